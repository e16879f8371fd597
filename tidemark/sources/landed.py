"""Readers of responses as landed: API pages in JSON, series with unknown column names, CSV, and generated series."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.metrics import api_timestamp

PAGEVIEWS = "items array<struct<project string, article string, granularity string, timestamp string, access string, agent string, views bigint>>"
TOP = "items array<struct<year string, month string, day string, articles array<struct<article string, views bigint, rank bigint>>>>"
COUNTS = "items array<struct<results array<struct<timestamp string, editors bigint, edits bigint>>>>"
REVISIONS = "items array<struct<title string, revid bigint, user string, timestamp string, comment string, size bigint>>"


def pageviews(responses: DataFrame, body: str = "body", device: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Page views (article, timestamp, device_type, views) and the responses that lack a required field, with the reason."""
    parsed = responses.withColumn("__p", F.from_json(body, PAGEVIEWS))
    lacking = F.exists("__p.items", lambda i: i["project"].isNull() | i["article"].isNull() | i["granularity"].isNull() | i["timestamp"].isNull() | i["views"].isNull())
    reason = F.when(F.col("__p").isNull() | F.col("__p.items").isNull(), "no items").when(lacking, "missing field")
    marked = parsed.withColumn("reason", reason)
    items = marked.where("reason is null").select(F.explode("__p.items").alias("i"), *([F.lit(device).alias("d")] if device else [F.col("device_type").alias("d")]))
    good = items.select(F.col("i.article").alias("article"), api_timestamp(F.col("i.timestamp")).alias("timestamp"), F.col("d").alias("device_type"), F.col("i.views").alias("views")).where("timestamp is not null")
    return good, marked.where("reason is not null").drop("__p")


def top_articles(responses: DataFrame, body: str = "body", limit: int = 1000) -> DataFrame:
    """article, views, rank in the server's order, the first ``limit`` of each response."""
    items = responses.select(F.from_json(body, TOP)["items"][0]["articles"].alias("a"))
    return items.select(F.posexplode("a").alias("p", "x")).where(F.col("p") < limit).select(F.col("x.article").alias("article"), F.col("x.views").alias("views"), (F.col("p") + 1).alias("rank"))


def aggregate_views(responses: DataFrame, body: str = "body", articles: int = 6_900_000) -> DataFrame:
    """Total views and views per article over all items (``articles`` is the assumed number of articles)."""
    items = responses.select(F.explode(F.from_json(body, PAGEVIEWS)["items"]).alias("i"))
    return items.agg(F.sum("i.views").alias("total"), (F.sum("i.views") / F.lit(float(articles))).alias("per_article"))


def counts(responses: DataFrame, measure: str, body: str = "body") -> DataFrame:
    """date and ``editors`` or ``edits`` of each result."""
    r = responses.select(F.explode(F.from_json(body, COUNTS)["items"]).alias("i")).select(F.explode("i.results").alias("r"))
    return r.select(F.to_date(F.substring("r.timestamp", 1, 10)).alias("date"), F.col(f"r.{measure}").alias(measure)).where(F.col(measure).isNotNull())


def response_problems(responses: DataFrame, body: str = "body") -> DataFrame:
    """Each response with is_valid and a message; an empty list is valid, but worth a message."""
    p = F.from_json(body, "items array<struct<timestamp string>>")
    message = F.when(p.isNull(), "not an object").when(p["items"].isNull(), "no items").when(F.size(p["items"]) == 0, "empty items").when(p["items"][0]["timestamp"].isNull(), "no timestamp")
    return responses.withColumn("message", message).withColumn("is_valid", F.col("message").isNull() | (F.col("message") == "empty items"))


def revisions(responses: DataFrame, body: str = "body") -> DataFrame:
    """article, revision_id, timestamp, editor_id, editor_type, edit_summary of landed revision pages; reverts and sizes come later."""
    from ..functions.metrics import classify_editor

    i = responses.select(F.explode(F.from_json(body, REVISIONS)["items"]).alias("i"))
    return i.select(
        F.col("i.title").alias("article"), F.col("i.revid").alias("revision_id"), F.try_to_timestamp("i.timestamp").cast("timestamp_ntz").alias("timestamp"), F.col("i.user").alias("editor_id"),
        classify_editor(F.col("i.user")).alias("editor_type"), F.lit(False).alias("is_reverted"), F.lit(0).alias("bytes_changed"), F.col("i.comment").alias("edit_summary"),
    )


class PagedFiles(DataSource):
    """``paged_json``: pages of JSON that name their successor. Each start is a partition and is followed to its end.

    Options: ``path`` (folder of the pages) and ``starts`` (comma list of first pages; by default
    every page that no other page names). A page is ``{"items": [...], "next": "file"}``.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "start string, page int, item string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _PagedReader(self.options)


class _PagedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.starts = options["path"], options.get("starts")

    def partitions(self) -> list[InputPartition]:
        if self.starts:
            return [InputPartition(s) for s in self.starts.split(",")]
        files = sorted(f for f in os.listdir(self.path) if f.endswith(".json"))
        named = set()
        for f in files:
            with open(os.path.join(self.path, f), encoding="utf-8") as page:
                named.add(json.load(page).get("next"))
        return [InputPartition(f) for f in files if f not in named]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        at, n, seen = partition.value, 0, set()
        while at and at not in seen:
            seen.add(at)
            with open(os.path.join(self.path, at), encoding="utf-8") as f:
                page = json.load(f)
            for item in page.get("items", []):
                yield partition.value, n, json.dumps(item)
            at, n = page.get("next"), n + 1


def paged(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(PagedFiles)
    return spark.read.format("paged_json").option("path", path).load()


#: Names under which dates and values are looked for, in order.
DATE_NAMES, VALUE_NAMES = ("date", "timestamp", "datetime"), ("values", "value", "count", "views", "editors", "edits")


def series_from(df: DataFrame, metric: str, platform: str = "all") -> DataFrame:
    """date, value, platform, metric_type from a table with other column names; a platform column goes before the argument."""
    lower = {c.lower(): c for c in df.columns}
    day = next((lower[n] for n in DATE_NAMES if n in lower), None)
    value = next((lower[n] for n in VALUE_NAMES if n in lower), None)
    if day is None or value is None:
        raise ValueError(f"no date or value column among {df.columns}")
    p = F.col(lower["platform"]) if "platform" in lower else F.lit(platform)
    return df.select(F.to_date(day).alias("date"), F.col(value).cast("double").alias("value"), p.alias("platform"), F.lit(metric).alias("metric_type"))


def with_external(df: DataFrame, path: str, schema: str, on: str = "date") -> DataFrame:
    """Left join of a CSV with a header; a missing file leaves the table as it is."""
    spark = df.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return df
    return df.join(spark.read.csv(path, header=True, schema=schema), on, "left")


def synthetic_traffic(spark: SparkSession, days: int = 730, platforms: tuple[str, ...] = ("desktop", "mobile-web", "mobile-app"), start: str = "2023-01-01", step_after: int = 400, seed: int = 21) -> DataFrame:
    """date, platform, pageviews, editors, edits: trend, weekly and yearly waves, a step, and noise from a hash of the row, so the same everywhere."""
    p = F.explode(F.array(*(F.struct(F.lit(x).alias("platform"), F.lit(1.0 / (i + 1)).alias("w")) for i, x in enumerate(platforms))))
    rows = spark.range(days).select(F.col("id").alias("t"), p.alias("p"))
    noise = lambda k: F.pmod(F.xxhash64("t", "p.platform", F.lit(seed + k)), F.lit(1_000_003)) / 1_000_003.0 - 0.5
    level = (1 + 0.0004 * F.col("t")) * (1 + 0.15 * F.sin(F.col("t") * 2 * 3.141592653589793 / 7)) * (1 + 0.2 * F.sin(F.col("t") * 2 * 3.141592653589793 / 365))
    level = level * F.when(F.col("t") > step_after, 1.12).otherwise(1.0) * F.col("p.w")
    return rows.select(
        F.date_add(F.lit(start).cast("date"), F.col("t").cast("int")).alias("date"), F.col("p.platform").alias("platform"),
        F.round(1e6 * level * (1 + 0.06 * noise(0))).cast("long").alias("pageviews"), F.round(4e3 * level * (1 + 0.1 * noise(1))).cast("long").alias("editors"), F.round(2e4 * level * (1 + 0.1 * noise(2))).cast("long").alias("edits"),
    )


def synthetic_companies(spark: SparkSession, n: int = 150, seed: int = 42) -> DataFrame:
    """company_id, sector, revenue_rank, employee_count, github_stars, github_forks, contributors from hashes of the number."""
    u = lambda k: F.pmod(F.xxhash64("id", F.lit(seed + k)), F.lit(1_000_003)) / 1_000_003.0
    sectors = F.array(*(F.lit(s) for s in ("Technology", "Finance", "Healthcare", "Energy", "Retail")))
    return spark.range(1, n + 1).select(
        F.format_string("COMP%03d", "id").alias("company_id"), F.element_at(sectors, (F.floor(u(0) * 5) + 1).cast("int")).alias("sector"), F.col("id").cast("int").alias("revenue_rank"),
        (1000 + F.floor(u(1) * 199_000)).cast("int").alias("employee_count"), F.floor(F.pow(u(2), F.lit(3.0)) * 1e5).cast("int").alias("github_stars"), F.floor(F.pow(u(3), F.lit(3.0)) * 3e4).cast("int").alias("github_forks"), F.floor(u(4) * 5000).cast("int").alias("contributors"),
    )
