"""Versioned results with checksums, exports, and append-only logs of lineage and metrics."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class IntegrityError(RuntimeError):
    """A stored result is not what its manifest says."""


def checksum(df: DataFrame) -> DataFrame:
    """One row: n, checksum, an order-free sum of row hashes (repeated rows count)."""
    h = F.xxhash64(*(x for c in df.columns for x in (F.col(c).isNull(), F.col(c)))) if df.columns else F.lit(0).cast("long")
    return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("checksum"))


def save_version(df: DataFrame, base: str, version: str) -> None:
    """Write ``base/data/version=...`` and one manifest row; a version is written once."""
    where = f"{base}/data/version={version}"
    df.write.mode("error").parquet(where)
    spark = df.sparkSession
    stored = checksum(spark.read.parquet(where)).select(F.lit(version).alias("version"), "n", "checksum", F.lit(df.schema.json()).alias("schema"), F.current_timestamp().alias("written_at"))
    stored.coalesce(1).write.mode("append").parquet(f"{base}/manifest")


def versions(spark: SparkSession, base: str) -> DataFrame:
    """The manifest, newest version first."""
    return spark.read.parquet(f"{base}/manifest").orderBy(F.desc("version"))


def load_version(spark: SparkSession, base: str, version: str | None = None, verify: bool = True) -> DataFrame:
    """A version (by default the latest), after its checksum has been compared with the manifest's."""
    listed = versions(spark, base)
    row = (listed.where(F.col("version") == version) if version else listed).first()
    if row is None:
        raise IntegrityError(f"no manifest of version {version} in {base}")
    df = spark.read.schema(StructType.fromJson(json.loads(row.schema))).parquet(f"{base}/data/version={row.version}")
    if verify:
        now = checksum(df).first()
        if (now.n, now.checksum) != (row.n, row.checksum):
            raise IntegrityError(f"version {row.version} of {base} has changed")
    return df


def compare_versions(spark: SparkSession, base: str, a: str, b: str) -> DataFrame:
    """One row: whether checksums agree, the difference in rows, and the rows that only one of both has."""
    x, y = load_version(spark, base, a, False), load_version(spark, base, b, False)
    m = {r.version: r for r in versions(spark, base).where(F.col("version").isin(a, b)).collect()}
    only_a, only_b = x.exceptAll(y).agg(F.count(F.lit(1)).alias("only_a")), y.exceptAll(x).agg(F.count(F.lit(1)).alias("only_b"))
    return only_a.crossJoin(only_b).select(F.lit(m[a].checksum == m[b].checksum).alias("same"), F.lit(m[b].n - m[a].n).alias("rows_more"), "only_a", "only_b")


def export_wide(metrics: DataFrame, key: str, name: str, value: str, names: list[str]) -> DataFrame:
    """One row per key with a column for each named metric in order of names; missing is null, of repeats the greatest counts."""
    return metrics.groupBy(key).pivot(name, sorted(names)).agg(F.max(value)).orderBy(key)


def export_json(metrics: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """One JSON object per key with the metrics it has."""
    maps = metrics.where(F.col(value).isNotNull()).groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct(name, value)))).alias("m"))
    return maps.select(key, F.to_json(F.struct(F.col(key), F.col("m").alias("metrics"))).alias("json"))


def export_rows(wide: DataFrame) -> DataFrame:
    """Rows as arrays of text with nulls kept, for tools that take columns and rows apart."""
    return wide.select(F.array(*(F.col(c).cast("string") for c in wide.columns)).alias("row"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def lineage(spark: SparkSession, run: str, source: str, steps: list[str], read: int, loaded: int, quarantined: int) -> DataFrame:
    """One lineage row, to append to a log."""
    return spark.createDataFrame([(run, source, steps, read, loaded, quarantined)], "run string, source string, steps array<string>, n_read bigint, n_loaded bigint, n_quarantined bigint").withColumn("at", F.current_timestamp())


def run_metrics(runs: DataFrame) -> DataFrame:
    """Success rate of each run; nothing read is 0."""
    return runs.select("run", "source", F.coalesce(F.try_divide("n_loaded", "n_read"), F.lit(0.0)).alias("success_rate"), "n_quarantined")


def write_text(lines: DataFrame, path: str) -> None:
    """Write a column ``line`` as text files; a report's few lines keep their order in one file."""
    lines.select("line").coalesce(1).write.mode("overwrite").text(path)
