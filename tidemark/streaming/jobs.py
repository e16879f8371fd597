"""Structured Streaming jobs: ingestion with quarantine and upsert, windowed counts, sessions, alert dedupe, circuit states.

Times without zone are read as UTC and cast, as watermarks need timestamps with one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.metrics import hash_key
from ..operators import etl
from ..sources.written import scratch


def files(spark: SparkSession, path: str, schema, fmt: str = "parquet", per_trigger: int = 100) -> DataFrame:  # noqa: ANN001
    """New files of a folder as a stream; ``per_trigger`` bounds a batch."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", per_trigger).load(path)


def timed(stream: DataFrame, time: str, late: str) -> DataFrame:
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def windowed_counts(stream: DataFrame, time: str, by: Sequence[str], value: str, window: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Rows and sum of a value by window and key; rows later than the watermark are dropped."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    return timed(stream, time, late).groupBy(w, *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "total")


def session_counts(stream: DataFrame, time: str, user: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions by inactivity gap with their number of rows."""
    return timed(stream, time, late).groupBy(F.session_window(time, gap), user).agg(F.count(F.lit(1)).alias("n")).select(user, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def once_within(stream: DataFrame, time: str, key: Sequence[str], within: str = "60 minutes") -> DataFrame:
    """The first row of each key within the time, such as an alert that is sent once an hour."""
    keyed = timed(stream, time, within).withColumn("alert", hash_key(*(F.col(k) for k in key)))
    return keyed.dropDuplicatesWithinWatermark(["alert"])


def ingest(stream: DataFrame, rules: Sequence[etl.Rule], key: Sequence[str], seq: str, target: str, checkpoint: str) -> StreamingQuery:
    """Validate each batch, append the rejected rows with reasons to ``target/quarantine`` and the valid ones to ``target/log``.

    Each batch writes its own partition, so a batch that is run again after a failure replaces
    what it wrote: the log holds every row once. ``current`` reads the newest row per key.
    """

    def write(batch: DataFrame, number: int) -> None:
        marked = etl.with_reason(batch, rules, "reason").persist()
        try:
            marked.where("reason is null").drop("reason").write.mode("overwrite").parquet(f"{target}/log/batch={number}")
            marked.where("reason is not null").write.mode("overwrite").parquet(f"{target}/quarantine/batch={number}")
        finally:
            marked.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str, key: Sequence[str], seq: str) -> DataFrame:
    """The table that the ingested log amounts to: the row with the greatest ``seq`` of each key."""
    log = spark.read.parquet(f"{target}/log").drop("batch")
    values = [c for c in log.columns if c not in key]
    return log.groupBy(*key).agg(F.max_by(F.struct(*values), seq).alias("__v")).select(*key, "__v.*")


def circuit_states(events: DataFrame, service: str, time: str, failed: str, open_after: int = 5, close_after: int = 2, wait_seconds: int = 60) -> DataFrame:
    """service, at, state after each event: closed, open after failures in a row, half open after a wait, closed again after successes.

    A trigger's events of a service are taken in order of time, in whatever order and batches they come; at the same time successes come first.
    The state depends on the one before, so this is a loop, over one service's events of one trigger.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        name, failures, successes, opened = state.get if state.exists else ("closed", 0, 0, 0.0)
        line = pd.concat(list(batches)).sort_values([time, failed], kind="stable")
        moments, bad, names = line[time].map(pd.Timestamp.timestamp).to_numpy(), line[failed].to_numpy(bool), []
        for now, failure in zip(moments, bad):
            if name == "open" and now - opened >= wait_seconds:
                name, successes = "half_open", 0
            if failure:
                failures += 1
                if name == "half_open" or (name == "closed" and failures >= open_after):
                    name, opened = "open", float(now)
            elif name == "half_open":
                successes += 1
                if successes >= close_after:
                    name, failures = "closed", 0
            elif name == "closed":
                failures = 0
            names.append(name)
        state.update((name, failures, successes, opened))
        yield pd.DataFrame({service: key[0], "at": line[time].to_numpy(), "state": names})

    kind = events.schema[service].dataType.simpleString()
    return events.withColumn(time, F.col(time).cast("timestamp")).groupBy(service).applyInPandasWithState(
        step, f"{service} {kind}, at timestamp, state string", "name string, failures int, successes int, opened double", "append", GroupStateTimeout.NoTimeout
    )


def run_to_end(df: DataFrame, mode: str = "append", checkpoint: str | None = None, target: str | None = None) -> DataFrame:
    """Run a stream over what there is now and return its result, a table in the shared folder.

    Each trigger writes its own partition, so one that is run again replaces what it wrote. In complete
    mode the last trigger holds the whole result. A stream without any trigger gives no rows.
    """
    spark = df.sparkSession
    target = target or scratch(spark, "streams")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint or scratch(spark, "streams")).trigger(availableNow=True).start()
    query.awaitTermination()
    numbered = StructType([*df.schema.fields, StructField("batch", LongType())])
    try:
        rows = spark.read.schema(numbered).parquet(target)
    except AnalysisException:
        return spark.createDataFrame([], df.schema)
    if mode == "complete":
        rows = rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch")
    return rows.select(*df.columns)


def pipeline(steps: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]], start: DataFrame) -> dict[str, DataFrame]:
    """Named steps one after the other; the result of each by name. Nothing runs until a result is asked for."""
    out, df = {}, start
    for name, fn in steps:
        df = df.transform(fn)
        out[name] = df
    return out
