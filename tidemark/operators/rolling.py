"""Totals and averages over trailing periods of days, days without activity included.

Readings are summed to one sparse row per entity and day before anything is shuffled by
entity, so a window holds at most one row per day of the time covered. Calendar rows are
made from each day and the next one that has rows; the frames are RANGE frames over the
integer day number, and the averages' denominators are the lengths of the periods.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import day_number, day_of


def daily_totals(readings: DataFrame, entity: str, time: str, value: str, parts: Sequence[str] = ()) -> DataFrame:
    """One row per entity and day (int day number): __e, __day, total.

    A reading is an entity, day and ``parts`` (such as the device); delivered again it
    counts once, with its greatest value. Rows without entity or time are left out; a day
    whose values are all null has a row with total 0.
    """
    reading = (
        readings.where(F.col(entity).isNotNull() & F.col(time).isNotNull())
        .groupBy(F.col(entity).alias("__e"), day_number(time).alias("__day"), *(F.col(p).alias(f"__p{i}") for i, p in enumerate(parts)))
        .agg(F.max(F.col(value).cast("long")).alias("__v"))
    )
    return reading.groupBy("__e", "__day").agg(F.coalesce(F.sum("__v"), F.lit(0).cast("long")).alias("total"))


def trailing_totals(
    readings: DataFrame,
    entity: str,
    time: str,
    value: str,
    parts: Sequence[str] = (),
    periods: Sequence[int] = (7, 30),
    untracked_after: int | None = 60,
) -> DataFrame:
    """Per entity and day from its first to its last row: total, and for each period n total_n, average_n and active_n.

    ``active_n`` is the number of days with rows in the last n days, ``average_n`` is
    ``total_n / n`` whatever is missing. Where two successive days with rows are more than
    ``untracked_after`` days apart, the days between get no rows. Nulls, repeats and empty
    tables: see daily_totals.
    """
    own = Window.partitionBy("__e").orderBy("__day")
    sparse = daily_totals(readings, entity, time, value, parts).withColumn("__next", F.lead("__day").over(own))
    tracked = F.col("__next").isNotNull()
    if untracked_after is not None:
        tracked &= F.col("__next") - F.col("__day") <= untracked_after
    upto = F.when(tracked, F.col("__next") - 1).otherwise(F.col("__day"))
    calendar = sparse.select("__e", "__day", "total", F.explode(F.sequence("__day", upto)).alias("__d")).select(
        "__e",
        F.col("__d").alias("__day"),
        F.when(F.col("__d") == F.col("__day"), F.col("total")).otherwise(F.lit(0).cast("long")).alias("total"),
        F.when(F.col("__d") == F.col("__day"), 1).otherwise(0).alias("__active"),
    )
    columns = {}
    for n in periods:
        frame = own.rangeBetween(-(n - 1), 0)
        columns[f"total_{n}"] = F.sum("total").over(frame)
        columns[f"average_{n}"] = F.sum("total").over(frame) / F.lit(float(n))
        columns[f"active_{n}"] = F.sum("__active").over(frame)
    return calendar.withColumns(columns).select(F.col("__e").alias(entity), day_of("__day").alias("day"), "total", *columns)
