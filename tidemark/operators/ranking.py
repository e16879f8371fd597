"""Ranks, deciles and quartiles over a whole table, without a window that holds a large one in one task.

Rows are counted; up to ``PLAIN`` of them are one window. More are range partitioned by the
whole order, ties included, into buckets of about that many rows; they are ranked within their
bucket, and the buckets' sizes, one small row each, give the offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.written import written


#: Rows of one bucket, and up to which a window needs no buckets.
PLAIN = 500_000


def _bucketed(rows: DataFrame, n: int, order: Sequence[Column], most: int) -> DataFrame:
    """The rows with ``__b``, the number of their bucket in the order; written, as the buckets are sampled."""
    return written(rows.repartitionByRange(-(-n // most), *order).withColumn("__b", F.spark_partition_id()))


def global_rank(df: DataFrame, value: str, ties: Sequence[str], name: str = "rank", descending: bool = False, keep: bool = True, most: int = PLAIN) -> DataFrame:
    """Add ``name`` (1-based, no gaps) by ``value`` and then ``ties``, and ``n``, the number of ranked rows.

    Rows with a null value are left out. With ``keep`` the rows are made once, at once, and kept
    in the shared folder, without it, as for a plain scan, they are read again. A value that most rows
    share is cut by the ties, of whatever type; rows equal in all of these share a bucket.
    """
    rows = df.where(F.col(value).isNotNull())
    rows = written(rows) if keep else rows
    n = rows.count()
    order = [F.desc(value) if descending else F.asc(value), *(F.asc(x) for x in ties)]
    if n <= most:
        return rows.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long")).withColumn("n", F.lit(n).cast("long"))
    cut = _bucketed(rows, n, order, most)
    sizes = cut.groupBy("__b").agg(F.count(F.lit(1)).alias("__s"))
    offsets = sizes.select("__b", (F.sum("__s").over(Window.orderBy("__b")) - F.col("__s")).alias("__before"))  # one row per bucket
    placed = cut.withColumn("__r", F.row_number().over(Window.partitionBy("__b").orderBy(*order))).join(F.broadcast(offsets), "__b")
    return placed.withColumn(name, F.col("__before") + F.col("__r")).withColumn("n", F.lit(n).cast("long")).drop("__b", "__r", "__before")


def running_before(df: DataFrame, value: str, add: str, name: str, most: int = PLAIN) -> DataFrame:
    """Add ``name``: the sum of ``add`` over all rows with a smaller ``value``. Values are numbers, each in one row."""
    rows = written(df)
    n = rows.count()
    before = lambda w: F.coalesce(F.sum(add).over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if n <= most:
        return rows.withColumn(name, before(Window.partitionBy()))
    cut = _bucketed(rows, n, [F.asc(value)], most)
    sums = cut.groupBy("__b").agg(F.sum(add).alias("__s"))
    offsets = sums.select("__b", (F.sum("__s").over(Window.orderBy("__b")) - F.col("__s")).alias("__before"))  # one row per bucket
    return cut.withColumn("__own", before(Window.partitionBy("__b"))).join(F.broadcast(offsets), "__b").withColumn(name, F.col("__before") + F.col("__own")).drop("__b", "__own", "__before")


def decile_by_count(rank: Column, n: Column) -> Column:
    """Decile 1 to 10 from an ascending 1-based rank: the share of rows before it, in tenths."""
    return F.least(F.lit(10), (F.floor((rank - 1) * 10 / n) + 1).cast("int"))


def decile_by_percentile(rank: Column, n: Column) -> Column:
    """Decile from the percent rank of the position (a single row is the 100th percentile)."""
    share = F.when(n == 1, F.lit(100.0)).otherwise((rank - 1) / F.nullif(n - 1, F.lit(0)) * 100)
    return F.least(F.lit(10), (F.floor(share / 10) + 1).cast("int"))


def quantile_bins(df: DataFrame, value: str, bins: int = 10, name: str = "bin") -> DataFrame:
    """Right-closed bins between linearly interpolated quantiles, 1 to ``bins``; equal edges merge upward."""
    edges = df.agg(F.percentile(value, F.array(*(F.lit(i / bins) for i in range(1, bins)))).alias("__edges"))
    return (
        df.crossJoin(F.broadcast(edges))
        .withColumn(name, F.when(F.col(value).isNotNull(), F.size(F.filter("__edges", lambda e: e < F.col(value))) + 1))
        .drop("__edges")
    )


def min_max(df: DataFrame, value: str, scale: float = 10.0, name: str = "normalized") -> DataFrame:
    """Min-max normalisation to 0..scale; a constant column is 0. The two bounds are one broadcast row."""
    bounds = df.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    spread = F.col("__hi") - F.col("__lo")
    scaled = F.when(F.col(value).isNull(), None).when(spread == 0, F.lit(0.0)).otherwise((F.col(value) - F.col("__lo")) / F.nullif(spread, F.lit(0.0)) * scale)
    return df.crossJoin(F.broadcast(bounds)).withColumn(name, scaled).drop("__lo", "__hi")


def top_share(df: DataFrame, value: str, ties: Sequence[str], parts: int = 4, bottom: bool = False, at_least_one: bool = True) -> DataFrame:
    """The best (or worst) n // parts rows; at least one where asked."""
    size = F.floor(F.col("n") / parts)
    size = F.greatest(F.lit(1), size) if at_least_one else size
    return global_rank(df, value, ties, "__rank", descending=not bottom).where(F.col("__rank") <= size).drop("__rank", "n")


def latest(df: DataFrame, key: str, time: str, seq: str | None = None) -> DataFrame:
    """The newest row of each key; at equal times the smallest ``seq``. No window: one aggregate."""
    columns = [c for c in df.columns if c != key]
    order = F.struct(F.col(time), -F.col(seq)) if seq else F.col(time)
    return df.where(F.col(time).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("__x")).select(key, "__x.*")
