"""Joins that need more than equal keys: by proximity, as of a day, pairs of groups, and dense grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def near_days(left: DataFrame, right: DataFrame, day: str, within: int) -> DataFrame:
    """left_day, right_day of all distinct pairs at most ``within`` days apart.

    Both sides are keyed by blocks of ``within`` days and the left is repeated for the two
    neighbouring blocks, so the join has an equal key and no row meets a far one.
    """
    width = max(1, within)
    a = left.select(F.col(day).alias("left_day")).where("left_day is not null").distinct()
    b = right.select(F.col(day).alias("right_day")).where("right_day is not null").distinct()
    block = lambda c: F.floor(F.unix_date(c) / width)
    keyed = a.withColumn("__k", F.explode(F.array(*(block("left_day") + i for i in (-1, 0, 1)))))
    return keyed.join(b.withColumn("__k", block("right_day")), "__k").where(F.abs(F.datediff("left_day", "right_day")) <= within).drop("__k")


def match_within(left: DataFrame, right: DataFrame, day: str, within: int) -> DataFrame:
    """left_day, right_day: each left day with its nearest right day (ties: the earlier), and the days of either side without partner."""
    pairs = near_days(left, right, day, within)
    best = pairs.groupBy("left_day").agg(F.min(F.struct(F.abs(F.datediff("left_day", "right_day")), "right_day")).alias("__m")).select("left_day", F.col("__m.right_day").alias("right_day"))
    a, b = (t.select(F.col(day).alias("d")).where("d is not null").distinct() for t in (left, right))
    none = F.lit(None).cast("date")
    only_a = a.join(pairs.select(F.col("left_day").alias("d")), "d", "left_anti").select(F.col("d").alias("left_day"), none.alias("right_day"))
    only_b = b.join(pairs.select(F.col("right_day").alias("d")), "d", "left_anti").select(none.alias("left_day"), F.col("d").alias("right_day"))
    return best.unionByName(only_a).unionByName(only_b)


def as_of_day(left: DataFrame, right: DataFrame, key: str, day: str, within: int) -> DataFrame:
    """Left rows with ``matched``: the latest right day of the key at or before the row's day, at most ``within`` days back.

    The right days of a key are few (one a day); each left row's day is looked up once per key
    and day, then joined back, so a key with many rows is no heavy window.
    """
    days = left.select(key, day).where(F.col(key).isNotNull() & F.col(day).isNotNull()).distinct()
    marks = days.select(key, day, F.lit(1).alias("__ask")).unionByName(right.select(key, day, F.lit(0).alias("__ask")))
    line = Window.partitionBy(key).orderBy(day, "__ask").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.max(F.when(F.col("__ask") == 0, F.col(day))).over(line)
    found = marks.withColumn("matched", seen).where("__ask = 1").select(key, day, F.when(F.datediff(day, "matched") <= within, F.col("matched")).alias("matched"))
    return left.join(found, [key, day], "left")


#: Groups that may be compared each with each.
MOST_GROUPS = 10_000


def _few(groups: DataFrame) -> None:
    """Raise where every pair would be more than a report: the result is as large as the square of the groups."""
    n = groups.limit(MOST_GROUPS + 1).count()
    if n > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups to compare each with each")


def pairwise_percent(groups: DataFrame, name: str, value: str) -> DataFrame:
    """name, against, percent for ordered pairs of groups; 0 where the base is 0. ``groups`` has one row per group, ``MOST_GROUPS`` at most."""
    _few(groups)
    other = groups.select(F.col(name).alias("against"), F.col(value).alias("__b"))
    change = F.coalesce(F.try_divide((F.col(value) - F.col("__b")) * 100.0, F.col("__b")), F.lit(0.0))
    return groups.join(other, F.col(name) != F.col("against")).select(name, "against", change.alias("percent"))


def upper_pairs(groups: DataFrame, name: str, value: str, multiplier: float = 1.5) -> DataFrame:
    """a, b, gap, is_significant for unordered pairs of groups: the gap against a multiple of the population deviation. ``MOST_GROUPS`` groups at most."""
    _few(groups)
    spread = groups.agg(F.stddev_pop(value).alias("__sd"))
    a, b = groups.select(F.col(name).alias("a"), F.col(value).alias("__x")), groups.select(F.col(name).alias("b"), F.col(value).alias("__y"))
    gap = F.abs(F.col("__x") - F.col("__y"))
    return a.join(b, F.col("a") < F.col("b")).crossJoin(F.broadcast(spread)).select("a", "b", gap.alias("gap"), (gap > F.lit(multiplier) * F.col("__sd")).alias("is_significant"))


def dense_means(df: DataFrame, group: str, metrics: str) -> DataFrame:
    """group, metric, value: means of the metrics in a map column over the rows that have them; 0 where a group has none."""
    long = df.select(group, F.explode(metrics).alias("metric", "__v"))
    means = long.groupBy(group, "metric").agg(F.avg("__v").alias("value"))
    grid = df.select(group).distinct().join(means.select("metric").distinct(), how="cross")  # groups times metrics: the result's own size
    return grid.join(means, [group, "metric"], "left").select(group, "metric", F.coalesce("value", F.lit(0.0)).alias("value"))


def leaderboard(scores: DataFrame, ranks: DataFrame, key: str, score: str) -> DataFrame:
    """Scores with ranks (rows without a rank are dropped) and their place by score, ties by key."""
    from .ranking import global_rank

    return global_rank(scores.join(ranks, key), score, [key], "place", descending=True).drop("n")


def edges_between(edges: DataFrame, nodes: DataFrame, node: str = "id") -> DataFrame:
    """The edges whose two ends are nodes, each once."""
    ids = nodes.select(F.col(node).alias("__n"))
    return edges.join(ids, F.col("src") == F.col("__n"), "left_semi").join(ids, F.col("dst") == F.col("__n"), "left_semi").distinct()


def without_orphans(edges: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """Edges from a row of ``source`` to a row of ``target``, both with a column id."""
    return edges.join(source.select(F.col("id").alias("src")), "src", "left_semi").join(target.select(F.col("id").alias("dst")), "dst", "left_semi").distinct()
