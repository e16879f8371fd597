"""Validation, quarantine, first-seen dedupe, upserts and dimensions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEVICES = ("desktop", "mobile-web", "mobile-app")
Rule = tuple[str, Column]


def _text(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)) != "", F.lit(False))


def pageview_rules() -> list[Rule]:
    v = F.col
    return [
        ("empty article", _text("article")),
        ("negative count", (v("views_human") >= 0) & (v("views_bot") >= 0) & (v("views_total") >= 0)),
        ("total mismatch", v("views_total") == v("views_human") + v("views_bot")),
        ("unknown device", v("device_type").isin(*DEVICES)),
    ]


def revision_rules() -> list[Rule]:
    return [
        ("empty article", _text("article")),
        ("bad revision", F.col("revision_id") > 0),
        ("unknown editor type", F.col("editor_type").isin("anonymous", "registered")),
    ]


def article_rules() -> list[Rule]:
    return [("missing title", _text("title")), ("bad url", F.col("url").startswith("http"))]


def with_reason(df: DataFrame, rules: Sequence[Rule], name: str = "reason") -> DataFrame:
    """Add the first rule that a row breaks, null for a valid row. A rule that a null leaves open counts as broken."""
    reason = None
    for label, holds in rules:
        broken = ~F.coalesce(holds, F.lit(False))
        reason = F.when(broken, F.lit(label)) if reason is None else reason.when(broken, F.lit(label))
    return df.withColumn(name, reason if reason is not None else F.lit(None).cast("string"))


def split_valid(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the others with their reason. Every row is in exactly one of both."""
    marked = with_reason(df, rules, "__reason")
    return marked.where("__reason is null").drop("__reason"), marked.where("__reason is not null").withColumnRenamed("__reason", "reason")


def keep_first(df: DataFrame, key: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """One row per key: the first by ``seq`` (nulls in the key are a value; ties: the smallest row)."""
    rest = [c for c in df.columns if c not in key]
    order = F.struct(*seq, F.xxhash64(*rest)) if rest else F.struct(*seq)
    picked = df.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("__x")) if rest else df.select(*key).distinct()
    return picked.select(*(c if c in key else F.col(f"__x.{c}").alias(c) for c in df.columns)) if rest else picked


def upsert(current: DataFrame, batch: DataFrame, key: Sequence[str], seq: str) -> DataFrame:
    """The table after a batch: a batch row replaces the current row of its key; within the batch the greatest ``seq`` wins."""
    values = [c for c in current.columns if c not in key]
    old = current.select(*key, F.struct(*values).alias("__v"), F.lit(0).alias("__new"), F.lit(None).cast(batch.schema[seq].dataType).alias("__s"))
    new = batch.select(*key, F.struct(*values).alias("__v"), F.lit(1).alias("__new"), F.col(seq).alias("__s"))
    return old.unionByName(new).groupBy(*key).agg(F.max_by("__v", F.struct("__new", "__s")).alias("__v")).select(*key, *(F.col(f"__v.{c}").alias(c) for c in values))


def upsert_dimension(dimension: DataFrame, seen: DataFrame, key: str, when: str, defaults: dict[str, Column]) -> DataFrame:
    """Insert unseen keys (surrogate ``id`` from a hash of the key), touch ``last_updated`` of seen ones."""
    news = seen.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(when).alias("__when"))
    both = dimension.join(news, key, "full_outer")
    fresh = F.col("id").isNull()
    columns = {
        "id": F.coalesce(F.col("id").cast("long"), F.xxhash64(key)),
        "first_seen": F.when(fresh, F.col("__when")).otherwise(F.col("first_seen")),
        "last_updated": F.greatest("last_updated", "__when"),
        **{c: F.when(fresh, v).otherwise(F.col(c)) for c, v in defaults.items()},
    }
    return both.withColumns(columns).select(*dimension.columns)


def date_dimension(dates: DataFrame, column: str = "date") -> DataFrame:
    """date, year, quarter, month, week (ISO), day_of_week (Monday 0) and is_weekend of the distinct dates."""
    d = F.col("date")
    return dates.select(F.to_date(column).alias("date")).where("date is not null").distinct().select(
        d, F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.month(d).alias("month"), F.weekofyear(d).alias("week"),
        F.weekday(d).alias("day_of_week"), (F.weekday(d) >= 5).alias("is_weekend"),
    )


def quality(df: DataFrame, entity: str, fields: Sequence[str], empty_is_missing: Sequence[str] = ()) -> DataFrame:
    """field, missing (number of entities without it) and completeness in percent; an empty table is 0 % complete."""
    def missing(f: str) -> Column:
        c = F.col(f)
        return c.isNull() | (c == "") if f in empty_is_missing else c.isNull()

    counts = df.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(missing(f)).alias(f) for f in fields))
    complete = F.coalesce(F.try_divide(100.0 * (F.col("n") - F.col("missing")), F.col("n")), F.lit(0.0))
    return counts.unpivot("n", list(fields), "field", "missing").select("field", "missing", complete.alias("completeness"))


def completeness(days: DataFrame, day: str, first: str, last: str, most_missing: float = 0.10) -> DataFrame:
    """One row: expected, actual and missing days, score, whether enough are there, and the largest step between missing days."""
    from pyspark.sql import Window

    spark = days.sparkSession
    expected = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("__d"))
    actual = days.select(F.to_date(day).alias("__d")).where("__d is not null").distinct()
    missing = expected.join(actual, "__d", "left_anti").withColumn("__gap", F.datediff("__d", F.lag("__d").over(Window.orderBy("__d"))))
    n_expected = F.datediff(F.lit(last).cast("date"), F.lit(first).cast("date")) + 1
    return (
        actual.agg(F.count(F.lit(1)).alias("actual"))
        .crossJoin(missing.agg(F.count(F.lit(1)).alias("missing"), F.max("__gap").alias("max_gap")))
        .select(
            n_expected.cast("long").alias("expected"), "actual", "missing", (F.col("actual") / n_expected).alias("score"),
            (F.col("missing") <= F.lit(most_missing) * n_expected).alias("is_complete"), "max_gap",
        )
    )


def outliers(df: DataFrame, value: str, by: Sequence[str] = (), limit: float = 3.0) -> DataFrame:
    """Rows whose |z| against the group's mean and population deviation is over ``limit``; a constant group has none."""
    v = F.col(value).cast("double")
    stats = df.groupBy(*by).agg(F.avg(v).alias("__m"), F.stddev_pop(v).alias("__sd"))
    joined = df.join(stats, list(by)) if by else df.crossJoin(F.broadcast(stats))
    z = F.try_divide(v - F.col("__m"), F.col("__sd"))
    return joined.withColumn("z", z).where((F.col("__sd") > 0) & (F.abs("z") > limit)).drop("__m", "__sd")


def has_missing(df: DataFrame, name: str = "has_missing") -> DataFrame:
    """Flag rows in which any column is null."""
    flag = F.lit(False)
    for c in df.columns:
        flag = flag | F.col(c).isNull()
    return df.withColumn(name, flag)


def schema_matches(df: DataFrame, expected: dict[str, str]) -> bool:
    """Whether the columns are there with the kinds int, float, str or date. No rows are read."""
    kinds = {"int": {"tinyint", "smallint", "int", "bigint"}, "float": {"float", "double"}, "str": {"string"}, "date": {"date", "timestamp", "timestamp_ntz"}}
    have = dict(df.dtypes)
    return all(c in have and have[c] in kinds.get(k, {k}) for c, k in expected.items())
