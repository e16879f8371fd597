"""One wide row per entity with counts, recency and totals for each of many kinds of event.

Events are first aggregated to a compact long table, one row per entity and kind, before
and after the shuffle, so an entity with a third of all events costs no more than its
kinds; only that table is pivoted, over a stated list of kinds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import micros

EDITORS = ("anonymous", "registered", "other", "unknown")
REVERTED = ("kept", "reverted", "unclear")
#: Size classes: powers of two up to this exponent, and what is larger.
LARGEST = 14
SIZES = ("same", "nosize", *(f"{sign}{2**k}" for sign in ("plus", "minus") for k in range(LARGEST + 1)))
KINDS = tuple(f"{e}_{r}_{s}" for e in EDITORS for r in REVERTED for s in SIZES)


def editor_kind(column: Column) -> Column:
    """The editor type without case and surrounding space; null or empty is unknown."""
    plain = F.lower(F.trim(column))
    return F.when(plain.isNull() | (plain == ""), "unknown").when(plain.isin(*EDITORS[:2]), plain).otherwise("other")


def size_kind(column: Column) -> Column:
    """Sign and power of two of a change: plus64 is 64 to 127 bytes more, the largest class is open."""
    value = F.abs(column.cast("long"))
    power = F.least(F.floor(F.log2(value.cast("double"))), F.lit(LARGEST))
    low = F.pow(F.lit(2.0), power).cast("long").cast("string")
    return F.when(column.isNull(), "nosize").when(column == 0, "same").otherwise(F.concat(F.when(column > 0, "plus").otherwise("minus"), low))


def latest_deliveries(rows: DataFrame, event_id: str, fetched: str, columns: Sequence[str]) -> DataFrame:
    """One row per event: the columns as last delivered (ties: the greatest values). Rows without id are left out."""
    known = F.max(F.struct(F.col(fetched).alias("__f"), *(F.col(c).alias(f"__k{i}") for i, c in enumerate(columns))))
    return (
        rows.where(F.col(event_id).isNotNull())
        .groupBy(F.col(event_id).alias("__id"))
        .agg(known.alias("__x"))
        .select("__id", *(F.col(f"__x.__k{i}").alias(c) for i, c in enumerate(columns)))
    )


def edit_features_long(revisions: DataFrame) -> DataFrame:
    """article, kind, n (distinct revisions), last (microseconds), bytes. Revisions without article are left out."""
    latest = latest_deliveries(
        revisions, "revision_id", "fetched_at", ["article", "timestamp", "editor_type", "is_reverted", "bytes_changed"]
    )
    reverted = F.when(F.col("is_reverted").isNull(), "unclear").when(F.col("is_reverted"), "reverted").otherwise("kept")
    return (
        latest.where(F.col("article").isNotNull())
        .select(
            "article",
            F.concat_ws("_", editor_kind(F.col("editor_type")), reverted, size_kind(F.col("bytes_changed"))).alias("kind"),
            micros("timestamp").alias("__t"),
            F.col("bytes_changed").cast("long").alias("__b"),
        )
        .groupBy("article", "kind")
        .agg(F.count(F.lit(1)).alias("n"), F.max("__t").alias("last"), F.sum("__b").alias("bytes"))
    )


def edit_features(revisions: DataFrame, kinds: Sequence[str] = KINDS) -> DataFrame:
    """One row per article; for each kind n_, bytes_ and age_ (seconds from its latest revision to the latest of all).

    Kinds without a revision have n 0 and null bytes and age; a total over nulls alone and the
    age of revisions without time are null. Of the deliveries of a revision the last counts.
    An empty table gives no rows.
    """
    long = edit_features_long(revisions)
    newest = long.agg(F.max("last").alias("__newest"))  # one row
    age = ((F.col("__newest") - F.col("last")) / 1_000_000).cast("long").alias("age")
    place = F.array_position(F.lit(list(kinds)), F.col("kind")).cast("int")
    placed = long.crossJoin(F.broadcast(newest)).select("article", place.alias("__p"), F.struct("n", "bytes", age).alias("__v"))
    # One map per entity, of as many entries as there are kinds at most: columns are read off, not aggregated.
    held = placed.groupBy("article").agg(F.map_from_entries(F.collect_list(F.when(F.col("__p") > 0, F.struct("__p", "__v")))).alias("__m"))
    # As text: building the columns one by one takes longer than running them.
    columns = [f"coalesce(__m[{i}].n, 0L) AS `n_{k}`" for i, k in enumerate(kinds, 1)]
    columns += [f"__m[{i}].{m} AS `{m}_{k}`" for i, k in enumerate(kinds, 1) for m in ("bytes", "age")]
    return held.selectExpr("article", *columns)
