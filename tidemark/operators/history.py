"""Histories of changing attributes: type-two dimensions from snapshots or updates.

``merge_updates`` brings a batch of updates into a history: attribute hashes are compared with the
version before, changed versions are closed and new ones opened. A batch may hold any number of
updates of an entity, corrections of moments already reported and rows that come late: an
entity's versions from its first moment in the batch on are replayed from the log of updates,
everything before stays as it is. ``merged_history`` does so batch by batch in the order of
loading, ``attribute_history`` is the merge of everything into nothing.

An entity's rows are cut into pieces of time; carrying values forward and comparing with
the row before happen within a piece, and what crosses pieces is one summary row per
entity and piece. An entity with a third of all rows is thus many small windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import from_micros, micros
from ..sources.written import written

LEAST = -(2**63)


def attribute_hash(columns: Sequence[Column]) -> Column:
    """A hash in which nulls have a place of their own."""
    return F.xxhash64(*(x for c in columns for x in (c.isNull(), c)))


def _rows(snapshots: DataFrame, entity: str, valid: str, load: str, attributes: Sequence[str]) -> DataFrame:
    """__id, __t, __l and the attributes as __a0, ...; rows without entity or time are left out."""
    return snapshots.where(F.col(entity).isNotNull() & F.col(valid).isNotNull()).select(
        F.col(entity).alias("__id"), micros(valid).alias("__t"), F.coalesce(F.col(load).cast("long"), F.lit(LEAST)).alias("__l"), *(F.col(a).alias(f"__a{i}") for i, a in enumerate(attributes))
    )


def _newest(rows: DataFrame, names: list[str]) -> DataFrame:
    """Of the rows of an entity and time the one loaded last."""
    return rows.groupBy("__id", "__t").agg(F.max_by(F.struct(*names), "__l").alias("__x")).select("__id", "__t", "__x.*")


def _versions(rows: DataFrame, names: list[str], piece_days: int) -> DataFrame:
    """__id, the attributes, __t and __end of each version. ``rows``: one per __id and __t."""
    piece = Window.partitionBy("__id", "__c")
    line = piece.orderBy("__t")
    rows = rows.select("__id", F.floor(F.col("__t") / (piece_days * 86_400_000_000)).alias("__c"), "__t", *names)
    local = rows.select("__id", "__c", "__t", *(F.last(n, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0)).alias(n) for n in names))
    ended = local.groupBy("__id", "__c").agg(*(F.max_by(n, "__t").alias(n) for n in names))
    # One row per entity and piece of time from here on: what holds before the piece.
    pieces = Window.partitionBy("__id").orderBy("__c")
    before = ended.select(
        "__id",
        "__c",
        F.lag("__c").over(pieces).isNotNull().alias("__known"),
        *(F.last(n, ignorenulls=True).over(pieces.rowsBetween(Window.unboundedPreceding, -1)).alias(f"{n}p") for n in names),
    )
    filled = local.join(before, ["__id", "__c"]).withColumns({n: F.coalesce(F.col(n), F.col(f"{n}p")) for n in names})
    own = [F.col(n) for n in names]
    hashed = filled.withColumn("__h", attribute_hash(own)).withColumn("__first", F.row_number().over(line) == 1)
    prior = lambda n, p: F.when(F.col("__first"), F.col(p)).otherwise(F.lag(n).over(line))
    hashed = hashed.withColumn("__hp", attribute_hash([F.col(f"{n}p") for n in names]))
    hashed = hashed.withColumns({"__hq": prior("__h", "__hp"), **{f"{n}q": prior(n, f"{n}p") for n in names}})
    # Other hashes, other values; equal hashes are looked into, should two ever meet by chance.
    changed = F.col("__h") != F.col("__hq")
    for n in names:
        changed |= ~F.col(n).eqNullSafe(F.col(f"{n}q"))
    versions = hashed.where((F.col("__first") & ~F.col("__known")) | changed).select("__id", "__c", "__t", *names)
    starts = versions.groupBy("__id", "__c").agg(F.min("__t").alias("__s"))
    after = starts.select("__id", "__c", F.lead("__s").over(pieces).alias("__after"))
    closed = versions.withColumn("__end", F.lead("__t").over(line)).join(after, ["__id", "__c"])
    return closed.select("__id", *names, "__t", F.coalesce(F.col("__end"), F.col("__after")).alias("__end"))


def _named(versions: DataFrame, entity: str, attributes: Sequence[str]) -> DataFrame:
    return versions.select(
        F.col("__id").alias(entity), *(F.col(f"__a{i}").alias(a) for i, a in enumerate(attributes)), from_micros("__t").alias("valid_from"), from_micros("__end").alias("valid_to"), F.col("__end").isNull().alias("is_current")
    )


def attribute_history(snapshots: DataFrame, entity: str, valid: str, load: str, attributes: Sequence[str], piece_days: int = 30) -> DataFrame:
    """One row per version: entity, the attributes, valid_from, valid_to and is_current.

    Rows without entity or ``valid`` time are left out. Of rows with the same entity and time the
    one with the greatest ``load`` counts. A null attribute was not reported, and the last
    reported value goes on. A version starts at an entity's first row and wherever an attribute
    differs from the row before; a return to earlier values is a new version. valid_to is the
    start of the next version, null for the current one. Columns not named play no part.
    """
    names = [f"__a{i}" for i in range(len(attributes))]
    return _named(_versions(_newest(_rows(snapshots, entity, valid, load, attributes), names), names, piece_days), entity, attributes)


def merge_updates(history: DataFrame, log: DataFrame, batch: DataFrame, entity: str, valid: str, load: str, attributes: Sequence[str], piece_days: int = 30) -> DataFrame:
    """The history of ``log`` and ``batch`` together, from ``history``, that of ``log``.

    Entities without a row in the batch pass through, and so do versions that ended before the
    entity's first moment in the batch. The version that held just before this moment is the row
    that the batch is compared with; it is closed where a later row's hash differs. Updates of the
    log from that moment on are replayed between those of the batch, so late rows and corrections
    come out as if they had been there in time. Nulls, ties and columns as in ``attribute_history``.
    """
    names = [f"__a{i}" for i in range(len(attributes))]
    come = _rows(batch, entity, valid, load, attributes)
    first = come.groupBy("__id").agg(F.min("__t").alias("__first"))
    known = history.select(
        F.col(entity).alias("__id"), *(F.col(a).alias(n) for a, n in zip(attributes, names, strict=True)), micros("valid_from").alias("__t"), micros("valid_to").alias("__end")
    ).join(first, "__id", "left")
    ended = F.col("__end") < F.col("__first")
    passing = known.where(F.col("__first").isNull() | F.coalesce(ended, F.lit(False))).select("__id", *names, "__t", "__end")
    held = known.where((F.col("__t") < F.col("__first")) & ~F.coalesce(ended, F.lit(False))).select("__id", "__t", *names)
    again = _rows(log, entity, valid, load, attributes).join(first, "__id").where(F.col("__t") >= F.col("__first")).drop("__first")
    replayed = _versions(held.unionByName(_newest(come.unionByName(again), names)), names, piece_days)
    return _named(passing.unionByName(replayed), entity, attributes)


def merged_history(snapshots: DataFrame, entity: str, valid: str, load: str, attributes: Sequence[str], batches: int = 2, piece_days: int = 30) -> DataFrame:
    """The history of ``snapshots``, merged in batches of about equal size in the order of ``load``; rows without load come first.

    The history between batches is written to the shared folder before the result is asked for.
    """
    kept = snapshots.select(entity, valid, load, *attributes)
    order = F.coalesce(F.col(load).cast("long"), F.lit(LEAST))
    edges = kept.agg(F.percentile_approx(order, F.array(*(F.lit(i / batches) for i in range(1, batches))), 1_000)).first()[0] if batches > 1 else None
    bounds = [None, *sorted(set(edges or [])), None]
    history = None
    for lo, hi in zip(bounds, bounds[1:]):
        batch = kept.where((order > lo if lo is not None else F.lit(True)) & (order <= hi if hi is not None else F.lit(True)))
        if history is None:
            history = attribute_history(batch, entity, valid, load, attributes, piece_days)
        else:
            history = merge_updates(written(history), kept.where(order <= lo), batch, entity, valid, load, attributes, piece_days)
    return history
