"""Per-key results where a few keys hold most rows.

Rows are range partitioned by the key *and* a secondary order, at quantiles that
Spark samples from the data, so a heavy key is cut into as many pieces as its share
of the rows asks for. Each piece yields one partial state per key, and only these
states, at most one per key and piece, are exchanged by key and stitched together.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class State:
    """A result that can be made in pieces: the aggregate ``make`` of a value over the rows of a piece, ``stitch`` over the pieces' states. Both are names of functions of pyspark.sql.functions."""

    name: str
    value: str | Column
    make: str
    stitch: str


def count_rows(name: str) -> State:
    return State(name, F.lit(1), "count", "sum")


def total(name: str, column: str) -> State:
    """Sum of whole numbers; null where every value is null."""
    return State(name, column, "sum", "sum")


def least(name: str, column: str) -> State:
    return State(name, column, "min", "min")


def greatest(name: str, column: str | Column) -> State:
    return State(name, column, "max", "max")


def spread(rows: DataFrame, key: Sequence[str], order: Sequence[str], pieces: int | None = None) -> DataFrame:
    """Range partition by key and order, so that no piece holds much more than its share.

    Rows that tie in key and order are told apart by a hash of all columns given and by the
    split they were read from, so not even a key whose rows are all alike stays together.
    """
    tie = [F.xxhash64(*rows.columns), F.spark_partition_id()]
    by = [*(F.col(c) for c in [*key, *order]), *tie]
    return rows.repartitionByRange(pieces, *by) if pieces else rows.repartitionByRange(*by)


def keyed_states(
    rows: DataFrame, key: Sequence[str], order: Sequence[str], states: Sequence[State], pieces: int | None = None
) -> DataFrame:
    """One row per key with the given states, without a task that holds a whole heavy key.

    Nulls in the key form a group of their own, nulls in the order come first, ties and
    repeated rows all count. An empty table gives no rows. Columns that no state uses are
    not read or moved, whatever their names.
    """
    plain = [s.value for s in states if isinstance(s.value, str)]
    named = list(dict.fromkeys([*key, *order, *plain]))
    values = [s.value if isinstance(s.value, str) else f"__v{i}" for i, s in enumerate(states)]
    # A constant is no column to move.
    made = [s.value.alias(v) for s, v in zip(states, values, strict=True) if v not in plain and s.make != "count"]
    pieced = spread(rows.select(*named, *made), key, order, pieces)
    partial = pieced.groupBy(*key, F.spark_partition_id().alias("__piece")).agg(
        *(getattr(F, s.make)(s.value if s.make == "count" else v).alias(f"__{i}") for i, (s, v) in enumerate(zip(states, values, strict=True)))
    )
    return partial.groupBy(*key).agg(*(getattr(F, s.stitch)(f"__{i}").alias(s.name) for i, s in enumerate(states)))


def heavy_keys(rows: DataFrame, key: str, order: Sequence[str], share: float = 0.025) -> DataFrame:
    """The keys that hold more than ``share`` of the rows, with their number of rows and share.

    A null key is no key, but its rows count in the whole.
    """
    counts = keyed_states(rows, [key], order, [count_rows("n_rows")])
    whole = counts.agg(F.sum("n_rows").alias("__all"))  # one row
    return (
        counts.crossJoin(F.broadcast(whole))
        .where(F.col(key).isNotNull() & (F.col("n_rows") > F.lit(share) * F.col("__all")))
        .select(key, "n_rows", (F.col("n_rows") / F.col("__all")).alias("share"))
    )
