"""Sessions: the events of a user that follow each other within a gap.

Sweep line: each event adds one at its time and takes one away a gap later; where the
running sum returns to zero a session is closed. Events are first joined to spans, one per user
and stretch of a gap's length, by plain aggregation; the sweep per user then holds at most
one span per gap of the time covered, however many events there are. Where values are
counted in each session, a user's events are swept in pieces of fixed length of time, and the
pieces' sessions again per user.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import from_micros, micros
from ..sources.written import written

SECOND = 1_000_000


def _sweep(spans: DataFrame, keys: list[str], gap: int, keep: list[Column] = ()) -> DataFrame:
    """The rows of ``spans`` (keys, __start, __end, __n, __first, __last) twice, as rise and fall, with ``__closed``: the sessions closed before."""
    deltas = spans.select(
        *keys,
        "__n",
        *keep,
        F.explode(
            F.array(
                F.struct(F.col("__start").alias("t"), F.lit(1).alias("d"), F.col("__first").alias("e")),
                F.struct((F.col("__end") + gap).alias("t"), F.lit(-1).alias("d"), F.col("__last").alias("e")),
            )
        ).alias("__x"),
    ).select(*keys, "__n", *[c for c in keep], F.col("__x.t").alias("__t"), F.col("__x.d").alias("__d"), F.col("__x.e").alias("__e"))
    # A rise at the moment of a fall comes first: a gap of exactly the limit goes on.
    line = Window.partitionBy(*keys).orderBy("__t", F.col("__d").desc(), "__e")
    swept = deltas.withColumn("__open", F.sum("__d").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    closes = F.when(F.col("__open") == 0, 1).otherwise(0)
    return swept.withColumn("__closed", F.coalesce(F.sum(closes).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def _close(swept: DataFrame, keys: list[str], gap: int, sums: list[str] = ()) -> DataFrame:
    """One row per session. The rise from zero carries its first event, the fall to zero its last; ``sums`` are added up over the rises."""
    opens = (F.col("__d") == 1) & (F.col("__open") == 1)
    closes = F.col("__open") == 0
    return swept.groupBy(*keys, "__closed").agg(
        F.max(F.when(opens, F.col("__t"))).alias("__start"),
        F.max(F.when(closes, F.col("__t") - gap)).alias("__end"),
        F.max(F.when(opens, F.col("__e"))).alias("__first"),
        F.max(F.when(closes, F.col("__e"))).alias("__last"),
        *(F.sum(F.when(F.col("__d") == 1, F.col(c)).otherwise(0)).alias(c) for c in ["__n", *sums]),
    )


def _spans(events: DataFrame, user: str, time: str, event_id: str, gap: int) -> DataFrame:
    """One row per user and stretch of a gap's length: the events in it follow each other within the gap.

    Events of a user are spread by their time, so that not even a burst stays together, and added up before and after the exchange.
    """
    once = (
        events.select(F.col(user).alias("__u"), micros(time).alias("__t"), F.col(event_id).cast("long").alias("__e"))
        .repartition("__u", "__t")
        .distinct()
        .groupBy("__u", "__t")
        .agg(F.count(F.lit(1)).alias("__n"), F.min("__e").alias("__a"), F.max("__e").alias("__b"))
    )
    return once.groupBy("__u", F.floor(F.col("__t") / gap).alias("__c")).agg(
        F.min("__t").alias("__start"), F.max("__t").alias("__end"), F.sum("__n").alias("__n"), F.min_by("__a", "__t").alias("__first"), F.max_by("__b", "__t").alias("__last")
    ).drop("__c")


def sessions(
    events: DataFrame,
    user: str,
    time: str,
    event_id: str,
    gap_seconds: int = 1800,
    distinct: str | None = None,
    piece_seconds: int = 6 * 3600,
) -> DataFrame:
    """Sessions of each user: user, start, end, seconds, n_events, first_id, last_id and, with ``distinct``, n_distinct.

    Events without user (null or empty) or time belong to none. Of the rows with the same
    user, time and id one counts; a null id counts once per user and time. At the same time
    the smaller id comes first, a null id gives way to others. ``n_distinct`` counts the non-null values of the column
    ``distinct`` in the session. An empty table gives no sessions.
    """
    gap, piece = gap_seconds * SECOND, piece_seconds * SECOND
    known = events.where((F.col(user) != "") & F.col(time).isNotNull())
    if not distinct:
        return _named(_close(_sweep(_spans(known, user, time, event_id, gap), ["__u"], gap), ["__u"], gap), user)
    rows = (
        known.select(F.col(user).alias("__u"), micros(time).alias("__start"), F.col(event_id).cast("long").alias("__first"), F.col(distinct).alias("__v"))
        .withColumn("__c", F.floor(F.col("__start") / piece))
        .repartition("__u", "__c")
    )
    once = (
        rows.groupBy("__u", "__c", "__start", "__first")
        .agg(F.max("__v").alias("__v"))
        .withColumns({"__end": F.col("__start"), "__last": F.col("__first"), "__n": F.lit(1).cast("long")})
    )
    local = _sweep(once, ["__u", "__c"], gap, ["__v"])
    # A value counts in its piece where it comes first; all of this stays in the pieces' partitions.
    own, rise = ["__u", "__c", "__closed"], F.col("__d") == 1
    nth = F.row_number().over(Window.partitionBy(*own, "__v", "__d").orderBy("__t"))
    whole_piece = Window.partitionBy(*own)
    marked = local.withColumn("__m", F.when(rise & F.col("__v").isNotNull() & (nth == 1), 1).otherwise(0)).withColumns(
        {"__a": F.min(F.when(rise, F.col("__t"))).over(whole_piece), "__b": F.max(F.when(rise, F.col("__t"))).over(whole_piece)}
    )
    pieces = _close(marked, ["__u", "__c"], gap, ["__m"])
    kept = ["__m", "__end", "__last", "__pc", "__ps"]
    swept = _sweep(pieces.withColumnsRenamed({"__c": "__pc", "__closed": "__ps"}), ["__u"], gap, kept)
    # One row per piece with its session; three things below read it, so it is made once.
    parts = written(swept.where("__d = 1").select("__u", "__closed", "__n", F.col("__t").alias("__start"), F.col("__e").alias("__first"), *kept))
    joined = parts.groupBy("__u", "__closed").agg(
        F.min("__start").alias("__start"), F.max("__end").alias("__end"), F.sum("__n").alias("__n"), F.sum("__m").alias("__m"), F.min_by("__first", "__start").alias("__first"), F.max_by("__last", "__end").alias("__last")
    )
    # Only pieces that reach an edge of their stretch of time can have been joined to others; their values are counted anew.
    edge = lambda a, b, c: (F.col(a) - gap < F.col(c) * piece) | (F.col(b) + gap >= (F.col(c) + 1) * piece)
    seen = marked.where((F.col("__m") == 1) & edge("__a", "__b", "__c")).select("__u", F.col("__c").alias("__pc"), F.col("__closed").alias("__ps"), "__v")
    where = parts.where(edge("__start", "__end", "__pc")).select("__u", "__pc", "__ps", "__closed")
    counts = seen.join(where, ["__u", "__pc", "__ps"]).groupBy("__u", "__closed").agg(F.countDistinct("__v").alias("__again"))
    whole = joined.join(counts, ["__u", "__closed"], "left")
    return _named(whole.withColumn("n_distinct", F.coalesce("__again", F.col("__m").cast("long"))), user, "n_distinct")


def _named(joined: DataFrame, user: str, *more: str) -> DataFrame:
    return joined.select(
        F.col("__u").alias(user),
        from_micros("__start").alias("start"),
        from_micros("__end").alias("end"),
        ((F.col("__end") - F.col("__start")) / SECOND).alias("seconds"),
        F.col("__n").alias("n_events"),
        F.col("__first").alias("first_id"),
        F.col("__last").alias("last_id"),
        *more,
    )
