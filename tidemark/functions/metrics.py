"""Scalar metrics as column expressions, and small compositions of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _positive(value: Column, what: str) -> Column:
    """The value, or an error where it is not positive."""
    return F.when(value > 0, value.cast("double")).otherwise(F.raise_error(F.lit(f"{what} must be positive")).cast("double"))


def innovation_score(stars: Column, forks: Column, employees: Column) -> Column:
    return (stars + forks) / _positive(employees, "employee count")


def digital_maturity(stars: Column, forks: Column, contributors: Column, revenue_rank: Column) -> Column:
    return (stars + forks + contributors) / _positive(revenue_rank, "revenue rank")


def percent_gap(a: Column, b: Column) -> Column:
    """(a - b) / b in percent; 0 where b is 0."""
    return F.coalesce(F.try_divide((a - b) * 100.0, b), F.lit(0.0))


def percentage_change(baseline: Column, value: Column) -> Column:
    """Percent change; from about zero it is 0 for no change, else signed infinity."""
    change = value - baseline
    jump = F.when(F.abs(change) < 1e-10, F.lit(0.0)).when(change > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(F.abs(baseline) < 1e-10, jump).otherwise(F.try_divide(change, baseline) * 100)


def capped(value: Column, most: float = 1.0) -> Column:
    """The value, at most ``most``; null stays null (``least`` would skip it)."""
    return F.when(value > most, F.lit(most)).otherwise(value)


def hype_score(view_velocity: Column, edit_growth: Column, content_expansion: Column) -> Column:
    """Weighted shares of three magnitudes, each capped; signs do not count."""
    part = lambda x, most: capped(F.abs(x) / most)
    return 0.5 * part(view_velocity, 1000) + 0.3 * part(edit_growth, 500) + 0.2 * part(content_expansion, 300)


def is_trending(score: Column, cut: float = 0.75) -> Column:
    return score >= cut


def spike_kind(days: Column) -> Column:
    return F.when(days > 7, "sustained").otherwise("sudden")


def reputation_risk(velocity: Column, vandalism: Column, anonymous: Column) -> Column:
    """Velocity in edits per hour, the other two in percent."""
    return 0.3 * capped(velocity / 100) + 0.4 * vandalism / 100 + 0.3 * anonymous / 100


def level(value: Column, high: float, medium: float) -> Column:
    return F.when(value >= high, "high").when(value >= medium, "medium").otherwise("low")


def is_edit_spike(velocity: Column, baseline: Column) -> Column:
    """Three times the baseline; without a baseline any activity."""
    return F.when(baseline <= 0, velocity > 0).otherwise(velocity >= 3 * baseline)


def engagement_quality(ratio: Column) -> Column:
    return level(ratio, 1.0, 0.5)


def effect_magnitude(effect: Column) -> Column:
    e = F.abs(effect)
    return F.when(e < 0.2, "negligible").when(e < 0.5, "small").when(e < 0.8, "medium").otherwise("large")


def significance_stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def concentration_level(hhi: Column) -> Column:
    return F.when(hhi < 1500, "low").when(hhi < 2500, "moderate").otherwise("high")


def throughput(rows: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, rows / F.nullif(seconds.cast("double"), F.lit(0.0))).otherwise(F.lit(0.0))


def evidence_strength(significant_share: Column, mean_effect: Column) -> Column:
    """Nothing to show counts as no evidence."""
    return F.coalesce(0.6 * significant_share + 0.4 * capped(mean_effect), F.lit(0.0))


def quarter_label(time: Column) -> Column:
    return F.concat(F.lit("Q"), F.quarter(time), F.lit(" "), F.year(time))


def hash_key(*parts: Column) -> Column:
    """md5 of the parts joined by colons, in order."""
    return F.md5(F.concat_ws(":", *(p.cast("string") for p in parts)))


def metric_key(name: Column, labels: Column) -> Column:
    """name|k=v|k=v with the labels of a map in order of their keys."""
    entries = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.concat_ws("|", name, F.array_join(entries, "|"))


def api_timestamp(text: Column) -> Column:
    """Hour, day or month stamps by their length; other lengths are null."""
    return (
        F.when(F.length(text) == 10, F.try_to_timestamp(text, F.lit("yyyyMMddHH")))
        .when(F.length(text) == 8, F.try_to_timestamp(text, F.lit("yyyyMMdd")))
        .when(F.length(text) == 6, F.try_to_timestamp(text, F.lit("yyyyMM")))
        .cast("timestamp_ntz")
    )


def api_date(time: Column, granularity: str = "daily") -> Column:
    return F.date_format(time, {"hourly": "yyyyMMddHH", "daily": "yyyyMMdd", "monthly": "yyyyMM"}[granularity])


#: The shape of an address, and the words of summaries that undo an edit.
ADDRESS = r"^((\d{1,3}\.){3}\d{1,3}|([0-9a-fA-F]{0,4}:){2,7}[0-9a-fA-F]{0,4})$"
UNDOING = ("revert", "undo", "undid", "rollback", "reverted", "rv ", "restore", "restored")


def is_address(editor: Column) -> Column:
    return editor.rlike(ADDRESS)


def classify_editor(editor: Column) -> Column:
    return F.when(is_address(editor), "anonymous").otherwise("registered")


def vandal_summary(summary: Column) -> Column:
    return F.coalesce(F.lower(summary).rlike("|".join(UNDOING)), F.lit(False))


def radar(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns scaled to 0..1; a constant column is 0."""
    bounds = df.agg(*(f(c).alias(f"__{n}{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))))
    scaled = {c: (F.col(c) - F.col(f"__lo{c}")) / (F.col(f"__hi{c}") - F.col(f"__lo{c}") + 1e-9) for c in columns}
    rest = [c for c in df.columns if c not in scaled]
    return df.crossJoin(F.broadcast(bounds)).select(*rest, *(v.alias(c) for c, v in scaled.items()))


def edit_metrics(edits: DataFrame, window_hours: int = 24) -> DataFrame:
    """Per article: edits, reverted, vandalism and anonymous (percent), velocity (edits over the window) and risk."""
    n = F.count(F.lit(1))
    reverted = F.count_if(F.coalesce("is_reverted", F.lit(False)))
    anonymous = F.count_if(F.coalesce(F.lower(F.trim("editor_type")) == "anonymous", F.lit(False)))
    rates = edits.groupBy("article").agg(
        n.alias("edits"), reverted.alias("reverted"), (reverted * 100.0 / n).alias("vandalism"), (anonymous * 100.0 / n).alias("anonymous"), (n / float(window_hours)).alias("velocity")
    )
    return rates.withColumn("risk", reputation_risk(F.col("velocity"), F.col("vandalism"), F.col("anonymous")))


def anchored_windows(edits: DataFrame, entity: str, time: str, hours: Sequence[int]) -> DataFrame:
    """Edits and reverts in trailing windows that end at the entity's newest row. Two aggregates: the newest row, then the counts."""
    newest = edits.groupBy(entity).agg(F.max(time).alias("__newest"))
    inside = lambda h: F.col(time) >= F.col("__newest") - F.make_dt_interval(F.lit(0), F.lit(h))
    reverted = F.coalesce("is_reverted", F.lit(False))
    counts = [c for h in hours for c in (F.count_if(inside(h)).alias(f"edits_{h}"), F.count_if(inside(h) & reverted).alias(f"reverted_{h}"))]
    return edits.join(newest, entity).groupBy(entity).agg(*counts)


def edit_velocity(edits: DataFrame, entity: str, time: str, window_hours: float) -> DataFrame:
    """Rows per hour of the span between first and last, which counts as at least a thousandth hour and at most the window."""
    span = (F.unix_micros(F.max(time).cast("timestamp")) - F.unix_micros(F.min(time).cast("timestamp"))) / 3.6e9
    return edits.groupBy(entity).agg((F.count(F.lit(1)) / F.least(F.greatest(span, F.lit(0.001)), F.lit(float(window_hours)))).alias("velocity"))
