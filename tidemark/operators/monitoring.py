"""Logs of metrics, runs and reports: ranges, health, regressions and combined reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F


def metric_log(**tables: DataFrame) -> DataFrame:
    """Several record tables as one log with a ``record_type``; columns that a table lacks are null."""
    parts = [t.withColumn("record_type", F.lit(name)) for name, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def in_range(log: DataFrame, first: str, last: str, time: str = "at", record_type: str | None = None, company: str | None = None) -> DataFrame:
    """Records from ``first`` to ``last``, both included, of a type or company where asked, in order of time."""
    rows = log.where(F.col(time).between(F.lit(first).cast("timestamp_ntz"), F.lit(last).cast("timestamp_ntz")))
    if record_type:
        rows = rows.where(F.col("record_type") == record_type)
    if company:
        rows = rows.where(F.col("company_id") == company)
    return rows.orderBy(time)


def trend_rows(log: DataFrame, time: str, metric: str, other: str = "value", years: Sequence[int] = ()) -> DataFrame:
    """time, value: the metric, else the other column, else 0; of the given years, in order of time."""
    rows = log.where(F.year(time).isin(*years)) if years else log
    return rows.select(time, F.coalesce(F.col(metric).cast("double"), F.col(other).cast("double"), F.lit(0.0)).alias("value")).orderBy(time)


def heatmap(cells: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """row, bins (sorted distinct columns), value (mean): the rows of a heatmap."""
    return cells.groupBy(row).agg(F.array_sort(F.collect_set(column)).alias("bins"), F.avg(value).alias("value"))


def attention_density(views: DataFrame, by: Sequence[str], value: str, days: int = 7) -> DataFrame:
    """All views over the length of the window, whatever the rows cover."""
    return views.groupBy(*by).agg((F.sum(value) / F.lit(float(days))).alias("density"))


def recent_health(runs: DataFrame, time: str, ok: str, most: int = 10) -> DataFrame:
    """One row over the last runs: n, n_ok, success_rate (0 without runs)."""
    last = runs.orderBy(F.desc(time)).limit(most)
    return last.agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_ok")).withColumn("success_rate", F.coalesce(F.try_divide("n_ok", "n"), F.lit(0.0)))


def worst(components: DataFrame | GroupedData, status: str, order: Sequence[str] = ("healthy", "degraded", "unhealthy")) -> DataFrame:
    """The worst status of the components, or of each group of them; an unknown one counts as the worst."""
    severity = F.coalesce(F.element_at(F.create_map(*(x for i, s in enumerate(order) for x in (F.lit(s), F.lit(i)))), F.col(status)), F.lit(len(order) - 1))
    return components.agg(F.element_at(F.array(*map(F.lit, order)), F.max(severity) + 1).alias("status"))


def slow_runs(runs: DataFrame, name: str, time: str, ms: str, factor: float = 1.5) -> DataFrame:
    """Runs that took more than ``factor`` times the first run of their name."""
    first = runs.groupBy(name).agg(F.min_by(ms, time).alias("baseline"))
    return runs.join(first, name).where(F.col(ms) > factor * F.col("baseline"))


def within_retention(records: DataFrame, time: str, now: Column, minutes: int = 60) -> DataFrame:
    return records.where(F.col(time) >= now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes)))


def combined_reports(reports: DataFrame) -> DataFrame:
    """One row of many validation reports (is_valid, score, missing, advice): all valid, mean score, the union of the lists."""
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    return reports.agg(F.bool_and("is_valid").alias("is_valid"), F.avg("score").alias("score"), union("missing").alias("missing"), union("advice").alias("advice"))


def evidence(findings: DataFrame) -> DataFrame:
    """One row over findings (confidence, p, effect, method): counts by confidence, tests and significant tests, strength, methods."""
    from ..functions.metrics import evidence_strength

    level = lambda x: F.count_if(F.col("confidence") == x).alias(f"n_{x}")
    share = F.avg(F.when(F.col("p") < 0.05, 1.0).otherwise(0.0))
    return findings.agg(
        *(level(x) for x in ("high", "medium", "low")), F.count("p").alias("n_tests"), F.count_if(F.col("p") < 0.05).alias("n_significant"),
        evidence_strength(share, F.avg(F.abs("effect"))).alias("strength"), F.array_sort(F.collect_set("method")).alias("methods"),
    )


def org_metrics(repositories: DataFrame, contributors: DataFrame) -> DataFrame:
    """org, stars, forks, contributors (distinct logins over all repositories); an organisation without contributors has 0."""
    sums = repositories.groupBy("org").agg(F.sum("stars").alias("stars"), F.sum("forks").alias("forks"))
    people = contributors.groupBy("org").agg(F.countDistinct("login").alias("contributors"))
    return sums.join(people, "org", "left").fillna(0, ["contributors"])


def deduplicated_alerts(alerts: DataFrame, key: Sequence[str], time: str, minutes: int = 60) -> DataFrame:
    """Alerts that come at least ``minutes`` after the one before of the same key (each repeat renews the wait)."""
    w = Window.partitionBy(*key).orderBy(time)
    gap = F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lag(time).over(w).cast("timestamp"))
    return alerts.withColumn("__gap", gap).where(F.col("__gap").isNull() | (F.col("__gap") >= minutes * 60_000_000)).drop("__gap")


def dated_names(text: Column, fields: Sequence[str] = ("name",)) -> Column:
    """Array of structs date and names from a comma list of date:name(:more); entries without a date are dropped."""
    def one(entry: Column) -> Column:
        parts = F.split(entry, ":")
        return F.struct(F.try_to_date(F.trim(parts[0]), "yyyy-MM-dd").alias("date") if hasattr(F, "try_to_date") else F.to_date(F.try_to_timestamp(F.trim(parts[0]), F.lit("yyyy-MM-dd"))).alias("date"), *(F.trim(F.get(parts, F.lit(i + 1))).alias(f) for i, f in enumerate(fields)))

    return F.filter(F.transform(F.split(text, ","), one), lambda s: s["date"].isNotNull())
