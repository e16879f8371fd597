"""Time-ordered analytics over long tables (series, day, value).

A series has one row per day, so its windows are bounded by the time covered, not by the
number of raw rows, which are aggregated to days first. Positions are counted by row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import stats


def _line(by: Sequence[str], day: str = "day"):  # noqa: ANN202
    return Window.partitionBy(*by).orderBy(day)


def positions(df: DataFrame, by: Sequence[str], day: str = "day") -> DataFrame:
    """Add pos (from 0) and n, the number of rows of the series."""
    return df.withColumn("pos", F.row_number().over(_line(by, day)) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*by)))


def resample(df: DataFrame, by: Sequence[str], day: str, value: str, unit: str = "week") -> DataFrame:
    """Sums by calendar unit; units between the first and last without rows are 0."""
    sums = df.where(F.col(day).isNotNull()).groupBy(*by, F.trunc(day, unit).alias("bucket")).agg(F.sum(value).alias("total"))
    step = {"week": F.expr("interval 7 day"), "month": F.expr("interval 1 month"), "quarter": F.expr("interval 3 month"), "year": F.expr("interval 1 year")}[unit]
    grid = sums.groupBy(*by).agg(F.explode(F.sequence(F.min("bucket"), F.max("bucket"), step)).alias("bucket"))
    return grid.join(sums, [*by, "bucket"], "left").fillna(0, ["total"])


def change_to_previous(df: DataFrame, by: Sequence[str], day: str, value: str) -> DataFrame:
    """Percent change to the row before; rows without one or after a zero are left out."""
    before = F.lag(value).over(_line(by, day))
    return df.withColumn("__b", before).where((F.col("__b") != 0)).withColumn("change", (F.col(value) - F.col("__b")) / F.col("__b") * 100).drop("__b")


def inflections(df: DataFrame, by: Sequence[str], day: str, value: str, plateaus: bool = False) -> DataFrame:
    """Rows where growth turns. Strict: the changes before and after have opposite signs; with plateaus a flat step counts as not growing."""
    w = _line(by, day)
    b, a = F.col(value) - F.lag(value).over(w), F.lead(value).over(w) - F.col(value)
    turn = ((b > 0) != (a > 0)) if plateaus else (b * a < 0)
    return df.withColumn("__t", turn).where("__t").drop("__t")


def islands(df: DataFrame, by: Sequence[str], day: str, flag: str, pos: str = "pos") -> DataFrame:
    """Rows with the flag, with ``island``, a number that is the same for rows in succession."""
    hit = df.where(flag)
    return hit.withColumn("island", F.col(pos) - F.row_number().over(_line(by, day)))


def rolling_spikes(df: DataFrame, by: Sequence[str], day: str, value: str, window: int = 7, deviations: float = 2.0) -> DataFrame:
    """Runs of rows over their own trailing mean plus ``deviations`` sample deviations (both include the row): first, last, days, peak, magnitude, kind.

    The frame is at most one row shorter than the series; the magnitude is the mean excess
    of the run over its mean frame mean, in mean frame deviations.
    """
    frames = positions(df, by, day).where("n >= 3")
    sized = frames.withColumn("__w", F.least(F.lit(window), F.col("n") - 1))
    cases_mean, cases_sd = F.lit(None).cast("double"), F.lit(None).cast("double")
    for w in range(2, window + 1):
        frame = _line(by, day).rowsBetween(-(w - 1), 0)
        cases_mean = F.when(F.col("__w") == w, F.avg(value).over(frame)).otherwise(cases_mean)
        cases_sd = F.when(F.col("__w") == w, F.coalesce(F.stddev_samp(value).over(frame), F.lit(0.0))).otherwise(cases_sd)
    marked = sized.withColumns({"__m": cases_mean, "__s": cases_sd})
    marked = marked.withColumn("__hit", (F.col("__s") > 0) & (F.col(value) > F.col("__m") + deviations * F.col("__s")))
    runs = islands(marked, by, day, "__hit").groupBy(*by, "island").agg(
        F.min(day).alias("first"), F.max(day).alias("last"), F.count(F.lit(1)).alias("days"), F.max(value).alias("peak"),
        F.try_divide(F.avg(value) - F.avg("__m"), F.avg("__s")).alias("magnitude"),
    )
    return runs.withColumn("kind", F.when(F.col("days") > 7, "sustained").otherwise("sudden")).drop("island")


def global_events(df: DataFrame, by: Sequence[str], day: str, value: str, deviations: float = 2.0, least: int = 7) -> DataFrame:
    """Runs over the series' mean plus ``deviations`` population deviations: first, last, days, magnitude. Short or constant series have none."""
    whole = Window.partitionBy(*by)
    marked = positions(df, by, day).withColumns({"__m": F.avg(value).over(whole), "__s": F.stddev_pop(value).over(whole)})
    marked = marked.withColumn("__hit", (F.col("n") >= least) & (F.col("__s") > 0) & (F.col(value) > F.col("__m") + deviations * F.col("__s")))
    return islands(marked, by, day, "__hit").groupBy(*by, "island").agg(
        F.min(day).alias("first"), F.max(day).alias("last"), F.count(F.lit(1)).alias("days"), F.max((F.lit(0.0) + F.col("__s"))).alias("__s"), ((F.avg(value) - F.max("__m")) / F.max("__s")).alias("magnitude")
    ).drop("island", "__s")


def growth_over(df: DataFrame, by: Sequence[str], day: str, value: str, rows: int = 30) -> DataFrame:
    """Percent growth of the last value over the one ``rows`` before the end (the first in a shorter series); from 0 it is 100 or 0."""
    placed = positions(df, by, day)
    start = F.max(F.when(F.col("pos") == F.greatest(F.col("n") - rows, F.lit(0)), F.col(value)))
    end = F.max(F.when(F.col("pos") == F.col("n") - 1, F.col(value)))
    out = placed.groupBy(*by).agg(start.alias("start_value"), end.alias("end_value"))
    growth = F.when(F.col("start_value") == 0, F.when(F.col("end_value") > 0, 100.0).otherwise(0.0)).otherwise((F.col("end_value") - F.col("start_value")) / F.nullif(F.col("start_value").cast("double"), F.lit(0.0)) * 100)
    return out.withColumn("growth", growth)


def topic_growth(df: DataFrame, by: Sequence[str], day: str, value: str) -> DataFrame:
    """Growth from first to last day, yearly growth where at least a year is covered, and whether growth accelerates (mean second difference over 0)."""
    c = F.col
    daily = df.groupBy(*by, day).agg(F.sum(value).alias("__v"))
    w = _line(by, day)
    steps = daily.withColumn("__d", c("__v") - F.lag("__v").over(w)).withColumn("__dd", c("__d") - F.lag("__d").over(w))
    out = steps.groupBy(*by).agg(
        F.min_by("__v", day).alias("first_value"), F.max_by("__v", day).alias("last_value"), (F.datediff(F.max(day), F.min(day)) / 365.25).alias("years"), F.count(F.lit(1)).alias("days"), F.coalesce(F.avg("__dd") > 0, F.lit(False)).alias("is_emerging")
    )
    ok = (c("first_value") > 0) & (c("days") >= 2)
    ratio = F.try_divide(c("last_value") * 1.0, c("first_value"))
    return out.withColumn("growth", F.when(ok, (ratio - 1) * 100).otherwise(0.0)).withColumn(
        "cagr", F.when(ok & (c("years") >= 1) & (ratio > 0), (F.pow(ratio, 1 / F.nullif(c("years"), F.lit(0.0))) - 1) * 100).otherwise(0.0)
    )


def baseline_growth(df: DataFrame, by: Sequence[str], day: str, value: str, baseline_days: int = 7) -> DataFrame:
    """Growth weighted by views against the views of the first days: views, growth, baseline, relative, days."""
    c = F.col
    first = df.groupBy(*by).agg(F.min(day).alias("__first"))
    base = df.join(first, list(by)).groupBy(*by).agg(F.greatest(F.lit(1), F.sum(F.when(F.datediff(day, "__first") <= baseline_days, c(value)).otherwise(0))).alias("baseline"), F.sum(value).alias("views"), (F.datediff(F.max(day), F.min(day)) + 1).alias("period"))
    return topic_growth(df, by, day, value).join(base, list(by)).withColumn("relative", c("growth") * c("views") / c("baseline")).select(*by, "growth", "views", "baseline", "relative", "period")


def trailing_means(df: DataFrame, by: Sequence[str], day: str, value: str, rows: Sequence[int] = (7, 30)) -> DataFrame:
    """Means over the last rows, however few there are."""
    return df.withColumns({f"mean_{n}": F.avg(value).over(_line(by, day).rowsBetween(-(n - 1), 0)) for n in rows})


def monthly_change(df: DataFrame, by: Sequence[str], day: str, value: str) -> DataFrame:
    """Mean of the daily values by month and its percent change to the month before."""
    months = df.groupBy(*by, F.trunc(day, "month").alias("month")).agg(F.avg(value).alias("mean"))
    before = F.lag("mean").over(_line(by, "month"))
    return months.withColumn("change", F.try_divide((F.col("mean") - before) * 100, before))


def window_shifts(df: DataFrame, by: Sequence[str], day: str, value: str, window: int = 30, least: int = 10) -> DataFrame:
    """At each row with a full frame on either side, Student's t between the ``window`` rows before and from it on: statistic, df, p, effect."""
    placed = positions(df, by, day).where(F.col("n") >= 2 * window)
    v = F.col(value)
    frames = {}
    for label, frame in (("a", _line(by, day).rowsBetween(-window, -1)), ("b", _line(by, day).rowsBetween(0, window - 1))):
        frames |= {f"n_{label}": F.count(v).over(frame), f"mean_{label}": F.avg(v).over(frame), f"var_{label}": F.var_samp(v).over(frame)}
    inside = (F.col("pos") >= window) & (F.col("pos") < F.col("n") - window) & (F.col("n_a") >= least) & (F.col("n_b") >= least)
    return stats.t_test(placed.withColumns(frames).where(inside)).select(*by, day, "mean_a", "mean_b", "statistic", "effect", "p")


def weekday_profile(df: DataFrame, by: Sequence[str], day: str, value: str) -> DataFrame:
    """By weekday (Monday 0): n, mean, sd, and effect, the distance from the overall mean in overall deviations."""
    c = F.col
    whole = df.groupBy(*by).agg(F.avg(value).alias("__m"), F.stddev_samp(value).alias("__s"))
    days = df.groupBy(*by, F.weekday(day).alias("weekday")).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return days.join(whole, list(by)).withColumn("effect", F.coalesce(F.try_divide(c("mean") - c("__m"), c("__s")), F.lit(0.0))).drop("__m", "__s")


def weekday_test(df: DataFrame, by: Sequence[str], day: str, value: str) -> DataFrame:
    """Analysis of variance over the weekdays."""
    return stats.anova(stats.moments(df.withColumn("__w", F.weekday(day)), [*by, "__w"], value), by)


def weekend_test(df: DataFrame, by: Sequence[str], day: str, value: str) -> DataFrame:
    """Student's t between weekdays (a) and weekends (b)."""
    part = F.when(F.weekday(day) >= 5, "weekend").otherwise("weekday")
    return stats.t_test(stats.two_samples(df.withColumn("__p", part), "__p", "weekday", "weekend", value, by))


def holiday_effect(df: DataFrame, by: Sequence[str], day: str, value: str, holidays: Sequence[str]) -> DataFrame:
    """Holidays (a) against other days (b): the test's columns and percent; a side without rows gives p 1 and no effect."""
    part = F.when(F.date_format(day, "yyyy-MM-dd").isin(*holidays), "holiday").otherwise("other")
    out = stats.t_test(stats.two_samples(df.withColumn("__p", part), "__p", "holiday", "other", value, by))
    return out.withColumns({"p": F.coalesce("p", F.lit(1.0)), "percent": F.coalesce(F.try_divide(F.col("difference") * 100, F.col("mean_b")), F.lit(0.0))})


def utility_or_leisure(df: DataFrame, by: Sequence[str], day: str, ratio: str) -> DataFrame:
    """Whether engagement is higher on weekdays (utility) or weekends (leisure): the relative difference against 10 %."""
    out = weekend_test(df.where(F.col(ratio).isNotNull()), by, day, ratio)
    relative = F.try_divide(F.col("mean_a") - F.col("mean_b"), F.col("mean_b"))
    return out.withColumn("relative", relative).withColumn("kind", F.when(relative > 0.1, "utility").when(relative < -0.1, "leisure").otherwise("mixed"))


def recent_mean(df: DataFrame, by: Sequence[str], day: str, value: str, rows: int = 30, first: bool = False) -> DataFrame:
    """Mean of the last (or first) rows of each series."""
    order = F.asc(day) if first else F.desc(day)
    k = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return df.withColumn("__k", k).where(F.col("__k") <= rows).groupBy(*by).agg(F.avg(value).alias("mean"))


def platform_mix(df: DataFrame, platform: str, day: str, value: str, rows: int = 30) -> DataFrame:
    """Share of each platform in the means of the last rows."""
    m = recent_mean(df, [platform], day, value, rows)
    whole = m.agg(F.sum("mean").alias("__all"))
    return m.crossJoin(F.broadcast(whole)).select(platform, "mean", F.try_divide(F.col("mean"), F.col("__all")).alias("share"))


def concentration(mix: DataFrame, share: str = "share") -> DataFrame:
    """The Herfindahl index of percent shares and its level."""
    from ..functions.metrics import concentration_level

    hhi = F.sum(F.pow(F.col(share) * 100, F.lit(2.0)))
    return mix.agg(hhi.alias("hhi")).withColumn("level", concentration_level(F.col("hhi")))


def platform_growth(df: DataFrame, platform: str, day: str, value: str, rows: int = 30) -> DataFrame:
    """Yearly growth from the mean of the first rows to that of the last; 0 for under a tenth of a year or from nothing."""
    span = df.groupBy(platform).agg((F.datediff(F.max(day), F.min(day)) / 365.25).alias("years"))
    a, b = recent_mean(df, [platform], day, value, rows, True).withColumnRenamed("mean", "start"), recent_mean(df, [platform], day, value, rows).withColumnRenamed("mean", "end")
    ok = (F.col("years") >= 0.1) & (F.col("start") > 0)
    cagr = F.when(ok, F.pow(F.col("end") / F.nullif("start", F.lit(0.0)), 1 / F.nullif("years", F.lit(0.0))) - 1).otherwise(0.0)
    return a.join(b, platform).join(span, platform).withColumn("cagr", cagr)


def volatility(df: DataFrame, platform: str, value: str) -> DataFrame:
    """Coefficient of variation of each platform."""
    return df.groupBy(platform).agg(F.try_divide(F.stddev_samp(value), F.avg(value)).alias("cv"))


def volatility_test(df: DataFrame, platform: str, value: str) -> DataFrame:
    """Whether platforms vary alike: analysis of variance of absolute deviations from their means."""
    means = df.groupBy(platform).agg(F.avg(value).alias("__m"))
    deviations = df.join(means, platform).withColumn("__d", F.abs(F.col(value) - F.col("__m")))
    return stats.anova(stats.moments(deviations, [platform], "__d"))


def decline_scenarios(mix: DataFrame, declines: Sequence[float] = (0.1, 0.2, 0.3), share: str = "share") -> DataFrame:
    """For each decline, what the dominant platform would keep and lose."""
    top = mix.orderBy(F.desc(share), mix.columns[0]).limit(1)
    d = F.explode(F.array(*(F.lit(x) for x in declines))).alias("decline")
    return top.select(*mix.columns, d).withColumns({"new_share": F.col(share) * (1 - F.col("decline")), "loss": F.col(share) * F.col("decline")})


def moving_average(df: DataFrame, by: Sequence[str], day: str, value: str, half: int) -> DataFrame:
    """Centred mean over ``2 half + 1`` rows, shorter at the ends."""
    return df.withColumn("trend", F.avg(value).over(_line(by, day).rowsBetween(-half, half)))


def classical_decomposition(df: DataFrame, by: Sequence[str], day: str, value: str, period: int = 7) -> DataFrame:
    """Additive decomposition: centred mean over a period (odd), mean detrended value by position, centred to zero, and the rest. Ends without a full frame have no trend."""
    if period % 2 == 0:
        raise ValueError("the period must be odd")
    half = period // 2
    frame = _line(by, day).rowsBetween(-half, half)
    v = F.col(value)
    placed = positions(df, by, day).where(F.col("n") >= 2 * period)
    trended = placed.withColumn("trend", F.when(F.count(v).over(frame) == period, F.avg(v).over(frame))).withColumn("__p", F.col("pos") % period)
    phase = Window.partitionBy(*by, "__p")
    seasonal = trended.withColumn("__d", v - F.col("trend")).withColumn("__s", F.avg("__d").over(phase))
    level = seasonal.groupBy(*by, "__p").agg(F.first("__s").alias("__x")).groupBy(*by).agg(F.avg("__x").alias("__level"))
    out = seasonal.join(level, list(by)).withColumn("seasonal", F.col("__s") - F.col("__level"))
    return out.withColumn("residual", v - F.col("trend") - F.col("seasonal")).select(*by, day, value, "trend", "seasonal", "residual")


def seasonal_strength(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """1 - var(residual) / var(seasonal + residual), held in 0..1."""
    ratio = F.try_divide(F.var_samp("residual"), F.var_samp(F.col("seasonal") + F.col("residual")))
    return parts.where("residual is not null").groupBy(*by).agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(1 - ratio, F.lit(0.0)))).alias("strength"))


def before_after(df: DataFrame, by: Sequence[str], day: str, value: str, event: str, gap: int = 1) -> DataFrame:
    """Means before and after an event, with ``gap`` days left out from it on, and the lift in percent."""
    d = F.datediff(day, F.lit(event).cast("date"))
    out = df.groupBy(*by).agg(F.avg(F.when(d < 0, F.col(value))).alias("before"), F.avg(F.when(d >= gap, F.col(value))).alias("after"))
    return out.withColumn("lift", F.try_divide((F.col("after") - F.col("before")) * 100, F.col("before")))


def forecast_accuracy(df: DataFrame, by: Sequence[str], actual: str, predicted: str, naive: Column | None = None) -> DataFrame:
    """mape (zero actuals left out), rmse, mae and, given the naive error of the training rows, mase."""
    e = F.col(actual) - F.col(predicted)
    out = df.groupBy(*by).agg(
        (F.avg(F.abs(F.try_divide(e, F.col(actual)))) * 100).alias("mape"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), *([F.first(naive).alias("__naive")] if naive is not None else [])
    )
    if naive is None:
        return out
    return out.withColumn("mase", F.try_divide(F.col("mae"), F.col("__naive"))).drop("__naive")


def accuracy_band(mape: Column) -> Column:
    return F.when(mape < 10, "excellent").when(mape < 20, "good").when(mape < 50, "reasonable").otherwise("poor")
