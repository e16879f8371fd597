"""Effects of an intervention on daily series: closed forms over aggregates and windows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special as s
from . import models, stats


def _split(df: DataFrame, by: Sequence[str], day: str, event: str, pre: int, post: int) -> DataFrame:
    """Add is_post and x: the last ``pre`` rows before the event count 0..pre-1, the first ``post`` from it on follow."""
    is_post = F.col(day) >= F.lit(event).cast("date")
    marked = df.withColumn("is_post", is_post)
    back = F.row_number().over(Window.partitionBy(*by, "is_post").orderBy(F.desc(day)))
    ahead = F.row_number().over(Window.partitionBy(*by, "is_post").orderBy(day))
    numbered = marked.withColumn("__k", F.when(F.col("is_post"), ahead).otherwise(back))
    kept = numbered.where(F.when(F.col("is_post"), F.col("__k") <= post).otherwise(F.col("__k") <= pre))
    n_pre = F.count(F.when(~F.col("is_post"), 1)).over(Window.partitionBy(*by))
    return kept.withColumn("n_pre", n_pre).withColumn("x", F.when(F.col("is_post"), F.col("n_pre") + F.col("__k") - 1).otherwise(F.col("n_pre") - F.col("__k"))).drop("__k")


def interrupted_series(df: DataFrame, by: Sequence[str], day: str, value: str, event: str, pre: int = 90, post: int = 90, least: int = 60) -> DataFrame:
    """Rows of the period after the event with the line fitted before it: x, observed, counterfactual, gap. Series with fewer than ``least`` rows before are left out."""
    rows = _split(df, by, day, event, pre, post).where(F.col("n_pre") >= least)
    fit = stats.slope(rows.where("not is_post"), by, "x", value).select(*by, "slope", "intercept")
    line = F.col("intercept") + F.col("slope") * F.col("x")
    return rows.where("is_post").join(fit, list(by)).select(*by, day, "x", F.col(value).alias("observed"), line.alias("counterfactual"), (F.col(value) - line).alias("gap"))


def gap_test(gaps: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean gap, its percent of the mean counterfactual, one-sample t and p, and the normal interval."""
    c = F.col
    out = gaps.groupBy(*by).agg(F.count("gap").alias("n"), F.avg("gap").alias("effect"), F.stddev_samp("gap").alias("sd"), F.avg("counterfactual").alias("__cf"))
    se = c("sd") / F.sqrt(c("n").cast("double"))
    out = out.withColumns({"percent": F.coalesce(F.try_divide(c("effect") * 100, c("__cf")), F.lit(0.0)), "t": F.try_divide(c("effect"), se), "lo": c("effect") - 1.96 * se, "hi": c("effect") + 1.96 * se})
    return out.withColumn("p", s.t_p_value("t", F.nullif(c("n") - 1, F.lit(0)).cast("double"))).drop("__cf")


def duration_effects(gaps: DataFrame, by: Sequence[str], day: str, event: str, windows: Sequence[tuple[str, int, int]] = (("immediate", 0, 7), ("short", 8, 30), ("long", 31, 90))) -> DataFrame:
    """``gap_test`` within windows of days after the event."""
    d = F.datediff(day, F.lit(event).cast("date"))
    label = None
    for name, lo, hi in windows:
        hit = d.between(lo, hi)
        label = F.when(hit, name) if label is None else label.when(hit, name)
    return gap_test(gaps.withColumn("window", label).where("window is not null"), [*by, "window"])


def pre_trend_halves(df: DataFrame, by: Sequence[str], day: str, value: str, event: str, pre: int = 90) -> DataFrame:
    """Whether the slopes of the two halves before the event agree: difference, t with n - 4 degrees, p."""
    rows = _split(df, by, day, event, pre, 0).where("not is_post").withColumn("__h", F.when(F.col("x") < F.floor(F.col("n_pre") / 2), "a").otherwise("b"))
    return _slope_difference(stats.slope(rows, [*by, "__h"], "x", value), by, "__h", "a", "b")


def _slope_difference(slopes: DataFrame, by: Sequence[str], group: str, a: str, b: str) -> DataFrame:
    pick = lambda g, x: F.max(F.when(F.col(group) == g, F.col(x)))
    wide = slopes.groupBy(*by).agg(*(pick(g, x).alias(f"{x}_{n}") for g, n in ((a, "a"), (b, "b")) for x in ("n", "slope", "sse", "sxx")))
    c = F.col
    df = c("n_a") + c("n_b") - 4
    pooled = F.try_divide(c("sse_a") + c("sse_b"), df)
    se = F.sqrt(pooled * (F.try_divide(F.lit(1.0), c("sxx_a")) + F.try_divide(F.lit(1.0), c("sxx_b"))))
    out = wide.withColumns({"difference": c("slope_b") - c("slope_a"), "df": df}).withColumn("t", F.try_divide(c("difference"), se))
    return out.withColumn("p", s.t_p_value("t", c("df").cast("double"))).select(*by, "slope_a", "slope_b", "difference", "t", "p")


def difference_in_differences(df: DataFrame, group: str, treated: str, control: str, day: str, value: str, event: str, by: Sequence[str] = ()) -> DataFrame:
    """Four cell means, the effect, its standard error from the cells' squared errors, t and p."""
    c = F.col
    post = c(day) >= F.lit(event).cast("date")
    cells = {"tb": (c(group) == treated) & ~post, "ta": (c(group) == treated) & post, "cb": (c(group) == control) & ~post, "ca": (c(group) == control) & post}
    v = c(value).cast("double")
    aggs = [f(F.when(w, v)).alias(f"{p}_{k}") for k, w in cells.items() for p, f in (("n", F.count), ("m", F.avg), ("v", F.var_pop))]
    wide = df.where(c(group).isin(treated, control)).groupBy(*by).agg(*aggs) if by else df.where(c(group).isin(treated, control)).agg(*aggs)
    sse = sum((c(f"n_{k}") * c(f"v_{k}") for k in cells), F.lit(0.0))
    n = sum((c(f"n_{k}") for k in cells), F.lit(0))
    effect = (c("m_ta") - c("m_tb")) - (c("m_ca") - c("m_cb"))
    inverse = sum((F.try_divide(F.lit(1.0), c(f"n_{k}")) for k in cells), F.lit(0.0))
    out = wide.withColumns({"effect": effect, "se": F.sqrt(F.try_divide(sse, n - 4) * inverse), "df": n - 4})
    return out.withColumn("t", F.try_divide(c("effect"), c("se"))).withColumn("p", s.t_p_value("t", c("df").cast("double"))).select(*by, "m_tb", "m_ta", "m_cb", "m_ca", "effect", "se", "t", "p")


def parallel_trends(df: DataFrame, group: str, treated: str, control: str, day: str, value: str, event: str) -> DataFrame:
    """Whether both groups' slopes agree before the event."""
    before = df.where((F.col(day) < F.lit(event).cast("date")) & F.col(group).isin(treated, control)).withColumn("__x", F.datediff(day, F.lit(event).cast("date")))
    return _slope_difference(stats.slope(before, [group], "__x", value), [], group, treated, control)


def placebo_difference(df: DataFrame, group: str, treated: str, control: str, day: str, value: str, event: str, placebo: str) -> DataFrame:
    """The difference in differences at a made-up date, on rows before the event."""
    return difference_in_differences(df.where(F.col(day) < F.lit(event).cast("date")), group, treated, control, day, value, placebo)


def baseline_gaps(
    df: DataFrame, by: Sequence[str], day: str, value: str, event: str, pre: int = 90, post: int = 30, least: int = 60, method: str = "arima", order: tuple[int, int, int] | None = None, level: float = 0.95
) -> DataFrame:
    """Rows after the event against the forecast of a model of the rows before: by, day, x, observed, counterfactual, gap, lo, hi.

    ``method`` is ``arima`` (of an ``order``, or one found by AIC) or ``fourier_trend``. The interval grows with the root of the
    step. Series with fewer than ``least`` rows before are left out. A task holds one series' ``pre`` + ``post`` rows.
    """
    rows = _split(df, by, day, event, pre, post).where(F.col("n_pre") >= least).select(*by, F.col(day).alias("__day"), F.col("x").cast("long").alias("x"), "is_post", F.col(value).cast("double").alias("__v"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by, day).schema)
    fit = {"arima": lambda v, h: models.arima(v, h, order), "fourier_trend": models.fourier_trend}[method]
    z = s.normal_quantile((1 + level) / 2)

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x")
        before, after = pdf[~pdf["is_post"]], pdf[pdf["is_post"]]
        train = before["__v"].to_numpy()
        made, fitted = fit(train, len(after))
        reach = z * np.nanstd(models.filled(train) - fitted) * np.sqrt(np.arange(1, len(after) + 1))
        seen = after["__v"].to_numpy()
        out = dict(zip(by, key, strict=True)) | {day: after["__day"], "x": after["x"], "observed": seen, "counterfactual": made, "gap": seen - made, "lo": made - reach, "hi": made + reach}
        return pd.DataFrame(out)

    return rows.groupBy(*by).applyInPandas(one, f"{kinds}, x bigint, observed double, counterfactual double, gap double, lo double, hi double")


def evaluate_campaign(
    df: DataFrame, by: Sequence[str], day: str, value: str, start: str, pre: int = 90, post: int = 90, draws: int = 10_000, treated: str | None = None
) -> DataFrame:
    """One row per series: n, effect, percent, t, p, lo, hi of the gap to the line before; ``windows``, the mean gap at once, in the short and in the long run; permutation_p.

    With ``treated``, a value of the first column of ``by``, that series also gets ``synthetic_effect``, against a weighted
    mix of the other series; null where the mix fits badly.
    """
    gaps = interrupted_series(df, by, day, value, start, pre, post)
    windows = duration_effects(gaps, by, day, start).groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("window", "effect")))).alias("windows"))
    around = _split(df, by, day, start, pre, post).withColumn("__part", F.when(F.col("is_post"), "after").otherwise("before"))
    shuffled = stats.permutation_test(around, by, "__part", "after", "before", value, draws).select(*by, F.col("p").alias("permutation_p"))
    out = gap_test(gaps, by).join(windows, list(by), "left").join(shuffled, list(by), "left")
    if treated is None:
        return out
    mixed = synthetic_control(df, by[0], treated, day, value, start, placebos=False).where("is_treated").select(by[0], F.col("effect").alias("synthetic_effect"))
    return out.join(mixed, by[0], "left")


def abnormal_sum(gaps: DataFrame, by: Sequence[str]) -> DataFrame:
    """Event study over rows with observed and expected: cumulated gap, its z (over sqrt n population deviations), p, and the share outside lo..hi where given."""
    c = F.col
    outside = [F.avg(F.when((c("observed") < c("lo")) | (c("observed") > c("hi")), 1.0).otherwise(0.0)).alias("outside")] if "lo" in gaps.columns else []
    out = gaps.groupBy(*by).agg(F.count("gap").alias("n"), F.sum("gap").alias("car"), F.stddev_pop("gap").alias("sd"), *outside)
    return out.withColumn("z", F.try_divide(c("car"), c("sd") * F.sqrt(c("n").cast("double")))).withColumn("p", s.normal_p_value("z"))


def peak_gap(gaps: DataFrame, by: Sequence[str], day: str, event: str) -> DataFrame:
    """The largest deviation, its day, days to it and its percent of what was expected (ties: the first day)."""
    c = F.col
    best = F.min_by(F.struct("gap", "counterfactual", day), F.struct(-F.abs("gap"), c(day)))
    return gaps.groupBy(*by).agg(best.alias("__b")).select(
        *by, c(f"__b.{day}").alias("peak_day"), c("__b.gap").alias("peak"), F.datediff(c(f"__b.{day}"), F.lit(event).cast("date")).alias("days_to_peak"), F.try_divide(c("__b.gap") * 100, c("__b.counterfactual")).alias("percent")
    )


def persistence(df: DataFrame, by: Sequence[str], day: str, value: str, event: str, baseline: int = 90, least: int = 30, most: int = 180, threshold: float = 0.1) -> DataFrame:
    """Days until the trailing mean after the event is within ``threshold`` of the mean before; ``most`` if it never is."""
    c = F.col
    rows = _split(df, by, day, event, baseline, most).where(c("n_pre") >= least)
    base = rows.where("not is_post").groupBy(*by).agg(F.avg(value).alias("__base"))
    after = rows.where("is_post").withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    line = Window.partitionBy(*by).orderBy(day)
    mean = F.lit(None).cast("double")
    for w in range(1, 8):
        mean = F.when(F.least(F.lit(7), F.greatest(F.lit(1), F.floor(c("__n") / 4))) == w, F.avg(value).over(line.rowsBetween(-(w - 1), 0))).otherwise(mean)
    near = after.withColumn("__m", mean).withColumn("__k", F.row_number().over(line)).join(base, list(by))
    back = F.when(F.abs(c("__m") - c("__base")) <= threshold * F.abs("__base"), c("__k") - 1)
    return near.groupBy(*by).agg(F.coalesce(F.min(back), F.lit(most)).alias("days"))


def campaign_table(results: DataFrame, name: str, effect: str, se: str) -> DataFrame:
    """Fixed-effect pooling of effects: pooled, pooled_se, q, p, i_squared. The weights are inverse variances, and Q uses them as they are."""
    c = F.col
    w = 1 / F.pow(c(se), F.lit(2.0))
    sums = results.where(c(se) > 0).agg(F.count(F.lit(1)).alias("k"), F.sum(w).alias("w"), F.sum(w * c(effect)).alias("we"), F.sum(w * c(effect) * c(effect)).alias("wee"))
    out = sums.withColumns({"pooled": F.try_divide(c("we"), c("w")), "pooled_se": F.sqrt(F.try_divide(F.lit(1.0), c("w"))), "q": F.greatest(F.lit(0.0), c("wee") - F.try_divide(c("we") * c("we"), c("w")))})
    i2 = F.greatest(F.lit(0.0), F.coalesce(F.try_divide(c("q") - (c("k") - 1), c("q")), F.lit(0.0)))
    return out.withColumns({"i_squared": i2, "p": s.chi2_p_value("q", F.nullif(c("k") - 1, F.lit(0)).cast("double"))}).select("k", "pooled", "pooled_se", "q", "p", "i_squared")


def campaign_pairs(results: DataFrame, name: str, effect: str, se: str) -> DataFrame:
    """z tests between every two campaigns (a few rows)."""
    a = results.select(F.col(name).alias("a"), F.col(effect).alias("__x"), F.col(se).alias("__s"))
    b = results.select(F.col(name).alias("b"), F.col(effect).alias("__y"), F.col(se).alias("__t"))
    z = F.try_divide(F.col("__x") - F.col("__y"), F.sqrt(F.col("__s") * F.col("__s") + F.col("__t") * F.col("__t")))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", (F.col("__x") - F.col("__y")).alias("difference"), z.alias("z")).withColumn("p", s.normal_p_value("z"))


def simplex_projection(v: np.ndarray) -> np.ndarray:
    """The nearest point whose parts are not negative and add up to one."""
    u = np.sort(v)[::-1]
    cut = (np.cumsum(u) - 1) / np.arange(1, len(u) + 1)
    return np.maximum(v - cut[np.nonzero(u > cut)[0][-1]], 0)


def simplex_weights(donors: np.ndarray, target: np.ndarray, steps: int = 5000) -> np.ndarray:
    """Weights (not negative, sum one) of the columns that come nearest to the target, by accelerated projected gradient."""
    scale = max(1e-12, float(np.abs(target).mean()))
    a, y = donors / scale, target / scale
    gram, rhs = a.T @ a, a.T @ y
    rate = 1 / max(np.linalg.eigvalsh(gram)[-1], 1e-12)
    w = z = np.full(a.shape[1], 1 / a.shape[1])
    t = 1.0
    for _ in range(steps):
        new = simplex_projection(z - rate * (gram @ z - rhs))
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, moved = new + (t - 1) / nt * (new - w), np.abs(new - w).max()
        w, t = new, nt
        if moved < 1e-12:
            break
    return w


#: Units of one pool of donors.
MOST_UNITS = 1_000


def synthetic_control(df: DataFrame, unit: str, treated: str, day: str, value: str, event: str, least: int = 30, least_fit: float = 0.7, placebos: bool = True) -> DataFrame:
    """Each unit against a weighted mix of the others: unit, is_treated, weights, fit (R² before the event), effect (mean gap after), n and, on the treated row, p by the share of placebos with as large an effect.

    Each unit is a task of its own over the matrix of days by units, so the work grows with the square of the
    units: more than ``MOST_UNITS`` raise. Units with a poor fit are left out of p;
    a treated unit with a poor fit has no effect.
    """
    if df.select(unit).distinct().limit(MOST_UNITS + 1).count() > MOST_UNITS:
        raise ValueError(f"more than {MOST_UNITS} units; a synthetic control mixes a chosen pool of donors")
    units = df.where(F.col(value).isNotNull()).groupBy(day).agg(F.map_from_entries(F.collect_list(F.struct(F.col(unit), F.col(value).cast("double")))).alias("__m"))
    listed = df.select(F.col(unit).alias("__t")).distinct()
    if not placebos:
        listed = listed.where(F.col("__t") == treated)
    spread = listed.crossJoin(units.withColumn("__post", F.col(day) >= F.lit(event).cast("date")))

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pd.DataFrame([dict(m) for m in pdf.sort_values(day)["__m"]]).to_numpy(float)
        names = list(pd.DataFrame([dict(m) for m in pdf.sort_values(day)["__m"]]).columns)
        post = pdf.sort_values(day)["__post"].to_numpy(bool)
        at = names.index(key[0])
        donors = [i for i, n in enumerate(names) if i != at and (key[0] == treated or n != treated)]
        ok = ~np.isnan(wide[:, [at, *donors]]).any(axis=1)
        pre, aft = ok & ~post, ok & post
        if len(donors) < 2 or pre.sum() < least or not aft.any():
            return pd.DataFrame([[key[0], None, None, None, int(aft.sum())]], columns=["u", "w", "f", "e", "n"])
        w = simplex_weights(wide[pre][:, donors], wide[pre, at])
        y, hat = wide[pre, at], wide[pre][:, donors] @ w
        fit = 1 - ((y - hat) ** 2).sum() / max(((y - y.mean()) ** 2).sum(), 1e-12)
        gap = wide[aft, at] - wide[aft][:, donors] @ w
        return pd.DataFrame([[key[0], {names[d]: float(x) for d, x in zip(donors, w, strict=True)}, float(fit), float(gap.mean()), int(aft.sum())]], columns=["u", "w", "f", "e", "n"])

    made = spread.groupBy("__t").applyInPandas(one, "u string, w map<string, double>, f double, e double, n bigint")
    c = F.col
    good = made.select(c("u").alias(unit), (c("u") == treated).alias("is_treated"), c("w").alias("weights"), c("f").alias("fit"), F.when(c("f") >= least_fit, c("e")).alias("effect"), "n")
    own = good.where("is_treated").agg(F.first("effect").alias("__e"))
    tail = good.crossJoin(own).where("not is_treated and effect is not null").agg(((F.count_if(F.abs("effect") >= F.abs("__e")) + 1) / (F.count(F.lit(1)) + 1)).alias("__p"))
    return good.crossJoin(F.broadcast(tail)).withColumn("p", F.when(c("is_treated") & c("effect").isNotNull(), c("__p"))).drop("__p")
