"""Tests, intervals and effect sizes.

Everything that moments give is an aggregate: n, mean and variance per group, combined by
expressions; only the p values of these few rows pass through numpy. Resampling runs per
group with a seed from the group's key.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special as s
from .ranking import running_before


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson's coefficient of complete pairs; null where a side is constant or there is no pair."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def moments(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """n, mean, var (sample), sd (sample), pop (population deviation) of the non-null values."""
    v = F.col(value).cast("double")
    return df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*by).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("var"), F.stddev_samp(v).alias("sd"), F.stddev_pop(v).alias("pop")
    )


def two_samples(df: DataFrame, group: str, a: str, b: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per ``by`` with the moments of the groups a and b: n_a, mean_a, var_a and so on."""
    v, g = F.col(value).cast("double"), F.col(group)
    aggs = []
    for label, x in (("a", a), ("b", b)):
        w = F.when(g == x, v)
        aggs += [F.count(w).alias(f"n_{label}"), F.avg(w).alias(f"mean_{label}"), F.var_samp(w).alias(f"var_{label}")]
    rows = df.where(g.isin(a, b) & v.isNotNull())
    return rows.groupBy(*by).agg(*aggs) if by else rows.agg(*aggs)


def t_test(samples: DataFrame) -> DataFrame:
    """Student's two-sample test on the moments of ``two_samples``: statistic, df, effect (Cohen's d), hedges_g, lo, hi and p.

    A single value has no variance of its own; without a degree of freedom there is no statistic.
    Two constant samples: no difference gives p 1, a difference infinite statistic and p 0.
    """
    c = F.col
    df = c("n_a") + c("n_b") - 2
    pooled = F.sqrt(F.try_divide((c("n_a") - 1) * F.coalesce("var_a", F.lit(0.0)) + (c("n_b") - 1) * F.coalesce("var_b", F.lit(0.0)), F.when(df > 0, df)))
    diff = c("mean_a") - c("mean_b")
    se = pooled * F.sqrt(F.try_divide(F.lit(1.0), c("n_a")) + F.try_divide(F.lit(1.0), c("n_b")))
    stat = F.when(se.isNull(), None).when(se > 0, F.try_divide(diff, se)).when(diff == 0, F.lit(0.0)).when(diff > 0, F.lit(float("inf"))).when(diff < 0, F.lit(float("-inf")))
    effect = F.when(pooled > 0, F.try_divide(diff, pooled)).otherwise(F.lit(0.0))
    out = samples.withColumns({"difference": diff, "df": df, "statistic": stat, "effect": effect, "lo": diff - 1.96 * se, "hi": diff + 1.96 * se})
    out = out.withColumn("hedges_g", c("effect") * (1 - F.try_divide(F.lit(3.0), 4.0 * (c("n_a") + c("n_b")) - 9)))
    return out.withColumn("p", s.t_p_value(c("statistic").cast("double"), c("df").cast("double")))


def anova(groups: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One-way analysis of variance on rows of ``moments``: k, n, statistic, eta_squared, p. The grand mean weighs groups by size."""
    c = F.col
    agg = groups.groupBy(*by).agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(c("n") * c("mean")).alias("s"), F.sum(c("n") * c("mean") * c("mean")).alias("q"),
        F.sum((c("n") - 1) * F.coalesce("var", F.lit(0.0))).alias("within"),
    )
    between = F.greatest(F.lit(0.0), c("q") - c("s") * c("s") / c("n"))
    stat = F.try_divide(F.try_divide(between, c("k") - 1), F.try_divide(c("within"), c("n") - c("k")))
    out = agg.withColumns({"statistic": stat, "eta_squared": F.try_divide(between, between + c("within"))})
    p = s.f_p_value(c("statistic"), (c("k") - 1).cast("double"), (c("n") - c("k")).cast("double"))
    return out.withColumn("p", p).select(*by, "k", "n", "statistic", "eta_squared", "p")


def average_ranks(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Value counts with the average rank of ties: value, ties, before, average_rank. One row per distinct value, so no row is ranked on its own."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("ties"))
    if by:  # a group's distinct values are one window
        line = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("before", F.coalesce(F.sum("ties").over(line), F.lit(0)))
    else:
        counts = running_before(counts, value, "ties", "before")
    return counts.withColumn("average_rank", F.col("before") + (F.col("ties") + 1) / 2.0)


def rank_sums(df: DataFrame, group: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """n and rank_sum of each group, with the tie term and size of the whole."""
    ranks = average_ranks(df, value, by)
    tie = ranks.groupBy(*by).agg(F.sum(F.pow("ties", F.lit(3.0)) - F.col("ties")).alias("tie_term"), F.sum("ties").alias("n_all"))
    sums = df.where(F.col(group).isNotNull()).groupBy(*by, group, value).agg(F.count(F.lit(1)).alias("c")).join(ranks.select(*by, value, "average_rank"), [*by, value])
    sums = sums.groupBy(*by, group).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("average_rank")).alias("rank_sum"))
    return sums.join(tie, list(by)) if by else sums.crossJoin(F.broadcast(tie))


#: Samples up to this size without ties have exact probabilities.
EXACT = 8


def _exact_p() -> list[list[list[float]]]:
    """Two-sided p of U by the sizes of both samples (from 1) and U (from 0), from the number of orders that give each U."""
    ways: dict[tuple[int, int], list[int]] = {}
    for a in range(EXACT + 1):
        for b in range(EXACT + 1):
            n = [0] * (a * b + 1)
            if not a * b:
                n[0] = 1
            else:
                for u in range(a * b + 1):  # the largest value is of the first sample and beats all b, or of the second
                    n[u] = (ways[a - 1, b][u - b] if u >= b else 0) + (ways[a, b - 1][u] if u <= a * (b - 1) else 0)
            ways[a, b] = n
    table = []
    for a in range(1, EXACT + 1):
        table.append([])
        for b in range(1, EXACT + 1):
            n = ways[a, b]
            table[-1].append([min(1.0, 2 * min(sum(n[: u + 1]), sum(n[u:])) / sum(n)) for u in range(a * b + 1)])
    return table


def median_difference(df: DataFrame, group: str, a: str, b: str, value: str, by: Sequence[str] = (), z: float = 1.96) -> DataFrame:
    """median_a, median_b, difference and lo, hi: z times the pooled population deviation over the samples' sizes."""
    c = F.col
    of = lambda g: F.median(F.when(c(group) == g, c(value)))
    size = lambda g: F.count(F.when(c(group) == g, c(value)))
    out = df.where(c(group).isin(a, b)).groupBy(*by).agg(of(a).alias("median_a"), of(b).alias("median_b"), size(a).alias("__m"), size(b).alias("__n"), F.stddev_pop(value).alias("__sd"))
    reach = z * F.sqrt(F.try_divide(c("__m") + c("__n"), c("__m") * c("__n"))) * c("__sd")
    return out.withColumn("difference", c("median_a") - c("median_b")).withColumns({"lo": c("difference") - reach, "hi": c("difference") + reach}).drop("__m", "__n", "__sd")


def mann_whitney(df: DataFrame, group: str, a: str, b: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """U of group a, z (normal approximation with tie and continuity correction), effect 1 - 2U/(n_a n_b) and two-sided p.

    Two samples of at most ``EXACT`` values each without ties have the exact p.
    """
    c = F.col
    sums = rank_sums(df.where(c(group).isin(a, b)), group, value, by)
    pick = lambda g, x: F.max(F.when(c(group) == g, c(x)))
    wide = sums.groupBy(*by).agg(pick(a, "n").alias("n_a"), pick(b, "n").alias("n_b"), pick(a, "rank_sum").alias("r_a"), F.max("tie_term").alias("tie_term"))
    n, prod = c("n_a") + c("n_b"), c("n_a") * c("n_b")
    u = c("r_a") - c("n_a") * (c("n_a") + 1) / 2.0
    sigma = F.sqrt(prod / 12.0 * ((n + 1) - F.try_divide(c("tie_term"), n * (n - 1))))
    out = wide.withColumns({"u": u, "z": F.coalesce(F.try_divide(F.greatest(F.lit(0.0), F.abs(u - prod / 2.0) - 0.5), sigma), F.lit(0.0)), "effect": 1 - F.try_divide(2 * u, prod)})
    small = (c("n_a") <= EXACT) & (c("n_b") <= EXACT) & (c("tie_term") == 0)
    at = lambda x, i: F.get(x, i.cast("int"))
    exact = at(at(at(F.lit(_exact_p()), c("n_a") - 1), c("n_b") - 1), c("u"))
    return out.withColumn("p", F.when(small, exact).otherwise(s.normal_p_value("z"))).select(*by, "n_a", "n_b", "u", "z", "effect", "p")


def kruskal_wallis(df: DataFrame, group: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """H with tie correction, effect (H - k + 1)/(n - k) held in 0..1, and p; all values alike give H 0 and p 1."""
    c = F.col
    wide = rank_sums(df, group, value, by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("k"), F.max("n_all").alias("n"), F.sum(c("rank_sum") * c("rank_sum") / c("n")).alias("q"), F.max("tie_term").alias("tie_term")
    )
    raw = 12.0 / (c("n") * (c("n") + 1)) * c("q") - 3 * (c("n") + 1)
    ties = 1 - F.try_divide(c("tie_term"), F.pow("n", F.lit(3.0)) - c("n"))
    out = wide.withColumn("h", F.coalesce(F.try_divide(raw, ties), F.lit(0.0)))
    effect = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(c("h") - c("k") + 1, c("n") - c("k"))))
    return out.withColumn("effect", effect).withColumn("p", s.chi2_p_value("h", (c("k") - 1).cast("double"))).select(*by, "k", "n", "h", "effect", "p")


def correlation(df: DataFrame, x: str, y: str, by: Sequence[str] = (), z: float = 1.959964) -> DataFrame:
    """n, r, lo, hi (Fisher), p over complete pairs; a constant side gives r 0, fewer than four pairs the interval -1..1, fewer than three no r."""
    c = F.col
    a, b = c(x).cast("double"), c(y).cast("double")
    agg = df.where(a.isNotNull() & b.isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), safe_corr(a, b).alias("raw"))
    r = F.when(c("n") >= 3, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce("raw", F.lit(0.0)))))
    out = agg.withColumn("r", r)
    inner = F.greatest(F.lit(-0.9999999), F.least(F.lit(0.9999999), c("r")))
    half = F.when(c("n") > 3, F.lit(z) / F.sqrt(F.greatest(c("n") - 3, F.lit(1)).cast("double")))
    bound = lambda sign: F.coalesce(F.tanh(F.atanh(inner) + sign * half), F.when(c("r").isNotNull(), F.lit(float(sign))))
    stat = F.when(F.abs(c("r")) >= 1, F.lit(float("inf"))).otherwise(F.abs(c("r")) * F.sqrt((c("n") - 2) / F.nullif(1 - c("r") * c("r"), F.lit(0.0))))
    out = out.withColumns({"lo": bound(-1), "hi": bound(1), "t": stat})
    return out.withColumn("p", s.t_p_value(c("t"), (c("n") - 2).cast("double"))).select(*by, "n", "r", "lo", "hi", "p")


def mean_interval(groups: DataFrame, level: float = 0.95) -> DataFrame:
    """Add half (t times standard error), lo and hi to rows of ``moments``; a single value has none."""
    se = F.col("sd") / F.sqrt(F.col("n").cast("double"))
    out = groups.withColumn("half", s.t_critical(F.lit(level), F.nullif(F.col("n") - 1, F.lit(0)).cast("double")) * se)
    return out.withColumns({"lo": F.col("mean") - F.col("half"), "hi": F.col("mean") + F.col("half")})


def wilson(successes: Column, trials: Column, z: float = 1.959963984540054) -> Column:
    """Struct lo, hi of Wilson's interval of a proportion; null without trials."""
    n, zz = F.nullif(trials.cast("double"), F.lit(0.0)), z * z
    p = successes / n
    centre, width = (p + zz / (2 * n)) / (1 + zz / n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return _held(centre - width, centre + width)


def _held(lo: Column, hi: Column) -> Column:
    """Struct lo, hi held in 0..1; nulls stay."""
    return F.struct(F.when(lo.isNotNull(), F.greatest(F.lit(0.0), lo)).alias("lo"), F.when(hi.isNotNull(), F.least(F.lit(1.0), hi)).alias("hi"))


def normal_proportion(successes: Column, trials: Column, z: float = 1.959963984540054) -> Column:
    """Struct lo, hi of the normal interval of a proportion, held in 0..1."""
    n = F.nullif(trials.cast("double"), F.lit(0.0))
    p = successes / n
    width = z * F.sqrt(p * (1 - p) / n)
    return _held(p - width, p + width)


def exact_proportion(successes: Column, trials: Column, level: float = 0.95) -> Column:
    """Struct lo, hi of the exact (beta) interval of a proportion."""
    tail, k, n = (1 - level) / 2, successes.cast("double"), trials.cast("double")
    lo = F.when(k <= 0, F.lit(0.0)).otherwise(s.beta_ppf(F.lit(tail), F.when(k > 0, k), n - k + 1))
    hi = F.when(k >= n, F.lit(1.0)).otherwise(s.beta_ppf(F.lit(1 - tail), k + 1, F.when(n > k, n - k)))
    return F.struct(lo.alias("lo"), hi.alias("hi"))


def _ratio_interval(ratio: Column, variance: Column, z: float) -> Column:
    se = F.sqrt(variance)
    return F.struct(ratio.alias("value"), F.exp(F.log(ratio) - z * se).alias("lo"), F.exp(F.log(ratio) + z * se).alias("hi"))


def relative_risk(exposed: Column, exposed_all: Column, control: Column, control_all: Column, z: float = 1.959963984540054) -> Column:
    """Struct value, lo, hi; null parts where a cell is zero."""
    inv = lambda c: F.try_divide(F.lit(1.0), c)
    ratio = F.try_divide(F.try_divide(exposed * 1.0, exposed_all), F.try_divide(control * 1.0, control_all))
    return _ratio_interval(ratio, inv(exposed) - inv(exposed_all) + inv(control) - inv(control_all), z)


def odds_ratio(exposed: Column, exposed_all: Column, control: Column, control_all: Column, z: float = 1.959963984540054) -> Column:
    """Struct value, lo, hi; null parts where a cell is zero."""
    inv = lambda c: F.try_divide(F.lit(1.0), c)
    ratio = F.try_divide(exposed * 1.0 * (control_all - control), (exposed_all - exposed) * 1.0 * control)
    return _ratio_interval(ratio, inv(exposed) + inv(exposed_all - exposed) + inv(control) + inv(control_all - control), z)


def seed_of(key: tuple, seed: int = 42) -> int:
    """A seed that depends on the group's key only, not on where it runs."""
    return (zlib.crc32(repr(key).encode()) + seed) % (2**32)


def resampled(df: DataFrame, by: Sequence[str], value: str, statistic: Callable[[np.ndarray], np.ndarray] | str = "mean", draws: int = 10_000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """Percentile bootstrap per group: n, estimate, lo, hi.

    ``statistic`` maps a matrix of resamples (one a row) to one number each; "mean" and
    "median" by name. Groups are series, whose length is bounded by their days.
    """
    named = {"mean": lambda m: m.mean(axis=-1), "median": lambda m: np.median(m, axis=-1)}
    fn = named[statistic] if isinstance(statistic, str) else statistic
    tails = [(1 - level) / 2 * 100, (1 + level) / 2 * 100]

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(pdf["__v"].dropna().to_numpy(float))
        if not len(x):
            return pd.DataFrame([[*key, 0, None, None, None]])
        rng = np.random.RandomState(seed_of(key, seed))
        per = max(1, 4_000_000 // len(x))
        made = np.concatenate([np.asarray(fn(x[rng.randint(0, len(x), (min(per, draws - i), len(x)))])) for i in range(0, draws, per)])
        lo, hi = np.percentile(made, tails)
        return pd.DataFrame([[*key, len(x), float(fn(x[None, :])[0]), lo, hi]])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by).schema)
    rows = df.select(*by, F.col(value).cast("double").alias("__v"))
    return rows.groupBy(*by).applyInPandas(lambda k, p: _named(one(k, p), [*by, "n", "estimate", "lo", "hi"]), f"{fields}, n bigint, estimate double, lo double, hi double")


def permutation_test(df: DataFrame, by: Sequence[str], group: str, a: str, b: str, value: str, draws: int = 10_000, seed: int = 42) -> DataFrame:
    """Difference of means of two groups against random relabelling: difference, effect (by the population deviation) and p."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["__v"]).sort_values(["__g", "__v"])
        x, is_a = pdf["__v"].to_numpy(float), (pdf["__g"] == a).to_numpy()
        n_a, n = int(is_a.sum()), len(x)
        if not 0 < n_a < n:
            return pd.DataFrame([[*key, None, None, None]])
        diff = x[is_a].mean() - x[~is_a].mean()
        rng, hits, per = np.random.RandomState(seed_of(key, seed)), 0, max(1, 2_000_000 // n)
        for i in range(0, draws, per):
            first = np.argsort(rng.random_sample((min(per, draws - i), n)), axis=1)[:, :n_a]
            mean_a = x[first].mean(axis=1)
            made = mean_a - (x.sum() - mean_a * n_a) / (n - n_a)
            hits += int((np.abs(made) >= abs(diff) - 1e-12).sum())
        sd = x.std()
        return pd.DataFrame([[*key, diff, diff / sd if sd > 0 else 0.0, hits / draws]])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by).schema)
    rows = df.where(F.col(group).isin(a, b)).select(*by, F.col(group).alias("__g"), F.col(value).cast("double").alias("__v"))
    return rows.groupBy(*by).applyInPandas(lambda k, p: _named(one(k, p), [*by, "difference", "effect", "p"]), f"{fields}, difference double, effect double, p double")


def _named(pdf: pd.DataFrame, columns: list[str]) -> pd.DataFrame:
    pdf.columns = columns
    return pdf


def slope(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Least squares per group: n, slope, intercept, r2, se (of the slope), p."""
    c = F.col
    a, b = c(x).cast("double"), c(y).cast("double")
    out = df.where(a.isNotNull() & b.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(a).alias("__mx"), F.avg(b).alias("__my"), F.regr_sxx(b, a).alias("sxx"), F.regr_syy(b, a).alias("syy"), F.regr_sxy(b, a).alias("__sxy")
    )
    out = out.withColumn("slope", F.try_divide(c("__sxy"), F.nullif(c("sxx"), F.lit(0.0))))
    out = out.withColumns({"intercept": c("__my") - c("slope") * c("__mx"), "r2": F.try_divide(c("slope") * c("__sxy"), F.nullif(c("syy"), F.lit(0.0)))}).drop("__mx", "__my", "__sxy")
    sse = F.greatest(F.lit(0.0), c("syy") - c("slope") * c("slope") * c("sxx"))
    out = out.withColumn("sse", sse).withColumn("se", F.sqrt(F.try_divide(F.try_divide(c("sse"), F.nullif(c("n") - 2, F.lit(0))), c("sxx"))))
    return out.withColumn("p", s.t_p_value(F.try_divide(c("slope"), c("se")), F.nullif(c("n") - 2, F.lit(0)).cast("double")))


def slope_agreement(slopes: DataFrame, direction: float, by: Sequence[str] = ()) -> DataFrame:
    """Whether sources support a finding: mean score (1 the same direction and significant, half the same direction) and a majority rule."""
    same = F.signum("slope") == F.lit(float(np.sign(direction)))
    score = F.when(same & (F.col("p") < 0.05), 1.0).when(same, 0.5).otherwise(0.0)
    return slopes.withColumn("score", score).groupBy(*by).agg(F.avg("score").alias("score"), (F.avg(F.when(same, 1.0).otherwise(0.0)) > 0.5).alias("is_consistent"))


def without_outliers(df: DataFrame, by: Sequence[str], value: str, limit: float = 3.0) -> DataFrame:
    """Rows within ``limit`` population deviations of their group's mean; constant groups stay whole."""
    stats = df.groupBy(*by).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__sd"))
    joined = df.join(stats, list(by)) if by else df.crossJoin(F.broadcast(stats))
    return joined.where((F.col("__sd") == 0) | (F.abs(F.col(value) - F.col("__m")) <= limit * F.col("__sd"))).select(*df.columns)


def stability(results: DataFrame, value: str, most: float, by: Sequence[str] = ()) -> DataFrame:
    """cv of results over parameters or methods, whether it is below ``most``, and the median; a mean of 0 has no cv and is unstable unless constant."""
    cv = F.try_divide(F.stddev_pop(value), F.abs(F.avg(value)))
    return results.groupBy(*by).agg(cv.alias("cv"), F.coalesce(cv < most, F.stddev_pop(value) == 0).alias("is_stable"), F.median(value).alias("median"))


def over_parameters(fn: Callable[..., DataFrame], parameters: Sequence[dict]) -> DataFrame:
    """Union of the results of a function of parameters, with the number of each run as ``run``."""
    runs = [fn(**p).withColumn("run", F.lit(i)) for i, p in enumerate(parameters)]
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return out


def autocorrelation(df: DataFrame, by: Sequence[str], order: str, value: str, lag: int) -> DataFrame:
    """Biased autocorrelation at a lag with its standard error 1/sqrt(n), z and p."""
    c = F.col
    means = df.groupBy(*by).agg(F.avg(value).alias("__m"), F.count(value).alias("n"))
    w = Window.partitionBy(*by).orderBy(order)
    x = df.join(means, list(by)).withColumn("__d", c(value) - c("__m")).withColumn("__l", F.lag("__d", lag).over(w))
    out = x.groupBy(*by).agg(F.max("n").alias("n"), F.try_divide(F.sum(c("__d") * c("__l")), F.sum(c("__d") * c("__d"))).alias("acf"))
    return out.withColumn("z", c("acf") * F.sqrt(c("n").cast("double"))).withColumn("p", s.normal_p_value("z"))


def partial_autocorrelation(x: np.ndarray, lag: int) -> float:
    """Partial autocorrelation at a lag by Levinson-Durbin on unbiased autocovariances."""
    d = np.asarray(x, float) - np.mean(x)
    n = len(d)
    cov = np.array([(d[: n - k] * d[k:]).sum() / (n - k) for k in range(lag + 1)])
    if cov[0] <= 0:
        return 0.0
    phi, err = np.zeros(lag + 1), cov[0]
    last = 0.0
    for k in range(1, lag + 1):
        last = (cov[k] - (phi[1:k] * cov[k - 1 : 0 : -1]).sum()) / err
        new = phi.copy()
        new[k] = last
        new[1:k] = phi[1:k] - last * phi[k - 1 : 0 : -1]
        phi, err = new, err * (1 - last * last)
    return float(last)


def spectral_peak(x: np.ndarray) -> tuple[float, float]:
    """Period of the largest peak of the periodogram (constant removed) and its power relative to the mean."""
    d = np.asarray(x, float) - np.mean(x)
    power = np.abs(np.fft.rfft(d)) ** 2
    if len(power) < 2 or power[1:].sum() == 0:
        return float("nan"), 0.0
    k = 1 + int(np.argmax(power[1:]))
    return len(d) / k, float(power[k] / power[1:].mean())


def prediction_interval(point: Column, residual_sd: Column, step: Column, horizon: int, level: float = 0.95) -> Column:
    """Struct lo, hi around a forecast: the residual deviation grows with the share of the horizon."""
    half = s.normal_quantile((1 + level) / 2) * residual_sd * F.sqrt(1 + step / float(horizon))
    return F.struct((point - half).alias("lo"), (point + half).alias("hi"))


def normality(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Jarque-Bera test per group: n, statistic, p, for groups of any size: it needs no sorted sample."""
    c = F.col
    v = c(value).cast("double")
    out = df.where(v.isNotNull()).groupBy(*by).agg(F.count(v).alias("n"), F.skewness(v).alias("skew"), F.kurtosis(v).alias("kurt"))
    out = out.withColumn("statistic", c("n") / 6.0 * (c("skew") * c("skew") + c("kurt") * c("kurt") / 4))
    return out.withColumn("p", s.chi2_p_value("statistic", F.lit(2.0))).select(*by, "n", "statistic", "p")


#: Values of a group up to which the sorted sample is tested.
SHAPIRO_MOST = 5_000


def shapiro_wilk(values: np.ndarray) -> tuple[float, float]:
    """W and p of three to ``SHAPIRO_MOST`` values by Royston's approximation; equal values are as normal as can be."""
    x = np.sort(np.asarray(values, float))
    n = len(x)
    if x[-1] - x[0] < 1e-19:
        return 1.0, 1.0
    m = np.array([s.normal_quantile((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    # The polynomials of the approximation, in rising powers.
    last, next_last = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056), (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
    small_mean, small_log_sd = (0.5440, -0.39978, 0.025054, -0.0006714), (1.3822, -0.77857, 0.062767, -0.0020322)
    large_mean, large_log_sd = (-1.5861, -0.31082, -0.083751, 0.0038915), (-0.4803, -0.082676, 0.0030302)
    at = np.polynomial.polynomial.polyval
    square, u = float(m @ m), 1 / np.sqrt(n)
    a = m / np.sqrt(square)
    if n == 3:
        a = np.array([-np.sqrt(0.5), 0.0, np.sqrt(0.5)])
    else:
        k = 2 if n > 5 else 1
        ends = [a[-1] + at(u, last), a[-2] + at(u, next_last)][:k]
        rest = (square - 2 * (m[-k:] @ m[-k:])) / (1 - 2 * sum(e * e for e in ends))
        a = m / np.sqrt(rest)
        for i, e in enumerate(ends):
            a[-1 - i], a[i] = e, -e
    w = min(1.0, float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum()))
    if n == 3:
        return w, float(max(0.0, 6 / np.pi * (np.arcsin(np.sqrt(w)) - np.arcsin(np.sqrt(0.75)))))
    if w == 1:
        return w, 1.0
    if n <= 11:
        y, mean, sd = -np.log(max(0.459 * n - 2.273 - np.log(1 - w), 1e-12)), at(n, small_mean), np.exp(at(n, small_log_sd))
    else:
        y, mean, sd = np.log(1 - w), at(np.log(n), large_mean), np.exp(at(np.log(n), large_log_sd))
    return w, float(1 - s.normal_cdf((y - mean) / sd))


def sample_normality(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """n, statistic, p of Shapiro and Wilk's test per group of 3 to ``SHAPIRO_MOST`` values; smaller groups have no p, larger ones that of ``normality``."""
    sizes = normality(df, by, value)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by).schema)
    rows = df.select(*by, F.col(value).cast("double").alias("__v")).where("__v is not null")
    fit = sizes.where(F.col("n").between(3, SHAPIRO_MOST)).select(*by)

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _named(pd.DataFrame([[*key, len(pdf), *shapiro_wilk(pdf["__v"].to_numpy())]]), [*by, "n", "statistic", "p"])

    tested = rows.join(fit, list(by), "left_semi").groupBy(*by).applyInPandas(one, f"{fields}, n bigint, statistic double, p double")
    none = F.lit(None).cast("double")
    rest = sizes.where(~F.col("n").between(3, SHAPIRO_MOST)).select(*by, "n", *(F.when(F.col("n") > SHAPIRO_MOST, F.col(c)).otherwise(none).alias(c) for c in ("statistic", "p")))
    return tested.unionByName(rest)


def pre_post(df: DataFrame, by: Sequence[str], day: str, value: str, at: str, alpha: float = 0.05) -> DataFrame:
    """Compare before and after: Student's t where both sides pass for normal, else the rank test: test, p, effect."""
    part = df.withColumn("__p", F.when(F.col(day) < F.lit(at).cast("date"), "before").otherwise("after"))
    fits = sample_normality(part, [*by, "__p"], value).groupBy(*by).agg(F.bool_and(F.coalesce(F.col("p") >= alpha, F.lit(False))).alias("__normal"))
    t = t_test(two_samples(part, "__p", "before", "after", value, by)).select(*by, F.col("p").alias("__tp"), F.col("effect").alias("__te"))
    u = mann_whitney(part, "__p", "before", "after", value, by).select(*by, F.col("p").alias("__up"), F.col("effect").alias("__ue"))
    both = fits.join(t, list(by)).join(u, list(by))
    pick = lambda a, b: F.when(F.col("__normal"), F.col(a)).otherwise(F.col(b))
    return both.select(*by, F.when(F.col("__normal"), "t").otherwise("mann_whitney").alias("test"), pick("__tp", "__up").alias("p"), pick("__te", "__ue").alias("effect"))


def over_threshold(share: Column, lo: Column, hi: Column, threshold: float = 0.7) -> Column:
    """Struct exceeds, z of a share against a threshold, with the error taken from its 95 % interval."""
    se = (hi - lo) / (2 * 1.959963984540054)
    return F.struct((share > threshold).alias("exceeds"), F.try_divide(share - threshold, se).alias("z"))


def subsamples(df: DataFrame, by: Sequence[str], value: str, draws: int = 100, share: float = 0.8, seed: int = 42) -> DataFrame:
    """Stability of the mean over subsamples without replacement: mean, cv, is_stable (below a fifth)."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(pdf["__v"].dropna().to_numpy(float))
        k = max(1, int(len(x) * share)) if len(x) else 0
        if not k:
            return _named(pd.DataFrame([[*key, None, None, None]]), [*by, "mean", "cv", "is_stable"])
        rng = np.random.RandomState(seed_of(key, seed))
        made = np.array([x[rng.permutation(len(x))[:k]].mean() for _ in range(draws)])
        cv = float(made.std() / abs(made.mean())) if made.mean() else None
        return _named(pd.DataFrame([[*key, float(made.mean()), cv, cv is not None and cv < 0.2]]), [*by, "mean", "cv", "is_stable"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by).schema)
    return df.select(*by, F.col(value).cast("double").alias("__v")).groupBy(*by).applyInPandas(one, f"{fields}, mean double, cv double, is_stable boolean")


def against_benchmark(df: DataFrame, benchmark: DataFrame, day: str, value: str) -> DataFrame:
    """One row: r, ratio of means and whether both slopes have the same sign, over the positions that both series have."""
    number = lambda t, c: t.select(F.row_number().over(Window.orderBy(day)).alias("__k"), F.col(value).cast("double").alias(c))
    both = number(df, "x").join(number(benchmark, "y"), "__k")
    return both.agg(safe_corr(F.col("x"), F.col("y")).alias("r"), F.try_divide(F.avg("x"), F.avg("y")).alias("ratio"), (F.signum(F.regr_sxy("x", "__k")) == F.signum(F.regr_sxy("y", "__k"))).alias("same_direction"))


def alignment(days: DataFrame, day: str, event: str, first: str, last: str, tolerance: int = 14) -> DataFrame:
    """day, distance, is_aligned, p: the share of all days between first and last that are as near to the event."""
    d = lambda x: F.lit(x).cast("date")
    distance = F.abs(F.datediff(day, d(event)))
    before, after = F.datediff(d(event), d(first)), F.datediff(d(last), d(event))
    near = F.least(distance, before) + F.least(distance, after) + 1
    return days.select(day, distance.alias("distance"), (distance <= tolerance).alias("is_aligned"), F.least(F.lit(1.0), near / (before + after + 1)).alias("p"))


def decomposition_consistency(parts: DataFrame, by: Sequence[str], day: str, columns: Sequence[str], least: float = 0.7) -> DataFrame:
    """Smallest correlation between the seasonal parts of several methods (one column each), and whether it is over ``least``."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return parts.groupBy(*by).agg(F.least(*(F.coalesce(safe_corr(F.col(a), F.col(b)), F.lit(0.0)) for a, b in pairs), F.lit(1.0)).alias("smallest")).withColumn("is_consistent", F.col("smallest") > least)
