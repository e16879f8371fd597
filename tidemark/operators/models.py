"""Models of daily series in numpy, one series a task: decomposition, changepoints, forecasts.

Every function here takes arrays of one series, whose length is bounded by its days; the
``per_series`` wrappers run them by group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import special


def filled(x: np.ndarray) -> np.ndarray:
    """Gaps filled along straight lines; ends with the nearest value."""
    x = np.asarray(x, float)
    ok = ~np.isnan(x)
    return np.interp(np.arange(len(x)), np.flatnonzero(ok), x[ok]) if ok.any() else np.zeros_like(x)


def loess(y: np.ndarray, window: int, degree: int = 1, weights: np.ndarray | None = None, at: np.ndarray | None = None) -> np.ndarray:
    """Local regression with tricube weights over the ``window`` nearest positions, at the given positions (also outside)."""
    n = len(y)
    at = np.arange(n, dtype=float) if at is None else np.asarray(at, float)
    q = min(window, n)
    lo = np.clip(np.searchsorted(np.arange(n), at - (q - 1) / 2), 0, n - q)
    idx = lo[:, None] + np.arange(q)
    dist = np.abs(idx - at[:, None])
    reach = dist.max(axis=1, keepdims=True) * (1.0 if window <= n else window / n) + 1e-9
    w = np.clip(1 - (dist / reach) ** 3, 0, None) ** 3
    if weights is not None:
        w = w * weights[idx]
    s = w.sum(axis=1)
    flat = s <= 0
    w = np.where(flat[:, None], 1.0, w)
    s = w.sum(axis=1)
    x, v = idx - at[:, None], y[idx]
    mx, mv = (w * x).sum(axis=1) / s, (w * v).sum(axis=1) / s
    if degree == 0:
        return mv
    sxx = (w * (x - mx[:, None]) ** 2).sum(axis=1)
    sxy = (w * (x - mx[:, None]) * (v - mv[:, None])).sum(axis=1)
    return mv - np.where(sxx > 1e-9, sxy / np.maximum(sxx, 1e-12), 0) * mx


def _means(x: np.ndarray, k: int) -> np.ndarray:
    c = np.concatenate(([0.0], np.cumsum(x)))
    return (c[k:] - c[:-k]) / k


def stl(x: np.ndarray, period: int, seasonal: int = 7, trend: int | None = None, inner: int = 2, robust: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trend, seasonal and remainder by alternating loess of the cycle positions and of the deseasonalised series.

    Windows are made odd. At least two periods are needed.
    """
    y = filled(x)
    n = len(y)
    if n < 2 * period:
        raise ValueError("a decomposition needs two periods")
    seasonal += seasonal % 2 == 0
    if trend is None:
        trend = int(np.ceil(1.5 * period / (1 - 1.5 / seasonal)))
    trend += trend % 2 == 0
    low = period + (period % 2 == 0)
    level, season, rho = np.zeros(n), np.zeros(n), np.ones(n)
    for turn in range(robust + 1):
        for _ in range(inner):
            detrended = y - level
            cycle = np.zeros(n + 2 * period)
            for p in range(period):
                part = detrended[p::period]
                cycle[p::period] = loess(part, seasonal, 1, rho[p::period], np.arange(-1, len(part) + 1))
            smooth = loess(_means(_means(_means(cycle, period), period), 3), low)
            season = cycle[period : period + n] - smooth
            level = loess(y - season, trend, 1, rho)
        if turn < robust:
            r = np.abs(y - level - season)
            h = 6 * np.median(r)
            rho = np.clip(1 - (r / h) ** 2, 0, None) ** 2 if h > 0 else np.ones(n)
    return level, season, y - level - season


def hp_trend(x: np.ndarray, smoothing: float | None = None) -> np.ndarray:
    """The trend that balances closeness and squared second differences, by a banded solve in linear time."""
    y = filled(x)
    n = len(y)
    lam = smoothing if smoothing is not None else (129_600.0 if n > 100 else 1_600.0)
    if n < 3:
        return y
    d = np.zeros((3, n))
    main, one, two = np.ones(n), np.zeros(n - 1), np.zeros(n - 2)
    for i in range(n - 2):
        main[i : i + 3] += lam * np.array([1, 4, 1])
        one[i : i + 2] += lam * np.array([-2, -2])
        two[i] += lam
    # LDL' of the symmetric matrix with two off-diagonals.
    l1, l2 = np.zeros(n), np.zeros(n)
    diag = d[0]
    for i in range(n):
        v = main[i]
        if i >= 1:
            v -= l1[i] ** 2 * diag[i - 1]
        if i >= 2:
            v -= l2[i] ** 2 * diag[i - 2]
        diag[i] = v
        if i + 1 < n:
            l1[i + 1] = (one[i] - (l2[i + 1] * l1[i] * diag[i - 1] if i >= 1 else 0)) / v
        if i + 2 < n:
            l2[i + 2] = two[i] / v
    z = y.copy()
    for i in range(n):
        z[i] -= (l1[i] * z[i - 1] if i >= 1 else 0) + (l2[i] * z[i - 2] if i >= 2 else 0)
    z /= diag
    for i in range(n - 1, -1, -1):
        z[i] -= (l1[i + 1] * z[i + 1] if i + 1 < n else 0) + (l2[i + 2] * z[i + 2] if i + 2 < n else 0)
    return z


# Changepoints


def l2_cost(x: np.ndarray) -> Callable[[int, int], float]:
    """Squared error around the mean of a stretch, from prefix sums."""
    s, q = np.concatenate(([0.0], np.cumsum(x))), np.concatenate(([0.0], np.cumsum(x * x)))
    return lambda a, b: q[b] - q[a] - (s[b] - s[a]) ** 2 / (b - a)


def rbf_cost(x: np.ndarray, most: int = 3000) -> Callable[[int, int], float]:
    """Spread of a stretch under a Gaussian kernel whose width is the median distance; the kernel matrix bounds the length."""
    if len(x) > most:
        raise ValueError(f"a kernel cost keeps at most {most} positions; aggregate the series first")
    d = (x[:, None] - x[None, :]) ** 2
    med = np.median(d[np.triu_indices(len(x), 1)]) if len(x) > 1 else 1.0
    k = np.exp(-np.clip(d / med, 0, 100)) if med > 0 else np.exp(-np.clip(d, 0, 100))
    c = np.zeros((len(x) + 1, len(x) + 1))
    c[1:, 1:] = k.cumsum(0).cumsum(1)
    return lambda a, b: (b - a) - (c[b, b] - c[a, b] - c[b, a] + c[a, a]) / (b - a)


def optimal_partition(cost: Callable[[int, int], float], n: int, penalty: float, least: int) -> list[int]:
    """Breaks that minimise cost plus penalty a break, with pruning of starts that cannot win."""
    best, before, alive = np.full(n + 1, np.inf), np.zeros(n + 1, int), [0]
    best[0] = -penalty
    for b in range(least, n + 1):
        tried = [(best[a] + cost(a, b) + penalty, a) for a in alive if b - a >= least]
        if not tried:
            continue
        best[b], before[b] = min(tried)
        keep = {a for v, a in tried if v - penalty <= best[b]}
        alive = [a for a in alive if b - a < least or a in keep]
        if b - least + 1 >= least and np.isfinite(best[b - least + 1]):
            alive.append(b - least + 1)
    breaks, b = [], n
    while b > 0:
        b = int(before[b])
        if b > 0:
            breaks.append(b)
    return breaks[::-1]


def binary_segmentation(cost: Callable[[int, int], float], n: int, breaks: int, least: int = 2) -> list[int]:
    """The break that lowers the cost most, again and again."""
    edges = [0, n]
    for _ in range(breaks):
        gains = [(cost(a, b) - cost(a, t) - cost(t, b), t) for a, b in zip(edges, edges[1:]) for t in range(a + least, b - least + 1)]
        if not gains:
            break
        gain, t = max(gains, key=lambda g: (g[0], -g[1]))
        if gain <= 0:
            break
        edges = sorted([*edges, t])
    return edges[1:-1]


def bottom_up(cost: Callable[[int, int], float], n: int, penalty: float, grid: int = 5) -> list[int]:
    """Fine cuts merged while a merge costs less than the penalty."""
    edges = [*range(0, n, grid), n]
    if len(edges) > 2 and edges[-1] - edges[-2] < 2:
        edges.pop(-2)
    while len(edges) > 2:
        costs = [cost(a, c) - cost(a, b) - cost(b, c) for a, b, c in zip(edges, edges[1:], edges[2:])]
        k = int(np.argmin(costs))
        if costs[k] > penalty:
            break
        edges.pop(k + 1)
    return edges[1:-1]


def describe_break(x: np.ndarray, at: int) -> dict:
    """Means on either side of a break, magnitude, direction, confidence and Student's p."""
    a, b = x[:at], x[at:]
    na, nb = len(a), len(b)
    pooled = np.sqrt(((na - 1) * a.var(ddof=1) + (nb - 1) * b.var(ddof=1)) / (na + nb - 2)) if na > 1 and nb > 1 else 0.0
    diff = b.mean() - a.mean()
    effect = abs(diff) / pooled if pooled > 0 else 0.0
    t = diff / (pooled * np.sqrt(1 / na + 1 / nb)) if pooled > 0 else 0.0
    p = float(special.t_two_sided(t, na + nb - 2)) if pooled > 0 else 1.0
    return {"pos": at, "pre_mean": float(a.mean()), "post_mean": float(b.mean()), "magnitude": float(abs(diff)), "direction": "increase" if diff > 0 else "decrease", "confidence": float(min(0.99, effect / 3)), "p": p}


def breaks_by_method(x: np.ndarray, least: int = 30, n_breaks: int = 5) -> dict[str, list[int]]:
    """Breaks by optimal partition (kernel), binary segmentation (squared error) and bottom-up merging (kernel)."""
    x = filled(x)
    n = len(x)
    if n < 2 * least:
        return {}
    scaled = (x - x.mean()) / (x.std() or 1.0)
    kernel = rbf_cost(scaled)
    return {
        "pelt": optimal_partition(kernel, n, np.log(n) * scaled.var(), least),
        "binary_segmentation": binary_segmentation(l2_cost(scaled), n, n_breaks),
        "bottom_up": bottom_up(kernel, n, 0.05 * n * np.log(n)),
    }


def consensus(breaks: dict[str, list[int]], tolerance: int = 7, confidence: Callable[[int], float] = lambda at: 0.0) -> list[int]:
    """Positions that at least two methods name within ``tolerance`` of the first: of each such group the most confident."""
    listed = sorted((at, m) for m, some in breaks.items() for at in some)
    used, found = set(), []
    for i, (seed, _) in enumerate(listed):
        if i in used:
            continue
        group = [j for j in range(i, len(listed)) if j not in used and listed[j][0] - seed <= tolerance]
        if len({listed[j][1] for j in group}) >= 2:
            used.update(group)
            found.append(max((listed[j][0] for j in group), key=lambda at: (confidence(at), -at)))
    return sorted(found)


# Forecasts


def holt_winters(x: np.ndarray, period: int, horizon: int) -> tuple[np.ndarray, np.ndarray]:
    """Point forecasts and fitted values of additive trend and season; smoothing from a grid by squared error. Without two periods only the trend."""
    y = filled(x)
    n = len(y)
    seasonal = n >= 2 * period and period > 1
    p = period if seasonal else 1
    level0 = y[:p].mean()
    trend0 = (y[p : 2 * p].mean() - level0) / p if n >= 2 * p else 0.0
    season0 = y[:p] - level0 if seasonal else np.zeros(1)
    grid = [(a, b, g) for a in (0.05, 0.2, 0.4, 0.7) for b in (0.0, 0.02, 0.1, 0.3) for g in ((0.02, 0.1, 0.3) if seasonal else (0.0,))]
    a, b, g = (np.array(v) for v in zip(*grid))
    level, trend, season = np.full(len(grid), level0), np.full(len(grid), trend0), np.tile(season0, (len(grid), 1))
    fitted = np.zeros((len(grid), n))
    for t in range(n):
        s = season[:, t % p].copy()
        fitted[:, t] = level + trend + s
        new = a * (y[t] - s) + (1 - a) * (level + trend)
        trend = b * (new - level) + (1 - b) * trend
        season[:, t % p] = g * (y[t] - new) + (1 - g) * s
        level = new
    k = int(np.argmin(((fitted - y) ** 2)[:, p:].sum(axis=1)))
    ahead = np.arange(1, horizon + 1)
    return level[k] + ahead * trend[k] + season[k, (n + ahead - 1) % p], fitted[k]


def _steady(lags: np.ndarray) -> bool:
    """Whether a recursion with these coefficients dies away."""
    if not len(lags):
        return True
    companion = np.eye(len(lags), k=-1)
    companion[0] = lags
    return bool(np.abs(np.linalg.eigvals(companion)).max() < 0.999)


def _arma(z: np.ndarray, shocks: np.ndarray, p: int, q: int, first: int) -> tuple[float, np.ndarray, np.ndarray]:
    """AIC, coefficients and fitted values from row ``first`` on of a regression on p lags and q shocks."""
    rows = np.arange(first, len(z))
    design = np.column_stack([np.ones(len(rows)), *(z[rows - k] for k in range(1, p + 1)), *(shocks[rows - k] for k in range(1, q + 1))])
    coef, *_ = np.linalg.lstsq(design, z[rows], rcond=None)
    made = design @ coef
    sse = ((z[rows] - made) ** 2).sum()
    return len(rows) * np.log(max(sse / len(rows), 1e-12)) + 2 * (p + q + 2), coef, made


def arima(x: np.ndarray, horizon: int, order: tuple[int, int, int] | None = None, most: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """ARIMA(p, d, q): point forecasts and fitted values.

    Without an order, the series is differenced while that makes its variance smaller (twice at most), and p and q
    are searched stepwise by AIC from small models on. Shocks are the residuals of a long autoregression,
    coefficients come by least squares on lags and shocks; models that do not die away or cannot be inverted are passed over.
    """
    y = filled(x)
    if order is None:
        d = 0
        while d < 2 and len(y) > 20 and np.diff(y, d + 1).var() < np.diff(y, d).var():
            d += 1
    else:
        d = order[1]
    z = np.diff(y, d) if d else y
    if len(z) < 4:
        raise ValueError("an ARIMA model needs four rows")
    long = min(10, max(1, len(z) // 4))
    shocks = np.zeros(len(z))
    if order is None or order[2]:
        shocks[long:] = z[long:] - _arma(z, shocks, long, 0, long)[2]
    if order is None:
        most, first = min(most, len(z) // 8), min(long + most, len(z) // 2)
        tried: dict[tuple[int, int], tuple[float, np.ndarray]] = {}

        def aic(p: int, q: int) -> float:
            if min(p, q) < 0 or max(p, q) > most:
                return np.inf
            if (p, q) not in tried:
                score, coef, _ = _arma(z, shocks, p, q, first)
                tried[p, q] = (score if _steady(coef[1 : p + 1]) and _steady(-coef[p + 1 :]) else np.inf, coef)
            return tried[p, q][0]

        p, q = min(((0, 0), (1, 0), (0, 1), (2, 2)), key=lambda m: aic(*m))
        while True:
            better = min(((p + i, q + j) for i in (-1, 0, 1) for j in (-1, 0, 1)), key=lambda m: aic(*m))
            if not aic(*better) < aic(p, q):
                break
            p, q = better
    else:
        p, _, q = order
    first = max(p, q + long if q else 0)
    _, coef, inner = _arma(z, shocks, p, q, first)
    past, shock, out = list(z), list(shocks), []
    for _ in range(horizon):
        step = coef[0] + sum(coef[k] * past[-k] for k in range(1, p + 1)) + sum(coef[p + k] * shock[-k] for k in range(1, q + 1))
        past.append(step)
        shock.append(0.0)
        out.append(step)
    fitted = np.full(len(y), np.nan)
    error = z[first:] - inner  # of the differences, and so of the series
    fitted[d + first :] = y[d + first :] - error
    made = np.array(out)
    for k in range(d, 0, -1):
        made = np.diff(y, k - 1)[-1] + np.cumsum(made)
    return made, fitted


def fourier_trend(x: np.ndarray, horizon: int, start_weekday: int = 0, changes: int = 10, ridge: float = 0.05, multiplicative: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A piecewise straight trend with weekly and (from a year on) yearly waves, fitted with a penalty on its changes of slope."""
    y = filled(x)
    n = len(y)
    log = multiplicative and (y > 0).all()
    v = np.log(y) if log else y
    t = np.arange(n + horizon) / max(n - 1, 1)
    knots = np.linspace(0, 0.8, changes + 2)[1:-1] if n >= 4 * changes else np.array([])
    columns = [np.ones_like(t), t, *(np.clip(t - k, 0, None) for k in knots)]
    free = 2
    for period, order in ((7.0, 3), *(((365.25, 6),) if n > 365 else ())):
        w = 2 * np.pi * np.arange(n + horizon) / period
        columns += [f(k * w) for k in range(1, order + 1) for f in (np.sin, np.cos)]
    a = np.column_stack(columns)
    penalty = np.full(a.shape[1], ridge * n / 100)
    penalty[:free] = 0
    penalty[free : free + len(knots)] *= 10
    b = a[:n]
    coef = np.linalg.solve(b.T @ b + np.diag(penalty) + 1e-9 * np.eye(a.shape[1]), b.T @ v)
    whole = a @ coef
    whole = np.exp(whole) if log else whole
    return whole[n:], whole[:n]


METHODS: dict[str, Callable[[np.ndarray, int], tuple[np.ndarray, np.ndarray]]] = {
    "arima": lambda x, h: (lambda made, fitted: (made, filled(fitted)))(*arima(x, h)),
    "fourier_trend": fourier_trend,
    "holt_winters": lambda x, h: holt_winters(x, 7, h),
}


#: The same with seasons that grow with the level.
MULTIPLICATIVE = METHODS | {"fourier_trend": lambda x, h: fourier_trend(x, h, multiplicative=True)}


def hold_out_error(method: Callable, x: np.ndarray) -> float:
    """Root mean squared error on the last fifth (at least ten rows); infinite where it cannot be fitted."""
    k = max(10, len(x) // 5)
    if len(x) - k < 10:
        return float("inf")
    try:
        made = method(x[:-k], k)[0]
        e = float(np.sqrt(np.mean((made - x[-k:]) ** 2)))
    except (np.linalg.LinAlgError, ValueError, FloatingPointError):
        return float("inf")
    return e if np.isfinite(e) else float("inf")


def ensemble_weights(errors: Sequence[float]) -> np.ndarray:
    """Shares by inverse error: a perfect method takes all, failed ones nothing; all failed share alike."""
    e = np.asarray(errors, float)
    if not np.isfinite(e).any():
        return np.full(len(e), 1 / len(e))
    if (e == 0).any():
        return (e == 0) / (e == 0).sum()
    inverse = np.where(np.isfinite(e), 1 / e, 0.0)
    return inverse / inverse.sum()


def ensemble(x: np.ndarray, horizon: int, levels: Sequence[float] = (0.5, 0.8, 0.95), methods: dict | None = None) -> tuple[pd.DataFrame, dict[str, float]]:
    """Weighted forecast with intervals from the methods' spread and their residuals, growing with the root of the step."""
    x, methods = filled(x), methods or METHODS
    if len(x) < 30:
        raise ValueError("a forecast needs 30 rows")
    errors = {m: hold_out_error(f, x) for m, f in methods.items()}
    weights = dict(zip(methods, ensemble_weights(list(errors.values())), strict=True))
    runs = {m: f(x, horizon) for m, f in methods.items() if weights[m] > 0}
    made = np.array([runs[m][0] for m in runs])
    w = np.array([weights[m] for m in runs])
    w = w / w.sum()
    point = w @ made
    noise = sum(wi * np.std(x - runs[m][1]) ** 2 for wi, m in zip(w, runs, strict=True))
    spread = np.sqrt(w @ (made - point) ** 2 + noise) * np.sqrt(np.arange(1, horizon + 1)) ** 0.5
    out = {"step": np.arange(1, horizon + 1), "point": point}
    for level in levels:
        z = special.normal_quantile((1 + level) / 2)
        out |= {f"lo_{int(level * 100)}": point - z * spread, f"hi_{int(level * 100)}": point + z * spread}
    return pd.DataFrame(out), weights


def _grouped(df: DataFrame, by: Sequence[str], day: str, value: str, fn: Callable[[pd.DataFrame], pd.DataFrame], fields: str, least: int = 1) -> DataFrame:
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by).schema)
    names = [f.split()[0] for f in fields.split(", ")]

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__day").reset_index(drop=True)
        made = fn(pdf) if pdf["__v"].notna().sum() >= least else pd.DataFrame(columns=names)
        for i, (name, part) in enumerate(zip(by, key, strict=True)):
            made.insert(i, name, part)
        return made[[*by, *names]]

    rows = df.where(F.col(day).isNotNull()).select(*by, F.col(day).alias("__day"), F.col(value).cast("double").alias("__v"))
    return rows.groupBy(*by).applyInPandas(one, f"{keys}, {fields}")


def decompose(df: DataFrame, by: Sequence[str], day: str, value: str, period: int = 7, seasonal: int = 7) -> DataFrame:
    """by, day, trend, seasonal, residual by loess; series under two periods give no rows."""

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        t, s, r = stl(pdf["__v"].to_numpy(), period, seasonal)
        return pd.DataFrame({"day": pdf["__day"], "trend": t, "seasonal": s, "residual": r})

    return _grouped(df, by, day, value, fn, "day date, trend double, seasonal double, residual double", 2 * period)


def smooth_trend(df: DataFrame, by: Sequence[str], day: str, value: str) -> DataFrame:
    """by, day, trend by the Hodrick-Prescott filter."""
    return _grouped(df, by, day, value, lambda p: pd.DataFrame({"day": p["__day"], "trend": hp_trend(p["__v"].to_numpy())}), "day date, trend double")


def changepoints(df: DataFrame, by: Sequence[str], day: str, value: str, least: int = 30, alpha: float = 0.05, use_trend: bool = True) -> DataFrame:
    """Breaks that two of three methods agree on and that are significant: day, means, magnitude, direction, confidence, p."""

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        x = filled(pdf["__v"].to_numpy())
        base = stl(x, 7)[0] if use_trend and len(x) >= 14 else x
        named = consensus(breaks_by_method(base, least), 7, lambda at: describe_break(x, at)["confidence"])
        rows = [d | {"day": pdf["__day"].iloc[d["pos"]]} for d in (describe_break(x, at) for at in named) if d["p"] < alpha]
        return pd.DataFrame(rows, columns=["day", "pos", "pre_mean", "post_mean", "magnitude", "direction", "confidence", "p"])

    return _grouped(df, by, day, value, fn, "day date, pos bigint, pre_mean double, post_mean double, magnitude double, direction string, confidence double, p double", 2 * least)


def seasonality_tests(df: DataFrame, by: Sequence[str], day: str, value: str, period: int = 7) -> DataFrame:
    """Spectral, autocorrelation and partial autocorrelation tests of a detrended series: test, value, is_significant."""
    from .stats import partial_autocorrelation, spectral_peak

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        x = filled(pdf["__v"].to_numpy())
        half = period // 2
        d = x[half : len(x) - half] - _means(x, 2 * half + 1)
        peak, power = spectral_peak(d)
        c = d - d.mean()
        acf = float((c[:-period] * c[period:]).sum() / max((c * c).sum(), 1e-12))
        pacf, se = partial_autocorrelation(d, period), 1 / np.sqrt(len(d))
        return pd.DataFrame({"test": ["spectral", "acf", "pacf"], "value": [peak, acf, pacf], "is_significant": [bool(power > 3 and abs(peak - period) / period < 0.1), bool(abs(acf) > 1.96 * se), bool(abs(pacf) > 1.96 * se)]})

    return _grouped(df, by, day, value, fn, "test string, value double, is_significant boolean", 3 * period)


def forecasts(df: DataFrame, by: Sequence[str], day: str, value: str, horizon: int = 30, methods: dict | None = None) -> DataFrame:
    """by, day, step, point and 50, 80 and 95 % intervals of the weighted ensemble of ``methods`` (``METHODS``, ``MULTIPLICATIVE``)."""

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        out, _ = ensemble(pdf["__v"].to_numpy(), horizon, methods=methods)
        last = pd.Timestamp(pdf["__day"].iloc[-1])
        out["day"] = [(last + pd.Timedelta(days=int(s))).date() for s in out["step"]]
        return out

    return _grouped(df, by, day, value, fn, "day date, step bigint, point double, lo_50 double, hi_50 double, lo_80 double, hi_80 double, lo_95 double, hi_95 double", 30)


def method_errors(df: DataFrame, by: Sequence[str], day: str, value: str) -> DataFrame:
    """by, method, rmse (hold-out) and weight of each forecast method."""

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        x = filled(pdf["__v"].to_numpy())
        e = [hold_out_error(f, x) for f in METHODS.values()]
        return pd.DataFrame({"method": list(METHODS), "rmse": e, "weight": ensemble_weights(e)})

    return _grouped(df, by, day, value, fn, "method string, rmse double, weight double", 30)


def cross_validated(df: DataFrame, by: Sequence[str], day: str, value: str, splits: int = 5) -> DataFrame:
    """by, method, fold, rmse over growing training stretches; a fold that cannot be fitted is infinite."""

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        x = filled(pdf["__v"].to_numpy())
        k = len(x) // (splits + 1)
        rows = []
        for m, f in METHODS.items():
            for fold in range(1, splits + 1):
                train, test = x[: len(x) - (splits - fold + 1) * k], x[len(x) - (splits - fold + 1) * k : len(x) - (splits - fold) * k]
                try:
                    e = float(np.sqrt(np.mean((f(train, len(test))[0] - test) ** 2)))
                except (np.linalg.LinAlgError, ValueError):
                    e = float("inf")
                rows.append((m, fold, e))
        return pd.DataFrame(rows, columns=["method", "fold", "rmse"])

    return _grouped(df, by, day, value, fn, "method string, fold bigint, rmse double", 6 * (splits + 1))


def scenarios(forecast: DataFrame, factors: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Forecast rows times factor, with a weight, for each named scenario."""
    factors = factors or {"optimistic": (1.2, 0.25), "expected": (1.0, 0.5), "pessimistic": (0.8, 0.25)}
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("scenario"), F.lit(f).alias("factor"), F.lit(w).alias("weight")) for k, (f, w) in factors.items()))).alias("__s")
    return forecast.select("*", rows).select(*forecast.columns, "__s.*").withColumn("scenario_point", F.col("point") * F.col("factor"))
