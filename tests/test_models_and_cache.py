"""Series models, effects over them, exact probabilities, the cache and report texts on literals."""

import datetime as dt
import itertools
import time

import numpy as np
import pytest

from tidemark.operators import causal, models, report, stats
from tidemark.sources.cache import ResultCache
from tidemark.sources.written import dropped, scratch, written

DAY = dt.date(2024, 1, 1)


def test_arima_of_a_given_order_is_a_regression_on_lags():
    rng = np.random.default_rng(2)
    x = np.zeros(200)
    for t in range(1, 200):
        x[t] = 3 + 0.6 * x[t - 1] + rng.normal()
    made, fitted = models.arima(x, 3, (1, 0, 0))
    slope, level = np.polyfit(x[:-1], x[1:], 1)
    want = [x[-1]]
    for _ in range(3):
        want.append(level + slope * want[-1])
    assert made == pytest.approx(want[1:]) and fitted[1:] == pytest.approx(level + slope * x[:-1]) and np.isnan(fitted[0])


def test_arima_goes_on_with_lines_and_seasons_and_uses_shocks():
    assert models.arima(np.arange(60.0), 3)[0] == pytest.approx([60, 61, 62], abs=1e-6)
    rng = np.random.default_rng(1)
    e = rng.normal(size=3000)
    x = e.copy()
    x[1:] += 0.8 * e[:-1]
    made, fitted = models.arima(x, 2, (0, 0, 1))
    assert made[0] == pytest.approx(0.8 * e[-1], abs=0.2) and abs(made[1]) < 0.1
    assert np.nanstd(x - fitted) == pytest.approx(1.0, abs=0.05)
    own, inner = models.arima(x, 2)
    assert np.nanstd(x - inner) < 1.06 and np.isfinite(own).all()
    with pytest.raises(ValueError):
        models.arima(np.ones(3), 1)


def series(spark, values, name="a"):
    return spark.createDataFrame([(name, DAY + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)], "series string, day date, value double")


def test_event_baseline_of_a_step(spark):
    rng = np.random.default_rng(4)
    values = 50 + rng.normal(size=130)
    values[100:] += 20
    event = str(DAY + dt.timedelta(days=100))
    for method in ("arima", "fourier_trend"):
        gaps = causal.baseline_gaps(series(spark, values), ["series"], "day", "value", event, method=method)
        assert gaps.count() == 30
        r = causal.abnormal_sum(gaps, ["series"]).first()
        assert r.n == 30 and 450 < r.car < 750 and r.outside > 0.8
    assert causal.baseline_gaps(series(spark, values[60:]), ["series"], "day", "value", event, post=5).count() == 0


def test_campaign_evaluation(spark):
    rng = np.random.default_rng(5)
    shape = 100 + 10 * np.sin(np.arange(180) / 9)
    lifted = shape + rng.normal(size=180)
    lifted[90:] += 30
    rows = series(spark, lifted, "t")
    for i in range(3):
        rows = rows.unionByName(series(spark, shape * (1 + i / 10) + rng.normal(size=180), f"d{i}"))
    event = str(DAY + dt.timedelta(days=90))
    out = {r.series: r for r in causal.evaluate_campaign(rows, ["series"], "day", "value", event, draws=200, treated="t").collect()}
    assert set(out) == {"t", "d0", "d1", "d2"}
    assert out["t"].permutation_p == 0 and set(out["t"].windows) == {"immediate", "short", "long"} and out["t"].synthetic_effect == pytest.approx(30, abs=3)
    assert out["d0"].synthetic_effect is None


@pytest.mark.parametrize(("a", "b"), [([1, 2, 3], [4, 5, 6, 7]), ([1, 5, 9, 11], [2, 3, 10]), ([2.5], [1, 2, 3, 4, 5])])
def test_exact_rank_test(spark, a, b):
    rows = spark.createDataFrame([("a", float(v)) for v in a] + [("b", float(v)) for v in b], "g string, v double")
    r = stats.mann_whitney(rows, "g", "a", "b", "v").first()
    u_of = lambda some, rest: sum(x > y for x in some for y in rest)
    every = [u_of(c, set(a + b) - set(c)) for c in itertools.combinations(a + b, len(a))]
    u = u_of(a, b)
    assert r.u == u
    assert r.p == pytest.approx(min(1, 2 * min(sum(x <= u for x in every), sum(x >= u for x in every)) / len(every)))


def test_shapiro_wilk():
    # Weights of eleven men, the published example of the test: W 0.79.
    w, p = stats.shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236.0]))
    assert w == pytest.approx(0.7888, abs=1e-3) and p == pytest.approx(0.0067, abs=5e-4)
    rng = np.random.default_rng(1)
    normal = [stats.shapiro_wilk(rng.normal(size=n))[1] for n in (4, 8, 20, 200) for _ in range(200)]
    assert 0.02 < np.mean(np.array(normal) < 0.05) < 0.09
    assert np.mean([stats.shapiro_wilk(rng.exponential(size=100))[1] < 0.05 for _ in range(50)]) > 0.95
    assert stats.shapiro_wilk(np.ones(5)) == (1.0, 1.0) and stats.shapiro_wilk(np.array([1, 2, 3.0]))[0] == pytest.approx(1)


def test_sample_normality_of_groups(spark):
    rows = spark.createDataFrame([("a", float(v)) for v in range(50)] + [("b", 1.0), ("b", None)] + [("c", float(2**v)) for v in range(12)], "g string, v double")
    out = {r.g: r for r in stats.sample_normality(rows, ["g"], "v").collect()}
    assert (out["a"].n, out["b"].n, out["c"].n) == (50, 1, 12)
    assert out["b"].p is None and out["c"].p < 0.01 and out["a"].p > 0.01


def test_median_difference(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 6.0), ("b", 4.0), ("c", 9.0)], "g string, v double")
    r = stats.median_difference(rows, "g", "a", "b", "v").first()
    assert r.difference == -2 and r.hi - r.difference == pytest.approx(1.96 * (4 / 3) ** 0.5 * np.std([1, 2, 6, 4]))


def test_cache_reads_through_and_expires(spark, tmp_path):
    cache, calls = ResultCache(spark, str(tmp_path), seconds=60), []

    def make():
        calls.append(1)
        return spark.range(len(calls))

    assert cache.get("k") is None
    assert cache.get("k", make).count() == 1 and cache.get("k", make).count() == 1 and len(calls) == 1
    assert cache.get("other", make).count() == 2
    cache.set("k", spark.range(7), seconds=120)
    assert cache.get("k", make).count() == 7
    cache.set("short", spark.range(3), seconds=0.0)
    time.sleep(0.01)
    assert cache.get("short") is None and cache.purge() == 1
    cache.forget("k")
    assert cache.get("k") is None
    unwritable = ResultCache(spark, "/proc/none")
    assert unwritable.get("k", make).count() == 3


def test_written_tables_are_dropped(spark):
    df = written(spark.range(3))
    assert df.count() == 3
    dropped(df, None, spark.range(1))
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(df._tidemark_path).count()
    assert scratch(spark, "x") != scratch(spark, "x")


def test_investments_and_report_texts(spark):
    rows = [(f"c{i}", "s", v) for i, v in enumerate([1.0, 4.0, 5.0, 6.0])] + [("z", "null", 0.0)]
    out = {r.company_id: r for r in report.investments(spark.createDataFrame(rows, "company_id string, sector string, score double")).collect()}
    assert set(out) == {"z"} and (out["z"].gap, out["z"].confidence, out["z"].percent, out["z"].talent_percent) == (0, 0.5, 0, 0)
    r = report.investments(spark.createDataFrame(rows[:4], "company_id string, sector string, score double")).first()
    assert (r.company_id, r.gap, r.confidence, r.percent, r.talent_percent) == ("c0", 3.0, 0.75, 75.0, 37.5)
    small = spark.createDataFrame([("a<b", None, [1, 2])], "x string, y int, z array<int>")
    assert [r.line for r in report.as_text(small).collect()] == ["x: a<b", "y: ", "z: [1,2]"]
    assert [r.line for r in report.as_text(small, "html").collect()] == ["<tr><th>x</th><th>y</th><th>z</th></tr>", "<tr><td>a&lt;b</td><td></td><td>[1,2]</td></tr>"]
    with pytest.raises(ValueError):
        report.as_text(small, "pdf")
