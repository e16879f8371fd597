"""Functions without a query of their own: literals, invariants, and round trips."""

import datetime as dt
import json
import random
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import html, special
from tidemark.functions import metrics as m
from tidemark.operators import causal, etl, graph, joins, learn, models, monitoring, query_text, ranking, series, stats
from tidemark.sources import landed, sinks, written
from tidemark.streaming import jobs


def value(spark, expression):
    return spark.range(1).select(expression.alias("v")).first().v


def close(a, b, e=1e-6):
    return a is not None and abs(a - b) <= e * max(1, abs(b))


# Distributions and scalars


def test_distribution_functions():
    assert close(float(special.t_two_sided(2.228138852, 10)), 0.05) and close(float(special.f_upper(4.102821, 2, 10)), 0.05)
    assert close(float(special.chi2_upper(5.991464547, 2)), 0.05) and close(float(special.normal_cdf(1.959963985)), 0.975)
    assert close(float(special.t_quantile(0.975, 10)), 2.228138852) and close(float(special.beta_inc(2, 3, 0.4)), 0.5248)
    assert close(float(special.gamma_inc(3, 2)), 1 - math.exp(-2) * (1 + 2 + 2)) and close(float(special.beta_quantile(0.5, 2, 2)), 0.5)


@pytest.mark.parametrize(("args", "want"), [((800, 400, 250), 0.806667), ((300, 150, 100), 0.306667), ((50, 20, 10), 0.043667), ((-800, -400, -250), 0.806667)])
def test_hype(spark, args, want):
    assert close(value(spark, m.hype_score(*map(F.lit, args))), want)


@pytest.mark.parametrize(("args", "risk", "level"), [((50, 40, 80), 0.55, "medium"), ((20, 20, 40), 0.26, "low"), ((2, 5, 10), 0.056, "low"), ((500, 90, 90), 0.93, "high")])
def test_reputation(spark, args, risk, level):
    r = m.reputation_risk(*map(F.lit, args))
    assert close(value(spark, r), risk) and value(spark, m.level(r, 0.7, 0.4)) == level


@pytest.mark.parametrize(("v", "b", "want"), [(31, 10, True), (30, 10, True), (29, 10, False), (1, 0, True), (0, 0, False)])
def test_edit_spike(spark, v, b, want):
    assert value(spark, m.is_edit_spike(F.lit(v), F.lit(b))) is want


def test_scalars(spark):
    assert value(spark, m.hype_score(F.lit(None).cast("double"), F.lit(1), F.lit(1))) is None and value(spark, m.reputation_risk(F.lit(None).cast("double"), F.lit(1), F.lit(1))) is None
    assert value(spark, m.percentage_change(F.lit(100.0), F.lit(110.0))) == pytest.approx(10)
    assert value(spark, m.percentage_change(F.lit(0.0), F.lit(5.0))) == math.inf and value(spark, m.percentage_change(F.lit(0.0), F.lit(0.0))) == 0
    assert value(spark, m.metric_key(F.lit("n"), F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1")))) == "n|a=1|b=2"
    assert value(spark, m.api_timestamp(F.lit("2024010203"))) == dt.datetime(2024, 1, 2, 3) and value(spark, m.api_timestamp(F.lit("2024"))) is None
    assert value(spark, m.classify_editor(F.lit("999.1.1.1"))) == "anonymous" and value(spark, m.classify_editor(F.lit("Ann"))) == "registered"
    assert value(spark, m.significance_stars(F.lit(0.004))) == "**" and value(spark, m.effect_magnitude(F.lit(-0.6))) == "medium"
    assert value(spark, m.throughput(F.lit(10), F.lit(0))) == 0 and value(spark, m.evidence_strength(F.lit(None).cast("double"), F.lit(None).cast("double"))) == 0
    with pytest.raises(Exception, match="positive"):
        value(spark, m.innovation_score(F.lit(1), F.lit(1), F.lit(0)))
    assert [r.date for r in value(spark, monitoring.dated_names(F.lit("2024-01-05:a:b, bad:c,2024-02-01:d"), ("name", "kind")))] == [dt.date(2024, 1, 5), dt.date(2024, 2, 1)]


# Ranking and joins


def test_deciles_of_four(spark):
    df = spark.createDataFrame([(i, float(i)) for i in (1, 2, 3, 4)], "id int, v double")
    r = ranking.global_rank(df, "v", ["id"], "r")
    got = sorted(tuple(x) for x in r.select("id", ranking.decile_by_count(F.col("r"), F.col("n")), ranking.decile_by_percentile(F.col("r"), F.col("n"))).collect())
    assert got == [(1, 1, 1), (2, 3, 4), (3, 6, 7), (4, 8, 10)]


@pytest.mark.parametrize("most", [40, 10_000])
@pytest.mark.parametrize("descending", [False, True])
def test_global_rank_is_a_rank(spark, descending, most):
    rows = [(i, 7 if i % 3 == 0 else (i * 7919) % 50) for i in range(500)] + [(900, None)]
    got = {r.id: (r.r, r.n) for r in ranking.global_rank(spark.createDataFrame(rows, "id int, v int"), "v", ["id"], "r", descending, most=most).collect()}
    line = sorted((x for x in rows if x[1] is not None), key=lambda x: (-x[1] if descending else x[1], x[0]))
    assert got == {x[0]: (k + 1, 500) for k, x in enumerate(line)}
    assert ranking.global_rank(spark.createDataFrame([], "id int, v int"), "v", ["id"]).collect() == []


def test_min_max_of_a_constant_and_of_nothing(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, None)], "id int, v double")
    assert {r.id: r.normalized for r in ranking.min_max(df, "v").collect()} == {1: 0.0, 2: 0.0, 3: None}


def test_sector_comparison(spark):
    df = spark.createDataFrame([("C1", "Technology", 8.0, 7.0), ("C2", "Technology", 6.0, 5.0), ("C3", "Finance", 4.0, 3.0), ("C4", "Finance", 2.0, 1.0)], "id string, sector string, a double, b double")
    pairs = {(r.sector, r.against): r.percent for r in joins.pairwise_percent(df.groupBy("sector").agg(F.avg("a").alias("v")), "sector", "v").collect()}
    assert pairs["Finance", "Technology"] == pytest.approx(-57.142857) and pairs["Technology", "Finance"] == pytest.approx(133.333333)
    gaps = joins.upper_pairs(spark.createDataFrame([(0, 0.9), (1, 0.1), (2, 0.5)], "c int, d double"), "c", "d").collect()
    assert {(g.a, g.b): (round(g.gap, 6), g.is_significant) for g in gaps} == {(0, 1): (0.8, True), (0, 2): (0.4, False), (1, 2): (0.4, False)}


def test_near_days_find_all_pairs(spark):
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    a, b = [0, 3, 7, 20, 21], [1, 4, 10, 24, 40]
    df = lambda x: spark.createDataFrame([(day(n),) for n in x + [x[0]]] + [(None,)], "d date")
    got = {(r.left_day, r.right_day) for r in joins.near_days(df(a), df(b), "d", 3).collect()}
    assert got == {(day(x), day(y)) for x in a for y in b if abs(x - y) <= 3}
    matched = {(r.left_day, r.right_day) for r in joins.match_within(df(a), df(b), "d", 3).collect()}
    assert matched == {(day(0), day(1)), (day(3), day(4)), (day(7), day(4)), (day(20), None), (day(21), day(24)), (None, day(40))}


def test_upsert_and_first_seen(spark):
    current = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    batch = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1), (None, "m", 1)], "k int, v string, s int")
    once = etl.upsert(current, batch, ["k"], "s")
    assert sorted(map(tuple, once.collect()), key=str) == sorted([(1, "a"), (2, "y"), (3, "z"), (None, "m")], key=str)
    assert sorted(map(tuple, etl.upsert(once, batch, ["k"], "s").collect()), key=str) == sorted(map(tuple, once.collect()), key=str)
    first = etl.keep_first(batch, ["k"], ["s"])
    assert {(r.k, r.v) for r in first.collect()} == {(2, "x"), (3, "z"), (None, "m")}
    assert etl.keep_first(first, ["k"], ["s"]).count() == 3


def test_valid_and_quarantined_rows_add_up(spark):
    df = spark.createDataFrame([("a", 1, 1, 2, "desktop"), ("", 1, 1, 2, "desktop"), ("a", -1, 1, 0, "desktop"), ("a", 1, 1, 3, "desktop"), ("a", 1, 1, 2, "tv"), ("a", None, 1, 2, "desktop")], "article string, views_human long, views_bot long, views_total long, device_type string")
    good, bad = etl.split_valid(df, etl.pageview_rules())
    assert good.count() == 1 and sorted(r.reason for r in bad.collect()) == ["empty article", "negative count", "negative count", "total mismatch", "unknown device"]
    assert etl.schema_matches(df, {"article": "str", "views_bot": "int"}) and not etl.schema_matches(df, {"article": "int"})


# Statistics


def test_intervals_and_ratios(spark):
    w = value(spark, stats.wilson(F.lit(50), F.lit(100)))
    assert close(w.lo, 0.403832) and close(w.hi, 0.596168)
    args = [F.lit(x) for x in (20, 100, 10, 100)]
    assert value(spark, stats.relative_risk(*args)).value == pytest.approx(2) and value(spark, stats.odds_ratio(*args)).value == pytest.approx(2.25)
    e = value(spark, stats.exact_proportion(F.lit(5), F.lit(10)))
    assert close(e.lo, 0.187086, 1e-5) and close(e.hi, 0.812914, 1e-5)
    assert value(spark, stats.wilson(F.lit(0), F.lit(0))).lo is None


def test_tests_on_shifted_samples(spark):
    rng = np.random.RandomState(42)
    rows = [("a", float(x)) for x in rng.normal(10, 2, 100)] + [("b", float(x)) for x in rng.normal(12, 2, 100)]
    df = spark.createDataFrame(rows, "g string, v double")
    t = stats.t_test(stats.two_samples(df, "g", "a", "b", "v")).first()
    assert t.p < 0.001 and t.effect < 0
    assert stats.mann_whitney(df, "g", "a", "b", "v").first().p < 0.001 and stats.kruskal_wallis(df, "g", "v").first().p < 0.001
    assert stats.anova(stats.moments(df, ["g"], "v")).first().statistic == pytest.approx(t.statistic**2)
    same = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0), ("b", 1.0)], "g string, v double")
    assert stats.t_test(stats.two_samples(same, "g", "a", "b", "v")).first().p == 1
    keyed = df.withColumn("k", F.lit("x"))
    assert stats.permutation_test(keyed, ["k"], "g", "a", "b", "v", 500).first().p < 0.01
    boot = stats.resampled(keyed, ["k", "g"], "v", "mean", 500).collect()
    assert all(r.lo < r.estimate < r.hi for r in boot) and boot == stats.resampled(keyed, ["k", "g"], "v", "mean", 500).collect()


def test_correlation_edges(spark):
    df = spark.createDataFrame([("c", 1.0, 5.0), ("c", 2.0, 5.0), ("c", 3.0, 5.0), ("p", 1.0, 2.0), ("p", 2.0, 4.0), ("p", 3.0, 6.0), ("p", 4.0, 8.0), ("s", 1.0, 1.0)], "k string, x double, y double")
    got = {r.k: (r.r, r.p) for r in stats.correlation(df, "x", "y", ["k"]).collect()}
    assert got["c"] == (0.0, 1.0) and got["p"][0] == pytest.approx(1) and got["p"][1] < 1e-6 and got["s"][0] is None


# Series models


def test_decomposition_and_changes():
    rng = np.random.RandomState(0)
    t = np.arange(200)
    wave = 50 * np.sin(2 * np.pi * t / 7)
    x = 1000 + 0.5 * t + wave + rng.normal(0, 5, 200) + 200 * (t >= 100)
    trend, season, rest = models.stl(x, 7)
    assert np.allclose(trend + season + rest, x) and np.corrcoef(season, wave)[0, 1] > 0.98
    assert models.optimal_partition(models.l2_cost(x - wave), 200, 20_000, 30) == [100]
    assert models.binary_segmentation(models.l2_cost(x - wave), 200, 1) == [100]
    assert models.consensus({"a": [50, 100], "b": [103], "c": [160]}) == [100]
    second = np.diff(np.eye(60), 2, axis=0)
    assert np.allclose(models.hp_trend(x[:60]), np.linalg.solve(np.eye(60) + 1600 * second.T @ second, x[:60]))
    made, weights = models.ensemble(x[100:], 14)
    assert len(made) == 14 and sum(weights.values()) == pytest.approx(1) and (made.lo_95 <= made.lo_50).all() and (made.lo_50 <= made.point).all() and (made.point <= made.hi_80).all()
    assert np.abs(made.point - (1200 + 0.5 * np.arange(200, 214) + 50 * np.sin(2 * np.pi * np.arange(200, 214) / 7))).mean() < 25
    assert models.ensemble_weights([np.inf, np.inf]).tolist() == [0.5, 0.5] and models.ensemble_weights([1, np.inf, 1]).tolist() == [0.5, 0, 0.5]


def test_short_and_missing_series(spark):
    df = spark.createDataFrame([("a", dt.date(2024, 1, 1), 1.0), ("a", dt.date(2024, 1, 2), None), ("b", None, 3.0)], "series string, day date, value double")
    assert models.decompose(df, ["series"], "day", "value").collect() == [] and models.changepoints(df, ["series"], "day", "value").collect() == []
    assert models.smooth_trend(df, ["series"], "day", "value").count() == 2


def test_structural_shifts_are_daily(spark, monkeypatch):
    from tidemark.plans import models as plans

    noise = np.random.default_rng(3).normal(0, 1, 400)
    rows = [("a", dt.date(2024, 1, 1) + dt.timedelta(days=i), 100.0 + 40 * (i >= 300) + float(noise[i])) for i in range(400)]
    daily = spark.createDataFrame(rows, "series string, day date, value double")
    monkeypatch.setattr(plans, "daily_orders", lambda spark, d: daily)
    found = plans.structural_shifts(spark, "").collect()
    # The trend smooths the step; methods agree within seven days.
    assert [abs(r.pos - 300) <= 7 and r.direction == "increase" for r in found] == [True]


def test_spike_literals(spark):
    v = [100, 110, 105, 115, 120, 500, 520, 510, 125, 130, 135, 140, 145, 150, 155, 160, 165, 170, 175, 180]
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i)
    df = spark.createDataFrame([("s", day(i), x) for i, x in enumerate(v)] + [("ramp", day(i), 100 + i) for i in range(20)], "s string, day date, v int")
    got = series.rolling_spikes(df, ["s"], "day", "v").collect()
    assert [(r.s, r["first"], r.days) for r in got] == [("s", day(5), 1)]


# Causal effects


def test_synthetic_control_recovers_a_step(spark):
    rng = np.random.RandomState(1)
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i)
    base = {u: 100 + np.cumsum(rng.normal(0, 1, 120)) for u in "abcd"}
    base["t"] = 0.6 * base["a"] + 0.4 * base["b"] + rng.normal(0, 0.1, 120) + 15 * (np.arange(120) >= 80)
    df = spark.createDataFrame([(u, day(i), float(x)) for u, line in base.items() for i, x in enumerate(line)], "u string, day date, v double")
    r = {x.u: x for x in causal.synthetic_control(df, "u", "t", "day", "v", str(day(80)), least_fit=-100).collect()}["t"]
    assert r.effect == pytest.approx(15, abs=0.5) and r.weights["a"] == pytest.approx(0.6, abs=0.05) and r.p == pytest.approx(0.2)
    d = causal.difference_in_differences(df, "u", "t", "c", "day", "v", str(day(80))).first()
    assert d.se > 0
    g = causal.gap_test(causal.interrupted_series(df.where("u = 't'"), ["u"], "day", "v", str(day(80))), ["u"]).first()
    assert g.n == 40


def test_simplex():
    assert np.allclose(causal.simplex_projection(np.array([0.2, 0.3, 0.5])), [0.2, 0.3, 0.5]) and np.allclose(causal.simplex_projection(np.array([5.0, 0.0])), [1, 0])


# Graphs


def edges(spark, pairs, kind="string"):
    return spark.createDataFrame(pairs, f"src {kind}, dst {kind}")


def nodes(spark, ids, kind="string"):
    return spark.createDataFrame([(i,) for i in ids], f"id {kind}")


def test_pagerank_sums_to_one_and_ranks_a_sink(spark):
    e = edges(spark, [("a", "c"), ("b", "c"), ("c", "a"), ("d", "c"), ("d", "c")])
    r = {x.id: x.rank for x in graph.pagerank(nodes(spark, "abcde"), e).collect()}
    assert sum(r.values()) == pytest.approx(1, abs=1e-3) and max(r, key=r.get) == "c"
    assert graph.pagerank(nodes(spark, []), e).collect() == []


def test_betweenness_of_a_path_and_a_star(spark):
    path = {r.id: r.centrality for r in graph.betweenness(nodes(spark, "abcdz"), edges(spark, [("a", "b"), ("b", "c"), ("c", "d")])).collect()}
    assert path["b"] == pytest.approx(4 / 12) and path["a"] == 0 and path["z"] == 0
    star = {r.id: r.centrality for r in graph.betweenness(nodes(spark, "abcd"), edges(spark, [("a", "b"), ("a", "c"), ("a", "d"), ("b", "a")])).collect()}
    assert star["a"] == pytest.approx(1)


@pytest.mark.parametrize("directed", [False, True])
def test_betweenness_as_by_hand(spark, directed):
    rng = random.Random(5)
    ids = list(range(12))
    pairs = [(a, b) for a in ids for b in ids if a != b and rng.random() < 0.2]
    links = {(a, b) for a, b in pairs} | (set() if directed else {(b, a) for a, b in pairs})
    far = {(a, b): 0 if a == b else 1 if (a, b) in links else 99 for a in ids for b in ids}
    for k in ids:
        for a in ids:
            for b in ids:
                far[a, b] = min(far[a, b], far[a, k] + far[k, b])

    def paths(a, b):
        return 1 if a == b else sum(paths(a, k) for k in ids if (k, b) in links and far[a, k] + 1 == far[a, b])

    want = {v: sum(paths(a, v) * paths(v, b) / paths(a, b) for a in ids for b in ids if len({a, b, v}) == 3 and far[a, b] < 99 and far[a, v] + far[v, b] == far[a, b]) / 110 for v in ids}
    got = {r.id: r.centrality for r in graph.betweenness(spark.createDataFrame([(i,) for i in ids], "id int"), spark.createDataFrame(pairs, "src int, dst int"), directed).collect()}
    assert got == pytest.approx(want)


def test_communities_of_two_cliques(spark):
    pairs = [(a, b) for g in ("abcd", "wxyz") for a in g for b in g if a < b] + [("d", "w")]
    for found in (graph.modularity_communities(nodes(spark, "abcdwxyzq"), edges(spark, pairs)), graph.label_communities(nodes(spark, "abcdwxyzq"), edges(spark, pairs))):
        c = {r.id: r.community for r in found.collect()}
        assert len({c[x] for x in "abcd"}) == 1 and len({c[x] for x in "wxyz"}) == 1 and c["a"] != c["z"] and sorted(set(c.values())) == [0, 1, 2]


def test_densities(spark):
    c = spark.createDataFrame([(x, 0) for x in "ABCD"] + [("Z", 1)], "id string, community int")
    got = {r.community: r.density for r in graph.community_density(c, edges(spark, [("A", "B"), ("B", "A"), ("C", "D"), ("D", "C"), ("A", "Q")])).collect()}
    assert got == {0: pytest.approx(2 / 6), 1: 0.0}


def test_crawl_resumes(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("a", None)])
    seeds = nodes(spark, "a")
    one = graph.crawl(seeds, e, depth=1, most=None)
    assert {(r.id, r.depth) for r in one.collect()} == {("a", 0), ("b", 1)}
    assert {(r.id, r.depth) for r in graph.crawl(seeds, e, depth=2, most=None, visited=one).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert graph.crawl(seeds, e, depth=3, most=2).count() == 2


def test_components(spark):
    c = {r.id: r.component for r in graph.connected_components(nodes(spark, range(12), "int"), edges(spark, [(i, i + 1) for i in range(8)] + [(10, 11)], "int")).collect()}
    assert all(c[i] == 0 for i in range(9)) and c[9] == 9 and c[10] == c[11] == 10


# Text, files, streams

PAGE = """<html><h1 class="firstHeading">Old <i>Mill</i></h1><table class="infobox"><tr><th>Built</th><td>1901<br>late</td></tr><tr><th>Built</th><td>1902</td></tr></table>
<p>Short.</p><p>A paragraph that is certainly longer than fifty characters in all.</p><table class="wikitable"><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>
<a href="/wiki/Dam">x</a><a href="/wiki/Dam">x</a><a href="/wiki/File:X">f</a><a href="/wiki/Dam#top">t</a><a href="/wiki/Category:Mills">Mills</a>"""


def test_html(spark):
    df = spark.createDataFrame([(PAGE, "u"), (None, "https://x/wiki/Tide_gauge"), ("<p>open", "u")], "h string, u string")
    a, b, c = df.select(html.title(F.col("h"), F.col("u")).alias("t"), html.infobox("h").alias("i"), html.tables("h").alias("w"), html.internal_links("h").alias("l"), html.categories("h").alias("c"), html.summary("h").alias("s")).collect()
    assert (a.t, a.i, a.w, a.l, a.c) == ("Old Mill", {"Built": "1902"}, [[["a", "b"], ["1", "2"]]], ["/wiki/Dam"], ["Mills"]) and a.s.startswith("A paragraph")
    assert (b.t, b.i, b.l) == ("Tide gauge", {}, []) and c.s == ""
    assert value(spark, html.next_link(F.lit('<https://x?page=2>; rel="next", <https://x?page=9>; rel="last"'))) == "https://x?page=2"


def test_landed_responses(spark):
    item = {"project": "p", "article": "A", "granularity": "daily", "timestamp": "2024010100", "views": 5}
    rows = [(json.dumps({"items": [item, item | {"timestamp": "x"}]}), "desktop"), (json.dumps({"items": [{"article": "A"}]}), "desktop"), ("nonsense", "desktop"), (None, "desktop")]
    good, bad = landed.pageviews(spark.createDataFrame(rows, "body string, device_type string"))
    assert [(r.article, r.views, r.timestamp) for r in good.collect()] == [("A", 5, dt.datetime(2024, 1, 1))]
    assert sorted(r.reason for r in bad.collect()) == ["missing field", "no items", "no items"]
    top = spark.createDataFrame([(json.dumps({"items": [{"articles": [{"article": x, "views": 9} for x in "abc"]}]}),)], "body string")
    assert [(r.article, r["rank"]) for r in landed.top_articles(top, limit=2).collect()] == [("a", 1), ("b", 2)]
    counts = spark.createDataFrame([(json.dumps({"items": [{"results": [{"timestamp": "2024-01-01T00:00:00Z", "editors": 7}]}]}),)], "body string")
    assert [tuple(r) for r in landed.counts(counts, "editors").collect()] == [(dt.date(2024, 1, 1), 7)]
    assert [r.message for r in landed.response_problems(spark.createDataFrame([('{"items": []}',)], "body string")).collect()] == ["empty items"]


def test_paged_source(spark, tmp_path):
    for name, items, following in (("a1.json", [1, 2], "a2.json"), ("a2.json", [3], None), ("b1.json", [], None)):
        (tmp_path / name).write_text(json.dumps({"items": items, "next": following}))
    assert sorted((r.start, r.page, r.item) for r in landed.paged(spark, str(tmp_path)).collect()) == [("a1.json", 0, "1"), ("a1.json", 0, "2"), ("a1.json", 1, "3")]


def test_series_names_and_external_csv(spark, tmp_path):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), 5)], "Date date, Views int")
    assert landed.series_from(df, "pageviews").first().asDict() == {"date": dt.date(2024, 1, 1), "value": 5.0, "platform": "all", "metric_type": "pageviews"}
    (tmp_path / "x.csv").write_text("date,rain\n2024-01-01,3\n")
    base = landed.series_from(df, "pageviews")
    assert landed.with_external(base, str(tmp_path / "x.csv"), "date date, rain int").first().rain == 3
    assert landed.with_external(base, str(tmp_path / "none.csv"), "date date, rain int").columns == base.columns
    assert landed.synthetic_companies(spark).count() == 150 and landed.synthetic_traffic(spark, 10).count() == 30


def test_versions(spark, tmp_path):
    base = str(tmp_path / "r")
    one, two = spark.createDataFrame([(1, None), (2, "b")], "a int, b string"), spark.createDataFrame([(1, None), (2, "c"), (2, "c")], "a int, b string")
    sinks.save_version(one, base, "v1")
    sinks.save_version(two, base, "v2")
    assert [r.version for r in sinks.versions(spark, base).collect()] == ["v2", "v1"]
    assert sinks.load_version(spark, base).count() == 3 and sinks.load_version(spark, base, "v1").count() == 2
    c = sinks.compare_versions(spark, base, "v1", "v2").first()
    assert (c.same, c.rows_more, c.only_a, c.only_b) == (False, 1, 1, 2)
    one.limit(1).write.mode("append").parquet(f"{base}/data/version=v1")
    with pytest.raises(sinks.IntegrityError):
        sinks.load_version(spark, base, "v1")


def test_exports(spark):
    df = spark.createDataFrame([("c", "m", 1.0), ("c", "n", None), ("d", "n", 2.0)], "id string, metric string, v double")
    assert [tuple(r) for r in sinks.export_wide(df, "id", "metric", "v", ["n", "m"]).collect()] == [("c", 1.0, None), ("d", None, 2.0)]
    assert json.loads(sinks.export_json(df, "id", "metric", "v").where("id = 'c'").first().json) == {"id": "c", "metrics": {"m": 1.0}}


def test_ingest_is_the_same_after_a_second_run(spark, tmp_path):
    schema = "article string, timestamp timestamp_ntz, device_type string, views_human long, views_bot long, views_total long, fetched_at timestamp_ntz"
    t = dt.datetime(2024, 1, 1)
    rows = [("a", t, "desktop", 1, 1, 2, t), ("a", t, "desktop", 2, 1, 3, t + dt.timedelta(hours=1)), ("a", t, "tv", 1, 1, 2, t)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        jobs.ingest(jobs.files(spark, str(tmp_path / "in"), schema), etl.pageview_rules(), ["article"], "fetched_at", str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    now = jobs.current(spark, str(tmp_path / "out"), ["article", "timestamp", "device_type"], "fetched_at").collect()
    assert [(r.article, r.views_total) for r in now] == [("a", 3)] and spark.read.parquet(str(tmp_path / "out/quarantine")).count() == 1


def test_circuit(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [("s", t + dt.timedelta(seconds=i), True) for i in range(5)] + [("s", t + dt.timedelta(seconds=100 + i), False) for i in range(2)]
    spark.createDataFrame(rows, "service string, at timestamp, failed boolean").write.parquet(str(tmp_path / "in"))
    states = jobs.circuit_states(jobs.files(spark, str(tmp_path / "in"), "service string, at timestamp, failed boolean"), "service", "at", "failed")
    out = jobs.run_to_end(states, checkpoint=str(tmp_path / "state"))
    assert [r.state for r in out.orderBy("at").collect()] == ["closed"] * 4 + ["open", "half_open", "closed"]


def test_circuit_takes_events_in_order_of_time(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [("s", t + dt.timedelta(seconds=i), i < 5) for i in range(9)]
    spark.createDataFrame(rows[::-1], "service string, at timestamp, failed boolean").repartition(3).write.parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        states = jobs.circuit_states(jobs.files(spark, str(tmp_path / "in"), "service string, at timestamp, failed boolean"), "service", "at", "failed")
        got = [r.state for r in jobs.run_to_end(states).orderBy("at").collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == ["closed"] * 4 + ["open"] * 5


def test_streams_without_files_and_complete_results(spark, tmp_path):
    schema = "k string, ts timestamp, v double"
    (tmp_path / "none").mkdir()
    assert jobs.run_to_end(jobs.files(spark, str(tmp_path / "none"), schema)).collect() == []
    for part in range(3):
        spark.createDataFrame([("a", dt.datetime(2024, 1, 1, part), 1.0)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    counts = jobs.windowed_counts(jobs.files(spark, str(tmp_path / "in"), schema, per_trigger=1), "ts", ["k"], "v")
    assert [(r.k, r.n, r.total) for r in jobs.run_to_end(counts, "complete").collect()] == [("a", 3, 3.0)]


READS = ["SELECT 1", "WITH a AS (SELECT 1 x) SELECT * FROM a WHERE x IN (SELECT 2)", "FROM a SELECT x", "SHOW TABLES", "DESCRIBE t", "EXPLAIN SELECT 1", "VALUES (1)", "SELECT (SELECT max(x) FROM b) FROM a"]
REFUSED = [
    "", "DROP TABLE x", "SELECT (1", "SELECT 1; SELECT 2", "WITH a AS (SELECT 1 x) INSERT INTO t SELECT * FROM a", "FROM a INSERT INTO t SELECT x", "FROM a INSERT INTO t SELECT x INSERT INTO u SELECT x", "INSERT OVERWRITE DIRECTORY '/tmp/x' SELECT 1",
    "CREATE TABLE t AS SELECT 1", "SET x=1", "CACHE TABLE t", "DELETE FROM t", "MERGE INTO a USING b ON a.x=b.x WHEN MATCHED THEN DELETE", "SELECT TRANSFORM(a) USING 'sh' FROM t", "SELECT reflect('java.lang.System', 'exit', 0)", "CALL x.y()", "BEGIN SELECT 1; END",
]


def test_query_text(spark):
    rows, audit = query_text.run(spark, "SELECT 1 AS x")
    assert rows[0].x == 1 and audit["status"] == "ok" and not audit["has_more"]
    rows, audit = query_text.run(spark, "SELECT id FROM range(5)", most=2)
    assert len(rows) == 2 and audit["has_more"]


@pytest.mark.parametrize("text", READS)
def test_texts_that_read(spark, text):
    query_text.check(spark, text)


@pytest.mark.parametrize("text", REFUSED)
def test_texts_that_do_not(spark, text):
    with pytest.raises(query_text.QueryTextError):
        query_text.check(spark, text)


def test_monitoring(spark):
    reports = spark.createDataFrame([(True, 1.0, ["a"], ["x"]), (False, 0.5, ["b", "a"], [])], "is_valid boolean, score double, missing array<string>, advice array<string>")
    r = monitoring.combined_reports(reports).first()
    assert (r.is_valid, r.score, r.missing, r.advice) == (False, 0.75, ["a", "b"], ["x"])
    assert monitoring.worst(spark.createDataFrame([("healthy",), ("degraded",)], "status string"), "status").first().status == "degraded"
    e = monitoring.evidence(spark.createDataFrame([("high", 0.01, 0.5, "t"), ("low", 0.5, 2.0, "u")], "confidence string, p double, effect double, method string")).first()
    assert (e.n_high, e.n_tests, e.n_significant, e.strength, e.methods) == (1, 2, 1, 0.6 * 0.5 + 0.4, ["t", "u"])
    o = monitoring.org_metrics(spark.createDataFrame([("o", 5, 1), ("o", 2, 2), ("q", 1, 1)], "org string, stars int, forks int"), spark.createDataFrame([("o", "x"), ("o", "x"), ("o", "y")], "org string, login string"))
    assert {x.org: (x.stars, x.forks, x.contributors) for x in o.collect()} == {"o": (7, 3, 2), "q": (1, 1, 0)}


def test_predictions(spark):
    rows = [(i, float(i % 10), float((i * 7) % 5), 2.0 * (i % 10) + (i * 7) % 5) for i in range(150)]
    p = learn.growth_model(spark.createDataFrame(rows, "id int, a double, b double, y double"), "id", "y")
    q = learn.prediction_quality(p, p.select("id", F.col("actual").alias("outcome")), "id").first()
    assert q.accuracy > 0.9 and p.where("confidence < 0 or confidence > 1").count() == 0
    with pytest.raises(ValueError, match="needs"):
        learn.growth_model(spark.createDataFrame(rows[:5], "id int, a double, b double, y double"), "id", "y")


def test_written_tables_can_be_read_again(spark):
    df = written.written(spark.range(5))
    assert df.count() == 5 and df.agg(F.sum("id")).first()[0] == 10
