"""The general operators p1 to p6 on small tables: brute force, nulls, ties, repeats, empty tables, clashing columns, heavy keys."""

import datetime as dt
from collections import Counter, defaultdict
from statistics import median

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import features, heavy_keys, history, rolling, sessions, spikes
from tidemark.plans import pipeline

T0 = dt.datetime(2024, 9, 1)
FEW = settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def at(seconds):
    return None if seconds is None else T0 + dt.timedelta(seconds=seconds)


# p1


def test_heavy_keys_counts_all_rows_and_cuts_a_heavy_key(spark):
    rows = [(1, i % 7) for i in range(3000)] + [(2, None)] * 50 + [(None, 1)] * 10 + [(k, k) for k in range(10, 110)]
    df = spark.createDataFrame(rows, "k int, o int")
    counts = {r.k: r.n for r in heavy_keys.keyed_states(df, ["k"], ["o"], [heavy_keys.count_rows("n")], 6).collect()}
    assert counts == dict(Counter(k for k, _ in rows))
    pieces = heavy_keys.spread(df, ["k"], ["o"], 6).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in pieces) < 0.6 * len(rows)
    found = heavy_keys.heavy_keys(df, "k", ["o"], 0.025).collect()
    assert [r.k for r in found] == [1] and found[0].n_rows == 3000


def test_heavy_keys_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], "article_id int, id long")
    assert heavy_keys.heavy_keys(df, "article_id", ["id"]).collect() == []
    odd = spark.createDataFrame([(1, 1, 5, 6), (1, 1, 5, 6)], "article_id int, id long, __piece int, n_rows int")
    assert heavy_keys.heavy_keys(odd, "article_id", ["id"]).first().n_rows == 2


def test_states_stitch_totals_and_bounds(spark):
    df = spark.createDataFrame([(1, 5, 3), (1, 2, None), (1, 9, 4), (2, 1, None)], "k int, o int, v int")
    h = heavy_keys
    out = h.keyed_states(df, ["k"], ["o"], [h.total("s", "v"), h.least("a", "o"), h.greatest("b", "o")], 3)
    assert sorted(map(tuple, out.collect())) == [(1, 7, 2, 9), (2, None, 1, 1)]


# p2


def brute_sessions(rows, gap=1800):
    users = defaultdict(set)
    for u, t, r, _ in rows:
        if u and t is not None:
            users[u].add((t, r))
    out = []
    for u, events in users.items():
        line = sorted(events)
        part = [line[0]]
        for e in line[1:]:
            if e[0] - part[-1][0] > gap:
                out.append((u, part))
                part = []
            part.append(e)
        out.append((u, part))
    return sorted((u, at(p[0][0]), at(p[-1][0]), len(p), p[0][1], p[-1][1]) for u, p in out)


EVENT = st.tuples(st.sampled_from(["a", "b", "", None]), st.one_of(st.none(), st.integers(0, 40).map(lambda x: x * 900), st.integers(0, 90_000)), st.integers(1, 60), st.sampled_from(["x", "y", None]))


@FEW
@given(st.lists(EVENT, max_size=60))
def test_sessions_as_by_hand(spark, rows):
    rows = list({(u, t, r): (u, t, r, a) for u, t, r, a in rows}.values())
    rows += rows[:5]
    df = spark.createDataFrame([(u, at(t), r, a) for u, t, r, a in rows], "u string, t timestamp_ntz, r long, a string")
    got = sessions.sessions(df, "u", "t", "r", piece_seconds=7200)
    assert sorted(tuple(x[c] for c in ("u", "start", "end", "n_events", "first_id", "last_id")) for x in got.collect()) == brute_sessions(rows)


def test_sessions_gap_is_inclusive_and_crosses_pieces(spark):
    rows = [("u", at(t), i, f"a{i % 3}") for i, t in enumerate([21_000, 21_600, 23_400, 25_201, 43_199, 43_200])]
    df = spark.createDataFrame(rows, "u string, t timestamp_ntz, r long, a string")
    got = sorted(tuple(r) for r in sessions.sessions(df, "u", "t", "r", distinct="a").select("first_id", "last_id", "n_events", "n_distinct").collect())
    assert got == [(0, 2, 3, 3), (3, 3, 1, 1), (4, 5, 2, 2)]


def test_sessions_ties_nulls_and_extra_columns(spark):
    rows = [("u", at(0), 9, 1, None), ("u", at(0), 3, 2, "x"), ("u", at(0), 3, 2, "x"), ("u", None, 4, 3, "y"), ("v", at(5), None, 3, "z")]
    df = spark.createDataFrame(rows, "u string, t timestamp_ntz, r long, __n int, __c string")
    got = sorted((r.u, r.first_id, r.last_id, r.n_events) for r in sessions.sessions(df, "u", "t", "r").collect())
    assert got == [("u", 3, 9, 2), ("v", None, None, 1)]
    assert sessions.sessions(df.limit(0), "u", "t", "r", distinct="__c").collect() == []


# p3


@FEW
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(0, 200)), st.sampled_from(["d", "m"]), st.one_of(st.none(), st.integers(0, 9))), max_size=40))
def test_trailing_totals_as_by_hand(spark, rows):
    df = spark.createDataFrame([(a, at(None if d is None else d * 86_400 + 5), p, v) for a, d, p, v in rows], "a string, t timestamp_ntz, p string, v long")
    got = {(r.a, (r.day - T0.date()).days): (r.total, r.total_7, r.average_7, r.active_7, r.total_30) for r in rolling.trailing_totals(df, "a", "t", "v", ["p"]).collect()}
    readings = defaultdict(list)
    for a, d, p, v in rows:
        if a and d is not None:
            readings[a, d, p].append(v)
    days = defaultdict(dict)
    for (a, d, _), v in readings.items():
        days[a][d] = days[a].get(d, 0) + max((x for x in v if x is not None), default=0)
    want = {}
    for a, own in days.items():
        line = sorted(own)
        listed = [x for d, n in zip(line, [*line[1:], None]) for x in (range(d, n) if n and n - d <= 60 else [d])]
        for d in listed:
            t = lambda n: sum(own.get(x, 0) for x in range(d - n + 1, d + 1))  # noqa: B023, E731
            want[a, d] = (own.get(d, 0), t(7), t(7) / 7, sum(x in own for x in range(d - 6, d + 1)), t(30))
    assert got == want


# p4


def brute_suspicious(rows):
    readings = {}
    for a, d, p, t, b, h in rows:
        if a and d is not None:
            key = (a, p, d)
            readings[key] = tuple(max((x for x in (o, n) if x is not None), default=None) for o, n in zip(readings.get(key, (None,) * 3), (t, b, h)))
    found = set()
    for (a, p, d), (t, b, h) in readings.items():
        own = [(k, v) for k, v in readings.items() if k[:2] == (a, p)]
        ok = lambda *x: None not in x
        bad = any(x is not None and x < 0 for x in (t, b, h)) or (ok(b, t) and b > t) or (ok(t, b, h) and t != b + h)
        for i, x in ((0, t), (1, b)):
            known = [v[i] for _, v in own if v[i] is not None]
            bad |= x is not None and x > 5 * median(known)
        days = {k[2]: v[0] for k, v in own}
        lo = hi = d
        if t is not None:
            while days.get(lo - 1) == t:
                lo -= 1
            while days.get(hi + 1) == t:
                hi += 1
            bad |= hi - lo >= 4
        if bad:
            found.add((a, p, d))
    return found


COUNT = st.one_of(st.none(), st.integers(-1, 30), st.just(7))


@FEW
@given(st.lists(st.tuples(st.sampled_from(["a", None]), st.one_of(st.none(), st.integers(0, 14)), st.sampled_from(["d", None]), COUNT, COUNT, COUNT), max_size=50))
def test_suspicious_readings_as_by_hand(spark, rows):
    rows = list({r[:3]: r for r in rows}.values())
    df = spark.createDataFrame([(a, at(None if d is None else d * 86_400), p, t, b, h) for a, d, p, t, b, h in rows + rows[:3]], "a string, x timestamp_ntz, p string, t long, b long, h long")
    out = spikes.suspicious_readings(df, ["a", "p"], "x", "t", "b", "h")
    assert out.where("(t_above and not t_extreme and not t_untested) or (t is null and t_residual is not null)").count() == 0
    hit = out.where("implausible or is_stuck or ((t_extreme or t_untested) and t_above) or ((b_extreme or b_untested) and b_above)")
    assert {(r.a, r.p, (r.day - T0.date()).days) for r in hit.collect()} == brute_suspicious(rows)


def test_tail_cutoff_flags_a_spike(spark):
    rows = [("a", at(d * 86_400), "d", 100 + (d * 7919) % 23, 10, 90 + (d * 7919) % 23) for d in range(70)]
    rows[40] = ("a", rows[40][1], "d", 390, 300, 90)
    df = spark.createDataFrame(rows, "a string, x timestamp_ntz, p string, t long, b long, h long")
    out = spikes.suspicious_readings(df, ["a", "p"], "x", "t", "b", "h", risk=0.001, over=0.1)
    assert out.where("t_untested").count() == 0  # the fitted tail screens this source
    assert {r.day for r in out.where("t_extreme").collect()} == {rows[40][1].date()}
    assert spikes.suspicious_readings(df.limit(0), ["a", "p"], "x", "t", "b", "h").collect() == []


def test_p4_found_has_no_stage_without_effect(spark, tmp_path):
    # A tail under five medians, spikes that fill the tail, and a source too short for a cutoff.
    over = {"a": {40: 700, 41: 480}, "b": {d: 600 + d for d in range(0, 70, 3)}, "c": {2: 900}}
    totals = [(a, d, over[a].get(d, 100 + d * 7919 % 23)) for a, n in (("a", 70), ("b", 70), ("c", 4)) for d in range(n)]
    rows = [(a, d, "d", t, t // 5, t - t // 5) for a, d, t in totals]
    schema = "article string, timestamp timestamp_ntz, device_type string, views_total long, views_bot long, views_human long"
    spark.createDataFrame([(a, at(d * 86_400), *rest) for a, d, *rest in rows], schema).write.parquet(f"{tmp_path}/pageviews.parquet")
    found, tails = (pipeline.QUERIES[name](spark, str(tmp_path)) for name in ("p4_found", "p4_tails"))
    assert {(r.article, r.device_type, (dt.date.fromisoformat(r.day) - T0.date()).days) for r in found.collect()} == brute_suspicious(rows)
    assert found.count() == 26
    # The fit decides the rows of p4_tails; no row of p4_found depends on it, so it has no place in that plan.
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "__c0level#" in plan(tails) and "__c0level#" not in plan(found) and "__c1level#" not in plan(found)


# p5


SNAPSHOT = st.tuples(st.sampled_from(["c1", "c2"]), st.one_of(st.none(), st.integers(0, 12)), st.one_of(st.none(), st.integers(1, 3)), st.one_of(st.none(), st.integers(1, 3)))


def brute_history(rows):
    out = []
    for c in {r[1] for r in rows}:
        newest = {}
        for s, k, t, a, b in sorted(rows):
            if k == c and t is not None:
                newest[t] = (a, b)
        last, known = None, [None, None]
        for t in sorted(newest):
            known = [v if v is not None else k for v, k in zip(newest[t], known)]
            if last is None or known != last:
                out.append([c, *known, t, None])
                if last is not None:
                    out[-2][4] = t
                last = list(known)
    return sorted(map(tuple, out), key=str)


@FEW
@given(st.lists(SNAPSHOT, max_size=30))
def test_history_as_by_hand(spark, rows):
    rows = [(i, *r) for i, r in enumerate(rows)]
    day = lambda d: None if d is None else d * 86_400 * 9
    df = spark.createDataFrame([(i, c, at(day(t)), a, b, "x") for i, c, t, a, b in rows], "s long, c string, t timestamp_ntz, a int, b int, valid_from string")
    got = [(r.c, r.a, r.b, r.valid_from, r.valid_to) for r in history.attribute_history(df, "c", "t", "s", ["a", "b"], piece_days=20).collect()]
    want = [(c, a, b, at(day(f)), at(day(t))) for c, a, b, f, t in brute_history(rows)]
    assert sorted(got, key=str) == sorted(want, key=str)


@FEW
@given(st.lists(SNAPSHOT, max_size=30), st.integers(0, 30))
def test_merge_is_the_rebuilt_history(spark, rows, cut):
    """Batches in the order of loading hold several updates of an entity, late rows, corrections and nulls."""
    rows = [(i, c, at(None if t is None else t * 86_400 * 9), a, b, "x") for i, (c, t, a, b) in enumerate(rows)]
    schema = "s long, c string, t timestamp_ntz, a int, b int, valid_from string"
    df = lambda some: spark.createDataFrame(some, schema)
    args = ("c", "t", "s", ["a", "b"])
    whole = sorted(map(str, history.attribute_history(df(rows), *args).collect()))
    log, batch = rows[:cut], rows[cut:]
    merged = history.merge_updates(history.attribute_history(df(log), *args), df(log), df(batch), *args, piece_days=20)
    assert sorted(map(str, merged.collect())) == whole
    assert sorted(map(str, history.merged_history(df(rows), *args, batches=4).collect())) == whole


def test_several_updates_and_late_rows_of_one_batch(spark):
    schema = "s long, c string, t timestamp_ntz, a int, b int"
    log = spark.createDataFrame([(1, "x", at(0), 1, 1), (2, "x", at(86_400 * 9), 1, None), (3, "y", at(5), 8, 8)], schema)
    batch = spark.createDataFrame([(4, "x", at(10), 2, None), (5, "x", at(86_400 * 20), 5, 9), (6, "x", at(86_400 * 21), 6, None), (7, None, at(1), 1, 1)], schema)
    args = ("c", "t", "s", ["a", "b"])
    merged = history.merge_updates(history.attribute_history(log, *args), log, batch, *args)
    got = sorted((r.c, r.a, r.b, r.valid_from, r.valid_to, r.is_current) for r in merged.collect())
    times = [at(0), at(10), at(86_400 * 9), at(86_400 * 20), at(86_400 * 21), None]
    values = [(1, 1), (2, 1), (1, 1), (5, 9), (6, 9)]
    assert got == sorted([("x", *v, f, t, t is None) for v, f, t in zip(values, times, times[1:])] + [("y", 8, 8, at(5), None, True)])
    assert history.merged_history(log.limit(0), *args).collect() == []


# p6


def test_features_of_kinds(spark):
    t = lambda s: at(s)
    rows = [
        ("a", 1, t(0), "Registered ", "e", False, 100, "", t(10)), ("a", 1, t(0), "Registered ", "e", True, 100, "", t(20)),
        ("a", 2, t(50), "registered", "e", True, 127, "", t(60)), ("a", 3, None, None, "e", None, None, "", t(60)),
        ("b", 4, t(90), "bot", "e", False, -1, "", t(95)), (None, 5, t(9), "bot", "e", False, 1, "", t(10)), ("b", None, t(9), "bot", "e", False, 1, "", t(10)),
    ]
    df = spark.createDataFrame(rows, "article string, revision_id long, timestamp timestamp_ntz, editor_type string, editor_id string, is_reverted boolean, bytes_changed int, kind string, fetched_at timestamp_ntz")
    kinds = ["registered_reverted_plus64", "unknown_unclear_nosize", "other_kept_minus1"]
    got = {r.article: r for r in features.edit_features(df, kinds).collect()}
    a, b = got["a"], got["b"]
    assert (a.n_registered_reverted_plus64, a.bytes_registered_reverted_plus64, a.age_registered_reverted_plus64) == (2, 227, 40)
    assert (a.n_unknown_unclear_nosize, a.bytes_unknown_unclear_nosize, a.age_unknown_unclear_nosize) == (1, None, None)
    assert (b.n_other_kept_minus1, b.bytes_other_kept_minus1, b.age_other_kept_minus1, b.n_unknown_unclear_nosize) == (1, -1, 0, 0)
    assert features.edit_features(df.limit(0), kinds).collect() == []


def test_every_size_has_a_kind(spark):
    values = [0, None, 1, -1, 2, 3, 4, -7, 8191, 16384, 2_000_000_000, -2_147_483_648]
    df = spark.createDataFrame([(v,) for v in values], "v int").select(features.size_kind(F.col("v")).alias("k"))
    assert {r.k for r in df.collect()} <= set(features.SIZES)
    assert len(features.KINDS) == len(set(features.KINDS)) == 384


@pytest.mark.parametrize("text", ["", "  ", "x" * 100_000])
def test_long_and_empty_names(spark, text):
    df = spark.createDataFrame([(text, at(0), 1), ("u", at(1), 2)], "u string, t timestamp_ntz, r long")
    assert sessions.sessions(df, "u", "t", "r").count() == (1 if text == "" else 2)
