"""Queries over the library's readers, figures, reports and causal effects that no other module has."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html
from ..functions import metrics as m
from ..operators import causal, etl, graph, learn, monitoring, report, stats
from ..sources import landed, sinks
from ..sources.tables import table
from ..sources.written import scratch
from ..streaming import jobs
from .relational import r6
from .series import BY, EVENT
from .views import DAILY_ORDERS, EDITS, READINGS, daily_orders, edits, readings

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def register(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# Responses as landed, made from the tables and read back


@query(f"WITH {READINGS} SELECT article, CAST(day AS TIMESTAMP) AS timestamp, device_type, views FROM readings")
def landed_pageviews(spark: SparkSession, d: str) -> DataFrame:
    """A response for each article and device."""
    item = F.struct(F.lit("w").alias("project"), "article", F.lit("daily").alias("granularity"), F.date_format("day", "yyyyMMdd00").alias("timestamp"), "views")
    bodies = readings(spark, d).groupBy("article", "device_type").agg(F.to_json(F.struct(F.collect_list(item).alias("items"))).alias("body"))
    return landed.pageviews(bodies)[0].select("article", "timestamp", "device_type", "views")


@query("""SELECT id, CASE WHEN namespace IS NULL THEN 'no items' WHEN id % 3 = 0 THEN 'empty items' WHEN id % 3 = 1 THEN 'no timestamp' END AS message, namespace IS NOT NULL AND id % 3 <> 1 AS is_valid FROM dim_articles""")
def landed_problems(spark: SparkSession, d: str) -> DataFrame:
    """Responses that lack something."""
    body = F.when(F.col("namespace").isNull(), '{"title": 1}').when(F.col("id") % 3 == 0, '{"items": []}').when(F.col("id") % 3 == 1, '{"items": [{"views": 1}]}').otherwise('{"items": [{"timestamp": "20240101"}]}')
    return landed.response_problems(table(spark, d, "dim_articles").select("id", body.alias("body"))).select("id", "message", "is_valid")


def _article_totals(spark: SparkSession, d: str) -> DataFrame:
    return readings(spark, d).groupBy("article").agg(F.sum("views").alias("views"))


@query(f"WITH {READINGS} SELECT article, CAST(sum(views) AS BIGINT) AS views, row_number() OVER (ORDER BY sum(views) DESC, article) AS rank FROM readings GROUP BY 1 QUALIFY rank <= 100")
def landed_top(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred of a response that lists all articles by views."""
    listed = F.array_sort(F.collect_list(F.struct((-F.col("views")).alias("order"), "article", "views")))
    body = _article_totals(spark, d).agg(F.to_json(F.struct(F.array(F.struct(listed.alias("articles"))).alias("items"))).alias("body"))
    return landed.top_articles(body, limit=100).select("article", "views", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {READINGS} SELECT CAST(sum(views) AS BIGINT) AS total, round(sum(views) / 6900000.0, 9) AS per_article FROM readings")
def landed_totals(spark: SparkSession, d: str) -> DataFrame:
    """A response for each article."""
    bodies = _article_totals(spark, d).select(F.to_json(F.struct(F.array(F.struct("article", "views")).alias("items"))).alias("body"))
    return landed.aggregate_views(bodies).select("total", F.round("per_article", 9).alias("per_article"))


@query(f"WITH {EDITS} SELECT CAST(timestamp AS DATE) AS date, count(DISTINCT editor_id) AS editors, count(*) AS edits FROM edits GROUP BY 1")
def landed_counts(spark: SparkSession, d: str) -> DataFrame:
    """Editors and edits of each day, from one response a day."""
    days = edits(spark, d).groupBy(F.to_date("timestamp").alias("day")).agg(F.countDistinct("editor_id").alias("editors"), F.count(F.lit(1)).alias("edits"))
    result = F.struct(F.date_format("day", "yyyy-MM-dd'T'00:00:00'Z'").alias("timestamp"), "editors", "edits")
    bodies = days.select(F.to_json(F.struct(F.array(F.struct(F.array(result).alias("results"))).alias("items"))).alias("body"))
    return landed.counts(bodies, "editors").join(landed.counts(bodies, "edits"), "date")


@query("""SELECT article, revision_id, date_trunc('second', timestamp) AS timestamp, editor_id, CASE WHEN regexp_matches(editor_id, '^((\\d{1,3}\\.){3}\\d{1,3}|([0-9a-fA-F]{0,4}:){2,7}[0-9a-fA-F]{0,4})$') THEN 'anonymous' ELSE 'registered' END AS editor_type, edit_summary FROM revisions""")
def landed_revisions(spark: SparkSession, d: str) -> DataFrame:
    """A response for each revision as delivered."""
    item = F.struct(F.col("article").alias("title"), F.col("revision_id").alias("revid"), F.col("editor_id").alias("user"), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.col("edit_summary").alias("comment"))
    bodies = table(spark, d, "revisions").select(F.to_json(F.struct(F.array(item).alias("items"))).alias("body"))
    return landed.revisions(bodies).select("article", "revision_id", "timestamp", "editor_id", "editor_type", "edit_summary")


@query("""WITH r AS (SELECT p_brand AS org, sum(p_size) AS stars, count(*) AS forks FROM part GROUP BY 1), c AS (SELECT p_brand AS org, count(DISTINCT l_suppkey) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
  SELECT r.org, CAST(stars AS BIGINT) AS stars, forks, coalesce(n, 0) AS contributors FROM r LEFT JOIN c ON r.org = c.org""")
def organisation_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Brands as organisations, parts as repositories, suppliers as contributors."""
    p = table(spark, d, "part")
    people = table(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("org"), F.col("l_suppkey").alias("login"))
    return monitoring.org_metrics(p.select(F.col("p_brand").alias("org"), F.col("p_size").alias("stars"), F.lit(1).alias("forks")), people)


@query(f"""WITH {DAILY_ORDERS} SELECT day AS date, value, series AS platform, 'orders' AS metric_type, w.quarter FROM daily LEFT JOIN dim_dates w ON w.date = day""")
def external_columns(spark: SparkSession, d: str) -> DataFrame:
    """A series found by its column names, with a column of a CSV."""
    path = scratch(spark, "external")
    sinks.write_csv(table(spark, d, "dim_dates").select("date", "quarter"), path)
    named = daily_orders(spark, d).select(F.col("day").alias("Date"), F.col("value").alias("Value"), F.col("series").alias("Platform"))
    return landed.with_external(landed.series_from(named, "orders"), path, "date date, quarter int")


# Exports


@query("SELECT id, lower(sector) AS metric, max(revenue_rank) AS value FROM company_snapshots WHERE sector IS NOT NULL AND revenue_rank IS NOT NULL GROUP BY 1, 2")
def exported_json(spark: SparkSession, d: str) -> DataFrame:
    """One object per company, read back."""
    own = table(spark, d, "company_snapshots").where("sector is not null").groupBy("id", F.lower("sector").alias("metric")).agg(F.max("revenue_rank").alias("value"))
    read = F.from_json("json", "id string, metrics map<string, int>")
    return sinks.export_json(own, "id", "metric", "value").select(read.alias("j")).select("j.id", F.explode("j.metrics").alias("metric", "value"))


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def exported_csv(spark: SparkSession, d: str) -> DataFrame:
    """A table written as CSV and read back."""
    c, path = table(spark, d, "customer"), scratch(spark, "exports")
    sinks.write_csv(c, path)
    return spark.read.csv(path, header=True, schema=c.schema)


@query("""WITH s AS (SELECT id, sector, arg_max(employee_count, updated_at) AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, snapshot_id) AS k FROM company_snapshots WHERE updated_at IS NOT NULL AND employee_count IS NOT NULL) WHERE k = 1 GROUP BY 1, 2)
  SELECT '<tr><td>' || id || '</td><td>' || coalesce(replace(replace(replace(sector, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '') || '</td><td>' || score || '</td></tr>' AS line FROM s UNION ALL SELECT '<tr><th>id</th><th>sector</th><th>score</th></tr>'""")
def exported_report(spark: SparkSession, d: str) -> DataFrame:
    """The newest scores as rows of an HTML table, written as text and read back."""
    from ..operators.ranking import latest

    log = table(spark, d, "company_snapshots").where("employee_count is not null").select("id", "sector", F.col("employee_count").alias("score"), "updated_at", "snapshot_id")
    path = scratch(spark, "exports")
    sinks.write_text(report.as_text(latest(log, "id", "updated_at", "snapshot_id").select("id", "sector", "score"), "html"), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


# Figures


@query("""SELECT o_orderkey, CASE WHEN abs(b) < 1e-10 THEN CASE WHEN abs(v - b) < 1e-10 THEN 0 WHEN v > b THEN 'Infinity'::DOUBLE ELSE '-Infinity'::DOUBLE END ELSE round((v - b) / b * 100, 6) END AS change,
  CASE WHEN abs(e) < 0.2 THEN 'negligible' WHEN abs(e) < 0.5 THEN 'small' WHEN abs(e) < 0.8 THEN 'medium' ELSE 'large' END AS magnitude,
  CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS stars, round(CASE WHEN q > 0 THEN v / q ELSE 0 END, 6) AS per_second,
  'Q' || quarter(o_orderdate) || ' ' || year(o_orderdate) AS quarter
  FROM (SELECT *, (o_orderkey % 5) * 1000.0 AS b, o_totalprice AS v, o_totalprice / 500000 - 0.3 AS e, (o_orderkey % 1000) / 10000.0 AS p, o_custkey % 7 AS q FROM orders)""")
def scalar_figures(spark: SparkSession, d: str) -> DataFrame:
    """Change, magnitude, stars, throughput and quarter of every order."""
    o = table(spark, d, "orders")
    b, v, p = (F.col("o_orderkey") % 5) * 1000.0, F.col("o_totalprice"), (F.col("o_orderkey") % 1000) / 10000.0
    return o.select(
        "o_orderkey", r6(m.percentage_change(b, v), "change"), m.effect_magnitude(v / 500000 - 0.3).alias("magnitude"), m.significance_stars(p).alias("stars"), r6(m.throughput(v, F.col("o_custkey") % 7), "per_second"), m.quarter_label(F.col("o_orderdate")).alias("quarter")
    )


@query(f"""WITH {DAILY_ORDERS}, guesses AS (SELECT series || day AS key, value AS outcome, lag(value) OVER (PARTITION BY series ORDER BY day) AS predicted FROM daily)
  SELECT round(avg(abs(predicted - outcome)), 4) AS mae, round(sqrt(avg((predicted - outcome) * (predicted - outcome))), 4) AS rmse, round(greatest(0, least(1, 1 - avg(abs(predicted - outcome)) / avg(abs(outcome)))), 6) AS accuracy FROM guesses WHERE predicted IS NOT NULL""")
def guess_quality(spark: SparkSession, d: str) -> DataFrame:
    """Predictions joined with outcomes by key."""
    from pyspark.sql import Window

    rows = daily_orders(spark, d).withColumn("key", F.concat("series", F.col("day").cast("string")))
    guesses = rows.withColumn("predicted", F.lag("value").over(Window.partitionBy("series").orderBy("day"))).where("predicted is not null")
    out = learn.prediction_quality(guesses.select("key", "predicted"), rows.select("key", F.col("value").alias("outcome")), "key")
    return out.select(F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"), r6("accuracy", "accuracy"))


@query("""WITH f AS (SELECT CASE l_returnflag WHEN 'A' THEN 'high' WHEN 'N' THEN 'medium' ELSE 'low' END AS confidence, l_tax AS p, l_discount * 20 - 1 AS effect, l_linestatus AS method FROM lineitem)
  SELECT count(*) FILTER (confidence = 'high') AS n_high, count(*) FILTER (confidence = 'medium') AS n_medium, count(*) FILTER (confidence = 'low') AS n_low, count(p) AS n_tests, count(*) FILTER (p < 0.05) AS n_significant,
  round(0.6 * avg(CASE WHEN p < 0.05 THEN 1.0 ELSE 0 END) + 0.4 * least(1, avg(abs(effect))), 6) AS strength, list_sort(list(DISTINCT method)) AS methods FROM f""")
def evidence_summary(spark: SparkSession, d: str) -> DataFrame:
    """Line items as findings."""
    level = F.when(F.col("l_returnflag") == "A", "high").when(F.col("l_returnflag") == "N", "medium").otherwise("low")
    f = table(spark, d, "lineitem").select(level.alias("confidence"), F.col("l_tax").alias("p"), (F.col("l_discount") * 20 - 1).alias("effect"), F.col("l_linestatus").alias("method"))
    return monitoring.evidence(f).withColumn("strength", r6("strength"))


@query("""SELECT bool_and(c_acctbal > -900) AS is_valid, round(avg(c_acctbal), 4) AS score, list_sort(list(DISTINCT c_mktsegment)) AS missing, list_sort(list(DISTINCT 'nation ' || c_nationkey)) AS advice FROM customer""")
def joined_reports(spark: SparkSession, d: str) -> DataFrame:
    """One report of many."""
    c = table(spark, d, "customer")
    reports = c.select((F.col("c_acctbal") > -900).alias("is_valid"), F.col("c_acctbal").alias("score"), F.array("c_mktsegment").alias("missing"), F.array(F.concat(F.lit("nation "), "c_nationkey")).alias("advice"))
    return monitoring.combined_reports(reports).withColumn("score", F.round("score", 4))


@query("""WITH b AS (SELECT s_suppkey AS id, s_nationkey AS community FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 60) SELECT x.id AS src, y.id AS dst, x.community FROM b x JOIN b y ON x.community = y.community AND x.id < y.id""")
def displayed_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The sixty most central nodes and their pairs by community, a report of stated size."""
    s = table(spark, d, "supplier")
    central = s.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("centrality"))
    return graph.display_network(central, s.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("community")))[1]


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, o_orderstatus AS name, o_orderpriority AS kind FROM orders")
def campaign_names(spark: SparkSession, d: str) -> DataFrame:
    """Lists of date:name:kind, parsed; entries without a date are dropped."""
    text = F.concat(F.lit("soon:x:y, "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(":"), "o_orderstatus", F.lit(" : "), "o_orderpriority")
    return table(spark, d, "orders").select("o_orderkey", F.explode(monitoring.dated_names(text, ("name", "kind"))).alias("x")).select("o_orderkey", "x.*")


@query("SELECT id, CASE WHEN id % 4 <> 0 THEN url || '?page=2' END AS next FROM dim_articles WHERE url IS NOT NULL")
def next_pages(spark: SparkSession, d: str) -> DataFrame:
    """The next page of a Link header."""
    a = table(spark, d, "dim_articles").where("url is not null")
    header = F.concat(F.when(F.col("id") % 4 != 0, F.concat(F.lit("<"), "url", F.lit('?page=2>; rel="next", '))).otherwise(""), F.lit("<"), "url", F.lit('?page=9>; rel="last"'))
    return a.select("id", html.next_link(header).alias("next"))


@query("SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 60 MINUTE")
def retained_events(spark: SparkSession, d: str) -> DataFrame:
    """Records of the last hour before the newest."""
    e = table(spark, d, "events")
    newest = e.agg(F.max("ts").alias("now"))
    return monitoring.within_retention(e.crossJoin(F.broadcast(newest)), "ts", F.col("now")).select("event_id", "ts")


@query("SELECT n_regionkey AS region, CASE max(n_nationkey % 3) WHEN 0 THEN 'healthy' WHEN 1 THEN 'degraded' ELSE 'unhealthy' END AS status FROM nation GROUP BY 1")
def worst_states(spark: SparkSession, d: str) -> DataFrame:
    """The worst state of each region's components."""
    state = F.element_at(F.array(F.lit("healthy"), F.lit("degraded"), F.lit("unhealthy")), F.col("n_nationkey") % 3 + 1)
    return monitoring.worst(table(spark, d, "nation").select(F.col("n_regionkey").alias("region"), state.alias("status")).groupBy("region"), "status")


@query("""SELECT c_mktsegment AS segment, count(*) AS n, round(sum(total), 2) AS total FROM (SELECT o_custkey, sum(o_totalprice) AS total FROM orders WHERE o_totalprice > 1000 GROUP BY 1) JOIN customer ON c_custkey = o_custkey GROUP BY 1""")
def chained_steps(spark: SparkSession, d: str) -> DataFrame:
    """Named steps one after the other; the last one's result."""
    steps = [
        ("large", lambda df: df.where("o_totalprice > 1000")),
        ("customers", lambda df: df.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"))),
        ("segments", lambda df: df.join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("total"), 2).alias("total"))),
    ]
    return jobs.pipeline(steps, table(spark, d, "orders"))["segments"]


@query("""WITH n AS (SELECT id AS company_id, sector, CAST(employee_count AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, snapshot_id) AS k FROM company_snapshots WHERE updated_at IS NOT NULL AND employee_count IS NOT NULL) WHERE k = 1),
  means AS (SELECT sector, avg(score) AS mean FROM n GROUP BY 1), low AS (SELECT *, row_number() OVER (ORDER BY score, company_id) AS k, count(*) OVER () AS c FROM n)
  SELECT company_id, low.sector, score, round(mean, 4) AS sector_mean, round(greatest(mean - score, 0), 4) AS gap, round_even(CASE WHEN mean = 0 THEN 0.5 ELSE least(greatest(mean - score, 0) / mean, 1) END, 4) AS confidence FROM low JOIN means ON low.sector = means.sector WHERE k <= greatest(1, c // 4)""")
def investment_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Companies of the bottom quarter with the gap to their sector."""
    from ..operators.ranking import latest

    log = table(spark, d, "company_snapshots").where("employee_count is not null").select(F.col("id").alias("company_id"), "sector", F.col("employee_count").cast("double").alias("score"), "updated_at", "snapshot_id")
    out = report.investments(latest(log, "company_id", "updated_at", "snapshot_id"))
    return out.select("company_id", "sector", "score", F.round("sector_mean", 4).alias("sector_mean"), F.round("gap", 4).alias("gap"), "confidence")


# Effects


@query("""WITH s AS (SELECT o_orderstatus AS g, o_totalprice AS v FROM orders WHERE o_orderstatus IN ('F', 'O')), z AS (SELECT median(v) FILTER (g = 'F') AS a, median(v) FILTER (g = 'O') AS b, count(*) FILTER (g = 'F') AS m, count(*) FILTER (g = 'O') AS n, stddev_pop(v) AS sd FROM s)
  SELECT round(a - b, 4) AS difference, round(a - b - 1.96 * sqrt((m + n) / (m * n * 1.0)) * sd, 4) AS lo, round(a - b + 1.96 * sqrt((m + n) / (m * n * 1.0)) * sd, 4) AS hi FROM z""")
def median_gap(spark: SparkSession, d: str) -> DataFrame:
    """The difference of two medians with its interval."""
    out = stats.median_difference(table(spark, d, "orders"), "o_orderstatus", "F", "O", "o_totalprice")
    return out.select(*(F.round(c, 4).alias(c) for c in ("difference", "lo", "hi")))


PLACEBO = "1997-06-01"


@query(f"""WITH {DAILY_ORDERS}, p AS (SELECT * FROM daily WHERE day < DATE '{EVENT}'), c AS (SELECT {', '.join(f"avg(value) FILTER (series = '{g}' AND day {o} DATE '{PLACEBO}') AS m_{k}" for k, g, o in (('tb', '1-URGENT', '<'), ('ta', '1-URGENT', '>='), ('cb', '5-LOW', '<'), ('ca', '5-LOW', '>=')))} FROM p)
  SELECT round((m_ta - m_tb) - (m_ca - m_cb), 4) AS effect FROM c""")
def placebo_effect(spark: SparkSession, d: str) -> DataFrame:
    """The difference in differences at a made-up date."""
    return causal.placebo_difference(daily_orders(spark, d), "series", "1-URGENT", "5-LOW", "day", "value", EVENT, PLACEBO).select(F.round("effect", 4).alias("effect"))


_STUDY = f"""WITH {DAILY_ORDERS}, pre AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY day DESC) AS k FROM daily WHERE day < DATE '{EVENT}'), kept AS (SELECT *, lag(value) OVER (PARTITION BY series ORDER BY day) AS before FROM pre WHERE k <= 90),
  fit AS (SELECT series, regr_slope(value, before) AS f, regr_intercept(value, before) AS c, max(value) FILTER (k = 1) AS last, count(*) AS n FROM kept GROUP BY 1 HAVING count(*) >= 60),
  post AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY day) AS h FROM daily WHERE day >= DATE '{EVENT}'),
  gaps AS (SELECT p.series, day, value AS observed, c * (1 - pow(f, h)) / (1 - f) + pow(f, h) * last AS counterfactual FROM post p JOIN fit ON p.series = fit.series WHERE h <= 30)"""


@query(_STUDY + " SELECT series, day, observed, round(counterfactual, 2) AS counterfactual, round(observed - counterfactual, 2) AS gap FROM gaps")
def event_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Thirty days after the event against an ARIMA(1, 0, 0) of the ninety rows before."""
    g = causal.baseline_gaps(daily_orders(spark, d), BY, "day", "value", EVENT, order=(1, 0, 0))
    return g.select("series", "day", "observed", F.round("counterfactual", 2).alias("counterfactual"), F.round("gap", 2).alias("gap"))


@query(_STUDY + " SELECT series, count(*) AS n, round(sum(observed - counterfactual), 1) AS car, round(sum(observed - counterfactual) / (stddev_pop(observed - counterfactual) * sqrt(count(*))), 5) AS z FROM gaps GROUP BY 1")
def event_study(spark: SparkSession, d: str) -> DataFrame:
    """The cumulated gap of these thirty days and its z."""
    g = causal.baseline_gaps(daily_orders(spark, d), BY, "day", "value", EVENT, order=(1, 0, 0))
    return causal.abnormal_sum(g, BY).select("series", "n", F.round("car", 1).alias("car"), F.round("z", 5).alias("z"))


@query()
def event_study_by_aic(spark: SparkSession, d: str) -> DataFrame:
    """C09, C11 with an order found by AIC, as the defaults have it."""
    return causal.abnormal_sum(causal.baseline_gaps(daily_orders(spark, d), BY, "day", "value", EVENT), BY)


@query()
def campaign_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Effect, windows, permutation p and, for one series, the synthetic effect."""
    return causal.evaluate_campaign(daily_orders(spark, d), BY, "day", "value", EVENT, treated="1-URGENT")


@query("SELECT article, lang, count(*) AS n FROM (SELECT DISTINCT ON (article, source) article, source, lang FROM documents WHERE article IS NOT NULL ORDER BY article, source, doc_id) GROUP BY 1, 2")
def first_crawls(spark: SparkSession, d: str) -> DataFrame:
    """The first document of each article and source, counted by language."""
    docs = table(spark, d, "documents").where("article is not null").select("article", "source", "doc_id", "lang")
    return etl.keep_first(docs, ["article", "source"], ["doc_id"]).groupBy("article", "lang").agg(F.count(F.lit(1)).alias("n"))
