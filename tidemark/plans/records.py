"""Queries over logs, runs and derived scores, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics as m
from ..operators import graph, monitoring, query_text, series, stats
from ..sources.tables import table
from .relational import r6
from .views import ARTICLE_DAYS, COMPANIES, DAILY_ORDERS, READINGS, article_days, companies, daily_orders, readings

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def register(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query(f"WITH {ARTICLE_DAYS}, h AS (SELECT article, day, 0.5 * least(abs(coalesce(growth, 0)) / 1000, 1) + 0.3 * least(edit_count / 500.0, 1) + 0.2 * least(reverted / 300.0, 1) AS score FROM article_days) SELECT article, day, round(score, 6) AS score, score >= 0.75 AS is_trending FROM h")
def hype_scores(spark: SparkSession, d: str) -> DataFrame:
    """M06, M07."""
    score = m.hype_score(F.coalesce("growth", F.lit(0.0)), F.col("edit_count"), F.col("reverted"))
    return article_days(spark, d).select("article", "day", score.alias("s")).select("article", "day", r6("s", "score"), m.is_trending(F.col("s")).alias("is_trending"))


@query(f"WITH {READINGS} SELECT article, round(CAST(sum(views) AS BIGINT) / 7.0, 6) AS density FROM readings GROUP BY 1")
def attention_density(spark: SparkSession, d: str) -> DataFrame:
    """A05."""
    return monitoring.attention_density(readings(spark, d), ["article"], "views").withColumn("density", r6("density"))


@query(f"WITH {ARTICLE_DAYS}, b AS (SELECT article, avg(edit_count) AS base FROM article_days GROUP BY 1) SELECT a.article, day, edit_count FROM article_days a JOIN b ON a.article = b.article WHERE CASE WHEN base <= 0 THEN edit_count > 0 ELSE edit_count >= 3 * base END")
def edit_spikes(spark: SparkSession, d: str) -> DataFrame:
    """M10."""
    days = article_days(spark, d)
    base = days.groupBy("article").agg(F.avg("edit_count").alias("base"))
    return days.join(base, "article").where(m.is_edit_spike(F.col("edit_count"), F.col("base"))).select("article", "day", "edit_count")


@query("""SELECT event_id, event_type, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12' AND event_type = 'purchase'""")
def log_range(spark: SparkSession, d: str) -> DataFrame:
    """Records of a type in a closed range."""
    e = table(spark, d, "events")
    log = monitoring.metric_log(**{t: e.where(F.col("event_type") == t).withColumnRenamed("ts", "at") for t in ("purchase", "view", "error")})
    return monitoring.in_range(log, "2024-01-05", "2024-01-12", record_type="purchase").select("event_id", "event_type", "value")


@query("""SELECT ts, coalesce(value, 0.0) AS value FROM events WHERE event_type = 'view' AND year(ts) = 2024""")
def trend_rows(spark: SparkSession, d: str) -> DataFrame:
    """P15."""
    return monitoring.trend_rows(table(spark, d, "events").where("event_type = 'view'").withColumn("metric", F.lit(None).cast("double")), "ts", "metric", "value", [2024])


@query("""SELECT o_orderpriority AS priority, list_sort(list(DISTINCT o_orderstatus)) AS bins, round(avg(o_totalprice), 4) AS value FROM orders GROUP BY 1""")
def order_heatmap(spark: SparkSession, d: str) -> DataFrame:
    """A26."""
    return monitoring.heatmap(table(spark, d, "orders").withColumnRenamed("o_orderpriority", "priority"), "priority", "o_orderstatus", "o_totalprice").withColumn("value", F.round("value", 4))


@query("""WITH l AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 10) SELECT count(*) AS n, count(*) FILTER (event_type <> 'error') AS n_ok, round(count(*) FILTER (event_type <> 'error') / CAST(count(*) AS DOUBLE), 6) AS success_rate FROM l""")
def recent_health(spark: SparkSession, d: str) -> DataFrame:
    """The last ten runs (a report of stated size)."""
    runs = table(spark, d, "events").select(F.struct("ts", "event_id").alias("at"), (F.col("event_type") != "error").alias("ok"))
    return monitoring.recent_health(runs, "at", "ok").withColumn("success_rate", r6("success_rate"))


@query("""WITH f AS (SELECT user_id, arg_min(value, (ts, event_id)) AS baseline FROM events GROUP BY 1) SELECT event_id, e.user_id, value, baseline FROM events e JOIN f ON e.user_id = f.user_id WHERE value > 1.5 * baseline""")
def slow_runs(spark: SparkSession, d: str) -> DataFrame:
    """M16."""
    runs = table(spark, d, "events").withColumn("at", F.struct("ts", "event_id"))
    return monitoring.slow_runs(runs, "user_id", "at", "value").select("event_id", "user_id", "value", "baseline")


@query("""WITH g AS (SELECT *, date_diff('microsecond', lag(ts) OVER w, ts) AS gap FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts)) SELECT event_id FROM g WHERE gap IS NULL OR gap >= 3600000000""")
def alerts_once_an_hour(spark: SparkSession, d: str) -> DataFrame:
    """Z05, in batch."""
    return monitoring.deduplicated_alerts(table(spark, d, "events"), ["user_id", "event_type"], "ts").select("event_id")


@query(f"WITH {COMPANIES} SELECT sector, count(*) AS n FROM companies GROUP BY 1")
def counts_by_sector(spark: SparkSession, d: str) -> DataFrame:
    """G09."""
    return graph.counts_by_type(companies(spark, d), "sector")


@query("SELECT revision_id, count(*) AS n FROM fact_edits GROUP BY 1 HAVING count(*) > 1 OR revision_id IS NULL")
def repeated_revisions(spark: SparkSession, d: str) -> DataFrame:
    """Rows that break a uniqueness rule."""
    return graph.repeated_keys(table(spark, d, "fact_edits"), "revision_id")


@query("""SELECT s_name AS a_name, n_name AS b_name, s_acctbal AS a_balance FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 5000""")
def one_step_path(spark: SparkSession, d: str) -> DataFrame:
    """Supplier -LOCATED_IN-> nation with a condition."""
    s = table(spark, d, "supplier")
    edges = s.select(F.col("s_suppkey").alias("src"), F.col("s_nationkey").cast("long").alias("dst"), F.lit("LOCATED_IN").alias("type"))
    a = s.where("s_acctbal > 5000").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    b = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    return graph.neighbours(edges, "LOCATED_IN", a, b).select("a_name", "b_name", "a_balance")


@query("""SELECT n_regionkey AS region, count(*) AS n FROM nation GROUP BY 1""")
def text_query(spark: SparkSession, d: str) -> DataFrame:
    """SQL text that has been checked, over registered tables."""
    table(spark, d, "nation").createOrReplaceTempView("tidemark_nation")
    text = "SELECT n_regionkey AS region, count(*) AS n FROM tidemark_nation GROUP BY n_regionkey"
    query_text.check(spark, text)
    return spark.sql(text)


@query(f"WITH {DAILY_ORDERS}, r AS (SELECT series, day, value, avg(value) OVER (PARTITION BY series) AS m, stddev_pop(value) OVER (PARTITION BY series) AS s FROM daily) SELECT series, count(*) AS n, round(avg(value), 4) AS mean FROM r WHERE abs(value - m) <= 3 * s GROUP BY 1")
def without_outliers(spark: SparkSession, d: str) -> DataFrame:
    """X28."""
    return stats.without_outliers(daily_orders(spark, d), ["series"], "value").groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean"))


@query(f"WITH {DAILY_ORDERS}, r AS (SELECT 0 AS run, avg(value) AS v FROM daily UNION ALL SELECT 1, median(value) FROM daily), z AS (SELECT stddev_pop(v) / abs(avg(v)) AS cv, median(v) AS med FROM r) SELECT round(cv, 6) AS cv, cv < 0.15 AS is_stable, round(med, 4) AS median FROM z")
def method_comparison(spark: SparkSession, d: str) -> DataFrame:
    """A function over parameters, and whether its results agree."""
    daily = daily_orders(spark, d)
    runs = stats.over_parameters(lambda fn: daily.agg(fn("value").alias("v")), [{"fn": F.avg}, {"fn": F.median}])
    return stats.stability(runs, "v", 0.15).select(r6("cv", "cv"), "is_stable", F.round("median", 4).alias("median"))


@query(f"WITH {DAILY_ORDERS}, x AS (SELECT row_number() OVER (ORDER BY day) AS k, value FROM daily WHERE series = '1-URGENT'), y AS (SELECT row_number() OVER (ORDER BY day) AS k, value FROM daily WHERE series = '5-LOW') SELECT round(corr(x.value, y.value), 6) AS r, round(avg(x.value) / avg(y.value), 6) AS ratio, sign(regr_slope(x.value, x.k)) = sign(regr_slope(y.value, x.k)) AS same_direction FROM x JOIN y ON x.k = y.k")
def benchmark_comparison(spark: SparkSession, d: str) -> DataFrame:
    """X33."""
    daily = daily_orders(spark, d)
    out = stats.against_benchmark(daily.where("series = '1-URGENT'"), daily.where("series = '5-LOW'"), "day", "value")
    return out.select(r6("r", "r"), r6("ratio", "ratio"), "same_direction")


@query(f"WITH {DAILY_ORDERS} SELECT DISTINCT day, CAST(abs(day - DATE '1998-06-01') AS INTEGER) AS distance, abs(day - DATE '1998-06-01') <= 14 AS is_aligned FROM daily WHERE day BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'")
def event_alignment(spark: SparkSession, d: str) -> DataFrame:
    """D04."""
    days = daily_orders(spark, d).select("day").distinct().where("day between date'1998-01-01' and date'1998-12-31'")
    return stats.alignment(days, "day", "1998-06-01", "1998-01-01", "1998-12-31").select("day", "distance", "is_aligned")


@query(f"WITH {DAILY_ORDERS}, p AS (SELECT series, {', '.join(f'{f}(value) FILTER (isodow(day) {c} 6) AS {n}' for f, c, n in (('avg', '<', 'a'), ('avg', '>=', 'b')))} FROM daily GROUP BY 1) SELECT series, round((a - b) / b, 6) AS relative, CASE WHEN (a - b) / b > 0.1 THEN 'utility' WHEN (a - b) / b < -0.1 THEN 'leisure' ELSE 'mixed' END AS kind FROM p")
def utility_or_leisure(spark: SparkSession, d: str) -> DataFrame:
    """J02."""
    return series.utility_or_leisure(daily_orders(spark, d), ["series"], "day", "value").select("series", r6("relative", "relative"), "kind")


@query("""SELECT DISTINCT strftime(o_orderdate, '%Y%m%d') AS stamp, 'Q' || quarter(o_orderdate) || ' ' || year(o_orderdate) AS label, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS parsed FROM orders""")
def stamps(spark: SparkSession, d: str) -> DataFrame:
    """Stamps formatted and parsed again."""
    stamp = m.api_date(F.col("o_orderdate"))
    return table(spark, d, "orders").select(stamp.alias("stamp"), m.quarter_label(F.col("o_orderdate")).alias("label"), m.api_timestamp(stamp).alias("parsed")).distinct()


@query()
def pre_post_tests(spark: SparkSession, d: str) -> DataFrame:
    """X23."""
    return stats.pre_post(daily_orders(spark, d), ["series"], "day", "value", "1998-06-01")


@query()
def subsample_stability(spark: SparkSession, d: str) -> DataFrame:
    """X31."""
    return stats.subsamples(daily_orders(spark, d), ["series"], "value")
