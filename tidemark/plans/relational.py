"""Validation, joins, aggregates, ranking and reshaping, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import metrics as m
from ..operators import etl, joins, ranking
from ..operators.stats import safe_corr
from ..sources.tables import table
from .views import (
    ARTICLE_DAYS, COMPANIES, DAILY_ORDERS, EDITS, READINGS, article_days, companies, daily_orders, edits, readings,
)

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    """Register a query under its function's name, with its SQL."""

    def register(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def r6(c, name: str | None = None):  # noqa: ANN001, ANN201
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6).alias(name) if name else F.round(c, 6)


# Validation and loading

_BAD_VIEWS = """CASE WHEN article IS NULL OR trim(article) = '' THEN 'empty article'
  WHEN NOT coalesce(views_human >= 0 AND views_bot >= 0 AND views_total >= 0, false) THEN 'negative count'
  WHEN NOT coalesce(views_total = views_human + views_bot, false) THEN 'total mismatch'
  WHEN NOT coalesce(device_type IN ('desktop', 'mobile-web', 'mobile-app'), false) THEN 'unknown device' END"""
_BAD_REVISION = """CASE WHEN article IS NULL OR trim(article) = '' THEN 'empty article' WHEN NOT coalesce(revision_id > 0, false) THEN 'bad revision'
  WHEN NOT coalesce(editor_type IN ('anonymous', 'registered'), false) THEN 'unknown editor type' END"""


@query(f"SELECT {_BAD_VIEWS} AS reason, count(*) AS n, CAST(sum(views_total) AS BIGINT) AS views FROM pageviews GROUP BY 1")
def etl_pageview_validation(spark: SparkSession, d: str) -> DataFrame:
    """Rows and views by the first rule they break."""
    return etl.with_reason(table(spark, d, "pageviews"), etl.pageview_rules()).groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.sum("views_total").alias("views"))


@query(f"SELECT {_BAD_REVISION} AS reason, revision_id, fetched_at FROM revisions WHERE {_BAD_REVISION} IS NOT NULL")
def etl_revision_quarantine(spark: SparkSession, d: str) -> DataFrame:
    """The revisions to set aside, with the reason."""
    return etl.split_valid(table(spark, d, "revisions"), etl.revision_rules())[1].select("reason", "revision_id", "fetched_at")


@query("""SELECT CASE WHEN title IS NULL OR trim(title) = '' THEN 'missing title' WHEN NOT coalesce(starts_with(url, 'http'), false) THEN 'bad url' END AS reason, count(*) AS n
          FROM dim_articles GROUP BY 1""")
def etl_article_validation(spark: SparkSession, d: str) -> DataFrame:
    """P05."""
    return etl.with_reason(table(spark, d, "dim_articles"), etl.article_rules()).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT article, timestamp, device_type, min(fetched_at) AS fetched_at FROM pageviews GROUP BY 1, 2, 3""")
def etl_first_seen_pageviews(spark: SparkSession, d: str) -> DataFrame:
    """The first delivery of each reading."""
    rows = table(spark, d, "pageviews").select("article", "timestamp", "device_type", "fetched_at")
    return etl.keep_first(rows, ["article", "timestamp", "device_type"], ["fetched_at"])


@query("SELECT revision_id, min(fetched_at) AS fetched_at FROM revisions GROUP BY 1")
def etl_first_seen_revisions(spark: SparkSession, d: str) -> DataFrame:
    """The first delivery of each revision."""
    return etl.keep_first(table(spark, d, "revisions").select("revision_id", "fetched_at"), ["revision_id"], ["fetched_at"])


@query("""SELECT DISTINCT coalesce(article, '') AS article, crawl_timestamp FROM documents WHERE article IS NOT NULL""")
def etl_distinct_crawls(spark: SparkSession, d: str) -> DataFrame:
    """One row per title and time of crawl."""
    rows = table(spark, d, "documents").where("article is not null").select("article", "crawl_timestamp")
    return etl.keep_first(rows, ["article", "crawl_timestamp"], [])


@query("""SELECT article_id, date_id, hour, device_type, arg_max({'v': views_human}, id).v AS views_human, arg_max({'v': views_bot}, id).v AS views_bot, arg_max({'v': views_total}, id).v AS views_total
          FROM fact_pageviews GROUP BY 1, 2, 3, 4""")
def etl_upsert_pageviews(spark: SparkSession, d: str) -> DataFrame:
    """The slots after the log's second half is upserted into its first."""
    log = table(spark, d, "fact_pageviews")
    middle = log.agg(F.percentile_approx("id", 0.5).alias("__m"))
    both = log.crossJoin(F.broadcast(middle))
    key, values = ["article_id", "date_id", "hour", "device_type"], ["views_human", "views_bot", "views_total"]
    empty = log.limit(0).select(*key, *values)
    first = etl.upsert(empty, both.where("id <= __m").select(*key, *values, "id"), key, "id")
    return etl.upsert(first, both.where("id > __m").select(*key, *values, "id"), key, "id")


@query("""SELECT revision_id, arg_max({'v': is_reverted}, id).v AS is_reverted, arg_max({'v': bytes_changed}, id).v AS bytes_changed, arg_max({'v': edit_summary}, id).v AS edit_summary FROM fact_edits GROUP BY 1""")
def etl_upsert_edits(spark: SparkSession, d: str) -> DataFrame:
    """One row per revision, the last load wins."""
    log = table(spark, d, "fact_edits").select("revision_id", "is_reverted", "bytes_changed", "edit_summary", "id")
    return etl.upsert(log.limit(0).drop("id"), log, ["revision_id"], "id")


@query("""WITH seen AS (SELECT article AS title, max(crawl_timestamp) AS t FROM documents WHERE article IS NOT NULL GROUP BY 1)
          SELECT title, namespace, first_seen, greatest(last_updated, t) AS last_updated FROM (SELECT coalesce(a.title, s.title) AS title,
          CASE WHEN a.id IS NULL THEN 'Main' ELSE namespace END AS namespace, CASE WHEN a.id IS NULL THEN t ELSE first_seen END AS first_seen, last_updated, t
          FROM (SELECT * FROM dim_articles WHERE first_seen < TIMESTAMP '2005-01-01') a FULL JOIN seen s ON a.title = s.title)""")
def etl_article_dimension(spark: SparkSession, d: str) -> DataFrame:
    """Crawled titles are inserted into the dimension as it was at the end of 2004, or touched."""
    half = table(spark, d, "dim_articles").where("first_seen < timestamp_ntz'2005-01-01'")
    seen = table(spark, d, "documents").select(F.col("article").alias("title"), "crawl_timestamp")
    return etl.upsert_dimension(half, seen, "title", "crawl_timestamp", {"namespace": F.lit("Main")}).select("title", "namespace", "first_seen", "last_updated")


@query("""SELECT date, year, quarter, month, week, day_of_week, is_weekend FROM dim_dates""")
def etl_date_dimension(spark: SparkSession, d: str) -> DataFrame:
    """The parts of every date worked out anew."""
    return etl.date_dimension(table(spark, d, "dim_dates").select("date"))


_FIELDS = ["id", "name", "sector", "revenue_rank", "employee_count", "github_org"]


def _missing(f: str) -> str:
    return f"({f} IS NULL" + (f" OR {f} = ''" if f == "github_org" else "") + ")"


@query(" UNION ALL ".join(
    f"SELECT '{f}' AS field, count(*) FILTER ({_missing(f)}) AS missing, round(100.0 * count(*) FILTER (NOT {_missing(f)}) / count(*), 6) AS completeness FROM company_snapshots" for f in _FIELDS))
def etl_company_quality(spark: SparkSession, d: str) -> DataFrame:
    """Missing values and completeness by field."""
    return etl.quality(table(spark, d, "company_snapshots"), "id", _FIELDS, ["github_org"]).withColumn("completeness", r6("completeness"))


@query("""WITH actual AS (SELECT DISTINCT CAST(timestamp AS DATE) AS day FROM revisions WHERE timestamp IS NOT NULL),
  expected AS (SELECT CAST(unnest(generate_series(DATE '2024-08-25', DATE '2024-11-20', INTERVAL 1 DAY)) AS DATE) AS day),
  missing AS (SELECT day, day - lag(day) OVER (ORDER BY day) AS gap FROM expected WHERE day NOT IN (SELECT day FROM actual))
  SELECT CAST(88 AS BIGINT) AS expected, (SELECT count(*) FROM actual) AS actual, count(*) AS missing, round((SELECT count(*) FROM actual) / 88.0, 6) AS score, count(*) <= 8.8 AS is_complete, CAST(max(gap) AS INTEGER) AS max_gap FROM missing""")
def etl_completeness(spark: SparkSession, d: str) -> DataFrame:
    """Days without an edit in a stated period."""
    days = table(spark, d, "revisions").where("timestamp is not null").select("timestamp")
    return etl.completeness(days, "timestamp", "2024-08-25", "2024-11-20").withColumn("score", r6("score"))


@query(f"WITH {DAILY_ORDERS}" + """, s AS (SELECT series, avg(value) AS mu, stddev_pop(value) AS sd FROM daily GROUP BY 1)
  SELECT d.series, day, value, round((value - mu) / sd, 6) AS z FROM daily d JOIN s ON d.series = s.series WHERE sd > 0 AND abs((value - mu) / sd) > 3""")
def etl_outliers(spark: SparkSession, d: str) -> DataFrame:
    """Days more than three deviations from their series' mean."""
    return etl.outliers(daily_orders(spark, d), "value", ["series"]).withColumn("z", r6("z"))


@query("SELECT count(*) AS n, count(*) FILTER (article IS NULL OR revision_id IS NULL OR timestamp IS NULL OR editor_type IS NULL OR editor_id IS NULL OR is_reverted IS NULL OR bytes_changed IS NULL) AS n_missing FROM revisions")
def etl_missing_flags(spark: SparkSession, d: str) -> DataFrame:
    """P12."""
    rows = table(spark, d, "revisions").drop("edit_summary", "fetched_at")
    return etl.has_missing(rows).agg(F.count(F.lit(1)).alias("n"), F.count_if("has_missing").alias("n_missing"))


@query(f"WITH {DAILY_ORDERS} SELECT day AS date, value AS values, series AS platform, 'orders' AS metric_type FROM daily WHERE day BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'")
def series_range(spark: SparkSession, d: str) -> DataFrame:
    """A series' rows in a closed range of dates."""
    return daily_orders(spark, d).where("day between date'1996-01-01' and date'1996-12-31'").select(
        F.col("day").alias("date"), F.col("value").alias("values"), F.col("series").alias("platform"), F.lit("orders").alias("metric_type")
    )


# Company scores

@query(f"WITH {COMPANIES}" + """, scored AS (SELECT *, (stars + forks) / CAST(employees AS DOUBLE) AS score, (stars + forks + contributors) / CAST(revenue_rank AS DOUBLE) AS maturity FROM companies),
  bounds AS (SELECT min(score) AS lo, max(score) AS hi, count(*) AS n FROM scored),
  placed AS (SELECT *, row_number() OVER (ORDER BY score, company_id) AS r FROM scored, bounds)
  SELECT company_id, round(score, 6) AS score, round(maturity, 6) AS maturity, round((score - lo) / nullif(hi - lo, 0) * 10, 6) AS normalized, CAST(least(10, floor((r - 1) * 10 / n) + 1) AS INTEGER) AS decile,
  CAST(least(10, floor((r - 1) / CAST(n - 1 AS DOUBLE) * 100 / 10) + 1) AS INTEGER) AS decile_by_percentile FROM placed""")
def company_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores, normalised scores and both definitions of deciles."""
    scored = companies(spark, d, ranked=True).withColumn("score", m.innovation_score(F.col("stars"), F.col("forks"), F.col("employees"))).withColumn(
        "maturity", m.digital_maturity(F.col("stars"), F.col("forks"), F.col("contributors"), F.col("revenue_rank"))
    )
    placed = ranking.global_rank(ranking.min_max(scored, "score"), "score", ["company_id"], "r")
    return placed.select(
        "company_id", r6("score", "score"), r6("maturity", "maturity"), r6("normalized", "normalized"),
        ranking.decile_by_count(F.col("r"), F.col("n")).alias("decile"), ranking.decile_by_percentile(F.col("r"), F.col("n")).alias("decile_by_percentile"),
    )


@query(f"WITH {COMPANIES}" + """, e AS (SELECT quantile_cont(CAST(stars AS DOUBLE), [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM companies)
  SELECT company_id, CAST(len(list_filter(q, lambda x: x < stars)) + 1 AS INTEGER) AS decile FROM companies, e""")
def company_quantile_bins(spark: SparkSession, d: str) -> DataFrame:
    """Deciles by interpolated quantile edges."""
    return ranking.quantile_bins(companies(spark, d), "stars", 10, "decile").select("company_id", "decile")


@query(f"WITH {COMPANIES}" + """, r AS (SELECT *, row_number() OVER (ORDER BY stars DESC, company_id) AS hi, row_number() OVER (ORDER BY stars, company_id) AS lo, count(*) OVER () AS n FROM companies)
  SELECT round(avg(revenue) FILTER (hi <= greatest(1, n // 4)), 6) AS top_avg, round(avg(revenue) FILTER (lo <= greatest(1, n // 4)), 6) AS bottom_avg,
  round(avg(revenue) FILTER (hi <= greatest(1, n // 4)) - avg(revenue) FILTER (lo <= greatest(1, n // 4)), 6) AS difference FROM r""")
def company_quartile_growth(spark: SparkSession, d: str) -> DataFrame:
    """Mean revenue of the top and bottom quarter by score."""
    base = companies(spark, d)
    top = ranking.top_share(base, "stars", ["company_id"]).agg(F.avg("revenue").alias("t"))
    bottom = ranking.top_share(base, "stars", ["company_id"], bottom=True).agg(F.avg("revenue").alias("b"))
    return top.crossJoin(bottom).select(r6("t", "top_avg"), r6("b", "bottom_avg"), r6(F.col("t") - F.col("b"), "difference"))


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, snapshot_id) AS k FROM company_snapshots WHERE updated_at IS NOT NULL),
  c AS (SELECT id, sector, employee_count FROM l WHERE k = 1), a AS (SELECT sector, avg(employee_count) AS mu FROM c GROUP BY 1)
  SELECT id, c.sector, employee_count, round(mu - employee_count, 6) AS gap FROM c JOIN a ON c.sector = a.sector WHERE employee_count < mu""")
def company_underperformers(spark: SparkSession, d: str) -> DataFrame:
    """The newest snapshot of each company, against its sector's mean."""
    newest = ranking.latest(table(spark, d, "company_snapshots").select("id", "sector", "employee_count", "updated_at", "snapshot_id"), "id", "updated_at", "snapshot_id")
    means = newest.groupBy("sector").agg(F.avg("employee_count").alias("mu"))
    return newest.join(means, "sector").where("employee_count < mu").select("id", "sector", "employee_count", r6(F.col("mu") - F.col("employee_count"), "gap"))


@query(f"WITH {COMPANIES}" + """, a AS (SELECT sector, avg(stars) AS s FROM companies GROUP BY 1)
  SELECT x.sector AS sector, y.sector AS against, round((x.s - y.s) / y.s * 100, 6) AS percent FROM a x JOIN a y ON x.sector <> y.sector""")
def sector_differences(spark: SparkSession, d: str) -> DataFrame:
    """Ordered pairs of sectors, percent difference of means."""
    return joins.pairwise_percent(companies(spark, d).groupBy("sector").agg(F.avg("stars").alias("value")), "sector", "value").select("sector", "against", r6("percent", "percent"))


@query(f"WITH {COMPANIES}" + """, long AS (SELECT company_id, sector, unnest(['stars', 'forks', 'contributors']) AS metric, unnest([stars, CASE WHEN revenue_rank > 10 THEN forks END, contributors]) AS v FROM companies),
  s AS (SELECT DISTINCT sector FROM companies), mm AS (SELECT DISTINCT metric FROM long WHERE v IS NOT NULL)
  SELECT s.sector, mm.metric, round(coalesce(avg(v), 0), 6) AS value FROM s CROSS JOIN mm LEFT JOIN long l ON l.sector = s.sector AND l.metric = mm.metric GROUP BY 1, 2""")
def sector_metric_means(spark: SparkSession, d: str) -> DataFrame:
    """Ragged metric maps to a dense grid of sector means."""
    c = companies(spark, d, ranked=True)
    ragged = c.select("sector", F.map_filter(F.create_map(F.lit("stars"), F.col("stars"), F.lit("forks"), F.when(F.col("revenue_rank") > 10, F.col("forks")), F.lit("contributors"), F.col("contributors")), lambda k, v: v.isNotNull()).alias("metrics"))
    return joins.dense_means(ragged, "sector", "metrics").withColumn("value", r6("value"))


@query(f"WITH {COMPANIES}" + """, a AS (SELECT sector, avg(stars) AS v FROM companies GROUP BY 1)
  SELECT (SELECT sector FROM a ORDER BY v DESC, sector LIMIT 1) AS highest, (SELECT sector FROM a ORDER BY v, sector LIMIT 1) AS lowest, round((max(v) - min(v)) / min(v) * 100, 6) AS lead FROM a""")
def sector_extrema(spark: SparkSession, d: str) -> DataFrame:
    """The best and worst sector; ties go to the first name."""
    a = companies(spark, d).groupBy("sector").agg(F.avg("stars").alias("v"))
    return a.agg(
        F.min_by("sector", F.struct(-F.col("v"), F.col("sector"))).alias("highest"), F.min_by("sector", F.struct("v", "sector")).alias("lowest"),
        r6((F.max("v") - F.min("v")) / F.min("v") * 100, "lead"),
    )


@query(f"WITH {COMPANIES}" + """, md AS (SELECT sector, median(stars) AS ms, median(revenue_rank) AS mr FROM companies GROUP BY 1)
  SELECT company_id, c.sector, stars, revenue_rank FROM companies c JOIN md ON c.sector = md.sector WHERE stars > ms AND revenue_rank > mr""")
def acquisition_targets(spark: SparkSession, d: str) -> DataFrame:
    """Companies over their sector's median score and rank."""
    c = companies(spark, d, ranked=True)
    med = c.groupBy("sector").agg(F.median("stars").alias("ms"), F.median("revenue_rank").alias("mr"))
    return c.join(med, "sector").where("stars > ms and revenue_rank > mr").select("company_id", "sector", "stars", "revenue_rank")


@query(f"WITH {COMPANIES}" + """, a AS (SELECT sector, unnest(['stars', 'forks']) AS metric, unnest([avg(stars), avg(forks)]) AS v FROM companies GROUP BY 1),
  md AS (SELECT metric, median(v) AS mid, count(*) AS n FROM a GROUP BY 1)
  SELECT a.metric, sector, round(v, 6) AS value FROM a JOIN md ON a.metric = md.metric WHERE n >= 2 AND v > mid""")
def best_practices(spark: SparkSession, d: str) -> DataFrame:
    """Sectors over the median of the sector means, by metric."""
    a = companies(spark, d).groupBy("sector").agg(F.avg("stars").alias("stars"), F.avg("forks").alias("forks")).unpivot("sector", ["stars", "forks"], "metric", "v")
    med = a.groupBy("metric").agg(F.median("v").alias("mid"), F.count(F.lit(1)).alias("n"))
    return a.join(med, "metric").where("n >= 2 and v > mid").select("metric", "sector", r6("v", "value"))


@query(f"WITH {COMPANIES}" + """ SELECT sector, count(*) AS n, round(avg(stars), 6) AS stars, round(avg(forks), 6) AS forks, round(avg(contributors), 6) AS contributors, round(avg(revenue), 6) AS revenue,
  round(count(*) / CAST((SELECT count(*) FROM companies) AS DOUBLE), 6) AS density FROM companies GROUP BY 1""")
def sector_profile(spark: SparkSession, d: str) -> DataFrame:
    """Several means, size and share of each sector."""
    g = companies(spark, d).groupBy("sector").agg(F.count(F.lit(1)).alias("n"), *(r6(F.avg(c), c) for c in ("stars", "forks", "contributors", "revenue")))
    whole = g.agg(F.sum("n").alias("all"))
    return g.crossJoin(F.broadcast(whole)).withColumn("density", r6(F.col("n") / F.col("all"))).drop("all")


@query(f"WITH {COMPANIES}" + """, d AS (SELECT sector, CAST(least(10, floor((row_number() OVER (ORDER BY stars, company_id) - 1) * 10 / count(*) OVER ()) + 1) AS INTEGER) AS decile, stars FROM companies)
  SELECT sector, """ + ", ".join(f"round(avg(stars) FILTER (decile = {k}), 6) AS d{k}" for k in range(1, 11)) + " FROM d GROUP BY 1")
def sector_decile_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Sector by decile, mean score, over a stated list of deciles."""
    placed = ranking.global_rank(companies(spark, d), "stars", ["company_id"], "r").withColumn("decile", ranking.decile_by_count(F.col("r"), F.col("n")))
    wide = placed.groupBy("sector").pivot("decile", list(range(1, 11))).agg(F.avg("stars"))
    return wide.select("sector", *(r6(F.col(str(k)), f"d{k}") for k in range(1, 11)))


@query(f"WITH {COMPANIES}" + """, z AS (SELECT company_id, unnest(['stars', 'forks', 'contributors']) AS metric, CAST(unnest([stars, forks, contributors]) AS DOUBLE) AS value FROM companies) SELECT * FROM z""")
def melt_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Wide to long."""
    return companies(spark, d).select("company_id", *(F.col(c).cast("double") for c in ("stars", "forks", "contributors"))).unpivot("company_id", ["stars", "forks", "contributors"], "metric", "value")


@query(f"WITH {COMPANIES}" + """, z AS (SELECT *, (stars - min(stars) OVER ()) / (max(stars) OVER () - min(stars) OVER () + 1e-9) AS a, (forks - min(forks) OVER ()) / (max(forks) OVER () - min(forks) OVER () + 1e-9) AS b FROM companies)
  SELECT company_id, round(a, 6) AS stars, round(b, 6) AS forks FROM z""")
def radar_scale(spark: SparkSession, d: str) -> DataFrame:
    """Columns scaled to 0..1."""
    return m.radar(companies(spark, d).select("company_id", "stars", "forks"), ["stars", "forks"]).select("company_id", r6("stars", "stars"), r6("forks", "forks"))


@query(f"WITH {COMPANIES}" + """ SELECT company_id, name, stars, revenue_rank, row_number() OVER (ORDER BY stars DESC, company_id) AS place FROM companies WHERE sector IN ('ASIA', 'EUROPE')""")
def leaderboard(spark: SparkSession, d: str) -> DataFrame:
    """Scores and ranks joined, a sector filter, placed by score."""
    c = companies(spark, d, ranked=True)
    scores, ranks = c.select("company_id", "name", "sector", "stars"), c.select("company_id", "revenue_rank")
    return joins.leaderboard(scores.where(F.col("sector").isin("ASIA", "EUROPE")), ranks, "company_id", "stars").select("company_id", "name", "stars", "revenue_rank", F.col("place"))


@query(f"WITH {COMPANIES}" + " SELECT company_id, place FROM (SELECT company_id, row_number() OVER (ORDER BY stars DESC, company_id) AS place FROM companies) WHERE place BETWEEN 11 AND 20")
def leaderboard_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of ten, numbered over the whole."""
    return ranking.global_rank(companies(spark, d), "stars", ["company_id"], "place", descending=True).where("place between 11 and 20").select("company_id", "place")


@query(f"WITH {COMPANIES}" + " SELECT company_id, stars FROM companies ORDER BY stars DESC, company_id LIMIT 10")
def top_ten(spark: SparkSession, d: str) -> DataFrame:
    """A top-k report."""
    return companies(spark, d).select("company_id", "stars").orderBy(F.desc("stars"), "company_id").limit(10)


@query(f"WITH {COMPANIES}" + """ SELECT sector, company_id, stars, k FROM (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY stars DESC, company_id) AS k FROM companies) WHERE k <= 10""")
def top_per_sector(spark: SparkSession, d: str) -> DataFrame:
    """Top ten of each group; Spark limits each partition's groups before the shuffle."""
    w = Window.partitionBy("sector").orderBy(F.desc("stars"), "company_id")
    return companies(spark, d).withColumn("k", F.row_number().over(w).cast("long")).where("k <= 10").select("sector", "company_id", "stars", "k")


# Articles

@query(f"WITH {ARTICLE_DAYS}" + """ SELECT article, CAST(sum(total_views) AS BIGINT) AS views, round(avg(total_views), 6) AS avg_views, round(coalesce(avg(growth), 0), 6) AS avg_growth, CAST(sum(edit_count) AS BIGINT) AS edits FROM article_days GROUP BY 1""")
def competitor_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Views, growth and edits by article."""
    return article_days(spark, d).groupBy("article").agg(
        F.sum("total_views").alias("views"), r6(F.avg("total_views"), "avg_views"), r6(F.coalesce(F.avg("growth"), F.lit(0.0)), "avg_growth"), F.sum("edit_count").alias("edits")
    )


@query(f"WITH {ARTICLE_DAYS}" + """ SELECT article, day, total_views, round(growth, 6) AS growth, edit_count, reverted,
  round(0.3 * least(edit_count / 24.0 / 100, 1) + 0.4 * coalesce(reverted / nullif(CAST(edit_count AS DOUBLE), 0), 0), 6) AS risk FROM article_days""")
def article_metrics_daily(spark: SparkSession, d: str) -> DataFrame:
    """The daily aggregate table with a risk from velocity and reverts."""
    return article_days(spark, d).withColumn(
        "risk", r6(m.reputation_risk(F.col("edit_count") / 24.0, F.coalesce(F.try_divide(F.col("reverted") * 100.0, F.col("edit_count")), F.lit(0.0)), F.lit(0.0)))
    ).withColumn("growth", r6("growth"))


@query(f"WITH {ARTICLE_DAYS}" + """, z AS (SELECT article, day, reverted / nullif(CAST(edit_count AS DOUBLE), 0) AS risk FROM article_days)
  SELECT article, day, round(risk, 6) AS risk, CASE WHEN risk >= 0.7 THEN 'high' WHEN risk >= 0.5 THEN 'medium' ELSE 'low' END AS level, round(least(risk * 50, 100), 6) AS vandalism FROM z WHERE risk > 0.3""")
def reputation_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Risk over a floor, in levels."""
    risk = F.try_divide(F.col("reverted").cast("double"), F.col("edit_count"))
    return article_days(spark, d).withColumn("x", risk).where("x > 0.3").select(
        "article", "day", r6("x", "risk"), m.level(F.col("x"), 0.7, 0.5).alias("level"), r6(F.least(F.col("x") * 50, F.lit(100.0)), "vandalism")
    )


@query(f"WITH {READINGS}" + """ SELECT day, article, device_type, CAST(sum(views) AS BIGINT) AS views, CAST(sum(bot) AS BIGINT) AS bots, round(coalesce(sum(bot) * 100.0 / nullif(sum(views), 0), 0), 6) AS bot_share
  FROM readings GROUP BY GROUPING SETS ((day, article), (device_type), (day))""")
def view_totals(spark: SparkSession, d: str) -> DataFrame:
    """Sums by (day, article), device and day in one pass of grouping sets."""
    return readings(spark, d).groupingSets([["day", "article"], ["device_type"], ["day"]], "day", "article", "device_type").agg(
        F.sum("views").alias("views"), F.sum("bot").alias("bots"), r6(F.coalesce(F.try_divide(F.sum("bot") * 100.0, F.sum("views")), F.lit(0.0)), "bot_share")
    )


@query(f"WITH {READINGS}" + """, v AS (SELECT article, CAST(sum(views) AS BIGINT) AS views FROM readings GROUP BY 1)
  SELECT coalesce(namespace, 'Unknown') AS namespace, count(*) AS articles, CAST(sum(views) AS BIGINT) AS views FROM v JOIN dim_articles a ON v.article = a.title GROUP BY 1""")
def namespace_leaderboard(spark: SparkSession, d: str) -> DataFrame:
    """Facts joined to the article dimension, grouped by its attribute."""
    v = readings(spark, d).groupBy("article").agg(F.sum("views").alias("views"))
    a = table(spark, d, "dim_articles").select(F.col("title").alias("article"), "namespace")
    return v.join(a, "article").groupBy(F.coalesce("namespace", F.lit("Unknown")).alias("namespace")).agg(F.count(F.lit(1)).alias("articles"), F.sum("views").alias("views"))


@query("SELECT title FROM dim_articles WHERE title IS NOT NULL ORDER BY 1")
def article_titles(spark: SparkSession, d: str) -> DataFrame:
    """S19."""
    return table(spark, d, "dim_articles").select("title").where("title is not null").orderBy("title")


@query("SELECT DISTINCT namespace FROM dim_articles WHERE namespace IS NOT NULL")
def namespaces(spark: SparkSession, d: str) -> DataFrame:
    """S20."""
    return table(spark, d, "dim_articles").select("namespace").where("namespace is not null").distinct().orderBy("namespace")


@query(f"WITH {EDITS}" + """, k AS (SELECT *, CASE WHEN lower(trim(editor_type)) = 'anonymous' THEN 1 ELSE 0 END AS anon, CASE WHEN coalesce(is_reverted, false) THEN 1 ELSE 0 END AS rev FROM edits)
  SELECT article, count(*) AS edits, CAST(sum(rev) AS BIGINT) AS reverted, round(sum(rev) * 100.0 / count(*), 6) AS vandalism, round(sum(anon) * 100.0 / count(*), 6) AS anonymous, round(count(*) / 24.0, 6) AS velocity,
  round(0.3 * least(count(*) / 24.0 / 100, 1) + 0.4 * (sum(rev) / CAST(count(*) AS DOUBLE)) + 0.3 * (sum(anon) / CAST(count(*) AS DOUBLE)), 6) AS risk FROM k GROUP BY 1""")
def edit_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Rates and risk of each article."""
    return m.edit_metrics(edits(spark, d), 24).select("article", "edits", "reverted", r6("vandalism", "vandalism"), r6("anonymous", "anonymous"), r6("velocity", "velocity"), r6("risk", "risk"))


_WINDOWS = (24, 168, 720)


@query(f"WITH {EDITS}" + ", l AS (SELECT article, max(timestamp) AS newest FROM edits GROUP BY 1) SELECT e.article, " + ", ".join(
    f"count(*) FILTER (timestamp >= newest - INTERVAL {h} HOUR) AS edits_{h}, count(*) FILTER (timestamp >= newest - INTERVAL {h} HOUR AND coalesce(is_reverted, false)) AS reverted_{h}" for h in _WINDOWS) + " FROM edits e JOIN l ON e.article = l.article GROUP BY 1")
def edit_windows(spark: SparkSession, d: str) -> DataFrame:
    """Trailing windows anchored at each article's newest edit."""
    return m.anchored_windows(edits(spark, d), "article", "timestamp", _WINDOWS)


@query(f"WITH {EDITS}" + """, s AS (SELECT article, count(*) AS n, date_diff('microsecond', min(timestamp), max(timestamp)) / 3.6e9 AS h FROM edits GROUP BY 1)
  SELECT article, round(n / CASE WHEN h >= 24 THEN 24 ELSE greatest(h, 0.001) END, 6) AS velocity FROM s""")
def edit_velocity(spark: SparkSession, d: str) -> DataFrame:
    """Edits per hour of the span, at most the window."""
    return m.edit_velocity(edits(spark, d), "article", "timestamp", 24).withColumn("velocity", r6("velocity"))


@query(f"WITH {EDITS}" + """ SELECT article, count(*) AS n, count(*) FILTER (regexp_matches(lower(coalesce(edit_summary, '')), 'revert|undo|undid|rollback|rv |restore')) AS flagged FROM edits GROUP BY 1""")
def summary_vandalism(spark: SparkSession, d: str) -> DataFrame:
    """Keywords in edit summaries."""
    return edits(spark, d).groupBy("article").agg(F.count(F.lit(1)).alias("n"), F.count_if(m.vandal_summary(F.col("edit_summary"))).alias("flagged"))


@query("""SELECT CASE WHEN regexp_full_match(editor_id, '\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}|([0-9a-fA-F]{0,4}:){2,7}[0-9a-fA-F]{0,4}') THEN 'anonymous' ELSE 'registered' END AS kind, count(*) AS n FROM revisions WHERE editor_id <> '' GROUP BY 1""")
def editor_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Addresses are anonymous editors."""
    rows = table(spark, d, "revisions").where("editor_id <> ''")
    return rows.groupBy(m.classify_editor(F.col("editor_id")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


# Joins by proximity

@query("""WITH v AS (SELECT CAST(timestamp AS DATE) AS day, device_type, CAST(sum(views_total) AS BIGINT) AS value FROM pageviews WHERE timestamp IS NOT NULL AND device_type IS NOT NULL GROUP BY 1, 2),
  e AS (SELECT CAST(timestamp AS DATE) AS day, count(*) AS n FROM revisions WHERE timestamp IS NOT NULL GROUP BY 1),
  vz AS (SELECT day FROM (SELECT day, sum(value) AS t FROM v GROUP BY 1) QUALIFY abs(t - avg(t) OVER ()) > 1.0 * stddev_pop(t) OVER ()),
  ez AS (SELECT day FROM e QUALIFY abs(n - avg(n) OVER ()) > 1.0 * stddev_pop(n) OVER ()),
  p AS (SELECT vz.day AS a, ez.day AS b, row_number() OVER (PARTITION BY vz.day ORDER BY abs(vz.day - ez.day), ez.day) AS k FROM vz JOIN ez ON abs(vz.day - ez.day) <= 3)
  SELECT a AS left_day, b AS right_day FROM p WHERE k = 1 UNION ALL SELECT day, NULL FROM vz WHERE day NOT IN (SELECT a FROM p) UNION ALL SELECT NULL, day FROM ez WHERE day NOT IN (SELECT b FROM p)""")
def matched_anomalies(spark: SparkSession, d: str) -> DataFrame:
    """Anomalies of two series within three days of each other, and those without a partner."""
    v = table(spark, d, "pageviews").where("timestamp is not null and device_type is not null").groupBy(F.to_date("timestamp").alias("day")).agg(F.sum("views_total").alias("x"))
    e = table(spark, d, "revisions").where("timestamp is not null").groupBy(F.to_date("timestamp").alias("day")).agg(F.count(F.lit(1)).alias("x"))
    a, b = (etl.outliers(t, "x", [], 1.0).select("day") for t in (v, e))
    return joins.match_within(a, b, "day", 3)


@query(f"WITH {EDITS}" + """, v AS (SELECT article, CAST(timestamp AS DATE) AS day, CAST(sum(views_total) AS BIGINT) AS views FROM pageviews WHERE article IS NOT NULL AND timestamp IS NOT NULL GROUP BY 1, 2)
  SELECT e.article, revision_id, max(v.day) AS views_day FROM edits e JOIN v ON v.article = e.article AND v.day <= CAST(e.timestamp AS DATE) AND v.day >= CAST(e.timestamp AS DATE) - 30 GROUP BY 1, 2""")
def views_as_of_edits(spark: SparkSession, d: str) -> DataFrame:
    """The latest day of views at or before each edit, by one sorted pass instead of a range join."""
    v = table(spark, d, "pageviews").where("article is not null and timestamp is not null").select("article", F.to_date("timestamp").alias("day")).distinct()
    return joins.as_of_day(edits(spark, d).select("article", "revision_id", F.to_date("timestamp").alias("day")), v, "article", "day", 30).where("matched is not null").select("article", "revision_id", F.col("matched").alias("views_day"))


@query("""WITH v AS (SELECT CAST(timestamp AS DATE) AS day, CAST(sum(views_total) AS BIGINT) AS views FROM pageviews WHERE timestamp IS NOT NULL GROUP BY 1),
  e AS (SELECT CAST(timestamp AS DATE) AS day, count(DISTINCT editor_id) AS editors FROM revisions WHERE timestamp IS NOT NULL GROUP BY 1),
  j AS (SELECT day, views, editors FROM v JOIN e USING (day) WHERE views > 0)
  SELECT count(*) AS n, round(corr(views, editors), 6) AS r, round(avg(editors * 1000.0 / views), 6) AS ratio, min(day) AS first_day, max(day) AS last_day FROM j""")
def views_editors_correlation(spark: SparkSession, d: str) -> DataFrame:
    """Two daily series joined on the day."""
    v = table(spark, d, "pageviews").where("timestamp is not null").groupBy(F.to_date("timestamp").alias("day")).agg(F.sum("views_total").alias("views"))
    e = table(spark, d, "revisions").where("timestamp is not null").groupBy(F.to_date("timestamp").alias("day")).agg(F.countDistinct("editor_id").alias("editors"))
    j = v.join(e, "day").where("views > 0")
    return j.agg(F.count(F.lit(1)).alias("n"), r6(safe_corr(F.col("views"), F.col("editors")), "r"), r6(F.avg(F.col("editors") * 1000.0 / F.col("views")), "ratio"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@query("""WITH a AS (SELECT DISTINCT article AS title FROM revisions WHERE article IS NOT NULL), b AS (SELECT DISTINCT article AS title FROM pageviews WHERE article IS NOT NULL)
  SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'edits only', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL
  SELECT 'views only', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT 'either', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)""")
def title_sets(spark: SparkSession, d: str) -> DataFrame:
    """Set operations on keys."""
    a, b = (table(spark, d, t).select("article").where("article is not null").distinct() for t in ("revisions", "pageviews"))
    parts = {"both": a.intersect(b), "edits only": a.subtract(b), "views only": b.subtract(a), "either": a.union(b).distinct()}
    counted = [x.agg(F.lit(k).alias("part"), F.count(F.lit(1)).alias("n")) for k, x in parts.items()]
    result = counted[0]
    for c in counted[1:]:
        result = result.unionByName(c)
    return result


@query("""WITH r AS (SELECT c_custkey, c_mktsegment, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey)
  SELECT c_mktsegment AS segment, count(DISTINCT c_custkey) AS customers, count(DISTINCT c_custkey) FILTER (o_orderkey IS NULL) AS without_orders, count(o_orderkey) AS orders FROM r GROUP BY 1 HAVING count(*) > 10""")
def segment_orders(spark: SparkSession, d: str) -> DataFrame:
    """A left join, distinct counts and a condition on the group."""
    j = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return (
        j.groupBy(F.col("c_mktsegment").alias("segment"))
        .agg(F.countDistinct("c_custkey").alias("customers"), F.countDistinct(F.when(F.col("o_orderkey").isNull(), F.col("c_custkey"))).alias("without_orders"), F.count("o_orderkey").alias("orders"), F.count(F.lit(1)).alias("all"))
        .where("all > 10").drop("all")
    )


@query("""SELECT weekday, """ + ", ".join(f"round(avg(v) FILTER (month = {k}), 6) AS m{k}" for k in range(1, 13)) + """ FROM (SELECT isodow(o_orderdate) - 1 AS weekday, month(o_orderdate) AS month, o_totalprice AS v FROM orders) GROUP BY 1""")
def weekday_month_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Weekday by month over a stated list of months."""
    o = table(spark, d, "orders").select(F.weekday("o_orderdate").cast("long").alias("weekday"), F.month("o_orderdate").alias("month"), F.col("o_totalprice").alias("v"))
    wide = o.groupBy("weekday").pivot("month", list(range(1, 13))).agg(F.avg("v"))
    return wide.select("weekday", *(r6(F.col(str(k)), f"m{k}") for k in range(1, 13)))


@query("""SELECT event_type, count(*) AS n, round(sum(value), 6) AS total, min(value) AS lowest, max(value) AS highest, round(avg(value), 6) AS mean, arg_max(value, (ts, event_id)) AS newest FROM events GROUP BY 1""")
def histogram_stats(spark: SparkSession, d: str) -> DataFrame:
    """Count, sum, bounds, mean and last value of a metric."""
    return table(spark, d, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("value"), "total"), F.min("value").alias("lowest"), F.max("value").alias("highest"), r6(F.avg("value"), "mean"), F.max_by("value", F.struct("ts", "event_id")).alias("newest")
    )


@query("""SELECT user_id, count(*) AS n, round(count(*) FILTER (event_type = 'error') / CAST(count(*) AS DOUBLE), 6) AS failure_rate, count(*) FILTER (event_type = 'error') / CAST(count(*) AS DOUBLE) > 0.1 AS alert FROM events GROUP BY 1""")
def failure_rates(spark: SparkSession, d: str) -> DataFrame:
    """A23."""
    rate = F.count_if(F.col("event_type") == "error") / F.count(F.lit(1))
    return table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), r6(rate, "failure_rate"), (rate > 0.1).alias("alert"))


@query("""SELECT md5(event_type || ':' || user_id || ':' || CAST(ts AS DATE)) AS alert, count(*) AS n, min(event_id) AS first_event FROM events GROUP BY 1""")
def alert_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Keys of alerts by hash."""
    key = m.hash_key(F.col("event_type"), F.col("user_id"), F.to_date("ts"))
    return table(spark, d, "events").groupBy(key.alias("alert")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


@query("""SELECT CAST(props->>'$.k' AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1""")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    """Fields of JSON text."""
    return table(spark, d, "events").groupBy(F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k")).agg(F.count(F.lit(1)).alias("n"))
