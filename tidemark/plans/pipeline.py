"""Queries p1 to p6: the general operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features, heavy_keys, history, rolling, sessions, spikes
from ..sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The articles with more than 2.5 % of a fact table's rows."""
    found = [
        heavy_keys.heavy_keys(table(spark, d, name), "article_id", ["id"]).select(F.lit(name).alias("table_name"), "article_id")
        for name in ("fact_edits", "fact_pageviews")
    ]
    return found[0].unionByName(found[1])


def p1_edit_totals(spark: SparkSession, d: str) -> DataFrame:
    """Rows, bytes, reverted rows, first and last load of every article in fact_edits."""
    h = heavy_keys
    return h.keyed_states(
        table(spark, d, "fact_edits").withColumn("reverted", F.col("is_reverted").cast("int")),
        ["article_id"],
        ["id"],
        [h.count_rows("n_rows"), h.total("bytes_changed", "bytes_changed"), h.total("n_reverted", "reverted"), h.least("first_id", "id"), h.greatest("last_id", "id")],
    )


def p1_pageview_totals(spark: SparkSession, d: str) -> DataFrame:
    """Rows and views of every article in fact_pageviews; of a slot's loads the one with the greatest id counts."""
    h = heavy_keys
    slot = ["article_id", "date_id", "hour", "device_type"]
    newest = h.greatest("x", F.struct("id", "views_total"))
    slots = h.keyed_states(table(spark, d, "fact_pageviews"), slot, ["id"], [h.count_rows("n"), newest])
    return slots.groupBy("article_id").agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_slots"), F.sum(F.col("x.views_total").cast("long")).alias("views_total")
    )


def _revision_sessions(spark: SparkSession, d: str, distinct: str | None) -> DataFrame:
    return sessions.sessions(table(spark, d, "revisions"), "editor_id", "timestamp", "revision_id", distinct=distinct)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """First and last revision of every session."""
    return _revision_sessions(spark, d, None).select(
        "editor_id", F.col("first_id").alias("first_revision_id"), F.col("last_id").alias("last_revision_id")
    )


def p2_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Start, end, duration, revisions and articles of every session."""
    return _revision_sessions(spark, d, "article").select(
        "editor_id", "start", "end", "seconds", F.col("n_events").alias("n_revisions"), F.col("n_distinct").alias("n_articles")
    )


def _views(spark: SparkSession, d: str) -> DataFrame:
    return rolling.trailing_totals(table(spark, d, "pageviews"), "article", "timestamp", "views_total", ["device_type"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Days with no row on the day and the six before."""
    return _views(spark, d).where("active_7 = 0").select("article", F.date_format("day", "yyyy-MM-dd").alias("day"))


def p3_trailing_views(spark: SparkSession, d: str) -> DataFrame:
    """Trailing 7- and 30-day totals and averages of every article and day."""
    return _views(spark, d).select("article", "day", "total", "total_7", F.round("average_7", 6).alias("average_7"), "total_30", F.round("average_30", 6).alias("average_30"))


def _suspicious(spark: SparkSession, d: str) -> DataFrame:
    return spikes.suspicious_readings(
        table(spark, d, "pageviews"), ["article", "device_type"], "timestamp", "views_total", "views_bot", "views_human"
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Readings that are implausible, stuck, or over five medians; the fitted tail cannot change these rows and is left to p4_tails."""
    return (
        _suspicious(spark, d)
        .where("implausible or is_stuck or views_total_above or views_bot_above")
        .select("article", F.date_format("day", "yyyy-MM-dd").alias("day"), "device_type")
    )


def p4_tails(spark: SparkSession, d: str) -> DataFrame:
    """Every reading over its source's fitted cutoff, with residual and cutoff."""
    return (
        _suspicious(spark, d)
        .where("views_total_extreme or views_bot_extreme")
        .select(
            "article", "day", "device_type", "views_total", "views_bot",
            *(F.round(f"{c}_{m}", 6).alias(f"{c}_{m}") for c in ("views_total", "views_bot") for m in ("residual", "cutoff")),
        )
    )


def p5_history(spark: SparkSession, d: str) -> DataFrame:
    """Every version with its period."""
    return history.merged_history(table(spark, d, "company_snapshots"), "id", "updated_at", "snapshot_id", ["revenue_rank", "employee_count"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The start of every version."""
    return p5_history(spark, d).select("id", F.date_format("valid_from", "yyyy-MM-dd HH:mm:ss").alias("valid_from"))


def p6_edit_features(spark: SparkSession, d: str) -> DataFrame:
    """One row per article with count, total and recency of every kind of edit."""
    return features.edit_features(table(spark, d, "revisions"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_edit_totals, p1_pageview_totals, p2_found, p2_sessions, p3_found, p3_trailing_views,
        p4_found, p4_tails, p5_found, p5_history, p6_edit_features,
    )
}

_SESSIONS = """
WITH once AS (SELECT editor_id, timestamp AS t, revision_id AS r, max(article) AS article FROM revisions
              WHERE editor_id <> '' AND timestamp IS NOT NULL GROUP BY 1, 2, 3),
starts AS (SELECT *, CASE WHEN date_diff('microsecond', lag(t) OVER w, t) <= 1800000000 THEN 0 ELSE 1 END AS s
           FROM once WINDOW w AS (PARTITION BY editor_id ORDER BY t, r)),
numbered AS (SELECT *, sum(s) OVER (PARTITION BY editor_id ORDER BY t, r) AS n FROM starts)
"""

_CALENDAR = """
WITH reading AS (SELECT article, CAST(timestamp AS DATE) AS day, device_type, max(views_total) AS v FROM pageviews
                 WHERE article IS NOT NULL AND timestamp IS NOT NULL GROUP BY 1, 2, 3),
daily AS (SELECT article, day, CAST(coalesce(sum(v), 0) AS BIGINT) AS total FROM reading GROUP BY 1, 2),
nexts AS (SELECT *, lead(day) OVER (PARTITION BY article ORDER BY day) AS following FROM daily),
calendar AS (SELECT article, CAST(unnest(generate_series(day, CASE WHEN following - day <= 60 THEN following - 1 ELSE day END, INTERVAL 1 DAY)) AS DATE) AS day
             FROM nexts),
filled AS (SELECT c.article, c.day, coalesce(d.total, 0) AS total, CASE WHEN d.day IS NULL THEN 0 ELSE 1 END AS active
           FROM calendar c LEFT JOIN daily d ON c.article = d.article AND c.day = d.day),
rolled AS (SELECT *, sum(total) OVER w7 AS t7, sum(active) OVER w7 AS a7, sum(total) OVER w30 AS t30 FROM filled
           WINDOW w7 AS (PARTITION BY article ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW),
                  w30 AS (PARTITION BY article ORDER BY day RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW))
"""

#: The fitted tails of both counts, step by step as in ``spikes``.
_TAILS = """
WITH reading AS (SELECT article, CAST(timestamp AS DATE) AS day, device_type, max(views_total) AS t, max(views_bot) AS b
                 FROM pageviews WHERE article IS NOT NULL AND timestamp IS NOT NULL GROUP BY 1, 2, 3),
long AS (SELECT article, day, device_type, which, CASE WHEN which = 't' THEN t ELSE b END AS c, CASE WHEN which = 't' THEN ln(greatest(t, 0) + 1.0) ELSE ln(greatest(b, 0) + 1.0) END AS l0
         FROM reading, (VALUES ('t'), ('b')) w(which)),
logs AS (SELECT *, CASE WHEN c IS NOT NULL THEN l0 END AS l FROM long),
levels AS (SELECT *, median(l) OVER (PARTITION BY article, device_type, which) AS level FROM logs),
seasons AS (SELECT *, median(l - level) OVER (PARTITION BY article, device_type, which, (day - DATE '1970-01-01') % 7) AS season FROM levels),
residuals AS (SELECT *, l - level - season AS residual FROM seasons),
sources AS (SELECT article, device_type, which, quantile_cont(residual, 0.6) AS u, count(residual) AS n FROM residuals GROUP BY 1, 2, 3),
excesses AS (SELECT r.article, r.device_type, r.which, count(*) AS k, quantile_cont(residual - u, 0.5) AS q1, quantile_cont(residual - u, 0.75) AS q2
             FROM residuals r JOIN sources s ON r.article = s.article AND r.device_type IS NOT DISTINCT FROM s.device_type AND r.which = s.which WHERE residual > u GROUP BY 1, 2, 3),
shapes AS (SELECT s.*, k, q1, greatest(-0.5, least(0.5, log2(q2 / q1 - 1))) AS shape, 0.02 * n / k AS odds FROM sources s JOIN excesses e
           ON s.article = e.article AND s.device_type IS NOT DISTINCT FROM e.device_type AND s.which = e.which WHERE k >= 5),
tails AS (SELECT *, CASE WHEN abs(shape) < 1e-6 THEN u - q1 / ln(2.0) * ln(odds) ELSE u + q1 / (pow(2.0, shape) - 1) * (pow(odds, -shape) - 1) END AS cutoff FROM shapes),
signs AS (SELECT r.*, cutoff FROM residuals r LEFT JOIN tails s ON r.article = s.article AND r.device_type IS NOT DISTINCT FROM s.device_type AND r.which = s.which)
SELECT a.article, a.day, a.device_type, a.c AS views_total, z.c AS views_bot, round(a.residual, 6) AS views_total_residual, round(a.cutoff, 6) AS views_total_cutoff,
       round(z.residual, 6) AS views_bot_residual, round(z.cutoff, 6) AS views_bot_cutoff
FROM signs a JOIN signs z ON a.article = z.article AND a.day = z.day AND a.device_type IS NOT DISTINCT FROM z.device_type
WHERE a.which = 't' AND z.which = 'b' AND (a.residual > a.cutoff OR z.residual > z.cutoff)"""

_VERSIONS = """
WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY id, updated_at ORDER BY snapshot_id DESC) AS k FROM company_snapshots WHERE updated_at IS NOT NULL),
filled AS (SELECT id, updated_at, last_value(revenue_rank IGNORE NULLS) OVER w AS revenue_rank, last_value(employee_count IGNORE NULLS) OVER w AS employee_count
           FROM ranked WHERE k = 1 WINDOW w AS (PARTITION BY id ORDER BY updated_at ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
compared AS (SELECT *, row_number() OVER w AS n, lag(revenue_rank) OVER w AS r0, lag(employee_count) OVER w AS e0
             FROM filled WINDOW w AS (PARTITION BY id ORDER BY updated_at)),
versions AS (SELECT id, revenue_rank, employee_count, updated_at AS valid_from FROM compared
             WHERE n = 1 OR revenue_rank IS DISTINCT FROM r0 OR employee_count IS DISTINCT FROM e0)
"""


def _features_sql() -> str:
    kind = f"""CASE WHEN e IS NULL OR e = '' THEN 'unknown' WHEN e IN ('anonymous', 'registered') THEN e ELSE 'other' END || '_'
        || CASE WHEN is_reverted IS NULL THEN 'unclear' WHEN is_reverted THEN 'reverted' ELSE 'kept' END || '_'
        || CASE WHEN b IS NULL THEN 'nosize' WHEN b = 0 THEN 'same'
           ELSE CASE WHEN b > 0 THEN 'plus' ELSE 'minus' END || CAST(CAST(pow(2, least(floor(log2(abs(b))), {features.LARGEST})) AS BIGINT) AS VARCHAR) END"""
    columns = [f"coalesce(max(n) FILTER (kind = '{k}'), 0) AS n_{k}" for k in features.KINDS]
    columns += [f"max({m}) FILTER (kind = '{k}') AS {m}_{k}" for k in features.KINDS for m in ("bytes", "age")]
    return f"""
WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY revision_id ORDER BY fetched_at DESC NULLS LAST, article DESC NULLS LAST, timestamp DESC NULLS LAST,
    editor_type DESC NULLS LAST, is_reverted DESC NULLS LAST, bytes_changed DESC NULLS LAST) AS k FROM revisions WHERE revision_id IS NOT NULL),
kinds AS (SELECT article, timestamp AS t, lower(trim(editor_type)) AS e, is_reverted, CAST(bytes_changed AS BIGINT) AS b FROM ranked WHERE k = 1 AND article IS NOT NULL),
long AS (SELECT article, {kind} AS kind, count(*) AS n, max(t) AS latest, CAST(sum(b) AS BIGINT) AS bytes FROM kinds GROUP BY 1, 2),
aged AS (SELECT *, CAST(floor(date_diff('microsecond', latest, (SELECT max(latest) FROM long)) / 1000000) AS BIGINT) AS age FROM long)
SELECT article, {", ".join(columns)} FROM aged GROUP BY article"""


SQL = {
    "p1_found": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, article_id FROM {t} WHERE article_id IS NOT NULL GROUP BY article_id HAVING count(*) > 0.025 * (SELECT count(*) FROM {t})"
        for t in ("fact_edits", "fact_pageviews")
    ),
    "p1_edit_totals": """SELECT article_id, count(*) AS n_rows, CAST(sum(bytes_changed) AS BIGINT) AS bytes_changed,
        CAST(sum(CAST(is_reverted AS INTEGER)) AS BIGINT) AS n_reverted, min(id) AS first_id, max(id) AS last_id FROM fact_edits GROUP BY 1""",
    "p1_pageview_totals": """WITH slots AS (SELECT article_id, date_id, hour, device_type, count(*) AS n, arg_max({'v': views_total}, id).v AS v FROM fact_pageviews GROUP BY 1, 2, 3, 4)
        SELECT article_id, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_slots, CAST(sum(v) AS BIGINT) AS views_total FROM slots GROUP BY 1""",
    "p2_found": _SESSIONS + """SELECT editor_id, arg_min(r, (t, r)) AS first_revision_id, arg_max(r, (t, r)) AS last_revision_id FROM numbered GROUP BY editor_id, n""",
    "p2_sessions": _SESSIONS
    + """SELECT editor_id, min(t) AS "start", max(t) AS "end", date_diff('microsecond', min(t), max(t)) / 1000000.0 AS seconds,
        count(*) AS n_revisions, count(DISTINCT article) AS n_articles FROM numbered GROUP BY editor_id, n""",
    "p3_found": _CALENDAR + "SELECT article, strftime(day, '%Y-%m-%d') AS day FROM rolled WHERE a7 = 0",
    "p3_trailing_views": _CALENDAR
    + """SELECT article, day, total, CAST(t7 AS BIGINT) AS total_7, round(t7 / 7.0, 6) AS average_7, CAST(t30 AS BIGINT) AS total_30, round(t30 / 30.0, 6) AS average_30 FROM rolled""",
    "p4_found": """
WITH reading AS (SELECT article, CAST(timestamp AS DATE) AS day, device_type, max(views_total) AS t, max(views_bot) AS b, max(views_human) AS h
                 FROM pageviews WHERE article IS NOT NULL AND timestamp IS NOT NULL GROUP BY 1, 2, 3),
level AS (SELECT *, median(t) OVER s AS mt, median(b) OVER s AS mb, day - DATE '1970-01-01' - row_number() OVER (PARTITION BY article, device_type, t ORDER BY day) AS island
          FROM reading WINDOW s AS (PARTITION BY article, device_type)),
runs AS (SELECT *, count(*) OVER (PARTITION BY article, device_type, t, island) AS run FROM level)
SELECT article, strftime(day, '%Y-%m-%d') AS day, device_type FROM runs
WHERE t < 0 OR b < 0 OR h < 0 OR b > t OR t <> b + h OR t > 5 * mt OR b > 5 * mb OR (t IS NOT NULL AND run >= 5)""",
    "p4_tails": _TAILS,
    "p5_found": _VERSIONS + "SELECT id, strftime(valid_from, '%Y-%m-%d %H:%M:%S') AS valid_from FROM versions",
    "p5_history": _VERSIONS
    + """SELECT *, lead(valid_from) OVER (PARTITION BY id ORDER BY valid_from) AS valid_to,
        lead(valid_from) OVER (PARTITION BY id ORDER BY valid_from) IS NULL AS is_current FROM versions""",
    "p6_edit_features": _features_sql(),
}
