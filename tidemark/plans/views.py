"""Domain views over the test tables, as DataFrames and, for the SQL checks, as DuckDB text.

Companies are suppliers: sector is the region, and the repository figures come from their
line items. Daily series are order totals by priority. Views and edits are the tables' own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.etl import DEVICES
from ..sources.tables import table


def companies(spark: SparkSession, d: str, ranked: bool = False) -> DataFrame:
    """company_id, name, sector, stars, forks, contributors, employees, revenue and, if asked for, revenue_rank."""
    from ..operators.ranking import global_rank

    regions = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    sold = table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("stars"),
        F.countDistinct("l_orderkey").alias("forks"),
        F.countDistinct("l_partkey").alias("contributors"),
        F.sum("l_quantity").cast("long").alias("employees"),
        F.round(F.sum("l_extendedprice"), 2).alias("revenue"),
    )
    joined = (
        table(spark, d, "supplier")
        .join(sold, F.col("s_suppkey") == F.col("l_suppkey"))
        .join(regions, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(F.col("s_suppkey").alias("company_id"), F.col("s_name").alias("name"), F.col("r_name").alias("sector"), "stars", "forks", "contributors", "employees", "revenue")
    )
    return global_rank(joined, "revenue", ["company_id"], "revenue_rank", descending=True).drop("n") if ranked else joined


COMPANIES = """
sold AS (SELECT l_suppkey, count(*) AS stars, count(DISTINCT l_orderkey) AS forks, count(DISTINCT l_partkey) AS contributors,
         CAST(sum(l_quantity) AS BIGINT) AS employees, round(sum(l_extendedprice), 2) AS revenue FROM lineitem GROUP BY 1),
companies AS (SELECT s_suppkey AS company_id, s_name AS name, r_name AS sector, stars, forks, contributors, employees, revenue,
         row_number() OVER (ORDER BY revenue DESC, s_suppkey) AS revenue_rank
         FROM supplier JOIN sold ON s_suppkey = l_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def daily_orders(spark: SparkSession, d: str) -> DataFrame:
    """series, day, value: order totals by priority and day."""
    return (
        table(spark, d, "orders")
        .groupBy(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("day"))
        .agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    )


DAILY_ORDERS = """
daily AS (SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS day, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2)"""


def readings(spark: SparkSession, d: str) -> DataFrame:
    """article, day, device_type, human, bot, views: the valid page views, each reading once."""
    v = table(spark, d, "pageviews")
    return (
        v.where(F.col("article").isNotNull() & F.col("timestamp").isNotNull() & (F.col("views_human") >= 0) & (F.col("views_bot") >= 0) & (F.col("views_total") == F.col("views_human") + F.col("views_bot")) & F.col("device_type").isin(*DEVICES))
        .groupBy("article", F.to_date("timestamp").alias("day"), "device_type")
        .agg(F.max("views_human").alias("human"), F.max("views_bot").alias("bot"), F.max("views_total").alias("views"))
    )


READINGS = """
readings AS (SELECT article, CAST(timestamp AS DATE) AS day, device_type, max(views_human) AS human, max(views_bot) AS bot, max(views_total) AS views
             FROM pageviews WHERE article IS NOT NULL AND timestamp IS NOT NULL AND views_human >= 0 AND views_bot >= 0 AND views_total = views_human + views_bot
             AND device_type IN ('desktop', 'mobile-web', 'mobile-app') GROUP BY 1, 2, 3)"""


def edits(spark: SparkSession, d: str) -> DataFrame:
    """article, revision_id, timestamp, editor_id, editor_type, is_reverted, bytes_changed: revisions with article and time, each as last delivered."""
    from ..operators.features import latest_deliveries

    columns = ["article", "timestamp", "editor_id", "editor_type", "is_reverted", "bytes_changed", "edit_summary"]
    latest = latest_deliveries(table(spark, d, "revisions"), "revision_id", "fetched_at", columns)
    return latest.where(F.col("article").isNotNull() & F.col("timestamp").isNotNull()).select(F.col("__id").alias("revision_id"), *columns)


EDITS = """
ranked_edits AS (SELECT *, row_number() OVER (PARTITION BY revision_id ORDER BY fetched_at DESC NULLS LAST, article DESC NULLS LAST, timestamp DESC NULLS LAST, editor_id DESC NULLS LAST,
    editor_type DESC NULLS LAST, is_reverted DESC NULLS LAST, bytes_changed DESC NULLS LAST, edit_summary DESC NULLS LAST) AS k FROM revisions WHERE revision_id IS NOT NULL),
edits AS (SELECT revision_id, article, timestamp, editor_id, editor_type, is_reverted, bytes_changed, edit_summary FROM ranked_edits
    WHERE k = 1 AND article IS NOT NULL AND timestamp IS NOT NULL)"""


def article_days(spark: SparkSession, d: str) -> DataFrame:
    """The daily aggregate of articles: article, day, total_views, growth (percent to the day before with rows), edit_count, reverted."""
    from pyspark.sql import Window

    w = Window.partitionBy("article").orderBy("day")  # one row per article and day: bounded by the time covered
    views = readings(spark, d).groupBy("article", "day").agg(F.sum("views").alias("total_views"))
    changed = edits(spark, d).groupBy("article", F.to_date("timestamp").alias("day")).agg(
        F.count(F.lit(1)).alias("edit_count"), F.count_if(F.coalesce("is_reverted", F.lit(False))).alias("reverted")
    )
    before = F.lag("total_views").over(w)
    return (
        views.withColumn("growth", F.try_divide((F.col("total_views") - before) * 100.0, before))
        .join(changed, ["article", "day"], "left")
        .fillna(0, ["edit_count", "reverted"])
    )


ARTICLE_DAYS = (
    READINGS
    + ","
    + EDITS
    + """,
day_views AS (SELECT article, day, CAST(sum(views) AS BIGINT) AS total_views FROM readings GROUP BY 1, 2),
day_growth AS (SELECT *, (total_views - lag(total_views) OVER w) * 100.0 / nullif(lag(total_views) OVER w, 0) AS growth FROM day_views WINDOW w AS (PARTITION BY article ORDER BY day)),
day_edits AS (SELECT article, CAST(timestamp AS DATE) AS day, count(*) AS edit_count, count(*) FILTER (coalesce(is_reverted, false)) AS reverted FROM edits GROUP BY 1, 2),
article_days AS (SELECT g.article, g.day, total_views, growth, coalesce(edit_count, 0) AS edit_count, coalesce(reverted, 0) AS reverted
    FROM day_growth g LEFT JOIN day_edits e ON g.article = e.article AND g.day = e.day)"""
)
