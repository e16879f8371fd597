"""Windows over daily series, statistics and causal effects, with SQL wherever no distribution function is involved."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import special
from ..operators import causal, joins, ranking, series, stats
from ..sources.tables import table
from .relational import r6
from .views import COMPANIES, DAILY_ORDERS, READINGS, companies, daily_orders, readings

QUERIES: dict = {}
SQL: dict[str, str] = {}
EVENT = "1998-06-01"
BY = ["series"]


def query(sql: str | None = None):  # noqa: ANN201
    def register(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_PLACED = f"WITH {DAILY_ORDERS}, placed AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY day) - 1 AS pos, count(*) OVER (PARTITION BY series) AS n FROM daily)"
_W = "WINDOW w AS (PARTITION BY series ORDER BY day)"


@query(f"WITH {DAILY_ORDERS}, z AS (SELECT *, lag(value) OVER w AS b FROM daily {_W}) SELECT series, day, round((value - b) / b * 100, 6) AS change FROM z WHERE b <> 0")
def series_change(spark: SparkSession, d: str) -> DataFrame:
    """W07, W08."""
    return series.change_to_previous(daily_orders(spark, d), BY, "day", "value").select("series", "day", r6("change", "change"))


@query(f"WITH {DAILY_ORDERS}, z AS (SELECT *, value - lag(value) OVER w AS b, lead(value) OVER w - value AS a FROM daily {_W}) SELECT series, day, value FROM z WHERE b * a < 0")
def series_inflections(spark: SparkSession, d: str) -> DataFrame:
    """W09."""
    return series.inflections(daily_orders(spark, d), BY, "day", "value").select("series", "day", "value")


@query("""WITH daily AS (SELECT CAST(user_id AS VARCHAR) AS series, CAST(ts AS DATE) AS day, count(*) AS value FROM events GROUP BY 1, 2),
  z AS (SELECT *, value - lag(value) OVER w AS b, lead(value) OVER w - value AS a FROM daily WINDOW w AS (PARTITION BY series ORDER BY day)) SELECT series, day, value FROM z WHERE (b > 0) <> (a > 0)""")
def series_inflections_with_plateaus(spark: SparkSession, d: str) -> DataFrame:
    """W10."""
    daily = table(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("series"), F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("value"))
    return series.inflections(daily, BY, "day", "value", plateaus=True)


_ARTICLE_DAILY = f"WITH {READINGS}, daily AS (SELECT article, day, CAST(sum(views) AS BIGINT) AS views FROM readings GROUP BY 1, 2)"


def _article_daily(spark: SparkSession, d: str) -> DataFrame:
    return readings(spark, d).groupBy("article", "day").agg(F.sum("views").alias("views"))


_SPIKE_CASES = " ".join(
    f"WHEN w = {w} THEN {{f}}(views) OVER (PARTITION BY article ORDER BY day ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)" for w in range(2, 8)
)


@query(_ARTICLE_DAILY + f""", p AS (SELECT *, row_number() OVER (PARTITION BY article ORDER BY day) - 1 AS pos, count(*) OVER (PARTITION BY article) AS n FROM daily),
  q AS (SELECT *, least(7, n - 1) AS w FROM p WHERE n >= 3),
  f AS (SELECT *, CASE {_SPIKE_CASES.format(f='avg')} END AS m, CASE {_SPIKE_CASES.format(f='stddev_samp')} END AS s FROM q),
  h AS (SELECT *, pos - row_number() OVER (PARTITION BY article ORDER BY day) AS island FROM f WHERE s > 0 AND views > m + 2 * s)
  SELECT article, min(day) AS first, max(day) AS last, count(*) AS days, max(views) AS peak, round((avg(views) - avg(m)) / avg(s), 6) AS magnitude, CASE WHEN count(*) > 7 THEN 'sustained' ELSE 'sudden' END AS kind FROM h GROUP BY article, island""")
def attention_spikes(spark: SparkSession, d: str) -> DataFrame:
    """Runs over the trailing mean and deviation."""
    return series.rolling_spikes(_article_daily(spark, d), ["article"], "day", "views").withColumn("magnitude", r6("magnitude"))


@query(_ARTICLE_DAILY + """, p AS (SELECT *, row_number() OVER (PARTITION BY article ORDER BY day) - 1 AS pos, count(*) OVER a AS n, avg(views) OVER a AS m, stddev_pop(views) OVER a AS s FROM daily WINDOW a AS (PARTITION BY article)),
  h AS (SELECT *, pos - row_number() OVER (PARTITION BY article ORDER BY day) AS island FROM p WHERE n >= 7 AND s > 0 AND views > m + 2 * s)
  SELECT article, min(day) AS first, max(day) AS last, count(*) AS days, round((avg(views) - max(m)) / max(s), 6) AS magnitude FROM h GROUP BY article, island""")
def hype_events(spark: SparkSession, d: str) -> DataFrame:
    """Runs over a global threshold."""
    return series.global_events(_article_daily(spark, d), ["article"], "day", "views").withColumn("magnitude", r6("magnitude"))


@query(_ARTICLE_DAILY + """, p AS (SELECT *, row_number() OVER (PARTITION BY article ORDER BY day) - 1 AS pos, count(*) OVER (PARTITION BY article) AS n FROM daily),
  g AS (SELECT article, max(views) FILTER (pos = greatest(n - 30, 0)) AS start_value, max(views) FILTER (pos = n - 1) AS end_value FROM p GROUP BY 1)
  SELECT *, round(CASE WHEN start_value = 0 THEN CASE WHEN end_value > 0 THEN 100.0 ELSE 0.0 END ELSE (end_value - start_value) / CAST(start_value AS DOUBLE) * 100 END, 6) AS growth FROM g""")
def article_growth(spark: SparkSession, d: str) -> DataFrame:
    """W15."""
    return series.growth_over(_article_daily(spark, d), ["article"], "day", "views").withColumn("growth", r6("growth"))


@query(f"WITH {DAILY_ORDERS}, s AS (SELECT *, value - lag(value) OVER w AS dd FROM daily {_W}), s2 AS (SELECT *, dd - lag(dd) OVER w AS d2 FROM s {_W}), "
       """g AS (SELECT series, arg_min(value, day) AS a, arg_max(value, day) AS b, (max(day) - min(day)) / 365.25 AS y, avg(d2) > 0 AS is_emerging FROM s2 GROUP BY 1)
  SELECT series, round((b / a - 1) * 100, 6) AS growth, round((pow(b / a, 1 / y) - 1) * 100, 6) AS cagr, is_emerging FROM g""")
def topic_growth(spark: SparkSession, d: str) -> DataFrame:
    """A04, W16, W17."""
    return series.topic_growth(daily_orders(spark, d), BY, "day", "value").select("series", r6("growth", "growth"), r6("cagr", "cagr"), "is_emerging")


@query(f"WITH {DAILY_ORDERS}, f AS (SELECT series, min(day) AS f FROM daily GROUP BY 1) "
       """SELECT d.series, round((arg_max(value, day) / arg_min(value, day) - 1) * 100 * sum(value) / greatest(1, sum(value) FILTER (day - f <= 7)), 4) AS relative, CAST(max(day) - min(day) + 1 AS INTEGER) AS period FROM daily d JOIN f ON d.series = f.series GROUP BY 1""")
def industry_comparison(spark: SparkSession, d: str) -> DataFrame:
    """W18."""
    return series.baseline_growth(daily_orders(spark, d), BY, "day", "value").select("series", F.round("relative", 4).alias("relative"), "period")


_SHIFT = "count(value) OVER {0} AS n_{1}, avg(value) OVER {0} AS m_{1}, var_samp(value) OVER {0} AS v_{1}"


@query(_PLACED + ", f AS (SELECT *, " + _SHIFT.format("a", "a") + ", " + _SHIFT.format("b", "b") + """ FROM placed WINDOW a AS (PARTITION BY series ORDER BY day ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY series ORDER BY day ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING))
  SELECT series, day, round(m_a, 4) AS mean_a, round(m_b, 4) AS mean_b, round((m_a - m_b) / (sqrt((29 * v_a + 29 * v_b) / 58) * sqrt(2 / 30.0)), 6) AS statistic FROM f WHERE pos >= 30 AND pos < n - 30""")
def engagement_shifts(spark: SparkSession, d: str) -> DataFrame:
    """T statistics of the 30 rows before and after every row."""
    return series.window_shifts(daily_orders(spark, d), BY, "day", "value").select("series", "day", F.round("mean_a", 4).alias("mean_a"), F.round("mean_b", 4).alias("mean_b"), r6("statistic", "statistic"))


@query(f"WITH {DAILY_ORDERS} SELECT series, day, round(avg(value) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS mean_7, round(avg(value) OVER (w ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 4) AS mean_30 FROM daily {_W}")
def trailing_means(spark: SparkSession, d: str) -> DataFrame:
    """W23."""
    return series.trailing_means(daily_orders(spark, d), BY, "day", "value").select("series", "day", F.round("mean_7", 4).alias("mean_7"), F.round("mean_30", 4).alias("mean_30"))


@query(f"WITH {DAILY_ORDERS}, m AS (SELECT series, CAST(date_trunc('month', day) AS DATE) AS month, avg(value) AS mean FROM daily GROUP BY 1, 2) SELECT series, month, round(mean, 4) AS mean, round((mean - lag(mean) OVER w) * 100 / lag(mean) OVER w, 6) AS change FROM m WINDOW w AS (PARTITION BY series ORDER BY month)")
def monthly_change(spark: SparkSession, d: str) -> DataFrame:
    """W24."""
    return series.monthly_change(daily_orders(spark, d), BY, "day", "value").select("series", "month", F.round("mean", 4).alias("mean"), r6("change", "change"))


@query(f"WITH {DAILY_ORDERS}" + """, s AS (SELECT series, CAST(date_trunc('week', day) AS DATE) AS bucket, sum(value) AS total FROM daily GROUP BY 1, 2),
  g AS (SELECT series, CAST(unnest(generate_series(min(bucket), max(bucket), INTERVAL 7 DAY)) AS DATE) AS bucket FROM s GROUP BY 1)
  SELECT g.series, g.bucket, round(coalesce(total, 0), 2) AS total FROM g LEFT JOIN s ON g.series = s.series AND g.bucket = s.bucket""")
def weekly_totals(spark: SparkSession, d: str) -> DataFrame:
    """A03."""
    return series.resample(daily_orders(spark, d), BY, "day", "value").select("series", "bucket", F.round("total", 2).alias("total"))


@query(f"WITH {DAILY_ORDERS}, o AS (SELECT series, avg(value) AS m, stddev_samp(value) AS s FROM daily GROUP BY 1) SELECT d.series, CAST(isodow(day) - 1 AS INTEGER) AS weekday, count(*) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS sd, round((avg(value) - max(m)) / max(s), 6) AS effect FROM daily d JOIN o ON d.series = o.series GROUP BY 1, 2")
def weekday_profile(spark: SparkSession, d: str) -> DataFrame:
    """A15, D02."""
    return series.weekday_profile(daily_orders(spark, d), BY, "day", "value").select("series", "weekday", "n", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), r6("effect", "effect"))


_TWO = """count(*) FILTER ({a}) AS na, count(*) FILTER ({b}) AS nb, avg(value) FILTER ({a}) AS ma, avg(value) FILTER ({b}) AS mb, var_samp(value) FILTER ({a}) AS va, var_samp(value) FILTER ({b}) AS vb"""
_T = "round((ma - mb) / (sqrt(((na - 1) * coalesce(va, 0) + (nb - 1) * coalesce(vb, 0)) / nullif(na + nb - 2, 0)) * sqrt(1.0 / na + 1.0 / nb)), 6) AS statistic, round((ma - mb) / sqrt(((na - 1) * coalesce(va, 0) + (nb - 1) * coalesce(vb, 0)) / nullif(na + nb - 2, 0)), 6) AS effect"


@query(f"WITH {DAILY_ORDERS}, t AS (SELECT series, " + _TWO.format(a="isodow(day) < 6", b="isodow(day) >= 6") + f" FROM daily GROUP BY 1) SELECT series, {_T} FROM t")
def weekend_test(spark: SparkSession, d: str) -> DataFrame:
    """Student's t and Cohen's d of weekdays against weekends."""
    return series.weekend_test(daily_orders(spark, d), BY, "day", "value").select("series", r6("statistic", "statistic"), r6("effect", "effect"))


_HOLIDAYS = [f"{y}-12-{x}" for y in range(1995, 2002) for x in (24, 25, 26, 31)]


@query(f"WITH {DAILY_ORDERS}, t AS (SELECT series, " + _TWO.format(a=f"strftime(day, '%Y-%m-%d') IN ({', '.join(repr(h) for h in _HOLIDAYS)})", b=f"strftime(day, '%Y-%m-%d') NOT IN ({', '.join(repr(h) for h in _HOLIDAYS)})") + f" FROM daily GROUP BY 1) SELECT series, {_T}, round((ma - mb) * 100 / mb, 6) AS percent FROM t")
def holiday_effect(spark: SparkSession, d: str) -> DataFrame:
    """A16."""
    return series.holiday_effect(daily_orders(spark, d), BY, "day", "value", _HOLIDAYS).select("series", r6("statistic", "statistic"), r6("effect", "effect"), r6("percent", "percent"))


_MIX = """recent AS (SELECT series, avg(value) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY day DESC) AS k FROM daily) WHERE k <= 30 GROUP BY 1), mix AS (SELECT series, mean, mean / sum(mean) OVER () AS share FROM recent)"""


@query(f"WITH {DAILY_ORDERS}, {_MIX}, top AS (SELECT * FROM mix ORDER BY share DESC, series LIMIT 1) SELECT series, decline, round(share * (1 - decline), 6) AS new_share, round(share * decline, 6) AS loss FROM top, (SELECT CAST(unnest([0.1, 0.2, 0.3]) AS DOUBLE) AS decline)")
def platform_scenarios(spark: SparkSession, d: str) -> DataFrame:
    """A17, W26, W27."""
    return series.decline_scenarios(series.platform_mix(daily_orders(spark, d), "series", "day", "value")).select("series", "decline", r6("new_share", "new_share"), r6("loss", "loss"))


@query(f"WITH {DAILY_ORDERS}, {_MIX}, h AS (SELECT sum(pow(share * 100, 2)) AS hhi FROM mix) SELECT round(hhi, 6) AS hhi, CASE WHEN hhi < 1500 THEN 'low' WHEN hhi < 2500 THEN 'moderate' ELSE 'high' END AS level FROM h")
def platform_concentration(spark: SparkSession, d: str) -> DataFrame:
    """A18, M22."""
    return series.concentration(series.platform_mix(daily_orders(spark, d), "series", "day", "value")).select(r6("hhi", "hhi"), "level")


@query(f"WITH {DAILY_ORDERS}, k AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY day) AS lo, row_number() OVER (PARTITION BY series ORDER BY day DESC) AS hi FROM daily) SELECT series, round(pow(avg(value) FILTER (hi <= 30) / avg(value) FILTER (lo <= 30), 365.25 / (max(day) - min(day))) - 1, 6) AS cagr, round(stddev_samp(value) / avg(value), 6) AS cv FROM k GROUP BY 1")
def platform_growth(spark: SparkSession, d: str) -> DataFrame:
    """A19, A20."""
    daily = daily_orders(spark, d)
    return series.platform_growth(daily, "series", "day", "value").join(series.volatility(daily, "series", "value"), "series").select("series", r6("cagr", "cagr"), r6("cv", "cv"))


@query(_PLACED + """, t AS (SELECT *, pos % 7 AS p, CASE WHEN count(value) OVER c = 7 THEN avg(value) OVER c END AS trend FROM placed WINDOW c AS (PARTITION BY series ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
  s AS (SELECT *, avg(value - trend) OVER (PARTITION BY series, p) AS s0 FROM t), l AS (SELECT series, avg(x) AS level FROM (SELECT series, p, min(s0) AS x FROM s GROUP BY 1, 2) GROUP BY 1)
  SELECT s.series, day, round(trend, 3) AS trend, round(s0 - level, 3) AS seasonal, round(value - trend - (s0 - level), 3) AS residual FROM s JOIN l ON s.series = l.series""")
def classical_decomposition(spark: SparkSession, d: str) -> DataFrame:
    """F02, W21, W22."""
    return series.classical_decomposition(daily_orders(spark, d), BY, "day", "value").select("series", "day", *(F.round(c, 3).alias(c) for c in ("trend", "seasonal", "residual")))


@query(f"WITH {DAILY_ORDERS} SELECT series, round(avg(value) FILTER (day < DATE '{EVENT}'), 4) AS before, round(avg(value) FILTER (day > DATE '{EVENT}'), 4) AS after FROM daily GROUP BY 1")
def event_lift(spark: SparkSession, d: str) -> DataFrame:
    """W29."""
    return series.before_after(daily_orders(spark, d), BY, "day", "value", EVENT).select("series", F.round("before", 4).alias("before"), F.round("after", 4).alias("after"))


@query(f"WITH {DAILY_ORDERS}, m AS (SELECT *, avg(value) OVER a AS mu, lead(value, 7) OVER w AS l FROM daily WINDOW w AS (PARTITION BY series ORDER BY day DESC), a AS (PARTITION BY series)) SELECT series, count(*) AS n, round(sum((value - mu) * (l - mu)) / sum(pow(value - mu, 2)), 6) AS acf FROM m GROUP BY 1")
def autocorrelation(spark: SparkSession, d: str) -> DataFrame:
    """X25."""
    return stats.autocorrelation(daily_orders(spark, d), BY, "day", "value", 7).select("series", "n", r6("acf", "acf"))


@query(f"WITH {COMPANIES} SELECT sector, count(*) AS n, round(coalesce(corr(stars, revenue), 0), 6) AS r FROM companies GROUP BY 1 HAVING count(*) >= 3")
def sector_correlation(spark: SparkSession, d: str) -> DataFrame:
    """The coefficient; p and interval are in statistics_p_values."""
    return stats.correlation(companies(spark, d), "stars", "revenue", ["sector"]).where("r is not null").select("sector", "n", r6("r", "r"))


@query(f"WITH {COMPANIES}, z AS (SELECT CAST(stars AS DOUBLE) AS x, sector FROM companies), m AS (SELECT sector, count(*) AS n, avg(x) AS mu, coalesce(var_samp(x), 0) AS v FROM z GROUP BY 1), "
       "t AS (SELECT count(*) AS k, sum(n) AS nn, sum(n * mu * mu) - pow(sum(n * mu), 2) / sum(n) AS b, sum((n - 1) * v) AS w FROM m) SELECT k, CAST(nn AS BIGINT) AS n, round((b / (k - 1)) / (w / (nn - k)), 5) AS statistic, round(b / (b + w), 5) AS eta_squared FROM t")
def sector_anova(spark: SparkSession, d: str) -> DataFrame:
    """X08, A14."""
    return stats.anova(stats.moments(companies(spark, d), ["sector"], "stars")).select("k", "n", F.round("statistic", 5).alias("statistic"), F.round("eta_squared", 5).alias("eta_squared"))


@query("""WITH x AS (SELECT o_orderstatus AS g, o_totalprice AS v FROM orders WHERE o_orderstatus IN ('F', 'O')), r AS (SELECT g, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS k FROM x)
  SELECT count(*) FILTER (g = 'F') AS n_a, count(*) FILTER (g = 'O') AS n_b, round(sum(k) FILTER (g = 'F') - count(*) FILTER (g = 'F') * (count(*) FILTER (g = 'F') + 1) / 2.0, 3) AS u FROM r""")
def rank_test(spark: SparkSession, d: str) -> DataFrame:
    """X09, on rank sums over value counts."""
    return stats.mann_whitney(table(spark, d, "orders"), "o_orderstatus", "F", "O", "o_totalprice").select("n_a", "n_b", F.round("u", 3).alias("u"))


@query("""WITH x AS (SELECT o_orderpriority AS g, o_totalprice AS v FROM orders), r AS (SELECT g, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS k FROM x), c AS (SELECT sum(pow(t, 3) - t) AS tt FROM (SELECT count(*) AS t FROM x GROUP BY v)),
  s AS (SELECT g, count(*) AS n, sum(k) AS rs FROM r GROUP BY 1), h AS (SELECT count(*) AS k, sum(n) AS n, sum(rs * rs / n) AS q FROM s)
  SELECT k, CAST(n AS BIGINT) AS n, round((12.0 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - tt / (pow(n, 3) - n)), 4) AS h FROM h, c""")
def rank_test_of_groups(spark: SparkSession, d: str) -> DataFrame:
    """X10."""
    return stats.kruskal_wallis(table(spark, d, "orders"), "o_orderpriority", "o_totalprice").select("k", "n", F.round("h", 4).alias("h"))


@query("""WITH z AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS k, count(*) AS n FROM events GROUP BY 1), w AS (SELECT user_id, k, n, k / CAST(n AS DOUBLE) AS p, 1.959963984540054 AS z FROM z)
  SELECT user_id, round((p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) / (1 + z * z / n), 6) AS lo, round((p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) / (1 + z * z / n), 6) AS hi FROM w""")
def purchase_share_interval(spark: SparkSession, d: str) -> DataFrame:
    """X15."""
    e = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("k"), F.count(F.lit(1)).alias("n"))
    i = e.withColumn("i", stats.wilson(F.col("k"), F.col("n")))
    return i.select("user_id", r6(F.col("i.lo"), "lo"), r6(F.col("i.hi"), "hi"))


@query("""WITH c AS (SELECT count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 200000) AS a, count(*) FILTER (o_orderstatus = 'F') AS na, count(*) FILTER (o_orderstatus = 'O' AND o_totalprice > 200000) AS b, count(*) FILTER (o_orderstatus = 'O') AS nb FROM orders)
  SELECT round((a * 1.0 / na) / (b * 1.0 / nb), 6) AS relative_risk, round((a * 1.0 * (nb - b)) / ((na - a) * 1.0 * b), 6) AS odds_ratio FROM c""")
def large_order_risk(spark: SparkSession, d: str) -> DataFrame:
    """X20, X21."""
    is_a, is_b, big = F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "O", F.col("o_totalprice") > 200000
    c = table(spark, d, "orders").agg(F.count_if(is_a & big).alias("a"), F.count_if(is_a).alias("na"), F.count_if(is_b & big).alias("b"), F.count_if(is_b).alias("nb"))
    args = [F.col(x) for x in ("a", "na", "b", "nb")]
    return c.select(r6(stats.relative_risk(*args)["value"], "relative_risk"), r6(stats.odds_ratio(*args)["value"], "odds_ratio"))


@query(f"WITH {DAILY_ORDERS} SELECT series, round(regr_slope(value, day - DATE '1995-01-01'), 6) AS slope, round(regr_r2(value, day - DATE '1995-01-01'), 6) AS r2, round(regr_slope(value, day - DATE '1995-01-01') / avg(value) * 100, 6) AS growth FROM daily GROUP BY 1")
def trend_slopes(spark: SparkSession, d: str) -> DataFrame:
    """F10, X32, X33."""
    x = daily_orders(spark, d).withColumn("x", F.datediff("day", F.lit("1995-01-01").cast("date")))
    s = stats.slope(x, BY, "x", "value").join(x.groupBy("series").agg(F.avg("value").alias("mean")), "series")
    return s.select("series", r6("slope", "slope"), r6("r2", "r2"), r6(F.col("slope") / F.col("mean") * 100, "growth"))


_ITS = f"""WITH {DAILY_ORDERS}, pre AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY day DESC) AS k FROM daily WHERE day < DATE '{EVENT}') WHERE k <= 90),
  post AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY day) AS k FROM daily WHERE day >= DATE '{EVENT}') WHERE k <= 90),
  fit AS (SELECT series, regr_slope(value, 90 - k) AS s, regr_intercept(value, 90 - k) AS i FROM pre GROUP BY 1), gaps AS (SELECT p.series, day, 90 + k - 1 AS x, value AS observed, i + s * (90 + k - 1) AS counterfactual, value - (i + s * (90 + k - 1)) AS gap FROM post p JOIN fit f ON p.series = f.series)"""


@query(_ITS + " SELECT series, day, CAST(x AS BIGINT) AS x, observed, round(counterfactual, 4) AS counterfactual, round(gap, 4) AS gap FROM gaps")
def interrupted_series(spark: SparkSession, d: str) -> DataFrame:
    """C01, C02."""
    return causal.interrupted_series(daily_orders(spark, d), BY, "day", "value", EVENT).select("series", "day", F.col("x").cast("long").alias("x"), "observed", F.round("counterfactual", 4).alias("counterfactual"), F.round("gap", 4).alias("gap"))


@query(_ITS + " SELECT series, count(*) AS n, round(avg(gap), 4) AS effect, round(avg(gap) * 100 / avg(counterfactual), 6) AS percent, round(avg(gap) / (stddev_samp(gap) / sqrt(count(*))), 6) AS t FROM gaps GROUP BY 1")
def intervention_effect(spark: SparkSession, d: str) -> DataFrame:
    """C03, C22."""
    g = causal.interrupted_series(daily_orders(spark, d), BY, "day", "value", EVENT)
    return causal.gap_test(g, BY).select("series", "n", F.round("effect", 4).alias("effect"), r6("percent", "percent"), r6("t", "t"))


@query(_ITS + f", w AS (SELECT *, CASE WHEN day - DATE '{EVENT}' BETWEEN 0 AND 7 THEN 'immediate' WHEN day - DATE '{EVENT}' BETWEEN 8 AND 30 THEN 'short' WHEN day - DATE '{EVENT}' BETWEEN 31 AND 90 THEN 'long' END AS win FROM gaps) SELECT series, win AS \"window\", count(*) AS n, round(avg(gap), 4) AS effect FROM w WHERE win IS NOT NULL GROUP BY 1, 2")
def duration_effects(spark: SparkSession, d: str) -> DataFrame:
    """C17."""
    g = causal.interrupted_series(daily_orders(spark, d), BY, "day", "value", EVENT)
    return causal.duration_effects(g, BY, "day", EVENT).select("series", "window", "n", F.round("effect", 4).alias("effect"))


@query(_ITS + " SELECT series, count(*) AS n, round(sum(gap), 3) AS car, round(sum(gap) / (stddev_pop(gap) * sqrt(count(*))), 6) AS z FROM gaps GROUP BY 1")
def cumulated_gap(spark: SparkSession, d: str) -> DataFrame:
    """Against the straight line before."""
    g = causal.interrupted_series(daily_orders(spark, d), BY, "day", "value", EVENT)
    return causal.abnormal_sum(g, BY).select("series", "n", F.round("car", 3).alias("car"), r6("z", "z"))


@query(_ITS + f", r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY abs(gap) DESC, day) AS k FROM gaps) SELECT series, day AS peak_day, round(gap, 4) AS peak, CAST(day - DATE '{EVENT}' AS INTEGER) AS days_to_peak, round(gap * 100 / counterfactual, 6) AS percent FROM r WHERE k = 1")
def peak_impact(spark: SparkSession, d: str) -> DataFrame:
    """C21."""
    g = causal.interrupted_series(daily_orders(spark, d), BY, "day", "value", EVENT)
    return causal.peak_gap(g, BY, "day", EVENT).select("series", "peak_day", F.round("peak", 4).alias("peak"), "days_to_peak", r6("percent", "percent"))


_T4 = [("tb", "1-URGENT", "<"), ("ta", "1-URGENT", ">="), ("cb", "5-LOW", "<"), ("ca", "5-LOW", ">=")]


@query(f"WITH {DAILY_ORDERS}, c AS (SELECT " + ", ".join(f"avg(value) FILTER (series = '{s}' AND day {o} DATE '{EVENT}') AS m_{k}, count(*) FILTER (series = '{s}' AND day {o} DATE '{EVENT}') AS n_{k}, coalesce(var_pop(value) FILTER (series = '{s}' AND day {o} DATE '{EVENT}'), 0) AS v_{k}" for k, s, o in _T4)
       + " FROM daily) SELECT " + ", ".join(f"round(m_{k}, 4) AS m_{k}" for k, _, _ in _T4) + ", round((m_ta - m_tb) - (m_ca - m_cb), 4) AS effect, round(sqrt((" + " + ".join(f"n_{k} * v_{k}" for k, _, _ in _T4) + ") / (" + " + ".join(f"n_{k}" for k, _, _ in _T4) + " - 4) * (" + " + ".join(f"1.0 / n_{k}" for k, _, _ in _T4) + ")), 4) AS se FROM c WHERE n_tb > 0 AND n_cb > 0 AND n_ta > 0")
def difference_in_differences(spark: SparkSession, d: str) -> DataFrame:
    """C05, C06."""
    daily = _priorities(spark, d)
    out = causal.difference_in_differences(daily, "series", "1-URGENT", "5-LOW", "day", "value", EVENT)
    return out.where("m_tb is not null and m_cb is not null and m_ta is not null").select(*(F.round(c, 4).alias(c) for c in ("m_tb", "m_ta", "m_cb", "m_ca", "effect", "se")))


def _priorities(spark: SparkSession, d: str) -> DataFrame:
    return daily_orders(spark, d)


@query(f"WITH {DAILY_ORDERS}, f AS (SELECT series, regr_slope(value, day - DATE '{EVENT}') AS s FROM daily WHERE day < DATE '{EVENT}' GROUP BY 1) SELECT round(max(s) FILTER (series = '1-URGENT'), 6) AS slope_a, round(max(s) FILTER (series = '5-LOW'), 6) AS slope_b FROM f")
def parallel_trends(spark: SparkSession, d: str) -> DataFrame:
    """C04, C07."""
    return causal.parallel_trends(daily_orders(spark, d), "series", "1-URGENT", "5-LOW", "day", "value", EVENT).select(r6("slope_a", "slope_a"), r6("slope_b", "slope_b"))


@query(f"WITH {COMPANIES}, g AS (SELECT sector, avg(stars) AS v FROM companies GROUP BY 1), s AS (SELECT stddev_pop(v) AS sd FROM g) SELECT x.sector AS a, y.sector AS b, round(abs(x.v - y.v), 6) AS gap, abs(x.v - y.v) > 1.5 * sd AS is_significant FROM g x JOIN g y ON x.sector < y.sector, s")
def density_gaps(spark: SparkSession, d: str) -> DataFrame:
    """J14, M20."""
    g = companies(spark, d).groupBy("sector").agg(F.avg("stars").alias("v"))
    return joins.upper_pairs(g, "sector", "v").withColumn("gap", r6("gap"))


@query(f"WITH {DAILY_ORDERS}, e AS (SELECT series AS name, avg(value) AS effect, stddev_samp(value) / sqrt(count(*)) AS se FROM daily GROUP BY 1), w AS (SELECT *, 1 / (se * se) AS w FROM e) SELECT count(*) AS k, round(sum(w * effect) / sum(w), 4) AS pooled, round(sqrt(1 / sum(w)), 4) AS pooled_se, round(sum(w * effect * effect) - pow(sum(w * effect), 2) / sum(w), 4) AS q FROM w")
def campaign_pooling(spark: SparkSession, d: str) -> DataFrame:
    """J15."""
    e = daily_orders(spark, d).groupBy(F.col("series").alias("name")).agg(F.avg("value").alias("effect"), (F.stddev_samp("value") / F.sqrt(F.count(F.lit(1)))).alias("se"))
    return causal.campaign_table(e, "name", "effect", "se").select("k", *(F.round(c, 4).alias(c) for c in ("pooled", "pooled_se", "q")))


@query(f"WITH {DAILY_ORDERS}, f AS (SELECT *, lag(value) OVER w AS guess FROM daily {_W}) SELECT series, round(avg(abs((value - guess) / value)) * 100, 6) AS mape, round(sqrt(avg(pow(value - guess, 2))), 4) AS rmse, round(avg(abs(value - guess)), 4) AS mae FROM f GROUP BY 1")
def naive_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """The error of yesterday's value as forecast."""
    from pyspark.sql import Window

    guess = daily_orders(spark, d).withColumn("guess", F.lag("value").over(Window.partitionBy("series").orderBy("day")))
    return series.forecast_accuracy(guess, BY, "value", "guess").select("series", r6("mape", "mape"), F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"))


# Distribution functions and resampling: no SQL


@query()
def statistics_p_values(spark: SparkSession, d: str) -> DataFrame:
    """Test, key, statistic, p of every kind of test."""
    daily, c = daily_orders(spark, d), companies(spark, d)
    one = lambda df, name, key, stat: df.select(F.lit(name).alias("test"), key.cast("string").alias("key"), stat.cast("double").alias("statistic"), F.col("p"))
    parts = [
        one(series.weekend_test(daily, BY, "day", "value"), "t", F.col("series"), F.col("statistic")),
        one(series.weekday_test(daily, BY, "day", "value"), "anova", F.col("series"), F.col("statistic")),
        one(stats.correlation(c, "stars", "revenue", ["sector"]), "correlation", F.col("sector"), F.col("r")),
        one(stats.mann_whitney(table(spark, d, "orders"), "o_orderstatus", "F", "O", "o_totalprice"), "mann_whitney", F.lit("F-O"), F.col("u")),
        one(stats.kruskal_wallis(table(spark, d, "orders"), "o_orderpriority", "o_totalprice"), "kruskal_wallis", F.lit("priority"), F.col("h")),
        one(series.volatility_test(daily, "series", "value"), "volatility", F.lit("series"), F.col("statistic")),
        one(stats.autocorrelation(daily, BY, "day", "value", 7), "acf", F.col("series"), F.col("acf")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query()
def bootstrap_means(spark: SparkSession, d: str) -> DataFrame:
    """X12, Y01."""
    return stats.resampled(daily_orders(spark, d), BY, "value", "mean")


@query()
def permutation_effects(spark: SparkSession, d: str) -> DataFrame:
    """Weekdays against weekends."""
    part = F.when(F.weekday("day") >= 5, "weekend").otherwise("weekday")
    return stats.permutation_test(daily_orders(spark, d).withColumn("part", part), BY, "part", "weekday", "weekend", "value")


@query()
def synthetic_controls(spark: SparkSession, d: str) -> DataFrame:
    """C12-C15, on monthly totals: weights, fit, effect and placebo p."""
    monthly = daily_orders(spark, d).groupBy("series", F.trunc("day", "month").alias("day")).agg(F.sum("value").alias("value"))
    return causal.synthetic_control(monthly, "series", "1-URGENT", "day", "value", EVENT, least_fit=-10.0)


@query(f"""WITH {DAILY_ORDERS}, pre AS (SELECT series, avg(value) AS base, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY day DESC) AS k FROM daily WHERE day < DATE '{EVENT}') WHERE k <= 90 GROUP BY 1 HAVING count(*) >= 30),
  post AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY day) AS k FROM daily WHERE day >= DATE '{EVENT}' QUALIFY k <= 180), sized AS (SELECT *, count(*) OVER (PARTITION BY series) AS n FROM post),
  means AS (SELECT p.series, p.k, (SELECT avg(q.value) FROM sized q WHERE q.series = p.series AND q.k BETWEEN p.k - least(7, greatest(1, p.n // 4)) + 1 AND p.k) AS m FROM sized p)
  SELECT m.series, CAST(coalesce(min(k - 1) FILTER (abs(m - base) <= 0.1 * abs(base)), 180) AS BIGINT) AS days FROM means m JOIN pre ON m.series = pre.series GROUP BY 1""")
def persistence_days(spark: SparkSession, d: str) -> DataFrame:
    """W20."""
    return causal.persistence(daily_orders(spark, d), BY, "day", "value", EVENT)


@query()
def mean_intervals(spark: SparkSession, d: str) -> DataFrame:
    """X13, A34, X16."""
    return stats.mean_interval(stats.moments(daily_orders(spark, d), BY, "value"))
