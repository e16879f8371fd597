"""Graphs, models, text clusters, streams, files and reports over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html
from ..operators import etl, graph, joins, learn, models, report
from ..sources import landed, sinks
from ..sources.tables import table
from ..sources.written import scratch, written
from ..streaming import jobs
from .relational import r6
from .views import DAILY_ORDERS, companies, daily_orders

QUERIES: dict = {}
SQL: dict[str, str] = {}
BY = ["series"]


def query(sql: str | None = None):  # noqa: ANN201
    def register(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def trade(spark: SparkSession, d: str) -> DataFrame:
    """Edges from the nation of the customer to that of the supplier, for pairs that trade more than pairs do on average; 625 at most, made once."""
    sold = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_orderkey", F.col("s_nationkey").alias("dst")).agg(F.sum("l_quantity").alias("q"))
    bought = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", F.col("c_nationkey").alias("src"))
    volumes = bought.join(sold, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("src", "dst").agg(F.sum("q").alias("q"))
    mean = volumes.agg(F.avg("q").alias("mean"))
    return written(volumes.crossJoin(F.broadcast(mean)).where("q > mean").select("src", "dst"))


TRADE = """volumes AS (SELECT c_nationkey AS src, s_nationkey AS dst, sum(l_quantity) AS q FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
trade AS MATERIALIZED (SELECT src, dst FROM volumes WHERE q > (SELECT avg(q) FROM volumes))"""


def editing(spark: SparkSession, d: str) -> DataFrame:
    """Edges from each editor to each article edited, over all revisions, made once. The graph grows with the table."""
    known = table(spark, d, "revisions").where("editor_id <> '' and article is not null")
    return written(known.select(F.concat(F.lit("e:"), "editor_id").alias("src"), F.concat(F.lit("a:"), "article").alias("dst")).distinct())


EDITING = """editing AS MATERIALIZED (SELECT DISTINCT 'e:' || editor_id AS src, 'a:' || article AS dst FROM revisions WHERE editor_id <> '' AND article IS NOT NULL),
both_ways AS MATERIALIZED (SELECT src AS a, dst AS b FROM editing UNION ALL SELECT dst, src FROM editing), ids AS MATERIALIZED (SELECT DISTINCT a AS id FROM both_ways)"""


def _nations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("id"))


def _pagerank_sql(rounds: int) -> str:
    text = f"WITH {EDITING}, o AS MATERIALIZED (SELECT src, count(*) AS n FROM editing GROUP BY 1), s AS MATERIALIZED (SELECT t.src, t.dst, 1.0 / o.n AS share FROM editing t JOIN o ON t.src = o.src), r0 AS MATERIALIZED (SELECT id, CAST(1.0 / (SELECT count(*) FROM ids) AS DOUBLE) AS rank FROM ids)"
    for k in range(1, rounds + 1):
        text += f""", g{k} AS (SELECT dst AS id, sum(rank * share) AS got FROM s JOIN r{k - 1} ON id = src GROUP BY 1), l{k} AS (SELECT coalesce(sum(rank), 0) AS loose FROM r{k - 1} WHERE id NOT IN (SELECT src FROM o)),
        r{k} AS MATERIALIZED (SELECT ids.id, 0.15 / (SELECT count(*) FROM ids) + 0.85 * (coalesce(got, 0) + loose / (SELECT count(*) FROM ids)) AS rank FROM ids LEFT JOIN g{k} ON ids.id = g{k}.id, l{k})"""
    return text + f" SELECT id, round(rank * 1000000, 4) AS millionths FROM r{rounds}"


@query(_pagerank_sql(20))
def edit_pagerank(spark: SparkSession, d: str) -> DataFrame:
    """Twenty rounds over editors and articles."""
    e = editing(spark, d)
    return graph.pagerank(graph.nodes_of(e), e, tolerance=0.0).select("id", F.round(F.col("rank") * 1_000_000, 4).alias("millionths"))


def _least_sql(rounds: int) -> str:
    text = f"WITH {EDITING}, c0 AS MATERIALIZED (SELECT id, id AS c FROM ids)"
    for k in range(1, rounds + 1):
        text += f", c{k} AS MATERIALIZED (SELECT ids.id, least(min(own.c), min(near.c)) AS c FROM ids JOIN c{k - 1} own ON own.id = ids.id JOIN both_ways e ON e.a = ids.id JOIN c{k - 1} near ON near.id = e.b GROUP BY 1)"
    return text + f" SELECT id, c AS component FROM c{rounds}"


@query(_least_sql(12))
def edit_components(spark: SparkSession, d: str) -> DataFrame:
    """Connected components of editors and articles."""
    e = editing(spark, d)
    return graph.connected_components(graph.nodes_of(e), e)


@query(f"""WITH RECURSIVE {EDITING}, r(id, depth) AS (SELECT (SELECT min(id) FROM ids), 0 UNION SELECT b, depth + 1 FROM r JOIN both_ways ON a = id WHERE depth < 2) SELECT id, min(depth) AS depth FROM r GROUP BY 1""")
def edit_crawl(spark: SparkSession, d: str) -> DataFrame:
    """Breadth first from one article over its editors to their articles, two deep."""
    e = editing(spark, d)
    links = graph.undirected(e)
    seeds = links.agg(F.min("src").alias("id"))
    return graph.crawl(seeds, links, depth=2, most=None).select("id", F.col("depth").cast("int").alias("depth"))


def _labels_sql(rounds: int) -> str:
    text = f"WITH {EDITING}, l0 AS MATERIALIZED (SELECT id, id AS label FROM ids)"
    for k in range(1, rounds + 1):
        text += f""", v{k} AS (SELECT id, label, count(*) AS n FROM (SELECT e.b AS id, label FROM l{k - 1} JOIN both_ways e ON e.a = id UNION ALL SELECT id, label FROM l{k - 1}) GROUP BY 1, 2),
        l{k} AS MATERIALIZED (SELECT id, label FROM v{k} QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, label) = 1)"""
    return text + f" SELECT id, min(id) OVER (PARTITION BY label) AS community FROM l{rounds}"


@query(_labels_sql(6))
def edit_communities(spark: SparkSession, d: str) -> DataFrame:
    """Six rounds of label propagation over editors and articles; a community goes by its least member."""
    e = editing(spark, d)
    found = graph.label_communities(graph.nodes_of(e), e, rounds=6)
    return found.join(found.groupBy("community").agg(F.min("id").alias("least")), "community").select("id", F.col("least").alias("community"))


@query(f"""WITH {TRADE}, c AS (SELECT n_nationkey AS id, n_regionkey AS community FROM nation), p AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM trade),
  i AS (SELECT x.community, count(*) AS edges FROM p JOIN c x ON x.id = a JOIN c y ON y.id = b WHERE x.community = y.community GROUP BY 1), s AS (SELECT community, count(*) AS size FROM c GROUP BY 1)
  SELECT s.community, size, coalesce(edges, 0) AS edges, round(coalesce(edges, 0) / (size * (size - 1) / 2.0), 6) AS density FROM s LEFT JOIN i ON s.community = i.community""")
def region_density(spark: SparkSession, d: str) -> DataFrame:
    """Edges inside given communities."""
    c = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("community"))
    return graph.community_density(c, trade(spark, d)).withColumn("density", r6("density"))


@query("SELECT n_regionkey AS community, list(n_nationkey ORDER BY n_nationkey) AS members FROM nation GROUP BY 1")
def region_members(spark: SparkSession, d: str) -> DataFrame:
    """The members of given communities."""
    return graph.members(table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("community")))


@query(f"""WITH {TRADE}, n AS (SELECT n_nationkey AS id FROM nation WHERE n_regionkey < 3) SELECT src, dst FROM trade WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)""")
def filtered_network(spark: SparkSession, d: str) -> DataFrame:
    """Edges whose ends both survive a filter."""
    n = table(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("id"))
    return joins.edges_between(trade(spark, d), n)


@query()
def trade_communities(spark: SparkSession, d: str) -> DataFrame:
    """Label propagation and modularity, side by side."""
    edges = trade(spark, d)
    a = graph.label_communities(_nations(spark, d), edges).withColumnRenamed("community", "by_labels")
    b = graph.modularity_communities(_nations(spark, d), edges).withColumnRenamed("community", "by_modularity")
    return a.join(b, "id")


def _between_sql(name: str, links: str, levels: int = 8) -> str:
    """CTEs of shortest paths by length and of what lies between, from a list of links (a, b)."""
    text = f"{name}_e AS MATERIALIZED ({links}), {name}_0 AS MATERIALIZED (SELECT id AS a, id AS b, 1.0 AS c, 0 AS far FROM nations)"
    for k in range(1, levels + 1):
        text += f""", {name}_{k} AS MATERIALIZED (SELECT * FROM {name}_{k - 1} UNION ALL SELECT p.a, e.b, sum(p.c), {k} FROM {name}_{k - 1} p JOIN {name}_e e ON e.a = p.b
          WHERE p.far = {k - 1} AND NOT EXISTS (SELECT 1 FROM {name}_{k - 1} o WHERE o.a = p.a AND o.b = e.b) GROUP BY 1, 2)"""
    paths = f"{name}_{levels}"
    return text + f""", {name} AS MATERIALIZED (SELECT id, coalesce((SELECT sum(x.c * y.c / w.c) FROM {paths} x JOIN {paths} y ON x.b = y.a JOIN {paths} w ON w.a = x.a AND w.b = y.b
          WHERE x.b = id AND x.a <> id AND y.b <> id AND x.a <> y.b AND x.far + y.far = w.far), 0) / ((SELECT count(*) FROM nations) - 1) / ((SELECT count(*) FROM nations) - 2) AS c FROM nations)"""


def _centrality_sql(rounds: int) -> str:
    ways = "SELECT src AS a, dst AS b FROM trade WHERE src <> dst"
    text = f"WITH {TRADE}, nations AS MATERIALIZED (SELECT n_nationkey AS id FROM nation), " + _between_sql("near", f"{ways} UNION SELECT dst, src FROM trade WHERE src <> dst") + ", " + _between_sql("onward", ways)
    text += """, best AS (SELECT e.a AS id, n.c, row_number() OVER (PARTITION BY e.a ORDER BY n.c DESC, e.b) AS k FROM near_e e JOIN near n ON n.id = e.b),
      around AS (SELECT id, sum(c) AS s, count(*) AS n FROM best WHERE k <= 10 GROUP BY 1), x0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE AS x FROM nations)"""
    for k in range(1, rounds + 1):
        text += f""", y{k} AS MATERIALIZED (SELECT p.id, p.x + coalesce((SELECT sum(q.x) FROM near_e e JOIN x{k - 1} q ON q.id = e.b WHERE e.a = p.id), 0) AS x FROM x{k - 1} p),
          x{k} AS MATERIALIZED (SELECT id, x / (SELECT sqrt(sum(x * x)) FROM y{k}) AS x FROM y{k})"""
    return text + f""" SELECT near.id, round(near.c, 4) AS centrality, round((near.c + coalesce(s, 0)) / (1 + coalesce(around.n, 0)), 4) AS ecosystem, round((onward.c + x) / 2, 4) AS knowledge
      FROM near LEFT JOIN around ON around.id = near.id JOIN onward ON onward.id = near.id JOIN x{rounds} ON x{rounds}.id = near.id"""


@query(_centrality_sql(40))
def trade_betweenness(spark: SparkSession, d: str) -> DataFrame:
    """Betweenness, its mean with the best neighbours, and knowledge centrality."""
    nodes, edges = _nations(spark, d), trade(spark, d)
    b = written(graph.betweenness(nodes, edges))
    e = graph.ecosystem_centrality(b, edges).withColumnRenamed("centrality", "ecosystem")
    k = graph.knowledge_centrality(nodes, edges).withColumnRenamed("centrality", "knowledge")
    return b.join(e, "id").join(k, "id").select("id", *(F.round(c, 4).alias(c) for c in ("centrality", "ecosystem", "knowledge")))


@query()
def loess_decomposition(spark: SparkSession, d: str) -> DataFrame:
    """F01, F03, F24."""
    return models.decompose(daily_orders(spark, d), BY, "day", "value")


@query()
def smooth_trends(spark: SparkSession, d: str) -> DataFrame:
    """W21."""
    return models.smooth_trend(daily_orders(spark, d), BY, "day", "value")


@query()
def structural_shifts(spark: SparkSession, d: str) -> DataFrame:
    """Breaks of daily series that methods agree on."""
    return models.changepoints(daily_orders(spark, d), BY, "day", "value")


@query()
def seasonality(spark: SparkSession, d: str) -> DataFrame:
    """X24-X26, F26."""
    return models.seasonality_tests(daily_orders(spark, d), BY, "day", "value")


@query()
def demand_forecast(spark: SparkSession, d: str) -> DataFrame:
    """Ensemble forecasts in three scenarios."""
    return models.scenarios(models.forecasts(daily_orders(spark, d), BY, "day", "value", 30))


@query()
def multiplicative_forecast(spark: SparkSession, d: str) -> DataFrame:
    """The ensemble with seasons that grow with the level."""
    return models.forecasts(daily_orders(spark, d), BY, "day", "value", 30, models.MULTIPLICATIVE)


@query()
def forecast_errors(spark: SparkSession, d: str) -> DataFrame:
    """F15, F19, F20."""
    return models.method_errors(daily_orders(spark, d), BY, "day", "value")


@query()
def topic_labels(spark: SparkSession, d: str) -> DataFrame:
    """clusters of the whole corpus with size and label."""
    return learn.topic_clusters(table(spark, d, "documents"), "doc_id", "text")[1]


@query()
def embedding_growth(spark: SparkSession, d: str) -> DataFrame:
    """The label of an embedding predicted from it."""
    e = table(spark, d, "embeddings").withColumn("target", F.col("label").cast("double"))
    return learn.growth_model(e, "vec_id", "target", "embedding", drop=["label"])


@query()
def quarterly_report(spark: SparkSession, d: str) -> DataFrame:
    """The nested report over a log of company snapshots."""
    log = table(spark, d, "company_snapshots").where("updated_at is not null and employee_count is not null").select(F.col("id").alias("company_id"), "sector", F.col("employee_count").cast("double").alias("score"), F.col("updated_at").alias("at"))
    return report.executive_report(log).select("period", F.to_json("summary").alias("summary"), F.to_json("leaderboard").alias("leaderboard"), F.size("trends").alias("sectors"), F.to_json("recommendations").alias("recommendations"))


@query("""WITH l AS (SELECT CAST(updated_at AS DATE) AS day, coalesce(sector, 'Unknown') AS sector, employee_count AS score FROM company_snapshots WHERE updated_at IS NOT NULL AND employee_count IS NOT NULL)
  SELECT day, sector, round(avg(score), 6) AS score, count(*) AS n FROM l GROUP BY GROUPING SETS ((day), (day, sector))""")
def score_trends(spark: SparkSession, d: str) -> DataFrame:
    """A13."""
    log = table(spark, d, "company_snapshots").where("updated_at is not null and employee_count is not null").select("sector", F.col("employee_count").alias("score"), F.col("updated_at").alias("at"))
    return report.trends(log).withColumn("score", r6("score"))


@query(f"""WITH z AS (SELECT id, lower(sector) AS metric, max(revenue_rank) AS v FROM company_snapshots WHERE sector IS NOT NULL GROUP BY 1, 2) SELECT id, {', '.join(f"max(v) FILTER (metric = '{m}') AS {m}" for m in ('energy', 'finance', 'healthcare', 'retail', 'technology'))} FROM z WHERE metric IN ('energy', 'finance', 'healthcare', 'retail', 'technology') GROUP BY 1""")
def export_wide(spark: SparkSession, d: str) -> DataFrame:
    """Ragged metrics to a wide table over stated names."""
    names = ["energy", "finance", "healthcare", "retail", "technology"]
    m = table(spark, d, "company_snapshots").select("id", F.lower("sector").alias("metric"), "revenue_rank").where(F.col("metric").isin(*names))
    return sinks.export_wide(m, "id", "metric", "revenue_rank", names)


@query(f"WITH {DAILY_ORDERS} SELECT series, day, value FROM daily")
def versioned_result(spark: SparkSession, d: str) -> DataFrame:
    """A result written, verified and read back."""
    base = scratch(spark, "versions")
    sinks.save_version(daily_orders(spark, d), base, "v1")
    return sinks.load_version(spark, base)


@query("SELECT CAST(time_bucket(INTERVAL 1 DAY, ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    """A stream of events counted by day; in complete mode it ends with what the table holds."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    counts = jobs.windowed_counts(jobs.files(spark, _folder(d, "events"), schema), "ts", ["event_type"], "value")
    return jobs.run_to_end(counts, "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT event_id, ts, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts) = 1")
def stream_once(spark: SparkSession, d: str) -> DataFrame:
    """Repeats within the watermark are dropped."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    once = jobs.once_within(jobs.files(spark, _folder(d, "events"), schema), "ts", ["event_id"])
    out = jobs.run_to_end(once.select("event_id", "ts", "user_id", "event_type"))
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


_INGESTED = ["views_human", "views_bot", "views_total"]


@query(f"""SELECT article, timestamp, device_type, {', '.join(f"arg_max({c}, fetched_at) AS {c}" for c in _INGESTED)} FROM pageviews WHERE trim(article) <> '' AND views_human >= 0 AND views_bot >= 0
  AND views_total = views_human + views_bot AND device_type IN ('desktop', 'mobile-web', 'mobile-app') GROUP BY 1, 2, 3""")
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Page views streamed through validation into a log, read as the current table."""
    schema = spark.read.parquet(f"{d}/pageviews.parquet").schema
    target, key = scratch(spark, "streams"), ["article", "timestamp", "device_type"]
    stream = jobs.files(spark, _folder(d, "pageviews"), schema)
    jobs.ingest(stream, etl.pageview_rules(), key, "fetched_at", f"{target}/out", f"{target}/state").awaitTermination()
    return jobs.current(spark, f"{target}/out", key, "fetched_at").select(*key, *_INGESTED)


@query("""SELECT article, timestamp, device_type, fetched_at, CASE WHEN article IS NULL OR trim(article) = '' THEN 'empty article' WHEN NOT coalesce(views_human >= 0 AND views_bot >= 0 AND views_total >= 0, false) THEN 'negative count'
  WHEN NOT coalesce(views_total = views_human + views_bot, false) THEN 'total mismatch' ELSE 'unknown device' END AS reason FROM pageviews
  WHERE NOT coalesce(trim(article) <> '' AND views_human >= 0 AND views_bot >= 0 AND views_total >= 0 AND views_total = views_human + views_bot AND device_type IN ('desktop', 'mobile-web', 'mobile-app'), false)""")
def stream_quarantine(spark: SparkSession, d: str) -> DataFrame:
    """What the stream of page views rejects, with the reason."""
    schema = spark.read.parquet(f"{d}/pageviews.parquet").schema
    target = scratch(spark, "streams")
    stream = jobs.files(spark, _folder(d, "pageviews"), schema)
    jobs.ingest(stream, etl.pageview_rules(), ["article"], "fetched_at", f"{target}/out", f"{target}/state").awaitTermination()
    return spark.read.parquet(f"{target}/out/quarantine").select("article", "timestamp", "device_type", "fetched_at", "reason")


def _folder(d: str, name: str) -> str:
    """A path a file stream can read: the table's folder, or its one file."""
    return f"{d}/{name}.parquet*"


@query()
def synthetic_series(spark: SparkSession, d: str) -> DataFrame:
    """S22-S24."""
    return landed.synthetic_traffic(spark)


@query("SELECT id, title, title AS name, 1 AS n_links FROM dim_articles WHERE title IS NOT NULL")
def page_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts of a page made from each article's title."""
    a = table(spark, d, "dim_articles").where("title is not null")
    page = F.concat(F.lit('<h1 class="firstHeading">'), "title", F.lit('</h1><table class="infobox"><tr><th>Name</th><td>'), "title", F.lit('</td></tr></table><a href="/wiki/'), F.regexp_replace("title", " ", "_"), F.lit('">x</a>'))
    return a.select("id", page.alias("page"), "url").select("id", html.title(F.col("page"), F.col("url")).alias("title"), html.infobox(F.col("page"))["Name"].alias("name"), F.size(html.internal_links(F.col("page"))).alias("n_links"))
