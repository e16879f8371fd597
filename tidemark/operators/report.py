"""The executive report as one nested row, from companies and a log of scores over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import capped, quarter_label
from ..sources.written import written
from .ranking import latest, top_share


def summary(newest: DataFrame) -> DataFrame:
    """One row: companies, mean score, best sector and best company of rows (company_id, sector, score)."""
    sectors = newest.groupBy("sector").agg(F.avg("score").alias("s")).agg(F.min_by("sector", F.struct(-F.col("s"), F.col("sector"))).alias("best_sector"))
    return newest.agg(F.count(F.lit(1)).alias("companies"), F.avg("score").alias("mean_score"), F.min_by("company_id", F.struct(-F.col("score"), F.col("company_id"))).alias("best_company")).crossJoin(sectors)


def trends(log: DataFrame) -> DataFrame:
    """day, sector (null for all), mean score and n: one pass of grouping sets."""
    days = log.withColumn("day", F.to_date("at")).withColumn("sector", F.coalesce("sector", F.lit("Unknown")))
    return days.groupingSets([["day"], ["day", "sector"]], "day", "sector").agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("n"))


def change_of_latest(log: DataFrame) -> DataFrame:
    """company_id, change: the newest score over the one before, less one; 0 where that is 0 or there is one score."""
    w = Window.partitionBy("company_id").orderBy(F.desc("at"))
    two = log.withColumn("k", F.row_number().over(w)).where("k <= 2").groupBy("company_id").agg(F.max(F.when(F.col("k") == 1, F.col("score"))).alias("a"), F.max(F.when(F.col("k") == 2, F.col("score"))).alias("b"))
    return two.select("company_id", F.coalesce(F.try_divide(F.col("a") - F.col("b"), "b"), F.lit(0.0)).alias("change"))


def recommendations(newest: DataFrame) -> DataFrame:
    """priority, kind, company_id, gap of companies in the bottom quarter and below their sector's mean, best first."""
    means = newest.groupBy("sector").agg(F.avg("score").alias("m"))
    below = newest.join(means, "sector").where("score < m").select(F.lit(2).alias("priority"), F.lit("below sector").alias("kind"), "company_id", (F.col("m") - F.col("score")).alias("gap"))
    invest = top_share(newest, "score", ["company_id"], bottom=True).join(means, "sector").select(F.lit(1).alias("priority"), F.lit("invest").alias("kind"), "company_id", F.greatest(F.lit(0.0), F.col("m") - F.col("score")).alias("gap"))
    return invest.unionByName(below)


def investments(newest: DataFrame) -> DataFrame:
    """Companies of the bottom quarter with the gap to their sector's mean: company_id, sector, score, sector_mean, gap, confidence, percent and talent_percent.

    confidence is the gap's share of the mean, held to 1, and a half where the mean is 0; percent is the same share in percent, talent_percent half of it; rounded half to even.
    """
    c = F.col
    means = newest.groupBy("sector").agg(F.avg("score").alias("sector_mean"))
    out = top_share(newest, "score", ["company_id"], bottom=True).join(means, "sector").withColumn("gap", F.greatest(c("sector_mean") - c("score"), F.lit(0.0)))
    share = F.try_divide("gap", "sector_mean")
    out = out.withColumns({"confidence": F.coalesce(F.bround(capped(share), 4), F.lit(0.5)), "percent": F.coalesce(F.bround(share * 100, 1), F.lit(0.0))})
    return out.withColumn("talent_percent", F.bround(c("percent") * 0.5, 1)).select("company_id", "sector", "score", "sector_mean", "gap", "confidence", "percent", "talent_percent")


def as_text(report: DataFrame, fmt: str = "txt") -> DataFrame:
    """``line``: each field of each row as ``name: value``, or as rows of an HTML table; nested values as JSON."""
    if fmt not in ("txt", "html"):
        raise ValueError(f"no format {fmt}")
    nested = {f.name for f in report.schema if f.dataType.typeName() in ("struct", "array", "map")}
    shown = lambda name: F.coalesce(F.to_json(name) if name in nested else F.col(name).cast("string"), F.lit(""))
    safe = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    if fmt == "txt":
        return report.select(F.explode(F.array(*(F.concat(F.lit(f"{n}: "), shown(n)) for n in report.columns))).alias("line"))
    cells = lambda tag, some: F.concat(F.lit("<tr>"), *(F.concat(F.lit(f"<{tag}>"), safe(x), F.lit(f"</{tag}>")) for x in some), F.lit("</tr>"))
    head = report.sparkSession.range(1).select(cells("th", [F.lit(n) for n in report.columns]).alias("line"))
    return head.union(report.select(cells("td", [shown(n) for n in report.columns]).alias("line")))


def executive_report(log: DataFrame, most: int = 20) -> DataFrame:
    """One row with period, summary, the ``most`` best companies, trends by sector (map to days) and the ``most`` first recommendations."""
    newest = written(latest(log, "company_id", "at"))
    board = newest.orderBy(F.desc("score"), "company_id").limit(most).agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("order"), "company_id", "sector", "score"))).alias("leaderboard"))
    lines = trends(log).where("sector is not null").groupBy("sector").agg(F.sort_array(F.collect_list(F.struct("day", "score"))).alias("days"))
    by_sector = lines.agg(F.map_from_entries(F.collect_list(F.struct("sector", "days"))).alias("trends"))
    advice = recommendations(newest).orderBy("priority", F.desc("gap"), "company_id").limit(most).agg(F.sort_array(F.collect_list(F.struct("priority", (-F.col("gap")).alias("order"), "company_id", "kind"))).alias("recommendations"))
    s = summary(newest)
    period = log.agg(quarter_label(F.max("at")).alias("period"))
    return period.crossJoin(s.select(F.struct(*s.columns).alias("summary"))).crossJoin(board).crossJoin(by_sector).crossJoin(advice)
