"""Topic clusters and growth prediction with Spark's own estimators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, CountVectorizer, NGram, Normalizer, RegexTokenizer, SQLTransformer, StopWordsRemover, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.written import written


def topic_clusters(docs: DataFrame, doc_id: str, text: str, k: int = 8, features: int = 1000, seed: int = 42, starts: int = 10, rounds: int = 300) -> tuple[DataFrame, DataFrame]:
    """Assignments (doc_id, cluster, confidence) and labels (cluster, size, label) by TF-IDF of words and pairs and k-means.

    Null and empty texts are left out. Terms must be in two documents; at most ``features``
    terms count. Confidence is one minus the distance over the largest distance. A label is the
    three terms with the greatest mean weight. Of ``starts`` runs of k-means the one with the least cost counts. Vectors stay distributed; only centres are shared.
    """
    rows = docs.where(F.length(F.trim(F.col(text))) > 0).select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"))
    shaped = Pipeline(
        stages=[
            RegexTokenizer(inputCol="__text", outputCol="__raw", pattern=r"[^\p{L}\p{N}]+", minTokenLength=2),
            StopWordsRemover(inputCol="__raw", outputCol="__words"),
            NGram(n=2, inputCol="__words", outputCol="__pairs"),
            SQLTransformer(statement="SELECT __id, concat(__words, __pairs) AS __terms FROM __THIS__"),
            CountVectorizer(inputCol="__terms", outputCol="__counts", vocabSize=features, minDF=2),
            IDF(inputCol="__counts", outputCol="__weights"),
            Normalizer(inputCol="__weights", outputCol="features"),
        ]
    ).fit(rows)
    vocabulary = shaped.stages[4].vocabulary
    vectors = written(shaped.transform(rows).select("__id", "features"))
    fits = (KMeans(k=k, seed=seed + i, maxIter=rounds).fit(vectors) for i in range(starts))
    model = min(fits, key=lambda f: f.summary.trainingCost)
    centres = F.array(*(F.array(*(F.lit(float(x)) for x in c)) for c in model.clusterCenters()))
    placed = model.transform(vectors).select("__id", F.col("prediction").alias("cluster"), vector_to_array("features").alias("__v"))
    distance = F.sqrt(F.aggregate(F.zip_with("__v", F.element_at(centres, F.col("cluster") + 1), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    far = placed.select("__id", "cluster", distance.alias("__d"))
    most = far.agg(F.max("__d").alias("__most"))
    assigned = far.crossJoin(F.broadcast(most)).select(F.col("__id").alias(doc_id), "cluster", F.coalesce(1 - F.try_divide("__d", "__most"), F.lit(1.0)).alias("confidence"))
    sizes = placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    tops = [(i, "_".join(vocabulary[j] for j in sorted(range(len(c)), key=lambda j: (-c[j], j))[:3])) for i, c in enumerate(model.clusterCenters())]
    names = docs.sparkSession.createDataFrame(tops, "cluster int, label string")
    return assigned, sizes.join(names, "cluster")


def growth_model(rows: DataFrame, key: str, target: str, embedding: str | None = None, drop: Sequence[str] = (), least: int = 100, seed: int = 42, trees: int = 100) -> DataFrame:
    """key, actual, predicted, confidence: boosted trees on the numeric columns and an embedding.

    Features are every numeric column but key, target and ``drop``. Fewer than ``least`` rows
    with a target raise. Confidence is exp(-spread of the trees' steps over the target's
    deviation), held in 0..1: where the trees move the prediction far it is low.
    """
    numeric = [c for c, t in rows.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double") and c not in {key, target, *drop}]
    data = rows.where(F.col(target).isNotNull()).fillna(0, numeric)
    if embedding:
        from pyspark.ml.functions import array_to_vector

        data = data.withColumn("__e", array_to_vector(F.transform(embedding, lambda x: x.cast("double"))))
    n = data.count()
    if n < least:
        raise ValueError(f"{n} rows with {target}; a model needs {least}")
    assembled = VectorAssembler(inputCols=[*numeric, *(["__e"] if embedding else [])], outputCol="features").transform(data)
    model = GBTRegressor(featuresCol="features", labelCol=target, maxIter=trees, stepSize=0.1, maxDepth=3, seed=seed).fit(assembled)
    scored = model.transform(assembled)
    steps = []
    for i, tree in enumerate(model.trees[1:]):  # the first tree is the level, the others are steps from it
        scored = tree.setPredictionCol(f"__t{i}").transform(scored)
        steps.append(F.col(f"__t{i}"))
    mean = sum(steps, F.lit(0.0)) / len(steps)
    spread = F.sqrt(sum(((s - mean) * (s - mean) for s in steps), F.lit(0.0)) / len(steps))
    whole = scored.agg(F.stddev_pop(target).alias("__sd"))
    confidence = F.least(F.lit(1.0), F.exp(-F.coalesce(F.try_divide(spread, "__sd"), F.lit(0.0))))
    return scored.crossJoin(F.broadcast(whole)).select(key, F.col(target).alias("actual"), F.col("prediction").alias("predicted"), confidence.alias("confidence"))


def promising(predictions: DataFrame, ranks: DataFrame, key: str, percentile: float = 0.75) -> DataFrame:
    """Rows predicted over the median whose rank is over the percentile of ranks."""
    both = predictions.join(ranks, key)
    cuts = both.agg(F.median("predicted").alias("__m"), F.percentile("rank", percentile).alias("__p"))
    return both.crossJoin(F.broadcast(cuts)).where("predicted > __m and rank > __p").drop("__m", "__p")


def confident(predictions: DataFrame, least: float = 0.8) -> DataFrame:
    return predictions.where(F.col("confidence") > least)


def prediction_quality(predictions: DataFrame, actuals: DataFrame, key: str) -> DataFrame:
    """mae, rmse, accuracy (1 - mae over mean absolute actual, held in 0..1) on the keys that both have."""
    e = F.col("predicted") - F.col("outcome")
    out = predictions.join(actuals, key).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs("outcome")).alias("__a"))
    return out.withColumn("accuracy", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.try_divide("mae", "__a")))).drop("__a")


def top_terms(terms: DataFrame, group: str, term: str, weight: str, k: int = 3) -> DataFrame:
    """group, label: the k heaviest terms of each group joined by underscores."""
    w = Window.partitionBy(group).orderBy(F.desc(weight), term)
    best = terms.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= k)
    return best.groupBy(group).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__k", term))), lambda s: s[term]), "_").alias("label"))
