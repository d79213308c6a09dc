"""Learners from Spark ML behind the feature tables."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import PCA, BucketedRandomProjectionLSH, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assembled(rows: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(rows.na.fill(0.0, features))


def fit_gbt(rows: DataFrame, features: list[str], rounds: int = 20, depth: int = 4, seed: int = 42):
    """A pointwise stand-in for LambdaRank, which Spark ML lacks: boosted trees on the label; ranks come from the
    probability within a query."""
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), GBTClassifier(labelCol="label", maxIter=rounds, maxDepth=depth, seed=seed)]).fit(rows)


def fit_logistic(rows: DataFrame, features: list[str], balanced: bool = True):
    """Standardised logistic regression; balanced classes weigh alike."""
    if balanced:
        n = rows.agg(F.count("*").alias("n"), F.sum("label").alias("p")).first()
        pos, neg = max(n["p"] or 0, 1), max(n["n"] - (n["p"] or 0), 1)
        rows = rows.withColumn("_w", F.when(F.col("label") == 1, n["n"] / (2.0 * pos)).otherwise(n["n"] / (2.0 * neg)))
    model = LogisticRegression(labelCol="label", featuresCol="scaled", maxIter=50, **({"weightCol": "_w"} if balanced else {}))
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), StandardScaler(inputCol="features", outputCol="scaled", withMean=True), model]).fit(rows)


def predicted(model, rows: DataFrame) -> DataFrame:
    """rows with prob."""
    keep = rows.columns
    return model.transform(rows).withColumn("prob", vector_to_array("probability")[1]).select(*keep, "prob")


def search(rows: DataFrame, features: list[str], depths: tuple[int, ...] = (3, 5), rounds: tuple[int, ...] = (10, 20), folds: int = 3, fold_column: str | None = None):
    """Cross-validated choice of depth and rounds; fold_column keeps groups together."""
    gbt = GBTClassifier(labelCol="label", seed=42)
    grid = ParamGridBuilder().addGrid(gbt.maxDepth, list(depths)).addGrid(gbt.maxIter, list(rounds)).build()
    cv = CrossValidator(estimator=Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), gbt]), estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(labelCol="label"), numFolds=folds, **({"foldCol": fold_column} if fold_column else {}))
    return cv.fit(rows)


def importance(model, features: list[str]) -> list[tuple[str, float]]:
    got = model.stages[-1].featureImportances.toArray()
    return sorted(((f, float(x)) for f, x in zip(features, got, strict=True)), key=lambda x: (-x[1], x[0]))


def clusters(vectors: DataFrame, k: int, rounds: int = 20, seed: int = 42) -> tuple[DataFrame, float]:
    """((doc_id, cluster), inertia) of vectors (doc_id, v)."""
    rows = vectors.select("doc_id", array_to_vector(F.col("v").cast("array<double>")).alias("features"))
    model = KMeans(k=k, maxIter=rounds, seed=seed).fit(rows)
    return model.transform(rows).select("doc_id", F.col("prediction").alias("cluster")), float(model.summary.trainingCost)


def inertia_sweep(vectors: DataFrame, ks: tuple[int, ...]) -> list[tuple[int, float]]:
    return [(k, clusters(vectors, k)[1]) for k in ks]


def cluster_sizes(assigned: DataFrame) -> DataFrame:
    """Sizes' mean, median, max, min, deviation, share of the largest tenth and slope of ln(size) on ln(rank)."""
    from pyspark.sql import Window

    n = assigned.groupBy("cluster").agg(F.count("*").alias("n"))
    r = n.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "cluster"))).withColumn("k", F.count("*").over(Window.partitionBy()))
    return r.agg(F.count("*").alias("clusters"), F.avg("n").alias("mean"), F.percentile("n", 0.5).alias("median"), F.max("n").alias("largest"), F.min("n").alias("smallest"), F.stddev_pop("n").alias("deviation"), (F.sum(F.when(F.col("rank") <= F.ceil(F.col("k") / 10), F.col("n")).otherwise(0)) / F.sum("n")).alias("head"), F.regr_slope(F.ln("n"), F.ln("rank")).alias("slope"))


def pca(vectors: DataFrame, k: int) -> DataFrame:
    rows = vectors.select("doc_id", array_to_vector(F.col("v").cast("array<double>")).alias("features"))
    return PCA(k=k, inputCol="features", outputCol="p").fit(rows).transform(rows).select("doc_id", vector_to_array("p").alias("v"))


def near_pairs(queries: DataFrame, vectors: DataFrame, distance: float, width: float = 0.5, tables: int = 4) -> DataFrame:
    """Approximate pairs by random projections: (query_id, doc_id, distance)."""
    q = queries.select("query_id", array_to_vector(F.col("v").cast("array<double>")).alias("features"))
    v = vectors.select("doc_id", array_to_vector(F.col("v").cast("array<double>")).alias("features"))
    lsh = BucketedRandomProjectionLSH(inputCol="features", outputCol="h", bucketLength=width, numHashTables=tables, seed=42).fit(v)
    return lsh.approxSimilarityJoin(q, v, distance, "distance").select("datasetA.query_id", "datasetB.doc_id", "distance")
