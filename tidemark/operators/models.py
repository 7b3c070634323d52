"""Models on feature tables, by MLlib."""

from __future__ import annotations

import math

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_dir, written
from . import bins

#: Boosting rounds from one checkpoint of the residuals to the next.
EVERY = 10
#: Bins of a feature, as many as MLlib's trees have by default.
BINS = 32


def cluster_tickers(returns: DataFrame, k: int = 4, seed: int = 0) -> DataFrame:
    """(ticker, cluster) by co-movement; tickers with gaps or without variance are left out, too few get cluster 0.

    A ticker's vector has one component per date, standardised across tickers.
    """
    rows = returns.where("ret is not null")
    dates = rows.agg(F.countDistinct("date").alias("n")).first()["n"]
    per_date = Window.partitionBy("date")
    good = rows.groupBy("ticker").agg(F.count("*").alias("n"), F.var_samp("ret").alias("v")).where((F.col("n") == dates) & (F.col("v") > 1e-12)).select("ticker")
    rows = rows.join(good, "ticker", "left_semi")
    sd = F.stddev_pop("ret").over(per_date)
    rows = rows.withColumn("x", F.when(sd > 0, (F.col("ret") - F.avg("ret").over(per_date)) / sd).otherwise(0.0))
    vectors = rows.groupBy("ticker").agg(F.transform(F.array_sort(F.collect_list(F.struct("date", "x"))), lambda s: s["x"]).alias("x"))
    vectors = written(vectors.select("ticker", array_to_vector("x").alias("features")).orderBy("ticker"))  # k-means depends on the order of rows
    if vectors.count() < k:
        return vectors.select("ticker", F.lit(0).alias("cluster"))
    return KMeans(k=k, seed=seed, predictionCol="cluster").fit(vectors).transform(vectors).select("ticker", "cluster")


def _trees(kind: type, rows: DataFrame, rounds: int, **params):
    """A boosted-tree estimator of depth 3 that checkpoints in the shared folder.

    Each round's residuals depend on those of the round before, so without checkpoints a task carries
    the lineage of all rounds (200 of them overflow the stack) and a lost executor repeats them.
    """
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(rows.sparkSession))
    return kind(maxDepth=3, maxIter=rounds, checkpointInterval=EVERY, **params)


def _thresholds(rows: DataFrame, features: list[str]) -> dict[str, list[float]]:
    """Where each feature's bins meet: between all its values, or at exact quantiles of all rows if it has over ``BINS`` values."""
    values = written(bins.long_features(rows, features, []).groupBy("feature", "value").agg(F.count("*").alias("n")))
    many = values.groupBy("feature").agg(F.count("*").alias("many")).where(F.col("many") > BINS).select("feature")
    few = values.join(F.broadcast(many), "feature", "left_anti").groupBy("feature").agg(F.array_sort(F.collect_list("value")).alias("v"))
    found = {r["feature"]: [(x + y) / 2 for x, y in zip(r["v"], r["v"][1:], strict=False)] for r in few.collect()}
    cut = bins.exact_quantiles(values.join(F.broadcast(many), "feature", "left_semi"), ["feature"], [i / BINS for i in range(1, BINS)], weight="n")
    found |= {r["feature"]: sorted(set(r["q"])) for r in cut.select("feature", "q").collect()}
    return {f: found.get(f) or [0.0] for f in features}  # a feature with one value is told apart nowhere


def _cells(rows: DataFrame, thresholds: dict[str, list[float]], label: str) -> DataFrame:
    """(x, label, weight): one row for all rows in the same bins, with the mean label and their number.

    Trees cut between bins only and squared error falls by the same amount for a cell's rows as for their
    mean, so a weighted fit on cells grows the trees of a fit on rows. Cells do not grow with the rows.
    """
    own = [bins.bucket(F.col(f), [-math.inf, *t, math.inf]).cast("double").alias(f"_bin_{f}") for f, t in thresholds.items()]
    names = [f"_bin_{f}" for f in thresholds]
    cells = rows.select(*own, F.col(label).cast("double").alias(label)).groupBy(*names).agg(F.avg(label).alias(label), F.count("*").cast("double").alias("weight"))
    return written(VectorAssembler(inputCols=names, outputCol="x").transform(cells).select("x", label, "weight"))


def fit_return_model(rows: DataFrame, features: list[str], label: str, seed: int = 0, rounds: int = 120):
    """A boosted-tree regressor of the next return, on features in bins, and the deviation of its residuals.

    ``rows`` are read a few times, not in every round; the rounds read cells. Trees need no scaling, as
    they look at the order of values only.
    """
    clean = rows.dropna(subset=[*features, label])
    thresholds = _thresholds(clean, features)
    # MLlib finds the bounds of bins from maxBins * maxBins rows: that many so that no bin is missed
    trees = _trees(GBTRegressor, rows, rounds, featuresCol="x", labelCol=label, weightCol="weight", maxBins=BINS * BINS, seed=seed).fit(_cells(clean, thresholds, label))
    names = [f"_bin_{f}" for f in features]
    binned = Bucketizer(splitsArray=[[-math.inf, *thresholds[f], math.inf] for f in features], inputCols=features, outputCols=names)
    model = PipelineModel([binned, VectorAssembler(inputCols=names, outputCol="x"), trees])
    sigma = model.transform(clean).agg(F.stddev_pop(F.col(label) - F.col("prediction")).alias("s")).first()["s"]
    return model, sigma


def fit_fill_model(rows: DataFrame, features: list[str], label: str = "label", least_rows: int = 500, least_fills: int = 20, seed: int = 0, rounds: int = 80):
    """A boosted-tree fill classifier with isotonic calibration; None under the minimum of rows or fills."""
    n, fills = rows.agg(F.count("*"), F.sum(label)).first()
    if n < least_rows or (fills or 0) < least_fills:
        return None
    assembled = VectorAssembler(inputCols=features, outputCol="x", handleInvalid="skip").transform(rows)
    trees = _trees(GBTClassifier, rows, rounds, featuresCol="x", labelCol=label, seed=seed).fit(assembled)
    scored = trees.transform(assembled).withColumn("p", vector_to_array("probability")[1])
    return trees, IsotonicRegression(featuresCol="p", labelCol=label, predictionCol="p_fill").fit(scored.select("p", F.col(label).cast("double").alias(label)))


def fill_probability(model, rows: DataFrame, features: list[str]) -> DataFrame:
    trees, curve = model
    scored = trees.transform(VectorAssembler(inputCols=features, outputCol="x", handleInvalid="skip").transform(rows))
    return curve.transform(scored.withColumn("p", vector_to_array("probability")[1])).drop("x", "rawPrediction", "probability", "prediction", "p")


def auc_brier(scored: DataFrame, probability: str, label: str) -> tuple[float, float]:
    auc = BinaryClassificationEvaluator(rawPredictionCol=probability, labelCol=label).evaluate(scored.withColumn(probability, F.col(probability).cast("double")))
    return auc, scored.agg(F.avg(F.pow(F.col(probability) - F.col(label), 2))).first()[0]


def _probe_input(rows: DataFrame, features: list[str], label: str) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="x").transform(rows.dropna(subset=[*features, label]))


def fit_probe(rows: DataFrame, features: list[str], label: str = "y", seed: int = 0, rounds: int = 200):
    """A boosted-tree classifier fitted on the train split."""
    trees = _trees(GBTClassifier, rows, rounds, featuresCol="x", labelCol=label, seed=seed)
    return trees.fit(_probe_input(rows, features, label).where("split = 'train'"))


def directional_probe(rows: DataFrame, features: list[str], label: str = "y", seed: int = 0, rounds: int = 200) -> DataFrame:
    """Rows of the eval split with ``pred`` of a classifier fitted on the train split."""
    model = fit_probe(rows, features, label, seed, rounds)
    scored = model.transform(_probe_input(rows, features, label).where("split = 'eval'"))
    return scored.withColumn("pred", F.col("prediction").cast("int")).drop("x", "rawPrediction", "probability", "prediction")


def importances(model, features: list[str], spark, n: int = 10) -> DataFrame:
    """The ``n`` most important features of a fitted tree model."""
    values = model.featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(features, values, strict=True)), "feature string, importance double").orderBy(F.col("importance").desc(), "feature").limit(n)
