"""Per-symbol models with pyspark.ml: direction of the next bar and its return."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence
from multiprocessing.pool import ThreadPool

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch
from .features import FEATURES, LABELS, time_split

KEPT = ["symbol", "timestamp", *LABELS]


def _prepared(df: DataFrame, features: Sequence[str], test_share: float) -> DataFrame:
    clean = df.dropna(subset=[*features, *LABELS])
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(time_split(clean, test_share))


def train(df: DataFrame, symbols: Iterable[str], *, features: Sequence[str] = FEATURES, test_share: float = 0.2, least_rows: int = 60, trees: int = 300, boosts: int = 200, seed: int = 42, at_once: int = 5) -> DataFrame:
    """Held-out predictions of both models for the given symbols, which are few; short ones are skipped.

    Each symbol is two distributed fits over its rows, ``at_once`` symbols at a time. The prepared rows
    and each symbol's predictions are written to the scratch folder, so that nothing depends on a cache.
    The result has pred_proba_up and pred_return.
    """
    spark, root = df.sparkSession, scratch(df.sparkSession, "models")
    _prepared(df, features, test_share).select(*KEPT, "features", "is_test").write.parquet(f"{root}/rows")
    rows = spark.read.parquet(f"{root}/rows")
    found = {r["symbol"]: r["count"] for r in rows.filter(F.col("symbol").isin(list(symbols))).groupBy("symbol").count().filter(F.col("count") >= least_rows).collect()}  # a row a symbol

    def fit(symbol: str) -> str:
        own = rows.filter(F.col("symbol") == symbol)
        # each tree level is a job over these partitions: as many as the rows are worth
        known, held = own.filter("NOT is_test").repartition(1 + found[symbol] // 100_000, "timestamp").persist(), own.filter("is_test")
        try:
            forest = RandomForestClassifier(labelCol="target_up_next", numTrees=trees, maxDepth=6, minInstancesPerNode=20, seed=seed, probabilityCol="probability").fit(known)
            forest = forest.copy()  # without the training summary, which holds the session and can't go to tasks once that has observations
            boosted = GBTRegressor(labelCol="target_return_next", maxIter=boosts, maxDepth=3, stepSize=0.05, seed=seed, predictionCol="pred_return").fit(known)
        finally:
            known.unpersist()
        scored = forest.transform(held).withColumn("pred_proba_up", vector_to_array("probability")[1]).drop("prediction", "rawPrediction", "probability")
        boosted.transform(scored).select(*KEPT, "pred_proba_up", "pred_return").write.parquet(folder := f"{root}/predictions/{uuid.uuid4().hex}")
        return folder

    if not found:
        return df.select(*KEPT, F.lit(None).cast("double").alias("pred_proba_up"), F.lit(None).cast("double").alias("pred_return")).limit(0)
    with ThreadPool(min(at_once, len(found))) as pool:
        return spark.read.parquet(*pool.map(fit, sorted(found)))


def score(pred: DataFrame) -> DataFrame:
    """Per symbol: rows, accuracy at 0.5, mean absolute error, that of predicting no change, and the area under the ROC curve."""
    right = ((F.col("pred_proba_up") > 0.5).cast("int") == F.col("target_up_next")).cast("double")
    scores = pred.groupBy("symbol").agg(
        F.count("*").alias("n_test"),
        F.avg(right).alias("accuracy"),
        F.avg(F.abs(F.col("pred_return") - F.col("target_return_next"))).alias("mae"),
        F.avg(F.abs("target_return_next")).alias("naive_mae"),
    )
    return scores.join(auc(pred), "symbol", "left")


def auc(pred: DataFrame) -> DataFrame:
    """Per symbol the area under the ROC curve, equal scores counting half; null with one class."""
    up = F.col("target_up_next") == 1
    by = pred.filter(F.col("target_up_next").isNotNull() & F.col("pred_proba_up").isNotNull()).groupBy("symbol", "pred_proba_up").agg(F.count_if(up).alias("ups"), F.count_if(~up).alias("downs"))
    below = Window.partitionBy("symbol").orderBy("pred_proba_up").rowsBetween(Window.unboundedPreceding, -1)
    placed = by.withColumn("below", F.coalesce(F.sum("downs").over(below), F.lit(0)))
    area = F.try_divide(F.sum(F.col("ups") * (F.col("below") + F.col("downs") / 2)), F.sum("ups") * F.sum("downs"))
    return placed.groupBy("symbol").agg(area.alias("auc"))
