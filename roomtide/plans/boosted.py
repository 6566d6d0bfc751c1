"""Gradient-boosted trees on the hourly series."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import SparkContext
from pyspark.ml import PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor, GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, functions as F

from roomtide.plans.forecast import cut_at
from roomtide.session import durable

TARGET = "occupancy"
NOT_FEATURES = {TARGET, "timestamp", "slot", "slots", "part"}
FIRST_SLOT = 24  # the 24 h lag is missing before it
STAGES_KEPT = 16  # trees whose shares a plan adds up before the sum is written


@dataclass(frozen=True)
class TreeForecast:
    model: PipelineModel
    predictions: DataFrame

    def mean_absolute_error(self) -> float:
        judge = RegressionEvaluator(labelCol=TARGET, predictionCol="prediction", metricName="mae")
        return judge.evaluate(self.predictions)


def split_hourly(features: DataFrame, train_ratio: float, holdout: float) -> DataFrame:
    """Label rows ``train``, ``validate`` or ``test`` by position in time.

    Validation rows are the tail of the training rows, so stopping early never
    looks at the test rows. Positions follow from the slot number.
    """
    n, pos = F.col("slots") - FIRST_SLOT, F.col("slot") - FIRST_SLOT
    train = cut_at(n, train_ratio)
    fit = F.floor(train.cast("double") * F.lit(1.0 - holdout))
    return features.withColumn("part", F.when(pos < fit, "train").when(pos < train, "validate").otherwise("test"))


def assembled(like: GBTRegressionModel, trees: list, rate: float) -> GBTRegressionModel:
    """A boosted model of the given trees: the first counts in full, the others at the learning rate."""
    context = SparkContext._active_spark_context
    package = context._jvm.org.apache.spark.ml.regression
    members = context._gateway.new_array(package.DecisionTreeRegressionModel, len(trees))
    weights = context._gateway.new_array(context._jvm.double, len(trees))
    for i, tree in enumerate(trees):
        members[i], weights[i] = tree._java_obj, 1.0 if i == 0 else rate
    model = GBTRegressionModel(package.GBTRegressionModel(like.uid, members, weights))
    return model.setFeaturesCol(like.getFeaturesCol()).setPredictionCol(like.getPredictionCol())


def stage(rows: DataFrame, tree: DecisionTreeRegressionModel, rate: float) -> DataFrame:
    """``rows`` with the tree's share added to ``reached``, the prediction so far."""
    done = tree.setPredictionCol("_tree").transform(rows)
    return done.withColumn("reached", F.col("reached") + F.col("_tree") * rate).select("inputs", TARGET, "reached")


def boost(
    fit: DataFrame, watched: DataFrame | None, like: GBTRegressor, rounds: int, patience: int,
) -> GBTRegressionModel:
    """Boost until ``patience`` trees in a row have not lowered the validation error, and cut after the best tree.

    The first trees, which patience needs in any case, are grown in one run.
    From there the fitted model is continued tree by tree: boosting with squared
    error fits each tree to twice the residuals. The predictions reached so far
    are written every ``STAGES_KEPT`` trees. No tree is grown twice, and the cut
    is a prefix of the trees.
    """
    if watched is None:
        return like.copy({like.maxIter: rounds}).fit(fit)
    first = like.copy({like.maxIter: min(patience + 1, rounds)}).fit(fit)
    trees, rate = first.trees, like.getStepSize()
    errors = first.evaluateEachIteration(watched, "squared")
    one = DecisionTreeRegressor(
        labelCol="residual", featuresCol="inputs", maxDepth=like.getMaxDepth(), seed=like.getSeed()
    )
    so_far = [first.setPredictionCol("reached").transform(part).select("inputs", TARGET, "reached") for part in (fit, watched)]
    miss = F.col(TARGET) - F.col("reached")
    while len(trees) < rounds and len(trees) - (errors.index(min(errors)) + 1) < patience:
        if (len(trees) - patience - 1) % STAGES_KEPT == 0:
            so_far = [durable(part) for part in so_far]
        trees.append(one.fit(so_far[0].withColumn("residual", miss * 2.0)))
        so_far = [stage(part, trees[-1], rate) for part in so_far]
        errors.append(so_far[1].agg(F.avg(miss * miss)).first()[0])
    return assembled(first.setPredictionCol("prediction"), trees[:errors.index(min(errors)) + 1], rate)


def train_trees(
    features: DataFrame, train_ratio: float = 0.8, holdout: float = 0.1, rounds: int = 1000,
    learning_rate: float = 0.05, depth: int = 6, patience: int = 50, seed: int = 7,
) -> TreeForecast:
    """Fit on the first part of the series and predict the rest; ``boost`` says when training stops."""
    rows = split_hourly(features, train_ratio, holdout)
    inputs = [c for c in features.columns if c not in NOT_FEATURES]
    assembler = VectorAssembler(inputCols=inputs, outputCol="inputs")
    known = assembler.transform(durable(rows.where(F.col("part") != "test")))
    fit, watched = known.where(F.col("part") == "train"), known.where(F.col("part") == "validate")
    like = GBTRegressor(labelCol=TARGET, featuresCol="inputs", stepSize=learning_rate, maxDepth=depth, seed=seed)
    grown = boost(fit, None if watched.isEmpty() else watched, like, rounds, patience)
    model = PipelineModel([assembler, grown])
    tested = model.transform(rows.where(F.col("part") == "test"))
    predictions = tested.select("timestamp", TARGET, "prediction")
    return TreeForecast(model, predictions)


def forecast_error(actual: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row: rows predicted, mean absolute and root mean squared error of ``occupancy`` against ``prediction``."""
    pairs = actual.select("timestamp", TARGET).join(predicted.select("timestamp", "prediction"), "timestamp")
    miss = F.col(TARGET) - F.col("prediction")
    return pairs.agg(
        F.count(F.lit(1)).alias("rows"), F.avg(F.abs(miss)).alias("mae"), F.sqrt(F.avg(miss * miss)).alias("rmse"),
    )
