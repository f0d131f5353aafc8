"""Distributed regressors and their comparison."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemline.functions.metrics import rmse
from hemline.session import materialize


def split_score(key: str | Sequence[str], seed: int = 42) -> Column:
    """Number in [0, 1) that depends only on the key and the seed."""
    keys = [key] if isinstance(key, str) else list(key)
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    return F.conv(F.left(F.md5(text), F.lit(8)), 16, 10).cast("double") / F.lit(float(1 << 32))


def split(
    df: DataFrame, key: str | Sequence[str], test: float = 0.3, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Train and test tables; a row's side does not depend on partitioning."""
    score = split_score(key, seed)
    return df.filter(score >= F.lit(test)), df.filter(score < F.lit(test))


# Fewest rows worth a task of their own.
TASK_ROWS = 10_000


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over the cores, if it has fewer partitions than cores and rows enough for more.

    A fit of trees passes over its rows many times and works long on each, but their bytes are
    few: files of the usual size would leave them to one or two tasks.
    """
    wanted = min(df.sparkSession.sparkContext.defaultParallelism, df.count() // TASK_ROWS)
    return df.repartition(wanted) if wanted > df.rdd.getNumPartitions() else df


def _fit(train: DataFrame, features: Sequence[str], regressor) -> PipelineModel:
    assembler = VectorAssembler(inputCols=list(features), outputCol="__features")
    return Pipeline(stages=[assembler, regressor]).fit(train)


def fit_linear(
    train: DataFrame, features: Sequence[str], label: str, kind: str = "linear", alpha: float = 1.0
) -> PipelineModel:
    """Linear, ridge or lasso regression on unscaled features.

    ``alpha`` weighs the penalty against the sum of squares (ridge) or half
    the mean of squares (lasso).  The solver divides an L2 penalty by the
    label's deviation, which the ridge parameter undoes.
    """
    net, reg = 0.0, 0.0
    if kind == "lasso":
        net, reg = 1.0, alpha
    elif kind == "ridge":
        n, std = train.agg(F.count(label), F.stddev_pop(label)).first()
        reg = alpha * std / n
    elif kind != "linear":
        raise ValueError("kind must be 'linear', 'ridge' or 'lasso'")
    regressor = LinearRegression(
        featuresCol="__features",
        labelCol=label,
        regParam=reg,
        elasticNetParam=net,
        standardization=False,
        maxIter=1000,
        tol=1e-10,
    )
    return _fit(train, features, regressor)


def fit_forest(
    train: DataFrame, features: Sequence[str], label: str, trees: int = 100, depth: int = 30, seed: int = 0
) -> PipelineModel:
    """Random forest that considers every feature at every split; 30 is the deepest that Spark grows."""
    regressor = RandomForestRegressor(
        featuresCol="__features",
        labelCol=label,
        numTrees=trees,
        maxDepth=depth,
        featureSubsetStrategy="all",
        seed=seed,
        # nodes that one pass over the rows may split together
        maxMemoryInMB=1024,
        # a row's place in every tree is kept, where each level of a deep tree would walk down to it again
        cacheNodeIds=True,
    )
    return _fit(spread(train.select(*features, label)), features, regressor)


def fit_bagging(
    train: DataFrame, features: Sequence[str], label: str, trees: int = 10, depth: int = 30, seed: int = 0
) -> PipelineModel:
    """Bagged trees: bootstrap samples, all features."""
    return fit_forest(train, features, label, trees, depth, seed)


def fit_gbt(
    train: DataFrame, features: Sequence[str], label: str, rounds: int = 100, depth: int = 3, seed: int = 23
) -> PipelineModel:
    """Gradient-boosted trees."""
    regressor = GBTRegressor(
        featuresCol="__features", labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=0.1, seed=seed
    )
    return _fit(spread(train.select(*features, label)), features, regressor)


def leaderboard(
    fitters: Mapping[str, Callable[[DataFrame], PipelineModel | Callable[[DataFrame], DataFrame]]],
    train: DataFrame,
    test: DataFrame,
    label: str,
) -> DataFrame:
    """RMSE per model on the test table, with negative predictions set to 0.

    A fitter returns a fitted model, or a function from the test table to a
    table with ``prediction``.  All models are scored on the same rows: those
    that every model answers with a number.  ``rows`` counts them, ``skipped``
    the rows that this model itself left without one.
    """
    numbered = materialize(test.withColumn("__row", F.monotonically_increasing_id()))
    frames = []
    for name, fitter in fitters.items():
        fitted = fitter(train)
        scored = fitted(numbered) if callable(fitted) else fitted.transform(numbered)
        frames.append(scored.select("__row", F.lit(name).alias("model"), F.col(label).alias("y"), "prediction"))
    scored = reduce(DataFrame.unionByName, frames)
    answered = F.col("prediction").isNotNull() & ~F.isnan("prediction")
    scored = scored.withColumn("answered", F.coalesce(answered, F.lit(False)))
    by_row = scored.groupBy("__row").agg(
        F.count_if("answered").alias("models"),
        F.collect_list(F.struct("model", "y", "prediction", "answered")).alias("all"),
    )
    each = by_row.select("models", F.inline("all"))
    common = F.col("models") == len(fitters)
    clipped = F.when(common, F.greatest(F.col("prediction"), F.lit(0.0)))
    return each.withColumn("prediction", clipped).groupBy("model").agg(
        rmse("prediction", "y").alias("rmse"),
        F.count_if(common).alias("rows"),
        F.count_if(~F.col("answered")).alias("skipped"),
    )


def batch_score(df: DataFrame, path: str) -> DataFrame:
    """Apply a saved model to a table."""
    return PipelineModel.load(path).transform(df).drop("__features")
