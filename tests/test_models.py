import numpy as np
import pytest
from pyspark.sql import functions as F

from hemline.operators import models as L


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(240, 3)) * [1.0, 5.0, 0.5] + 2
    y = x @ [3.0, -1.0, 0.0] + 20 + rng.normal(size=240)
    data = [(int(i), *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(data, "id long, a double, b double, c double, y double").repartition(5)


FEATURES = ["a", "b", "c"]


def _weights(model):
    fitted = model.stages[-1]
    return np.array([*fitted.coefficients, fitted.intercept])


@pytest.mark.parametrize("kind,penalty", [("linear", 0.0), ("ridge", 1.0)])
def test_linear_and_ridge_closed_form(rows, kind, penalty):
    x, y, df = rows
    xc, yc = x - x.mean(axis=0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + penalty * np.eye(3), xc.T @ yc)
    want = [*w, y.mean() - x.mean(axis=0) @ w]
    assert np.allclose(_weights(L.fit_linear(df, FEATURES, "y", kind)), want, atol=1e-6)


def test_lasso_by_coordinate_descent(rows):
    x, y, df = rows
    xc, yc, n = x - x.mean(axis=0), y - y.mean(), len(y)
    w = np.zeros(3)
    for _ in range(2000):
        for j in range(3):
            rho = xc[:, j] @ (yc - xc @ w + xc[:, j] * w[j]) / n
            w[j] = np.sign(rho) * max(abs(rho) - 1.0, 0) / (xc[:, j] @ xc[:, j] / n)
    assert np.allclose(_weights(L.fit_linear(df, FEATURES, "y", "lasso"))[:3], w, atol=1e-3)


def test_split_does_not_depend_on_partitions(rows):
    _, _, df = rows
    train, test = L.split(df, "id")
    again = L.split(df.repartition(17), "id")[1]
    ids = {r.id for r in test.collect()}
    assert ids == {r.id for r in again.collect()}
    assert train.count() + test.count() == 240 and 40 < len(ids) < 105
    assert ids != {r.id for r in L.split(df, "id", seed=7)[1].collect()}


def test_trees_beat_the_mean(rows):
    _, _, df = rows
    train, test = L.split(df, "id")
    mean = train.agg({"y": "avg"}).first()[0]

    def constant(_):
        from pyspark.sql import functions as F

        return lambda t: t.withColumn("prediction", F.lit(mean))

    board = L.leaderboard(
        {
            "mean": constant,
            "forest": lambda r: L.fit_forest(r, FEATURES, "y", trees=10, depth=5),
            "bagging": lambda r: L.fit_bagging(r, FEATURES, "y", depth=5),
            "boosting": lambda r: L.fit_gbt(r, FEATURES, "y", rounds=20),
        },
        train,
        test,
        "y",
    )
    score = {r.model: r.rmse for r in board.collect()}
    assert all(score[m] < score["mean"] for m in ("forest", "bagging", "boosting"))


def test_negative_predictions_count_as_zero(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, 3.0)], "id int, y double")
    board = L.leaderboard({"m": lambda _: lambda t: t.withColumn("prediction", F.lit(-5.0))}, df, df, "y")
    assert board.first().rmse == 3.0


def test_rows_of_a_fit_are_dealt_over_the_cores(spark, monkeypatch):
    monkeypatch.setattr(L, "TASK_ROWS", 100)
    df = spark.range(1000).coalesce(1).select(F.col("id").cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y"))
    assert L.spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert L.spread(df.limit(150)).rdd.getNumPartitions() == 1 and L.spread(df.repartition(30)).rdd.getNumPartitions() == 30
    seen, fit = [], L._fit
    monkeypatch.setattr(L, "_fit", lambda train, *args: seen.append(train.rdd.getNumPartitions()) or fit(train, *args))
    L.fit_forest(df, ["x"], "y", trees=2, depth=2)
    L.fit_gbt(df, ["x"], "y", rounds=2)
    assert seen == [8, 8]
