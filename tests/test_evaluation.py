import math

import pytest

from hemline.functions import metrics as M
from hemline.operators import evaluation as E
from hemline.operators.scaling import LinearScaler


@pytest.fixture(scope="module")
def pred(spark):
    rows = [("i", "r", "c1", 4.0, 2.0), ("i", "b", "c1", 0.0, 0.0), ("j", "r", "c2", 1.0, 3.0), ("k", "r", None, 5.0, 5.0)]
    return spark.createDataFrame(rows, "item string, color string, cat string, true double, pred double")


def test_smape_bounds(pred):
    got = [r[0] for r in pred.select(M.row_smape("pred", "true")).collect()]
    assert got[1] == 0 and got[3] == 0 and all(0 <= g < 1 for g in got)
    assert math.isclose(got[0], 2 / (6 + 1e-6))


def test_category_skips_null(pred):
    got = {r.cat: r.mse for r in E.metric_by_category(pred, "cat", ["mse"]).collect()}
    assert got == {"c1": 2.0, "c2": 4.0}


def test_item_level(pred):
    assert {(r.item, r.true, r.pred) for r in E.item_level(pred, "item").collect()} == {
        ("i", 4.0, 2.0), ("j", 1.0, 3.0), ("k", 5.0, 5.0)
    }
    assert E.item_level(pred, "item", per_row=True).count() == 4


def test_short_batch_weighs_as_much(spark):
    df = spark.createDataFrame([(i, 0.0, 0.0 if i < 4 else 3.0) for i in range(5)], "i int, true double, pred double")
    mean = E.batched_mean(df, M.mse("pred", "true"), "i", size=4)
    assert mean.first()[0] == 4.5


def test_nan_guard(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "p double")
    clean, report = E.nan_guard(df, ["p"])
    assert clean.count() == 2 and tuple(report.first()) == (1, 3)


def test_best_run(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, nan), (2, 0.5), (3, 0.2), (4, 0.2), (5, 0.5)], "epoch int, m double")
    assert E.best_run(df, "m", "min").first().epoch == 3
    assert E.best_run(df, "m", "max").first().epoch == 2
    with pytest.raises(ValueError):
        E.best_run(df, "m", "best")


def test_predictions_round_half_to_even(spark):
    df = spark.createDataFrame([(1.0, 0.125), (2.0, 0.375)], "target double, prediction double")
    got = [r.pred for r in E.predictions(df, LinearScaler(0.0, 1.0)).collect()]
    assert got == [0.12, 0.38]


def test_blended_loss(spark):
    df = spark.createDataFrame([(1.0, 0.0, 4.0, 1.0)], "a double, b double, c double, d double")
    row = E.blended_loss(df, ("a", "b"), ("c", "d"), 0.25, "mse").first()
    assert (row.scaled, row.unscaled, row.loss) == (1.0, 9.0, 7.0)


def test_report_rows(pred):
    rows = E.metric_report({"all": pred}, {"by": (pred, "cat")}, ["mse"]).collect()
    assert {(r.scope, r.category, r.value) for r in rows} == {("all", None, 2.0), ("by", "c1", 2.0), ("by", "c2", 4.0)}
