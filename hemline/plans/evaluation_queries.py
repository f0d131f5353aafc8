"""Models and metrics.

Prediction rows are per part and return flag: the truth is the quantity sold,
the prediction the average of the part's type.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemline.functions import metrics as M
from hemline.operators import evaluation as E
from hemline.operators import models as L
from hemline.operators import neighbors as N
from hemline.operators import scaling as Z
from hemline.operators import stages as St
from hemline.plans.neighbor_queries import SPLIT_SQL
from hemline.plans.registry import Tables, query, rounded
from hemline.plans.sales_queries import TARGET_SQL, targets
from hemline.session import materialize, scratch_path

PRED_SQL = """base AS (
  SELECT l_partkey AS item, l_returnflag AS color, p_type AS category, sum(l_quantity) AS "true"
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL
), pred AS (SELECT *, round_even(avg("true") OVER (PARTITION BY category), 2) AS pred FROM base)"""


def prediction_rows(t: Tables) -> DataFrame:
    """item, color, category, true, pred.

    The sums are written once, and so are the means: their measured size makes
    them a broadcast, where a join on six categories would shuffle into six tasks.
    """
    kinds = t.part.select(F.col("p_partkey").alias("item"), F.col("p_type").alias("category"))
    sums = t.lineitem.groupBy(F.col("l_partkey").alias("item"), F.col("l_returnflag").alias("color")).agg(
        F.sum("l_quantity").alias("true")
    )
    rows = materialize(sums.join(kinds, "item"))
    means = materialize(rows.groupBy("category").agg(F.avg("true").alias("mean")))
    return E.predictions(rows.join(means, "category"), None, "mean", "true", keep=["item", "color", "category"])


@query(
    "h1_split",
    f"SELECT l_orderkey, l_linenumber, l_partkey, {SPLIT_SQL.format(key='l_orderkey')} < 0.3 AS in_test FROM lineitem",
)
def h1(t):
    keyed = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    train, test = L.split(keyed, "l_orderkey")
    return train.withColumn("in_test", F.lit(False)).unionByName(test.withColumn("in_test", F.lit(True)))


FEATURES = ["p_size", "p_retailprice"]


def model_sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Train and test rows (item, features, target), written once for the passes of a fit, in files enough for all cores."""
    attrs = t.part.select(F.col("p_partkey").alias("item"), *FEATURES)
    rows = materialize(targets(t).join(attrs, "item").select("item", *FEATURES, "target"))
    dealt = L.spread(rows)
    return L.split(rows if dealt is rows else materialize(dealt), "item")


# Closed form of two centred features; the ridge penalty joins the diagonal.
def solved_sql(alpha: float) -> str:
    return f"""{TARGET_SQL}, rows AS (
      SELECT item, CAST(p_size AS DOUBLE) AS x1, p_retailprice AS x2, target AS y,
        {SPLIT_SQL.format(key="item")} < 0.3 AS in_test FROM target JOIN part ON item = p_partkey),
    m AS (SELECT avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my FROM rows WHERE NOT in_test),
    s AS (SELECT sum((x1 - m1) * (x1 - m1)) + {alpha} AS s11, sum((x2 - m2) * (x2 - m2)) + {alpha} AS s22,
        sum((x1 - m1) * (x2 - m2)) AS s12, sum((x1 - m1) * (y - my)) AS s1y, sum((x2 - m2) * (y - my)) AS s2y
      FROM rows, m WHERE NOT in_test),
    w AS (SELECT (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS w1,
        (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS w2 FROM s),
    scored AS (SELECT item, y, my + w1 * (x1 - m1) + w2 * (x2 - m2) AS prediction FROM rows, m, w WHERE in_test)"""


_SCORED = "WITH {} SELECT item, round(prediction, 4) AS prediction FROM scored"


def _scored(model, test):
    return model.transform(test).select("item", rounded("prediction", 4).alias("prediction"))


@query("h2_fit_linear", _SCORED.format(solved_sql(0.0)))
def h2(t):
    train, test = model_sides(t)
    return _scored(L.fit_linear(train, FEATURES, "target"), test)


@query("h2_fit_ridge", _SCORED.format(solved_sql(1.0)))
def h2_ridge(t):
    train, test = model_sides(t)
    return _scored(L.fit_linear(train, FEATURES, "target", "ridge"), test)


# Of the sparse and signed solutions of two centred features, the one with the lowest penalised error.
LASSO_SQL = f"""{TARGET_SQL}, rows AS (
  SELECT item, CAST(p_size AS DOUBLE) AS x1, p_retailprice AS x2, target AS y,
    {SPLIT_SQL.format(key="item")} < 0.3 AS in_test FROM target JOIN part ON item = p_partkey),
m AS (SELECT avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, count(*) AS n FROM rows WHERE NOT in_test),
s AS (SELECT any_value(n) AS n, sum((x1 - m1) * (x1 - m1)) AS s11, sum((x2 - m2) * (x2 - m2)) AS s22,
    sum((x1 - m1) * (x2 - m2)) AS s12, sum((x1 - m1) * (y - my)) AS s1y, sum((x2 - m2) * (y - my)) AS s2y
  FROM rows, m WHERE NOT in_test),
signs AS (SELECT a.g AS g1, b.g AS g2 FROM (VALUES (-1), (0), (1)) a(g), (VALUES (-1), (0), (1)) b(g)),
tried AS (SELECT s.*,
    CASE WHEN g1 = 0 THEN 0 WHEN g2 = 0 THEN (s1y - n * g1) / s11
      ELSE ((s1y - n * g1) * s22 - (s2y - n * g2) * s12) / (s11 * s22 - s12 * s12) END AS w1,
    CASE WHEN g2 = 0 THEN 0 WHEN g1 = 0 THEN (s2y - n * g2) / s22
      ELSE ((s2y - n * g2) * s11 - (s1y - n * g1) * s12) / (s11 * s22 - s12 * s12) END AS w2 FROM s, signs),
w AS (SELECT w1, w2 FROM tried ORDER BY (w1 * w1 * s11 + 2 * w1 * w2 * s12 + w2 * w2 * s22 - 2 * w1 * s1y - 2 * w2 * s2y)
    / (2 * n) + abs(w1) + abs(w2) LIMIT 1),
scored AS (SELECT item, my + w1 * (x1 - m1) + w2 * (x2 - m2) AS prediction FROM rows, m, w WHERE in_test)"""


@query("h2_fit_lasso", _SCORED.format(LASSO_SQL))
def h2_lasso(t):
    train, test = model_sides(t)
    return _scored(L.fit_linear(train, FEATURES, "target", "lasso"), test)


@query("h3_fit_forest")
def h3(t):
    train, test = model_sides(t)
    return _scored(L.fit_forest(train, FEATURES, "target"), test)


@query("h3_fit_bagging")
def h3_bagging(t):
    train, test = model_sides(t)
    return _scored(L.fit_bagging(train, FEATURES, "target"), test)


@query("h4_fit_gbt")
def h4(t):
    train, test = model_sides(t)
    return _scored(L.fit_gbt(train, FEATURES, "target"), test)


_RMSE = """SELECT '{name}' AS model, round(sqrt(avg((greatest(prediction, 0) - y) * (greatest(prediction, 0) - y))), 4) AS rmse
  FROM (WITH {body} SELECT * FROM scored)"""


@query(
    "h5_leaderboard",
    _RMSE.format(name="linear", body=solved_sql(0.0)) + " UNION ALL " + _RMSE.format(name="ridge", body=solved_sql(1.0)),
)
def h5(t):
    train, test = model_sides(t)
    fitters = {
        kind: lambda rows, kind=kind: L.fit_linear(rows, FEATURES, "target", kind) for kind in ("linear", "ridge")
    }
    return L.leaderboard(fitters, train, test, "target").select("model", rounded("rmse", 4).alias("rmse"))


@query("h5_leaderboard_full")
def h5_full(t):
    train, test = model_sides(t)

    def neighbors(rows):
        def packed(df):
            return df.withColumn("vec", F.array(*[F.col(c).cast("double") for c in FEATURES]))

        def score(df):
            guess = N.knn_regress(packed(rows), packed(df), "target", 4, id_col="item")
            return df.join(guess.withColumnRenamed("qid", "item"), "item")

        return score

    fitters = {
        "forest": lambda rows: L.fit_forest(rows, FEATURES, "target"),
        "neighbors": neighbors,
        "bagging": lambda rows: L.fit_bagging(rows, FEATURES, "target"),
        "boosting": lambda rows: L.fit_gbt(rows, FEATURES, "target"),
        "linear": lambda rows: L.fit_linear(rows, FEATURES, "target"),
        "lasso": lambda rows: L.fit_linear(rows, FEATURES, "target", "lasso"),
        "ridge": lambda rows: L.fit_linear(rows, FEATURES, "target", "ridge"),
    }
    return L.leaderboard(fitters, train, test, "target").select("model", rounded("rmse", 4).alias("rmse"))


@query(
    "h6_nan_guard",
    f"""WITH {PRED_SQL} SELECT category, count(*) FILTER (WHERE item % 7 = 0) AS skipped, count(*) AS rows
    FROM pred GROUP BY category""",
)
def h6(t):
    rows = prediction_rows(t)
    holed = rows.withColumn("pred", F.when(F.col("item") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("pred")))
    return E.nan_guard(holed, ["pred"], by="category")[1]


@query(
    "h6_write_guarded",
    f"""WITH {PRED_SQL} SELECT category, count(*) FILTER (WHERE item % 7 = 0) AS skipped, count(*) AS rows,
    count(*) FILTER (WHERE item % 7 <> 0) AS written FROM pred GROUP BY category""",
)
def h6_written(t):
    rows = prediction_rows(t)
    holed = rows.withColumn("pred", F.when(F.col("item") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("pred")))
    groups = [r[0] for r in t.part.select("p_type").distinct().collect()]
    kept, report = E.write_guarded(holed, ["pred"], "category", groups)
    return report.join(kept.groupBy("category").agg(F.count("*").alias("written")), "category")


_SMAPE = "abs(pred - \"true\") / (abs(pred) + abs(\"true\") + 1e-6)"


@query("h7_adjusted_smape", f"WITH {PRED_SQL} SELECT round(avg({_SMAPE}), 6) AS smape FROM pred")
def h7(t):
    return E.overall_smape(prediction_rows(t)).select(rounded("smape").alias("smape"))


@query("h8_row_smape", f"WITH {PRED_SQL} SELECT item, color, round({_SMAPE}, 6) AS smape FROM pred")
def h8(t):
    return prediction_rows(t).select("item", "color", rounded(M.row_smape("pred", "true")).alias("smape"))


@query(
    "h9_mse_rmse",
    f"""WITH {PRED_SQL} SELECT round(avg(pow(pred - "true", 2)), 4) AS mse,
    round(sqrt(avg(pow(pred - "true", 2))), 6) AS rmse FROM pred""",
)
def h9(t):
    return prediction_rows(t).agg(
        rounded(M.mse("pred", "true"), 4).alias("mse"), rounded(M.rmse("pred", "true")).alias("rmse")
    )


@query(
    "h10_blended_loss",
    f"""WITH {PRED_SQL}, m AS (SELECT avg(pow(ln(pred) - ln("true"), 2)) AS scaled, avg(pow(pred - "true", 2)) AS unscaled
    FROM pred) SELECT round(scaled, 6) AS scaled, round(unscaled, 4) AS unscaled,
    round(0.3 * scaled + 0.7 * unscaled, 4) AS loss FROM m""",
)
def h10(t):
    rows = prediction_rows(t).withColumn("ln_pred", F.log("pred")).withColumn("ln_true", F.log("true"))
    loss = E.blended_loss(rows, ("ln_pred", "ln_true"), ("pred", "true"), 0.3, "mse")
    return loss.select(
        rounded("scaled").alias("scaled"), rounded("unscaled", 4).alias("unscaled"), rounded("loss", 4).alias("loss")
    )


@query(
    "h11_batched_mean",
    f"""WITH {PRED_SQL}, i AS (SELECT *, row_number() OVER (ORDER BY item, color) - 1 AS i FROM pred)
    SELECT round(avg(v), 6) AS smape FROM (SELECT i // 64 AS b, avg({_SMAPE}) AS v FROM i GROUP BY b)""",
)
def h11(t):
    mean = E.batched_mean(prediction_rows(t), M.adjusted_smape("pred", "true"), ["item", "color"], name="smape")
    return mean.withColumn("smape", rounded("smape"))


@query(
    "h12_item_level",
    f'WITH {PRED_SQL} SELECT item, sum("true") AS "true", round(sum(pred), 6) AS pred FROM pred GROUP BY item',
)
def h12(t):
    return E.item_level(prediction_rows(t), "item").withColumn("pred", rounded("pred"))


@query(
    "h12_item_level_per_row",
    f"""WITH {PRED_SQL} SELECT item, sum("true") OVER (PARTITION BY item) AS "true",
    round(sum(pred) OVER (PARTITION BY item), 6) AS pred FROM pred""",
)
def h12_rows(t):
    return E.item_level(prediction_rows(t), "item", per_row=True).withColumn("pred", rounded("pred"))


_BY_CATEGORY = f"""SELECT category, round(avg({_SMAPE}), 6) AS smape,
  round(sqrt(avg(pow(pred - "true", 2))), 6) AS rmse FROM {{}} GROUP BY category"""


@query("h13_metric_by_category", f"WITH {PRED_SQL} {_BY_CATEGORY.format('pred')}")
def h13(t):
    rows = E.metric_by_category(prediction_rows(t), "category", ["smape", "rmse"])
    return rows.select("category", rounded("smape").alias("smape"), rounded("rmse").alias("rmse"))


@query(
    "h13_metric_by_category_items",
    f"""WITH {PRED_SQL}, items AS (SELECT item, category, sum("true") AS "true", sum(pred) AS pred FROM pred
    GROUP BY item, category) {_BY_CATEGORY.format("items")}""",
)
def h13_items(t):
    from hemline.operators.catalog import attach_category

    rows = prediction_rows(t)
    items = attach_category(E.item_level(rows, "item"), rows, ["item"])
    scored = E.metric_by_category(items, "category", ["smape", "rmse"])
    return scored.select("category", rounded("smape").alias("smape"), rounded("rmse").alias("rmse"))


@query(
    "h14_predictions",
    f"""WITH {TARGET_SQL}, q AS (SELECT quantile_cont(target, 0.16) AS lo, quantile_cont(target, 0.84) AS hi FROM target),
    anchor AS (SELECT 2 / (sqrt(lo) - sqrt(hi)) AS a, 2 / (sqrt(lo) - sqrt(hi)) * sqrt(lo) - 1 AS b FROM q),
    x AS (SELECT item, target, a, b, avg(a * sqrt(target) - b) OVER (PARTITION BY p_type) AS guess
      FROM target JOIN part ON item = p_partkey, anchor)
    SELECT item, target AS "true", round(pow((guess + b) / a, 2), 2) AS pred FROM x""",
)
def h14(t):
    kinds = t.part.select(F.col("p_partkey").alias("item"), "p_type")
    rows = materialize(targets(t).join(kinds, "item"))
    scaler = Z.fit_anchor(rows, "target", lam=0.5)
    scaled = scaler.scale(rows, "target")
    means = materialize(scaled.groupBy("p_type").agg(F.avg("scaled").alias("guess")))
    return E.predictions(scaled.join(means, "p_type"), scaler, "guess", keep=["item"])


_HISTORY = """history AS (SELECT month(o_orderdate) AS epoch, round(avg(o_totalprice), 4) AS test_loss,
  round(stddev_pop(o_totalprice), 4) AS test_eval FROM orders GROUP BY 1)"""


def _history(t):
    return t.orders.groupBy(F.month("o_orderdate").cast("long").alias("epoch")).agg(
        rounded(F.avg("o_totalprice"), 4).alias("test_loss"),
        rounded(F.stddev_pop("o_totalprice"), 4).alias("test_eval"),
    )


@query("h15_best_run", f"WITH {_HISTORY} SELECT * FROM history ORDER BY test_loss, epoch LIMIT 1")
def h15(t):
    return E.best_run(_history(t), "test_loss", "min")


@query("h15_best_run_max", f"WITH {_HISTORY} SELECT * FROM history ORDER BY test_eval DESC, epoch LIMIT 1")
def h15_max(t):
    return E.best_run(_history(t), "test_eval", "max")


@query("h16_batch_score", _SCORED.format(solved_sql(0.0)))
def h16(t):
    train, test = model_sides(t)
    path = scratch_path(t.spark)
    L.fit_linear(train, FEATURES, "target").save(path)
    return L.batch_score(test, path).select("item", rounded("prediction", 4).alias("prediction"))


# The closed form on a scaled target: both sides of the anchors and the power 0.5 from the training rows.
_SCALED_SQL = solved_sql(0.0).replace("m AS (", """q AS (SELECT sqrt(quantile_cont(y, 0.16)) AS lo, sqrt(quantile_cont(y, 0.84)) AS hi FROM raw WHERE NOT in_test),
    rows AS (SELECT item, x1, x2, in_test, 2 / (lo - hi) * sqrt(y) - (2 / (lo - hi) * lo - 1) AS y FROM raw, q),
    m AS (""", 1).replace("rows AS (", "raw AS (", 1)


@query(
    "h16_scaled_pipeline",
    f"""WITH {_SCALED_SQL} SELECT item, round(pow((prediction + 2 / (lo - hi) * lo - 1) / (2 / (lo - hi)), 2), 4) AS prediction FROM scored, q""",
)
def h16_scaled(t):
    """Scaling, model and unscaling as one saved object."""
    train, test = model_sides(t)
    path = scratch_path(t.spark)
    scale = St.TargetScaler(inputCol="target", outputCol="scaled", lam=0.5)
    fitted = L.fit_linear(scale.fit(train).transform(train), FEATURES, "scaled")
    St.unscaled(PipelineModel([scale.fit(train), *fitted.stages])).save(path)
    return L.batch_score(test.drop("target"), path).select("item", rounded("prediction", 4).alias("prediction"))
