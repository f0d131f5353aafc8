"""Whole flows from lines, vectors and texts to metrics, and facts about operators that SQL states in part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemline.functions import metrics as M
from hemline.functions import text as X
from hemline.functions import vectors as V
from hemline.operators import catalog as C
from hemline.operators import evaluation as E
from hemline.operators import models as L
from hemline.operators import neighbors as N
from hemline.operators import scaling as Z
from hemline.plans.evaluation_queries import FEATURES, model_sides
from hemline.plans.feature_queries import DIM, _long, _long_sql
from hemline.plans.neighbor_queries import _RESIDUAL, SPLIT_SQL, VECTORS_SQL, _residuals, sides
from hemline.plans.registry import Tables, query, rounded
from hemline.plans.sales_queries import TARGET_SQL
from hemline.plans.scaling_queries import LAMBDA_SQL
from hemline.session import materialize

# A line through the scaled training residuals, undone on the test side.
_NEIGHBOR_FLOW = f"""{_RESIDUAL}, s AS (
    SELECT r.*, v.label AS y, {SPLIT_SQL.format(key="qid")} < 0.3 AS in_test FROM r JOIN v ON v.id = qid),
  m AS (SELECT min(residual) AS lo, max(residual) AS hi FROM s WHERE NOT in_test),
  f AS (SELECT regr_slope((residual - lo) / (hi - lo), neighbor_mean) AS w,
      regr_intercept((residual - lo) / (hi - lo), neighbor_mean) AS c FROM s, m WHERE NOT in_test),
  p AS (SELECT qid, y, round_even((w * neighbor_mean + c) * (hi - lo) + lo, 2) + neighbor_mean AS pred
    FROM s, f, m WHERE in_test)"""


def neighbor_flow(t: Tables) -> DataFrame:
    """Test rows qid, true, pred: neighbours, residual, its scaler and model on the training side, restored."""
    train, test = L.split(_residuals(t), "qid")
    scaler = Z.fit_linear_scaler(train, "residual")
    model = L.fit_linear(scaler.scale(train, "residual"), ["neighbor_mean"], "scaled")
    restored = N.restore_prediction(model.transform(test), scaler, scaled="prediction", name="pred")
    return restored.select("qid", F.col("label").alias("true"), "pred")


@query("g7_predicted_residual", f"WITH {_NEIGHBOR_FLOW} SELECT qid, round(pred, 6) + 0.0 AS pred FROM p")
def g7_predicted(t):
    return neighbor_flow(t).select("qid", rounded("pred").alias("pred"))


@query(
    "flow_neighbors",
    f"""WITH {_NEIGHBOR_FLOW} SELECT CAST(y AS INTEGER) AS category, round(avg(abs(pred - y) / (abs(pred) + abs(y) + 1e-6)), 6) AS smape,
    round(sqrt(avg(pow(pred - y, 2))), 6) AS rmse FROM p GROUP BY y""",
)
def flow_neighbors(t):
    rows = neighbor_flow(t).withColumn("category", F.col("true").cast("int"))
    items = C.attach_category(E.item_level(rows.withColumnRenamed("qid", "item"), "item"), rows.select(F.col("qid").alias("item"), "category"), ["item"])
    scored = E.metric_by_category(items, "category", ["smape", "rmse"])
    return scored.select("category", rounded("smape").alias("smape"), rounded("rmse").alias("rmse"))


# Lambda, anchors and weights come from the training side; ``target`` names that side for the shared fit.
_TRAINING_FLOW = f"""{TARGET_SQL.replace("), target AS (", "), everything AS (")},
  target AS (SELECT * FROM everything WHERE {SPLIT_SQL.format(key="item")} >= 0.3), {LAMBDA_SQL},
  q AS (SELECT quantile_cont(target, 0.16) AS lo, quantile_cont(target, 0.84) AS hi FROM target),
  anchor AS (SELECT lam, 2 / (pow(lo, lam) - pow(hi, lam)) AS a,
    2 / (pow(lo, lam) - pow(hi, lam)) * pow(lo, lam) - 1 AS b FROM q, b4),
  x AS (SELECT item, p_type AS category, target AS truth, CAST(p_size AS DOUBLE) AS x1, p_retailprice AS x2,
      a * pow(target, lam) - b AS y, {SPLIT_SQL.format(key="item")} < 0.3 AS in_test
    FROM everything JOIN part ON item = p_partkey, anchor),
  m AS (SELECT avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my FROM x WHERE NOT in_test),
  s AS (SELECT sum((x1 - m1) * (x1 - m1)) AS s11, sum((x2 - m2) * (x2 - m2)) AS s22,
      sum((x1 - m1) * (x2 - m2)) AS s12, sum((x1 - m1) * (y - my)) AS s1y, sum((x2 - m2) * (y - my)) AS s2y
    FROM x, m WHERE NOT in_test),
  w AS (SELECT (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS w1,
      (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS w2 FROM s),
  p AS (SELECT item, category, truth,
      round_even(pow((my + w1 * (x1 - m1) + w2 * (x2 - m2) + b) / a, 1 / lam), 2) AS pred
    FROM x, m, w, anchor WHERE in_test)"""


def training_flow(t: Tables) -> DataFrame:
    """Test rows item, true, pred of a model on the target scaled by the training side's own fit."""
    train, test = model_sides(t)
    scaler = Z.fit_anchor(train, "target")
    model = L.fit_linear(scaler.scale(train, "target"), FEATURES, "scaled")
    return E.predictions(model.transform(test), scaler, keep=["item"])


@query("h14_predictions_of_model", f"WITH {_TRAINING_FLOW} SELECT item, truth AS \"true\", pred FROM p")
def h14_model(t):
    return training_flow(t)


@query(
    "flow_training",
    f"""WITH {_TRAINING_FLOW} SELECT category, round(avg(abs(pred - truth) / (abs(pred) + abs(truth) + 1e-6)), 6) AS smape,
    round(sqrt(avg(pow(pred - truth, 2))), 6) AS rmse, count(*) AS items FROM p GROUP BY category""",
)
def flow_training(t):
    kinds = t.part.select(F.col("p_partkey").alias("item"), F.col("p_type").alias("category"))
    items = C.attach_category(E.item_level(training_flow(t), "item"), kinds, ["item"])
    scored = items.groupBy("category").agg(M.adjusted_smape("pred", "true").alias("smape"), M.rmse("pred", "true").alias("rmse"), F.count("*").alias("items"))
    return scored.withColumns({"smape": rounded("smape"), "rmse": rounded("rmse")})


@query(
    "flow_text_model",
    f"""SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), '[\\p{{L}}\\p{{N}}]') THEN 1.0 ELSE 0.0 END::DOUBLE AS norm,
    true AS answered FROM documents WHERE {SPLIT_SQL.format(key="doc_id")} < 0.3""",
)
def flow_text(t):
    """Text vectors fitted on the training side become the columns of a model of the text's length."""
    docs = t.documents.select("doc_id", "text", F.length(F.coalesce("text", F.lit(""))).cast("double").alias("size"))
    train, test = L.split(docs, "doc_id")
    vectors = X.fit_text_embedding(train, "text", 32)

    def wide(side: DataFrame) -> DataFrame:
        return V.vector_to_columns(X.embed_text(side, vectors).drop("text"), "text_vector", "text", 32)

    # written once for the passes of the fit
    model = L.fit_linear(materialize(wide(train)), [f"text_{i}" for i in range(32)], "size", "ridge")
    scored = model.transform(wide(test))
    answered = F.col("prediction").isNotNull() & ~F.isnan("prediction")
    norm = F.sqrt(V.dot("text_vector", "text_vector"))
    return scored.select("doc_id", rounded(norm).alias("norm"), answered.alias("answered"))


@query(
    "e9_text_norms",
    r"""SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), '[\p{L}\p{N}]') THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM documents""",
)
def e9_norms(t):
    embedded = X.embed_corpus(t.documents, "doc_id", "text", 256)
    return embedded.select("doc_id", rounded(F.sqrt(V.dot("text_vector", "text_vector"))).alias("norm"))


@query(
    "e8_read_weights",
    """WITH e AS (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS value, generate_subscripts(embedding, 1) AS pos FROM embeddings),
    m AS (SELECT label, pos, avg(value) AS value FROM e GROUP BY label, pos),
    w AS (SELECT label, list(value ORDER BY pos) AS row FROM m GROUP BY label)
    SELECT vec_id, CAST(w.label AS INTEGER) AS pos,
    round(list_dot_product(CAST(embedding AS DOUBLE[]), row), 6) + 0.0 AS value FROM embeddings, w""",
)
def e8_weights(t):
    """The mean vector of every label is a row of the weight matrix, kept as a table."""
    elements = t.embeddings.select(F.col("label").alias("out"), F.posexplode("embedding").alias("in", "x"))
    weights = elements.groupBy("out", "in").agg(F.avg(F.col("x").cast("double")).alias("w"))
    labels = t.embeddings.agg(F.max("label")).first()[0] + 1
    return _long(t.embeddings, "vec_id", V.linear_project("embedding", V.read_weights(weights, labels, DIM)))


@query("e5_flatten_vectors", _long_sql("embeddings", "vec_id", f"list_concat(embedding[33:{DIM}], embedding[1:32])"))
def e5_flatten(t):
    halves = F.array(F.slice("embedding", 33, DIM - 32), F.slice("embedding", 1, 32))
    return _long(t.embeddings, "vec_id", V.flatten_vectors(halves))


_TREE_FACTS = f"""WITH {TARGET_SQL}, x AS (SELECT {SPLIT_SQL.format(key="item")} < 0.3 AS in_test FROM target JOIN part ON item = p_partkey),
  n AS (SELECT count(*) FILTER (in_test) AS rows FROM x)
  SELECT model, rows, rows AS within, true AS beats_mean FROM n, (VALUES {{}}) k(model)"""


def tree_facts(name: str, model, train: DataFrame, test: DataFrame, slack: float) -> DataFrame:
    """Answered test rows, those within the training targets (widened by ``slack`` of their range), and whether
    the error on the training side is below that of its mean."""
    low, high, spread = train.agg(F.min("target"), F.max("target"), F.stddev_pop("target")).first()
    wide = slack * (high - low) + 1e-9
    within = F.count_if(F.col("prediction").between(low - wide, high + wide))
    error = model.transform(train).agg(M.rmse("prediction", "target")).first()[0]
    facts = model.transform(test).agg(F.count("prediction").alias("rows"), within.alias("within"))
    return facts.select(F.lit(name).alias("model"), "rows", "within", F.lit(error < spread).alias("beats_mean"))


@query("h3_tree_facts", _TREE_FACTS.format("('forest'), ('bagging')"))
def h3_facts(t):
    train, test = model_sides(t)
    forest = tree_facts("forest", L.fit_forest(train, FEATURES, "target"), train, test, 0.0)
    return forest.unionByName(tree_facts("bagging", L.fit_bagging(train, FEATURES, "target"), train, test, 0.0))


@query("h4_gbt_facts", _TREE_FACTS.format("('boosting')"))
def h4_facts(t):
    train, test = model_sides(t)
    return tree_facts("boosting", L.fit_gbt(train, FEATURES, "target"), train, test, 1.0)


@query(
    "g4_compared_pairs",
    f"WITH {VECTORS_SQL} SELECT count(*) AS queries, count(*) FILTER (in_train) AS train, true AS possible FROM v",
)
def g4_pairs(t):
    rows, train, _ = sides(t)
    share = N.compared_share(rows, train, 3).first()["share"]
    sizes = rows.agg(F.count("*").alias("queries"), F.count_if(L.split_score("id") >= F.lit(0.3)).alias("train"))
    # each query meets k training rows at least, and no pair twice
    least = F.lit(3.0) / F.col("train")
    return sizes.withColumn("possible", F.lit(share).between(least, F.lit(1.0)))
