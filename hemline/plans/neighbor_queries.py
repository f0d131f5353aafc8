"""Nearest neighbours on the embeddings; the target is the label."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemline.operators import hashing as H
from hemline.operators import neighbors as N
from hemline.operators.models import split
from hemline.operators.scaling import fit_linear_scaler
from hemline.plans.registry import Tables, query, rounded
from hemline.session import materialize, materialize_only

SPLIT_SQL = "CAST(('0x' || substr(md5({key} || '|42'), 1, 8)) AS UBIGINT) / 4294967296.0"

VECTORS_SQL = f"""v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec, label,
  {SPLIT_SQL.format(key="vec_id")} >= 0.3 AS in_train FROM embeddings)"""

_DISTANCE = {
    "euclidean": "list_distance(q.vec, t.vec)",
    "cosine": "1 - list_cosine_similarity(q.vec, t.vec)",
    "cosine_similarity_asc": "list_cosine_similarity(q.vec, t.vec)",
}


def near_sql(k: int, metric: str = "euclidean", queries: str = "v") -> str:
    return f"""near AS (SELECT * FROM (
      SELECT q.id AS qid, t.id AS tid, t.label AS y, {_DISTANCE[metric]} AS d,
        row_number() OVER (PARTITION BY q.id ORDER BY {_DISTANCE[metric]}, t.id) AS pos
      FROM {queries} q JOIN v t ON t.in_train AND q.id <> t.id) WHERE pos <= {k})"""


def vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label").cast("double").alias("label")
    )


def sides(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows, the 70 % for training and the 30 % for testing."""
    rows = vectors(t)
    return rows, *split(rows, "id")


def _listed(found: DataFrame) -> DataFrame:
    return found.select("qid", F.posexplode("neighbors").alias("pos", "n")).select(
        "qid", (F.col("pos") + 1).cast("long").alias("pos"), F.col("n.id").alias("tid"), rounded("n.d").alias("d")
    )


def _listed_sql(k: int, metric: str = "euclidean") -> str:
    return f"WITH {VECTORS_SQL}, {near_sql(k, metric)} SELECT qid, pos, tid, round(d, 6) + 0.0 AS d FROM near"


_PAIR = """SELECT a.vec_id AS qid, b.vec_id AS tid, round({d}, 6) AS d
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""
_DOUBLES = "CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])"


@query("g1_pair_distance", _PAIR.format(d=f"list_distance({_DOUBLES})"))
def g1(t):
    rows = vectors(t)
    pairs = rows.select(F.col("id").alias("qid"), (F.col("id") + 1).alias("tid"))
    return N.pair_distance(pairs, rows, rows).withColumn("d", rounded("d"))


@query("g1_pair_distance_cosine", _PAIR.format(d=f"1 - list_cosine_similarity({_DOUBLES})"))
def g1_cosine(t):
    rows = vectors(t)
    pairs = rows.select(F.col("id").alias("qid"), (F.col("id") + 1).alias("tid"))
    return N.pair_distance(pairs, rows, rows, "cosine").withColumn("d", rounded("d"))


@query("g2_nearest", _listed_sql(3))
def g2(t):
    rows, train, _ = sides(t)
    return _listed(N.nearest(rows, train, 3))


@query("g3_nearest_cosine", _listed_sql(3, "cosine"))
def g3(t):
    rows, train, _ = sides(t)
    return _listed(N.nearest(rows, train, 3, "cosine"))


@query("g3_least_similar", _listed_sql(3, "cosine_similarity_asc"))
def g3_literal(t):
    rows, train, _ = sides(t)
    return _listed(N.nearest(rows, train, 3, "cosine_similarity_asc"))


@query("g4_nearest_pruned", _listed_sql(3))
def g4(t):
    rows, train, _ = sides(t)
    return _listed(N.nearest_pruned(rows, train, 3))


@query("g4_compared_share")
def g4_share(t):
    rows, train, _ = sides(t)
    return N.compared_share(rows, train, 3)


def clusters(rows: DataFrame, copies: int, centres: int = 50, spread: float = 0.3) -> DataFrame:
    """``copies`` rows of every vector, turned by as many places, each near one of the first ``centres`` vectors."""
    centre = F.broadcast(rows.where(F.col("id") < centres).select(F.col("id").alias("c"), F.col("vec").alias("around")))
    turned = rows.withColumn("by", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    own = F.concat(F.slice("vec", F.col("by") + 1, F.size("vec")), F.slice("vec", F.lit(1), F.col("by")))
    placed = turned.select((F.col("id") * copies + F.col("by")).alias("id"), (F.col("id") % centres).alias("c"), own.alias("own"))
    return placed.join(centre, "c").select("id", F.zip_with("around", "own", lambda a, b: a + b * F.lit(spread)).alias("vec"))


def _dealt(rows: DataFrame) -> DataFrame:
    """``rows``, dealt to all cores where fewer would read them."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else materialize(rows.repartition(2 * cores))


def lsh_quality(t: Tables, tables: int = 6, probes: int = 16) -> DataFrame:
    """Recall of the hash index and the share of pairs it compares, on clusters at three sizes."""
    base = _dealt(vectors(t))

    def figures(copies: int) -> DataFrame:
        # made of the table wherever they are read, and one search's tables deleted before the next: clusters are many times the table
        rows = clusters(base, copies)
        asked, train = split(rows, "id", 0.9)[1], rows
        exact = materialize_only(t.spark, lambda: N.nearest(asked, train, 3))
        index = H.build_lsh(train, 3, tables)
        found = index.nearest(asked, 3, probes)
        share = index.compared(asked, probes).select((F.col("compared") / F.col("pairs")).alias("share"))
        both = H.recall(found, exact).unionByName(share, allowMissingColumns=True)
        return both.agg(F.lit(copies).alias("copies"), F.max("recall").alias("recall"), F.max("share").alias("share"))

    return reduce(DataFrame.unionByName, [materialize_only(t.spark, partial(figures, copies)) for copies in (1, 4, 16)])


@query("g4_pruned_clusters", "SELECT CAST(4 AS INTEGER) AS copies, true AS pruned, CAST(0 AS BIGINT) AS differing")
def g4_clusters(t):
    """On clusters, most blocks are ruled out and every answer is that of the plain search."""
    rows = clusters(_dealt(vectors(t)), 4)
    # one search's tables are deleted before the next
    exact = materialize_only(t.spark, lambda: _listed(N.nearest(rows, rows, 3)))
    pruned = materialize_only(t.spark, lambda: _listed(N.nearest_pruned(rows, rows, 3)))
    differing = exact.exceptAll(pruned).agg(F.count("*").alias("differing"))
    share = materialize_only(t.spark, lambda: N.compared_share(rows, rows, 3)).select((F.col("share") < 0.5).alias("pruned"))
    both = differing.unionByName(share, allowMissingColumns=True)
    return both.agg(F.lit(4).alias("copies"), F.bool_or("pruned").alias("pruned"), F.max("differing").alias("differing"))


@query("g4_lsh_quality")
def g4_lsh(t):
    return lsh_quality(t)


@query("g4_lsh_holds", "SELECT CAST(unnest([1, 4, 16]) AS INTEGER) AS copies, true AS recalled, true AS pruned")
def g4_lsh_holds(t):
    found = materialize(lsh_quality(t))
    return found.select("copies", (F.col("recall") >= 0.9).alias("recalled"), (F.col("share") < 0.3).alias("pruned"))


@query(
    "g5_neighbor_targets",
    f"""WITH {VECTORS_SQL}, {near_sql(3)} SELECT qid, string_agg(CAST(CAST(y AS INTEGER) AS VARCHAR), ',' ORDER BY pos) AS targets
    FROM near GROUP BY qid""",
)
def g5(t):
    rows, train, _ = sides(t)
    listed = N.neighbor_targets(N.nearest(rows, train, 3), train, "label")
    return listed.select("qid", F.array_join(F.col("neighbor_targets").cast("array<int>"), ",").alias("targets"))


def _residuals(t):
    rows, train, _ = sides(t)
    listed = N.neighbor_targets(N.nearest(rows, train, 3), train, "label")
    joined = listed.join(rows.select(F.col("id").alias("qid"), "label"), "qid")
    # Written once: the scaler's fit and its use share one search.
    return materialize(N.neighbor_residual(joined, "label"))


_RESIDUAL = f"""{VECTORS_SQL}, {near_sql(3)}, r AS (
  SELECT qid, avg(near.y) AS neighbor_mean, any_value(v.label) - avg(near.y) AS residual
  FROM near JOIN v ON v.id = qid GROUP BY qid)"""
_MINMAX = "(residual - min(residual) OVER ()) / (max(residual) OVER () - min(residual) OVER ())"


@query(
    "g6_neighbor_residual",
    f"""WITH {_RESIDUAL} SELECT qid, round(neighbor_mean, 6) AS neighbor_mean, round(residual, 6) + 0.0 AS residual,
    round({_MINMAX}, 6) AS scaled FROM r""",
)
def g6(t):
    rows = _residuals(t)
    scaled = fit_linear_scaler(rows, "residual").scale(rows, "residual")
    return scaled.select(
        "qid", rounded("neighbor_mean").alias("neighbor_mean"), rounded("residual").alias("residual"),
        rounded("scaled").alias("scaled"),
    )


@query(
    "g7_restore_prediction",
    f"WITH {_RESIDUAL} SELECT qid, round(round_even(residual, 2) + neighbor_mean, 6) + 0.0 AS prediction FROM r",
)
def g7(t):
    rows = _residuals(t)
    scaler = fit_linear_scaler(rows, "residual")
    restored = N.restore_prediction(scaler.scale(rows, "residual"), scaler)
    return restored.select("qid", rounded("prediction").alias("prediction"))


@query(
    "g8_knn_regress",
    f"""WITH {VECTORS_SQL}, tests AS (SELECT * FROM v WHERE NOT in_train), {near_sql(10, queries="tests")}
    SELECT qid, round(avg(y), 6) AS prediction FROM near GROUP BY qid""",
)
def g8(t):
    _, train, test = sides(t)
    return N.knn_regress(train, test, "label", 10).withColumn("prediction", rounded("prediction"))


_GRID = """WITH n AS (SELECT count(*) AS n FROM embeddings), p AS (
      SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec, label, row_number() OVER (ORDER BY vec_id) - 1 AS i
      FROM embeddings),
    v AS (SELECT p.*, CASE WHEN i < (n % 10) * (n // 10 + 1) THEN i // (n // 10 + 1)
      ELSE n % 10 + (i - (n % 10) * (n // 10 + 1)) // (n // 10) END AS fold FROM p, n),
    near AS (SELECT * FROM (SELECT q.id AS qid, q.fold, q.label AS y, t.label AS ty,
        row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.vec, t.vec), t.id) AS pos
      FROM v q JOIN v t ON q.fold <> t.fold) WHERE pos <= 30),
    g AS (SELECT k, qid, fold, any_value(y) AS y, avg(ty) AS guess FROM near JOIN range(1, 31) r(k) ON pos <= k
      GROUP BY k, qid, fold)
    SELECT CAST(k AS INTEGER) AS k, round(-avg(mse), 6) AS score FROM (
      SELECT k, fold, avg((guess - y) * (guess - y)) AS mse FROM g GROUP BY k, fold) GROUP BY k"""


@query("g9_knn_grid", _GRID)
def g9(t):
    return N.knn_grid(vectors(t), "label", "id").withColumn("score", rounded("score"))


@query("g9_best_k", f"SELECT * FROM ({_GRID}) ORDER BY score DESC, k LIMIT 1")
def g9_best(t):
    return N.best_k(N.knn_grid(vectors(t), "label", "id")).withColumn("score", rounded("score"))
