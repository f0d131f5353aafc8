import numpy as np
import pytest
from pyspark.sql import functions as F

from hemline.operators import neighbors as N


def _brute(q_ids, q, t_ids, t, k, same=None):
    out = {}
    for i, v in zip(q_ids, q):
        d = np.sqrt(np.square(t - v).sum(axis=1))
        rows = sorted((d[j], t_ids[j]) for j in range(len(t)) if t_ids[j] != i and not (same and same(i, t_ids[j])))
        out[i] = [x[1] for x in rows[:k]]
    return out


def _frame(spark, ids, vectors):
    rows = [(i, [float(x) for x in v]) for i, v in zip(ids, vectors)]
    kind = "string" if isinstance(ids[0], str) else "long"
    return spark.createDataFrame(rows, f"id {kind}, vec array<double>").repartition(4)


def _ids(found):
    return {r.qid: [n.id for n in r.neighbors] for r in found.collect()}


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    v = rng.normal(size=(300, 6))
    # A third of all rows are copies of one vector, and a lattice adds more ties.
    v[:100] = v[0]
    v[100:160] = rng.integers(0, 2, size=(60, 6))
    return np.arange(300), v


@pytest.mark.parametrize("block_rows", [20, 1000])
def test_any_block_size_gives_the_exact_result(spark, data, block_rows):
    ids, v = data
    df = _frame(spark, ids.tolist(), v)
    train = df.filter("id % 3 != 0")
    keep = ids % 3 != 0
    want = _brute(ids, v, ids[keep], v[keep], 3)
    assert _ids(N.nearest(df, train, 3, block_rows=block_rows)) == want


@pytest.mark.parametrize("pivots,block_rows", [(1, 1000), (12, 30)])
def test_pruning_keeps_the_exact_result(spark, data, pivots, block_rows):
    ids, v = data
    df = _frame(spark, ids.tolist(), v)
    train = df.filter("id % 3 != 0")
    keep = ids % 3 != 0
    want = _brute(ids, v, ids[keep], v[keep], 4)
    assert _ids(N.nearest_pruned(df, train, 4, pivots=pivots, block_rows=block_rows)) == want


def test_pruning_compares_less_on_clustered_rows(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(20, 4))[rng.integers(0, 20, 600)] * 50 + rng.normal(size=(600, 4))
    df = _frame(spark, list(range(600)), v)
    assert N.compared_share(df, df, 3, pivots=20, block_rows=50).first()[0] < 0.4


def test_fewer_train_rows_than_k_and_string_ids(spark):
    df = _frame(spark, ["b", "a", "c"], [[0.0], [0.0], [5.0]])
    train = df.filter("id != 'c'")
    assert _ids(N.nearest(df, train, 3)) == {"a": ["b"], "b": ["a"], "c": ["a", "b"]}
    assert _ids(N.nearest_pruned(df, train, 3, pivots=2)) == {"a": ["b"], "b": ["a"], "c": ["a", "b"]}


def test_a_query_without_candidates_stays(spark):
    df = _frame(spark, [1, 2, 3], [[0.0], [1.0], [2.0]])
    only = df.filter("id = 1")
    assert _ids(N.nearest(df, only, 2)) == {1: [], 2: [1], 3: [1]}
    assert _ids(N.nearest(df, only.filter("id = 9"), 2)) == {1: [], 2: [], 3: []}
    assert _ids(N.nearest_pruned(df, only, 2)) == {1: [], 2: [1], 3: [1]}
    targets = only.withColumn("y", F.lit(7.0))
    assert {r.qid: r.prediction for r in N.knn_regress(targets, df, "y", 2).collect()} == {1: None, 2: 7.0, 3: 7.0}


def test_cosine_orders(spark):
    df = _frame(spark, [1, 2, 3], [[1.0, 0.0], [5.0, 0.1], [-1.0, 0.0]])
    assert _ids(N.nearest(df, df, 1, "cosine"))[1] == [2]
    assert _ids(N.nearest(df, df, 1, "cosine_similarity_asc"))[1] == [3]
    with pytest.raises(ValueError):
        N.nearest(df, df, 1, "manhattan")


def test_pair_distance_of_a_row_to_itself(spark):
    df = _frame(spark, [1, 2], [[0.0, 3.0], [4.0, 0.0]])
    pairs = spark.createDataFrame([(1, 1), (1, 2)], "qid long, tid long")
    assert {r.tid: r.d for r in N.pair_distance(pairs, df, df).collect()} == {1: float("inf"), 2: 5.0}


def test_targets_keep_distance_order(spark):
    df = _frame(spark, [1, 2, 3, 4], [[0.0], [3.0], [1.0], [2.0]]).withColumn("y", F.col("id") * 10)
    listed = N.neighbor_targets(N.nearest(df, df, 3), df, "y")
    assert {r.qid: r.neighbor_targets for r in listed.collect()}[1] == [30.0, 40.0, 20.0]
    rows = N.neighbor_residual(listed.withColumn("y", F.col("qid") * 10), "y")
    row = rows.filter("qid = 1").first()
    assert (row.neighbor_mean, row.residual) == (30.0, -20.0)


def test_grid_equals_a_direct_search(spark):
    rng = np.random.default_rng(4)
    n, folds = 53, 10
    v, y = rng.normal(size=(n, 3)), rng.normal(size=n)
    df = _frame(spark, list(range(n)), v)
    targets = spark.createDataFrame([(i, float(x)) for i, x in enumerate(y)], "id long, y double")
    scores = N.knn_grid(df.join(targets, "id"), "y", "id", ks=[1, 4, 7], folds=folds)
    fold = np.concatenate([np.full(n // folds + (f < n % folds), f) for f in range(folds)])
    want = {}
    for k in (1, 4, 7):
        per_fold = []
        for f in range(folds):
            train = np.nonzero(fold != f)[0]
            errors = []
            for i in np.nonzero(fold == f)[0]:
                near = train[np.argsort(np.square(v[train] - v[i]).sum(axis=1))[:k]]
                errors.append((y[near].mean() - y[i]) ** 2)
            per_fold.append(np.mean(errors))
        want[k] = -np.mean(per_fold)
    got = {r.k: r.score for r in scores.collect()}
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert N.best_k(scores).first().k == max(want, key=want.get)


def test_candidates_are_ranked_before_they_are_gathered(spark, data, capsys):
    df = _frame(spark, data[0].tolist(), data[1])
    N.nearest(df, df, 3, block_rows=10).explain()
    plan = capsys.readouterr().out
    assert "WindowGroupLimit" in plan.split("FlatMapCoGroupsInArrow")[0]


@pytest.mark.parametrize("metric", N.METRICS)
def test_a_block_in_chunks_gives_the_rows_of_a_block_at_once(data, monkeypatch, metric):
    ids, v = data
    v = v + 0.5
    monkeypatch.setattr(N, "_TRAIN_CHUNK", 7)
    monkeypatch.setattr(N, "_QUERY_CHUNK", 16)
    fold, rank = ids % 4, np.arange(len(ids))
    excluded = (ids[:, None] == ids[None, :]) | (fold[:, None] == fold[None, :])
    for groups, out in (((fold, fold), excluded), ((None, None), ids[:, None] == ids[None, :])):
        want = N._block_top_k(v, v, out, rank, 5, metric)
        got = N._cell_top_k(v, v, ids, ids, *groups, rank, 5, metric)
        assert all(np.array_equal(a, b) for a, b in zip(got, want))


def test_pruned_rows_travel_once_to_a_group_of_blocks(spark, data, monkeypatch):
    ids, v = data
    df = _frame(spark, ids.tolist(), v)
    shipped, search = [], N._search

    def counted(q_cells, t_cells, *args, **kwargs):
        shipped.append(q_cells.count())
        return search(q_cells, t_cells, *args, **kwargs)

    monkeypatch.setattr(N, "_search", counted)
    assert _ids(N.nearest_pruned(df, df, 4, pivots=1, block_rows=30)) == _brute(ids, v, ids, v, 4)
    assert shipped == [300, 300]


def test_no_vector_is_shuffled(spark, data, capsys):
    df = _frame(spark, data[0].tolist(), data[1])
    for found in (N.nearest(df, df, 3, block_rows=10), N.nearest_pruned(df, df, 3, pivots=8, block_rows=30)):
        found.explain()
        plan = capsys.readouterr().out
        assert "CoGroup" not in plan
        dealt = [line for line in plan.splitlines() if "Exchange hash" in line]
        assert dealt and all("hashpartitioning(qid" in line for line in dealt)


@pytest.mark.parametrize("run", [12, 1 << 23])
def test_crowds_of_copies_shrink_in_their_task(spark, monkeypatch, run):
    monkeypatch.setattr(N, "RUN_NUMBERS", run)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(batch)
    rng = np.random.default_rng(8)
    ids, v = np.arange(200), rng.normal(size=(200, 3)).astype(np.float32).astype(np.float64)
    v[40:160] = v[5]
    fold = ids % 3
    rows = [(int(i), [float(x) for x in r], int(f)) for i, r, f in zip(ids, v, fold)]
    for kind in ("float", "double"):
        df = spark.createDataFrame(rows, f"id long, vec array<{kind}>, fold int").repartition(3)
        assert _ids(N.nearest(df, df, 4)) == _brute(ids, v, ids, v, 4)
        same = N.nearest(df, df, 4, exclude_same="fold")
        assert _ids(same) == _brute(ids, v, ids, v, 4, lambda a, b: fold[a] == fold[b])
    spark.conf.set(batch, 20)
    held = N.Blocks.of(df.coalesce(1).select("id", F.lit(None).cast("long").alias("grp"), "vec"), 50, copies=4)
    spark.conf.set(batch, usual)
    assert held.count() == 84 if run > 12 else 84 < held.count() < 200


def test_a_search_leaves_only_its_result(spark, tmp_path):
    from hemline import session
    from hemline.plans import neighbor_queries as Q
    from hemline.plans.registry import Tables

    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r], i % 4) for i, r in enumerate(rng.normal(size=(240, 16)))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    written = session._WRITTEN.setdefault(spark.sparkContext.applicationId, [])
    before = len(written)
    found = Q.g4_clusters(Tables(spark, str(tmp_path))).first()
    assert (found.copies, found.differing) == (4, 0)
    # the plain search's rows, the pruned one's and the share
    kept = [path for path in written[before:] if "vec" not in spark.read.parquet(path).columns]
    assert len(kept) == 3 and len(written) - before <= 4
