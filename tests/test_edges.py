"""Null, NaN, short and long cases that the tables lack."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hemline.operators import catalog as C
from hemline.operators import models as L
from hemline.operators import neighbors as N
from hemline.operators import scaling as Z
from hemline.session import scratch_path
from hemline.sources import files as S

VECTORS = "id long, vec array<double>, tag double"


@pytest.mark.parametrize("search", [N.nearest, N.nearest_pruned])
def test_a_bad_vector_changes_only_itself(spark, search):
    good = [(i, [float(i), 1.0], 0.2 if i % 2 else 0.7) for i in range(1, 7)]
    bad = [(90, None, 0.1), (91, [float("nan"), 1.0], 0.1), (92, [1.0], 0.1), (93, [None, 1.0], 0.1), (94, [float("inf"), 0.0], 0.1)]
    clean = {r.qid: r.neighbors for r in search(*[spark.createDataFrame(good, VECTORS)] * 2, k=2).collect()}
    mixed = {r.qid: r.neighbors for r in search(*[spark.createDataFrame(good + bad, VECTORS)] * 2, k=2).collect()}
    assert {k: mixed[k] for k in clean} == clean and all(len(v) == 2 for v in clean.values())
    assert {k for k in mixed if mixed[k] == []} == {r[0] for r in bad}


def test_no_direction_no_cosine(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0.0), (2, [1.0, 1.0], 0.0), (3, [0.0, 0.0], 0.0)], VECTORS)
    got = {r.qid: [n.id for n in r.neighbors] for r in N.nearest(df, df, k=2, metric="cosine").collect()}
    assert got == {1: [2], 2: [1], 3: []}


@pytest.mark.parametrize("kind", ["double", "string"])
def test_exclusion_compares_the_value(spark, kind):
    df = spark.createDataFrame([(i, [float(i)], 0.2 if i % 2 else 0.7) for i in range(6)], VECTORS)
    df = df.withColumn("tag", F.col("tag").cast(kind))
    got = {r.qid: [n.id for n in r.neighbors] for r in N.nearest(df, df, k=1, exclude_same="tag").collect()}
    assert all(len(v) == 1 and (q - v[0]) % 2 == 1 for q, v in got.items())


def test_lambda_beyond_fifty(spark):
    y = 1000 - np.random.default_rng(0).exponential(3, 60)
    df = spark.createDataFrame([(float(v),) for v in y] + [(float("nan"),), (None,)], "y double")
    lam = Z.fit_boxcox(df, "y", digits=1)
    logs = np.log(y / np.exp(np.log(y).mean()))

    def likelihood(p):
        return -len(y) / 2 * math.log(np.var(np.expm1(p * logs) / p))

    assert lam > 50
    assert likelihood(lam) >= max(likelihood(p) for p in np.arange(1, 2000, 0.5)) - 1e-3


def test_mapping_with_nulls(spark):
    path = scratch_path(spark)
    S.write_mapping(spark.createDataFrame([("a", None), ("b", "x: y")], "key string, value string"), path)
    assert {tuple(r) for r in S.read_mapping(spark, path).collect()} == {("a", None), ("b", "x: y")}
    with pytest.raises(Exception, match="colon"):
        S.write_mapping(spark.createDataFrame([("k:x", "v")], "key string, value string"), scratch_path(spark))


def test_params_with_lists(spark):
    path = scratch_path(spark)
    S.save_params(spark, {"layers": [8, 4], "rate": np.float64(0.5), "none": None}, path)
    assert S.load_params(spark, path) == {"layers": [8, 4], "rate": 0.5}


def test_long_mapping_keeps_its_types(spark):
    df = spark.createDataFrame([(1,), (None,)], "k int")
    short, long = {i: i * 2 for i in range(10)}, {i: i * 2 for i in range(C.LITERAL_MAP_LIMIT + 50)}
    a, b = (C.map_values(df, "k", m) for m in (short, long))
    assert a.dtypes == b.dtypes and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_folders_follow_the_name(spark):
    files = spark.createDataFrame([(1, "red one"), (1, "blue two"), (None, "red"), (2, None), (3, "green")], "i int, name string")
    colors = spark.createDataFrame([("red", 1), ("blue", 2), (None, 0)], "color string, priority int")
    got = sorted(map(str, C.assign_color_folder(files, colors).select("name", "folder").collect()))
    want = [("red one", "red"), ("blue two", "blue"), ("red", "red"), (None, None), ("green", None)]
    assert got == sorted(map(str, spark.createDataFrame(want, "name string, folder string").collect()))


def test_black_keeps_files_without_folder(spark):
    files = spark.createDataFrame([(None, "x"), ("d", "BLACK a"), ("e", "b")], "dir string, name string")
    got = {r["name"]: r["folder"] for r in C.assign_black(files, "folder").collect()}
    assert got == {"x": "BLACK", "BLACK a": None, "b": "BLACK"}


def test_leaderboard_scores_the_same_rows(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (30.0,)], "y double")
    fitters = {
        "whole": lambda _: lambda t: t.withColumn("prediction", F.col("y") + 1),
        "gaps": lambda _: lambda t: t.withColumn("prediction", F.when(F.col("y") < 30, F.col("y"))),
        "nan": lambda _: lambda t: t.withColumn("prediction", F.when(F.col("y") > 1, F.col("y")).otherwise(float("nan"))),
    }
    got = {r.model: (r.rmse, r.rows, r.skipped) for r in L.leaderboard(fitters, df, df, "y").collect()}
    assert got == {"whole": (1.0, 1, 0), "gaps": (0.0, 1, 1), "nan": (0.0, 1, 1)}
