"""Operators on values that the tables lack: nulls, descending keys, and the scope of scratch tables."""

import os
import subprocess
import sys

import numpy as np
from pyspark.sql import functions as F

from hemline.functions import text as X
from hemline.functions import vectors as V
from hemline.operators import evaluation as E
from hemline.operators import ordering as O
from hemline.operators import profile as P
from hemline.session import materialize, scratch, scratch_path


def test_null_vectors_stay_null_or_add_nothing(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, None), (2, None), (None, [3.0, 4.0])], "k int, v array<double>")
    assert {r["k"]: r["vector"] for r in V.sum_vectors(df, "k", "v").collect()} == {1: [1.0, 2.0], 2: None, None: [3.0, 4.0]}
    projected = df.select("k", V.linear_project("v", np.array([[1.0, 1.0]])).alias("p")).collect()
    assert sorted([(r["k"] or 0, r["p"]) for r in projected], key=str) == sorted([(1, [3.0]), (1, None), (2, None), (0, [7.0])], key=str)


def test_null_text_has_a_zero_vector(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "c")], "k int, text string")
    found = {r["k"]: r["text_vector"] for r in X.embed_corpus(df, "k", "text", 8).collect()}
    assert set(found) == {1, 2, 3} and not any(found[2])


def test_nan_guard_counts_nulls(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),)], "pred double")
    kept, report = E.nan_guard(df, ["pred"], nulls=True)
    assert kept.count() == 1 and tuple(report.first()) == (2, 3)


def test_overall_row_is_told_from_a_null_season(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", "s", 2)], "item string, season string, qty int")
    rows = P.item_totals_by_season(df, "item", "qty", overall="all")
    assert sorted((r["total"], r["all"]) for r in rows.collect()) == [(1, False), (2, False), (3, True)]


def test_tail_of_a_descending_key(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "i int")
    assert [r["i"] for r in O.tail(df, F.desc("i"), 3).collect()] == [2, 1, 0]


def test_scratch_scope_leaves_no_file(spark):
    outside = materialize(spark.range(3))
    with scratch(spark):
        path = os.path.dirname(scratch_path(spark))
        before = set(os.listdir(path))
        assert materialize(spark.range(5)).count() == 5
        assert len(set(os.listdir(path)) - before) == 1
    assert set(os.listdir(path)) == before
    assert outside.count() == 3


def test_weights_of_a_table(spark):
    table = spark.createDataFrame([(0, 1, 2.0), (1, 0, 3.0)], "out int, `in` int, w double")
    assert V.read_weights(table, 2, 2).tolist() == [[0.0, 2.0], [3.0, 0.0]]


def test_package_reaches_workers_from_another_folder(tmp_path):
    """With the package on the path of the driver and the workers, as an installed or shipped package is."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        "from hemline.session import local_session; from hemline.functions import vectors as V\n"
        "s = local_session(2)\n"
        "print(s.createDataFrame([([1.0],)], 'v array<double>').select(V.activate('v')).first()[0])\n"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": root}, capture_output=True, text=True, timeout=120)
    assert "0.841" in done.stdout
