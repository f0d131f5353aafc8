import pytest
from pyspark.ml.functions import vector_to_array

from hemline.operators import profile as P


def test_nulls_and_nans_are_missing(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (None, "b")], "x double, s string")
    got = {r.column: (r.nulls, r.non_nulls) for r in P.null_profile(df).collect()}
    assert got == {"x": (2, 1), "s": (1, 2)}
    assert P.null_total(df).first()[0] == 3
    assert {(r.column, r.type, r.non_nulls, r.rows) for r in P.table_profile(df).collect()} == {
        ("x", "double", 1, 3), ("s", "string", 2, 3)
    }


def test_distinct_count_counts_null_as_a_value(spark):
    df = spark.createDataFrame([("g", "a"), ("g", None), ("g", None), ("h", "a")], "g string, v string")
    assert {r.g: r["values"] for r in P.distinct_count(df, "v", "g").collect()} == {"g": 2, "h": 1}
    assert P.distinct_count(df, "v", approx=True).first()[0] == 2


def test_histogram_edges_and_constant(spark):
    df = spark.createDataFrame([(float(i), 3) for i in range(11)] + [(None, None), (float("nan"), None)], "x double, c int")
    got = {(r.column, r.bin): r.rows for r in P.histogram(df, ["x", "c"]).collect()}
    assert got[("x", 9)] == 2 and got[("x", 0)] == 1 and got[("c", 0)] == 11
    assert sum(n for (c, _), n in got.items() if c == "x") == 11


def test_one_hot(spark):
    df = spark.createDataFrame([(1, "R"), (2, None), (3, "B")], "i int, c string")
    got = {r.i: (r.Color_B, r.Color_R) for r in P.one_hot(df, "c", "Color").collect()}
    assert got == {1: (0, 1), 2: (0, 0), 3: (1, 0)}
    with pytest.raises(ValueError):
        P.one_hot(df, "c", "Color", limit=1)
    sparse = P.one_hot_sparse(df, "c", "v").select("i", vector_to_array("v").alias("v"))
    assert {r.i: list(r.v) for r in sparse.collect()} == {1: [0.0, 1.0], 2: [0.0, 0.0], 3: [1.0, 0.0]}


def test_one_hot_sum_without_values(spark):
    df = spark.createDataFrame([("a", "R"), ("a", "R"), ("a", "B"), ("b", None)], "k string, c string")
    got = {r.k: (r.C_B, r.C_R) for r in P.one_hot_sum(df, "k", "c", "C").collect()}
    assert got == {"a": (1, 2), "b": (0, 0)}


def test_concat_text(spark):
    rows = [("a", 3, "z"), ("a", 1, "x"), ("a", 2, None), ("a", 4, "x"), ("b", 1, None)]
    df = spark.createDataFrame(rows, "k string, o int, t string").repartition(4)
    assert {r.k: r.t for r in P.concat_text(df, "k", "t", "o").collect()} == {"a": "xzx", "b": ""}
    joined = P.concat_text(df, "k", "t", "o", separator="|", dedupe=True)
    assert {r.k: r.t for r in joined.collect()} == {"a": "x|z", "b": ""}
