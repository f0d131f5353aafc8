from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from hemline.operators import sales as S


def test_season_bounds_are_half_open(spark):
    days = ["2018-02-28", "2018-03-01", "2018-08-31 23:59:59", "2018-09-01", "2019-05-05"]
    df = spark.createDataFrame([(d,) for d in days], "d string").withColumn("d", F.col("d").cast("timestamp"))
    got = [(str(r.d), r.season) for r in S.season_slice(df, "d", S.spring_summer([2018])).orderBy("d").collect()]
    assert got == [("2018-03-01 00:00:00", "2018"), ("2018-08-31 23:59:59", "2018")]


def test_season_filter_reaches_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    sliced = S.season_slice(df, "l_shipdate", S.spring_summer([1996, 1997])).select("l_partkey", "season")
    plan = sliced._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan and "l_quantity" not in plan


def test_old_cohorts(spark):
    rows = [("2018", "QX71"), ("2018", "QXA1"), ("2019", "QXA1"), ("2019", "QXB1"), ("2019", None), ("2030", "QX7")]
    df = spark.createDataFrame(rows, "season string, code string")
    rules = S.growing_patterns(["2018", "2019"], ["QX7", "QXA"])
    assert rules == {"2018": "QX7", "2019": "QX7|QXA"}
    got = {(r.season, r.code) for r in S.exclude_old_cohorts(df, "code", rules).collect()}
    assert got == {("2018", "QXA1"), ("2019", "QXB1"), ("2030", "QX7")}


def test_discount_band_drops_negatives_and_nulls(spark):
    df = spark.createDataFrame([(d,) for d in (-5, 0, 19, 49, 50, 100, None)], "`rate (%)` int")
    band = lambda closed: sorted(r[0] for r in S.discount_band(df, "rate (%)", closed=closed).collect())
    assert band("left") == [0, 19, 49]
    assert band("neither") == [19, 49]
    with pytest.raises(ValueError):
        S.discount_band(df, "rate (%)", closed="right")


def test_casts_truncate_and_raise(spark):
    df = spark.createDataFrame([(-3.7, "2020-01-02"), (3.7, "bad")], "x double, d string")
    assert [r.x for r in S.cast_columns(df, {"x": "int"}).collect()] == [-3, 3]
    assert [r.d for r in S.cast_columns(df, {"d": "date"}, lenient=True).collect()][1] is None
    with pytest.raises(PySparkException):
        S.cast_columns(df, {"d": "date"}).collect()


def test_fill_only_in_scope(spark):
    df = spark.createDataFrame([("2020", None), ("2021", None), ("2020", "x")], "s string, k string")
    got = sorted(((r.s, r.k) for r in S.fill_where_null(df, "k", "n", F.col("s") == "2020").collect()), key=str)
    assert got == sorted([("2020", "n"), ("2021", None), ("2020", "x")], key=str)


def test_align_names_missing_columns(spark):
    train = spark.createDataFrame([(1, 2)], "a int, b int")
    with pytest.raises(ValueError, match="b"):
        S.align_columns(train.drop("b"), train)


def test_target_counts_112_days_from_first_sale(spark):
    rows = [("a", "2020-01-01", 1), ("a", "2020-04-21 23:00:00", 2), ("a", "2020-04-22", 4), ("b", "2020-06-01", 8)]
    df = spark.createDataFrame([(i, datetime.fromisoformat(d), q) for i, d, q in rows], "item string, d timestamp, q int")
    got = {r.item: r.target for r in S.sales_target(df, "item", "d", "q").collect()}
    assert got == {"a": 3, "b": 8}


def test_target_window_holds_days_not_lines(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = S.sales_target(df, "l_partkey", "l_shipdate", "l_quantity")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Window") < plan.rindex("partial_sum(l_quantity")


def test_drop_duplicates_keeps_the_named_first(spark):
    df = spark.createDataFrame([(1, 5, "b"), (1, 2, "a"), (2, 1, "c")], "k int, o int, v string")
    assert {(r.k, r.v) for r in S.drop_duplicates(df, ["k"], ["o"]).collect()} == {(1, "a"), (2, "c")}
    with pytest.raises(ValueError):
        S.drop_duplicates(df, ["k"])
