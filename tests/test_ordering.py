from pyspark.sql import functions as F

from hemline.operators import ordering as O


def test_index_covers_ties_and_copies(spark):
    # One order value on most rows, and one row copied many times.
    rows = spark.range(3000).select(F.when(F.col("id") < 2500, 7).otherwise(F.col("id") % 50).alias("k"))
    indexed = O.global_index(rows, "k").collect()
    assert sorted(r.row_index for r in indexed) == list(range(3000))
    keys = [r.k for r in sorted(indexed, key=lambda r: r.row_index)]
    assert keys == sorted(keys)


def test_copies_spread_over_partitions(spark):
    rows = spark.range(20000).select(F.lit("same").alias("k"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        placed = O.ordered_table(rows, "k")
        parts = placed.groupBy(O._part()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(parts) > 4 and max(r["count"] for r in parts) < 20000 / 3


def test_forward_fill_does_not_depend_on_partitions(spark):
    rows = [(i, None if i % 7 else i, None if i < 40 or i % 11 else f"s{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "i int, a int, b string").repartition(5)
    want, a, b = {}, None, None
    for i, x, y in rows:
        a, b = (x if x is not None else a), (y if y is not None else b)
        want[i] = (a, b)
    for n in ("1", "3", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = {r.i: (r.a, r.b) for r in O.forward_fill(df, ["a", "b"], "i").collect()}
        assert got == want
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_forward_fill_over_partitions_without_any_value(spark):
    df = spark.createDataFrame([(i, 1 if i == 0 else None) for i in range(1000)], "i int, a int").repartition(4)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert O.forward_fill(df, "a", "i").filter("a = 1").count() == 1000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_running_total(spark):
    df = spark.range(1000).select("id", (F.col("id") % 5).alias("w")).repartition(7)
    got = {r.id: r.running for r in O.running_total(df, "w", "id").collect()}
    total = 0
    for i in range(1000):
        total += i % 5
        assert got[i] == total


def test_head_tail_slice(spark):
    df = spark.range(100).repartition(6)
    assert [r.id for r in O.head(df, "id", 3).collect()] == [0, 1, 2]
    assert [r.id for r in O.tail(df, "id", 3).collect()] == [97, 98, 99]
    assert [r.id for r in O.slice_rows(df, "id", 3, 20).collect()] == [20, 21, 22]


def test_ordered_groups_keeps_order_of_a_hot_key(spark):
    rows = [(("hot" if i % 3 else f"k{i % 5}"), i, f"v{i}" if i % 10 else None) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, o int, v string").repartition(8)
    got = {r.k: [x for p in r.pieces for x in p] for r in O.ordered_groups(df, "k", "o", "v").collect()}
    for key in {r[0] for r in rows}:
        assert got[key] == [v for k, _, v in rows if k == key and v is not None]


def test_tail_of_mixed_directions(spark):
    df = spark.createDataFrame([(i if i % 4 else None, i % 3) for i in range(12)], "i int, j int")
    mixed = [F.desc("j"), F.asc_nulls_last("i")], [F.col("j") + 0, F.desc_nulls_first("i")], [F.asc_nulls_first("j"), F.desc_nulls_last("i")]
    for order in (["j", "i"], *mixed):
        want = df.orderBy(*order).collect()[-5:]
        last = O.tail(df, order, 5)
        assert last.collect() == want and "Exchange rangepartitioning" not in last._jdf.queryExecution().executedPlan().toString()


def test_ordered_groups_with_null_keys_in_one_shuffle_more(spark):
    rows = [(draw, i % 7, f"v{i}" if i % 3 else None) for i in range(50) for draw in (None, "a", "b")]
    df = spark.createDataFrame(rows, "k string, o int, v string").repartition(5)
    found = O.ordered_groups(df, "k", "o", "v")
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {r.k: [x for p in r.pieces for x in p] for r in found.collect()}
    want = {k: [v for _, v in sorted((o, v) for kk, o, v in rows if kk == k and v)] for k in (None, "a", "b")}
    assert got == want
    only = O.ordered_groups(df.where("v IS NULL"), "k", "o", "v").collect()
    assert len(only) == 3 and not any(x for r in only for p in r.pieces for x in p)
