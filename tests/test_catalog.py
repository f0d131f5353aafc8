import pytest
from pyspark.sql import functions as F

from hemline.operators import catalog as C


def test_map_values_literal_and_table_agree(spark):
    df = spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    small = {"a": "A", "b": "B"}
    large = small | {f"k{i}": f"v{i}" for i in range(C.LITERAL_MAP_LIMIT + 1)}
    for keep in (False, True):
        for mapping in (small, large):
            got = [r.c for r in C.map_values(df, "c", mapping, keep_unmapped=keep).collect()]
            assert sorted(got, key=str) == sorted(["A", "z" if keep else None, None], key=str)


def test_paths(spark):
    df = spark.createDataFrame([("a ", "x"), ("b", None)], "i string, c string")
    built = C.build_path(df, [F.lit("root"), F.col("i"), F.col("c")])
    assert [r.path for r in C.trim_path_segments(built, "path").collect()] == ["root/a/x", None]
    assert [r.key for r in C.composite_key(df, ["i", "c"]).collect()] == ["a _x", None]


def test_pairs_stop_at_the_shorter(spark):
    a = spark.createDataFrame([("c",), ("a",), ("b",)], "n string")
    b = spark.createDataFrame([("y",), ("x",)], "n string")
    assert {tuple(r) for r in C.pair_sorted(a, b).collect()} == {("a", "x"), ("b", "y")}


def test_inverted_mapping_last_wins(spark):
    df = spark.createDataFrame([("k1", "v", 1), ("k2", "v", 2)], "key string, value string, at int")
    assert [tuple(r) for r in C.invert_mapping(df, "at").collect()] == [("v", "k2")]


def test_files(spark):
    rows = spark.createDataFrame([(1, "d1"), (2, "none"), (3, None)], "i int, path string")
    files = spark.createDataFrame([("d1", "d1/b"), ("d1", "d1/a")], "dir string, path string")
    got = C.attach_files(rows.withColumnRenamed("path", "at"), files, "at")
    assert {r.i: r.files for r in got.collect()} == {1: ["d1/a", "d1/b"], 2: [], 3: []}
    assert {(r.i, r.position) for r in C.missing_files(got, "i").collect()} == {(2, 1), (3, 2)}


@pytest.mark.parametrize("limit", [200, 2])
def test_color_folder_takes_the_first_listed_color(spark, monkeypatch, limit):
    monkeypatch.setattr(C, "LITERAL_MAP_LIMIT", limit)
    files = spark.createDataFrame([(1, "BLACKRED_1.jpg"), (2, "RED.jpg"), (3, "x.jpg"), (4, "BL")], "i int, name string")
    colors = spark.createDataFrame([("BLACK", 0), ("BLACKRED", 1), ("RED", 2)], "color string, priority int")
    got = {r.i: r.folder for r in C.assign_color_folder(files, colors).collect()}
    assert got == {1: "BLACK", 2: "RED", 3: None, 4: None}


def test_black_modes(spark):
    files = spark.createDataFrame([("d", "black1"), ("d", "x"), ("e", "BLACK2"), ("e", "y")], "dir string, name string")
    contains = {(r.dir, r.name): r.folder for r in C.assign_black(files).collect()}
    assert contains == {("d", "black1"): "BLACK", ("d", "x"): None, ("e", "BLACK2"): "BLACK", ("e", "y"): None}
    folder = {(r.dir, r.name): r.folder for r in C.assign_black(files, "folder").collect()}
    assert folder == {("d", "black1"): "BLACK", ("d", "x"): "BLACK", ("e", "BLACK2"): None, ("e", "y"): None}


def test_join_columns_needs_unique_keys(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    b = spark.createDataFrame([(2, "c"), (3, "d")], "k int, y string")
    assert {tuple(r) for r in C.join_columns(a, b, "k").collect()} == {(1, "a", None), (2, "b", "c"), (3, None, "d")}
    with pytest.raises(ValueError, match="right"):
        C.join_columns(a, b.union(b), "k")


def test_category_fanout(spark):
    pred = spark.createDataFrame([("i", 1.0)], "item string, pred double")
    true = spark.createDataFrame([("i", "c"), ("i", "c")], "item string, category string")
    assert C.attach_category(pred, true, ["item"]).count() == 1
    assert C.attach_category(pred, true, ["item"], fanout=True).count() == 2


def test_no_file_list_goes_through_the_order(spark, monkeypatch):
    rows = spark.range(40).select(F.col("id").alias("i"), F.when(F.col("id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array_repeat(F.lit("f"), 9)).alias("files"))
    longest, index = [], C.global_index

    def seen(df, *args, **kwargs):
        longest.append(df.agg(F.max(F.size("files"))).first()[0])
        return index(df, *args, **kwargs)

    monkeypatch.setattr(C, "global_index", seen)
    found = C.missing_files(rows, "i").collect()
    assert {(r.i, r.position, tuple(r.files)) for r in found} == {(i, i, ()) for i in range(0, 40, 4)} and longest == [1]
