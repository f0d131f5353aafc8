import pytest

from hemline.session import scratch_path, shared_folder
from hemline.sources import files as Fi
from hemline.sources import tables as Ta


def test_preamble_is_dropped_from_many_split_files(spark, tmp_path):
    want = []
    for f in range(3):
        lines = ["title", "", "x,y", "n,s"] + [f'{f * 1000 + i},"a, {i}"' for i in range(400)]
        want += [(f * 1000 + i, f"a, {i}") for i in range(400)]
        (tmp_path / f"s{f}.csv").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        df = Ta.read_table(spark, str(tmp_path), "csv", "n int, s string", skip_rows=3)
        assert df.rdd.getNumPartitions() > 5
        assert sorted(tuple(r) for r in df.collect()) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_preamble_needs_a_schema(spark, tmp_path):
    with pytest.raises(ValueError):
        Ta.read_table(spark, str(tmp_path), "csv", skip_rows=1)


def test_list_files_with_blanks(spark, tmp_path):
    (tmp_path / "a b" / "RED").mkdir(parents=True)
    (tmp_path / "a b" / "RED" / "x 1.jpg").write_text("x")
    (tmp_path / "top.txt").write_text("x")
    got = {tuple(r) for r in Fi.list_files(spark, str(tmp_path), relative=True).collect()}
    assert got == {("a b/RED", "x 1.jpg", "a b/RED/x 1.jpg"), ("", "top.txt", "top.txt")}


def test_mapping_keeps_later_colons(spark):
    path = scratch_path(spark)
    Fi.write_mapping(spark.createDataFrame([("k", "v: w")], "key string, value string"), path)
    assert [tuple(r) for r in Fi.read_mapping(spark, path).collect()] == [("k", "v: w")]


def test_params_round_trip(spark):
    path = scratch_path(spark)
    params = {"lam": 0.1234567890123, "k": 3, "metric": "euclidean", "flag": True, "none": None}
    Fi.save_params(spark, params, path)
    assert Fi.load_params(spark, path) == {k: v for k, v in params.items() if v is not None}


def test_index_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`Unnamed: 0` int, `_c0` int, x int")
    assert Ta.drop_index_columns(df).columns == ["x"]


def test_shared_folder_comes_from_the_session(spark):
    setting = spark.conf.get("spark.checkpoint.dir", None)
    if setting:
        assert shared_folder(spark) == setting.rstrip("/")
    assert scratch_path(spark).startswith(shared_folder(spark) + "/hemline/")


def test_cluster_without_shared_folder_is_refused():
    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())
