"""Joins by runs, bins and hashes, sheets, saved scalers, observed counts and stored sketches."""

import csv
import datetime
import io
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from hemline import session
from hemline.functions import text as X
from hemline.operators import evaluation as E
from hemline.operators import hashing as H
from hemline.operators import models as L
from hemline.operators import neighbors as N
from hemline.operators import profile as P
from hemline.operators import sales as S
from hemline.operators import scaling as Z
from hemline.operators import stages as St
from hemline.plans import neighbor_queries as Q
from hemline.plans.registry import Tables
from hemline.session import materialize, scratch_path
from hemline.sources import sheets as Sh


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def no_pairs(df):
    assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)


def test_a_thousand_rules_drop_the_rows_of_the_chain(spark):
    draw = random.Random(1)
    some = lambda n: "".join(draw.choice("ABé1") for _ in range(n))
    seasons = ["s1", "s2", "s3"]
    rules = sorted({(draw.choice(seasons), some(draw.randrange(2, 7))) for _ in range(1500)})
    rules = [r for r in rules if len(r[1]) > 3 or draw.random() < 0.2][:1000]
    rows = [(draw.choice([*seasons, "s4", None]), draw.choice([None, some(draw.randrange(9)), "ABAB1"]), n) for n in range(3000)]
    df = spark.createDataFrame(rows, "season string, item string, n int")
    table = spark.createDataFrame([*rules, rules[0], ("s1", None), (None, "A")], "season string, pattern string")
    chain = {s: "|".join(p for r, p in rules if r == s) for s in seasons}
    want = sorted(r.n for r in S.exclude_old_cohorts(df, "item", chain).collect())
    got = S.exclude_by_rules(df, "item", table)
    no_pairs(got)
    assert sorted(r.n for r in got.collect()) == want and 0 < len(want) < 2500 and len(rules) > 500
    everything = spark.createDataFrame([("s1", "")], "season string, pattern string")
    assert S.exclude_by_rules(df, "item", everything).where("season = 's1'").count() == 0
    assert S.exclude_by_rules(df, "item", table.limit(0)).count() == sum(r[1] is not None for r in rows)


@pytest.mark.parametrize("bin_days", [None, 1, 1000])
def test_seasons_as_rows(spark, bin_days):
    day = lambda n: datetime.date(2020, 1, 1) + datetime.timedelta(n)
    draw = random.Random(2)
    spans = [(f"s{n}", day(b := draw.randrange(-50, 300)), day(b + draw.choice([0, 1, 7, 90, 400, -3]))) for n in range(40)]
    spans += [("all", day(-5000), day(5000)), ("same", day(3), day(9)), ("open", day(3), None), (None, day(0), day(9))]
    rows = [(n, datetime.datetime.combine(day(draw.randrange(-60, 400)), datetime.time(23, 59)), "old") for n in range(300)] + [(900, None, "x")]
    df = spark.createDataFrame(rows, "n int, at timestamp_ntz, season string")
    seasons = spark.createDataFrame(spans, "season string, start date, end date")
    got = S.season_join(df, "at", seasons, bin_days)
    no_pairs(got)
    want = [(n, s) for n, at, _ in rows if at for s, b, e in spans if e and b <= at.date() < e]
    assert sorted(((r.n, r.season) for r in got.collect()), key=str) == sorted(want, key=str)
    assert got.columns == ["n", "at", "season"] and S.season_join(df, "at", seasons.limit(0)).count() == 0


def test_hash_index_on_clusters(spark, monkeypatch):
    monkeypatch.setattr(H, "GROUP_ROWS", 300)
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(12, 16)) * 5
    rows = [(n, (centres[n % 12] + draw.normal(size=16)).tolist()) for n in range(900)]
    rows += [(5000 + n, rows[7][1]) for n in range(40)]  # a crowd of copies
    train = spark.createDataFrame(rows, "id long, vec array<double>")
    index = H.build_lsh(train, 3, block_rows=16)
    assert index.sizes.agg(F.max("parts")).first()[0] > 1 and index.groups > 3
    exact, found = N.nearest(train, train, 3), index.nearest(train, 3)
    share = index.compared(train).first()
    assert H.recall(found, exact).first()[0] > 0.9 and share.compared / share.pairs < 0.3
    vectors = {r[0]: np.array(r[1]) for r in rows}
    for r in found.collect():
        assert len({p.id for p in r.neighbors}) == len(r.neighbors) <= 3 and r.qid not in {p.id for p in r.neighbors}
        assert all(abs(p.d - np.linalg.norm(vectors[r.qid] - vectors[p.id])) < 1e-9 for p in r.neighbors)
        assert [(p.d, p.id) for p in r.neighbors] == sorted((p.d, p.id) for p in r.neighbors)
    wide = H.nearest_lsh(train, train, 3, width=1e9)
    assert {r.qid: r.neighbors for r in wide.collect()} == {r.qid: r.neighbors for r in exact.collect()}


def test_a_row_is_written_once_to_the_index_and_never_shuffled(spark, monkeypatch, capsys):
    monkeypatch.setattr(H, "GROUP_ROWS", 50)
    draw = np.random.default_rng(6)
    rows = [(n, (np.eye(8)[n % 8] * 9 + draw.normal(size=8)).tolist()) for n in range(400)]
    train = spark.createDataFrame(rows, "id long, vec array<double>")
    index = H.build_lsh(train, 3)
    assert index.groups >= 8 and index.held.count() == 400
    index.nearest(train, 3).explain()
    plan = capsys.readouterr().out
    assert "CoGroup" not in plan
    dealt = [line for line in plan.splitlines() if "Exchange hash" in line]
    assert dealt and all("hashpartitioning(qid" in line for line in dealt)


@pytest.mark.parametrize("few", [0, 1024])
def test_small_buckets_are_measured_like_large_ones(spark, monkeypatch, few):
    monkeypatch.setattr(H, "_FEW_PAIRS", few)
    draw = np.random.default_rng(7)
    vectors = draw.normal(size=(300, 6))
    train = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(vectors)], "id long, vec array<double>").repartition(3)
    index = H.build_lsh(train, 3, tables=3, hashes=4, block_rows=16)
    names = [index.projections.buckets(pd.Series(list(vectors)), n).reshape(300, -1) for n in (1, 5)]
    for r in index.nearest(train, 3, probes=5).collect():
        met = [i for i in range(300) if i != r.qid and set(names[0][i]) & set(names[1][r.qid])]
        want = sorted((np.sqrt(np.square(vectors[r.qid] - vectors[i]).sum()), i) for i in met)[:3]
        assert [(p.d, p.id) for p in r.neighbors] == want


def test_figures_of_the_index_leave_no_vectors_behind(spark, tmp_path):
    rows = [(i, np.random.default_rng(i).normal(size=16).tolist(), i % 4) for i in range(240)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    written = session._WRITTEN.setdefault(spark.sparkContext.applicationId, [])
    before = len(written)
    found = Q.lsh_quality(Tables(spark, str(tmp_path))).collect()
    assert [r.copies for r in found] == [1, 4, 16] and all(r.recall > 0.5 for r in found)
    # the table dealt to the cores, and a row of figures for each size
    held = [spark.read.parquet(path).count() for path in written[before:]]
    assert sorted(held) in ([1, 1, 1], [1, 1, 1, 240])


def test_hash_index_without_neighbours(spark):
    rows = [(1, [0.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [float("nan"), 1.0]), (5, [1e6, 1e6]), (6, [1.0])]
    both = spark.createDataFrame(rows, "id long, vec array<double>")
    got = {r.qid: [p.id for p in r.neighbors] for r in H.nearest_lsh(both, both, 2, width=10.0).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6} and got[5] == got[3] == got[4] == got[6] == []
    assert got[1] == [2] and got[2] == [1]
    assert all(not r.neighbors for r in H.nearest_lsh(both, both.limit(0), 2).collect())
    with pytest.raises(ValueError):
        H.build_lsh(both, 2).nearest(both, 2, probes=0)


def _written(folder, texts):
    for n, text in enumerate(texts):
        (folder / f"part-{n}.csv").write_bytes(text.encode())


def test_sheets_equal_a_row_wise_reader(spark, tmp_path):
    draw = random.Random(4)
    cell = lambda: draw.choice(["a", "", 'say "x"', "two\nlines", "a,b", "é" * 30, "line\r\n" * 200, '"', "\n\n"])
    texts, want = [], []
    for f in range(4):
        out = io.StringIO()
        out.write("".join(f'note "{n}, odd quote\n' for n in range(37)))
        writer = csv.writer(out, quoting=csv.QUOTE_NONNUMERIC, lineterminator="\r\n" if f % 2 else "\n")
        writer.writerow(["id", "text", "last\ncolumn"])
        for n in range(60):
            row = (f * 1000 + n, cell(), cell())
            writer.writerow(row)
            want.append(row)
        texts.append(out.getvalue())
    _written(tmp_path, [*texts, "", "too\nshort\n"])
    (tmp_path / "_SUCCESS").write_text("not a sheet")
    Sh.register(spark)
    for block in (64, 1000, 1_000_000):
        reader = spark.read.format("sheet").option("skip_rows", 37).option("block_bytes", block)
        got = reader.schema("id int, text string, last string").load(str(tmp_path))
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert got.rdd.getNumPartitions() == 5
    named = spark.read.format("sheet").option("skip_rows", 37).load(f"file:{tmp_path}/part-0.csv")
    assert named.columns == ["id", "text", "last\ncolumn"] and named.count() == 60


def test_sheets_without_header_and_with_other_columns(spark, tmp_path):
    _written(tmp_path, ['1;2.5;true;2020-01-02\n;;;\n3;"";false;x,y\n'])
    Sh.register(spark)
    reader = spark.read.format("sheet").option("header", "false").option("delimiter", ";")
    got = reader.schema("a bigint, b string, c boolean").load(str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [(1, "2.5", True), (None, None, None), (3, "", False)]
    wide = reader.schema("a bigint, b string, c boolean, d string, e double").load(str(tmp_path)).collect()
    assert [r.d for r in wide] == ["2020-01-02", None, "x,y"] and all(r.e is None for r in wide)
    plain = spark.read.format("sheet").option("header", "false").option("delimiter", ";")
    assert plain.load(str(tmp_path)).columns == ["_c0", "_c1", "_c2", "_c3"]


@pytest.mark.parametrize("kind,form", [("anchor", "power"), ("anchor", "boxcox"), ("standard", "power")])
def test_scaler_model_and_unscaling_are_one_object(spark, kind, form):
    rows = [(float(n), float((n + 3) ** 2 + n % 5)) for n in range(200)]
    df = spark.createDataFrame(rows, "x double, target double")
    stages = [St.TargetScaler(kind=kind, form=form), VectorAssembler(inputCols=["x"], outputCol="__features"), LinearRegression(featuresCol="__features", labelCol="scaled")]
    fitted = St.unscaled(Pipeline(stages=stages).fit(df))
    path = scratch_path(spark)
    fitted.save(path)
    again = PipelineModel.load(path)
    assert again.stages[0].scaler == fitted.stages[0].scaler
    got = L.batch_score(df.drop("target"), path).orderBy("x").collect()
    scaler = Z.fit_anchor(df, "target", form=form) if kind == "anchor" else Z.fit_standard(df, "target")
    plain = scaler.unscale(fitted.stages[2].transform(fitted.stages[1].transform(df)), "prediction", "p").orderBy("x").collect()
    assert all(abs(a.prediction - b.p) < 1e-9 * abs(b.p) for a, b in zip(got, plain))
    # on the target's scale, so far nearer to it than its mean is
    mean = sum(b.target for b in plain) / len(plain)
    assert sum(abs(a.prediction - b.target) for a, b in zip(got, plain)) < 0.3 * sum(abs(b.target - mean) for b in plain)


def test_guarded_rows_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = [(draw, g) for draw, g in zip([1.0, None, float("nan"), 2.0, float("nan")] * 20, ["a", "b", None, "a", "b"] * 20)]
    df = spark.createDataFrame(rows, "pred double, g string")
    for by, groups in ((None, ()), ("g", ("a", "b", None, "unused"))):
        for nulls in (False, True):
            before = read.value
            kept, report = E.write_guarded(df.mapInArrow(counted, df.schema), ["pred"], by, groups, nulls)
            assert read.value - before == 100
            same, plain = E.nan_guard(df, ["pred"], by, nulls)
            assert sorted(map(str, report.collect())) == sorted(map(str, plain.collect()))
            assert sorted(map(str, kept.collect())) == sorted(map(str, same.collect())) and read.value - before == 100
    with pytest.raises(ValueError):
        E.write_guarded(df, ["pred"], "g", ("a", "b"))


def test_stored_distinct_sketches(spark):
    df = spark.range(60_000).select((F.col("id") % 3).cast("string").alias("s"), F.when(F.col("id") % 7 != 0, F.col("id") % 20_011).alias("v"))
    old, new = (P.distinct_sketches(df.where(w), "v", "s") for w in ("s <> '2'", "s = '2'"))
    stored = old.unionByName(new)
    total = P.sketched_count(P.merge_sketches(stored)).first()
    exact = P.distinct_count(df, "v").first()[0]
    assert abs(total["values"] - exact) <= total["error"] < 0.06 * exact
    by_season = {r.s: r for r in P.sketched_count(P.merge_sketches(stored, "s")).collect()}
    for r in P.distinct_count(df, "v", "s").collect():
        assert abs(by_season[r.s]["values"] - r["values"]) <= by_season[r.s]["error"]
    dates = spark.createDataFrame([("a", datetime.date(2020, 1, 1)), ("a", None), ("b", None)], "s string, v date")
    assert {r.s: r["values"] for r in P.sketched_count(P.distinct_sketches(dates, "v", "s")).collect()} == {"a": 2, "b": 1}


def test_stored_quantile_sketches(spark):
    draw = np.random.default_rng(5)
    values = [(str(n % 3), float(v)) for n, v in enumerate(draw.lognormal(size=9000))]
    df = spark.createDataFrame([*values, ("0", None), ("1", float("nan"))], "s string, y double")
    # a sketch is drawn anew each time it is built
    stored = materialize(Z.quantile_sketches(df, "y", "s"))
    for sketches, rows in ((Z.merge_quantile_sketches(stored), [v for _, v in values]), (stored.where("s = '1'"), [v for s, v in values if s == "1"])):
        for p, q in zip((0.16, 0.5, 0.84), Z.sketched_quantiles(sketches, (0.16, 0.5, 0.84)).first()["quantiles"]):
            assert abs(np.mean(np.array(rows) <= q) - p) < 2 * Z.sketch_rank_error() and q in rows
    anchors = {r.s: (r.a, r.b) for r in Z.sketched_anchors(stored, 0.5).collect()}
    quantiles = {r.s: r.quantiles for r in Z.sketched_quantiles(stored, (0.16, 0.84)).collect()}
    for s, (a, b) in anchors.items():
        assert abs(a * quantiles[s][0] ** 0.5 - b - 1) < 1e-9 and abs(a * quantiles[s][1] ** 0.5 - b + 1) < 1e-9


def test_pooled_word_vectors(spark):
    texts = [(1, "The cat, the DOG"), (2, None), (3, "unknown"), (4, "the " * 500), (4, "cat"), (None, "dog")]
    texts += [(10 + n, "the dog") for n in range(60)]
    table = {"the": ([1.0, 0.0], 0.5), "cat": ([0.0, 2.0], 2.0), "dog": ([4.0, 4.0], 1.0)}
    words = spark.createDataFrame([(w, v, x) for w, (v, x) in table.items()] + [("unknown", [9.0, 9.0], 0.0)], "word string, vector array<double>, weight double")
    got = {r.k: r.text_vector for r in X.pool_word_vectors(spark.createDataFrame(texts, "k long, t string"), "k", "t", words).collect()}

    def pooled(counts):
        total = sum(n * table[w][1] for w, n in counts.items())
        return [sum(n * table[w][1] * table[w][0][i] for w, n in counts.items()) / total for i in range(2)]

    assert len(got) == 65 and got[2] is None and got[3] is None
    assert got[1] == pytest.approx(pooled({"the": 2, "cat": 1, "dog": 1})) and got[4] == pytest.approx(pooled({"the": 500, "cat": 1}))
    assert got[None] == [4.0, 4.0] and got[10] == pytest.approx(pooled({"the": 1, "dog": 1}))


def test_words_beyond_the_frequent_ones_are_joined(spark, monkeypatch):
    draw = np.random.default_rng(3)
    names = [f"w{chr(97 + i)}" for i in range(20)]
    lists = [draw.choice([*names, "unknown"], draw.integers(0, 30)) for _ in range(200)]
    texts = spark.createDataFrame([(n % 150 if n % 11 else None, " ".join(w)) for n, w in enumerate(lists)], "k long, t string")
    # a word in two rows counts for both
    rows = [(w, draw.normal(size=3).tolist(), float(draw.random() + 0.1)) for w in [*names, names[0], names[4]]]
    words = spark.createDataFrame(rows, "word string, vector array<double>, weight double")
    want: dict = {}
    for n, used in enumerate(lists):
        total = want.setdefault(n % 150 if n % 11 else None, np.zeros(4))
        for w, v, x in rows:
            total += np.sum(used == w) * x * np.array([*v, 1.0])
    for frequent in (1, 3, 65_536):
        monkeypatch.setattr(X, "FREQUENT", frequent)
        got = {r.k: r.text_vector for r in X.pool_word_vectors(texts, "k", "t", words).collect()}
        assert got.keys() == want.keys()
        for k, total in want.items():
            assert got[k] is None if total[3] == 0 else got[k] == pytest.approx(list(total[:3] / total[3]))


def test_words_of_a_text_leave_its_task_as_one_vector(spark):
    texts = spark.range(50).select(F.col("id").alias("k"), F.lit("the cat and the dog").alias("t"))
    words = spark.createDataFrame([(w, [1.0, 2.0], 1.0) for w in ("the", "cat", "dog")], "word string, vector array<double>, weight double")
    pooled = X.pool_word_vectors(texts, "k", "t", words)
    assert "Join" not in pooled._jdf.queryExecution().optimizedPlan().toString()


def test_rules_meet_only_codes_that_may_hold_them(spark, monkeypatch):
    patterns = [f"{n:06d}" for n in range(100_000, 102_000)]
    rules = spark.createDataFrame([(s, p) for p in patterns for s in ("s1", "s2")], "season string, pattern string")
    codes = spark.createDataFrame([(s, f"C#000{n}") for n in range(101_900, 102_100) for s in ("s1", "s2", "s3")], "season string, item string")
    looked = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def contains(code, pattern):
        looked.add(1)
        return pattern in code

    monkeypatch.setattr(S.F, "contains", contains)
    assert S.exclude_by_rules(codes, "item", rules).groupBy("season").count().collect().__len__() == 3
    assert looked.value <= 200
