"""Sharding, packing, near copies and search against brute force."""

import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from hemline.llm import impact_search, jaccard, packing, sharding
from hemline.llm.queries import QUERIES, tokenizer_path

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def shards_of(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.shard].append(r)
    return out


def test_shards_of_documents(spark):
    got = shards_of(QUERIES["op3_sharding"](spark, "/root/testdata/sf0.01"))
    sizes = [sum(r["size"] for r in rows) for rows in got.values()]
    largest = max(r["size"] for rows in got.values() for r in rows)
    assert sorted(got) == list(range(40)) and max(sizes) - min(sizes) <= largest
    assert all(sorted(r["slot"] for r in rows) == list(range(len(rows))) for rows in got.values())


def test_shards_of_one_hot_group(spark):
    rows = [(7, "the same")] * 300 + [(i, f"text {i}") for i in range(600)] + [(None, None), (None, "")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("slot", F.lit("clash"))
    got = shards_of(sharding.shard_documents(docs, shards=10))
    sizes = [sum(r["size"] for r in rows) for rows in got.values()]
    assert sum(map(len, got.values())) == len(rows) and max(sizes) - min(sizes) <= 60
    assert all(sorted(r["slot"] for r in rows) == list(range(len(rows))) for rows in got.values())
    assert all(r.text_crc32 == zlib.crc32((r.text or "").encode()) for rows in got.values() for r in rows)
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_packing_against_the_library(spark):
    from tokenizers import Tokenizer

    extra = [(9001, None), (9002, ""), (9003, "Été  ΣΑΣ <|endoftext|> don't\t\x1cx"), (9003, "same id"), (9004, "wörter " * 4000)]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(extra, DOCS))
    path = tokenizer_path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    want = []
    for r in docs.collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(r.doc_id, p, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for p, s in enumerate(range(0, len(ids), 2048))]
    got = packing.report(docs, path).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))]
        assert sum(n for _, n in places) <= 2048
    assert len(bins) <= packing.lower_bound(np.array([r.length for r in got])) + 1
    assert packing.report(docs.limit(0), path).count() == 0


def test_packing_bounds_and_exchange(spark):
    rng = np.random.default_rng(1)
    for _ in range(20):
        lengths = rng.integers(1, 101, 200)
        bins, offsets, room = packing.best_fit_decreasing(lengths, 100)
        assert packing.lower_bound(lengths, 100) <= len(room) and (room >= 0).all()
    assert packing.lower_bound(np.array([51] * 10), 100) == 10
    assert packing.lower_bound(np.array([34] * 10), 100) == 5
    cut = spark.createDataFrame([(int(n), "x") for n in rng.integers(1, 101, 900)], "length long, offset string")
    got = packing.pack(cut, capacity=100, group=100).collect()
    assert len(got) == 900
    # each of the nine groups may be one bin above its part
    assert len({r.sequence_id for r in got}) <= packing.lower_bound(np.array([r.length for r in got]), 100) + 9


def test_packing_keeps_a_column_named_row(spark):
    cut = spark.createDataFrame([(5, "a"), (5, "a"), (100, None)], "length long, Row string")
    got = packing.pack(cut, capacity=100)
    assert got.columns == ["length", "Row", "sequence_id", "offset"]
    assert sorted((r.length, r.Row or "") for r in got.collect()) == [(5, "a"), (5, "a"), (100, "")]


def n_grams(text):
    w = re.findall(r"\w+", (text or "").lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def by_brute_force(rows):
    sets = [n_grams(t) for _, t in rows]
    linked = [[j for j in range(len(rows)) if j != i and (rows[i][1] or "") == (rows[j][1] or "") or j != i and sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in range(len(rows))]
    root = list(range(len(rows)))
    for _ in rows:
        root = [min([root[i], *[root[j] for j in linked[i]]]) for i in range(len(rows))]
    least = {}
    for i, r in enumerate(root):
        least[r] = min([x for x in (least.get(r), rows[i][0]) if x is not None], default=None)
    return sorted((rows[i][0], least[root[i]], len(linked[i])) for i in range(len(rows)))


def test_exchange_until_the_pool_is_one_group_or_stops_shrinking(spark, monkeypatch):
    draw = np.random.default_rng(3)
    cut = spark.createDataFrame([(int(n),) for n in draw.integers(20, 60, 1500)], "length long")
    rounds, pack = [], packing._round
    monkeypatch.setattr(packing, "_round", lambda items, parts, *more: rounds.append((parts, pack(items, parts, *more))) or rounds[-1][1])
    got = packing.pack(cut, capacity=100, group=6).collect()
    parts, last = rounds[-1]
    offered = last.where("offered").count()
    assert len(rounds) > 4 and (parts == 1 or offered in (0, last.count()))
    room = defaultdict(int)
    for r in got:
        room[r.sequence_id] += r.length
    assert len(got) == 1500 and max(room.values()) <= 100


@pytest.mark.parametrize("block", [512, 8])
def test_near_copies(spark, block):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(500)]
    base = [" ".join(rng.choice(words, 60)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(60):
        w = base[i % 3].split()
        w[rng.integers(60)] = "changed" + str(i % 20)
        rows.append((100 + i, " ".join(w)))
    rows += [(500 + i, base[0]) for i in range(30)] + [(900, None), (901, ""), (902, "two words"), (903, "Two  words!"), (904, "?")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("row", F.lit(1))
    got = sorted(tuple(r) for r in jaccard.classes(docs, block=block).select("doc_id", "class_id", "links").collect())
    assert got == by_brute_force(rows)
    kept = jaccard.one_of_each(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c, _ in got}) and kept.columns == docs.columns
    assert jaccard.classes(docs.limit(0)).count() == 0


def test_blocks_are_bounded_in_bytes(spark, monkeypatch):
    draw = np.random.default_rng(8)
    text = [f"w{i}" for i in draw.integers(0, 9000, 400)]
    rows = [(i, " ".join([*text, f"end{i}"])) for i in range(30)]
    docs = spark.createDataFrame(rows, DOCS)
    want = sorted(map(tuple, jaccard.report(docs).collect()))

    def bounded(threshold, keep=jaccard._verify):
        verify = keep(threshold)

        def run(group):
            assert sum(map(len, group.column("grams").to_pylist())) <= 32_000
            return verify(group)

        return run

    monkeypatch.setattr(jaccard, "_verify", bounded)
    got = sorted(map(tuple, jaccard.classes(docs, size=8000).select("doc_id", "class_id", "links").collect()))
    assert got == want and {r[2] for r in got} == {29}


def test_enough_bands():
    assert jaccard.bands_for(Fraction(4, 5), 5, 0.999) == 18


def test_components_of_a_chain(spark):
    chain = [(i + 1, i) for i in range(40)] + [(101, 100), (100, 101)]
    got = dict(tuple(r) for r in jaccard.components(spark.createDataFrame(chain, "row long, root long")).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_top_k(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in rng.normal(0, 0.1, 8)]) for i in range(300)]
    vectors += [(400 + i, [0.5] * 8) for i in range(40)] + [(50, [0.5] * 8), (None, [0.5] * 8)]
    bad = [(1000, None), (1050, [None] * 8), (1100, [float("nan")] * 8), (1150, [float("inf")] * 8), (1200, []), (1250, [0.1, 0.2])]
    df = spark.createDataFrame(vectors + bad, "vec_id long, embedding array<double>").withColumn("rank", F.lit(0))
    got = impact_search.top_k(df, F.col("vec_id") % 50 == 0, block=64, query_block=4).collect()
    ints = [(i, np.floor(np.array(v) * 256).astype(int)) for i, v in vectors]
    want = []
    for q, v in ints:
        if q is not None and q % 50 == 0:
            scored = sorted((-int(v @ w), i is None, i or 0) for i, w in ints if i != q)[:5]
            want += [(q, n + 1, None if none else i, -s) for n, (s, none, i) in enumerate(scored)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert impact_search.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
