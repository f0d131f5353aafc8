"""Fingerprints, context trees, pieces and the pipeline."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from hemline.llm import context_tree, order_minhash, pieces
from hemline.llm.queries import tokenizer_path

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
AWKWARD = [(2, None), (4, ""), (6, " "), (6, " "), (8, "a"), (9, "日本語 🙂🙂 \x00 ▁▁x  y "), (11, "long " * 40_000), (13, "b" * 5000), (15, " " * 100 + "end")]


def test_fingerprints(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(i + 10_000, t) for i, t in AWKWARD], DOCS))
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    want = []
    for (key, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        own, its, next_own = (order_minhash.signature(t) for t in (text, changed, following))
        digest = hashlib.sha256(changed.encode()).hexdigest()
        want.append((key, len(text), digest, order_minhash._hexed(own), order_minhash._hexed(its), float((own == its).mean()), float((own == next_own).mean())))
    assert sorted(map(tuple, order_minhash.report(docs).collect())) == sorted(want)
    assert order_minhash.report(docs.limit(0)).count() == 0
    alone = order_minhash.report(docs.limit(1)).first()
    assert alone.near_next == 1.0


def test_fingerprints_by_definition():
    """Every component by sorting all numbered k-mers from its start."""
    rng = np.random.default_rng(4)
    for n in (3, 9, 40, 5000):
        text = "".join(rng.choice(list("abcd"), n))
        hashes = order_minhash._numbered(order_minhash._points(text), order_minhash.K)
        want = []
        for start in order_minhash._STARTS:
            first = np.sort(np.argsort(hashes - start, kind="stable")[: order_minhash.TUPLE])
            out = np.zeros(1, np.uint64)
            for i in first:
                out = order_minhash.mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i])
            want.append((out[0] >> np.uint64(32)).astype(np.uint32) | np.uint32(1))
        assert (order_minhash.signature(text) == np.array(want)).all()


def test_order_matters():
    a, b = "the first half of it. ", "and another half here. "
    same, swapped = order_minhash.signature(a * 1 + b), order_minhash.signature(b + a)
    assert order_minhash.likeness(same, swapped) < 0.8 < order_minhash.likeness(same, same)


def test_base_scores_and_tree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(i + 10_000, t) for i, t in AWKWARD], DOCS))
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", lower(t)) + ["\0end"]
    counts = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1 for w in tokens(t))
    total, bottom = sum(counts.values()), sum(counts.values()) + 0.5 * (len(counts) + 1)
    got = sorted(context_tree.report(docs, frequent=50).collect(), key=lambda r: (r.doc_id, r.n_tokens))
    for r, (key, text) in zip(got, sorted(rows, key=lambda x: (x[0], len(tokens(x[1]))))):
        w = tokens(text)
        assert (r.doc_id, r.n_tokens, r.n_known, r.train_tokens) == (key, len(w), sum(counts[x] > 0 for x in w), total)
        assert math.isclose(r.base_score, sum(math.log10((counts[x] + 0.5) / bottom) for x in w), rel_tol=1e-9)
        assert r.score < 0
    assert context_tree.report(docs.limit(0)).count() == 0


def test_weighting_by_definition(spark):
    """The mix along a path against the recursion over whole counts."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["abracadabra", "abrakadabra", "banana"] * 3)], DOCS)
    model = context_tree._fit_tree(docs)
    raw = [t.encode() for t in ["abracadabra", "abrakadabra", "banana"] * 3]
    keys, n = np.unique(context_tree.runs(raw)[0], return_counts=True)
    levels = []
    for depth in range(context_tree.DEPTH + 1):
        name, zero, one = context_tree.nodes(*_shortened(keys, n, depth))
        levels.append({int(k): (float(a), float(b)) for k, a, b in zip(name, zero, one)})

    def weighted(depth, node):
        a, b = levels[depth][node]
        own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
        if depth == context_tree.DEPTH:
            return own, 1.0
        below = sum(weighted(depth + 1, k)[0] for k in levels[depth + 1] if k & int(context_tree._mask(depth)) == node)
        return float(np.logaddexp(own, below)) - math.log(2), 1 / (1 + math.exp(below - own))

    text = context_tree.runs([b"abrad"])[0][:4]
    for key in text:
        total = 0.0
        for node, bit in context_tree.decisions(np.array([key])):
            p, mass = 0.0, 1.0
            seen = [d for d in range(context_tree.DEPTH + 1) if int(node[0]) & int(context_tree._mask(d)) in levels[d]]
            for d in range(seen[-1] + 1):
                a, b = levels[d][int(node[0]) & int(context_tree._mask(d))]
                share = weighted(d, int(node[0]) & int(context_tree._mask(d)))[1] if d < seen[-1] else 1.0
                p += mass * share * (b + 0.5) / (a + b + 1)
                mass *= 1 - share
            total += math.log10(p if bit[0] else 1 - p)
        assert math.isclose(total, float(model.log10(np.array([key]))[0]), abs_tol=5e-3)


def test_every_counted_context_is_used(spark):
    """Documents whose scores meet the definition for all their runs, however many contexts the tree has."""
    draw = np.random.default_rng(6)
    vocabulary = ["".join(draw.choice(list("abcdefghijklmnop"), 6)) for _ in range(3000)]
    texts = [" ".join(draw.choice(vocabulary, 60)) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    learned = [t.encode() for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1]
    keys, n = np.unique(context_tree.runs(learned)[0], return_counts=True)
    names, zeros, ones = (list(x) for x in zip(*(context_tree.nodes(*_shortened(keys, n, d)) for d in range(context_tree.DEPTH + 1))))
    own = [w[1] for w in context_tree.weigh(names, zeros, ones, 0)]
    places = [{int(k): i for i, k in enumerate(name)} for name in names]
    known = {}

    def log10(key):
        total = 0.0
        for node, bit in context_tree.decisions(np.array([key])):
            path = [places[d].get(int(node[0]) & int(context_tree._mask(d))) for d in range(context_tree.DEPTH + 1)]
            path = [i for i in path if i is not None]
            p, mass = 0.0, 1.0
            for d, i in enumerate(path):
                share = own[d][i] if d < len(path) - 1 else 1.0
                p += mass * share * (ones[d][i] + 0.5) / (zeros[d][i] + ones[d][i] + 1)
                mass *= 1 - share
            total += math.log10((p if bit[0] else 1 - p) if path else 0.5)
        return total

    got = {r.doc_id: r.score for r in context_tree.report(docs).collect()}
    for i, t in list(enumerate(texts))[:40]:
        want = sum(known.setdefault(int(k), log10(k)) for k in context_tree.runs([t.encode()])[0])
        assert math.isclose(got[i], want, rel_tol=1e-9)


def test_a_pair_of_bytes_is_in_many_groups(spark, monkeypatch):
    """Runs that end in one pair of context bytes are not one group's, and the scores stay the same."""
    draw = np.random.default_rng(7)
    letters = list("bcdfghjklmnpqrst")
    texts = [" ".join("".join(draw.choice(letters, 3)) + "e " + "".join(draw.choice(letters, 2)) for _ in range(40)) for _ in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    want = sorted(map(tuple, context_tree.report(docs).collect()))
    groups = []
    monkeypatch.setattr(context_tree, "RUNS", 20)
    monkeypatch.setattr(context_tree, "materialize", lambda df, keep=context_tree.materialize: groups.append(out := keep(df)) or out)
    got = sorted(map(tuple, context_tree.report(docs).collect()))
    assert all(a[:-1] == b[:-1] and math.isclose(a[-1], b[-1], rel_tol=1e-9) for a, b in zip(want, got, strict=True))
    tree = next(g for g in groups if "weighed" in g.columns)
    sums = tree.where("node IS NOT NULL").groupBy("node").count()
    in_pair = sums.where(F.shiftright("node", 8).bitwiseAND(F.lit(0xFFFF)) == int.from_bytes(b"e ", "big"))
    assert in_pair.agg(F.max("count")).first()[0] > 5


def _shortened(keys, n, depth):
    short, inverse = np.unique(keys & context_tree._mask(depth), return_inverse=True)
    return short, np.bincount(inverse, n)


def test_pieces_agree_with_the_library(spark):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").limit(60).unionByName(spark.createDataFrame(AWKWARD, DOCS))
    got = pieces.decode(pieces.encode(docs, path, chunk_chars=50_000), path).collect()
    assert len(got) == 60 + len(AWKWARD)
    assert all(r.ids == library.encode(r.text) and r.decoded == r.text.replace("▁", " ") for r in got)


def test_pieces_of_awkward_texts(spark):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["漢字かな交じり文" * 9, "a" * 70, "x" + " " * 60 + "y", "ab\n\ncd\te", "\U0001f600é\u0301ß", "Ω≠中", " ", "  ", "x ", "q9" * 40 + " z", None, ""]
    rows = [(None if i == 1 else i, t, "1") for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, ids string")
    got = pieces.decode(pieces.encode(docs, path, chunk_chars=200), path).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in [*rows, rows[0]])
    assert {r.text for r in got} == {t or "" for t in texts}
    assert all(r.ids == library.encode(r.text) and r.decoded == r.text for r in got)
    assert pieces.decode(pieces.encode(docs.limit(0), path), path).count() == 0


def test_pieces_travel_once(spark, monkeypatch):
    """Words meet their ids in their buckets, without a second shuffle by word, however many buckets, packed tables and cuts there are."""
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    for name, value in (("LATTICE_WORDS", 100), ("PACKED_ROWS", 50), ("CUT_WORDS", 7), ("SLICE", 300)):
        monkeypatch.setattr(pieces, name, value)
    docs = spark.createDataFrame([(i, "  ".join(f"wörd{j} x{i}" for j in range(i, i + 40))) for i in range(30)], DOCS)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        encoded = pieces.encode(docs, path, chunk_chars=3000)
        assert "hashpartitioning(word" not in encoded._jdf.queryExecution().executedPlan().toString()
        got = pieces.decode(encoded, path).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(got) == 30 and all(r.ids == library.encode(r.text) and r.decoded == r.text for r in got)


def test_words_are_numbered_and_cut_by_definition():
    texts = ["a b", "", " ", "  lead", "trail  ", "x   y x", "▁▁m ß漢🙂a", "a b", None]
    import pyarrow as pa

    array = pa.chunked_array([pa.array([t or "" for t in texts])])
    words, numbers, at = pieces._numbered(array)
    want = [re.findall("▁+[^▁]*", "▁" + (t or "").replace(" ", "▁")) if t else [] for t in texts]
    assert [[words[int(n)].as_py() for n in numbers[a:b]] for a, b in zip(at, at[1:])] == want
    pairs = frozenset(["▁a", "▁x", "ß漢", "le", "ea"])
    parts, begins = pieces._cutter(pairs)(words)
    for word, a, b in zip(words.to_pylist(), begins, begins[1:]):
        got = parts.to_pylist()[a:b]
        assert "".join(got) == word
        assert got == re.findall("(?s)[^\0]+", "".join(c + ("" if c + d in pairs else "\0") for c, d in zip(word, word[1:] + "\0")))


def test_pairs_are_joined_in_one_pass(spark):
    """One pass over numbered edges joins what joining the best pair again and again does; late pieces are known and handled."""
    assert pieces.late_pieces(["abc", "bc", "ab"]) == {"abc"} and not pieces.late_pieces(["bc", "abc", "ab"])
    rng = np.random.default_rng(7)
    some = lambda longest: "".join(rng.choice(list("abcd▁ß"), rng.integers(1, longest + 1)))
    words = sorted({some(24) for _ in range(400)} | {"a" * 24, "x", "abc"})
    late_words = 0
    for ranked in (["abc", "bc", "cab", "a", "b"], [*dict.fromkeys(some(5) for _ in range(60))], ["ab", "abab", "a", "b", "c"]):
        late, ids = pieces.late_pieces(ranked), {p: 300 + i for i, p in enumerate(ranked)}
        table = spark.createDataFrame([(p, i, ids[p], -1.0 * i, p in late) for i, p in enumerate(ranked)], "piece string, rank int, id int, score double, late boolean")

        def joined(word, ranks={p: i for i, p in enumerate(ranked)}, ids=ids):
            parts = list(word)
            while len(parts) > 1:
                best, at = min((ranks.get(a + b, math.inf), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                if best == math.inf:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            return [n for p in parts for n in ([ids[p]] if p in ids else [3 + b for b in p.encode()])]

        edged = pieces.numbered_lattice(spark.createDataFrame([(w,) for w in words], "word string"), table, 5)
        got = edged.select("word", pieces._merged_ids(F.col("word"), F.col("edges"), 3).alias("ids")).collect()
        assert {r.word: r.ids for r in got} == {w: joined(w) for w in words}
        late_words += sum(any(p in w for p in late) for w in words)
    assert late_words > 50


def test_best_path_by_brute_force(spark):
    table = spark.createDataFrame([("a", 0, 1, -1.0), ("b", 1, 2, -1.5), ("ab", 2, 3, -2.0), ("aba", 3, 4, -2.8), ("ba", 4, 5, -2.2)], "piece string, rank int, id int, score double")
    words = spark.createDataFrame([(w,) for w in ("abab", "ababa", "bbaab", "a")], "word string")
    score = {r.piece: r.score for r in table.collect()}

    def best(word):
        return max((score[word[:i]] + (best(word[i:]) if word[i:] else 0.0) for i in range(1, len(word) + 1) if word[:i] in score), default=-math.inf)

    edged = pieces.lattice(words, table, 3)
    for r in edged.withColumn("path", pieces._best_path(F.col("word"), F.col("edges"))).collect():
        assert math.isclose(sum(score[r.word[a:b]] for a, b in zip(r.path, r.path[1:])), best(r.word))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "ngram_jaccard_join", "secret_scans", "best_fit_packing"]
    wide = docs.withColumn("score", docs["n_chars"]).withColumn("row", docs["doc_id"])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).columns == docs.columns
        assert stage(spark, wide, FOLDER).columns == wide.columns
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
    got = corpus_pipeline.run(spark, FOLDER)
    kept = {r.doc_id for r in got.select("doc_id").distinct().collect()}
    assert 0.7 * docs.count() < len(kept) < docs.count()
