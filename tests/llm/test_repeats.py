"""Removal of repeated passages, vector codes and the filter audit against brute force."""

import hashlib
import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from hemline.llm import audit, lloyd, phrases
from hemline.llm.queries import ORACLES, QUERIES
from tests.check import compare, connect

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def kept_by_brute_force(rows, window=20):
    """(doc_id, n_words, n_removed, kept) for rows in their order."""
    seen, out = set(), []
    for i, text in rows:
        words = words_of(text)
        gone = set()
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if key in seen:
                gone.update(range(s, s + window))
            seen.add(key)
        out.append((i, len(words), len(gone), " ".join(w for n, w in enumerate(words) if n not in gone)))
    return out


def by_id(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:])))


def test_repeats_of_documents(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want = [(*r[:3], hashlib.sha256(r[3].encode()).hexdigest()) for r in kept_by_brute_force(rows)]
    got = QUERIES["op11_substring_dedup"](spark, FOLDER).collect()
    assert by_id(got) == by_id(want) and sum(r[2] for r in want) > 100


@pytest.mark.parametrize("chars", [600, 10_000_000])
def test_repeats_across_groups(spark, chars):
    draw = random.Random(5)
    some = lambda n: " ".join(draw.choice(["wörd", "a", "b", "日本", "x\xa0y", "c\x1cd"]) + str(draw.randrange(9)) for _ in range(n))
    passage, line = some(33), some(21)
    rows = [(n, f"{some(draw.randrange(30))}\t{passage if n % 3 else line}\n {some(draw.randrange(40))}") for n in range(60)]
    rows += [(60, "same " * 100), (61, "same " * 19), (62, None), (63, ""), (64, " \n "), (65, "one"), (66, f"{line}  {line} {line}"), (67, some(3000)), (68, rows[3][1])]
    rows += [(69, rows[5][1]), (69, rows[5][1]), (None, rows[7][1]), (None, some(50))]
    docs = spark.createDataFrame(rows, DOCS).withColumn("group", F.lit("clash")).withColumn("kept", F.lit(1)).repartition(4)
    got = phrases.remove_repeats(docs, group_chars=chars)
    assert by_id(got.collect()) == by_id(kept_by_brute_force(rows))
    assert got.count() == len(rows) and got.select("n_removed").count() == len(rows)
    assert phrases.remove_repeats(docs.limit(0)).count() == 0
    short = by_id(phrases.remove_repeats(docs, window=6, phrase=6, group_chars=chars).select("n_removed").collect())
    assert short == by_id([(r[2],) for r in kept_by_brute_force(rows, 6)])


def test_automata_locate_every_phrase():
    draw = random.Random(1)
    words = [draw.choice([b"a", b"b", "é".encode()]) for _ in range(2000)]
    chosen = [words[p : p + 4] for p in (0, 50, 51, 700)]
    places = [p for p in range(len(words) - 3) if words[p : p + 4] in chosen]
    assert phrases.locate(words, chosen, 4).tolist() == places


def codes_by_brute_force(rows, parts=8, entries=16, rounds=6):
    """{row: (code, distances)} and the books, by full scans with Python integers."""
    cut = [np.floor(np.array(v, np.float64) * 4096).astype(np.int64).reshape(parts, -1) for _, v in rows]
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    books = [[cut[i][p].tolist() for i in order[:entries]] for p in range(parts)]

    def assign():
        found = []
        for c in cut:
            near = [min((sum((a - b) ** 2 for a, b in zip(c[p].tolist(), e)), n) for n, e in enumerate(books[p])) for p in range(parts)]
            found.append(near)
        return found

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for n in range(len(books[p])):
                own = [cut[i][p].tolist() for i in range(len(cut)) if found[i][p][1] == n]
                if own:
                    books[p][n] = [sum(x) // len(own) for x in zip(*own)]
    return assign(), books


def check_codes(got, rows, labels, **how):
    found, books = codes_by_brute_force(rows, **how)
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    errors = [sum(d for d, _ in near) for near in found]
    want = []
    for (i, _), near, error, label in zip(rows, found, errors, labels):
        code = "".join(f"{n:02x}" for _, n in near)
        want.append((i, code, error, sum(e for e, other in zip(errors, labels) if other == label), digest))
    assert by_id(got) == by_id(want)


def test_codes_of_vectors(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").orderBy("vec_id").collect()
    got = QUERIES["op12_vector_codes"](spark, FOLDER)
    check_codes(got.collect(), [(r.vec_id, r.embedding) for r in rows], [r.label for r in rows])
    assert got.count() == len(rows) and got.select("label_error").count() == len(rows)


VECTORS = "vec_id long, embedding array<double>, label int"


def test_codes_of_awkward_vectors(spark, monkeypatch):
    monkeypatch.setattr(lloyd, "BLOCK_BITS", 2)
    draw = random.Random(3)
    # few values, so that ties, repeated vectors and unused entries occur
    rows = [(n // 2, [draw.choice([-0.25, 0.0, 0.5]) for _ in range(8)], draw.choice([None, 1, 2])) for n in range(60)]
    bad = [(900, None, 1), (901, [], 1), (902, [0.1] * 7 + [None], 1), (903, [float("nan")] * 8, 1), (904, [float("inf")] * 8, 1), (905, [0.1] * 6, 1)]
    vectors = spark.createDataFrame(rows + bad, VECTORS).withColumn("code", F.lit("clash")).withColumn("row", F.lit("clash"))
    for parts, entries, rounds in ((4, 5, 3), (2, 16, 6), (8, 100, 2)):
        got = lloyd.compress(vectors, parts, entries, rounds)
        first = sorted(rows, key=lambda r: (r[0], r[1]))
        check_codes(got.report().collect(), [r[:2] for r in first], [r[2] for r in first], parts=parts, entries=entries, rounds=rounds)
    near = {r.vec_id: r.vector for r in got.decoded().collect()}
    assert all(abs(a - b) < 1 for r in rows for a, b in zip(r[1], near[r[0]]))
    assert lloyd.compress(vectors.limit(0)).report().count() == 0
    unknown = lloyd.compress(spark.createDataFrame([(None, [1.0, 1e300], 1), (None, [1.0, 2.0], None)], VECTORS), 2).report().collect()
    assert [r.vec_id for r in unknown] == [None, None] and [r.error for r in unknown] == [0, 0]
    with pytest.raises(ValueError):
        lloyd.compress(vectors, 3)


def test_active_entries_agree_with_full_scans():
    draw = np.random.default_rng(2)
    skipped = 0
    for _ in range(200):
        vectors, book = draw.integers(-3, 4, (40, 2)), draw.integers(-3, 4, (6, 2))
        index, distance = lloyd.nearest(vectors, book)
        moved = draw.random(6) < 0.3
        book = np.where(moved[:, None], draw.integers(-3, 4, (6, 2)), book)
        got = lloyd.reassign(vectors, book, moved, index, distance)
        want = lloyd.nearest(vectors, book)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
        skipped += len(vectors) - got[2]
    assert skipped > 4000


def audit_by_brute_force(rows, quality, toxic):
    least = {}
    for i, _, text in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    docs = []
    for i, source, text in rows:
        t, words = text or "", words_of(text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t)}
        fails |= {"D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        docs.append((source or "", fails, i in quality, i in toxic))
    out, shares = [], {}
    for part in {d[0] for d in docs}:
        for order in permutations("ABCDE"):
            here = [d for d in docs if d[0] == part]
            for step, f in enumerate(order, 1):
                lost = [d for d in here if d[1][f]]
                failing = sum(d[0] == part and d[1][f] for d in docs)
                alone = sum(d[0] == part and d[1][f] and sum(d[1].values()) == 1 for d in docs)
                here = [d for d in here if not d[1][f]]
                shares[part, f] = shares.get((part, f), 0) + len(lost)
                out.append([part, "".join(order), step, len(here), len(lost), failing - len(lost), alone, sum(d[2] for d in lost), sum(d[3] for d in lost)])
    return sorted((*r, shares[r[0], r[1][r[2] - 1]]) for r in out)


def test_audit_of_awkward_documents(spark):
    draw = random.Random(4)
    texts = [None, "", "UPPER CASE # text", "word " * 250, " ".join(f"w{n}" for n in range(220)), "plain\x0btext | AB", "\xa0Ä" * 300, "x" * 100_000]
    rows = [(draw.choice([None, *range(40)]), draw.choice([None, "", "a", "b"]), draw.choice(texts)) for _ in range(150)]
    labels = [(1, 1, 0), (1, 0, 1), (2, 1, None), (None, 1, 1), (3, 0, 1), (99, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("digest", F.lit(0)).withColumn("A", F.lit("clash"))
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(map(tuple, audit.audit_documents(docs, known).collect()))
    assert got == audit_by_brute_force(rows, {1, 2}, {1, 3})
    assert audit.audit_documents(docs.limit(0), known).count() == 0
    assert audit.audit_documents(docs, known.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_audit_agrees_with_sql(spark):
    df = QUERIES["op13_filter_audit"](spark, FOLDER)
    assert compare(df, ORACLES["op13_filter_audit"], connect(FOLDER)) is None


def test_ranges_of_one_part_add_up(spark):
    rows = spark.range(500).select(F.lit("p").alias("part"), F.col("id").alias("row"), (F.col("id") % 2 == 0).alias("X"), (F.col("id") % 3 == 0).alias("Y"), (F.col("id") < 9).alias("t"))
    once, many = (sorted(map(tuple, audit.interactions(audit.postings(rows, "XY", ["t"], bits), "XY", ["t"]).collect())) for bits in (20, 4))
    assert once == many == [("p", "XY", 1, 250, 250, 0, 166, 5, 416), ("p", "XY", 2, 167, 83, 84, 83, 1, 250), ("p", "YX", 1, 333, 167, 0, 83, 3, 250), ("p", "YX", 2, 167, 166, 84, 166, 3, 416)]


def test_galloping_merges():
    draw = random.Random(6)
    for _ in range(300):
        lists = [sorted(draw.sample(range(60), draw.randrange(40))) for _ in range(draw.randrange(1, 5))]
        a, b = set(lists[0]), set(lists[-1])
        assert audit.union(lists) == sorted(set().union(*lists))
        assert audit.difference(lists[0], lists[-1]) == sorted(a - b)
        assert audit.common(lists[0], lists[-1]) == len(a & b)
