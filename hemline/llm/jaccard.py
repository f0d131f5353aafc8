"""Jaccard self-join on word n-grams by MinHash banding, verified on full sets.

Texts with the same n-gram set are one set with a number of copies.  Bands of
MinHash values meet in buckets; rows per band and bands are chosen so that a
pair at the threshold shares a bucket with the target recall.  Buckets with the
same members are treated once.  A large bucket is cut into blocks, and a task
compares one pair of blocks on the full sets by one matrix product.  It counts
a pair only in the first band that the two share, so nothing is counted twice,
and returns one row per set: its links and its root in the block.  No pair is
written out.  Connected components of the roots give the classes.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemline.llm.common import mix
from hemline.session import materialize

#: Words of an n-gram, least similarity, rows of a band, share of pairs at the threshold that must meet.
WORDS, THRESHOLD, ROWS, RECALL = 5, Fraction(4, 5), 4, 0.99999
#: Sets of a block; members of small buckets that are compared in one group.
BLOCK, TOGETHER = 512, 2000
#: Bytes of n-grams of a block, and of the small buckets of a group.
BYTES = 32_000_000
_WORD = re.compile(r"\w+")
_CELLS = 8_000_000


def bands_for(threshold: Fraction = THRESHOLD, rows: int = ROWS, recall: float = RECALL) -> int:
    """Least number of bands by which a pair at the threshold meets with the wanted probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - float(threshold) ** rows))


class _Hashes(dict):
    """Hash of each word, computed once."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        raw = word.encode("utf-8", "replace")
        value = self[word] = (zlib.crc32(raw) << 32) | zlib.adler32(raw)
        return value


def grams(text: str, hashes: _Hashes, n: int = WORDS) -> np.ndarray:
    """The set of a text's word n-grams as sorted 32-bit hashes; fewer words than n are one n-gram."""
    found = _WORD.findall(text.lower())
    if not found:
        return np.empty(0, np.uint32)
    each = mix(np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found)))
    n = min(n, len(found))
    total = np.zeros(len(found) - n + 1, np.uint64)
    for j in range(n):
        total = total * np.uint64(0x9E3779B97F4A7C15) + each[j : j + len(total)]
    return np.unique((mix(total) >> np.uint64(32)).astype(np.uint32))


class Sketcher:
    """MinHash bands of n-gram sets."""

    def __init__(self, bands: int, rows: int = ROWS, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.shape = (bands, rows)
        self.factor = rng.integers(1, 2**63, bands * rows, dtype=np.uint64)[:, None] | np.uint64(1)
        self.shift = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)[:, None]

    def __call__(self, found: np.ndarray) -> np.ndarray:
        least = np.full(len(self.factor), 2**64 - 1, np.uint64)
        spread = mix(found.astype(np.uint64) + np.uint64(1))
        for i in range(0, len(spread), 20_000):
            part = spread[None, i : i + 20_000] * self.factor + self.shift
            least = np.minimum(least, part.min(axis=1))
        out = np.zeros(self.shape[0], np.uint64)
        for column in least.reshape(self.shape).T:
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + column)
        return out.view(np.int64)


_SKETCH = "doc_id long, h1 long, h2 long, key binary, bands array<long>, grams binary"


def _sketch(bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sketcher = _Hashes(), Sketcher(bands)
        for batch in batches:
            keys, banded, sets = [], [], []
            for text in batch.column("text").to_pylist():
                found = grams(text or "", hashes)
                raw = found.tobytes()
                keys.append(hashlib.md5(raw if raw else b"text" + (text or "").encode("utf-8", "replace")).digest())
                banded.append(sketcher(found) if raw else None)
                sets.append(raw)
            own = [batch.column(c) for c in ("doc_id", "h1", "h2")]
            more = [pa.array(keys, pa.binary()), pa.array(banded, pa.list_(pa.int64())), pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays([*own, *more], ["doc_id", "h1", "h2", "key", "bands", "grams"])

    return run


def _similar(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: Fraction) -> np.ndarray:
    """Which pairs of left and right sets reach the threshold, by exact integer arithmetic."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    # an n-gram of one set alone is in no intersection
    shared = times[column] > 1
    column, owner = column[shared], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    column = np.cumsum(np.diff(column, prepend=column[:1]) > 0) if len(column) else column
    common = np.zeros((len(left), len(right)), np.float64)
    columns = int(column[-1]) + 1 if len(column) else 0
    wide = min(max(1, _CELLS // max(len(sets), 1)), max(columns, 1))
    for begin in range(0, columns, wide):
        a, b = np.searchsorted(column, [begin, begin + wide])
        part = np.zeros((len(sets), wide), np.float32)
        part[owner[a:b], column[a:b] - begin] = 1
        common += part[left] @ part[right].T
    common = common.astype(np.int64)
    union = sizes[left][:, None] + sizes[right][None, :] - common
    return (common * threshold.denominator >= union * threshold.numerator) & (common > 0)


_FOUND = "row long, links long, root long"


def _links(sets: list[np.ndarray], bands: np.ndarray, band: int, left: np.ndarray, right: np.ndarray, threshold: Fraction) -> tuple[np.ndarray, ...]:
    """Linked pairs of left and right sets, and which of them this band counts: those that share none before it."""
    similar = _similar(sets, left, right, threshold)
    if left is right:
        similar = np.triu(similar, 1)
    i, j = np.nonzero(similar)
    a, b = left[i], right[j]
    return a, b, ~(bands[a, :band] == bands[b, :band]).any(axis=1)


def _verify(threshold: Fraction):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("bucket").combine_chunks()
        bucket, row, copies, block, low, high, band = (group.column(c).to_numpy() for c in ("bucket", "row", "copies", "block", "low", "high", "band"))
        all_sets = [np.frombuffer(g, np.uint32) for g in group.column("grams").to_pylist()]
        all_bands = group.column("bands").chunk(0).flatten().to_numpy().reshape(len(row), -1)
        out = []
        starts = np.flatnonzero(np.diff(bucket, prepend=bucket[0] ^ 1))
        for begin, stop in zip(starts, [*starts[1:], len(row)]):
            here = slice(begin, stop)
            own, times, n = row[here], copies[here], stop - begin
            left = right = np.arange(n)
            if low[begin] != high[begin]:
                left, right = np.flatnonzero(block[here] == low[begin]), np.flatnonzero(block[here] == high[begin])
            if n < 2 or not len(left) or not len(right):
                continue
            a, b, counted = _links(all_sets[begin:stop], all_bands[here], int(band[begin]), left, right, threshold)
            if not len(a):
                continue
            links = np.bincount(a[counted], times[b[counted]], n) + np.bincount(b[counted], times[a[counted]], n)
            # least row that can be reached, over links in both directions
            root = own.copy()
            while True:
                before = root.copy()
                np.minimum.at(root, a, root[b])
                np.minimum.at(root, b, root[a])
                if (before == root).all():
                    break
            linked = np.unique(np.concatenate([a, b]))
            out.append((own[linked], links[linked].astype(np.int64), root[linked]))
        names = ("row", "links", "root")
        return pa.table(dict(zip(names, (np.concatenate(c) for c in zip(*out)) if out else [pa.array([], pa.int64())] * 3)))

    return run


def components(edges: DataFrame) -> DataFrame:
    """``row`` and ``root`` (the least row that can be reached) for all ends of ``edges`` (row, root).

    Every round takes the least root of the neighbours and then the root's root;
    each is written, so a lost executor costs one round.
    """
    both = materialize(edges.unionByName(edges.select(F.col("root").alias("row"), F.col("row").alias("root"))).where("row <> root").distinct())
    state = materialize(both.groupBy("row").agg(F.least(F.min("root"), F.col("row")).alias("root")))
    while True:
        theirs = state.select(F.col("row").alias("root"), F.col("root").alias("next"))
        near = both.join(theirs, "root").groupBy("row").agg(F.min("next").alias("near"))
        closer = state.join(near, "row").select("row", F.least("root", "near").alias("root"), F.col("root").alias("old"))
        # the roots are nodes themselves, so each has a root of its own
        jumped = closer.join(theirs, "root").select("row", F.least("root", "next").alias("root"), "old")
        after = materialize(jumped)
        changed = after.where("root <> old").count()
        state = after.select("row", "root")
        if not changed:
            return state


def classes(docs: DataFrame, threshold: Fraction = THRESHOLD, rows: int = ROWS, recall: float = RECALL, block: int = BLOCK, size: int = BYTES) -> DataFrame:
    """One row per document: doc_id, class_id, links, and whether the class keeps it (h1, h2: hashes of its text).

    Documents are linked if their sets' similarity reaches the threshold; a class
    is a connected component, named after its smallest known id (null if all
    are unknown).  ``links`` counts documents, copies included.  Texts of fewer
    words than an n-gram are compared as one n-gram; texts without words (null
    and empty ones alike) are linked to equal texts only.  Repeated rows
    are copies; an empty table gives no rows.
    """
    bands = bands_for(threshold, rows, recall)
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), text.alias("text"))
    drawn = keyed.mapInArrow(_sketch(bands), _SKETCH)
    drawn = materialize(drawn.withColumn("row", F.monotonically_increasing_id()))
    sets = materialize(drawn.groupBy("key").agg(F.min("row").alias("row"), F.count("*").alias("copies"), F.min("doc_id").alias("least")))
    banded = drawn.select("row", "bands", F.octet_length("grams").cast("long").alias("size")).where("bands IS NOT NULL").join(sets.select("row", "copies"), "row")
    exploded = banded.select("row", "copies", "size", F.posexplode("bands").alias("band", "value"))
    placed = materialize(exploded.select("row", "copies", "size", F.col("band").cast("int").alias("band"), F.xxhash64("band", "value").alias("bucket")))
    # the members' sum of hashes tells buckets with the same members, which are treated in their first band
    same = F.sum(F.xxhash64("row") % (2**31)).alias("same")
    buckets = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), same, F.min("row").alias("first"), F.min("band").alias("band")).where("n > 1")
    once = buckets.groupBy("n", "bytes", "same", "first").agg(F.min(F.struct("band", "bucket")).alias("b"))
    # a block is bounded in sets and in bytes
    blocks = F.least("n", F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("bytes") / size))).cast("int")
    once = materialize(once.select("n", "bytes", blocks.alias("blocks"), "b.band", "b.bucket"))
    small, small_bytes = once.where("blocks = 1").agg(F.sum("n"), F.sum("bytes")).first()
    together = max(1, (small or 0) // TOGETHER, (small_bytes or 0) // size)
    members = placed.select("row", "copies", "bucket").join(once, "bucket")
    cut = members.withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # small buckets are compared one after another in common groups
    group = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("bucket"), F.lit(together))).otherwise(F.col("bucket"))
    cut = cut.select("bucket", "band", group.alias("group"), F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "row", "copies")
    compared = cut.join(drawn.select("row", "bands", "grams"), "row").groupBy("group", "low", "high").applyInArrow(_verify(threshold), _FOUND)
    compared = materialize(compared)
    links = compared.groupBy("row").agg(F.sum("links").alias("links"))
    joined = components(compared.select("row", "root"))
    known = sets.join(joined, "row", "left").join(links, "row", "left")
    known = materialize(known.select("key", "copies", "least", F.coalesce("root", "row").alias("root"), F.coalesce("links", F.lit(0)).alias("links")))
    named = known.groupBy("root").agg(F.min("least").alias("class_id"))
    known = known.join(named, "root").select("key", "root", "class_id", (F.col("links") + F.col("copies") - 1).alias("links"))
    return drawn.select("doc_id", "h1", "h2", "key", "row").join(known, "key").select("doc_id", "class_id", "links", "h1", "h2", "root", "row")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, class_id and links of every document."""
    return classes(docs).select("doc_id", "class_id", "links")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class: that of the smallest known id, then of the first row.

    Among rows that repeat both id and text, one is kept.
    """
    text = F.coalesce("text", F.lit(""))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))
    chosen = classes(docs).groupBy("root").agg(F.min_by(F.struct("doc_id", "h1", "h2"), order).alias("c"))
    chosen = chosen.select(F.col("c.doc_id").alias("__id"), F.col("c.h1").alias("__c1"), F.col("c.h2").alias("__c2"))
    hashed = docs.withColumns({"__h1": F.xxhash64(text), "__h2": F.xxhash64(F.lit(1), text)}).dropDuplicates(["doc_id", "__h1", "__h2"])
    meets = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__h1") == F.col("__c1")) & (F.col("__h2") == F.col("__c2"))
    return hashed.join(chosen, meets, "left_semi").drop("__h1", "__h2")
