"""Order MinHash fingerprints, which follow the edit distance of texts.

A text's k-mers (runs of ``K`` code points) are numbered by occurrence, so that
repeats count.  Each component of the signature takes the ``TUPLE`` smallest
numbered k-mers under its permutation, puts them back into text order, and
hashes the tuple: texts share a component only if they share these k-mers in
the same order.  The permutations are rotations of one circle of hashes: a
component starts at its own point and takes the next hashes clockwise, so one
sort serves all components.

The next document comes from an ordered pass: ids are dealt into ranges by
sketched quantiles, and each range gets the first row of the next one as a
trailer, so that no range needs another one's rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemline.llm.common import mix, partitions

#: Code points of a k-mer, k-mers of a component, components of a fingerprint.
K, TUPLE, COMPONENTS = 8, 2, 64
_BITS = 64 - COMPONENTS.bit_length() + 1
_STARTS = np.arange(COMPONENTS, dtype=np.uint64) << np.uint64(_BITS)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def _numbered(points: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k-mer together with its occurrence number; a short text is one k-mer."""
    if not len(points):
        return points
    k = min(k, len(points))
    n = len(points) - k + 1
    key = np.zeros(n, np.uint64)
    for j in range(k):
        key = key * np.uint64(0x9E3779B97F4A7C15) + points[j : j + n]
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    fresh = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    nth = np.empty(n, np.uint64)
    # equal k-mers stand in text order after the stable sort
    nth[order] = np.arange(n) - np.repeat(fresh, np.diff(np.append(fresh, n)))
    return mix(key + nth * np.uint64(0xD1B54A32D192ED03))


def _circle(hashes: np.ndarray) -> np.ndarray:
    """Positions of the hashes that some component can take, by hash.

    Each component needs only the first few hashes after its start.  So hashes
    far from any start are left out, and all are taken if some arc is then short.
    """
    n, few = len(hashes), 16 * COMPONENTS
    if n > 2 * few:
        near = hashes & np.uint64(2**_BITS - 1)
        kept = np.flatnonzero(near < np.uint64(int(2**_BITS * few / n)))
        arcs = np.bincount((hashes[kept] >> np.uint64(_BITS)).astype(np.int64), minlength=COMPONENTS)
        if arcs.min() >= TUPLE:
            return kept[np.argsort(hashes[kept], kind="stable")]
    return np.argsort(hashes, kind="stable")


def signature(text: str) -> np.ndarray:
    """One 32-bit hash for each component; zeros for an empty text."""
    hashes = _numbered(_points(text), K)
    if not len(hashes):
        return np.zeros(COMPONENTS, np.uint32)
    order = _circle(hashes)
    first = np.searchsorted(hashes[order], _STARTS)
    taken = order[(first[:, None] + np.arange(min(TUPLE, len(order)))[None, :]) % len(order)]
    taken.sort(axis=1)
    out = np.zeros(COMPONENTS, np.uint64)
    for column in hashes[taken].T:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return (out >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal components."""
    return float((a == b).mean())


def _hexed(s: np.ndarray) -> str:
    return s.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last half replaced by as many code points of the following text, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of range and id; a trailer ends each range and is not reported."""
    before = None

    def told(key: int | None, text: str, own: np.ndarray, following: str, its: np.ndarray) -> tuple:
        changed = edited(text, following)
        own_changed = own if changed == text else signature(changed)
        digest = hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest()
        return key, len(text), digest, _hexed(own), _hexed(own_changed), likeness(own, own_changed), likeness(own, its)

    for batch in batches:
        out = []
        for place, key, trailer, text in zip(*[batch.column(c).to_pylist() for c in ("range", "doc_id", "trailer", "text")]):
            text = text or ""
            own = signature(text)
            if before and before[0] == place:
                out.append(told(before[1], before[2], before[3], text, own))
            before = None if trailer else (place, key, text, own)
        cols = list(zip(*out)) or [[]] * 7
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        names = [f.split()[0] for f in _OUT.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)


def _range_of(key: Column, bounds: list[int]) -> Column:
    """Number of bounds up to the key; a null key comes before all."""
    array = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    if not bounds:
        return F.lit(0)
    return F.when(key.isNull(), 0).otherwise(F.size(F.filter(array, lambda b: b <= key)))


def report(docs: DataFrame, per_task: int = 8) -> DataFrame:
    """Fingerprints of every document and of its edited text, and likeness to both neighbours.

    Null texts count as empty and have a fingerprint of zeros.  Equal ids are
    ordered by a hash of their text, so the next document of a repeated row is its
    copy; null ids come first.  A single document is its own next one, an
    empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = partitions(rows.sparkSession) * per_task
    found = rows.where("doc_id IS NOT NULL").approxQuantile("doc_id", [i / cuts for i in range(1, cuts)], 1 / (4 * cuts))
    bounds = sorted({int(b) for b in found})
    tie = F.xxhash64("text")
    ranged = rows.withColumns({"range": _range_of(F.col("doc_id"), bounds), "trailer": F.lit(False)})
    # one short row for each range: its first id, and the first text hash of that id
    keys = ranged.select("range", F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id"), tie.alias("tie")).alias("first"))
    firsts = sorted((r[0], r[1]) for r in keys.groupBy("range").agg(F.min("first")).collect())
    if not firsts:
        return rows.sparkSession.createDataFrame([], _OUT)
    # the first row of each range ends the range before, and that of the first range the last
    heads = [(f["doc_id"], f["tie"], firsts[i - 1][0]) for i, (_, f) in enumerate(firsts)]
    heads = F.broadcast(rows.sparkSession.createDataFrame(heads, "head long, head_tie long, range int"))
    meets = F.col("doc_id").eqNullSafe(F.col("head")) & (tie == F.col("head_tie"))
    trailers = rows.join(heads, meets).select("doc_id", "text", "range", F.lit(True).alias("trailer"))
    both = ranged.unionByName(trailers.dropDuplicates(["doc_id", "range"]))
    order = ["range", "trailer", F.col("doc_id").asc_nulls_first(), tie]
    dealt = both.repartition(partitions(rows.sparkSession), "range").sortWithinPartitions(*order)
    return dealt.select("range", "doc_id", "trailer", "text").mapInArrow(_walk, _OUT)
