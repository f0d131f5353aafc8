"""Vector codes by product quantisation, trained by Lloyd's rounds over active entries.

Vectors of integers are cut into equal parts, and every part position has a
codebook of its own.  The vectors are written once, in blocks of consecutive
rows that are also the buckets of the table.  Each part keeps the entry that it
is assigned to and its exact squared distance; this state, a few bytes a part, is
written anew each round in the same buckets, so a round joins both without
moving a vector.

In a round, a part whose entry did not move keeps its distance and compares only
the entries that moved: all others are as far away as before, and none of them was
nearer.  A part whose entry moved rescans its codebook.  Ties go to the
lower index in both.  Each block adds its sums by entry to the state; only their
total, as large as the codebooks, reaches the driver.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hemline.llm.common import bucketed

#: Integer components are held within these limits, so that squared distances are exact in 64 bits.
LIMIT = 2**27
#: Rows of a block, as a power of two, and numbers that are compared at once.
BLOCK_BITS, CELLS = 13, 4_000_000


def nearest(vectors: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry, the lower index of equal ones."""
    index, distance = np.zeros(len(vectors), np.int64), np.zeros(len(vectors), np.int64)
    step = max(1, CELLS // max(book.size, 1))
    for at in range(0, len(vectors), step):
        squares = ((vectors[at : at + step, None, :] - book[None]) ** 2).sum(axis=2)
        index[at : at + step] = squares.argmin(axis=1)
        distance[at : at + step] = squares.min(axis=1)
    return index, distance


def reassign(vectors: np.ndarray, book: np.ndarray, moved: np.ndarray, index: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest entries after the ``moved`` ones changed, and how many parts were rescanned.

    ``index`` and ``distance`` hold what was nearest before.
    """
    index, distance = index.copy(), distance.copy()
    rescanned = np.flatnonzero(moved[index])
    active = np.flatnonzero(moved)
    stays = np.flatnonzero(~moved[index])
    if len(active) and len(stays):
        near, squares = nearest(vectors[stays], book[active])
        near = active[near]
        better = (squares < distance[stays]) | ((squares == distance[stays]) & (near < index[stays]))
        index[stays[better]], distance[stays[better]] = near[better], squares[better]
    if len(rescanned):
        index[rescanned], distance[rescanned] = nearest(vectors[rescanned], book)
    return index, distance, len(rescanned)


def _state_type(label: T.DataType) -> T.StructType:
    """A row is a vector's state, or (entry not null) a block's sums of an entry, its count behind them."""
    fields = [("block", T.LongType()), ("row", T.LongType()), ("vec_id", T.LongType()), ("label", label), ("code", T.BinaryType())]
    fields += [("distances", T.ArrayType(T.LongType())), ("part", T.IntegerType()), ("entry", T.IntegerType()), ("sums", T.ArrayType(T.LongType()))]
    return T.StructType([T.StructField(*f) for f in fields])


def _assign(books: np.ndarray, moved: np.ndarray, names: list[str]):
    parts, entries, width = books.shape

    def run(vectors: pa.Table, state: pa.Table) -> pa.Table:
        n = vectors.num_rows
        vectors, state = (t.sort_by("row").combine_chunks() for t in (vectors, state))
        flat = vectors.column("ints").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        cut = flat.astype(np.int64).reshape(n, parts, width)
        known = state.num_rows > 0
        if known:
            codes = np.frombuffer(b"".join(state.column("code").to_pylist()), np.uint8).reshape(n, parts).astype(np.int64)
            squares = state.column("distances").combine_chunks().flatten().to_numpy().reshape(n, parts).copy()
        else:
            codes, squares = np.zeros((n, parts), np.int64), np.zeros((n, parts), np.int64)
        sums = np.zeros((parts, entries, width + 1), np.int64)
        for p in range(parts):
            if known:
                codes[:, p], squares[:, p], _ = reassign(cut[:, p], books[p], moved[p], codes[:, p], squares[:, p])
            else:
                codes[:, p], squares[:, p] = nearest(cut[:, p], books[p])
            np.add.at(sums[p], (codes[:, p], slice(None, width)), cut[:, p])
            sums[p, :, width] = np.bincount(codes[:, p], minlength=entries)
        # entries that nothing is assigned to have no sums
        part, entry = np.nonzero(sums[:, :, width])
        m, block = len(part), vectors.column("block")[0].as_py()
        no_state, no_sums = pa.nulls(m, pa.int64()), pa.nulls(n, pa.int32())
        lists = lambda values, size: pa.ListArray.from_arrays(np.arange(len(values) + 1, dtype=np.int32) * size, values.ravel())
        label = vectors.column("label").combine_chunks()
        label = label if isinstance(label, pa.Array) else pa.concat_arrays(label.chunks)
        code = pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary())
        columns = [
            pa.array(np.full(n + m, block)),
            pa.chunked_array([*vectors.column("row").chunks, no_state], pa.int64()),
            pa.chunked_array([*vectors.column("vec_id").chunks, no_state], pa.int64()),
            pa.chunked_array([label, pa.nulls(m, label.type)]),
            pa.chunked_array([code, pa.nulls(m, pa.binary())]),
            pa.chunked_array([lists(squares, parts), pa.nulls(m, pa.list_(pa.int64()))]),
            pa.chunked_array([no_sums, pa.array(part, pa.int32())]),
            pa.chunked_array([no_sums, pa.array(entry, pa.int32())]),
            pa.chunked_array([pa.nulls(n, pa.list_(pa.int64())), lists(sums[part, entry], width + 1)]),
        ]
        return pa.table(dict(zip(names, columns)))

    return run


def _ints(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))).cast("int"))


@dataclass
class Codes:
    """``rows`` (vec_id, label, code, distances) and ``books`` (part, entry, position) of integers; ``scale`` made them."""

    rows: DataFrame
    books: np.ndarray
    scale: int

    def digest(self) -> str:
        """Lowercase sha256 of the decimal components by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()

    def report(self) -> DataFrame:
        """vec_id, code in lowercase hex, error, label_error and the digest of the codebooks."""
        total = F.aggregate("distances", F.lit(0).cast("long"), lambda a, x: a + x)
        rows = self.rows.select("vec_id", F.lower(F.hex("code")).alias("code"), total.alias("error"), "label")
        by_label = rows.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
        both = rows.join(by_label, F.col("label").eqNullSafe(F.col("__label")))
        return both.select("vec_id", "code", "error", "label_error", F.lit(self.digest()).alias("codebooks_sha256"))

    def decoded(self) -> DataFrame:
        """vec_id and the vector that its code stands for: the middle of each integer's range."""
        books, scale = self.books, self.scale

        def run(batches):
            for batch in batches:
                codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, len(books))
                values = (books[np.arange(len(books)), codes].reshape(batch.num_rows, -1) + 0.5) / scale
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(list(values), pa.list_(pa.float64()))], ["vec_id", "vector"])

        return self.rows.select("vec_id", "code").mapInArrow(run, "vec_id long, vector array<double>")


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> Codes:
    """Codes of all ``vectors`` (vec_id, embedding, label), and the codebooks that they refer to.

    A codebook starts with that part of the vectors of the smallest ids (known
    ids first; of equal ids, the smaller integers), fewer than ``entries`` if
    there are fewer vectors.  Null or empty vectors and those with a null or
    non-finite component take no part, nor do vectors of another length than
    the first of these; a length that the parts do not divide is an error.
    Repeated rows and ids and null ids and labels are kept as they are, and an
    empty table gives no rows.  Components beyond 2^27 in size count as 2^27.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    spark = vectors.sparkSession
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").where((F.size("embedding") > 0) & F.coalesce(finite, F.lit(False)))
    rows = good.select("vec_id", "label", _ints(F.col("embedding"), scale).alias("ints"))
    order = [F.asc_nulls_last("vec_id"), "ints"]
    first = rows.orderBy(*order).limit(1).collect()
    length = len(first[0]["ints"]) if first else 0
    if length % parts:
        raise ValueError(f"{parts} equal parts of {length} components")
    width, rows = length // parts, rows.where(F.size("ints") == length)
    seeds = [r["ints"] for r in rows.select("vec_id", "ints").orderBy(*order).limit(entries).collect()]
    books = np.array(seeds, np.int64).reshape(len(seeds), parts, width).transpose(1, 0, 2)
    shape = _state_type(vectors.schema["label"].dataType)
    state = spark.createDataFrame([], shape)
    if not seeds:
        return Codes(state.select("vec_id", "label", "code", "distances"), books, scale)
    buckets = -(-rows.count() // 2**BLOCK_BITS)
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    table = bucketed(numbered.withColumn("block", F.shiftright("row", BLOCK_BITS)), buckets, "block")
    moved = np.ones(books.shape[:2], bool)
    for left in range(rounds, -1, -1):
        before = state.where("entry IS NULL").select("block", "row", "code", "distances")
        step = _assign(books, moved, shape.names)
        state = bucketed(table.groupBy("block").cogroup(before.groupBy("block")).applyInArrow(step, shape), buckets, "block")
        if not left:
            break
        summed = state.where("entry IS NOT NULL").select("part", "entry", F.posexplode("sums").alias("place", "value"))
        new = books.copy()
        totals = np.zeros((*books.shape[:2], width + 1), object)
        for part, entry, place, value in summed.groupBy("part", "entry", "place").agg(F.sum("value")).collect():
            totals[part, entry, place] = value
        for part, entry in zip(*np.nonzero(totals[:, :, width])):
            new[part, entry] = [s // totals[part, entry, width] for s in totals[part, entry, :width]]
        moved, books = (new != books).any(axis=2), new
        if not moved.any():
            break
    return Codes(state.where("entry IS NULL").select("vec_id", "label", "code", "distances"), books, scale)
