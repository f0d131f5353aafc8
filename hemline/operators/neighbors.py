"""Exact nearest neighbours among training rows, and what is derived from them.

Both sides are written once as blocks of bounded size, by the tasks that read them.
A task keeps a few blocks of queries, lets the blocks of training rows pass, finds the
nearest rows of each with a matrix product, and emits k rows per query; a final aggregate
keeps the k best.  Vectors are read from the blocks and never shuffled, and no pair table
and no distance matrix exists at any point.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from hemline.functions import vectors as V
from hemline.operators.ordering import OrderKey, global_index
from hemline.session import materialize

METRICS = ("euclidean", "cosine", "cosine_similarity_asc")
# Most rows per block, and most numbers in their vectors: a pair of blocks is one row on its way to a task.
BLOCK_ROWS = 65_536
BLOCK_NUMBERS = 1 << 20
# Numbers in the vectors that a task orders before it cuts them into blocks.
RUN_NUMBERS = 1 << 23
# Smaller blocks leave more to prune; most pivots, whose distances from each other every task gets.
PRUNED_BLOCK_ROWS = 2_048
MOST_PIVOTS = 1_024
# Fewest query rows worth a block of their own.
_LEAST_QUERIES = 128
# Bounds of the working arrays: queries and training rows per product, numbers per exact pass.
_QUERY_CHUNK = 256
_TRAIN_CHUNK = 8_192
_EXACT_NUMBERS = 4_000_000
# Fewest pairs that are worth single precision, and how many times k rows of a chunk it may leave a query to measure.
_SINGLE_PAIRS = 1 << 16
_MOST_ROUGH = 32


def pair_distance(
    pairs: DataFrame,
    queries: DataFrame,
    train: DataFrame,
    metric: str = "euclidean",
    id_col: str = "id",
    vec_col: str = "vec",
) -> DataFrame:
    """Distance of the listed pairs (qid, tid); a row to itself is infinite."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    q = queries.select(F.col(id_col).alias("qid"), F.col(vec_col).cast(V.VECTOR).alias("__q"))
    t = train.select(F.col(id_col).alias("tid"), F.col(vec_col).cast(V.VECTOR).alias("__t"))
    if metric == "euclidean":
        d = V.euclidean("__q", "__t")
    else:
        sim = V.cosine_similarity("__q", "__t")
        d = 1 - sim if metric == "cosine" else sim
    d = F.when(F.col("qid") == F.col("tid"), F.lit(float("inf"))).otherwise(d)
    return pairs.join(q, "qid").join(t, "tid").select("qid", "tid", d.alias("d"))


def _exact(q: np.ndarray, t: np.ndarray, metric: str) -> np.ndarray:
    """Distance of row i of ``q`` to row i of ``t``."""
    if metric == "euclidean":
        return np.sqrt(np.square(q - t).sum(axis=1))
    sim = (q * t).sum(axis=1) / np.sqrt(np.square(q).sum(axis=1) * np.square(t).sum(axis=1))
    return 1 - sim if metric == "cosine" else sim


def _block_top_k(q, t, excluded, rank, k, metric):
    """(query row, train row, distance) of each query's k nearest in the block.

    A matrix product ranks roughly; every row within rounding of the k-th is
    then measured exactly, so ties are decided by ``rank`` and not by noise.
    """
    if metric == "euclidean":
        qq, tt = np.square(q).sum(axis=1), np.square(t).sum(axis=1)
        rough = qq[:, None] + tt[None, :] - 2.0 * (q @ t.T)
        slack = 1e-11 * (qq + tt.max() + 1.0)
    else:
        unit_q = q / np.linalg.norm(q, axis=1, keepdims=True)
        unit_t = t / np.linalg.norm(t, axis=1, keepdims=True)
        rough = unit_q @ unit_t.T
        if metric == "cosine":
            rough = 1.0 - rough
        slack = np.full(len(q), 1e-11)
    rough[excluded] = np.inf
    if len(t) > k:
        kth = np.partition(rough, k - 1, axis=1)[:, k - 1]
        near = rough <= (kth + slack)[:, None]
    else:
        near = np.ones_like(rough, dtype=bool)
    rows, cols = np.nonzero(near & np.isfinite(rough))
    d = np.empty(len(rows))
    step = max(1, _EXACT_NUMBERS // q.shape[1])
    for at in range(0, len(rows), step):
        part = slice(at, at + step)
        d[part] = _exact(q[rows[part]], t[cols[part]], metric)
    order = np.lexsort((rank[cols], d, rows))
    rows, cols, d = rows[order], cols[order], d[order]
    starts = np.searchsorted(rows, rows, side="left")
    best = np.arange(len(rows)) - starts < k
    return rows[best], cols[best], d[best]


def _same_id(q_id: np.ndarray, t_id: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query row, train row) of equal ids, by query row."""
    order = np.argsort(t_id, kind="stable")
    by_id = t_id[order]
    low, high = np.searchsorted(by_id, q_id, side="left"), np.searchsorted(by_id, q_id, side="right")
    n = np.where(q_id == q_id, high - low, 0)
    at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return np.repeat(np.arange(len(q_id)), n), order[at]


def _ways(q, t, metric):
    """Factors whose product ranks the pairs, what a query adds to it to make it a (squared) distance, and its rounding."""
    if metric == "euclidean":
        qq, tt = np.square(q).sum(axis=1), np.square(t).sum(axis=1)
        return np.column_stack([-2.0 * q, np.ones(len(q))]), np.column_stack([t, tt]), qq, 1e-11 * (qq + tt.max() + 1.0)
    unit_q, unit_t = q / np.linalg.norm(q, axis=1, keepdims=True), t / np.linalg.norm(t, axis=1, keepdims=True)
    add, slack = np.full(len(q), 1.0 if metric == "cosine" else 0.0), np.full(len(q), 1e-11)
    return -unit_q if metric == "cosine" else unit_q, unit_t, add, slack


def _single(q_way, t_way, add, metric):
    """Rounding of the product in single precision, or None where it could overflow or vanish."""
    steps = 2.5 * (q_way.shape[1] + 8) * 2.0**-24
    if metric != "euclidean":
        return np.full(len(q_way), steps)
    far = add + 2.0 * t_way[:, -1].max()
    return steps * far if far.max() < 1e30 and far.min() > 1e-25 else None


def _cell_top_k(q, t, q_id, t_id, q_grp, t_grp, rank, k, metric, far=None):
    """``_block_top_k`` of a large block without its own rows: training rows are passed in chunks, and
    after the first one only those within the k-th distance so far are measured.  ``far`` is each query's
    k-th distance in other blocks; rows beyond it may be missing.  Large blocks are ranked in single precision,
    with its rounding, as long as that leaves few rows to measure."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if not (k > 0 and len(q) and len(t)):
        return none
    own_rows, own_cols = _same_id(q_id, t_id)
    unit = metric != "euclidean"
    q_way, t_way, add, slack = _ways(q, t, metric)
    rough_slack = _single(q_way, t_way, add, metric) if len(q) * len(t) >= _SINGLE_PAIRS else None
    if rough_slack is not None:
        q_rough, t_rough = q_way.astype(np.float32), t_way.astype(np.float32)

    def near(at, low, bound, single):
        """Pairs of a chunk that may be within the bound or the k-th of the chunk."""
        here, there = slice(at, at + _QUERY_CHUNK), slice(low, low + _TRAIN_CHUNK)
        rough = (q_rough if single else q_way)[here] @ (t_rough if single else t_way)[there].T
        begin, end = np.searchsorted(own_rows, [at, at + len(rough)])
        own_r, own_c = own_rows[begin:end] - at, own_cols[begin:end] - low
        inside = (own_c >= 0) & (own_c < rough.shape[1])
        rough[own_r[inside], own_c[inside]] = np.inf
        if q_grp is not None:
            rough[q_grp[here, None] == t_grp[None, there]] = np.inf
        reach = bound - add[here]
        if rough.shape[1] > k and np.isinf(bound).any():
            reach = np.minimum(reach, np.partition(rough, k - 1, axis=1)[:, k - 1])
        reach = reach + (rough_slack if single else slack)[here]
        if single:
            reach = np.nextafter(reach.astype(np.float32), np.float32(np.inf))
        rows, cols = np.divmod(np.flatnonzero(rough <= reach[:, None]), rough.shape[1])
        finite = np.isfinite(rough[rows, cols])
        return rows[finite], cols[finite] + low

    found = []
    for at in range(0, len(q), _QUERY_CHUNK):
        part = q[at : at + _QUERY_CHUNK]
        bound = np.full(len(part), np.inf)
        if far is not None:
            bound = far[at : at + _QUERY_CHUNK].copy() if unit else np.square(far[at : at + _QUERY_CHUNK])
        rows, cols, d = none
        for low in range(0, len(t), _TRAIN_CHUNK):
            new_r, new_c = near(at, low, bound, rough_slack is not None)
            if rough_slack is not None and len(new_r) > _MOST_ROUGH * k * len(part):
                rough_slack = None
                new_r, new_c = near(at, low, bound, False)
            if not len(new_r):
                continue
            new_d = np.empty(len(new_r))
            step = max(1, _EXACT_NUMBERS // q.shape[1])
            for i in range(0, len(new_r), step):
                cut = slice(i, i + step)
                new_d[cut] = _exact(part[new_r[cut]], t[new_c[cut]], metric)
            rows, cols, d = np.concatenate([rows, new_r]), np.concatenate([cols, new_c]), np.concatenate([d, new_d])
            order = np.lexsort((rank[cols], d, rows))
            rows, cols, d = rows[order], cols[order], d[order]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
            last = place == k - 1
            bound[rows[last]] = np.minimum(bound[rows[last]], d[last] if unit else np.square(d[last]))
            rows, cols, d = rows[place < k], cols[place < k], d[place < k]
        found.append((rows + at, cols, d))
    return tuple(np.concatenate(x) for x in zip(*found))


def _without_copies(rows: pa.Table, k: int) -> pa.Table:
    """Rows without the copies that no query can be answered with.

    Equal vectors are equally far from everything and go by id, so only the
    first k + 1 of them (one may be the query itself) can be among the k nearest.
    """
    vec = rows["vec"].combine_chunks()
    bits = np.ascontiguousarray(vec.flatten().to_numpy(zero_copy_only=False)).reshape(len(vec), -1)
    bits = bits.view(np.uint64 if bits.itemsize == 8 else np.uint32)
    mixed = np.zeros(len(bits), np.uint64)
    for i in range(bits.shape[1]):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + bits[:, i]
    _, name, n = np.unique(mixed, return_inverse=True, return_counts=True)
    crowd = np.flatnonzero(n[name] > k + 1)
    if not len(crowd):
        return rows
    grp = rows["grp"].combine_chunks()
    grp = np.column_stack([grp.is_null().to_numpy(zero_copy_only=False), grp.fill_null(0).to_numpy()])
    whole = np.ascontiguousarray(np.column_stack([bits[crowd], grp[crowd].astype(np.int64).view(np.uint64)]).astype(np.uint64))
    _, same = np.unique(whole.view(np.dtype((np.void, whole.shape[1] * 8))).ravel(), return_inverse=True)
    order = np.lexsort((np.argsort(np.argsort(np.asarray(rows["id"].to_pandas())[crowd], kind="stable")), same.ravel()))
    by_copy = same.ravel()[order]
    late = np.arange(len(crowd)) - np.searchsorted(by_copy, by_copy) > k
    keep = np.ones(len(bits), bool)
    keep[crowd[order[late]]] = False
    return rows.filter(pa.array(keep))


@dataclass(frozen=True)
class Blocks:
    """Rows in blocks that are written once.

    ``table`` has one row per block: its number (``no``), the bytes of its vectors (``vec``), and every
    other column of its rows as a list of the same name.
    """

    table: DataFrame
    kinds: dict[str, T.DataType]

    @staticmethod
    def of(rows: DataFrame, block_rows: int, copies: int | None = None, by: str | None = None) -> Blocks:
        """``rows`` (id, grp, vec and others) in blocks; without the copies that none of the ``copies`` nearest can be.

        A task packs the rows it reads, a run at a time: ordered by the column ``by``, which is not kept, a block
        holds rows that lie close together.
        """
        kinds = {f.name: f.dataType for f in rows.schema if f.name != by}
        exact = isinstance(kinds["vec"].elementType, T.FloatType)
        number = np.float32 if exact else np.float64
        if not exact:
            rows = rows.withColumn("vec", F.col("vec").cast(V.VECTOR))
        lists = {c: kind if isinstance(kind, T.ArrayType) else T.ArrayType(kind) for c, kind in kinds.items() if c != "vec"}
        shape = T.StructType([T.StructField("no", T.LongType()), *[T.StructField(c, kind) for c, kind in lists.items()], T.StructField("vec", T.BinaryType())])
        types = [to_arrow_type(f.dataType) for f in shape]
        block_rows, run_numbers, block_numbers = max(1, block_rows), RUN_NUMBERS, BLOCK_NUMBERS

        def cut(run: list[pa.RecordBatch]) -> Iterator[list]:
            held = pa.Table.from_batches(run).combine_chunks()
            if copies is not None:
                held = _without_copies(held, copies)
            if by is not None:
                held = held.take(pa.array(np.argsort(held[by].to_numpy(), kind="stable")))
            size = len(held["vec"][0])
            step = max(1, min(block_rows, block_numbers // size))
            for at in range(0, held.num_rows, step):
                part = held.slice(at, step).combine_chunks()
                values = [part[c].combine_chunks() for c in lists]
                values = [v.flatten() if isinstance(kinds[c], T.ArrayType) else v for c, v in zip(lists, values)]
                vec = part["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(number).tobytes()
                yield [*[pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in values], pa.array([vec], pa.binary())]

        def pack(batches):
            no, run, n = TaskContext.get().partitionId() << 32, [], 0

            def blocks():
                nonlocal no
                for columns in cut(run):
                    columns = [c if c.type == t else c.cast(t) for c, t in zip([pa.array([no]), *columns], types)]
                    yield pa.RecordBatch.from_arrays(columns, shape.names)
                    no += 1

            for batch in batches:
                if not batch.num_rows:
                    continue
                run.append(batch)
                n += batch.num_rows
                if n * len(batch.column("vec")[0]) >= run_numbers:
                    yield from blocks()
                    run, n = [], 0
            if run:
                yield from blocks()

        # a file for each block: a task then reads as many as it is meant to
        table = materialize(rows.mapInArrow(pack, shape), maxRecordsPerFile=1, **{"parquet.enable.dictionary": "false"})
        return Blocks(table, kinds)

    def rows(self, *columns: str) -> DataFrame:
        """Columns other than the vectors, a row for each row."""
        return self.table.select(F.explode(F.arrays_zip(*columns)).alias("row")).select("row.*")

    def count(self) -> int:
        return self.table.agg(F.coalesce(F.sum(F.size("id")), F.lit(0))).first()[0]


class Block:
    """A block of one side in a task: its vectors as a matrix, other columns by name."""

    def __init__(self, batch: pa.RecordBatch, i: int, side: str, kinds: dict[str, T.DataType]):
        self._lists = {c: batch.column(f"{side}_{c}")[i].values for c in kinds if c != "vec"}
        self.ids = self._lists["id"]
        self.id = np.asarray(self.ids.to_pandas())
        single = isinstance(kinds["vec"].elementType, T.FloatType)
        vec = np.frombuffer(batch.column(f"{side}_vec")[i].as_buffer(), np.float32 if single else np.float64)
        self.vec = vec.reshape(len(self.ids), -1).astype(np.float64)

    def __len__(self) -> int:
        return len(self.ids)

    def __getitem__(self, name: str) -> np.ndarray:
        return self._lists[name].to_pandas().to_numpy()


class _Best:
    """The k best (distance, id) of every query in a block, over the blocks of training rows so far.

    With ``once``, a pair may be added again and counts once.
    """

    def __init__(self, ids: pa.Array, k: int, kind: pa.DataType, once: bool = False):
        self.ids, self.k, self.once = ids, k, once
        self.rows, self.d, self.found = np.zeros(0, np.int64), np.zeros(0), pa.array([], kind)
        #: distance of the k-th
        self.far = np.full(len(ids), np.inf)
        #: what a search keeps with a block of queries
        self.kept: dict = {}

    def add(self, rows: np.ndarray, d: np.ndarray, found: pa.Array) -> None:
        if not len(rows):
            return
        touched = np.zeros(len(self.ids), bool)
        touched[rows] = True
        old = touched[self.rows]
        rows, d = np.concatenate([self.rows[old], rows]), np.concatenate([self.d[old], d])
        found = pa.concat_arrays([self.found.filter(pa.array(old)), found])
        rank = np.unique(np.asarray(found.to_pandas()), return_inverse=True)[1]
        order = np.lexsort((rank, d, rows))
        if self.once:
            by_row, by_id = rows[order], rank[order]
            order = order[np.append(True, (np.diff(by_row) != 0) | (np.diff(by_id) != 0))]
        place = np.arange(len(order)) - np.searchsorted(rows[order], rows[order], side="left")
        order, last = order[place < self.k], order[place == self.k - 1]
        self.far[rows[last]] = d[last]
        self.rows, self.d = np.concatenate([self.rows[~old], rows[order]]), np.concatenate([self.d[~old], d[order]])
        self.found = pa.concat_arrays([self.found.filter(pa.array(~old)), found.take(pa.array(order))])

    def batch(self, names: list[str]) -> pa.RecordBatch:
        # A query without any candidate still returns, with an empty row.
        alone = np.setdiff1d(np.arange(len(self.ids)), self.rows)
        qid = self.ids.take(pa.array(np.concatenate([self.rows, alone]).astype(np.int64)))
        d = pa.concat_arrays([pa.array(self.d), pa.nulls(len(alone), pa.float64())])
        return pa.RecordBatch.from_arrays([qid, d, pa.concat_arrays([self.found, pa.nulls(len(alone), self.found.type)])], names)


# What a search makes of two blocks: (query row, training row, distance) of each query's nearest, given the best so far,
# to which it may add some itself.
Meet = Callable[[Block, Block, _Best], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _hits(q: Blocks, t: Blocks, k: int, meet: Meet, once: bool = False) -> DataFrame:
    """k best (qid, d, id) per query and task, written once.

    The blocks of training rows pass those of the queries that a task keeps: a product of blocks, so that no row is
    joined with every other and the plan of a result begins with few rows per query.
    """
    id_type = t.kinds["id"]
    out = T.StructType([T.StructField("qid", q.kinds["id"]), T.StructField("d", T.DoubleType()), T.StructField("id", id_type)])
    q_kinds, t_kinds, kind = q.kinds, t.kinds, to_arrow_type(id_type)

    def run(batches):
        best: dict[int, _Best] = {}
        for batch in batches:
            for i, no in enumerate(batch.column("q_no").to_pylist()):
                left, right = Block(batch, i, "q", q_kinds), Block(batch, i, "t", t_kinds)
                so_far = best.setdefault(no, _Best(left.ids, k, kind, once))
                rows, cols, d = meet(left, right, so_far)
                so_far.add(rows, d, right.ids.take(pa.array(cols.astype(np.int64))))
        for so_far in best.values():
            yield so_far.batch(out.names)

    # a task for each part of the queries, and more only where that leaves cores idle: each emits k rows per query
    asking = q.table.select(*[F.col(c).alias(f"q_{c}") for c in q.table.columns])
    passing = t.table.select(*[F.col(c).alias(f"t_{c}") for c in t.kinds])
    tasks = max(1, asking.rdd.getNumPartitions())
    passing = passing.coalesce(max(1, math.ceil(2 * q.table.sparkSession.sparkContext.defaultParallelism / tasks)))
    return materialize(passing.hint("shuffle_replicate_nl").crossJoin(asking).mapInArrow(run, out))


def _search(q: Blocks, t: Blocks, k: int, meet: Meet) -> DataFrame:
    """k best (d, id) per query over all blocks."""
    if not t.table.isEmpty():
        hits = _hits(q, t, k, meet)
    else:
        hits = q.rows("id").select(F.col("id").alias("qid"), F.lit(None).cast("double").alias("d"), F.lit(None).cast(t.kinds["id"]).alias("id"))
    # the rank filter also runs before the shuffle, so no row gathers the candidates of all tasks
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("d").asc_nulls_last(), "id"))
    first = hits.withColumn("__rank", rank).filter(F.col("__rank") <= max(k, 1))
    pair = F.when((F.col("d").isNotNull()) & (F.col("__rank") <= k), F.struct("d", "id"))
    return first.groupBy("qid").agg(F.sort_array(F.collect_list(pair)).alias("neighbors"))


def _all_pairs(k: int, metric: str, met: Callable[[Block, Block], np.ndarray] | None = None) -> Meet:
    """Every query meets every training row that is not itself or of its group.

    ``met`` gives a place for each row of either side and, for the places in order, which of them meet.
    """

    def parts(q: Block, t: Block):
        """Rows of both sides that meet."""
        if met is None:
            yield slice(None), slice(None)
            return
        q_place, t_place, meets = met(q, t)
        if meets.all():
            yield slice(None), slice(None)
            return
        ways, way = np.unique(meets, axis=0, return_inverse=True)
        for i, there in enumerate(ways):
            if there.any():
                yield np.flatnonzero(way.ravel()[q_place] == i), np.flatnonzero(there[t_place])

    def meet(q: Block, t: Block, best: _Best):
        q_grp = t_grp = None
        if q._lists["grp"].null_count < len(q):
            q_grp, t_grp = q["grp"], t["grp"]
        rank = np.argsort(np.argsort(t.id, kind="stable"), kind="stable")
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for here, there in parts(q, t):
            groups = (None, None) if q_grp is None else (q_grp[here], t_grp[there])
            rows, cols, d = _cell_top_k(q.vec[here], t.vec[there], q.id[here], t.id[there], *groups, rank[there], k, metric, best.far[here])
            found.append((np.arange(len(q))[here][rows], np.arange(len(t))[there][cols], d))
        return tuple(np.concatenate(x) for x in zip(*found))

    return meet


def _sides(queries, train, id_col, vec_col, exclude_same, metric="euclidean"):
    """Both sides' usable rows, and the queries whose vector no distance is defined for.

    A usable vector has finite components, the usual length of the training
    vectors, and for a cosine a direction.  Training rows without one are
    neighbours of nothing.
    """
    grp = F.lit(None).cast("long")
    if exclude_same:
        grp = F.when(F.col(exclude_same).isNotNull(), F.xxhash64(exclude_same))
    names = [F.col(id_col).alias("id"), grp.alias("grp"), F.col(vec_col).alias("vec")]
    q, t = queries.select(*names), train.select(*names)
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = F.coalesce(finite, F.lit(False)) & (F.size("vec") > 0)
    if metric != "euclidean":
        usable = usable & F.exists("vec", lambda x: x != 0)
    usual = t.where(usable).agg(F.mode(F.size("vec"))).first()[0]
    usable = usable & (F.size("vec") == F.lit(usual or 0))
    return q.where(usable), t.where(usable), q.where(~F.coalesce(usable, F.lit(False)))


def _unanswered(found: DataFrame, bad: DataFrame) -> DataFrame:
    """``found`` with an empty answer for every query in ``bad``."""
    empty = F.array().cast(found.schema["neighbors"].dataType)
    return found.unionByName(bad.select(F.col("id").alias("qid"), empty.alias("neighbors")))


def nearest(
    queries: DataFrame,
    train: DataFrame,
    k: int = 3,
    metric: str = "euclidean",
    id_col: str = "id",
    vec_col: str = "vec",
    exclude_same: str | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The k nearest training rows of every query: ``qid, neighbors<d, id>``.

    The row itself is excluded, and with ``exclude_same`` every training row
    that shares that column's value; equal distances go by id.  Ids are unique
    per side.  A query whose vector is null, not finite, of unusual length or, for
    a cosine, without direction gets no neighbours; such training rows are nobody's.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    q, t, bad = _sides(queries, train, id_col, vec_col, exclude_same, metric)
    held = Blocks.of(_merged(t), block_rows, copies=k)
    # enough blocks for every core, as long as each holds a fair number of queries
    wanted = math.ceil(q.count() / (2 * q.sparkSession.sparkContext.defaultParallelism))
    asked = Blocks.of(_merged(q), min(block_rows, max(wanted, _LEAST_QUERIES)))
    return _unanswered(_search(asked, held, k, _all_pairs(k, metric)), bad)


def _merged(rows: DataFrame) -> DataFrame:
    """``rows`` in no more partitions than are worth a block."""
    return rows.coalesce(4 * rows.sparkSession.sparkContext.defaultParallelism)


def _pivot_distances(vectors: pd.Series, pivots: np.ndarray) -> np.ndarray:
    q = np.vstack(vectors.to_list()).astype(np.float64)
    square = np.square(q).sum(axis=1)[:, None] + np.square(pivots).sum(axis=1)[None, :] - 2.0 * (q @ pivots.T)
    return np.sqrt(np.maximum(square, 0.0))


def nearest_pruned(
    queries: DataFrame,
    train: DataFrame,
    k: int = 3,
    id_col: str = "id",
    vec_col: str = "vec",
    pivots: int | None = None,
    block_rows: int = PRUNED_BLOCK_ROWS,
) -> DataFrame:
    """Same result as ``nearest`` (Euclidean), comparing fewer blocks.

    Rows of both sides belong to the cell of their closest pivot; there are twice as many
    pivots as the root of the training rows, up to ``MOST_PIVOTS``.  Cells above
    ``block_rows`` are split, so a crowd of similar rows is several blocks.  A first search in one block
    near by bounds the k-th distance of every query in a block of queries; the triangle inequality
    then rules out every cell that lies farther from all of them.  Both sides are written once, ordered by
    cells that lie close together, for the first search and the second.
    """
    q, t, met, _ = _pruned_plan(queries, train, k, id_col, vec_col, pivots, block_rows)
    bad = _sides(queries, train, id_col, vec_col, None)[2]
    return _unanswered(_search(q, t, k, _all_pairs(k, "euclidean", met)), bad)


def compared_share(
    queries: DataFrame,
    train: DataFrame,
    k: int = 3,
    id_col: str = "id",
    vec_col: str = "vec",
    pivots: int | None = None,
    block_rows: int = PRUNED_BLOCK_ROWS,
) -> DataFrame:
    """Share of all query-train pairs that ``nearest_pruned`` still compares after its first search in one block near by."""
    compared = _pruned_plan(queries, train, k, id_col, vec_col, pivots, block_rows)[3]
    total = queries.count() * train.count()
    share = None if compared is None else compared / total
    return queries.sparkSession.range(1).select(F.lit(share).cast("double").alias("share"))


def _far_apart(rows: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` of the rows, each the farthest from those chosen before it."""
    chosen, far = [0], np.full(len(rows), np.inf)
    while len(chosen) < n:
        far = np.minimum(far, np.square(rows - rows[chosen[-1]]).sum(axis=1))
        if not far.max() > 0:
            break
        chosen.append(int(far.argmax()))
    return rows[chosen]


def _path(between: np.ndarray) -> np.ndarray:
    """Place of each point on a path from one to the nearest that is left; ``between`` are their distances."""
    place, left, at = np.zeros(len(between), np.int32), np.ones(len(between), bool), 0
    for i in range(len(between)):
        place[at], left[at] = i, False
        at = int(np.where(left, between[at], np.inf).argmin())
    return place


def _pruned_plan(queries, train, k, id_col, vec_col, n_pivots, block_rows):
    """Blocks of both sides, which of their rows meet, and the number of pairs to be compared."""
    q, t, _ = _sides(queries, train, id_col, vec_col, None)
    n_pivots = n_pivots or min(MOST_PIVOTS, max(16, 2 * math.isqrt(t.count())))
    sample = t.orderBy(F.xxhash64("id", F.lit(4)), "id").limit(4 * n_pivots).select("vec").collect()
    if not sample:
        raise ValueError("the training side is empty")
    pivot = _far_apart(np.array([r["vec"] for r in sample], dtype=np.float64), n_pivots)
    between = _pivot_distances(pd.Series(list(pivot)), pivot)
    place = _path(between)

    @F.pandas_udf("home int, reach double, place int")
    def assign(vectors: pd.Series) -> pd.DataFrame:
        d = _pivot_distances(vectors, pivot)
        home = d.argmin(axis=1)
        return pd.DataFrame({"home": home.astype(np.int32), "reach": d[np.arange(len(d)), home], "place": place[home]})

    # written once: the statistics and both searches read them
    part, chunk = F.xxhash64("id", F.lit(5)).alias("part"), F.xxhash64("id", F.lit(3)).alias("chunk")
    placed = ("id", "grp", "vec", "at.home", "at.reach", "at.place", part)
    wanted = math.ceil(q.count() / (2 * q.sparkSession.sparkContext.defaultParallelism))
    t = Blocks.of(_merged(t).withColumn("at", assign("vec")).select(*placed), BLOCK_ROWS, k, "place")
    q = Blocks.of(_merged(q).withColumn("at", assign("vec")).select(*placed, chunk), min(BLOCK_ROWS, max(wanted, _LEAST_QUERIES)), by="place")
    held, radius, asked = np.zeros(len(pivot), np.int64), np.full(len(pivot), -np.inf), np.zeros(len(pivot), np.int64)
    for r in t.rows("home", "reach").groupBy("home").agg(F.count("*").alias("rows"), F.max("reach").alias("radius")).collect():
        held[r["home"]], radius[r["home"]] = r["rows"], r["radius"]
    for r in q.rows("home").groupBy("home").agg(F.count("*").alias("rows")).collect():
        asked[r["home"]] = r["rows"]
    parts, chunks = np.maximum(1, -(-held // block_rows)), np.maximum(1, -(-asked // block_rows))
    # number of a cell's part or chunk: the cell's first one plus one given by the id
    first, first_ask = (np.concatenate([[0], np.cumsum(x)[:-1]]) for x in (parts, chunks))
    # the nearest cell with enough rows to bound a k-th distance, or with any
    candidates = (held > k) if (held > k).any() else (held > 0)
    near = np.where(candidates[None, :], between, np.inf).argmin(axis=1)

    def visited(q: Block, t: Block):
        """A query visits one part of the cell near by."""
        cell = near[q["home"]]
        one, q_place = np.unique(first[cell] + q["part"] % parts[cell], return_inverse=True)
        other, t_place = np.unique(first[t["home"]] + t["part"] % parts[t["home"]], return_inverse=True)
        return q_place, t_place, one[:, None] == other[None, :]

    found = _search(q, t, k, _all_pairs(k, "euclidean", visited))
    bound = found.select(F.col("qid").alias("id"), F.when(F.size("neighbors") == k, F.try_element_at("neighbors", F.lit(k))["d"]).alias("bound"))
    # no row of a cell is nearer to a query than the pivots' distance less the query's and the row's from theirs
    most = F.max(F.col("reach") + F.coalesce("bound", F.lit(float("inf")))).alias("most")
    here = F.pmod("chunk", F.get(F.array(*[F.lit(int(x)) for x in chunks]), F.col("home"))).alias("chunk")
    asking = q.rows("id", "home", "reach", "chunk").join(bound, "id", "left").groupBy("home", here).agg(F.count("*").alias("q"), most).toArrow()
    ask = first_ask[asking["home"].to_numpy()] + asking["chunk"].to_numpy()
    farthest = np.full(first_ask[-1] + chunks[-1], -np.inf)
    farthest[ask] = asking["most"].to_numpy()

    def reached(home: np.ndarray, most: np.ndarray, cells: np.ndarray) -> np.ndarray:
        return (held[cells] > 0)[None, :] & (between[home[:, None], cells[None, :]] - radius[cells][None, :] <= most[:, None] * (1 + 1e-9) + 1e-7)

    def met(q: Block, t: Block):
        """A chunk of a cell's queries meets the cells that one of them reaches."""
        home = q["home"]
        asks, one, q_place = np.unique(first_ask[home] + q["chunk"] % chunks[home], return_index=True, return_inverse=True)
        cells, t_place = np.unique(t["home"], return_inverse=True)
        return q_place, t_place, reached(home[one], farthest[asks], cells)

    compared = None
    for at in range(0, len(ask), MOST_PIVOTS):
        some = asking.slice(at, MOST_PIVOTS)
        rows = reached(some["home"].to_numpy(), some["most"].to_numpy(), np.arange(len(pivot))) @ held
        compared = (compared or 0) + int((rows * some["q"].to_numpy()).sum())
    return q, t, met, compared


def neighbor_targets(
    neighbors: DataFrame, train: DataFrame, target: str, id_col: str = "id", name: str = "neighbor_targets"
) -> DataFrame:
    """Targets of each query's neighbours in distance order; none gives ``[]``."""
    side = train.select(F.col(id_col).alias("id"), F.col(target).cast("double").alias("__y"))
    listed = neighbors.select("qid", F.posexplode_outer("neighbors").alias("pos", "n")).select("qid", "pos", "n.id")
    pair = F.when(F.col("pos").isNotNull(), F.struct("pos", "__y"))
    ordered = F.sort_array(F.collect_list(pair))
    return listed.join(side, "id", "left").groupBy("qid").agg(F.transform(ordered, lambda p: p["__y"]).alias(name))


def array_mean(col: str | Column) -> Column:
    """Mean of an array of numbers; null for an empty one."""
    total = F.aggregate(col, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(col) > 0, total / F.size(col))


def neighbor_residual(
    df: DataFrame, target: str, targets: str = "neighbor_targets"
) -> DataFrame:
    """Mean of the neighbours' targets and the distance of the own target to it."""
    return df.withColumn("neighbor_mean", array_mean(targets)).withColumn(
        "residual", F.col(target) - F.col("neighbor_mean")
    )


def restore_prediction(
    df: DataFrame, scaler, scaled: str = "scaled", mean: str = "neighbor_mean", name: str = "prediction"
) -> DataFrame:
    """Unscaled residual at 2 decimals plus the neighbour mean."""
    restored = scaler.unscale(df, scaled, "__residual")
    return restored.withColumn(name, F.bround("__residual", 2) + F.col(mean)).drop("__residual")


def knn_regress(
    train: DataFrame,
    test: DataFrame,
    target: str,
    k: int = 5,
    id_col: str = "id",
    vec_col: str = "vec",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Mean target of the k nearest training rows: ``qid, prediction``."""
    found = nearest(test, train, k, "euclidean", id_col, vec_col, block_rows=block_rows)
    listed = neighbor_targets(found, train, target, id_col)
    return listed.select("qid", array_mean("neighbor_targets").alias("prediction"))


def contiguous_folds(
    df: DataFrame, order: OrderKey | Sequence[OrderKey], folds: int, name: str = "fold"
) -> DataFrame:
    """Unshuffled folds by position; the first ``n mod folds`` hold one row more."""
    n = df.count()
    size, extra = divmod(n, folds)
    i = F.col("__i")
    long_rows = extra * (size + 1)
    fold = F.when(i < long_rows, F.floor(i / F.lit(size + 1))).otherwise(
        F.lit(extra) + F.floor((i - long_rows) / F.lit(max(size, 1)))
    )
    return global_index(df, order, "__i").withColumn(name, fold.cast("int")).drop("__i")


def knn_grid(
    train: DataFrame,
    target: str,
    order: OrderKey | Sequence[OrderKey],
    ks: Sequence[int] = tuple(range(1, 31)),
    folds: int = 10,
    id_col: str = "id",
    vec_col: str = "vec",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Score per k: mean over folds of the negative mean squared error.

    One search finds the most distant k needed outside each row's fold; every
    smaller k is a prefix of it.
    """
    folded = contiguous_folds(train, order, folds)
    found = nearest(folded, folded, max(ks), "euclidean", id_col, vec_col, "fold", block_rows)
    listed = neighbor_targets(found, folded, target, id_col)
    rows = folded.select(F.col(id_col).alias("qid"), "fold", F.col(target).cast("double").alias("y"))
    k = F.explode(F.array(*[F.lit(x) for x in ks])).alias("k")
    scored = listed.join(rows, "qid").select("fold", "y", "neighbor_targets", k)
    guess = array_mean(F.slice("neighbor_targets", F.lit(1), F.col("k")))
    error = F.avg(F.pow(guess - F.col("y"), 2))
    return scored.groupBy("k", "fold").agg(error.alias("mse")).groupBy("k").agg((-F.avg("mse")).alias("score"))


def best_k(scores: DataFrame) -> DataFrame:
    """The k of the best score; of equal scores the smallest k."""
    top = F.max_by(F.struct("k", "score"), F.struct("score", -F.col("k")))
    return scores.agg(top.alias("best")).select("best.k", "best.score")
