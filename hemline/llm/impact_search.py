"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Vectors are dealt out to blocks of bounded size, queries to blocks of their own;
a task meets one block of each.  The block's index holds, for every component,
posting segments: the vectors whose component falls into one quantised impact.
Segments are processed by descending impact, all queries of the block at once,
so the largest contributions come first.  After each impact the distance of
every vector from what has been added of it bounds its true score on both sides
(Cauchy-Schwarz).  Processing stops on proof: when the vectors whose upper bound
reaches a query's k-th best lower bound are few; these are rescored with exact integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hemline.session import materialize

#: Width of a quantised impact, on components multiplied by 256.
STEP = 8
#: Vectors and queries of a block; queries that share an accumulator.
BLOCK, QUERY_BLOCK, TOGETHER = 8192, 2048, 32
#: Share of a block that may be rescored before all segments are processed.
FEW = 0.02


class Index:
    """Posting segments of a block of integer vectors, by descending impact."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors.astype(np.float64)
        # single precision holds the sums of ordinary components; its rounding is part of the slack
        self.kind = np.float32 if np.abs(self.vectors).max(initial=0) < 1e6 else np.float64
        self.rounding = 1e-5 * float(np.sqrt((self.vectors**2).sum(axis=1)).max(initial=0))
        level = np.floor_divide(vectors, STEP)
        middle = level * STEP + (STEP - 1) / 2
        impact = np.maximum(np.abs(level), np.abs(level + 1)) // 2  # two neighbouring levels at a time
        rest = (self.vectors**2).sum(axis=1)
        self.steps: list[tuple[list[tuple[int, float, np.ndarray]], np.ndarray]] = []
        for top in np.unique(impact)[::-1]:
            here = impact == top
            segments = []
            for d in np.flatnonzero(here.any(axis=0)):
                ids = np.flatnonzero(here[:, d])
                for value in np.unique(middle[ids, d]):
                    segments.append((int(d), float(value), ids[middle[ids, d] == value]))
            # squared distance of each vector from what has been added of it
            rest = rest + np.where(here, (self.vectors - middle) ** 2 - self.vectors**2, 0).sum(axis=1)
            self.steps.append((segments, np.sqrt(np.maximum(rest, 0))))

    def search(self, queries: np.ndarray, own: np.ndarray, k: int) -> tuple[list[np.ndarray], int]:
        """Rows of possible members for each query, and the posting segments processed.

        ``own`` tells which rows are no candidates of a query (vectors x queries).
        """
        q = queries.astype(np.float64)
        norms = np.sqrt((q**2).sum(axis=1)) * (1 + 1e-9)
        q = q.astype(self.kind)
        n, open_queries = len(self.vectors), np.arange(len(q))
        total = np.zeros((n, len(q)), self.kind)
        members: list[np.ndarray] = [np.empty(0, np.int64)] * len(q)
        few, done, checked = max(4 * k, int(FEW * n)), 0, np.inf
        for i, (segments, rest) in enumerate(self.steps):
            for d, value, ids in segments:
                total[ids] += self.kind(value) * q[:, d]
            done += len(segments)
            # a proof is tried when the bounds have become clearly tighter
            if i < len(self.steps) - 1 and rest.mean() > 0.6 * checked:
                continue
            checked = rest.mean()
            slack = ((rest[:, None] + self.rounding) * norms[open_queries] + 1e-6).astype(self.kind)
            low = total - slack
            low[own] = -np.inf
            kth = np.partition(low, n - k, axis=0)[n - k] if n > k else np.full(len(open_queries), -np.inf)
            possible = (total + slack >= kth) & ~own
            enough = (possible.sum(axis=0) <= few) | (i == len(self.steps) - 1)
            for j in np.flatnonzero(enough):
                members[open_queries[j]] = np.flatnonzero(possible[:, j])
            if enough.any():
                open_queries, q, total, own = open_queries[~enough], q[~enough], total[:, ~enough], own[:, ~enough]
            if not len(open_queries):
                break
        return members, done


def _exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integer inner products; sums beyond 64 bits are held at its limits."""
    peak = int(np.abs(vectors).max(initial=0)) * int(np.abs(query).max(initial=0)) * max(len(query), 1)
    if peak < 2**62:
        return vectors @ query
    sums = vectors.astype(object) @ query.astype(object)
    return np.array([min(max(int(x), -(2**63)), 2**63 - 1) for x in sums], np.int64)


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat if isinstance(flat, pa.Array) else pa.concat_arrays(flat.chunks)
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


_FOUND = "query long, query_id long, vec_id long, score long"


def _meet(k: int):
    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if queries.num_rows and vectors.num_rows:
            v = _matrix(vectors.column("ints"), vectors.num_rows)
            q = _matrix(queries.column("ints"), queries.num_rows)
            ids = vectors.column("vec_id").to_pylist()
            known = np.array([i is not None for i in ids])
            names = np.array([i or 0 for i in ids], np.int64)
            rows, query_ids = queries.column("row").to_numpy(), queries.column("vec_id").to_numpy()
            index = Index(v)
            for at in range(0, len(q), TOGETHER):
                part = q[at : at + TOGETHER]
                own = (names[:, None] == query_ids[None, at : at + TOGETHER]) & known[:, None]
                members, _ = index.search(part, own, k)
                for j, m in enumerate(members):
                    scores = _exact(v[m], part[j])
                    # ties to the smaller id, unknown ids last
                    best = np.lexsort((names[m], ~known[m], -scores))[:k]
                    count = len(best)
                    out.append((np.full(count, rows[at + j]), np.full(count, query_ids[at + j]), m[best], scores[best]))
            if out:
                row, query, m, score = (np.concatenate(c) for c in zip(*out))
                return pa.table({"query": row, "query_id": query, "vec_id": pa.array(names[m], mask=~known[m]), "score": score})
        return pa.table({c: pa.array([], pa.int64()) for c in ("query", "query_id", "vec_id", "score")})

    return run


def _ints(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256))


def top_k(vectors: DataFrame, query: Column, k: int = 5, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` best rows for every row that meets ``query``.

    ``vectors`` has ``vec_id`` and ``embedding``.  Null or empty vectors and those
    with a null or non-finite component take no part, and vectors meet only
    those of their own length.  A query's own row is any row of its id.  Each
    repeated row counts and each repeated query is answered; unknown ids are
    candidates that lose ties.  An empty table gives no rows.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where((F.size("embedding") > 0) & F.coalesce(finite, F.lit(False)))
    # numbered once and written, so that the numbers hold when a task is repeated
    rows = good.select("vec_id", _ints(F.col("embedding")).alias("ints"), F.monotonically_increasing_id().alias("row"))
    rows = materialize(rows.withColumn("asks", F.coalesce(query, F.lit(False)) & F.col("vec_id").isNotNull()))
    n, asking = rows.agg(F.count("*"), F.count_if("asks")).first()
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-asking // query_block))

    def dealt(df: DataFrame, own: str, parts: int, other: str, others: int) -> DataFrame:
        place = F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")
        all_others = F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        return df.select("row", "vec_id", "ints", F.size("ints").alias("dim"), place.alias(own), all_others.alias(other))

    candidates = dealt(rows, "vb", blocks, "qb", query_blocks)
    # columns of their own: pruning goes by column identity and would take from one side what only the other leaves out
    fresh = rows.where("asks").select(*[F.col(c).alias(c) for c in ("row", "vec_id", "ints")])
    asked = dealt(fresh, "qb", query_blocks, "vb", blocks)
    keys = ["dim", "qb", "vb"]
    found = asked.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(_meet(k), _FOUND)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
