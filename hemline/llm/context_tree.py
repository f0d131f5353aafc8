"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions; each decision has a tree of contexts, the last
0 to ``DEPTH`` bytes.  Every node estimates its decision by Krichevsky and
Trofimov, and weighs its own estimate against its children's by how well either
codes the training texts: Pw = (Pe + product of the children's Pw) / 2.  The
probability of a decision mixes the estimates along the path of its context.

Spark counts runs of ``DEPTH`` + 1 bytes.  Subtrees below three context bytes are
weighed in groups of about ``RUNS`` runs, each with whole subtrees; the three levels
above them are small and weighed on the driver from the subtrees' sums.  Every group
also takes the different runs to be scored that end in its bytes and keeps what its deepest counted context gives each of
their decisions, so that every context of the training texts is used and no
machine holds the whole tree.  Documents are dealt to chunks by the tasks that read them and
written in buckets of chunks, so that their texts are never shuffled.  The scores of the runs
are joined back to the chunks and summed there.

The words' base score needs each word's count in the training texts: the most
frequent words, of a bounded number, are looked up in the task, all others joined.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemline.llm.common import bucketed, compressed, crc_mod, dealt, regroup
from hemline.session import materialize

#: Context bytes; words that are looked up in the task.
DEPTH, FREQUENT = 5, 65536
#: Ends a text and stands before its beginning; no byte of UTF-8.
END = 0xFF
#: Characters handled at once in a task, and bytes of the documents that share a list of runs.
CHUNK, SHARED = 2_000_000, 16_000_000
#: Context bytes above the groups' subtrees, and different runs of a group.
TOP, RUNS = 3, 50_000


def _mask(depth: int) -> np.uint64:
    """Bits of the last ``depth`` context bytes and of the byte itself."""
    return np.uint64((1 << (8 * (depth + 1))) - 1)


def runs(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For every byte and end of the texts: itself in the low byte, its context above it, newest first; and bytes of each text."""
    pad = bytes([END]) * DEPTH
    out = np.frombuffer(pad.join([b"", *raw, b""]), np.uint8).astype(np.uint64)
    lengths = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    # pairs of bytes first, then three pairs
    older = np.zeros_like(out)
    np.left_shift(out[:-1], np.uint64(8), out=older[1:])
    out |= older
    far = np.zeros_like(out)
    np.left_shift(out[:-2], np.uint64(16), out=older[2:])
    np.left_shift(out[:-4], np.uint64(32), out=far[4:])
    out[2:] |= older[2:]
    out |= far
    # a text's end is the first byte of the padding that follows it
    stops = np.cumsum(lengths - 1 + DEPTH) + 1
    wanted = np.ones(len(out), bool)
    wanted[:DEPTH] = False
    wanted[(stops[:, None] + np.arange(DEPTH - 1)).ravel()] = False
    return out[wanted], lengths


def _distinct(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the sum of their counts (one each if not given)."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys))) if counts is None else np.add.reduceat(counts, first) if len(first) else counts


def _sums(keys: np.ndarray, lengths: np.ndarray, known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum of the keys' values over every text; ``known`` is in order and has all keys.

    A key leaves 16 bits for the number of its text: sorted together, equal
    keys look up their value once.
    """
    ended = np.cumsum(lengths)
    out = []
    for begin in range(0, len(lengths), 65536):
        here = lengths[begin : begin + 65536]
        first = ended[begin] - here[0]
        tagged = keys[first : first + here.sum()] << np.uint64(16) | np.repeat(np.arange(len(here), dtype=np.uint64), here)
        tagged.sort()
        run = tagged >> np.uint64(16)
        new = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        each = np.repeat(values[np.searchsorted(known, run[new])], np.diff(np.append(new, len(run))))
        out.append(np.bincount((tagged & np.uint64(0xFFFF)).astype(np.int64), each, len(here)))
    return np.concatenate(out)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift, to about 1e-10."""
    y = x + 8
    shift = np.log(x)
    for j in range(1, 8):
        shift = shift + np.log(x + j)
    inv = 1 / y
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + inv / 12 - inv**3 / 360 + inv**5 / 1260 - shift


def _log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - _log_gamma(n0 + n1 + 1) - math.log(math.pi)


def decisions(keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Node (context above, 1 to 255 below) and bit of the eight decisions of each key's byte."""
    byte, above = keys & np.uint64(0xFF), keys & ~np.uint64(0xFF)
    for k in range(8):
        yield above | np.uint64(1 << k) | (byte >> np.uint64(8 - k)), (byte >> np.uint64(7 - k)) & np.uint64(1)


def nodes(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of both bits at every node of the keys."""
    parts = list(decisions(keys))
    all_nodes = np.concatenate([p[0] for p in parts])
    bits = np.concatenate([p[1] for p in parts])
    name, inverse = np.unique(all_nodes, return_inverse=True)
    weight = np.tile(counts.astype(np.float64), 8)
    n1 = np.bincount(inverse, weight * bits, len(name))
    return name, np.bincount(inverse, weight, len(name)) - n1, n1


def weigh(name: list[np.ndarray], n0: list[np.ndarray], n1: list[np.ndarray], top: int, below: np.ndarray | None = None):
    """Levels from ``top`` down: (log Pw, weight of a node's own estimate), given the sums below the last level."""
    out: list[tuple[np.ndarray, np.ndarray]] = [None] * len(name)
    sums = below
    for i in range(len(name) - 1, -1, -1):
        own = _log_kt(n0[i], n1[i])
        if sums is None:
            out[i] = own, np.ones(len(own))
        else:
            out[i] = np.logaddexp(own, sums) - math.log(2), 1 / (1 + np.exp(np.clip(sums - own, -700, 700)))
        if i:
            parent = np.searchsorted(name[i - 1], name[i] & _mask(top + i - 1))
            sums = np.bincount(parent, out[i][0], len(name[i - 1]))
    return out


_SHARES = [f"s{k}" for k in range(8)]
#: Rows of runs have the shares of their decisions (NaN where no context of ``TOP`` bytes is known), rows of nodes one level above a group's part of their sums.
_TREE = "run long, node long, n0 double, n1 double, weighed double, " + ", ".join(f"{s} double" for s in _SHARES)


def _subtree(group: pa.Table) -> pa.Table:
    """All runs of some endings of ``TOP`` context bytes: sums of their nodes, and what the subtrees' mix gives the bit 1 in each run's decisions."""
    asked, counts = group.column("run").to_numpy().view(np.uint64), group.column("n").to_numpy()
    keys, counts = asked[counts > 0], counts[counts > 0]
    levels = []
    for depth in range(TOP, DEPTH + 1):
        short, inverse = np.unique(keys & _mask(depth), return_inverse=True)
        levels.append(nodes(short, np.bincount(inverse, counts, len(short))))
    name, n0, n1 = (list(x) for x in zip(*levels))
    weighed = weigh(name, n0, n1, TOP)
    sums, mass = np.zeros(len(name[0])), np.ones(len(name[0]))
    next_sums, next_mass = sums, mass
    mixed = []
    for i, depth in enumerate(range(TOP, DEPTH + 1)):
        if i:
            parent = np.searchsorted(name[i - 1], name[i] & _mask(depth - 1))
            sums, mass = next_sums[parent], next_mass[parent]
        estimate = (n1[i] + 0.5) / (n0[i] + n1[i] + 1)
        own = weighed[i][1]
        next_sums, next_mass = sums + mass * own * estimate, mass * (1 - own)
        mixed.append(sums + mass * estimate)
    shares = []
    for node, _ in decisions(asked):
        share = np.full(len(asked), np.nan)
        left = np.arange(len(asked) if len(keys) else 0)
        for i in range(DEPTH - TOP, -1, -1):
            wanted = node[left] & _mask(i + TOP)
            place = np.minimum(np.searchsorted(name[i], wanted), len(name[i]) - 1)
            seen = name[i][place] == wanted
            share[left[seen]] = mixed[i][place[seen]]
            left = left[~seen]
            if not len(left):
                break
        shares.append(share)
    above, inverse = np.unique(name[0] & _mask(TOP - 1), return_inverse=True)
    no_run, no_node = pa.nulls(len(above), pa.float64()), pa.nulls(len(asked), pa.float64())
    own = [pa.chunked_array([no_node, pa.array(np.bincount(inverse, x, len(above)), pa.float64())]) for x in (n0[0], n1[0], weighed[0][0])]
    run = pa.chunked_array([pa.array(asked.view(np.int64)), no_run.cast(pa.int64())])
    node = pa.chunked_array([no_node.cast(pa.int64()), pa.array(above.view(np.int64))])
    return pa.table([run, node, *own, *[pa.chunked_array([pa.array(s), no_run]) for s in shares]], [f.split()[0] for f in _TREE.split(", ")])


def _lowered(texts: list[str]) -> list[bytes]:
    return [t.encode("utf-8", "replace").lower() for t in texts]


def _count_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, texts in regroup(batches, "text", CHUNK):
        keys, n = _distinct(runs(_lowered(texts))[0])
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["run", "n"])


def _chunk_runs(group: pa.Table) -> pa.Table:
    """Different runs of a chunk's documents, and how often they occur in its learned ones."""
    parts = []
    for batch, texts in regroup(iter(group.to_batches()), "text", CHUNK):
        keys, lengths = runs(_lowered(texts))
        learned = np.repeat(batch.column("learned").to_numpy(zero_copy_only=False), lengths)
        parts.append(_distinct(keys[learned]))
        other = _distinct(keys[~learned])[0]
        parts.append((other, np.zeros(len(other), np.int64)))
    different, n = _distinct(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
    return pa.table({"chunk": pa.array(np.full(len(different), group.column("chunk")[0].as_py(), np.int64)), "run": different.view(np.int64), "n": n})


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, texts in regroup(batches, "text", SHARED):
        found: Counter[bytes] = Counter()
        for raw in _lowered(texts):
            found.update(raw.split())
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"])


@dataclass
class Model:
    """The weighed tree: three small levels by node, and the shares that the subtrees give each run."""

    #: by (last byte << 8 | decision): the mix where no context of two bytes is known
    alone: np.ndarray
    #: nodes of two context bytes, the mix above the subtrees, the mass that goes to them, and the mix where none is seen
    names: np.ndarray
    above: np.ndarray
    mass: np.ndarray
    ended: np.ndarray
    #: run and its shares, for all runs that were learned or asked for
    shares: DataFrame

    def scored(self) -> DataFrame:
        """``run`` and the log10 of its byte's probability in its context."""
        spark = self.shares.sparkSession
        shared = spark.sparkContext.broadcast((self.alone, self.names, self.above, self.mass, self.ended))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            alone, names, above, mass, ended = shared.value
            for batch in batches:
                total = np.zeros(batch.num_rows)
                for (node, bit), name in zip(decisions(batch.column("run").to_numpy().view(np.uint64)), _SHARES):
                    p = alone[(node & _mask(1)).astype(np.int64)]
                    wanted = node & _mask(TOP - 1)
                    place = np.searchsorted(names, wanted)
                    seen = np.flatnonzero(names[np.minimum(place, len(names) - 1)] == wanted) if len(names) else []
                    at, share = place[seen], batch.column(name).to_numpy()[seen]
                    p[seen] = np.where(np.isnan(share), ended[at], above[at] + mass[at] * share)
                    total += np.log10(np.where(bit == 1, p, 1 - p))
                yield pa.RecordBatch.from_arrays([batch.column("run"), pa.array(total)], ["run", "log10"])

        return self.shares.mapInArrow(score, "run long, log10 double")

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """``scored`` of a few of its runs."""
        signed = keys.view(np.int64).tolist()
        found = {r[0]: r[1] for r in self.scored().where(F.col("run").isin(signed)).collect()}
        return np.array([found[k] for k in signed])


def _fit_tree(learned: DataFrame, counted: DataFrame | None = None) -> Model:
    """The tree of the learned texts, or of ``counted`` (run and n), whose runs with n = 0 are only scored."""
    if counted is None:
        counted = learned.select("text").mapInArrow(_count_runs, "run long, n long")
    counted = materialize(counted.groupBy("run").agg(F.sum("n").alias("n")))
    groups = max(1, -(-counted.count() // RUNS))
    ending = F.shiftright("run", 8).bitwiseAND(F.lit(2 ** (8 * TOP) - 1))
    grouped = counted.withColumn("part", F.pmod(F.xxhash64(ending), F.lit(groups))).groupBy("part")
    tree = materialize(grouped.applyInArrow(_subtree, _TREE))
    # two context bytes and a decision: at most 2^24 rows, and in text a small part of them
    top = tree.where("node IS NOT NULL").groupBy("node").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "weighed")]).toArrow()
    node2 = top.column("node").to_numpy().view(np.uint64)
    order = np.argsort(node2)
    node2, n0, n1, below = node2[order], *(top.column(c).to_numpy()[order] for c in ("n0", "n1", "weighed"))
    names, zeros, ones = [], [], []
    for depth in range(TOP):
        name, inverse = np.unique(node2 & _mask(depth), return_inverse=True)
        names.append(name)
        zeros.append(np.bincount(inverse, n0, len(name)))
        ones.append(np.bincount(inverse, n1, len(name)))
    weighed = weigh(names, zeros, ones, 0, below)
    estimate = [(b + 0.5) / (a + b + 1) for a, b in zip(zeros, ones)]
    alone = np.full((256, 256), 0.5)
    alone[:, names[0].astype(np.int64)] = estimate[0]
    alone = alone.ravel()
    ended, above, mass = estimate[0], weighed[0][1] * estimate[0], 1 - weighed[0][1]
    for depth in range(1, TOP):
        parent, own = np.searchsorted(names[depth - 1], names[depth] & _mask(depth - 1)), weighed[depth][1]
        ended = above[parent] + mass[parent] * estimate[depth]
        above, mass = above[parent] + mass[parent] * own * estimate[depth], mass[parent] * (1 - own)
        if depth == 1:
            alone[names[1].astype(np.int64)] = ended
    return Model(alone, names[-1], above, mass, ended, tree.where("run IS NOT NULL").select("run", *_SHARES))


_SCORED = "row long, doc_id long, held_out boolean, n_tokens long, known long, part double, score double, words array<binary>, counts array<long>"


def _score(frequent: dict[bytes, int], ends: int):
    def run(docs: pa.Table, scored: pa.Table) -> pa.Table:
        known_runs, log10 = scored.column("run").to_numpy().view(np.uint64), scored.column("log10").to_numpy()
        order = np.argsort(known_runs)
        known_runs, log10 = known_runs[order], log10[order]
        out = []
        for batch, texts in regroup(iter(docs.to_batches()), "text", CHUNK):
            raws = _lowered(texts)
            keys, lengths = runs(raws)
            scores = _sums(keys, lengths, known_runs, log10)
            tokens, known, part, words, counts = [], [], [], [], []
            for raw in raws:
                found = Counter(raw.split())
                here, seen, n = math.log10(ends + 0.5), int(ends > 0), 1
                rare = {}
                for word, times in found.items():
                    n += times
                    c = frequent.get(word)
                    if c is None:
                        rare[word] = times
                    else:
                        here += times * math.log10(c + 0.5)
                        seen += times
                tokens.append(n)
                known.append(seen)
                part.append(here)
                words.append(list(rare))
                counts.append(list(rare.values()))
            arrays = [batch.column(c) for c in ("row", "doc_id", "held_out")]
            arrays += [pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(part, pa.float64()), pa.array(scores, pa.float64())]
            arrays += [pa.array(words, pa.list_(pa.binary())), pa.array(counts, pa.list_(pa.int64()))]
            out.append(pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in _SCORED.split(", ")]))
        return pa.Table.from_batches(out)

    return run


def report(docs: DataFrame, fold: tuple[int, int] = (5, 1), frequent: int = FREQUENT) -> DataFrame:
    """One row per document: its tokens, the base score and the tree's log10 probability.

    Null texts count as empty: only their end is scored.  A null id is in no fold
    and not learned from.  Without training rows every decision has the
    probability 1/2 and no token is known.  Every row is scored by itself, an
    empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("held_out", F.coalesce(crc_mod("doc_id", fold[0]) == fold[1], F.lit(False)))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    # several buckets a chunk, so that few share one; a chunk is one file
    rows = rows.mapInArrow(dealt(SHARED), "chunk long, row long, doc_id long, held_out boolean, text string")
    rows = bucketed(rows, 4 * max(1, -(-size // SHARED)), "chunk")
    learns = F.col("doc_id").isNotNull() & ~F.col("held_out")
    learned = rows.where(learns)
    words = materialize(learned.select("text").mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c")))
    total, kinds = words.agg(F.sum("c"), F.count("*")).first()
    ends = learned.count()
    tokens, kinds = (total or 0) + ends, kinds + int(ends > 0)
    top = {bytes(r[0]): r[1] for r in words.orderBy(F.desc("c"), "word").limit(frequent).collect()}
    needed = rows.select("chunk", learns.alias("learned"), "text").groupBy("chunk").applyInArrow(_chunk_runs, "chunk long, run long, n long")
    needed = compressed(needed)
    model = _fit_tree(learned, needed)
    listed = needed.select("chunk", "run").join(model.scored(), "run")
    both = rows.select("chunk", "row", "doc_id", "held_out", "text").groupBy("chunk").cogroup(listed.groupBy("chunk"))
    scored = materialize(both.applyInArrow(_score(top, ends), _SCORED))
    rare = scored.select("row", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    met = rare.join(words, "word", "left")
    sums = met.groupBy("row").agg(
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("more"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("more_known"),
    )
    # V + 1 kinds share the added halves
    each = math.log10(tokens + 0.5 * (kinds + 1))
    both = scored.drop("words", "counts").join(sums, "row", "left")
    return both.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("part") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * each).alias("base_score"),
        "score",
    )
