"""How filters interact: what each removes in every order, from sorted posting lists.

Every document gets a row number; of each part of the corpus (a source) and range
of consecutive numbers, a posting row keeps one sorted list of failing rows for each
filter and one for each tag.  A part with a third of all documents is just
more ranges.  Within a posting row, the unions over all sets of filters are k-way
merges and what a filter adds to a set is a difference; both gallop: they look for the
next place by doubling steps, so long stretches of one list are copied or skipped whole.
The sizes add up over the ranges, and all orders read the same few sums.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from heapq import heapify, heappop, heapreplace
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hemline.llm.common import chunks
from hemline.session import materialize

#: Rows of a range, as a power of two.
RANGE_BITS = 14
#: Characters that count as capitals, and signs of markup.
CAPITALS, SIGNS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"


def gallop(ids: Sequence[int], wanted: int, begin: int) -> int:
    """First place from ``begin`` on whose id is not below ``wanted``."""
    step, high = 1, begin
    while high < len(ids) and ids[high] < wanted:
        begin = high + 1
        high += step
        step *= 2
    return bisect_left(ids, wanted, begin, min(high, len(ids)))


def union(lists: Sequence[Sequence[int]]) -> list[int]:
    """Sorted union of sorted lists without repeats."""
    heads = [(ids[0], which, 0) for which, ids in enumerate(lists) if ids]
    heapify(heads)
    out: list[int] = []
    while len(heads) > 1:
        _, which, at = heads[0]
        ids = lists[which]
        other = min(heads[1:3])[0]
        stop = gallop(ids, other, at)
        out += ids[at:stop]
        # an id that both lists hold is left to the other one
        stop += stop < len(ids) and ids[stop] == other
        if stop < len(ids):
            heapreplace(heads, (ids[stop], which, stop))
        else:
            heappop(heads)
    for _, which, at in heads:
        out += lists[which][at:]
    return out


def difference(ids: Sequence[int], gone: Sequence[int]) -> list[int]:
    """Sorted ids that ``gone`` does not hold."""
    out: list[int] = []
    at = place = 0
    while at < len(ids):
        place = gallop(gone, ids[at], place)
        if place == len(gone):
            return out + list(ids[at:])
        stop = gallop(ids, gone[place], at)
        out += ids[at:stop]
        at = stop + (stop < len(ids) and ids[stop] == gone[place])
    return out


def common(ids: Sequence[int], others: Sequence[int]) -> int:
    """How many ids both lists hold."""
    found = at = place = 0
    while at < len(ids) and place < len(others):
        place = gallop(others, ids[at], place)
        if place < len(others):
            at = gallop(ids, others[place], at)
            if at < len(ids) and ids[at] == others[place]:
                found, at, place = found + 1, at + 1, place + 1
    return found


def _sizes(filters: int, tags: int):
    """Sizes within each posting row, for every filter and set of filters before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                lists, marked = row["failing"], row["tagged"]
                unions = [union([lists[i] for i in range(filters) if mask >> i & 1]) for mask in range(2**filters)]
                for own in range(filters):
                    for before in range(2**filters):
                        if not before >> own & 1:
                            removed = difference(lists[own], unions[before])
                            lost = [common(removed, ids) for ids in marked]
                            out.append((row["part"], own, before, row["total"], len(lists[own]), len(unions[before | 1 << own]), len(removed), lost))
            columns = list(zip(*out)) if out else [[]] * 8
            kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.list_(pa.int64())]
            names = ["part", "filter", "before", "total", "failing", "gone", "removed", "lost"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return run


def postings(rows: DataFrame, filters: Sequence[str], tags: Sequence[str] = (), bits: int = RANGE_BITS) -> DataFrame:
    """One row per part and range: ``total`` rows, ``failing`` lists by filter and ``tagged`` lists by tag.

    ``rows`` has ``part``, a unique number ``row``, and a boolean column for each filter (true: fails) and tag.
    """
    held = lambda name: F.sort_array(F.collect_list(F.when(F.col(name), F.col("row"))))
    lists = [F.array(*[held(n) for n in names]).cast("array<array<bigint>>").alias(alias) for names, alias in ((filters, "failing"), (tags, "tagged"))]
    return rows.groupBy("part", F.shiftright("row", bits).alias("range")).agg(F.count("*").alias("total"), *lists)


def interactions(lists: DataFrame, filters: Sequence[str], tags: Sequence[str] = ()) -> DataFrame:
    """One row per part, order of the filters and step, from posting lists.

    Counts within the part: ``kept`` after the step, ``removed`` by it,
    ``redundant`` (failing, but removed earlier), ``unique_fails`` (failing this filter only), ``<tag>_lost``
    (removed here and tagged) and ``shapley`` (removed by the filter, summed over all orders).
    """
    k, spark = len(filters), lists.sparkSession
    shape = "part string, filter int, before int, total long, failing long, gone long, removed long, lost array<long>"
    sized = lists.mapInArrow(_sizes(k, len(tags)), shape)
    sums = [F.sum(c).alias(c) for c in ("total", "failing", "gone", "removed")]
    sums += [F.sum(F.get("lost", F.lit(i))).alias(f"{tag}_lost") for i, tag in enumerate(tags)]
    sized = sized.groupBy("part", "filter", "before").agg(*sums)
    # orders that have exactly this set before the filter: its own and the rest's arrangements
    weights = F.array(*[F.lit(factorial(n) * factorial(k - 1 - n)) for n in range(k)])
    alone = F.element_at(F.array(*[F.lit(2**k - 1 - 2**own) for own in range(k)]), F.col("filter") + 1)
    both = Window.partitionBy("part", "filter")
    sized = sized.withColumns(
        {
            "shapley": F.sum(F.col("removed") * F.element_at(weights, F.bit_count("before") + 1)).over(both),
            "unique_fails": F.max(F.when(F.col("before") == alone, F.col("removed"))).over(both),
        }
    )
    steps = [("".join(filters[i] for i in order), n + 1, own, sum(1 << i for i in order[:n])) for order in permutations(range(k)) for n, own in enumerate(order)]
    steps = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, filter int, before int"))  # k * k! rows
    placed = sized.join(steps, ["filter", "before"])
    kept, redundant = F.col("total") - F.col("gone"), F.col("failing") - F.col("removed")
    return placed.select("part", "filter_order", "step", kept.alias("kept"), "removed", redundant.alias("redundant"), "unique_fails", *[f"{t}_lost" for t in tags], "shapley")


def _failures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in chunks(batch):
            flags, digests = [], []
            for text in texts:
                raw = text.encode("utf-8", "replace")
                words = raw.split()  # at ASCII blanks only
                capitals = len(raw) - len(raw.translate(None, CAPITALS))
                signs = len(raw) - len(raw.translate(None, SIGNS))
                flags.append((len(words) < 200, 2 * len(set(words)) < len(words), 100 * capitals > 2 * len(text), signs > 0))
                digests.append(hashlib.sha256(raw).digest())
            own = [pa.array(f, pa.bool_()) for f in zip(*flags)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("part"), *own, pa.array(digests, pa.binary())], ["doc_id", "part", *"ABCD", "digest"])


def document_failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, row, the failures A to E and the tags ``good`` and ``toxic`` of every document.

    A null text is empty, a null source the empty part.  A null id is nobody's
    earlier copy and has none; a repeated id does not precede itself.
    Where labels repeat an id, a tag holds if any row has it.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "text")
    read = read.mapInArrow(_failures, "doc_id long, part string, A boolean, B boolean, C boolean, D boolean, digest binary")
    # numbered once and written, so that the numbers hold when a task is repeated
    read = materialize(read.withColumn("row", F.monotonically_increasing_id()))
    least = read.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last")).where("last > least")
    tags = [F.coalesce(F.bool_or(F.col(c) == 1), F.lit(False)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))]
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*tags).where("doc_id IS NOT NULL AND (good OR toxic)")
    marked = read.join(least.select("digest", "least"), "digest", "left").join(known, "doc_id", "left")
    later = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    return marked.select("part", "row", *"ABCD", later.alias("E"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The interactions of the document filters A to E by source; an empty table gives no rows."""
    tags = ("good", "toxic")
    return interactions(postings(document_failures(docs, labels), "ABCDE", tags), "ABCDE", tags)
