"""Shards of near-equal bytes by histogram sort, with DataFrame functions only.

The rows get a 48-digit hexadecimal key: hash of the text, hash of the id, row
number.  Exact bytes and rows below candidate key boundaries (prefixes of the
key) are counted over all partitions; the cells that hold a wanted splitter and
are larger than the tolerance are probed again with longer prefixes, until every
splitter lies within the tolerance of its target.  One exchange then moves each
row to its place.

Equal texts are neighbours in key order, and a group smaller than the tolerance
is never split; a larger one is, by ids and then by rows, so that one group
with a third of all rows neither unbalances the shards nor meets in one task.
Besides the shard splitters, splitters by row count cut the work of numbering
the slots into pieces of near-equal rows.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hemline.session import materialize

#: Bytes that a row counts besides its text.
ROW_BYTES = 16
#: Columns that the operator adds; input columns of these names are replaced.
ADDED = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
_FIRST = 3


@dataclass
class Cell:
    """Rows whose key starts with ``prefix``; all of them agree in ``known`` digits."""

    prefix: str
    rows: int
    size: int
    known: int


def _hex(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = {
        "__k1": F.xxhash64(text),
        "__k2": F.xxhash64(F.lit(7), F.col("doc_id").cast("string")),
        "__k3": F.monotonically_increasing_id(),
    }
    keyed = docs.drop(*ADDED).withColumns(parts)
    return keyed.withColumns(
        {
            "__key": F.concat(*[_hex(F.col(c)) for c in parts]),
            "size": F.octet_length(text).cast("long") + ROW_BYTES,
            "text_crc32": F.crc32(text.cast("binary")),
        }
    )


def _agreement(low: list[int], high: list[int]) -> int:
    """Leading key digits shared by all rows between the two extremes of the three parts."""
    for i, (a, b) in enumerate(zip(low, high)):
        if a != b:
            differ = (a & (2**64 - 1)) ^ (b & (2**64 - 1))
            return 16 * i + (64 - differ.bit_length()) // 4
    return 48


def _count(keyed: DataFrame, child: Column) -> list[Cell]:
    """Exact rows and bytes of every cell."""
    sums = [F.count("*").alias("rows"), F.sum("size").alias("bytes")]
    ends = [f(c).alias(f"{f.__name__}{c}") for f in (F.min, F.max) for c in ("__k1", "__k2", "__k3")]
    counted = keyed.groupBy(child.alias("prefix")).agg(*sums, *ends).where("prefix IS NOT NULL")
    return sorted(
        (Cell(r[0], r[1], r[2], max(len(r[0]), _agreement(r[3:6], r[6:9]))) for r in counted.collect()),
        key=lambda c: c.prefix,
    )


def _probe(keyed: DataFrame, cells: list[Cell]) -> list[Cell]:
    """The cells cut two digits beyond what their rows agree in."""
    child = F.lit(None).cast("string")
    for length, known in sorted({(len(c.prefix), c.known) for c in cells}):
        wanted = ",".join(f"'{c.prefix}'" for c in cells if (len(c.prefix), c.known) == (length, known))
        child = F.when(F.expr(f"substring(__key, 1, {length}) IN ({wanted})"), F.expr(f"substring(__key, 1, {known + 2})")).otherwise(child)
    return _count(keyed, child)


class _Target:
    """A position in the running total of one measure, and how close a splitter must come."""

    def __init__(self, at: float, tolerance: float, measure: str):
        self.at, self.tolerance, self.measure = at, tolerance, measure


def _sums(cells: list[Cell], measure: str) -> list[int]:
    out = [0]
    for c in cells:
        out.append(out[-1] + getattr(c, measure))
    return out


def _edge(sums: list[int], target: _Target) -> tuple[int, float, int]:
    """The cell edge nearest to the target, its distance, and the cell around the target."""
    i = bisect_left(sums, target.at)
    if i == len(sums):
        return len(sums) - 1, 0.0, len(sums) - 2
    around = max(0, i - 1)
    near = i if i == 0 or sums[i] - target.at <= target.at - sums[i - 1] else i - 1
    return near, abs(sums[near] - target.at), around


def find_splitters(keyed: DataFrame, shards: int, tolerance: float, pieces: int) -> tuple[list[Cell], list[int], list[int]]:
    """Cells with exact counts, and the cell edges that split shards and pieces.

    At most 4,096 cells come from the first pass, and at most 256 for each
    open target from a later one; both bounds hold for any number of rows.
    """
    cells = _count(keyed, F.expr(f"substring(__key, 1, {_FIRST})"))
    total, rows = sum(c.size for c in cells), sum(c.rows for c in cells)
    targets = [_Target(total * i / shards, total * tolerance / shards, "size") for i in range(1, shards)]
    targets += [_Target(rows * i / pieces, rows / pieces / 4, "rows") for i in range(1, pieces)]
    while True:
        sums = {m: _sums(cells, m) for m in ("size", "rows")}
        found = [(t, *_edge(sums[t.measure], t)) for t in targets] if cells else []
        open_cells = {around for t, _, far, around in found if far > t.tolerance and cells[around].rows > 1 and cells[around].known < 48}
        if not open_cells:
            break
        finer = _probe(keyed, [cells[i] for i in sorted(open_cells)])
        cells = sorted([c for i, c in enumerate(cells) if i not in open_cells] + finer, key=lambda c: c.prefix)
    edges = [edge for _, edge, _, _ in found]
    return cells, edges[: shards - 1], edges[shards - 1 :]


def _numbers(values: list[int], kind: str = "int") -> Column:
    """A constant array, built by the optimizer once."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def shard_documents(docs: DataFrame, shards: int = 40, tolerance: float = 0.005, pieces: int = 1024) -> DataFrame:
    """Documents with ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard``.

    The law is ``bytes``: every splitter lies within ``tolerance`` times the mean
    shard of its target, or at the nearer end of the row there if that row is
    larger.  A null text counts as no bytes and has the checksum of an empty
    one, null ids share one hash, repeated rows are told apart by their row
    number, an empty table gives no rows.  Columns named like the added ones
    are replaced, all others are kept.
    """
    keyed = materialize(_keyed(docs))
    cells, shard_edges, piece_edges = find_splitters(keyed, shards, tolerance, pieces)
    rows = _sums(cells, "rows")
    starts = sorted({0, *shard_edges, *piece_edges} - {len(cells)})
    shard_of = [sum(e <= s for e in shard_edges) for s in starts]
    first_row = [0, *[rows[e] for e in shard_edges]]
    offsets = [rows[s] - first_row[n] for s, n in zip(starts, shard_of)]
    bounds = [cells[s].prefix for s in starts[1:]]
    heads = [int(b[:_FIRST], 16) for b in bounds]
    below = [bisect_left(heads, h) for h in range(16**_FIRST + 1)]
    head = F.conv(F.substring("__key", 1, _FIRST), 16, 10).cast("int")
    # only the bounds that share the key's first digits need comparing
    here = F.slice(
        F.split(F.lit(",".join(bounds)), ","),
        F.element_at(_numbers(below), head + 1) + 1,
        F.element_at(_numbers([b - a for a, b in zip(below, below[1:])]), head + 1),
    )
    piece = F.element_at(_numbers(below), head + 1) + F.size(F.filter(here, lambda b: b <= F.col("__key")))
    order = Window.partitionBy("__piece").orderBy("__key")
    placed = keyed.withColumn("__piece", piece).withColumns(
        {
            "law": F.lit("bytes"),
            "shard": F.element_at(_numbers(shard_of or [0]), F.col("__piece") + 1),
            "slot": F.element_at(_numbers(offsets or [0], "bigint"), F.col("__piece") + 1) + F.row_number().over(order) - 1,
            "grown_shard": F.lit(None).cast("int"),
        }
    )
    return placed.drop("__k1", "__k2", "__k3", "__key", "__piece")
