"""Best-fit packing of token sequences with certified bin counts.

Documents become token ids in tasks; only documents longer than a sequence are
cut.  Whole sequences are done.  All other pieces are dealt out to groups of
bounded size by a hash of their row; each group is packed by best-fit decreasing
and compared with a lower bound from dual feasible functions.  A group whose
bins equal its bound is certified and offers its emptiest bin only; the others
keep their full bins and offer all bins with gaps.  What is offered is exchanged:
pooled, dealt out anew to fewer groups, and packed again, until nothing is
offered, the pool stops shrinking, or it is one group.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemline.session import materialize

#: Tokens of a sequence, and the id that ends a document.
CAPACITY, END = 2048, 0
#: Pieces of a group that one task packs at once.
GROUP = 20_000
#: Words that a worker remembers.
CACHED = 1_000_000
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: Fixed value: the letters of the short way in ``_Words``, whose lower case is one letter each and which no normal form changes.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Letters, then signs that are one token's text by themselves (no apostrophe, which may begin an ending).
_PLAIN = re.compile(f"([{_LETTERS}]+)([.,;:!?$%#*()&@+=_~^|/-]*)")


def _byte_letters() -> dict[int, str]:
    """The letters of ``_LETTERS`` as byte-level letters: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    shown = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173}
    hidden = [b for b in range(256) if b not in shown]
    letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(256) if re.match(f"[{_LETTERS}]", chr(c))}


class _Words(dict):
    """Ids of a word as little-endian 32-bit bytes; blanks separate words for the tokenizer.

    A word of letters and signs behind them goes to the tokenizer's merges
    directly, its lower case once for all spellings, where the tokenizer is
    seen to lower-case, to part letters from signs and to work on bytes.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        parts = json.loads(self.tokenizer.to_str())
        steps = [n["type"] for n in (parts["normalizer"] or {}).get("normalizers", [])]
        cuts = (parts["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        pattern = cuts[0].get("pattern", {}).get("Regex", "")
        on_bytes = cuts[-1].get("type") == "ByteLevel" and not cuts[-1].get("add_prefix_space") and not cuts[-1].get("use_regex")
        self.short = steps == ["NFC", "Replace", "Lowercase"] and pattern.endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") and on_bytes
        self.letters = _byte_letters()

    def _keep(self, word: str, value: bytes) -> bytes:
        # long strings are rare and would make the bound on entries useless
        if len(self) < CACHED and len(word) <= 64:
            self[word] = value
        return value

    def _encoded(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        plain = _PLAIN.fullmatch(word) if self.short else None
        if not plain:
            return self._keep(word, self._encoded(word))
        letters, signs = plain.groups()
        low = letters.lower()
        if low != word:
            return self._keep(word, self[low] + (self[signs] if signs else b""))
        merged = self.tokenizer.model.tokenize(low.translate(self.letters))
        return self._keep(word, b"".join([t.id.to_bytes(4, "little") for t in merged]))


@cache
def _words(path: str) -> _Words:
    """One dictionary for all tasks that a worker runs."""
    return _Words(path)


def _cut(path: str, capacity: int):
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(path)
        for batch in batches:
            out = []
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = b"".join([words[w] for w in (text or "").replace("\n", " ").split(" ") if w]) + end
                n = len(ids) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    stop = min(n, start + capacity)
                    out.append((key, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
            cols = list(zip(*out)) or [[]] * 5
            types = (batch.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most ``capacity`` tokens of every document (null text: only the end)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_cut(path, capacity), _PIECES)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The best bound from two families of dual feasible functions.

    For a threshold k, lengths above capacity - k count as whole bins and those
    below k as nothing; and lengths are rounded to multiples of capacity / (k + 1).
    """
    if not len(lengths):
        return 0
    sizes, counts = np.unique(lengths, return_counts=True)
    best = -(-int((sizes * counts).sum()) // capacity)
    for k in range(1, capacity // 2 + 1, max(1, capacity // 256)):
        value = np.where(sizes > capacity - k, capacity, np.where(sizes >= k, sizes, 0))
        best = max(best, -(-int((value * counts).sum()) // capacity))
    for k in range(1, 101):
        whole = sizes * (k + 1) % capacity == 0
        # exact in integers: k * value is sizes * k where whole, floor(sizes * (k + 1) / capacity) * capacity elsewhere
        value = np.where(whole, sizes * k, sizes * (k + 1) // capacity * capacity)
        best = max(best, -(-int((value * counts).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length, and the room left in each bin."""
    bins, offsets, room = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    # bit r is set while some bin has room r: the lowest set bit from a length on is the best fit
    open_rooms = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = open_rooms >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = free[r].pop()
            if not free[r]:
                open_rooms ^= 1 << r
        else:
            r, b = capacity, len(room)
            room.append(capacity)
        bins[i], offsets[i] = b, capacity - r
        r -= n
        room[b] = r
        if r:
            free[r].append(b)
            open_rooms |= 1 << r
    return bins, offsets, np.array(room, np.int64)


def _pack(capacity: int):
    def run(group: pa.Table) -> pa.Table:
        lengths = group.column("length").to_numpy()
        bins, offsets, room = best_fit_decreasing(lengths, capacity)
        certified = len(room) == lower_bound(lengths, capacity)
        # a certified group still gives its emptiest bins, whose rest the group's own bound rounds up
        offered = (room > 0) if not certified else (room > 0) & (room == room.max())
        columns = {
            "row": group.column("row"),
            "length": group.column("length"),
            "part": group.column("part"),
            "bin": pa.array(bins),
            "offset": pa.array(offsets),
            "offered": pa.array(offered[bins]),
        }
        return pa.table(columns)

    return run


_PACKED = "row long, length long, part long, bin long, offset long, offered boolean"


def _round(items: DataFrame, parts: int, nth: int, capacity: int) -> DataFrame:
    """Every group packed; ``row`` and ``length`` in, places and gaps out."""
    dealt = items.withColumn("part", F.pmod(F.xxhash64(F.lit(nth), "row"), F.lit(parts)))
    return materialize(dealt.groupBy("part").applyInArrow(_pack(capacity), _PACKED))


def pack(cut: DataFrame, capacity: int = CAPACITY, group: int = GROUP, rounds: int | None = None) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset`` (place in the sequence, without gaps).

    ``cut`` has a column ``length`` of 1 to ``capacity``; its other columns are
    kept, those named like the added ones are replaced.  ``rounds`` ends the exchange early.  Rows are told apart by
    their number, so repeated rows are separate pieces; an empty table gives no rows.
    """
    # a column of the input may have the name of the rows' own number
    named = {c: "__" + c for c in cut.columns if c.lower() == "row"}
    rows = materialize(cut.drop("sequence_id", "offset").withColumnsRenamed(named).withColumn("row", F.monotonically_increasing_id()))
    whole = rows.where(F.col("length") == capacity).select("row", F.col("row").alias("bin"), F.lit(0).cast("long").alias("offset"), F.lit(0).alias("nth"))
    items = rows.where(F.col("length") < capacity).select("row", "length")
    places = [whole]
    count, nth = items.count(), 1
    while count:
        parts = -(-count // group)
        packed = _round(items, parts, nth, capacity)
        open_rows = 0 if parts == 1 or nth == rounds else packed.where("offered").count()
        # an exchange of all rows would pack the same pool again
        last = open_rows == 0 or open_rows == count
        kept = packed if last else packed.where("NOT offered")
        places.append(kept.select("row", (F.col("part") * (2**40) + F.col("bin")).alias("bin"), "offset", F.lit(nth).alias("nth")))
        if last:
            break
        items, count, nth = packed.where("offered").select("row", "length"), open_rows, nth + 1
    placed = places[0]
    for more in places[1:]:
        placed = placed.unionByName(more)
    # the bin's own number, made unique over rounds
    placed = placed.select("row", (F.col("bin") * (nth + 1) + F.col("nth")).alias("sequence_id"), "offset")
    return rows.join(placed, "row").drop("row").withColumnsRenamed({own: c for c, own in named.items()})


def report(docs: DataFrame, path: str) -> DataFrame:
    """One row per piece of every document with its place."""
    return pack(pieces(docs, path)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
