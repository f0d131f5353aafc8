"""Repeated passages, located by automata of the phrases that recur, and removed but once.

A window is a number of consecutive words.  Of each window the phrase (a shorter run
of words) with the least hash is its seed, so equal windows have equal seeds and
neighbouring windows mostly share theirs.  Seeds that occur once in the corpus
rule their windows out; the others recur.

Documents are dealt out to groups of bounded size, and each group is a shard: the
recurring phrases that occur in it are compiled into its Aho-Corasick
automaton, and all its documents are streamed through that.  A window whose seed is located
becomes a candidate; a group sends each different candidate once, with the first
of its documents that has it.  Over all groups the earliest is found for
each, a group learns which of its windows are not the first, and removes their words.

A frequent phrase is thus one pattern in each group and one row per group, however
many documents hold it, and no automaton grows with the corpus.  The groups are
written once, in buckets, so that neither pass moves the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hemline.llm.common import bucketed, chunks, mix, regroup

#: Words of a window and of a seed phrase.
WINDOW, PHRASE = 20, 10
#: Characters of a group's documents, and those read at once for seeds.
GROUP_CHARS, CHUNK = 8_000_000, 4_000_000
#: Multipliers of two polynomial hashes.
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_NONE = np.uint64(2**64 - 1)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, by doubling."""
    size = 1
    while size * 2 <= width:
        values, size = np.minimum(values[:-size], values[size:]), size * 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if size < width else values


class Words:
    """The words of some documents, one after another, with the hashes of their phrases and windows."""

    def __init__(self, texts: list[str], window: int = WINDOW, phrase: int = PHRASE):
        self.window, self.phrase = window, phrase
        split = [t.encode("utf-8", "replace").split() for t in texts]  # at ASCII blanks only
        self.words = [w for words in split for w in words]
        self.sizes = np.fromiter(map(len, split), np.int64, len(split))
        self.starts = np.cumsum(self.sizes) - self.sizes
        n = max(0, len(self.words) - window + 1)
        #: by window start: whether it lies in one document, and the document
        self.document = np.repeat(np.arange(len(split)), self.sizes)[:n]
        self.inside = np.arange(n) + window <= np.repeat(self.starts + self.sizes, self.sizes)[:n]
        self._hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, len(self.words)) if self.inside.any() else None

    def _runs(self, hashes: np.ndarray, base: np.uint64, width: int) -> np.ndarray:
        out = np.zeros(len(hashes) - width + 1, np.uint64)
        for j in range(width):
            out = out * base + hashes[j : len(out) + j]
        return out

    def seeds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash of the phrase at each place, hash of each window's seed (0 outside), and which places are seeds."""
        places = mix(self._runs(self._hashes, _BASES[0], self.phrase))
        inner = self.window - self.phrase + 1
        least = np.where(self.inside, _least(places, inner), np.uint64(0))
        # a place is a seed if the greatest of the least hashes around it is its own
        padded = np.concatenate([np.zeros(inner - 1, np.uint64), least, np.zeros(inner - 1, np.uint64)])
        return places, least, ~_least(~padded, inner) == places

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """96 bits of each window: a signed long and a signed int."""
        first, second = (mix(self._runs(h, b, self.window)) for h, b in zip((self._hashes, mix(self._hashes)), _BASES))
        return first.view(np.int64), (second >> np.uint64(32)).astype(np.uint32).view(np.int32)

    @property
    def any(self) -> bool:
        return self._hashes is not None


def _dealt(chars: int):
    """Rows of a task in groups of about ``chars`` characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            groups = []
            for text in batch.column("text"):
                more = text.as_buffer().size
                if size and size + more > chars:
                    group, size = group + 1, 0
                size += more
                groups.append(group)
            yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), *batch.columns], ["group", "doc_id", "text"])

    return run


def _seeds(window: int, phrase: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in regroup(batches, "text", CHUNK):
            found = Words(texts, window, phrase)
            if not found.any:
                continue
            places, _, chosen = found.seeds()
            groups = np.repeat(batch.column("group").to_numpy(), found.sizes)[: len(places)]
            for group in np.unique(groups):
                seeds, n = np.unique(places[chosen & (groups == group)], return_counts=True)
                columns = [pa.array(seeds.view(np.int64)), pa.array(np.full(len(seeds), group)), pa.array(n > 1)]
                yield pa.RecordBatch.from_arrays(columns, ["seed", "group", "again"])

    return run


def _automaton(phrases: list[list[bytes]]) -> tuple[ahocorasick.Automaton, dict[bytes, str]]:
    """An automaton of the phrases, and the three letters that stand for each of their words.

    Letters of 256 values keep the branches of a node few.
    """
    codes: dict[bytes, str] = {}
    for words in phrases:
        for w in words:
            if w not in codes:
                n = len(codes) + 1
                codes[w] = chr(n & 255) + chr(n >> 8 & 255) + chr(n >> 16)
    automaton = ahocorasick.Automaton()
    for words in phrases:
        automaton.add_word("".join([codes[w] for w in words]), 0)
    automaton.make_automaton()
    return automaton, codes


def locate(words: list[bytes], phrases: list[list[bytes]], size: int) -> np.ndarray:
    """Places of all occurrences of the phrases, each of ``size`` words."""
    automaton, codes = _automaton(phrases)
    other = "\0\0\0"
    stream = "".join([codes.get(w, other) for w in words])
    ends = np.fromiter((end for end, _ in automaton.iter(stream)), np.int64) + 1
    # a match that begins within a word's letters is none
    return ends[ends % 3 == 0] // 3 - size


def _ordered(docs: pa.Table) -> tuple[pa.Table, list[str]]:
    """Documents by id (unknown last) and text."""
    docs = docs.combine_chunks().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return docs, docs.column("text").to_pylist()


_CANDIDATES = "high long, low int, group long, doc_id long, again boolean"


def _candidates(window: int, phrase: int):
    def run(docs: pa.Table, recurring: pa.Table) -> pa.Table:
        names = [f.split()[0] for f in _CANDIDATES.split(", ")]
        empty = pa.table({n: pa.array([], t) for n, t in zip(names, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()))})
        if not docs.num_rows or not recurring.num_rows:
            return empty
        docs, texts = _ordered(docs)
        found = Words(texts, window, phrase)
        if not found.any:
            return empty
        places, least, chosen = found.seeds()
        at = np.flatnonzero(chosen & np.isin(places, recurring.column("seed").to_numpy().view(np.uint64)))
        at = at[np.unique(places[at], return_index=True)[1]]
        if not len(at):
            return empty
        located = np.full(len(places), _NONE)
        hits = locate(found.words, [found.words[p : p + phrase] for p in at.tolist()], phrase)
        located[hits] = places[hits]
        starts = np.flatnonzero(found.inside & (_least(located, window - phrase + 1) == least))
        high, low = (d[starts] for d in found.digests())
        _, first, n = np.unique(high, return_index=True, return_counts=True)
        group = docs.column("group")[0].as_py()
        ids = docs.column("doc_id").take(pa.array(found.document[starts[first]]))
        return pa.table(dict(zip(names, (high[first], low[first], np.full(len(first), group), ids, n > 1))))

    return run


def _kept(window: int, phrase: int):
    def run(docs: pa.Table, repeated: pa.Table) -> pa.Table:
        docs, texts = _ordered(docs)
        found = Words(texts, window, phrase)
        covered = np.zeros(len(found.words) + 1, np.int64)
        if repeated.num_rows and found.any:
            repeated = repeated.sort_by("high").combine_chunks()
            high, low, gone = (repeated.column(c).to_numpy() for c in ("high", "low", "gone"))
            mine, also = found.digests()
            place = np.minimum(np.searchsorted(high, mine), len(high) - 1)
            starts = np.flatnonzero(found.inside & (high[place] == mine) & (low[place] == also))
            place = place[starts]
            # of a window that is first here, the first stays
            stays = np.zeros(len(starts), bool)
            stays[np.unique(place, return_index=True)[1]] = True
            starts = starts[~stays | gone[place]]
            np.add.at(covered, starts, 1)
            np.add.at(covered, starts + window, -1)
        out = np.cumsum(covered)[:-1] > 0
        removed, kept = [], []
        for begin, size in zip(found.starts.tolist(), found.sizes.tolist()):
            mask = out[begin : begin + size]
            n, words = int(mask.sum()), found.words[begin : begin + size]
            removed.append(n)
            kept.append(b" ".join([w for w, m in zip(words, mask.tolist()) if not m] if n else words).decode())
        columns = (docs.column("doc_id"), found.sizes, pa.array(removed, pa.int64()), pa.array(kept, pa.string()))
        return pa.table(dict(zip(("doc_id", "n_words", "n_removed", "kept"), columns)))

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, group_chars: int = GROUP_CHARS) -> DataFrame:
    """doc_id, n_words, n_removed and the ``kept`` words of every document, joined by one blank.

    Removed is each word in a window of ``window`` words that starts earlier too:
    in a document of a smaller id, or before in the same one.  Windows are those of
    the texts as given.  Unknown ids come last; rows of one id are documents of their own, in the order
    of their groups and texts.  A null text has no words, a text shorter than a window keeps
    all; an empty table gives no rows.  A task holds a group's texts, at least one text whole.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    buckets = -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 1) // group_chars)
    rows = bucketed(rows.mapInArrow(_dealt(group_chars), "group long, doc_id long, text string"), buckets, "group")
    seeds = rows.mapInArrow(_seeds(window, phrase), "seed long, group long, again boolean")
    # a seed has at most a few rows for each group
    often = F.count("*").over(Window.partitionBy("seed"))
    recurring = seeds.withColumn("n", often).where("n > 1 OR again").select("group", "seed")
    found = rows.groupBy("group").cogroup(recurring.groupBy("group")).applyInArrow(_candidates(window, phrase), _CANDIDATES)
    equal = Window.partitionBy("high", "low")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "group")
    judged = found.select("*", F.count("*").over(equal).alias("n"), (place != F.min(place).over(equal)).alias("gone"))
    repeated = judged.where("again OR gone").select("group", "high", "low", "gone")
    return rows.groupBy("group").cogroup(repeated.groupBy("group")).applyInArrow(_kept(window, phrase), "doc_id long, n_words long, n_removed long, kept string")
