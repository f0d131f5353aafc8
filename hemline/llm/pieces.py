"""SentencePiece encoding and decoding over a relational lattice.

Texts become words that begin with the blank mark, and words are cut between two
characters that no piece holds beside each other; no piece crosses their borders.  The corpus's different words are exploded into substrings of at most
the longest piece's length, which are joined to the piece table; the edges that
match are grouped by word.  A higher-order aggregate folds each lattice to the
word's pieces.  Texts then get their ids from the dictionary of their chunk: the tasks that
read the documents deal them to chunks and write them in buckets of chunks, so that texts
are never shuffled; the chunks' words travel once to the lattices, and back as packed tables.  Decoding looks up the bytes of every id in the piece table.

Two folds share the lattice: ``viterbi`` takes the path of the highest total
score, as unigram models do; ``merges`` joins the best neighbouring pair again
and again, as models of byte-pair kind do, and is what gives their library ids.  It passes over a word's edges
once, in the order of their ranks; only words with a piece that may become a pair too late for that are joined step by step.
Words that are longer than ``LONGEST`` after the cuts go to the library, whose cost does not
grow with the square of their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hemline.llm.common import bucketed, compressed, dealt

#: The mark for a blank, and the longest word that is folded.
MARK, LONGEST = "▁", 24
#: Bytes of text, about, that share a dictionary, and that a task handles at once; different words, about, in a task of the lattice.
CHUNK_CHARS, SLICE, LATTICE_WORDS = 36_000_000, 4_000_000, 20_000
#: Words cut at once, and rows of the dictionaries packed at once.
CUT_WORDS, PACKED_ROWS = 100_000, 200_000
#: A control character, which no piece holds beside another.
_APART = "\x01"
_EDGE = "array<struct<rank:int,begin:int,stop:int,id:int,score:double>>"
#: Places in the number of an edge: a single character, rank (25 bits), begin and stop (5 bits each, so ``LONGEST`` is below 32), a late piece, id (26 bits).
_SINGLE, _RANK, _BEGIN, _STOP, _LATE = 62, 37, 32, 27, 26


def piece_table(spark: SparkSession, path: str) -> tuple[DataFrame, int, int]:
    """Pieces (piece, rank, id, score, late), the id of the first byte piece, and the longest piece's length.

    A model has a fixed vocabulary, so the table is as small as its file.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    ranked = sorted(plain, key=lambda i: (-model.get_score(i), i))
    late = late_pieces([model.id_to_piece(i) for i in ranked])
    rows = [(p := model.id_to_piece(i), r, i, float(model.get_score(i)), p in late) for r, i in enumerate(ranked)]
    first = next((i for i in range(model.vocab_size()) if model.is_byte(i)), model.unk_id())
    return spark.createDataFrame(rows, "piece string, rank int, id int, score double, late boolean"), first, max(len(r[0]) for r in rows)


def late_pieces(ranked: list[str]) -> frozenset[str]:
    """Pieces that become a pair only by a join that ranks behind them.

    While both ends of a piece are borders, what is joined within does not depend on what is beside it.
    So pairs are met in the order of their ranks in every word without such a piece.
    """
    ranks = {p: r for r, p in enumerate(ranked)}
    late = set()
    for piece, rank in ranks.items():
        borders, last = [*range(len(piece) + 1)], -1
        while len(borders) > 3:
            joined, at = min((ranks.get(piece[a:b], len(ranks)), i) for i, (a, b) in enumerate(zip(borders, borders[2:])))
            if joined == len(ranks):
                break
            del borders[at + 1]
            last = joined
        if len(borders) == 3 and last > rank:
            late.add(piece)
    return frozenset(late)


def words_of(text: Column) -> Column:
    """The words of a text, each with the marks before it; an empty text has none."""
    marked = F.concat(F.lit(MARK), F.regexp_replace(text, " ", MARK))
    return F.when(F.length(text) > 0, F.regexp_extract_all(marked, F.lit(f"{MARK}+[^{MARK}]*"), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _met(words: DataFrame, pieces: DataFrame, longest_piece: int, *names: str) -> DataFrame:
    """``word``, ``begin`` and ``size`` of its substrings that are pieces (``found``), with these columns of theirs, and of its characters."""
    begins = F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("begin")
    lengths = F.explode(F.sequence(F.lit(1), F.least(F.lit(longest_piece), F.length("word") - F.col("begin")))).alias("size")
    cut = words.select("word", begins).select("word", "begin", lengths)
    cut = cut.withColumn("piece", F.substring("word", F.col("begin") + 1, F.col("size")))
    # the piece table is bounded by the model's vocabulary; it is met by a number, which is faster, and then compared
    keyed = pieces.select(F.xxhash64("piece").alias("key"), F.col("piece").alias("held"), *names)
    found = F.coalesce(F.col("held") == F.col("piece"), F.lit(False))
    # a word's characters stay, so that one without any piece does
    met = cut.withColumn("key", F.xxhash64("piece")).join(F.broadcast(keyed), "key", "left").where((F.col("size") == 1) | found)
    return met.select("word", "begin", "size", found.alias("found"), *names)


def lattice(words: DataFrame, pieces: DataFrame, longest_piece: int) -> DataFrame:
    """``word`` with ``edges``: all pieces within it, the best ranked first and equal ones by place."""
    met = _met(words, pieces, longest_piece, "rank", "id", "score")
    edge = F.struct("rank", "begin", (F.col("begin") + F.col("size")).alias("stop"), "id", "score")
    return met.groupBy("word").agg(F.sort_array(F.collect_list(F.when(F.col("found"), edge)).cast(_EDGE)).alias("edges"))


def numbered_lattice(words: DataFrame, pieces: DataFrame, longest_piece: int) -> DataFrame:
    """As ``lattice``, without scores: an edge is a number, which is collected and sorted faster, and single characters come last."""
    place = lambda flag, bit: F.when(flag, F.lit(1 << bit)).otherwise(F.lit(0))
    code = place(F.length("piece") == 1, _SINGLE) + F.col("rank") * F.lit(1 << _RANK) + place(F.col("late"), _LATE) + F.col("id")
    met = _met(words, pieces.withColumn("code", code), longest_piece, "code")
    begin, size = F.col("begin").cast("long"), F.col("size").cast("long")
    edge = F.col("code") + begin * F.lit(1 << _BEGIN) + (begin + size) * F.lit(1 << _STOP)
    return met.groupBy("word").agg(F.sort_array(F.collect_list(F.when(F.col("found"), edge))).alias("edges"))


def _field(edge: Column, place: int, bits: int) -> Column:
    """A field of an edge's number."""
    return F.shiftright(edge, place).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


def _unnumbered(edges: Column) -> Column:
    """Edges in columns."""
    return F.transform(edges, lambda e: F.struct(_field(e, _BEGIN, 5).alias("begin"), _field(e, _STOP, 5).alias("stop"), _field(e, 0, _LATE).alias("id")))


def _bits(count: Column) -> Column:
    """The lowest ``count`` bits."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), count) - 1


def _merged(word: Column, edges: Column) -> Column:
    """Borders of the pieces when the best-ranked, leftmost neighbouring pair is joined until none is a piece.

    The borders are the bits of a number.  A piece is a pair while both its ends are borders and one
    border lies within; pieces that have lost an end, or hold no border any more, leave the list.
    """

    def inside(e: Column) -> Column:
        return _bits(e["stop"]) - _bits(e["begin"] + 1)

    def alive(mask: Column, e: Column) -> Column:
        return (mask.bitwiseAND(e["ends"]) == e["ends"]) & (mask.bitwiseAND(e["inside"]) != 0)

    def step(state: Column, _: Column) -> Column:
        mask, left = state["mask"], state["left"]
        pairs = F.filter(left, lambda e: F.bit_count(mask.bitwiseAND(e["inside"])) == 1)

        def join(e: Column) -> Column:
            joined = mask.bitwiseAND(F.bitwise_not(e["inside"]))
            return F.when(e.isNull(), F.struct(mask.alias("mask"), F.slice(left, 1, 0).alias("left"))).otherwise(
                F.struct(joined.alias("mask"), F.filter(left, lambda o: alive(joined, o)).alias("left"))
            )

        # a list of one binds the best pair, which is otherwise searched for at each use
        return F.when(F.size(left) == 0, state).otherwise(F.get(F.transform(F.array(F.get(pairs, 0)), join), 0))

    ends = lambda e: _bits(e["begin"] + 1) - _bits(e["begin"]) + _bits(e["stop"] + 1) - _bits(e["stop"])
    longer = F.filter(edges, lambda e: e["stop"] - e["begin"] > 1)
    start = F.struct(_bits(F.length(word) + 1).alias("mask"), F.transform(longer, lambda e: F.struct(ends(e).alias("ends"), inside(e).alias("inside"))).alias("left"))
    places = F.sequence(F.lit(0), F.length(word))
    mask = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(word) - 1, F.lit(1))), start, step, lambda s: s["mask"])
    return F.get(F.transform(F.array(mask), lambda m: F.filter(places, lambda i: F.getbit(m, i) == 1)), 0)


def _merged_once(word: Column, edges: Column) -> Column:
    """Borders that ``_merged`` leaves, as the bits of a number, in one pass over numbered edges; right where none is late."""

    def step(mask: Column, e: Column) -> Column:
        begin, stop = _field(e, _BEGIN, 5), _field(e, _STOP, 5)
        inside = _bits(stop) - _bits(begin + 1)
        pair = (F.getbit(mask, begin) == 1) & (F.getbit(mask, stop) == 1) & (F.bit_count(mask.bitwiseAND(inside)) == 1)
        return F.when(pair, mask.bitwiseAND(F.bitwise_not(inside))).otherwise(mask)

    return F.aggregate(F.filter(edges, lambda e: e < F.lit(1 << _SINGLE)), _bits(F.length(word) + 1), step)


def _bound(value: Column, use) -> Column:
    """``use`` of a value, which a list of one binds; it is otherwise found again at each use."""
    return F.get(F.transform(F.array(value), use), 0)


def _merged_ids(word: Column, edges: Column, first_byte: int) -> Column:
    """Ids of a word from its numbered edges: joined in one pass, or one by one where a piece is late."""
    late = F.exists(edges, lambda e: F.getbit(e, F.lit(_LATE)) == 1)

    def between(borders: Column) -> Column:
        return _bound(borders, lambda b: _bound(_unnumbered(edges), lambda c: _ids(word, c, b, first_byte)))

    def ids(mask: Column) -> Column:
        def kept(e: Column) -> Column:
            begin, stop = _field(e, _BEGIN, 5), _field(e, _STOP, 5)
            return (F.getbit(mask, begin) == 1) & (F.getbit(mask, stop) == 1) & (mask.bitwiseAND(_bits(stop) - _bits(begin + 1)) == 0)

        # the pieces that are left, by their places; a character without a piece is not among them
        parts = F.sort_array(F.transform(F.filter(edges, kept), lambda e: e.bitwiseAND(F.lit((1 << _RANK) - 1))))
        borders = F.filter(F.sequence(F.lit(0), F.length(word)), lambda i: F.getbit(mask, i) == 1)
        return _bound(parts, lambda p: F.when(F.size(p) == F.bit_count(mask) - 1, F.transform(p, lambda e: _field(e, 0, _LATE))).otherwise(between(borders)))

    return F.when(late, between(_bound(_unnumbered(edges), lambda c: _merged(word, c)))).otherwise(_bound(_merged_once(word, edges), ids))


def _best_path(word: Column, edges: Column, missing: float = -1e6) -> Column:
    """Borders of the path with the highest total score; a character without a piece costs ``missing``."""
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.array(F.lit(0)).alias("path")))

    def step(best: Column, stop: Column) -> Column:
        ways = F.transform(
            F.filter(edges, lambda e: e["stop"] == stop),
            lambda e: F.struct((F.get(best, e["begin"])["score"] + e["score"]).alias("score"), F.get(best, e["begin"])["path"].alias("path")),
        )
        alone = F.get(best, stop - 1)
        ways = F.concat(ways, F.array(F.struct((alone["score"] + missing).alias("score"), alone["path"].alias("path"))))
        top = F.array_max(ways)
        return F.concat(best, F.array(F.struct(top["score"].alias("score"), F.concat(top["path"], F.array(stop)).alias("path"))))

    return F.aggregate(F.sequence(F.lit(1), F.length(word)), start, step, lambda s: F.element_at(s, -1)["path"])


def _ids(word: Column, edges: Column, borders: Column, first_byte: int) -> Column:
    """Ids between the borders; a character without a piece becomes its UTF-8 bytes."""

    def part(begin: Column, i: Column) -> Column:
        stop = F.get(borders, i + 1)
        found = F.get(F.filter(edges, lambda e: (e["begin"] == begin) & (e["stop"] == stop)), 0)["id"]
        raw = F.hex(F.encode(F.substring(word, begin + 1, stop - begin), "UTF-8"))
        octets = F.transform(F.sequence(F.lit(1), (F.length(raw) / 2).cast("int")), lambda j: F.conv(F.substring(raw, j * 2 - 1, F.lit(2)), 16, 10).cast("int") + first_byte)
        return F.get(F.transform(F.array(found), lambda n: F.when(n.isNotNull(), F.array(n)).otherwise(octets)), 0)

    inner = F.slice(borders, F.lit(1), F.size(borders) - 1)
    return F.flatten(F.transform(inner, part))


def _library(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model, before = None, 0
        for batch in batches:
            if model is None:
                model = sentencepiece.SentencePieceProcessor(model_file=path)
                # a word has its own mark, or is cut from one that has: the library's mark goes before a character that no piece holds
                before = len(model.encode(_APART))
            words = batch.column("word").to_pylist()
            ids = [model.encode(_APART + w.replace(MARK, " "))[before:] for w in words]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(ids, pa.list_(pa.int32()))], ["word", "ids"])

    return run


def encode_words(words: DataFrame, path: str, fold: str = "merges") -> DataFrame:
    """``word`` and ``ids`` of different words, each with the marks that it has."""
    table, first, longest_piece = piece_table(words.sparkSession, path)
    short = words.where(F.length("word") <= LONGEST)
    if fold == "merges":
        folded = numbered_lattice(short, table, longest_piece).select("word", _merged_ids(F.col("word"), F.col("edges"), first).alias("ids"))
    else:
        edged = lattice(short, table, longest_piece)
        # a list of one binds the borders, which are otherwise folded again at each use
        ids = F.get(F.transform(F.array(_best_path(F.col("word"), F.col("edges"))), lambda b: _ids(F.col("word"), F.col("edges"), b, first)), 0)
        folded = edged.select("word", ids.alias("ids"))
    long = words.where(F.length("word") > LONGEST).mapInArrow(_library(path), "word string, ids array<int>")
    return folded.unionByName(long)


_ENCODED = "doc_id long, ids array<int>, text string"


def _whole(array: pa.ChunkedArray | pa.Array) -> pa.Array:
    """One array of all rows."""
    return pa.concat_arrays(array.chunks) if isinstance(array, pa.ChunkedArray) and array.num_chunks else pa.array(array, array.type)


def _numbered(texts: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Different words of some texts, the number of each word of the texts in their order, and where each text's begin.

    A word is its blanks, one more at a text's beginning, and what follows them; blanks at a text's end are one.
    """
    texts = _whole(texts)
    split = pc.split_pattern(pc.replace_substring(texts, MARK, " "), " ")
    at, coded = split.offsets.to_numpy().astype(np.int64), split.values.dictionary_encode()
    codes, kinds = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    held = pc.not_equal(kinds, "").to_numpy(zero_copy_only=False)[codes]
    last = np.zeros(len(codes), bool)
    last[at[1:] - 1] = True
    # the place before a word's first blank: the last word's, or the one before the text
    before = np.maximum.accumulate(np.concatenate([[-1], np.where(held, np.arange(len(codes)), -1)[:-1]])) if len(codes) else codes
    marks = np.arange(len(codes)) - np.maximum(before, np.repeat(at[:-1], np.diff(at)) - 1)
    empty = np.repeat(pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), np.diff(at))
    words = (held | last) & ~empty
    codes, marks = codes[words], marks[words]
    several = np.flatnonzero(marks > 1)
    wide, inverse = np.unique(codes[several] << 32 | marks[several], return_inverse=True)
    codes[several] = len(kinds) + inverse
    repeated = pc.binary_repeat(pa.scalar(MARK), pa.array(wide & 0xFFFFFFFF))
    listed = pa.concat_arrays([pc.binary_join_element_wise(MARK, kinds, ""), pc.binary_join_element_wise(repeated, kinds.take(pa.array(wide >> 32)), "")])
    # only those that occur as such
    used = np.bincount(codes, minlength=len(listed)) > 0
    place = np.cumsum(used) - 1
    return listed.filter(pa.array(used)), place[codes].astype(np.int32), np.concatenate([[0], np.cumsum(words)])[at]


def _slices(docs: pa.Table) -> Iterator[pa.Table]:
    """Rows that follow each other, of about ``SLICE`` bytes of text; a text is never cut."""
    sizes = np.cumsum(pc.binary_length(docs.column("text")).to_numpy().astype(np.int64))
    begin, done = 0, 0
    while begin < len(sizes):
        stop = max(begin + 1, int(np.searchsorted(sizes, done + SLICE, "right")))
        yield docs.slice(begin, stop - begin)
        begin, done = stop, sizes[stop - 1]


def beside(path: str) -> frozenset[str]:
    """Pairs of neighbouring characters in the pieces: as bounded as the vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = (model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unused(i)))
    return frozenset(p[j : j + 2] for p in plain for j in range(len(p) - 1))


def _cutter(pairs: frozenset[str]):
    """Function of words to their parts, between which no piece can lie, and to where each word's begin.

    Pairs are looked up by a hash: where two share a place a border is missed, which changes no id.
    """
    place = lambda first, second: (first * np.uint32(0x9E3779B1) + second * np.uint32(0x85EBCA6B)) >> np.uint32(10)
    together = np.zeros(1 << 22, bool)
    listed = np.frombuffer("".join(pairs).encode("utf-32-le"), np.uint32)
    together[place(listed[::2], listed[1::2])] = True

    def some(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
        raw, ends = words.buffers()[2][at[0] : at[-1]].to_pybytes(), at - at[0]
        points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        octets = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
        first = np.ones(len(points), bool)
        first[1:] = ~together[place(points[:-1], points[1:])]
        opened = np.searchsorted(octets, ends[:-1])
        first[opened] = True
        borders = np.append(octets[first], len(raw)).astype(np.int32)
        parts = pa.StringArray.from_buffers(len(borders) - 1, pa.py_buffer(borders), pa.py_buffer(raw))
        return parts, np.cumsum(first)[opened] - 1

    def cut(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        lists, begins, done = [pa.array([], pa.string())], [], 0
        for begin in range(0, len(words), CUT_WORDS):
            parts, opened = some(words.slice(begin, CUT_WORDS))
            lists.append(parts)
            begins.append(done + opened)
            done += len(parts)
        return pa.concat_arrays(lists), np.concatenate([*begins, [done]]).astype(np.int64)

    return cut


def _words(pairs: frozenset[str]):
    def run(group: pa.Table) -> pa.Table:
        """The different parts of a chunk's words."""
        words = pc.unique(pa.chunked_array([_numbered(docs.column("text"))[0] for docs in _slices(group)], pa.string()))
        parts = pc.unique(_cutter(pairs)(words)[0])
        return pa.table({"chunk": pa.array(np.full(len(parts), group.column("chunk")[0].as_py(), np.int64)), "word": parts})

    return run


def _gather(flat: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists ``rows`` of a flat array with its offsets, one behind the other, and their offsets."""
    sizes = at[rows + 1] - at[rows]
    stops = np.concatenate([[0], np.cumsum(sizes)])
    return flat[np.repeat(at[rows] - stops[:-1], sizes) + np.arange(stops[-1])], stops


_PACKED = "chunk long, packed binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, word, ids) of a task as one compressed table for each chunk, which shuffles in a third of the space."""

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks().sort_by("chunk")
        chunks, begins = np.unique(rows.column("chunk").to_numpy(), return_index=True)
        blobs = []
        for begin, stop in zip(begins, [*begins[1:], len(rows)]):
            sink = pa.BufferOutputStream()
            part = rows.slice(begin, stop - begin).select(["word", "ids"])
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(part.combine_chunks())
            blobs.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(blobs, pa.binary())], ["chunk", "packed"])

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= PACKED_ROWS:
            yield packed(held)
            held, size = [], 0
    if size:
        yield packed(held)


def _unpacked(blobs: pa.ChunkedArray) -> pa.Table:
    """The rows (word, ids) of some packed tables."""
    tables = [pa.ipc.open_stream(b.as_buffer()).read_all() for b in blobs]
    return pa.concat_tables(tables) if tables else pa.table({"word": pa.array([], pa.string()), "ids": pa.array([], pa.list_(pa.int32()))})


def _apply(pairs: frozenset[str]):
    def run(docs: pa.Table, dictionary: pa.Table) -> pa.Table:
        """Ids of a chunk's texts from its dictionary."""
        dictionary = _unpacked(dictionary.column("packed"))
        listed = _whole(dictionary.column("ids"))
        numbered = [_numbered(some.column("text")) for some in _slices(docs)]
        coded = _whole(pa.chunked_array([words for words, _, _ in numbered], pa.string())).dictionary_encode()
        parts, begins = _cutter(pairs)(coded.dictionary)
        found = pc.index_in(parts, value_set=_whole(dictionary.column("word"))).to_numpy()
        flat, ends = _gather(listed.values.to_numpy(), listed.offsets.to_numpy().astype(np.int64), found)
        ends, lists, done = ends[begins], [], 0
        for words, numbers, at in numbered:
            ids, stops = _gather(flat, ends, coded.indices.to_numpy()[done + numbers])
            lists.append(pa.ListArray.from_arrays(pa.array(stops[at].astype(np.int32)), pa.array(ids, pa.int32())))
            done += len(words)
        return pa.table({"doc_id": docs.column("doc_id"), "ids": pa.chunked_array(lists, pa.list_(pa.int32())), "text": docs.column("text")})

    return run


def encode(docs: DataFrame, path: str, fold: str = "merges", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """doc_id, ids and text of every document; its other columns are left out.

    A null text is treated as empty and has no ids.  A row with a null id and a
    repeated row are encoded like any other; an empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # several buckets a chunk, so that few share one; a chunk is one file, and a task reads about one, however small the input's splits are
    chunks = max(1, -(-size // chunk_chars))
    rows = bucketed(rows.coalesce(chunks + chunks // 4).mapInArrow(dealt(chunk_chars), "chunk long, doc_id long, text string"), 4 * chunks, "chunk")
    pairs = beside(path)
    needed = compressed(rows.groupBy("chunk").applyInArrow(_words(pairs), "chunk long, word string"))
    # a task's lattices stay small: a word has many edges
    parts = max(1, -(-needed.agg(F.approx_count_distinct("word")).first()[0] // LATTICE_WORDS))
    # the chunks' words travel once to their bucket, where the lattices are folded and their ids join them
    spread = bucketed(needed.repartition(parts, "word").sortWithinPartitions("word"), parts, "word")
    encoded = bucketed(encode_words(spread.select("word").distinct(), path, fold), parts, "word")
    dictionary = spread.join(encoded, "word").select("chunk", "word", "ids").mapInArrow(_pack, _PACKED)
    return rows.groupBy("chunk").cogroup(dictionary.groupBy("chunk")).applyInArrow(_apply(pairs), _ENCODED)


def piece_bytes(path: str) -> list[str]:
    """The bytes of every id in hexadecimal; control pieces have none."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def octets(i: int) -> str:
        if model.is_control(i) or model.is_unused(i):
            return ""
        if model.is_byte(i):
            return model.id_to_piece(i)[3:5]
        return (" \u2047 " if model.is_unknown(i) else model.id_to_piece(i).replace(MARK, " ")).encode().hex()

    return [octets(i) for i in range(model.vocab_size())]


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with a column ``decoded``, which replaces one of that name; null or no ids give an empty text.

    The piece table, bounded by the vocabulary, is a constant that ids index;
    the blank before the first word is taken off.
    """
    table = F.split(F.lit(",".join(piece_bytes(path))), ",")
    raw = F.unhex(F.array_join(F.transform(F.coalesce("ids", F.array().cast("array<int>")), lambda i: F.get(table, i)), "")).cast("string")
    # a list of one binds the text, which is otherwise joined again at each use
    inner = lambda r: F.when(F.startswith(r, F.lit(" ")), F.substring(r, F.lit(2), F.length(r))).otherwise(r)
    return encoded.withColumn("decoded", F.get(F.transform(F.array(raw), inner), 0))
