"""Language identification by a convolutional network over bytes, in numpy.

A text is cut into fixed-length windows of its bytes that overlap by the widest
filter less one, so that no run of bytes is lost.  Each byte has an embedding;
filters of several widths slide over a window, their highest outputs (max
pooling) feed a softmax.  A text's distribution is the mean over its windows,
weighted by their bytes.

The network is trained on the driver on a bounded sample: about ``SAMPLE``
labelled documents of each language, chosen by a hash of the id, and at most
``CROPS`` windows of each.  Tasks apply it to batches of windows; there a filter
is a sum of table rows, one for each pair of neighbouring bytes.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from hemline.llm.common import chunks, crc_mod

#: Documents of each language and windows of each document that train the network.
SAMPLE, CROPS = 1500, 2
#: Most windows that are trained on, whatever the number of languages.
MOST_WINDOWS = 24_000
#: Bytes of a window; widths of the filters; filters of each width; size of a byte's embedding.
WINDOW, WIDTHS, FILTERS, EMBEDDING = 160, (2, 3, 4), 16, 8
EPOCHS, LEAST_STEPS, BATCH, RATE = 4, 800, 64, 3e-3
#: Prediction where a text has no letter.
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_STEP = WINDOW - max(WIDTHS) + 1


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts in a row (padded with 0), the text of each, and its bytes."""
    parts = [_bytes(t) for t in texts]
    counts = np.array([max(1, -(-(len(p) - (WINDOW - _STEP)) // _STEP)) for p in parts])
    owner = np.repeat(np.arange(len(texts)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    sizes = np.array([len(p) for p in parts])
    flat = np.concatenate([*parts, np.zeros(WINDOW, np.uint8)])
    at = (np.cumsum(sizes) - sizes)[owner] + nth * _STEP
    fill = np.clip(sizes[owner] - nth * _STEP, 0, WINDOW)
    rows = np.lib.stride_tricks.sliding_window_view(flat, WINDOW)[at].copy()
    rows[np.arange(WINDOW)[None, :] >= fill[:, None]] = 0
    return rows, owner, fill


@dataclass
class Network:
    """Embedding, filters by width, softmax layer, and the languages it tells apart."""

    languages: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    dense: np.ndarray
    dense_bias: np.ndarray

    @staticmethod
    def new(languages: list[str], seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        filters = [rng.normal(0, (2 / (w * EMBEDDING)) ** 0.5, (w, EMBEDDING, FILTERS)).astype(np.float32) for w in WIDTHS]
        dense = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
        zeros = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        embedding = rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32)
        return Network(languages, embedding, filters, zeros, dense, np.zeros(len(languages), np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, *self.biases, self.dense, self.dense_bias]

    def gradients(self, rows: np.ndarray, wanted: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean cross entropy of a batch of windows."""
        n, x = len(rows), self.embedding[rows]
        pooled, best = [], []
        for w, (f, b) in zip(WIDTHS, zip(self.filters, self.biases)):
            length = WINDOW - w + 1
            out = sum(x[:, t : t + length] @ f[t] for t in range(w)) + b
            top = out.argmax(axis=1)
            best.append(top)
            pooled.append(np.take_along_axis(out, top[:, None, :], 1)[:, 0])
        h = np.maximum(np.concatenate(pooled, axis=1), 0)
        logits = h @ self.dense + self.dense_bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(n), wanted] -= 1
        p /= n
        back = (p @ self.dense.T) * (h > 0)
        d_embedding = np.zeros_like(self.embedding)
        d_filters, d_biases = [], []
        for i, (w, f) in enumerate(zip(WIDTHS, self.filters)):
            g = back[:, i * FILTERS : (i + 1) * FILTERS]
            d_filters.append(np.empty_like(f))
            d_biases.append(g.sum(axis=0))
            for t in range(w):
                chosen = np.take_along_axis(rows, best[i] + t, 1)
                d_filters[-1][t] = np.einsum("nfe,nf->ef", self.embedding[chosen], g)
                np.add.at(d_embedding, chosen.ravel(), (g[:, :, None] * f[t].T[None]).reshape(-1, EMBEDDING))
        return [d_embedding, *d_filters, *d_biases, h.T @ p, p.sum(axis=0)]

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Outputs of all filters for a pair of bytes at their first and at their third place."""
        out = []
        for first in (0, 2):
            table = np.zeros((256, 256, FILTERS * len(WIDTHS)), np.float32)
            for i, (w, f) in enumerate(zip(WIDTHS, self.filters)):
                part = table[:, :, i * FILTERS : (i + 1) * FILTERS]
                if first < w:
                    part += (self.embedding @ f[first])[:, None, :]
                if first + 1 < w:
                    part += (self.embedding @ f[first + 1])[None, :, :]
            out.append(table.reshape(65536, -1))
        # the narrowest filters have no third place
        return out[0], np.ascontiguousarray(out[1][:, FILTERS:])

    def probabilities(self, rows: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Softmax of each window."""
        out = np.empty((len(rows), len(self.languages)), np.float32)
        bias = np.concatenate(self.biases)
        narrow, wide = FILTERS, FILTERS * len(WIDTHS)
        for i in range(0, len(rows), 64):
            part = rows[i : i + 64]
            pair = (part[:, :-1].astype(np.uint16) << 8) | part[:, 1:]
            head = tables[0][pair]
            pooled = np.empty((len(part), wide), np.float32)
            pooled[:, :narrow] = head[:, :, :narrow].max(axis=1)
            # the widths of 3 and 4 share all places but the last of 3, whose third byte ends the window
            pooled[:, narrow:] = (head[:, :-2, narrow:] + tables[1][pair[:, 2:]]).max(axis=1)
            middle, last = slice(narrow, 2 * narrow), part[:, -1].astype(np.uint16) << 8
            pooled[:, middle] = np.maximum(pooled[:, middle], head[:, -2, middle] + tables[1][last, :narrow])
            logits = np.maximum(pooled + bias, 0) @ self.dense + self.dense_bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            out[i : i + 64] = p / p.sum(axis=1, keepdims=True)
        return out


def train(rows: np.ndarray, wanted: np.ndarray, languages: list[str], epochs: int = EPOCHS, seed: int = 5) -> Network:
    """A network trained with Adam; some windows are cut short, as short texts are."""
    rng = np.random.default_rng(seed)
    net = Network.new(languages, seed)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    step = 0
    # a small sample is passed more often
    epochs = max(epochs, min(60, -(-LEAST_STEPS * BATCH // len(rows))))
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        rate = RATE * (1 - epoch / epochs) + RATE / 10
        for i in range(0, len(order), BATCH):
            part = rows[order[i : i + BATCH]].copy()
            keep = np.where(rng.random(len(part)) < 0.4, rng.integers(12, WINDOW, len(part)), WINDOW)
            part[np.arange(WINDOW)[None, :] >= keep[:, None]] = 0
            step += 1
            for p, g, (m, v) in zip(net.parameters(), net.gradients(part, wanted[order[i : i + BATCH]]), state):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def _crops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Up to ``CROPS`` windows of each document, at places that depend on its id."""
    for batch in batches:
        out = []
        for lang, key, text in zip(*[batch.column(c).to_pylist() for c in ("lang", "doc_id", "text")]):
            if not text or not _LETTER.search(text):
                continue
            rows, _, fill = windows([text])
            rng = np.random.default_rng(zlib.crc32(str(key).encode()))
            for i in sorted(rng.choice(len(rows), min(CROPS, len(rows)), replace=False)):
                if fill[i] >= 8 or len(rows) == 1:
                    out.append((lang, key, int(i), rows[i].tobytes()))
        cols = list(zip(*out)) or [[], [], [], []]
        types = (pa.string(), pa.int64(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["lang", "doc_id", "nth", "bytes"])


def fit(docs: DataFrame, sample: int = SAMPLE, fold: tuple[int, int] = (4, 2)) -> Network | None:
    """A network from documents outside the held-out fold; None if none has a language and a letter."""
    known = docs.select("doc_id", "lang", "text").where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    known = known.where(crc_mod("doc_id", fold[0]) != fold[1])
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, sample / n))).otherwise(share)
    place = F.pmod(F.xxhash64(F.lit(13), F.col("doc_id").cast("string")), F.lit(1_000_000)) / 1e6
    crops = known.where(place < share).mapInArrow(_crops, "lang string, doc_id long, nth int, bytes binary")
    # a repeated id counts once, with the same window in every run; the limit bounds what reaches the driver
    once = crops.groupBy("lang", "doc_id", "nth").agg(F.min("bytes").alias("bytes"))
    got = once.orderBy(F.xxhash64("doc_id", "lang", "nth"), "doc_id", "lang", "nth").limit(MOST_WINDOWS).toArrow()
    if not got.num_rows:
        return None
    got = got.sort_by([("doc_id", "ascending"), ("lang", "ascending"), ("nth", "ascending")])
    names = got.column("lang").to_pylist()
    languages = sorted(set(names))
    rows = np.frombuffer(b"".join(got.column("bytes").to_pylist()), np.uint8).reshape(-1, WINDOW)
    return train(rows, np.array([languages.index(x) for x in names]), languages)


def _predict(net: Network | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables() if net else None
        for batch in batches:
            for part, texts in chunks(batch):
                best, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
                lettered = [i for i, t in enumerate(texts) if _LETTER.search(t)] if net else []
                if lettered:
                    rows, owner, fill = windows([texts[i] for i in lettered])
                    p = net.probabilities(rows, tables).astype(np.float64) * np.maximum(fill, 1)[:, None]
                    starts = np.flatnonzero(np.diff(owner, prepend=-1))
                    p = np.add.reduceat(p, starts, axis=0)
                    p /= p.sum(axis=1, keepdims=True)
                    for i, row in zip(lettered, p):
                        best[i], score[i] = net.languages[int(row.argmax())], float(min(row.max(), 1.0))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(best, pa.string()), pa.array(score, pa.float64())], [*part.schema.names, "lang_pred", "lang_score"])

    return run


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score`` in place of any of these names.

    Texts that are null, empty or without a letter are ``und`` with score 0, and
    so are all texts without a network.  Every row is predicted by itself.
    """
    docs = docs.drop("lang_pred", "lang_score")
    fields = [StructField("lang_pred", StringType()), StructField("lang_score", DoubleType())]
    return docs.mapInArrow(_predict(net), StructType([*docs.schema.fields, *fields]))


def least_score(docs: DataFrame, net: Network | None, share: float = 0.002, fold: tuple[int, int] = (4, 2)) -> float:
    """The score that all but ``share`` of the held-out documents reach whose language is predicted rightly.

    Taken over the whole held-out fold; 0 if nothing of it has a language and a right prediction.
    """
    held = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & (crc_mod("doc_id", fold[0]) == fold[1]))
    right = predict(held, net).where(F.col("lang") == F.col("lang_pred"))
    return right.agg(F.percentile_approx("lang_score", share, 10_000)).first()[0] or 0.0


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; a null id is in no fold."""
    found = predict(docs.select("doc_id", "text"), fit(docs))
    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
