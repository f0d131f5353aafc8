"""Toxicity by two class-conditional Kneser-Ney models over words.

Each class has a model P(word | previous word) that backs off from the pair to
the word, from the word to its first letters, and from these to the counts that
both classes share.  As in Kneser-Ney smoothing, the counts are continuation
counts (in how many different contexts something occurs, so that copies of a
text add nothing), and every count is discounted.  The discount of a class
count is what the shared counts explain: its expected share, a relative margin
and a few standard deviations.  The discounted mass goes to the lower level, so
that a rare expression is smoothed by the shared counts and only expressions
that one class clearly prefers tell the classes apart.

The evidence of a text is its toxic minus its ordinary log-likelihood per word;
a logistic curve, fitted on sample rows apart from the counts, turns it into a
score.  A class without words in the sample rows apart fits the curve by its counted
rows.  Fitting uses a bounded sample of labelled rows (``SAMPLE`` documents of
each class, chosen by a hash of the id); Spark counts them, and only the
expressions that one class prefers travel with the tasks.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from hemline.llm.common import chunks, crc_mod
from hemline.session import materialize

#: Documents of each class that fit the model; of every four the second fits the curve.
SAMPLE = 4000
#: Letters of the level between a word and the shared counts.
STEM = 5
#: Discount of a class count: expected * (1 + MARGIN) + DEVIATIONS * sqrt(expected + 1).
MARGIN, DEVIATIONS = 0.5, 3.0
#: Discount within the shared counts, and the kinds over which their rest is spread.
SHARED_DISCOUNT, KINDS = 0.75, 2**18
#: Score from which a document is predicted toxic.
THRESHOLD = 0.7
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different triples of words of each class."""
    for batch in batches:
        for part, texts in chunks(batch):
            found = set()
            for toxic, text in zip(part.column("toxic").to_pylist(), texts):
                w = ["", "", *words(text)]
                found.update(zip([toxic] * len(w), w, w[1:], w[2:]))
            rows = list(zip(*found)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *[pa.array(r, pa.string()) for r in rows[1:]]], ["toxic", "before", "context", "word"])


@dataclass
class Level:
    """Discounted counts of one level: by key, (ordinary excess, toxic excess, shared count)."""

    totals: tuple[float, float]
    rest: tuple[float, float]
    kinds: float
    kept: dict[str, tuple[float, float, float]]

    def shared(self, count: float) -> float:
        """Probability by the shared counts."""
        total = self.totals[0] + self.totals[1]
        return (max(count - SHARED_DISCOUNT, 0) + SHARED_DISCOUNT * self.kinds / KINDS) / total


@dataclass
class Model:
    """Expressions that one class prefers, and what remains for all others."""

    stems: Level
    words: Level
    #: (context, word) -> excess shares of both classes; context -> share left to the words
    pairs: dict[tuple[str, str], tuple[float, float]] = field(default_factory=dict)
    contexts: dict[str, tuple[float, float]] = field(default_factory=dict)
    slope: float = 1.0
    offset: float = 0.0

    def word(self, word: str) -> list[float]:
        """Both classes' probability of a word, up to a factor that they share if nothing is kept for it."""
        stem, out = word[:STEM], []
        sx, wx = self.stems.kept.get(stem), self.words.kept.get(word)
        sq = self.stems.shared(sx[2]) if sx else 1.0
        wq = self.words.shared(wx[2]) if wx else 1.0
        for c in (0, 1):
            s = self.stems.rest[c] + (sx[c] / self.stems.totals[c] / sq if sx else 0.0)
            out.append((wx[c] / self.words.totals[c] if wx else 0.0) + self.words.rest[c] * wq * s)
        return out

    def ratio(self, word: str) -> float:
        ordinary, toxic = self.word(word)
        return math.log(toxic / ordinary)

    def evidence(self, text: str, cache: _Ratios) -> tuple[float, int]:
        """Toxic minus ordinary log-likelihood per word, and the number of words."""
        found = words(text)
        total = math.fsum([cache[w] for w in found])
        if self.contexts:
            for context, w in zip(["", *found], found):
                if context in self.contexts:
                    rest, p = self.contexts[context], self.word(w)
                    x = self.pairs.get((context, w), (0.0, 0.0))
                    total += math.log((x[1] + rest[1] * p[1]) / (x[0] + rest[0] * p[0])) - cache[w]
        return total / max(len(found), 1), len(found)

    def score(self, text: str, cache: _Ratios) -> float:
        """Texts without words score 0."""
        z, n = self.evidence(text, cache)
        return 1 / (1 + math.exp(-min(max(self.slope * z + self.offset, -60.0), 60.0))) if n else 0.0


class _Ratios(dict):
    """Log ratio of each word, computed once."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) > 400_000:
            self.clear()
        value = self[word] = self.model.ratio(word)
        return value


def _excess(counted: DataFrame, keys: list[str]) -> tuple[DataFrame, tuple[float, float], tuple[float, float], float]:
    """Both classes' counts beyond their discounts (``x0``, ``x1``) with the shared count, class totals, rests, kinds.

    ``counted`` has one row for each class and key.
    """
    n = [F.sum(F.when(F.col("toxic") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in (0, 1)]
    by_key = materialize(counted.groupBy(*keys).agg(*n))
    n0, n1, kinds = by_key.agg(F.sum("n0"), F.sum("n1"), F.count("*")).first()
    totals = (float(n0 or 0), float(n1 or 0))
    both = max(sum(totals), 1.0)

    def beyond(c: int) -> Column:
        expected = (F.col("n0") + F.col("n1")) * (totals[c] / both)
        discount = expected * (1 + MARGIN) + F.sqrt(expected + 1) * DEVIATIONS
        return F.greatest(F.col(f"n{c}") - discount, F.lit(0.0))

    kept = by_key.withColumns({"x0": beyond(0), "x1": beyond(1), "pool": F.col("n0") + F.col("n1")})
    sums = kept.agg(F.sum("x0"), F.sum("x1")).first()
    rest = tuple(1 - (sums[c] or 0.0) / max(totals[c], 1.0) for c in (0, 1))
    return kept, tuple(max(t, 1.0) for t in totals), rest, float(kinds)


def _model(grams: DataFrame) -> Model:
    """Levels from the different triples (toxic, before, context, word)."""
    by_pair = materialize(grams.distinct().groupBy("toxic", "context", "word").agg(F.count("*").alias("n")))
    by_word = by_pair.groupBy("toxic", "word").agg(F.count("*").alias("n"))
    stemmed = by_pair.select("toxic", "context", F.substring("word", 1, STEM).alias("stem")).distinct()
    kept, total, rest, kinds = _excess(stemmed.groupBy("toxic", "stem").agg(F.count("*").alias("n")), ["stem"])
    few = lambda df, *names: df.where("x0 > 0 OR x1 > 0").select(*names, "x0", "x1", "pool").collect()
    stems = Level(total, rest, kinds, {r[0]: tuple(r[1:]) for r in few(kept, "stem")})
    kept, total, rest, kinds = _excess(by_word, ["word"])
    level = Level(total, rest, kinds, {r[0]: tuple(r[1:]) for r in few(kept, "word")})
    model = Model(stems, level)
    pairs, *_ = _excess(by_pair, ["context", "word"])
    preferred = {(r[0], r[1]): (r[2], r[3]) for r in few(pairs, "context", "word")}
    if preferred:
        needed = pairs.select("context", "n0", "n1", "x0", "x1").groupBy("context")
        sums = needed.agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "x0", "x1")]).where("x0 > 0 OR x1 > 0").collect()
        seen = {r[0]: (max(r[1], 1), max(r[2], 1)) for r in sums}
        model.contexts = {r[0]: (1 - r[3] / max(r[1], 1), 1 - r[4] / max(r[2], 1)) for r in sums}
        # the words of these pairs need their shared counts too
        wanted = pairs.where("x0 > 0 OR x1 > 0").select("word").distinct()
        for r in kept.join(wanted, "word", "left_semi").select("word", "x0", "x1", "pool").collect():
            level.kept[r[0]] = tuple(r[1:])
        stem_of = {w[:STEM] for w in level.kept}
        model.pairs = {k: (x[0] / seen[k[0]][0], x[1] / seen[k[0]][1]) for k, x in preferred.items() if k[1][:STEM] in stem_of}
    return model


def _curve(evidence: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve with a small penalty, by Newton's method."""
    middle, scale = float(np.median(evidence)), max(float(evidence.std()), 1e-9)
    x = np.stack([(evidence - middle) / scale, np.ones_like(evidence)], axis=1)
    penalty = np.array([1e-3, 1e-6])
    beta = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        grad = x.T @ (p - toxic) + penalty * beta
        hess = x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + np.diag(penalty)
        step = np.clip(np.linalg.solve(hess, grad), -2, 2)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    slope = float(max(beta[0], 0.0) / scale)
    return slope, float(beta[1]) - slope * middle


def _evidence_of(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Ratios(model)
        for batch in batches:
            found = [model.evidence(t or "", cache) for t in batch.column("text").to_pylist()]
            z, n = [f[0] for f in found], [f[1] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(z, pa.float64()), pa.array(n, pa.int64())], ["toxic", "z", "n"])

    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, fold: tuple[int, int] = (3, 1)) -> Model | None:
    """The model from labelled rows outside the held-out fold; None unless both classes have rows with words.

    ``fold`` is (parts, held-out part) of crc32 of the id as text.  An id
    labelled twice is toxic if one label says so, a repeated id counts once.
    """
    known = labels.select("doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    known = known.where(crc_mod("doc_id", fold[0]) != fold[1]).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.xxhash64(F.lit(11), F.col("doc_id").cast("string"))
    picked = [known.where(F.col("toxic") == c).orderBy(order, "doc_id").limit(sample) for c in (0, 1)]
    # at most 2 * sample rows of two numbers each
    ids = F.broadcast(picked[0].union(picked[1]))
    rows = docs.select("doc_id", "text").join(ids, "doc_id").dropDuplicates(["doc_id"])
    rows = materialize(rows.where(F.col("text").rlike(r"[\p{L}\p{Nl}\p{No}]")))
    if rows.select("toxic").distinct().count() < 2:
        return None
    # by rank within each class, so that two rows are enough for both parts
    rank = F.row_number().over(Window.partitionBy("toxic").orderBy(F.xxhash64(F.lit(12), F.col("doc_id").cast("string")), "doc_id"))
    rows = rows.join(F.broadcast(rows.select("doc_id", (rank % 4 == 2).alias("apart"))), "doc_id")
    # the sample is a few files, its words are many
    spread = rows.repartition(12, "doc_id")
    counted = spread.where(~F.col("apart")).select("toxic", "text")
    model = _model(counted.mapInArrow(_trigrams, "toxic int, before string, context string, word string"))
    apart = spread.where("apart").select("toxic", "text").mapInArrow(_evidence_of(model), "toxic int, z double, n long")
    got = apart.where("n > 0").toArrow()
    z, toxic = got.column("z").to_numpy(), got.column("toxic").to_numpy()
    if missing := {0, 1} - set(toxic.tolist()):
        again = counted.where(F.col("toxic").isin(missing)).mapInArrow(_evidence_of(model), "toxic int, z double, n long")
        got = again.where("n > 0").toArrow()
        z, toxic = np.append(z, got.column("z").to_numpy()), np.append(toxic, got.column("toxic").to_numpy())
    if len(set(toxic.tolist())) < 2:
        return None
    model.slope, model.offset = _curve(z, toxic.astype(float))
    return model


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Ratios(model)
        for batch in batches:
            scores = [model.score(t or "", cache) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])

    return run


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with a column ``score`` (0 to 1) in place of any of that name.

    Texts that are null, empty or without words score 0, and so do all texts
    without a model.  Every row is scored by itself and whole, so repeated rows
    agree; an empty table gives no rows.
    """
    docs = docs.drop("score")
    if model is None:
        return docs.withColumn("score", F.lit(0.0))
    return docs.mapInArrow(_score(model), StructType([*docs.schema.fields, StructField("score", DoubleType())]))


def report(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; a null id is in no fold."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    held = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
