"""The byte network against plain convolutions and differences."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hemline.llm import language
from hemline.llm.queries import QUERIES


def by_convolution(net, text):
    """Mean distribution over the windows of a text, filter by filter and place by place."""
    raw = text.lower().encode()
    step = language.WINDOW - max(language.WIDTHS) + 1
    starts = [s for s in range(0, max(1, len(raw)), step) if s == 0 or s < len(raw) - (language.WINDOW - step)]
    total, weights = 0, 0
    for s in starts:
        part = raw[s : s + language.WINDOW]
        x = net.embedding[np.frombuffer(part.ljust(language.WINDOW, b"\0"), np.uint8)].astype(float)
        pooled = []
        for w, f, b in zip(language.WIDTHS, net.filters, net.biases):
            places = [sum(x[p + t] @ f[t] for t in range(w)) + b for p in range(language.WINDOW - w + 1)]
            pooled.append(np.max(places, axis=0))
        logits = np.maximum(np.concatenate(pooled), 0) @ net.dense + net.dense_bias
        p = np.exp(logits - logits.max())
        total = total + p / p.sum() * max(len(part), 1)
        weights += max(len(part), 1)
    return total / weights


@pytest.mark.parametrize("size", [1, 2, 3, 158, 159, 160, 161, 317, 318, 900])
def test_probabilities_are_those_of_plain_convolutions(size):
    draw = np.random.default_rng(size)
    net = language.Network.new(["a", "b", "c"], size)
    for b in net.biases:
        b += draw.normal(0, 0.3, b.shape).astype(np.float32)
    for _ in range(20):
        text = "".join(map(chr, draw.integers(97, 123, size)))
        rows, _, fill = language.windows([text])
        p = net.probabilities(rows, net.tables()).astype(float)
        got = (p * fill[:, None]).sum(axis=0) / fill.sum()
        assert np.abs(got - by_convolution(net, text)).max() < 1e-5


def test_gradients_agree_with_differences():
    draw = np.random.default_rng(3)
    net = language.Network.new(["a", "b"], 3)
    net.embedding, net.dense, net.dense_bias = (a.astype(float) for a in (net.embedding, net.dense, net.dense_bias))
    net.filters, net.biases = [f.astype(float) for f in net.filters], [b.astype(float) + 0.2 for b in net.biases]
    rows, wanted = draw.integers(97, 110, (5, language.WINDOW)).astype(np.uint8), np.array([0, 1, 1, 0, 1])

    def loss():
        total = 0.0
        for row, want in zip(rows, wanted):
            total -= np.log(by_convolution(net, row.tobytes().decode())[want])
        return total / len(rows)

    for values, gradient in zip(net.parameters(), net.gradients(rows, wanted)):
        flat = values.reshape(-1)
        for at in draw.choice(len(flat), min(4, len(flat)), replace=False):
            before = flat[at]
            flat[at] = before + 1e-5
            above = loss()
            flat[at] = before - 1e-5
            below = loss()
            flat[at] = before
            assert abs((above - below) / 2e-5 - gradient.reshape(-1)[at]) < 1e-4


def test_least_score_keeps_all_but_a_share(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = language.fit(docs)
    held = QUERIES["op10_language_id"](spark, "/root/testdata/sf0.01").where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang = lang_pred")
    scores = sorted(r.score for r in held.collect())
    assert language.least_score(docs, net, 0.0) == pytest.approx(scores[0], abs=1e-6)
    assert language.least_score(docs, net, 0.1) == pytest.approx(scores[round(0.1 * len(scores))], abs=0.02)
    assert language.least_score(docs.withColumn("lang", F.lit(None).cast("string")), net) == 0.0
    assert language.least_score(docs, None) == 0.0


def test_training_windows_do_not_depend_on_the_order_of_rows(spark):
    rows = [(i % 30, f"the cat number {i} and the dog " * 9 if i % 2 else f"der hund {i} und die katze " * 9, "en" if i % 2 else "de") for i in range(80)]
    nets = [language.fit(spark.createDataFrame(order, "doc_id long, text string, lang string").repartition(n)) for order, n in ((rows, 1), (rows[::-1], 5))]
    assert all((a == b).all() for a, b in zip(nets[0].parameters(), nets[1].parameters()))
