import math
import re

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

from hemline.functions import text as X
from hemline.functions import vectors as V


def test_parse_list(spark):
    cells = ["['a', \"it's b\"]", "plain", "[]", "['x'", '["q"]']
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    got = {r.i: r.l for r in df.select("i", X.parse_list("c").alias("l")).collect()}
    assert got == {0: ["a", "it's b"], 1: ["plain"], 2: [], 3: ["['x'"], 4: ["q"]}


def test_fixed_length(spark):
    df = spark.createDataFrame([(0, []), (1, ["a"]), (2, ["a", "b"]), (3, ["a", "b", "c"])], "i int, l array<string>")
    got = {r.i: r.l for r in df.select("i", X.fixed_length("l").alias("l")).collect()}
    assert got == {0: [None, None], 1: ["a", "a"], 2: ["a", "b"], 3: ["a", "b"]}
    single = {r.i: r.l for r in df.select("i", X.fixed_length("l", pad="single").alias("l")).collect()}
    assert single == {0: [], 1: ["a", "a"], 2: ["a", "b"], 3: ["a", "b", "c"]}


def test_gelu_over_the_whole_range(spark):
    xs = [-40.0, -8.0, -3.0, -1e-9, 0.0, 0.5, 2.0, 8.0, 40.0]
    df = spark.createDataFrame([(xs,), ([1.0],), (None,)], "v array<double>")
    got = [r.g for r in df.select(V.activate("v").alias("g")).collect()]
    assert np.allclose(got[0], [x * 0.5 * (1 + math.erf(x / math.sqrt(2))) for x in xs], rtol=1e-12, atol=1e-13)
    assert len(got[1]) == 1 and got[2] is None


def test_relu_and_projection(spark):
    df = spark.createDataFrame([([1.0, -2.0],), ([0.5, 4.0],)], "v array<double>")
    assert [r[0] for r in df.select(V.activate("v", "relu")).collect()] == [[1.0, 0.0], [0.5, 4.0]]
    weights = spark.createDataFrame([(0, 0, 2.0), (0, 1, 1.0), (1, 1, -1.0)], "out int, in int, w double")
    matrix = V.read_weights(weights, 2, 2)
    got = [r[0] for r in df.select(V.linear_project("v", matrix, np.array([1.0, 0.0]))).collect()]
    assert got == [[1.0, 2.0], [6.0, -4.0]]


def test_concat_refuses_a_null_part(spark):
    df = spark.createDataFrame([([1.0], None)], "a array<double>, b array<double>")
    with pytest.raises(PySparkException, match="null"):
        df.select(V.concat_vectors("a", "b")).collect()
    nested = spark.createDataFrame([([[1.0], [2.0, 3.0]],)], "v array<array<double>>")
    assert nested.select(V.flatten_vectors("v")).first()[0] == [1.0, 2.0, 3.0]


def test_feature_groups(spark):
    df = spark.createDataFrame([], "`long desc_0` float, `desc_1` float, y int, y_s int, f string, `3 closest y` int, z int")
    groups = V.feature_groups(df, "desc", "y", "y_s", "f", "closest")
    assert groups == {
        "text": ["long desc_0", "desc_1"], "neighbors": ["3 closest y"], "files": ["f"],
        "target": ["y", "y_s"], "other": ["z"],
    }


def test_text_vectors_match_a_direct_computation(spark):
    texts = ["Red ring, red!", "blue ring", "", "a b c d e f", "ring", "Été à l'île"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for cut in (None, 2):
        model = X.fit_text_embedding(df, "t", 64, max_tokens=cut)
        got = {r.i: np.array(r.text_vector) for r in X.embed_text(df, model).collect()}
        corpus = {r.i: r.text_vector for r in X.embed_corpus(df, "i", "t", 64, max_tokens=cut).collect()}
        assert all(list(got[i]) == corpus[i] for i in got)
        slot = HashingTF(numFeatures=64)
        tokens = [re.findall(r"\w+", t.lower())[:cut] for t in texts]
        tf = np.zeros((len(texts), 64))
        for i, words in enumerate(tokens):
            for w in words:
                tf[i, slot.indexOf(w)] += 1
        idf = np.log((len(texts) + 1) / ((tf > 0).sum(axis=0) + 1))
        want = tf * idf
        norm = np.linalg.norm(want, axis=1, keepdims=True)
        want = np.divide(want, norm, out=np.zeros_like(want), where=norm > 0)
        for i in got:
            assert np.allclose(got[i], want[i])


def test_distances(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 1.0])], "a array<double>, b array<double>")
    row = df.select(V.euclidean("a", "b").alias("e"), V.cosine_similarity("a", "b").alias("c"), F.lit(1)).first()
    assert math.isclose(row.e, math.sqrt(5)) and math.isclose(row.c, 5 / math.sqrt(50))
