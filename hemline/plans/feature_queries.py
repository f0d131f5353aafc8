"""Feature groups, list cells and vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from hemline.functions import text as X
from hemline.functions import vectors as V
from hemline.plans.registry import query, rounded

DIM = 64


def _long(df, key: str, vec, digits: int = 6):
    """One row per vector element: key, pos, value."""
    return df.select(key, F.posexplode(vec).alias("pos", "value")).select(
        key, "pos", rounded(F.col("value").cast("double"), digits).alias("value")
    )


def _long_sql(source: str, key: str, vec: str, digits: int = 6) -> str:
    return f"""SELECT {key}, CAST(pos - 1 AS INTEGER) AS pos, round(CAST(value AS DOUBLE), {digits}) + 0.0 AS value FROM (
      SELECT {key}, unnest(v) AS value, generate_subscripts(v, 1) AS pos FROM (SELECT {key}, {vec} AS v FROM {source}))"""


@query("e1_columns_like", "SELECT l_linenumber, l_linestatus FROM lineitem")
def e1(t):
    return t.lineitem.select(*V.columns_like(t.lineitem, "l_line"))


@query("e1_feature_groups", "SELECT p_partkey, p_brand, p_type, p_size FROM part")
def e1_groups(t):
    groups = V.feature_groups(t.part, text="name", target="p_retailprice")
    return t.part.select(*groups["other"])


@query(
    "e2_parse_list",
    """SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 1 ELSE 2 END AS n, p_name AS first,
    CASE WHEN p_size % 4 = 0 THEN p_name ELSE p_type END AS last FROM part""",
)
def e2(t):
    literal = F.concat(F.lit("['"), "p_name", F.lit("', '"), "p_type", F.lit("']"))
    cell = F.when(F.col("p_size") % 4 == 0, F.col("p_name")).otherwise(literal)
    parsed = t.part.withColumn("items", X.parse_list(cell))
    return parsed.select(
        "p_partkey", F.size("items").alias("n"), F.col("items")[0].alias("first"),
        F.element_at("items", -1).alias("last"),
    )


@query(
    "e3_fixed_length",
    """SELECT p_partkey, w[1] AS first, coalesce(w[2], w[1]) AS second, coalesce(w[3], w[2], w[1]) AS third FROM (
      SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN [] WHEN 1 THEN string_split(p_name, ' ')[1:1]
        WHEN 2 THEN string_split(p_name, ' ') ELSE string_split(p_name || ' ' || p_type || ' x y', ' ') END AS w FROM part)""",
)
def e3(t):
    words = F.split("p_name", " ")
    kind = F.col("p_size") % 4
    lists = (
        F.when(kind == 0, F.array().cast("array<string>"))
        .when(kind == 1, F.slice(words, 1, 1))
        .when(kind == 2, words)
        .otherwise(F.split(F.concat_ws(" ", "p_name", "p_type", F.lit("x y")), " "))
    )
    fixed = t.part.withColumn("w", X.fixed_length(lists, 3))
    return fixed.select(
        "p_partkey", F.col("w")[0].alias("first"), F.col("w")[1].alias("second"), F.col("w")[2].alias("third")
    )


@query(
    "e3_fixed_length_single",
    """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_type || ',' || p_type ELSE p_type || ',' || p_brand || ',x' END
    AS files FROM part""",
)
def e3_single(t):
    lists = F.when(F.col("p_size") % 2 == 0, F.array("p_type")).otherwise(F.array("p_type", "p_brand", F.lit("x")))
    padded = t.part.withColumn("files", X.fixed_length(lists, 2, pad="single"))
    return padded.select("p_partkey", F.array_join("files", ",").alias("files"))


@query(
    "e4_vector_to_columns",
    "SELECT vec_id, "
    + ", ".join(f"round(CAST(embedding[{i + 1}] AS DOUBLE), 6) + 0.0 AS v_{i}" for i in range(DIM))
    + " FROM embeddings",
)
def e4(t):
    wide = V.vector_to_columns(t.embeddings, "embedding", "v", DIM)
    return wide.select("vec_id", *[rounded(F.col(f"v_{i}").cast("double")).alias(f"v_{i}") for i in range(DIM)])


@query("e4_columns_to_vector", _long_sql("part", "p_partkey", "[CAST(p_size AS DOUBLE), p_retailprice]"))
def e4_back(t):
    return _long(V.columns_to_vector(t.part, ["p_size", "p_retailprice"], "v"), "p_partkey", "v")


@query("e5_concat_vectors", _long_sql("embeddings", "vec_id", "list_concat(embedding, list_reverse(embedding))"))
def e5(t):
    return _long(t.embeddings, "vec_id", V.concat_vectors("embedding", F.reverse("embedding")))


@query(
    "e6_sum_vectors",
    """SELECT label, CAST(pos - 1 AS INTEGER) AS pos, round(sum(value), 5) + 0.0 AS value FROM (
      SELECT label, CAST(unnest(embedding) AS DOUBLE) AS value, generate_subscripts(embedding, 1) AS pos FROM embeddings)
    GROUP BY label, pos""",
)
def e6(t):
    return _long(V.sum_vectors(t.embeddings, "label", "embedding"), "label", "vector", 5)


@query("e7_activate_relu", _long_sql("embeddings", "vec_id", "list_transform(embedding, lambda x: greatest(x, 0))"))
def e7_relu(t):
    return _long(t.embeddings, "vec_id", V.activate("embedding", "relu"))


# Series of the error function, enough terms for elements of unit vectors.
_ERF = """(2 / sqrt(pi()) * exp(-x * x / 2) * list_sum(list_transform(range(0, 16), lambda n:
  pow(4.0, n) * factorial(CAST(n AS INTEGER)) / factorial(CAST(2 * n + 1 AS INTEGER)) * pow(x / sqrt(2), 2 * n + 1))))"""


@query(
    "e7_activate_gelu",
    f"""SELECT vec_id, CAST(pos - 1 AS INTEGER) AS pos, round(x * 0.5 * (1 + {_ERF}), 6) + 0.0 AS value FROM (
      SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)""",
)
def e7_gelu(t):
    return _long(t.embeddings, "vec_id", V.activate("embedding", "gelu"))


OUT = 8
WEIGHTS = np.array([[((i + 1) * (o + 1) % 7 - 3) / 8 for i in range(DIM)] for o in range(OUT)])


@query(
    "e8_linear_project",
    _long_sql(
        "embeddings",
        "vec_id",
        f"""list_transform(range(0, {OUT}), lambda o: 0.5 + list_sum(list_transform(range(1, {DIM + 1}),
        lambda i: CAST(embedding[i] AS DOUBLE) * ((i * (o + 1)) % 7 - 3) / 8)))""",
    ),
)
def e8(t):
    return _long(t.embeddings, "vec_id", V.linear_project("embedding", WEIGHTS, np.full(OUT, 0.5)))


@query("e9_embed_text")
def e9(t):
    embedded = X.embed_corpus(t.documents, "doc_id", "text", 256)
    norm = F.sqrt(V.dot("text_vector", "text_vector"))
    used = F.size(F.filter("text_vector", lambda x: x != 0))
    return embedded.select("doc_id", rounded(norm).alias("norm"), used.alias("used"))


# Words of plain letters have the vector that their md5 points to, and weigh by the texts without them.
@query(
    "e9_word_vectors",
    """WITH tokens AS (
      SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS word FROM documents),
    counts AS (SELECT doc_id, word, count(*) AS n FROM tokens WHERE word <> '' GROUP BY ALL),
    vocabulary AS (SELECT word, ln((SELECT count(*) + 1.0 FROM documents) / count(*)) AS weight,
        CAST(('0x' || substr(md5(word), 1, 8)) AS UBIGINT) % (SELECT count(*) FROM embeddings) AS vec_id
      FROM counts WHERE regexp_full_match(word, '[a-z]+') GROUP BY word),
    parts AS (SELECT doc_id, n * weight AS w, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS place
      FROM counts JOIN vocabulary USING (word) JOIN embeddings USING (vec_id))
    SELECT doc_id, CAST(place AS INTEGER) AS place, round(sum(w * x::DOUBLE) / sum(w), 6) + 0.0 AS value FROM parts GROUP BY doc_id, place""",
)
def e9_words(t):
    texts, vectors = t.documents, t.embeddings
    tokens = texts.select("doc_id", F.explode(F.array_distinct(F.expr(X._tokens("text", None)))).alias("word"))
    used = tokens.where(F.col("word").rlike("^[a-z]+$")).groupBy("word").agg(F.count("*").alias("texts"))
    n_texts, n_vectors = texts.count(), vectors.count()
    at = F.conv(F.left(F.md5("word"), F.lit(8)), 16, 10).cast("long") % n_vectors
    weight = F.log(F.lit(n_texts + 1.0) / F.col("texts"))
    words = used.select("word", "texts", weight.alias("weight"), at.alias("vec_id")).join(vectors, "vec_id").select("word", "weight", "texts", F.col("embedding").alias("vector"))
    pooled = X.pool_word_vectors(texts, "doc_id", "text", words, often="texts")
    return pooled.select("doc_id", F.posexplode("text_vector").alias("i", "x")).select("doc_id", (F.col("i") + 1).alias("place"), rounded("x").alias("value"))
