"""List cells and text vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, SQLTransformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hemline.session import materialize


def parse_list(col: str | Column) -> Column:
    """List literal as an array; any other cell becomes a one-element list."""
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.from_json(col, "array<string>"), F.array(col))


def fixed_length(col: str | Column, n: int = 2, pad: str = "last") -> Column:
    """Array of exactly ``n``: padded with its last element, or cut.

    An empty array gives ``n`` nulls.  ``pad='single'`` only doubles
    one-element arrays and leaves the others alone.
    """
    col = F.col(col) if isinstance(col, str) else col
    if pad == "single":
        return F.when(F.size(col) == 1, F.array_repeat(col[0], n)).otherwise(col)
    if pad != "last":
        raise ValueError("pad must be 'last' or 'single'")
    filler = F.array_repeat(F.try_element_at(col, F.lit(-1)), n)
    return F.slice(F.concat(col, filler), 1, n)


def _tokens(col: str, max_tokens: int | None) -> str:
    """SQL for the lower-cased words of a text."""
    tokens = f"filter(split(lower(coalesce(`{col}`, '')), r'[^\\p{{L}}\\p{{N}}]+'), w -> w != '')"
    return f"slice({tokens}, 1, {int(max_tokens)})" if max_tokens else tokens


def _token_stages(col: str, dim: int, max_tokens: int | None) -> list:
    """Lower-cased words, and their hashed counts in ``__tf``."""
    return [
        SQLTransformer(statement=f"SELECT *, {_tokens(col, max_tokens)} AS __tokens FROM __THIS__"),
        HashingTF(inputCol="__tokens", outputCol="__tf", numFeatures=dim),
    ]


def _weight_stages() -> list:
    return [IDF(inputCol="__tf", outputCol="__tfidf"), Normalizer(inputCol="__tfidf", outputCol="__unit")]


def fit_text_embedding(
    df: DataFrame, col: str, dim: int = 256, max_tokens: int | None = None
) -> PipelineModel:
    """Hashed tf-idf text vectors of unit length.

    Whole texts are used; ``max_tokens`` cuts each text after so many tokens,
    as an encoder with a bounded input would.
    """
    return Pipeline(stages=[*_token_stages(col, dim, max_tokens), *_weight_stages()]).fit(df)


def embed_text(df: DataFrame, model: PipelineModel, name: str = "text_vector") -> DataFrame:
    """Attach the text vector of every row."""
    embedded = model.transform(df).withColumn(name, vector_to_array("__unit"))
    return embedded.select(*df.columns, name)


def embed_corpus(
    df: DataFrame, key: str, col: str, dim: int = 256, max_tokens: int | None = None, name: str = "text_vector"
) -> DataFrame:
    """Fit on a table and embed the same table: ``key`` and vector.

    The texts are read once: their hashed counts are written, and both the fit
    and the vectors start from those.
    """
    counts = Pipeline(stages=_token_stages(col, dim, max_tokens)).fit(df).transform(df)
    counts = materialize(counts.select(key, "__tf"))
    weighted = Pipeline(stages=_weight_stages()).fit(counts).transform(counts)
    return weighted.select(key, vector_to_array("__unit").alias(name))


# Words looked up in the task, those that occur most often, and most numbers in their vectors; all others are joined.
FREQUENT = 65_536
FREQUENT_NUMBERS = 1 << 22
# Words whose vectors are added at once.
_WORD_CHUNK = 32_768


def _pooled(known: pa.Array, sums: np.ndarray, weights: np.ndarray):
    """Of every text: the weighted sum of its frequent words' vectors, their weight, and its other words."""

    def run(batches):
        for batch in batches:
            lists = batch.column("__words")
            words, n = lists.flatten(), len(lists)
            at = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False)
            text = np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            met = at >= 0
            total = np.zeros((n, sums.shape[1]))
            places, texts = at[met], text[met]
            for low in range(0, len(places), _WORD_CHUNK):
                part = texts[low : low + _WORD_CHUNK]
                begins = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                total[part[begins]] += np.add.reduceat(sums[places[low : low + _WORD_CHUNK]], begins, axis=0)
            weight = np.bincount(texts, weights=weights[places], minlength=n) if len(places) else np.zeros(n)
            other = words.filter(pa.array(~met))
            ends = np.concatenate([[0], np.cumsum(np.bincount(text[~met], minlength=n))]).astype(np.int32)
            vector = pa.ListArray.from_arrays(pa.array(np.arange(0, total.size + 1, sums.shape[1], dtype=np.int32)), pa.array(total.ravel()))
            columns = [batch.column("__key"), vector, pa.array(weight), pa.ListArray.from_arrays(pa.array(ends), other)]
            yield pa.RecordBatch.from_arrays(columns, names=["__key", "vector", "weight", "others"])

    return run


def pool_word_vectors(
    df: DataFrame, key: str, col: str, words: DataFrame, max_tokens: int | None = None, name: str = "text_vector",
    often: str | None = None,
) -> DataFrame:
    """Texts as the weighted mean of their words' vectors from a table: ``key`` and vector.

    ``words`` has ``word`` (unique), ``vector`` and ``weight`` (above 0; others count for nothing).
    A word counts as often as it occurs.  Rows of one key are one text, and a text without a
    known word has a null vector.  The vectors of the most frequent words are added up where a
    text is read, so a text leaves its task as one vector; only its other words are joined.  ``often``
    names a column of ``words`` that tells the frequent ones; without it the words are counted.
    """
    tokens = F.expr(_tokens(col, max_tokens))
    texts = df.select(F.col(key).alias("__key"), tokens.alias("__words"))
    if often is None:
        used = texts.select(F.explode("__words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
        words = words.select("word", "vector", "weight").join(used, "word")
    else:
        words = words.where("word IS NOT NULL").withColumn("n", F.coalesce(F.col(often).cast("long"), F.lit(0)))
    # written once: the table of the frequent words, and the join with the others
    known = materialize(words.where("weight > 0 AND vector IS NOT NULL").select(
        "word", F.col("vector").cast("array<double>").alias("vector"), F.col("weight").cast("double").alias("weight"), "n"
    ))
    first = known.select(F.size("vector")).first()
    dim = first[0] if first else 0
    most = max(1, min(FREQUENT, FREQUENT_NUMBERS // max(1, dim)))
    table = known.orderBy(F.desc("n"), "word").limit(most).toArrow()
    rest = None
    if table.num_rows == most:
        # the last word may have more rows than these, and goes with the others
        last = table.slice(most - 1).to_pylist()[0]
        table = table.filter(pc.not_equal(table["word"], last["word"]))
        rest = known.where((F.col("n") < last["n"]) | ((F.col("n") == last["n"]) & (F.col("word") >= last["word"])))
    # a repeated word counts once for each of its rows
    coded = table["word"].combine_chunks().dictionary_encode()
    place, weight = coded.indices.to_numpy(), table["weight"].to_numpy()
    sums, weights = np.zeros((len(coded.dictionary), dim)), np.zeros(len(coded.dictionary))
    if len(place):
        np.add.at(sums, place, np.vstack(table["vector"].to_pylist()) * weight[:, None])
        np.add.at(weights, place, weight)
    shape = T.StructType([
        T.StructField("__key", texts.schema["__key"].dataType), T.StructField("vector", T.ArrayType(T.DoubleType())),
        T.StructField("weight", T.DoubleType()), T.StructField("others", T.ArrayType(T.StringType())),
    ])
    parts = texts.mapInArrow(_pooled(coded.dictionary, sums, weights), shape)
    if rest is not None:
        parts = materialize(parts)
        counts = parts.select("__key", F.explode("others").alias("word")).groupBy("__key", "word").agg(F.count("*").alias("n"))
        share = F.col("n") * F.col("weight")
        joined = counts.join(rest.drop("n"), "word")
        same = F.when(F.size("vector") == dim, F.transform("vector", lambda x: x * share)).otherwise(F.raise_error(F.lit("vectors of words differ in length")).cast("array<double>"))
        parts = parts.drop("others").unionByName(joined.select("__key", same.alias("vector"), share.alias("weight")))
    flat = parts.select("__key", "weight", *[F.get("vector", F.lit(i)).alias(f"v{i}") for i in range(dim)])
    total = flat.groupBy("__key").agg(F.sum("weight").alias("weight"), *[F.sum(f"v{i}").alias(f"v{i}") for i in range(dim)])
    mean = F.array(*[F.col(f"v{i}") / F.col("weight") for i in range(dim)]).cast("array<double>")
    return total.select(F.col("__key").alias(key), F.when(F.col("weight") > 0, mean).alias(name))
