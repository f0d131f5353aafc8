"""Feature groups and array-of-double vectors."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VECTOR = T.ArrayType(T.DoubleType())


def columns_like(df: DataFrame, text: str) -> list[str]:
    """Names of the columns that contain ``text``."""
    return [c for c in df.columns if text in c]


def feature_groups(
    df: DataFrame,
    text: str,
    target: str,
    scaled: str | None = None,
    files: str | None = None,
    neighbors: str | None = None,
) -> dict[str, list[str]]:
    """Column names by role; ``other`` is what no role claims."""
    groups = {
        "text": columns_like(df, text),
        "neighbors": columns_like(df, neighbors) if neighbors else [],
        "files": [c for c in (files,) if c in df.columns],
        "target": [c for c in (target, scaled) if c in df.columns],
    }
    claimed = {c for names in groups.values() for c in names}
    groups["other"] = [c for c in df.columns if c not in claimed]
    return groups


def vector_to_columns(df: DataFrame, vec: str, prefix: str, size: int) -> DataFrame:
    """One column ``prefix_i`` per dimension."""
    return df.withColumns({f"{prefix}_{i}": F.col(vec)[i] for i in range(size)})


def columns_to_vector(df: DataFrame, cols: Sequence[str], name: str) -> DataFrame:
    """Columns packed into one array, in the given order."""
    return df.withColumn(name, F.array(*[F.col(f"`{c}`").cast("double") for c in cols]))


def concat_vectors(*cols: str | Column) -> Column:
    """Vectors behind each other; a null part raises instead of nulling the row."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.coalesce(F.concat(*parts), F.raise_error(F.lit("a vector part is null")))


def flatten_vectors(col: str | Column) -> Column:
    """Array of vectors as one vector."""
    return F.flatten(col)


def sum_vectors(df: DataFrame, key: str, vec: str, name: str = "vector") -> DataFrame:
    """Elementwise sum per key, combined before the shuffle; null vectors add nothing, a key with no other has null."""
    v = F.col(vec).cast(VECTOR)
    total = Summarizer.sum(array_to_vector(v))
    sums = df.where(v.isNotNull()).groupBy(key).agg(vector_to_array(total).alias(name))
    every = df.select(key).distinct()
    return every.join(sums, every[key].eqNullSafe(sums[key]), "left").select(every[key], name)


def relu(vec: str | Column) -> Column:
    """max(x, 0) per element."""
    return F.transform(vec, lambda x: F.greatest(x, F.lit(0.0)))


def _erf(x: np.ndarray) -> np.ndarray:
    """Error function by its all-positive series; beyond 6 it equals +-1 in a double."""
    bounded = np.clip(x, -6.0, 6.0)
    square = bounded * bounded
    term = bounded.copy()
    total = bounded.copy()
    for n in range(1, 200):
        term = term * (2.0 * square / (2 * n + 1))
        total += term
        if not np.any(np.abs(term) > 1e-17 * np.abs(total)):
            break
    inner = np.clip(total * np.exp(-square) * (2.0 / math.sqrt(math.pi)), -1.0, 1.0)
    return np.where(np.abs(x) >= 6.0, np.sign(x), inner)


@F.pandas_udf(VECTOR)
def _gelu(vectors: pd.Series) -> pd.Series:
    sizes = vectors.map(len, na_action="ignore")
    present = vectors[vectors.notna()]
    if present.empty:
        return vectors
    flat = np.concatenate(present.to_list()).astype(np.float64)
    flat = flat * 0.5 * (1.0 + _erf(flat / math.sqrt(2.0)))
    cuts = np.cumsum(sizes[present.index].astype(int).to_numpy())[:-1]
    return pd.Series(np.split(flat, cuts), index=present.index).reindex(vectors.index)


def activate(vec: str | Column, kind: str = "gelu") -> Column:
    """GELU in its exact error-function form, or ReLU, per element."""
    vec = F.col(vec) if isinstance(vec, str) else vec
    if kind == "relu":
        return relu(vec.cast(VECTOR))
    if kind != "gelu":
        raise ValueError("kind must be 'gelu' or 'relu'")
    return _gelu(vec.cast(VECTOR))


# Weights that the driver fetches and every task gets: 8 MB.
WEIGHT_LIMIT = 1_000_000


def read_weights(weights: DataFrame, n_out: int, n_in: int) -> np.ndarray:
    """Weight matrix from rows (out, in, w); its size is checked before it is fetched."""
    if n_out * n_in > WEIGHT_LIMIT:
        raise ValueError("the weight matrix is too large to broadcast")
    rows = weights.select(F.col("out").cast("int"), F.col("in").cast("int"), F.col("w").cast("double")).limit(n_out * n_in + 1).toArrow()
    if rows.num_rows > n_out * n_in:
        raise ValueError("more weights than the stated shape")
    matrix = np.zeros((n_out, n_in))
    matrix[rows["out"].to_numpy(), rows["in"].to_numpy()] = rows["w"].to_numpy()
    return matrix


def linear_project(vec: str | Column, weights: np.ndarray, bias: np.ndarray | None = None) -> Column:
    """Dense projection ``W x + b`` as one matrix product per Arrow batch; null stays null."""
    matrix = np.asarray(weights, dtype=np.float64)
    if matrix.size > WEIGHT_LIMIT:
        raise ValueError("the weight matrix is too large to broadcast")
    offset = np.zeros(matrix.shape[0]) if bias is None else np.asarray(bias, dtype=np.float64)

    @F.pandas_udf(VECTOR)
    def project(vectors: pd.Series) -> pd.Series:
        present = vectors[vectors.notna()]
        if present.empty:
            return vectors
        product = np.vstack(present.to_list()) @ matrix.T + offset
        return pd.Series(list(product), index=present.index).reindex(vectors.index)

    vec = F.col(vec) if isinstance(vec, str) else vec
    return project(vec.cast(VECTOR))


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product of two arrays."""
    products = F.zip_with(a, b, lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def euclidean(a: str | Column, b: str | Column) -> Column:
    """Euclidean distance of two arrays."""
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))


def cosine_similarity(a: str | Column, b: str | Column) -> Column:
    """Cosine similarity of two arrays."""
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
