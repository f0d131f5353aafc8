"""Totals, profiles and encodings over whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hemline.operators.ordering import OrderKey, ordered_groups

_FLOATS = (T.FloatType, T.DoubleType)


def _missing(field: T.StructField) -> Column:
    """Null, or NaN in a floating column."""
    col = F.col(f"`{field.name}`")
    return col.isNull() | F.isnan(col) if isinstance(field.dataType, _FLOATS) else col.isNull()


def item_totals(df: DataFrame, keys: str | Sequence[str], qty: str, name: str = "total") -> DataFrame:
    """Sum of ``qty`` per key."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.groupBy(*keys).agg(F.sum(qty).alias(name))


def item_totals_by_season(
    df: DataFrame, item: str, qty: str, season: str = "season", name: str = "total", overall: str | None = None
) -> DataFrame:
    """Item sums per season plus one row per item over all seasons (null season).

    ``overall`` names a flag that tells those rows from rows whose season is null.

    The rollup runs over the season sums, so raw lines are not multiplied.
    """
    by_season = item_totals(df, [item, season], qty, name)
    rolled = by_season.groupingSets([[item, season], [item]], item, season)
    flag = [(F.grouping(season) == 1).alias(overall)] if overall else []
    return rolled.agg(F.sum(name).alias(name), *flag)


def distinct_values(df: DataFrame, col: str, by: str | None = None) -> DataFrame:
    """Distinct values of a column, per group where ``by`` is given.

    One row per value: a group with very many values stays distributed.
    """
    return df.select(*([by] if by else []), f"`{col}`").distinct()


def distinct_count(
    df: DataFrame, col: str, by: str | None = None, approx: bool = False, name: str = "values"
) -> DataFrame:
    """Number of distinct values, with null counted as one value."""
    value = F.col(f"`{col}`")
    any_null = F.max(F.when(value.isNull(), 1).otherwise(0))
    if approx:
        grouped = df.groupBy(by) if by else df.groupBy()
        return grouped.agg((F.approx_count_distinct(value) + any_null).cast("long").alias(name))
    values = distinct_values(df, col, by)
    return (values.groupBy(by) if by else values.groupBy()).agg(F.count("*").alias(name))


def distinct_sketches(df: DataFrame, col: str, by: str, size: int = 12) -> DataFrame:
    """A sketch of a column's distinct values per group, to be stored: group, ``sketch``, ``any_null``, ``size``.

    Merged counts have a relative standard error of 1.04 / sqrt(2 ^ size); other types than numbers
    without fraction, texts and bytes are sketched by their text.
    """
    value = F.col(f"`{col}`")
    if df.schema[col].dataType.simpleString() not in ("int", "bigint", "string", "binary"):
        value = value.cast("string")
    sketch = F.hll_sketch_agg(value, F.lit(size)).alias("sketch")
    return df.groupBy(by).agg(sketch, F.bool_or(value.isNull()).alias("any_null"), F.lit(size).alias("size"))


def merge_sketches(sketches: DataFrame, by: str | None = None) -> DataFrame:
    """Sketches of the same size merged, in all or per group, without their rows."""
    merged = [F.hll_union_agg("sketch").alias("sketch"), F.bool_or("any_null").alias("any_null"), F.max("size").alias("size")]
    return (sketches.groupBy(by) if by else sketches.groupBy()).agg(*merged)


def sketched_count(sketches: DataFrame, name: str = "values") -> DataFrame:
    """Estimated number of distinct values, null counted as one, and its ``error`` (three standard errors)."""
    found = F.hll_sketch_estimate("sketch")
    error = F.ceil(found * 3 * 1.04 / F.sqrt(F.pow(F.lit(2.0), F.col("size"))))
    kept = [c for c in sketches.columns if c not in ("sketch", "any_null", "size")]
    return sketches.select(*kept, (found + F.col("any_null").cast("int")).cast("long").alias(name), error.alias("error"))


def null_profile(df: DataFrame, by: str | None = None) -> DataFrame:
    """Null and non-null counts per column in long form, from one aggregate."""
    fields = [f for f in df.schema if f.name != by]
    stats = [F.count_if(_missing(f)).alias(f"n{i}") for i, f in enumerate(fields)]
    row = (df.groupBy(by) if by else df.groupBy()).agg(F.count("*").alias("__rows"), *stats)
    entries = F.array(
        *[
            F.struct(F.lit(f.name).alias("column"), F.col(f"n{i}").alias("nulls"))
            for i, f in enumerate(fields)
        ]
    )
    keys = [by] if by else []
    return row.select(*keys, "__rows", F.explode(entries).alias("e")).select(
        *keys, "e.column", "e.nulls", (F.col("__rows") - F.col("e.nulls")).alias("non_nulls")
    )


def null_total(df: DataFrame) -> DataFrame:
    """Number of nulls in the whole table."""
    return null_profile(df).agg(F.sum("nulls").alias("nulls"))


def table_profile(df: DataFrame) -> DataFrame:
    """Type, non-null count and row count per column."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    return null_profile(df).select(
        "column",
        kind[F.col("column")].alias("type"),
        "non_nulls",
        (F.col("nulls") + F.col("non_nulls")).alias("rows"),
    )


def histogram(df: DataFrame, cols: Sequence[str], bins: int = 10) -> DataFrame:
    """Equal-width bin counts per numeric column; the last bin is closed.

    A constant column falls into bin 0.  Two passes: bounds, then counts that
    are combined before the shuffle.
    """
    present = {c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)) for c in cols}
    bounds = df.agg(
        *[F.min(x).alias(f"lo{i}") for i, x in enumerate(present.values())],
        *[F.max(x).alias(f"hi{i}") for i, x in enumerate(present.values())],
    ).first()
    entries = []
    for i, (c, x) in enumerate(present.items()):
        lo, hi = bounds[f"lo{i}"], bounds[f"hi{i}"]
        if lo is None or lo == hi:
            bin_no = F.lit(0)
        else:
            bin_no = F.least(F.floor((x - lo) / F.lit((hi - lo) / bins)).cast("int"), F.lit(bins - 1))
        bin_no = F.when(x.isNotNull(), bin_no)
        entries.append(F.struct(F.lit(c).alias("column"), bin_no.cast("int").alias("bin")))
    return (
        df.select(F.explode(F.array(*entries)).alias("e"))
        .select("e.column", "e.bin")
        .filter(F.col("bin").isNotNull())
        .groupBy("column", "bin")
        .agg(F.count("*").alias("rows"))
    )


def _levels(df: DataFrame, col: str, limit: int) -> list:
    """Distinct values of a column that is going to become columns."""
    rows = df.select(col).filter(F.col(col).isNotNull()).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{col} has more than {limit} values; encode it sparsely or keep it long")
    return sorted(r[0] for r in rows)


def one_hot(df: DataFrame, col: str, prefix: str, limit: int = 2000) -> DataFrame:
    """One 0/1 column ``prefix_value`` per value; a null row is all zero."""
    flags = {
        f"{prefix}_{v}": F.coalesce((F.col(col) == F.lit(v)).cast("int"), F.lit(0))
        for v in _levels(df, col, limit)
    }
    return df.withColumns(flags)


def one_hot_sparse(df: DataFrame, col: str, name: str, limit: int = 1_000_000) -> DataFrame:
    """Sparse indicator vector for columns with many values; null is all zero."""
    from pyspark.ml.feature import OneHotEncoder, StringIndexer

    if df.select(col).distinct().count() > limit:
        raise ValueError(f"{col} has more than {limit} values; keep it long")
    index = StringIndexer(
        inputCol=col, outputCol="__index", handleInvalid="keep", stringOrderType="alphabetAsc"
    )
    indexed = index.fit(df).transform(df)
    encoder = OneHotEncoder(inputCol="__index", outputCol=name, dropLast=True)
    return encoder.fit(indexed).transform(indexed).drop("__index")


def one_hot_sum(df: DataFrame, key: str, col: str, prefix: str, limit: int = 2000) -> DataFrame:
    """Indicator sums per key: how often each value occurs."""
    levels = _levels(df, col, limit)
    counts = df.groupBy(key).pivot(col, levels).agg(F.count(F.lit(1)))
    return counts.select(
        key, *[F.coalesce(F.col(f"`{v}`"), F.lit(0)).alias(f"{prefix}_{v}") for v in levels]
    )


def concat_text(
    df: DataFrame,
    key: str,
    col: str,
    order: OrderKey | Sequence[OrderKey],
    separator: str = "",
    dedupe: bool = False,
) -> DataFrame:
    """Texts of each key in ``order`` joined into one; nulls are skipped.

    ``dedupe`` keeps the first occurrence of each text; repeats are dropped
    before any text is gathered.
    """
    if dedupe:
        keys = [order] if isinstance(order, (str, Column)) else list(order)
        first = F.min(F.struct(*[(F.col(k) if isinstance(k, str) else k).alias(f"o{i}") for i, k in enumerate(keys)]))
        df, order = df.groupBy(key, col).agg(first.alias("__first")), "__first"
    pieces = ordered_groups(df, key, order, col)
    full = F.filter("pieces", lambda p: F.size(p) > 0)
    text = F.array_join(F.transform(full, lambda p: F.array_join(p, separator)), separator)
    return pieces.select(key, text.alias(col))


def mean_std(df: DataFrame, col: str) -> DataFrame:
    """Mean and sample standard deviation."""
    return df.agg(F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"))
