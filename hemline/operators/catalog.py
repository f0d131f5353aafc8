"""Attribute joins, name reconciliation and the file catalog."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hemline.operators.ordering import OrderKey, global_index, ordered_groups

# A mapping up to this size travels inside the plan; a larger one is joined.
LITERAL_MAP_LIMIT = 200


def attach_attributes(sales: DataFrame, attrs: DataFrame, key: str) -> DataFrame:
    """Left join of attributes that hold one row per key.

    No hint is given: measured sizes decide between broadcast and shuffle, and
    adaptive execution splits a hot key on the sales side.
    """
    return sales.join(attrs, key, "left")


def attach_category(
    pred: DataFrame, true: DataFrame, keys: Sequence[str], category: str = "category", fanout: bool = False
) -> DataFrame:
    """Left join of the category by item, or item and colour.

    The category side is reduced to one row per key and category; ``fanout``
    joins its rows as they are, multiplying predictions.
    """
    side = true.select(*keys, category)
    return pred.join(side if fanout else side.distinct(), list(keys), "left")


def _literal_map(mapping: Mapping) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def _side_table(spark: SparkSession, mapping: Mapping) -> DataFrame:
    """A long dictionary as a table, with the types that the literal map would have."""

    def widest(values: list) -> Column:
        first = next((v for v in values if v is not None), None)
        return F.lit(max(values, key=lambda v: abs(v or 0)) if type(first) is int else first)

    kinds = spark.range(1).select(widest(list(mapping)).alias("key"), widest(list(mapping.values())).alias("value")).schema
    side = spark.createDataFrame(list(mapping.items()), ["key", "value"])
    return side.select(*[F.col(f.name).cast(f.dataType) for f in kinds])


def map_values(
    df: DataFrame, col: str, mapping: Mapping | DataFrame, name: str | None = None, keep_unmapped: bool = False
) -> DataFrame:
    """Map values; unmapped ones become null, or stay with ``keep_unmapped``.

    ``mapping`` is a dictionary or a table with unique ``key`` and ``value``.
    """
    name = name or col
    if isinstance(mapping, Mapping) and len(mapping) > LITERAL_MAP_LIMIT:
        mapping = _side_table(df.sparkSession, mapping)
    if isinstance(mapping, Mapping):
        mapped = F.try_element_at(_literal_map(mapping), F.col(col))
        return df.withColumn(name, F.coalesce(mapped, F.col(col)) if keep_unmapped else mapped)
    side = mapping.select(F.col("key").alias("__key"), F.col("value").alias("__value"))
    joined = df.join(side, F.col(col) == F.col("__key"), "left")
    mapped = F.coalesce("__value", col) if keep_unmapped else F.col("__value")
    return joined.withColumn(name, mapped).drop("__key", "__value")


def replace_values(df: DataFrame, col: str, replacements: Mapping) -> DataFrame:
    """Whole-value replacement."""
    return df.replace(dict(replacements), subset=[col])


def replace_substring(df: DataFrame, col: str, old: str, new: str) -> DataFrame:
    """Literal substring replacement."""
    return df.withColumn(col, F.replace(F.col(col), F.lit(old), F.lit(new)))


def pair_sorted(a: DataFrame, b: DataFrame, left: str = "old", right: str = "new") -> DataFrame:
    """i-th smallest value of ``a`` beside the i-th smallest of ``b``.

    Both are one-column tables; the pairing stops at the shorter one.
    """
    first = global_index(a.toDF(left), left, "__i")
    second = global_index(b.toDF(right), right, "__i")
    return first.join(second, "__i").select(left, right)


def invert_mapping(df: DataFrame, order: str, key: str = "key", value: str = "value") -> DataFrame:
    """Value to key; of several keys the last in ``order`` wins."""
    return df.groupBy(F.col(value).alias("__key")).agg(F.max_by(key, order).alias("__value")).select(
        F.col("__key").alias(key), F.col("__value").alias(value)
    )


def build_path(df: DataFrame, parts: Sequence[Column], name: str = "path") -> DataFrame:
    """``/``-joined path; a null part makes the path null."""
    joined = reduce(lambda a, b: F.concat(a, F.lit("/"), b), parts)
    return df.withColumn(name, joined)


def trim_path_segments(df: DataFrame, col: str) -> DataFrame:
    """Strip blanks around every ``/``."""
    parts = F.transform(F.split(F.col(col), "/"), lambda p: F.trim(p))
    return df.withColumn(col, F.array_join(parts, "/"))


def attach_files(
    df: DataFrame, files: DataFrame, path: str, dir_col: str = "dir", file_col: str = "path", name: str = "files"
) -> DataFrame:
    """Sorted file list of each row's folder; a folder without files gives ``[]``."""
    listing = ordered_groups(files, dir_col, file_col, file_col).select(
        F.col(dir_col).alias("__dir"), F.flatten("pieces").alias(name)
    )
    joined = df.join(listing, F.col(path) == F.col("__dir"), "left").drop("__dir")
    return joined.withColumn(name, F.coalesce(F.col(name), F.array().cast("array<string>")))


def missing_files(
    df: DataFrame, order: OrderKey | Sequence[OrderKey], files: str = "files"
) -> DataFrame:
    """Rows with an empty file list, with their position in ``order``.

    Only the first file of a list goes through the order: a kept row's list is empty.
    """
    short = df.withColumn(files, F.slice(files, 1, 1))
    return global_index(short, order, "position").filter(F.size(files) == 0)


def assign_color_folder(
    files: DataFrame, colors: DataFrame, name: str = "name"
) -> DataFrame:
    """Folder of each file: the first colour its name starts with, else null.

    ``colors`` holds ``color`` and ``priority``; null colours are left out.  Each
    different name offers its prefixes of the lengths that occur among the
    colours, and an equality join finds them.
    """
    known = colors.filter("color is not null").select("color", "priority")
    lengths = [r[0] for r in known.select(F.length("color")).distinct().collect()]
    prefixes = F.array(*[F.when(F.length(name) >= n, F.left(F.col(name), F.lit(n))) for n in sorted(lengths)])
    names = files.select(name).distinct()
    offered = names.select(F.col(name).alias("__name"), F.explode(prefixes.cast("array<string>")).alias("color")).filter("color is not null")
    found = offered.join(known, "color").groupBy("__name").agg(F.min_by("color", "priority").alias("folder"))
    return files.join(found, F.col(name) == F.col("__name"), "left").drop("__name")


def assign_black(
    files: DataFrame, mode: str = "contains", dir_col: str = "dir", name: str = "name", word: str = "BLACK"
) -> DataFrame:
    """Files that belong into the ``word`` folder.

    ``contains``: the name holds the word in any case.  ``folder``: all files
    of a folder in which no name starts with the word.
    """
    if mode == "contains":
        hit = F.upper(F.col(name)).contains(word)
        return files.withColumn("folder", F.when(hit, F.lit(word)))
    if mode != "folder":
        raise ValueError("mode must be 'contains' or 'folder'")
    has = files.groupBy(dir_col).agg(F.bool_or(F.col(name).startswith(word)).alias("__has"))
    has = has.withColumnRenamed(dir_col, "__dir")
    joined = files.join(has, F.col(dir_col).eqNullSafe(F.col("__dir")), "left")
    return joined.withColumn("folder", F.when(~F.col("__has"), F.lit(word))).drop("__has", "__dir")


def composite_key(df: DataFrame, cols: Sequence[str], sep: str = "_", name: str = "key") -> DataFrame:
    """Columns joined into one key; a null part makes the key null."""
    parts = [p for c in cols for p in (F.lit(sep), F.col(c))][1:]
    return df.withColumn(name, F.concat(*parts))


def join_columns(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Columns of both tables side by side, aligned on a key that is unique in each."""
    for label, side in (("left", a), ("right", b)):
        repeated = side.groupBy(key).count().filter("count > 1").limit(1).collect()
        if repeated:
            raise ValueError(f"{key} repeats on the {label} side: {repeated[0][0]!r}")
    return a.join(b, key, "full")
