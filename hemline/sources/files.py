"""Mapping files, folder listings, metric reports and run parameters."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_mapping(df: DataFrame, path: str, key: str = "key", value: str = "value") -> None:
    """Text lines ``key: value``; a null value is written as nothing, and a null key or one with a colon raises."""
    bad = F.col(key).isNull() | F.col(key).cast("string").contains(":")
    checked = F.when(bad, F.raise_error(F.lit("a mapping key is null or holds a colon"))).otherwise(F.col(key).cast("string"))
    df.select(F.concat(checked, F.lit(": "), F.coalesce(F.col(value).cast("string"), F.lit(""))).alias("value")).write.text(path)


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """Table (key, value) from ``key: value`` lines; only the first colon separates, no value is null."""
    parts = F.split(F.trim("value"), ":", 2)
    lines = spark.read.text(path).filter(F.col("value").contains(":"))
    return lines.select(parts[0].alias("key"), F.nullif(F.trim(parts[1]), F.lit("")).alias("value"))


def list_files(spark: SparkSession, root: str, relative: bool = False) -> DataFrame:
    """Every file below ``root``: folder, name and full path; contents are not read."""
    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    )
    if relative:
        found = found.withColumn("path", F.regexp_replace("path", "^.*?" + _literal(root.rstrip("/")) + "/", ""))
    name = F.element_at(F.split("path", "/"), -1)
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit(""))
    return found.select(folder.alias("dir"), name.alias("name"), "path")


def _literal(text: str) -> str:
    return "\\Q" + text.split(":", 1)[-1].lstrip("/") + "\\E"


def write_metric_report(metrics: DataFrame, path: str) -> None:
    """Lines ``scope [category] metric : value`` at 4 decimals."""
    label = F.concat_ws(" ", "scope", "category", "metric")
    metrics.select(F.format_string("%s : %.4f", label, F.col("value")).alias("value")).write.text(path)


def read_metric_report(spark: SparkSession, path: str) -> DataFrame:
    """Report lines as text."""
    return spark.read.text(path).select(F.col("value").alias("line"))


_KINDS = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}


def _kind(value: object) -> T.DataType:
    """Spark type of a setting; a list has the type of its first element."""
    if isinstance(value, (list, tuple)):
        return T.ArrayType(_kind(value[0]) if value else T.StringType())
    return _KINDS[type(value)]


def save_params(spark: SparkSession, params: Mapping, path: str) -> None:
    """One-row JSON of a run's settings or of fitted numbers."""
    known = {k: v for k, v in params.items() if v is not None}
    known = {k: v.item() if hasattr(v, "item") else v for k, v in known.items()}
    schema = T.StructType([T.StructField(k, _kind(v)) for k, v in known.items()])
    spark.createDataFrame([tuple(known.values())], schema).write.json(path)


def load_params(spark: SparkSession, path: str) -> dict:
    """Settings written by ``save_params``."""
    return spark.read.json(path).first().asDict()
