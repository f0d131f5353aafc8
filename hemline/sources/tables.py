"""Table readers and writers."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(
    spark: SparkSession,
    path: str | list[str],
    fmt: str = "parquet",
    schema: T.StructType | str | None = None,
    skip_rows: int = 0,
    header: bool = True,
) -> DataFrame:
    """Read parquet, ORC, JSON or CSV.

    ``skip_rows`` drops that many preamble lines at the start of every CSV
    file, before the header.  The preamble must lie in a file's first block, and
    a record on one line.
    """
    if skip_rows == 0:
        reader = spark.read.format(fmt)
        if fmt == "csv":
            reader = reader.option("header", header)
        return (reader.schema(schema) if schema is not None else reader).load(path)
    if fmt != "csv" or schema is None:
        raise ValueError("skip_rows needs fmt='csv' and an explicit schema")
    drop = skip_rows + int(header)
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )
    body = lines.mapInArrow(_skip_head(drop), "value string").filter(F.length("value") > 0)
    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return body.select(F.from_csv("value", struct.toDDL()).alias("row")).select("row.*")


def _skip_head(n: int):
    """Drop the first ``n`` lines of each file's block 0; lines of a block arrive in order."""

    def run(batches):
        seen: dict[str, int] = {}
        for batch in batches:
            value, starts = batch.column("value"), pc.equal(batch.column("block"), 0)
            heads = pc.unique(batch.column("file").filter(starts)).to_pylist()
            if any(seen.get(file, 0) < n for file in heads):
                keep = []
                for file, start in zip(batch.column("file").to_pylist(), starts.to_pylist()):
                    skip = start and seen.get(file, 0) < n
                    if skip:
                        seen[file] = seen.get(file, 0) + 1
                    keep.append(not skip)
                value = value.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([value], ["value"])

    return run


def drop_index_columns(df: DataFrame, prefix: str = "Unnamed:") -> DataFrame:
    """Drop the index columns a spreadsheet export leaves behind."""
    return df.drop(*[c for c in df.columns if c.startswith(prefix) or c == "_c0"])


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), mode: str = "errorifexists"
) -> None:
    """Write a table; one folder per value of ``partition_by``."""
    writer = df.write.mode(mode).format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)
