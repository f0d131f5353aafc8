"""Helpers of the operators in this folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hemline.session import scratch_path

#: Text handled at once inside a task, in characters (one text is never cut).
CHUNK_CHARS = 4_000_000
#: Rows per Arrow batch, so that a batch of very long texts still fits in a worker.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches of this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(key: Column | str, parts: int) -> Column:
    """crc32 of a key as text, modulo ``parts``; null for a null key."""
    return F.pmod(F.crc32(F.col(key).cast("string") if isinstance(key, str) else key.cast("string")), F.lit(parts))


def chunks(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch with their texts (null: empty) of about ``limit`` characters each."""
    texts = [t or "" for t in batch.column(text).to_pylist()]
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield batch.slice(begin, i - begin), texts[begin:i]
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield batch.slice(begin), texts[begin:]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the result."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns, so that other names cannot clash with an operator's own."""
    return df.select(*names)


def regroup(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Rows of several batches together, of about ``limit`` characters, with their texts (null: empty)."""
    held: list[pa.RecordBatch] = []
    texts: list[str] = []
    size = 0
    for batch in batches:
        for part, more in chunks(batch, text, limit):
            chars = sum(map(len, more))
            if held and size + chars > limit:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0], texts
                held, texts, size = [], [], 0
            held.append(part)
            texts += more
            size += chars
    if texts:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0], texts


def dealt(limit: int, text: str = "text"):
    """For ``mapInArrow``: rows of a task in chunks of about ``limit`` bytes of text, their number in a first column ``chunk``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            numbers = []
            for value in batch.column(text):
                more = value.as_buffer().size
                if size and size + more > limit:
                    chunk, size = chunk + 1, 0
                size += more
                numbers.append(chunk)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), *batch.columns], ["chunk", *batch.schema.names])

    return run


def bucketed(df: DataFrame, buckets: int, key: str) -> DataFrame:
    """``df`` written to the shared folder in hash buckets of ``key``; grouping it by ``key`` then moves no rows.

    The entry of the catalog goes at once, the files stay until the scratch folder is emptied.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    name = "hemline_" + path.rsplit("/", 1)[1]
    df.write.option("path", path).option("compression", "zstd").bucketBy(max(1, min(buckets, 100_000)), key).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def compressed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder in less space, and read back."""
    path = scratch_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
