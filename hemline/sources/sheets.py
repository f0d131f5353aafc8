"""Exported sheets as a data source: ``spark.read.format("sheet")``.

A sheet is a delimited text file with any number of preamble lines before its
header, and cells that may hold line breaks inside quotes.  Each file is a
partition, read as a stream of blocks: a block is cut at its last line break
outside quotes, which the number of quotes before it tells, and what follows goes with the next
block.  Neither the preamble nor a record has to fit in a block, and a task holds
one block and one record.

Files are opened by their URI (local paths, and what the installed file systems
of Arrow reach); tables in a store that only Spark reads go through ``tables.read_table``.

Options: ``skip_rows`` (0), ``header`` (true), ``delimiter`` (,), ``block_bytes``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.csv as pc
import pyarrow.fs as fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_type

BLOCK_BYTES = 4_000_000
_QUOTE, _BREAK = ord('"'), ord("\n")
#: Types that a cell is read as; others are read as text and cast.
_KINDS = (T.StringType, T.IntegerType, T.LongType, T.ShortType, T.DoubleType, T.FloatType, T.BooleanType, T.DateType)


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri[len("file:") :])
    return fs.LocalFileSystem(), uri


def _files(uri: str) -> list[tuple[str, int]]:
    """Path and size of the file, or of all files below the folder; hidden names are skipped, as Spark does."""
    store, path = _opened(uri)
    info = store.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    below = store.get_file_info(fs.FileSelector(path, recursive=True))
    shown = [f for f in below if f.type == fs.FileType.File and not any(p.startswith(("_", ".")) for p in f.path[len(path) :].split("/"))]
    return sorted((f.path, f.size) for f in shown)


def body(read, skip: int, block: int) -> Iterator[bytes]:
    """Blocks of whole records of a stream, after ``skip`` lines."""
    pending = b""
    size = block
    while data := read(size):
        pending += data
        while skip and (at := pending.find(b"\n")) >= 0:
            pending, skip = pending[at + 1 :], skip - 1
        if skip:
            pending = b""
            continue
        if not pending:
            continue
        raw = np.frombuffer(pending, np.uint8)
        breaks = np.flatnonzero(raw == _BREAK)
        outside = breaks[np.searchsorted(np.flatnonzero(raw == _QUOTE), breaks) % 2 == 0]
        if len(outside):
            cut = int(outside[-1]) + 1
            yield pending[:cut]
            pending, size = pending[cut:], block
        else:
            size *= 2  # a record longer than what was read: more at once, so that it is looked through few times
    if pending and not skip:
        yield pending


def _first(block: bytes) -> int:
    """Where the block's first record ends."""
    raw = np.frombuffer(block, np.uint8)
    breaks = np.flatnonzero(raw == _BREAK)
    outside = breaks[np.searchsorted(np.flatnonzero(raw == _QUOTE), breaks) % 2 == 0]
    return int(outside[0]) + 1 if len(outside) else len(block)


def _parsed(block: bytes, names: list[str] | None, types: dict[str, pa.DataType], delimiter: str) -> pa.Table:
    reading = pc.ReadOptions(column_names=names, autogenerate_column_names=names is None, block_size=max(len(block) + 1, 1024), use_threads=False)
    parsing = pc.ParseOptions(delimiter=delimiter, newlines_in_values=True)
    # an unquoted empty cell is null, a quoted one an empty text
    converting = pc.ConvertOptions(column_types=types, null_values=[""], strings_can_be_null=True, quoted_strings_can_be_null=False)
    return pc.read_csv(pa.BufferReader(block), read_options=reading, parse_options=parsing, convert_options=converting)


@dataclass
class SheetFile(InputPartition):
    path: str


class SheetSource(DataSource):
    """The format ``sheet``."""

    @classmethod
    def name(cls) -> str:
        return "sheet"

    def _option(self, name: str, default: str) -> str:
        return str(self.options.get(name, default))

    def _settings(self) -> dict:
        return {
            "uri": self.options["path"],
            "skip": int(self._option("skip_rows", "0")),
            "header": self._option("header", "true").lower() == "true",
            "delimiter": self._option("delimiter", ","),
            "block": int(self._option("block_bytes", str(BLOCK_BYTES))),
        }

    def schema(self) -> T.StructType:
        """Text columns named by the first file's header, or by their place."""
        how = self._settings()
        for path, size in _files(how["uri"]):
            with _opened(how["uri"])[0].open_input_stream(path) as stream:
                block = next(body(stream.read, how["skip"], how["block"]), b"")
            if block:
                row = _parsed(block[: _first(block)], None, {}, how["delimiter"])
                named = [str(c[0].as_py()) for c in row.columns] if how["header"] else [f"_c{i}" for i in range(row.num_columns)]
                return T.StructType([T.StructField(n, T.StringType()) for n in named])
        raise ValueError(f"no sheet with a row in {how['uri']}")

    def reader(self, schema: T.StructType) -> SheetReader:
        return SheetReader(schema, self._settings())


class SheetReader(DataSourceReader):
    """Columns go by position; those that a file lacks are null, further ones are left out."""

    def __init__(self, schema: T.StructType, how: dict):
        self.fields, self.how = schema, how

    def partitions(self) -> list[InputPartition]:
        return [SheetFile(path) for path, size in _files(self.how["uri"]) if size]

    def read(self, partition: SheetFile) -> Iterator[pa.RecordBatch]:
        how, head = self.how, self.how["header"]
        names = [str(i) for i in range(len(self.fields))]
        read_as = {n: to_arrow_type(f.dataType) for n, f in zip(names, self.fields) if isinstance(f.dataType, _KINDS)}
        width = None
        with _opened(how["uri"])[0].open_input_stream(partition.path) as stream:
            for block in body(stream.read, how["skip"], how["block"]):
                if width is None:
                    first = _first(block)
                    width = _parsed(block[:first], None, {}, how["delimiter"]).num_columns
                    block = block[first if head else 0 :]
                if not block.strip():
                    continue
                own = [str(i) for i in range(width)]
                table = _parsed(block, own, {n: read_as.get(n, pa.string()) for n in own}, how["delimiter"])
                columns = []
                for name, field in zip(names, self.fields):
                    kind = to_arrow_type(field.dataType)
                    column = table.column(name) if name in own else pa.nulls(table.num_rows, kind)
                    columns.append(column if column.type == kind else column.cast(kind))
                yield from pa.table(columns, names=self.fields.names).combine_chunks().to_batches(max_chunksize=10_000)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(SheetSource)
