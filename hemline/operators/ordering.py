"""Operators that need a total order, without a single-partition window.

A global position, a running total and a forward fill all depend on every row
before the current one.  They share one shape: range-partition by the order,
sort inside each partition, write the result once with a row id that holds
(partition, position), then correct each partition by a carry table of one row
per partition.  The carry table is bounded by the number of shuffle partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hemline.session import materialize

ROW_ID = "__row_id"
# True on the last row of each partition, for tables that went through ``within``.
LAST = "__last"
# monotonically_increasing_id keeps the position in its lower 33 bits.
_POSITION_BITS = 33

OrderKey = str | Column


def _columns(order: OrderKey | Sequence[OrderKey]) -> list[Column]:
    keys = [order] if isinstance(order, (str, Column)) else list(order)
    return [F.col(k) if isinstance(k, str) else k for k in keys]


def _part() -> Column:
    return F.shiftright(F.col(ROW_ID), _POSITION_BITS)


def _position() -> Column:
    return F.col(ROW_ID).bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))


def sort_by(df: DataFrame, order: OrderKey | Sequence[OrderKey]) -> DataFrame:
    """Ascending sort over range partitions."""
    return df.orderBy(*_columns(order))


def ordered_table(
    df: DataFrame,
    order: OrderKey | Sequence[OrderKey],
    within: Callable[[Iterable[pa.RecordBatch]], Iterable[pa.RecordBatch]] | None = None,
    schema: T.StructType | None = None,
) -> DataFrame:
    """``df`` range-partitioned and sorted by ``order``, written once, with a row id.

    ``within`` sees each sorted partition as Arrow batches.  A hash of the other
    columns and the input partition break ties, so one order value, or one row
    copied many times, still spreads over several range partitions.
    """
    keys = _columns(order)
    named = {k for k in ([order] if isinstance(order, (str, Column)) else order) if isinstance(k, str)}
    hashed = [
        f"`{f.name}`"
        for f in df.schema
        if f.name not in named and not isinstance(f.dataType, (T.MapType, T.VariantType))
    ]
    ties = {"__input": F.spark_partition_id()}
    if hashed:
        ties = {"__hash": F.xxhash64(*hashed), **ties}
    keys = [*keys, *[F.col(c) for c in ties]]
    placed = df.withColumns(ties).repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*ties)
    if within is not None:
        schema = T.StructType([*(schema or df.schema).fields, T.StructField(LAST, T.BooleanType())])
        placed = placed.mapInArrow(_marking_last(within), schema)
    return materialize(placed.withColumn(ROW_ID, F.monotonically_increasing_id()))


def _marking_last(within):
    def flagged(batch, last: bool):
        flags = pa.array([False] * (batch.num_rows - 1) + [last], pa.bool_())
        return pa.RecordBatch.from_arrays([*batch.columns, flags], names=[*batch.schema.names, LAST])

    def run(batches):
        held = None
        for batch in within(batches):
            if batch.num_rows:
                if held is not None:
                    yield flagged(held, False)
                held = batch
        if held is not None:
            yield flagged(held, True)

    return run


def _with_carry(placed: DataFrame, carry: DataFrame) -> DataFrame:
    """Attach the per-partition carry row (at most one per shuffle partition)."""
    return placed.withColumn("__part", _part()).join(F.broadcast(carry), "__part", "left").drop("__part")


def global_index(
    df: DataFrame, order: OrderKey | Sequence[OrderKey], name: str = "row_index", start: int = 0
) -> DataFrame:
    """Position of every row in ``order``, counted from ``start``."""
    placed = ordered_table(df, order)
    counts = placed.groupBy(_part().alias("__part")).agg(F.count("*").alias("__rows"))
    before = F.sum("__rows").over(Window.orderBy("__part")) - F.col("__rows")
    carry = counts.select("__part", before.alias("__before"))
    index = F.col("__before") + _position() + F.lit(start)
    return _with_carry(placed, carry).select(*df.columns, index.cast("long").alias(name))


def _fill_batches(cols: Sequence[str]):
    wanted = set(cols)

    def run(batches):
        last = {}
        for batch in batches:
            arrays = []
            for name, values in zip(batch.schema.names, batch.columns):
                if name in wanted:
                    values = pc.fill_null_forward(values)
                    if name in last:
                        values = pc.fill_null(values, last[name])
                    if len(values) and values[-1].is_valid:
                        last[name] = values[-1]
                arrays.append(values)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return run


def forward_fill(
    df: DataFrame, cols: str | Sequence[str], order: OrderKey | Sequence[OrderKey]
) -> DataFrame:
    """Carry the last seen value of ``cols`` down the sheet in ``order``."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    placed = ordered_table(df, order, within=_fill_batches(cols))
    lasts = placed.filter(LAST).select(
        _part().alias("__part"), *[F.col(f"`{c}`").alias(f"__last_{i}") for i, c in enumerate(cols)]
    )
    above = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carry = lasts.select(
        "__part",
        *[F.last(f"__last_{i}", ignorenulls=True).over(above).alias(f"__carry_{i}") for i in range(len(cols))],
    )
    slot = {c: i for i, c in enumerate(cols)}
    return _with_carry(placed, carry).select(
        *[
            F.coalesce(F.col(f"`{c}`"), F.col(f"__carry_{slot[c]}")).alias(c) if c in slot else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def _running_batches(weight: str, total: str):
    def run(batches):
        carried = 0
        for batch in batches:
            sums = pc.add(pc.cumulative_sum(batch.column(weight)), carried)
            if len(sums):
                carried = sums[-1].as_py()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, sums], names=[*batch.schema.names, total]
            )

    return run


def running_total(
    df: DataFrame, weight: str, order: OrderKey | Sequence[OrderKey], name: str = "running"
) -> DataFrame:
    """Sum of the integer column ``weight`` over all rows up to and including each row."""
    df = df.withColumn(weight, F.col(weight).cast("long"))
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.LongType())])
    placed = ordered_table(df, order, within=_running_batches(weight, name), schema=schema)
    sums = placed.filter(LAST).select(_part().alias("__part"), F.col(name).alias("__sum"))
    before = F.sum("__sum").over(Window.orderBy("__part")) - F.col("__sum")
    carry = sums.select("__part", before.alias("__before"))
    return _with_carry(placed, carry).select(
        *df.columns, (F.col(name) + F.col("__before")).alias(name)
    )


def head(df: DataFrame, order: OrderKey | Sequence[OrderKey], n: int = 5) -> DataFrame:
    """First ``n`` rows in ``order``."""
    return slice_rows(df, order, n)


def _reversed(key: OrderKey) -> Column:
    """The key in the opposite direction, its nulls at the opposite end."""
    if isinstance(key, str):
        return F.col(key).desc_nulls_last()
    node = key._jc.node()
    if node.getClass().getSimpleName() != "SortOrder":
        return key.desc_nulls_last()
    child = Column(SparkContext._active_spark_context._jvm.org.apache.spark.sql.Column(node.child()))
    descending = "Descending" in node.sortDirection().getClass().getName()
    first = "NullsFirst" in node.nullOrdering().getClass().getName()
    names = {(True, True): "asc_nulls_last", (True, False): "asc_nulls_first", (False, True): "desc_nulls_last", (False, False): "desc_nulls_first"}
    return getattr(child, names[descending, first])()


def tail(df: DataFrame, order: OrderKey | Sequence[OrderKey], n: int = 5) -> DataFrame:
    """Last ``n`` rows in ``order``, returned in ascending order: the first ones of the order turned around."""
    keys = [order] if isinstance(order, (str, Column)) else list(order)
    return df.orderBy(*[_reversed(k) for k in keys]).limit(n).orderBy(*_columns(order))


def slice_rows(
    df: DataFrame, order: OrderKey | Sequence[OrderKey], n: int, offset: int = 0
) -> DataFrame:
    """Rows ``offset`` to ``offset + n - 1`` by position in ``order``."""
    ordered = df.orderBy(*_columns(order))
    return ordered.offset(offset).limit(n) if offset else ordered.limit(n)


def _pieces(keys: Sequence[str]):
    """Runs of rows with equal keys as one row each, its non-null values in a list; a run may go on in the next batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            new[0] = True
            for key in keys:
                codes = pc.fill_null(batch.column(key).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            starts, values = np.flatnonzero(new), batch.column("__value")
            held = pc.is_valid(values).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(held)])
            offsets = pa.array(np.append(ends[starts], ends[-1]).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, values.filter(pa.array(held)))
            firsts = batch.take(pa.array(starts))
            yield pa.RecordBatch.from_arrays([*[firsts.column(k) for k in keys], lists], names=[*keys, "__piece"])

    return run


def ordered_groups(
    df: DataFrame, key: str | Sequence[str], order: OrderKey | Sequence[OrderKey], value: str | Column
) -> DataFrame:
    """One array per key with the non-null values in ``order``.

    The rows are range-partitioned by key and order and sorted, so a key holding
    much of the table is sorted in pieces; each run of a key becomes a piece where it lies, and the
    only further shuffle puts finished pieces behind each other.  Columns: the keys and
    ``pieces``, an array of arrays.
    """
    keys = [key] if isinstance(key, str) else list(key)
    value = F.col(value) if isinstance(value, str) else value
    named = [o.alias(f"o{i}") for i, o in enumerate(_columns(order))]
    rows = df.select(*keys, F.struct(*named).alias("__order"), value.alias("__value"))
    place = [*keys, "__order", "__value"]
    placed = rows.repartitionByRange(*place).sortWithinPartitions(*place).select(*keys, "__value")
    fields = {f.name: f for f in placed.schema}
    shape = T.StructType([*[fields[k] for k in keys], T.StructField("__piece", T.ArrayType(fields["__value"].dataType))])
    pieces = placed.mapInArrow(_pieces(keys), shape).withColumn("__part", F.monotonically_increasing_id())
    ordered = F.sort_array(F.collect_list(F.struct("__part", "__piece")))
    return pieces.groupBy(*keys).agg(F.transform(ordered, lambda p: p["__piece"]).alias("pieces"))
