"""Round trips through every reader and writer, on the driver tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemline.operators import evaluation as E
from hemline.operators import scaling as Z
from hemline.plans.evaluation_queries import PRED_SQL, prediction_rows
from hemline.plans.registry import query, rounded
from hemline.plans.sales_queries import targets
from hemline.plans.scaling_queries import ANCHOR_SQL
from hemline.session import materialize, scratch_path
from hemline.sources import files as Fi
from hemline.sources import sheets as Sh
from hemline.sources import tables as Ta

PREAMBLE = ["sales export", "", "vendor;all", "period;all", "unit;pieces"]


def _sheet(df: DataFrame, path: str) -> None:
    """Write CSV files the way a spreadsheet exports them: preamble, header, rows."""
    head = [*PREAMBLE, ",".join(df.columns)]

    def lead(batches):
        yield pa.RecordBatch.from_arrays([pa.array(head, pa.string())], ["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string())], ["value"])

    lines = df.select(F.to_csv(F.struct(*df.columns)).alias("value"))
    lines.mapInArrow(lead, "value string").write.text(path)


_LINES = "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag FROM lineitem"


@query("a1_read_table", _LINES)
def a1(t):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
    path = scratch_path(t.spark)
    _sheet(lines, path)
    return Ta.read_table(t.spark, path, "csv", lines.schema, skip_rows=len(PREAMBLE))


def _broken(name: str) -> str:
    return f"{name} || ' \"' || p_type || '\",' || chr(10) || chr(10) || p_size"


@query("a1_sheet_format", f"SELECT p_partkey, {_broken('p_name')} AS note, p_retailprice, CASE WHEN p_size % 5 <> 0 THEN p_brand END AS brand FROM part")
def a1_sheet(t):
    # cells with line breaks, quotes and delimiters, in small blocks that cut through records and preamble
    note = F.concat(F.col("p_name"), F.lit(' "'), F.col("p_type"), F.lit('",\n\n'), F.col("p_size"))
    rows = t.part.select("p_partkey", note.alias("note"), "p_retailprice", F.when(F.col("p_size") % 5 != 0, F.col("p_brand")).alias("brand"))
    quoted = rows.withColumn("note", F.concat(F.lit('"'), F.replace("note", F.lit('"'), F.lit('""')), F.lit('"')))
    lines = quoted.select(F.concat_ws(",", "p_partkey", "note", "p_retailprice", F.coalesce("brand", F.lit(""))).alias("value"))
    head = "\n".join([*PREAMBLE * 40, ",".join(rows.columns)])

    def lead(batches):
        yield pa.RecordBatch.from_arrays([pa.array([head], pa.string())], ["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string())], ["value"])

    path = scratch_path(t.spark)
    lines.repartition(3).mapInArrow(lead, "value string").write.text(path)
    Sh.register(t.spark)
    reader = t.spark.read.format("sheet").option("skip_rows", len(PREAMBLE) * 40).option("block_bytes", 512)
    return reader.schema(rows.schema).load(path)


@query("a1_read_parquet", _LINES)
def a1_parquet(t):
    path = scratch_path(t.spark)
    Ta.write_table(t.lineitem, path)
    return Ta.read_table(t.spark, path, schema=t.lineitem.schema).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag"
    )


@query("a2_drop_index_columns", "SELECT p_partkey, p_name FROM part")
def a2(t):
    exported = t.part.select(
        F.col("p_partkey").alias("Unnamed: 0"), F.col("p_size").alias("Unnamed: 0.1"), "p_partkey", "p_name"
    )
    return Ta.drop_index_columns(exported)


@query("a3_write_table", "SELECT p_partkey, p_brand, p_type FROM part")
def a3(t):
    path = scratch_path(t.spark)
    rows = t.part.select("p_partkey", "p_brand", "p_type")
    Ta.write_table(rows, path, partition_by=["p_type"])
    return Ta.read_table(t.spark, path, schema=rows.schema)


@query("a3_write_csv", 'SELECT l_partkey AS item, sum(l_quantity) AS total FROM lineitem GROUP BY l_partkey')
def a3_csv(t):
    path = scratch_path(t.spark)
    totals = t.lineitem.groupBy(F.col("l_partkey").alias("item")).agg(F.sum("l_quantity").alias("total"))
    Ta.write_table(totals, path, "csv")
    return Ta.read_table(t.spark, path, "csv", totals.schema)


@query("a4_mapping", "SELECT CAST(p_partkey AS VARCHAR) AS key, p_name || ': ' || p_type AS value FROM part")
def a4(t):
    path = scratch_path(t.spark)
    mapping = t.part.select(
        F.col("p_partkey").cast("string").alias("key"), F.concat("p_name", F.lit(": "), "p_type").alias("value")
    )
    Fi.write_mapping(mapping, path)
    return Fi.read_mapping(t.spark, path)


@query("a5_list_files", "SELECT 'p_type=' || p_type AS dir, count(*) AS rows FROM part GROUP BY p_type")
def a5(t):
    path = scratch_path(t.spark)
    Ta.write_table(t.part, path, partition_by=["p_type"])
    found = Fi.list_files(t.spark, path, relative=True).filter("name LIKE 'part-%.parquet'")
    # rows are counted by the file they are read from, so a file missed or listed twice shows
    file = F.regexp_extract(F.input_file_name(), "([^/]+/[^/]+)$", 1)
    held = t.spark.read.parquet(path).select(file.alias("path")).groupBy("path").agg(F.count("*").alias("rows"))
    return found.join(held, "path").groupBy("dir").agg(F.sum("rows").alias("rows"))


_SMAPE = "avg(abs(pred - \"true\") / (abs(pred) + abs(\"true\") + 1e-6))"


@query(
    "a6_metric_report",
    f"""WITH {PRED_SQL}
    SELECT printf('all smape : %.4f', {_SMAPE}) AS line FROM pred
    UNION ALL SELECT printf('all rmse : %.4f', sqrt(avg(pow(pred - "true", 2)))) FROM pred
    UNION ALL SELECT printf('item_color %s smape : %.4f', category, {_SMAPE}) FROM pred GROUP BY category
    UNION ALL SELECT printf('item_color %s rmse : %.4f', category, sqrt(avg(pow(pred - "true", 2)))) FROM pred
      GROUP BY category""",
)
def a6(t):
    rows = prediction_rows(t)
    report = E.metric_report({"all": rows}, {"item_color": (rows, "category")}, ["smape", "rmse"])
    path = scratch_path(t.spark)
    Fi.write_metric_report(report, path)
    return Fi.read_metric_report(t.spark, path)


@query(
    "a7_params",
    f"WITH {ANCHOR_SQL} SELECT item, round(a * pow(target, lam) - b, 6) + 0.0 AS scaled FROM target, anchor",
)
def a7(t):
    items = materialize(targets(t))
    path = scratch_path(t.spark)
    Fi.save_params(t.spark, Z.fit_anchor(items, "target").params(), path)
    scaler = Z.AnchorScaler(**Fi.load_params(t.spark, path))
    return scaler.scale(items, "target").select("item", rounded("scaled").alias("scaled"))
