"""Totals, profiles and encodings."""

from __future__ import annotations

from pyspark.sql import functions as F

from hemline.operators import profile as P
from hemline.plans.registry import query, rounded
from hemline.plans.sales_queries import SEASON_SQL, SEASONS, seasonal_lines
from hemline.session import materialize


@query("c1_item_totals", "SELECT l_partkey, sum(l_quantity) AS total FROM lineitem GROUP BY l_partkey")
def c1(t):
    return P.item_totals(t.lineitem, "l_partkey", "l_quantity")


@query(
    "c2_item_totals_by_season",
    f"""WITH s AS ({SEASON_SQL}) SELECT l_partkey, season, sum(l_quantity) AS total FROM s
    GROUP BY GROUPING SETS ((l_partkey, season), (l_partkey))""",
)
def c2(t):
    return P.item_totals_by_season(seasonal_lines(t), "l_partkey", "l_quantity")


@query("c3_distinct_values", f"WITH s AS ({SEASON_SQL}) SELECT DISTINCT season, l_partkey FROM s")
def c3(t):
    return P.distinct_values(seasonal_lines(t), "l_partkey", by="season")


@query("c3_distinct_colors", "SELECT DISTINCT string_split(p_name, ' ')[1] AS color FROM part")
def c3_colors(t):
    return P.distinct_values(t.part.select(F.split("p_name", " ")[0].alias("color")), "color")


_HOLED = "CASE WHEN l_suppkey % 10 = 0 THEN NULL ELSE l_partkey END"


@query(
    "c4_distinct_count",
    f"""WITH s AS ({SEASON_SQL}), h AS (SELECT season, {_HOLED} AS item FROM s)
    SELECT season, count(DISTINCT item) + max(CASE WHEN item IS NULL THEN 1 ELSE 0 END) AS "values"
    FROM h GROUP BY season""",
)
def c4(t):
    holes = seasonal_lines(t).withColumn("item", F.when(F.col("l_suppkey") % 10 != 0, F.col("l_partkey")))
    return P.distinct_count(holes, "item", by="season")


@query(
    "c4_distinct_count_all",
    f"""WITH h AS (SELECT {_HOLED} AS item FROM lineitem)
    SELECT count(DISTINCT item) + max(CASE WHEN item IS NULL THEN 1 ELSE 0 END) AS "values" FROM h""",
)
def c4_all(t):
    holes = t.lineitem.withColumn("item", F.when(F.col("l_suppkey") % 10 != 0, F.col("l_partkey")))
    return P.distinct_count(holes, "item")


@query(
    "c4_merged_sketches",
    f"""WITH s AS ({SEASON_SQL}), h AS (SELECT season, {_HOLED} AS item FROM s)
    SELECT coalesce(season, 'all') AS season, count(DISTINCT item) + max(CASE WHEN item IS NULL THEN 1 ELSE 0 END) AS "values", true AS within
    FROM h GROUP BY GROUPING SETS ((season), ())""",
)
def c4_sketches(t):
    """Stored sketches per season; the last season is added from its own rows, the total from the sketches."""
    holes = seasonal_lines(t).withColumn("item", F.when(F.col("l_suppkey") % 10 != 0, F.col("l_partkey")))
    last = SEASONS[-1][0]
    stored = materialize(P.distinct_sketches(holes.where(F.col("season") != last), "item", "season"))
    stored = stored.unionByName(materialize(P.distinct_sketches(holes.where(F.col("season") == last), "item", "season")))
    total = P.merge_sketches(stored).withColumn("season", F.lit("all"))
    found = P.sketched_count(stored.unionByName(total), "estimate")
    exact = P.distinct_count(holes, "item", by="season").unionByName(P.distinct_count(holes, "item").select(F.lit("all").alias("season"), "values"))
    within = F.abs(F.col("estimate") - F.col("values")) <= F.col("error")
    return exact.join(found, "season").select("season", "values", within.alias("within"))


def _order_holes(t):
    return t.orders.select(
        F.year("o_orderdate").cast("string").alias("season"),
        F.when(F.col("o_custkey") % 7 != 0, F.col("o_orderpriority")).alias("kind"),
        F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")).alias("price"),
    )


_ORDER_HOLES = """SELECT CAST(year(o_orderdate) AS VARCHAR) AS season,
  CASE WHEN o_custkey % 7 != 0 THEN o_orderpriority END AS kind,
  CASE WHEN o_orderkey % 4 != 0 THEN o_totalprice END AS price FROM orders"""


@query(
    "c5_null_profile",
    f"""WITH o AS ({_ORDER_HOLES})
    SELECT season, 'kind' AS "column", count(*) - count(kind) AS nulls, count(kind) AS non_nulls FROM o GROUP BY season
    UNION ALL
    SELECT season, 'price', count(*) - count(price), count(price) FROM o GROUP BY season""",
)
def c5(t):
    return P.null_profile(_order_holes(t), by="season")


@query(
    "c5_null_total",
    f"WITH o AS ({_ORDER_HOLES}) SELECT 2 * count(*) - count(kind) - count(price) AS nulls FROM o",
)
def c5_total(t):
    return P.null_total(_order_holes(t))


@query(
    "c6_table_profile",
    f"""WITH o AS ({_ORDER_HOLES})
    SELECT 'season' AS "column", 'string' AS type, count(season) AS non_nulls, count(*) AS rows FROM o
    UNION ALL SELECT 'kind', 'string', count(kind), count(*) FROM o
    UNION ALL SELECT 'price', 'double', count(price), count(*) FROM o""",
)
def c6(t):
    return P.table_profile(_order_holes(t))


_BINS = """SELECT '{c}' AS "column", CAST(least(floor((x - lo) / ((hi - lo) / 10)), 9) AS INTEGER) AS bin, count(*) AS rows
  FROM (SELECT {c} AS x FROM lineitem), (SELECT min({c}) AS lo, max({c}) AS hi FROM lineitem) GROUP BY 1, 2"""


@query("c7_histogram", " UNION ALL ".join(_BINS.format(c=c) for c in ("l_quantity", "l_extendedprice", "l_tax")))
def c7(t):
    return P.histogram(t.lineitem, ["l_quantity", "l_extendedprice", "l_tax"])


_KINDS = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


@query(
    "c8_one_hot",
    "SELECT p_partkey, "
    + ", ".join(f"CASE WHEN p_type = '{k}' THEN 1 ELSE 0 END AS \"Type_{k}\"" for k in _KINDS)
    + " FROM part",
)
def c8(t):
    return P.one_hot(t.part.select("p_partkey", "p_type"), "p_type", "Type").drop("p_type")


@query(
    "c8_one_hot_sparse",
    "SELECT p_partkey, 1.0::DOUBLE AS total, dense_rank() OVER (ORDER BY p_type) - 1 AS level FROM part",
)
def c8_sparse(t):
    from pyspark.ml.functions import vector_to_array

    coded = P.one_hot_sparse(t.part, "p_type", "coded")
    dense = vector_to_array("coded")
    total = F.aggregate(dense, F.lit(0.0), lambda a, x: a + x)
    level = F.array_position(dense, 1.0) - 1
    return coded.select("p_partkey", total.alias("total"), level.alias("level"))


@query(
    "c9_one_hot_sum",
    "SELECT p_brand, "
    + ", ".join(f"count(*) FILTER (WHERE p_type = '{k}') AS \"Type_{k}\"" for k in _KINDS)
    + " FROM part GROUP BY p_brand",
)
def c9(t):
    return P.one_hot_sum(t.part, "p_brand", "p_type", "Type")


@query(
    "c10_concat_text",
    "SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id",
)
def c10(t):
    return P.concat_text(t.conversations, "conv_id", "text", "turn")


@query(
    "c10_concat_text_dedupe",
    """WITH f AS (SELECT p_brand, p_type, min(p_partkey) AS first FROM part GROUP BY p_brand, p_type)
    SELECT p_brand, string_agg(p_type, '|' ORDER BY first) AS p_type FROM f GROUP BY p_brand""",
)
def c10_dedupe(t):
    return P.concat_text(t.part, "p_brand", "p_type", "p_partkey", separator="|", dedupe=True)


@query(
    "c11_mean_std",
    "SELECT round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std FROM lineitem",
)
def c11(t):
    return P.mean_std(t.lineitem, "l_quantity").select(rounded("mean").alias("mean"), rounded("std").alias("std"))
