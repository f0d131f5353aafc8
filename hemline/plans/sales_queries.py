"""Sales preparation on line items: item = part, cohort = brand, date = ship date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemline.operators import ordering as O
from hemline.operators import sales as S
from hemline.plans.registry import Tables, query, rounded

SEASONS = S.spring_summer(range(1995, 2002))
# Cohorts that turn old one season after the other.
COHORTS = ["Brand#11", "Brand#12", "Brand#13", "Brand#14", "Brand#15", "Brand#16", "Brand#17"]
LINE_ORDER = [
    "l_shipdate", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
    "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
]
LINE_ORDER_SQL = ", ".join(LINE_ORDER)

SEASON_SQL = """SELECT *, CAST(year(l_shipdate) AS VARCHAR) AS season FROM lineitem
  WHERE month(l_shipdate) BETWEEN 3 AND 8 AND year(l_shipdate) BETWEEN 1995 AND 2001"""

TARGET_SQL = """first AS (
  SELECT l_partkey, min(CAST(l_shipdate AS DATE)) AS first_sale FROM lineitem GROUP BY l_partkey
), target AS (
  SELECT l.l_partkey AS item, f.first_sale, sum(l.l_quantity) AS target
  FROM lineitem l JOIN first f ON l.l_partkey = f.l_partkey
  WHERE CAST(l.l_shipdate AS DATE) < f.first_sale + 112
  GROUP BY l.l_partkey, f.first_sale
)"""


def seasonal_lines(t: Tables) -> DataFrame:
    return S.season_slice(t.lineitem, "l_shipdate", SEASONS)


def percent_lines(t: Tables) -> DataFrame:
    return t.lineitem.withColumn("discount", F.round(F.col("l_discount") * 100).cast("int"))


def targets(t: Tables) -> DataFrame:
    """16-week target per part: item, first_sale, target."""
    lines = t.lineitem.withColumnRenamed("l_partkey", "item")
    return S.sales_target(lines, "item", "l_shipdate", "l_quantity")


@query(
    "b1_cast_columns",
    """SELECT l_orderkey, l_linenumber, l_partkey, CAST(trunc(l_extendedprice) AS INTEGER) AS price,
    CAST(trunc(l_quantity) AS INTEGER) AS qty, strftime(l_shipdate, '%Y-%m-%d') AS ship_day FROM lineitem""",
)
def b1(t):
    text = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").alias("qty"), F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("shipped"),
    )
    typed = S.cast_columns(text, {"price": "int", "qty": "int", "shipped": "timestamp"})
    return typed.withColumn("ship_day", F.date_format("shipped", "yyyy-MM-dd")).drop("shipped")


@query("b2_sort_by", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem")
def b2_sort(t):
    return S.project(O.sort_by(t.lineitem, LINE_ORDER), ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"])


@query(
    "b2_global_index",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    row_number() OVER (ORDER BY {LINE_ORDER_SQL}) - 1 AS row_index FROM lineitem""",
)
def b2_index(t):
    indexed = O.global_index(t.lineitem, LINE_ORDER)
    return indexed.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "row_index")


@query("b3_season_slice", f"WITH s AS ({SEASON_SQL}) SELECT l_orderkey, l_linenumber, l_partkey, season FROM s")
def b3(t):
    return seasonal_lines(t).select("l_orderkey", "l_linenumber", "l_partkey", "season")


_COHORT_CASE = " ".join(
    f"WHEN season = '{s}' THEN NOT regexp_matches(p_brand, '{p}')"
    for s, p in S.growing_patterns([s for s, _, _ in SEASONS], COHORTS).items()
)


@query(
    "b4_exclude_old_cohorts",
    f"""WITH s AS ({SEASON_SQL})
    SELECT season, p_brand, count(*) AS n, sum(l_quantity) AS qty FROM s JOIN part ON l_partkey = p_partkey
    WHERE CASE {_COHORT_CASE} ELSE TRUE END GROUP BY season, p_brand""",
)
def b4(t):
    rules = S.growing_patterns([s for s, _, _ in SEASONS], COHORTS)
    lines = seasonal_lines(t).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    kept = S.exclude_old_cohorts(lines, "p_brand", rules)
    return kept.groupBy("season", "p_brand").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))


@query(
    "b3_season_join",
    """WITH months AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS start FROM orders),
    seasons AS (
      SELECT strftime(start, '%Y-%m') AS season, start, CAST(start + INTERVAL 45 DAY AS DATE) AS "end" FROM months
      UNION ALL SELECT DISTINCT strftime(start, '%Y'), CAST(date_trunc('year', start) AS DATE), CAST(date_trunc('year', start) + INTERVAL 1 YEAR AS DATE) FROM months)
    SELECT season, count(*) AS n, sum(l_quantity) AS qty FROM lineitem JOIN seasons ON l_shipdate >= start AND l_shipdate < "end" GROUP BY season""",
)
def b3_join(t):
    months = t.orders.select(F.trunc("o_orderdate", "month").alias("start")).distinct()
    promotions = months.select(F.date_format("start", "yyyy-MM").alias("season"), "start", F.date_add("start", 45).alias("end"))
    year = F.trunc("start", "year")
    years = months.select(F.date_format("start", "yyyy").alias("season"), year.alias("start"), F.add_months(year, 12).alias("end")).distinct()
    placed = S.season_join(t.lineitem, "l_shipdate", promotions.unionByName(years))
    return placed.groupBy("season").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))


# Suppliers turn old one year after the other; an old one's two numbers, written together, rule codes out.
_RULES_SQL = """rules AS (SELECT CAST(y AS VARCHAR) AS season, CAST(s_suppkey AS VARCHAR) || CAST(s_nationkey AS VARCHAR) AS pattern
  FROM supplier, range(1992, 2003) r(y) WHERE 1992 + s_nationkey % 9 <= y)"""


@query(
    "b4_rule_table",
    f"""WITH {_RULES_SQL}, codes AS (
      SELECT CAST(year(o_orderdate) AS VARCHAR) AS season, c_name AS code, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
    SELECT season, count(*) AS codes, CAST(sum(n) AS BIGINT) AS orders FROM codes c
    WHERE NOT EXISTS (SELECT 1 FROM rules r WHERE r.season = c.season AND contains(c.code, r.pattern)) GROUP BY season""",
)
def b4_table(t):
    years = F.explode(F.sequence(F.lit(1992) + F.col("s_nationkey") % 9, F.lit(2002)))
    rules = t.supplier.select(years.alias("season"), F.concat(F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")).alias("pattern"))
    rules = rules.withColumn("season", F.col("season").cast("string"))
    sold = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.year("o_orderdate").cast("string").alias("season"), F.col("c_name").alias("code"))
    kept = S.exclude_by_rules(sold, "code", rules)
    return kept.groupBy("season").agg(F.count_distinct("code").alias("codes"), F.count("*").alias("orders"))


@query(
    "b5_union_seasons",
    """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
    WHERE month(l_shipdate) BETWEEN 3 AND 8 AND year(l_shipdate) = 1996
    UNION ALL SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
    WHERE month(l_shipdate) BETWEEN 3 AND 8 AND year(l_shipdate) = 1998""",
)
def b5(t):
    frames = [S.season_slice(t.lineitem, "l_shipdate", S.spring_summer([y])) for y in (1996, 1998)]
    return S.union_seasons(*frames).select("l_orderkey", "l_linenumber", "l_partkey")


_BAND = """SELECT l_orderkey, l_linenumber, l_partkey, CAST(round(l_discount * 100) AS INTEGER) AS discount
FROM lineitem WHERE round(l_discount * 100) {} 0 AND round(l_discount * 100) < 5"""


@query("b6_discount_band", _BAND.format(">="))
def b6(t):
    return S.discount_band(percent_lines(t), "discount", 0, 5).select(
        "l_orderkey", "l_linenumber", "l_partkey", "discount"
    )


@query("b6_discount_band_strict", _BAND.format(">"))
def b6_strict(t):
    return S.discount_band(percent_lines(t), "discount", 0, 5, closed="neither").select(
        "l_orderkey", "l_linenumber", "l_partkey", "discount"
    )


@query(
    "b7_value_filter",
    """SELECT l_orderkey, l_linenumber, l_partkey, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
    WHERE s_name = 'Supplier#000000001' AND round(l_discount * 100) >= 3 AND l_quantity != 7""",
)
def b7(t):
    lines = percent_lines(t).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    for col, op, value in (("s_name", "=", "Supplier#000000001"), ("discount", ">=", 3), ("l_quantity", "!=", 7)):
        lines = S.value_filter(lines, col, op, value)
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "s_name")


@query(
    "b8_exclude_containing",
    """SELECT o_orderpriority, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    WHERE o_orderpriority NOT LIKE '%URGENT%' GROUP BY o_orderpriority""",
)
def b8(t):
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return S.exclude_containing(lines, "o_orderpriority", "URGENT").groupBy("o_orderpriority").agg(
        F.count("*").alias("n")
    )


@query(
    "b8_exclude_items",
    """SELECT l_partkey, count(*) AS n FROM lineitem
    WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO') GROUP BY l_partkey""",
)
def b8_items(t):
    deny = t.part.filter("p_type = 'PROMO'").select(F.col("p_partkey").alias("l_partkey"))
    return S.exclude_items(t.lineitem, "l_partkey", deny).groupBy("l_partkey").agg(F.count("*").alias("n"))


@query("b9_substring_filter", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring%'")
def b9(t):
    return S.substring_filter(t.part, "p_name", "ring").select("p_partkey", "p_name")


@query(
    "b10_fill_where_null",
    """WITH o AS (SELECT o_orderkey, o_orderdate,
      CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS kind FROM orders)
    SELECT o_orderkey, CASE WHEN kind IS NULL AND year(o_orderdate) = 1998 THEN '3-MEDIUM' ELSE kind END AS kind
    FROM o""",
)
def b10(t):
    holes = t.orders.withColumn("kind", F.when(F.col("o_custkey") % 7 != 0, F.col("o_orderpriority")))
    filled = S.fill_where_null(holes, "kind", "3-MEDIUM", F.year("o_orderdate") == 1998)
    return filled.select("o_orderkey", "kind")


@query(
    "b11_forward_fill",
    f"""WITH h AS (SELECT *, CASE WHEN l_partkey % 5 = 0 THEN l_suppkey END AS code,
      CASE WHEN l_orderkey % 3 = 0 THEN l_returnflag END AS flag FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
      last_value(code IGNORE NULLS) OVER w AS code, last_value(flag IGNORE NULLS) OVER w AS flag
    FROM h WINDOW w AS (ORDER BY {LINE_ORDER_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def b11(t):
    holes = t.lineitem.withColumn("code", F.when(F.col("l_partkey") % 5 == 0, F.col("l_suppkey"))).withColumn(
        "flag", F.when(F.col("l_orderkey") % 3 == 0, F.col("l_returnflag"))
    )
    filled = O.forward_fill(holes, ["code", "flag"], LINE_ORDER)
    return filled.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "code", "flag")


@query("b12_drop_duplicates", "SELECT DISTINCT l_returnflag, l_linestatus, l_quantity, l_discount FROM lineitem")
def b12(t):
    return S.drop_duplicates(t.lineitem.select("l_returnflag", "l_linestatus", "l_quantity", "l_discount"))


@query(
    "b12_first_per_key",
    f"""SELECT l_partkey, l_orderkey, l_quantity FROM (SELECT *,
      row_number() OVER (PARTITION BY l_partkey ORDER BY {LINE_ORDER_SQL}) AS rn FROM lineitem) WHERE rn = 1""",
)
def b12_first(t):
    kept = S.drop_duplicates(t.lineitem, ["l_partkey"], keep_first_by=LINE_ORDER)
    return kept.select("l_partkey", "l_orderkey", "l_quantity")


@query("b13_project", "SELECT p_partkey, p_brand, p_size FROM part")
def b13_project(t):
    return S.project(S.project_out(t.part, ["p_retailprice", "p_type", "absent"]), ["p_partkey", "p_brand", "p_size"])


@query("b13_align_columns", "SELECT p_name, p_partkey FROM part")
def b13(t):
    train = t.part.select("p_name", "p_partkey")
    return S.align_columns(t.part, train)


@query("b14_rename", "SELECT p_partkey AS item, p_name AS name, p_type FROM part")
def b14(t):
    return S.rename(t.part, {"p_partkey": "item", "p_name": "name"}).select("item", "name", "p_type")


_SLICE = "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY {} LIMIT {}"


def _keys(df):
    return df.select("l_orderkey", "l_linenumber", "l_partkey")


@query("b15_head", _SLICE.format(LINE_ORDER_SQL, "5"))
def b15_head(t):
    return _keys(O.head(t.lineitem, LINE_ORDER))


@query("b15_tail", _SLICE.format(", ".join(f"{c} DESC" for c in LINE_ORDER), "5"))
def b15_tail(t):
    return _keys(O.tail(t.lineitem, LINE_ORDER))


@query("b15_slice_rows", _SLICE.format(LINE_ORDER_SQL, "30 OFFSET 20"))
def b15_slice(t):
    return _keys(O.slice_rows(t.lineitem, LINE_ORDER, 30, 20))


_WORDS = "SELECT string_split(p_name, ' ')[1] AS name FROM part"
_TYPES = "SELECT lower(p_type) AS name FROM part"


def _names(t):
    words = t.part.select(F.split("p_name", " ")[0].alias("name"))
    return words, t.part.select(F.lower("p_type").alias("name"))


@query("b16_set_difference", f"{_WORDS} EXCEPT {_TYPES}")
def b16(t):
    words, types = _names(t)
    return S.set_difference(words, types)


@query("b16_set_difference_back", f"{_TYPES} EXCEPT {_WORDS}")
def b16_back(t):
    words, types = _names(t)
    return S.set_difference(types, words)


@query(
    "b17_sales_target",
    f"WITH {TARGET_SQL} SELECT item, CAST(first_sale AS VARCHAR) AS first_sale, target FROM target",
)
def b17(t):
    return targets(t).withColumn("first_sale", F.col("first_sale").cast("string"))


@query(
    "cleaned_season_totals",
    f"""WITH s AS ({SEASON_SQL}), kept AS (
      SELECT s.*, p_type FROM s JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
      WHERE CASE {_COHORT_CASE} ELSE TRUE END AND round(l_discount * 100) < 5
      AND o_orderpriority NOT LIKE '%URGENT%')
    SELECT season, l_partkey, p_type, sum(l_quantity) AS total FROM kept GROUP BY season, l_partkey, p_type""",
)
def cleaned(t):
    """The cleaning flow end to end: season, cohort, discount, gifts, totals, attributes."""
    rules = S.growing_patterns([s for s, _, _ in SEASONS], COHORTS)
    lines = S.season_slice(percent_lines(t), "l_shipdate", SEASONS)
    lines = S.discount_band(lines, "discount", 0, 5)
    brands = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type")
    lines = S.exclude_old_cohorts(lines.join(brands, "l_partkey"), "p_brand", rules)
    gifts = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    lines = S.exclude_containing(lines.join(gifts, "l_orderkey"), "o_orderpriority", "URGENT")
    return lines.groupBy("season", "l_partkey", "p_type").agg(rounded(F.sum("l_quantity")).alias("total"))
