"""Attribute joins and the file catalog: pages and part names stand in for files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemline.operators import catalog as C
from hemline.operators import sales as S
from hemline.plans.registry import Tables, query
from hemline.plans.sales_queries import TARGET_SQL, targets

PAGE_FILES_SQL = """SELECT page_id, path, regexp_replace(path, '/[^/]*$', '') AS dir,
  regexp_extract(path, '[^/]*$') AS name
  FROM (SELECT page_id, regexp_replace(url, '^https?://', '') AS path FROM pages)"""


def page_files(t: Tables) -> DataFrame:
    """Page URLs as files: page_id, path, dir, name."""
    path = F.regexp_replace("url", "^https?://", "")
    return t.pages.select("page_id", path.alias("path")).select(
        "page_id",
        "path",
        F.regexp_replace("path", "/[^/]*$", "").alias("dir"),
        F.regexp_extract("path", "[^/]*$", 0).alias("name"),
    )


@query(
    "d1_attach_attributes",
    f"""WITH {TARGET_SQL} SELECT item, target, p_type, p_size FROM target
    LEFT JOIN part ON item = p_partkey""",
)
def d1(t):
    attrs = t.part.select(F.col("p_partkey").alias("item"), "p_type", "p_size")
    return C.attach_attributes(targets(t), attrs, "item").select("item", "target", "p_type", "p_size")


_PRED = """pred AS (SELECT l_partkey AS item, l_returnflag AS color, sum(l_quantity) AS qty
  FROM lineitem GROUP BY l_partkey, l_returnflag)"""


def _color_sums(t):
    return t.lineitem.groupBy(F.col("l_partkey").alias("item"), F.col("l_returnflag").alias("color")).agg(
        F.sum("l_quantity").alias("qty")
    )


@query(
    "d2_attach_category",
    f"""WITH {_PRED} SELECT pred.*, p_type AS category FROM pred LEFT JOIN part ON item = p_partkey""",
)
def d2(t):
    true = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_partkey").alias("item"), F.col("l_returnflag").alias("color"), F.col("p_type").alias("category")
    )
    return C.attach_category(_color_sums(t), true, ["item", "color"])


@query(
    "d2_attach_category_fanout",
    f"""WITH {_PRED}, brand AS (SELECT p_size AS item, p_type AS category FROM part)
    SELECT pred.item, category, count(*) AS n, sum(qty) AS qty FROM pred LEFT JOIN brand USING (item)
    GROUP BY pred.item, category""",
)
def d2_fanout(t):
    side = t.part.select(F.col("p_size").cast("long").alias("item"), F.col("p_type").alias("category"))
    rows = C.attach_category(_color_sums(t), side, ["item"], fanout=True)
    return rows.groupBy("item", "category").agg(F.count("*").alias("n"), F.sum("qty").alias("qty"))


# Category names in a second spelling; the last category is left out on purpose.
SPELLING = {"ECONOMY": "eco", "LARGE": "lg", "MEDIUM": "md", "PROMO": "pr", "SMALL": "sm"}
_SPELLED = "CASE p_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SPELLING.items())


@query("d3_map_values", f"SELECT p_partkey, {_SPELLED} END AS kind FROM part")
def d3(t):
    return C.map_values(t.part, "p_type", SPELLING, name="kind").select("p_partkey", "kind")


@query("d3_map_values_default", f"SELECT p_partkey, {_SPELLED} ELSE p_type END AS kind FROM part")
def d3_default(t):
    return C.map_values(t.part, "p_type", SPELLING, name="kind", keep_unmapped=True).select("p_partkey", "kind")


@query(
    "d3_map_values_table",
    "SELECT s_suppkey, n_name AS nation FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey",
)
def d3_table(t):
    side = t.nation.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value"))
    return C.map_values(t.supplier, "s_nationkey", side, name="nation").select("s_suppkey", "nation")


@query(
    "d4_replace_values",
    "SELECT p_partkey, CASE p_brand WHEN 'Brand#1' THEN 'Brand#01' WHEN 'Brand#2' THEN 'Brand#02' ELSE p_brand END "
    "AS p_brand FROM part",
)
def d4(t):
    renamed = C.replace_values(t.part, "p_brand", {"Brand#1": "Brand#01", "Brand#2": "Brand#02"})
    return renamed.select("p_partkey", "p_brand")


@query("d5_replace_substring", "SELECT page_id, replace(url, 'example.com', 'images') AS url FROM pages")
def d5(t):
    return C.replace_substring(t.pages, "url", "example.com", "images").select("page_id", "url")


@query(
    "d6_pair_sorted",
    """WITH a AS (SELECT name, row_number() OVER (ORDER BY name) AS i FROM (
        SELECT string_split(p_name, ' ')[1] AS name FROM part EXCEPT SELECT lower(p_type) FROM part)),
    b AS (SELECT name, row_number() OVER (ORDER BY name) AS i FROM (
        SELECT p_brand AS name FROM part EXCEPT SELECT 'Brand#7'))
    SELECT a.name AS old, b.name AS "new" FROM a JOIN b USING (i)""",
)
def d6(t):
    words = t.part.select(F.split("p_name", " ")[0].alias("name"))
    folders = words.subtract(t.part.select(F.lower("p_type").alias("name")))
    items = t.part.select(F.col("p_brand").alias("name")).distinct().filter("name != 'Brand#7'")
    return C.pair_sorted(folders, items)


@query(
    "d7_invert_mapping",
    "SELECT p_name AS key, arg_max(p_partkey, p_partkey) AS value FROM part GROUP BY p_name",
)
def d7(t):
    mapping = t.part.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("value"))
    ordered = mapping.withColumn("at", F.col("key"))
    return C.invert_mapping(ordered, "at")


@query(
    "d8_build_path",
    f"SELECT p_partkey, 'images/' || p_name || '/' || ({_SPELLED} END) AS path FROM part",
)
def d8(t):
    mapped = C.map_values(t.part, "p_type", SPELLING, name="kind")
    return C.build_path(mapped, [F.lit("images"), F.col("p_name"), F.col("kind")]).select("p_partkey", "path")


@query("d9_trim_path_segments", "SELECT p_partkey, 'images/' || p_name || '/' || p_type AS path FROM part")
def d9(t):
    spaced = t.part.withColumn("path", F.concat(F.lit("images /  "), "p_name", F.lit("/ "), "p_type", F.lit("  ")))
    return C.trim_path_segments(spaced, "path").select("p_partkey", "path")


_CATALOG = f"""files AS ({PAGE_FILES_SQL}),
  wanted AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN dir || '/none' ELSE dir END AS folder FROM files),
  listing AS (SELECT dir, string_agg(path, ' ' ORDER BY path) AS files, count(*) AS n FROM files GROUP BY dir)"""


def _catalog(t):
    files = page_files(t)
    folder = F.when(F.col("page_id") % 3 == 0, F.concat("dir", F.lit("/none"))).otherwise(F.col("dir"))
    wanted = files.select("page_id", folder.alias("folder"))
    return C.attach_files(wanted, files.select("dir", "path"), "folder")


@query(
    "d10_attach_files",
    f"""WITH {_CATALOG} SELECT page_id, folder, coalesce(files, '') AS files, coalesce(n, 0) AS n
    FROM wanted LEFT JOIN listing ON folder = dir""",
)
def d10(t):
    return _catalog(t).select(
        "page_id", "folder", F.array_join("files", " ").alias("files"), F.size("files").cast("long").alias("n")
    )


@query(
    "d11_missing_files",
    f"""WITH {_CATALOG} SELECT page_id, position FROM (
      SELECT page_id, folder, row_number() OVER (ORDER BY page_id) - 1 AS position FROM wanted)
    LEFT JOIN listing ON folder = dir WHERE n IS NULL""",
)
def d11(t):
    return C.missing_files(_catalog(t), "page_id").select("page_id", "position")


@query(
    "d12_assign_color_folder",
    """WITH colors AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS color FROM part
      UNION SELECT DISTINCT left(p_name, 2) FROM part WHERE p_size > 25),
    hits AS (SELECT p_partkey, arg_max(color, length(color)) AS folder FROM part JOIN colors
      ON starts_with(p_name, color) GROUP BY p_partkey)
    SELECT p_partkey, p_name AS name, folder FROM part LEFT JOIN hits USING (p_partkey)""",
)
def d12(t):
    words = t.part.select(F.split("p_name", " ")[0].alias("color"))
    short = t.part.filter("p_size > 25").select(F.left("p_name", F.lit(2)).alias("color"))
    colors = words.union(short).distinct().withColumn("priority", -F.length("color"))
    files = t.part.select("p_partkey", F.col("p_name").alias("name"))
    return C.assign_color_folder(files, colors)


def _part_files(t):
    return t.part.select(
        "p_partkey", F.concat_ws("/", "p_brand", "p_size").alias("dir"), F.col("p_name").alias("name")
    )


@query(
    "d13_assign_black",
    "SELECT p_partkey, p_name AS name, CASE WHEN contains(upper(p_name), 'RED') THEN 'RED' END AS folder FROM part",
)
def d13(t):
    return C.assign_black(_part_files(t), "contains", word="RED").select("p_partkey", "name", "folder")


@query(
    "d13_assign_black_folder",
    """WITH f AS (SELECT p_partkey, p_brand || '/' || p_size AS dir, p_name AS name FROM part),
    h AS (SELECT dir, bool_or(starts_with(name, 'red')) AS has FROM f GROUP BY dir)
    SELECT p_partkey, name, CASE WHEN NOT has THEN 'red' END AS folder FROM f JOIN h USING (dir)""",
)
def d13_folder(t):
    return C.assign_black(_part_files(t), "folder", word="red").select("p_partkey", "name", "folder")


@query("d14_composite_key", "SELECT p_partkey, p_brand || '_' || p_name AS key FROM part")
def d14(t):
    return C.composite_key(t.part, ["p_brand", "p_name"]).select("p_partkey", "key")


@query(
    "d15_join_columns",
    """WITH a AS (SELECT l_partkey AS item, sum(l_quantity) AS qty FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1),
    b AS (SELECT p_partkey AS item, p_type FROM part WHERE p_size > 10)
    SELECT coalesce(a.item, b.item) AS item, qty, p_type FROM a FULL JOIN b ON a.item = b.item""",
)
def d15(t):
    returned = S.value_filter(t.lineitem, "l_returnflag", "=", "A")
    a = returned.groupBy(F.col("l_partkey").alias("item")).agg(F.sum("l_quantity").alias("qty"))
    b = t.part.filter("p_size > 10").select(F.col("p_partkey").alias("item"), "p_type")
    return C.join_columns(a, b, "item")
