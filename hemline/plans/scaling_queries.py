"""Target scaling on the 16-week target per part."""

from __future__ import annotations

from pyspark.sql import functions as F

from hemline.operators import scaling as Z
from hemline.plans.registry import query, rounded
from hemline.plans.sales_queries import SEASON_SQL, TARGET_SQL, seasonal_lines
from hemline.plans.sales_queries import targets as lazy_targets
from hemline.session import materialize



def fit_input(t):
    """The target table written once: a fit passes over it several times."""
    return materialize(lazy_targets(t))


_LLF = """SELECT lam, (lam - 1) * sum(ln(target)) - count(*) / 2.0 * ln(var_pop(
  CASE WHEN abs(lam) < 1e-6 THEN ln(target) ELSE (pow(target, lam) - 1) / lam END)) AS llf
  FROM target, {grid} GROUP BY lam"""

LAMBDA_SQL = (
    "g1 AS (SELECT round(i / 10.0, 1)::DOUBLE AS lam FROM range(-20, 21) r(i)), "
    f"l1 AS ({_LLF.format(grid='g1')}), b1 AS (SELECT arg_max(lam, llf) AS lam FROM l1), "
    + ", ".join(
        f"g{d} AS (SELECT round(lam + i / {10**d}.0, {d})::DOUBLE AS lam FROM b{d - 1}, range(-10, 11) r(i)), "
        f"l{d} AS ({_LLF.format(grid=f'g{d}')}), b{d} AS (SELECT arg_max(lam, llf) AS lam FROM l{d})"
        for d in (2, 3, 4)
    )
)

ANCHOR_SQL = f"""{TARGET_SQL}, {LAMBDA_SQL},
q AS (SELECT quantile_cont(target, 0.16) AS lo, quantile_cont(target, 0.84) AS hi FROM target),
anchor AS (SELECT lam, 2 / (pow(lo, lam) - pow(hi, lam)) AS a,
  2 / (pow(lo, lam) - pow(hi, lam)) * pow(lo, lam) - 1 AS b FROM q, b4)"""


@query("f1_boxcox_llf", f"WITH {TARGET_SQL}, {LAMBDA_SQL} SELECT lam AS lambda, round(llf, 4) AS llf FROM l1")
def f1_llf(t):
    grid = [i / 10 for i in range(-20, 21)]
    llf = Z.boxcox_llf(Z.value_counts(fit_input(t), "target"), grid)
    return llf.select("lambda", rounded("llf", 4).alias("llf"))


@query("f1_fit_boxcox", f"WITH {TARGET_SQL}, {LAMBDA_SQL} SELECT count(*) AS items, max(b4.lam) AS lambda FROM target, b4")
def f1(t):
    items = fit_input(t)
    lam = Z.fit_boxcox(items, "target")
    return items.agg(F.count("*").alias("items"), F.lit(lam).alias("lambda"))


@query(
    "f2_boxcox",
    f"""WITH {TARGET_SQL} SELECT item, round((pow(target, 0.3) - 1) / 0.3, 6) AS bc, round(ln(target), 6) AS logged,
    round(target, 6) AS restored FROM target""",
)
def f2(t):
    y = F.col("target")
    bc = lazy_targets(t).withColumn("bc", Z.boxcox(y, 0.3)).withColumn("logged", Z.boxcox(y, 0.0))
    return bc.select(
        "item", rounded("bc").alias("bc"), rounded("logged").alias("logged"),
        rounded(Z.inv_boxcox(F.col("bc"), 0.3)).alias("restored"),
    )


@query(
    "f3_positive_shift",
    f"""WITH {TARGET_SQL} SELECT item, target - lo + s AS y FROM target,
    (SELECT min(target) AS lo, 1.0 AS s FROM target)""",
)
def f3(t):
    items = fit_input(t)
    low = items.agg(F.min("target")).first()[0]
    lowered = items.withColumn("y", F.col("target") - F.lit(low))
    return lowered.select("item", (F.col("y") + F.lit(Z.positive_shift(lowered, "y"))).alias("y"))


@query(
    "f4_quantiles",
    f"""WITH {TARGET_SQL} SELECT round(quantile_cont(target, 0.16), 6) AS q16, round(quantile_cont(target, 0.84), 6) AS q84,
    count(*) AS items FROM target""",
)
def f4(t):
    items = fit_input(t)
    low, high = Z.quantiles(items, "target")
    return items.agg(
        rounded(F.lit(low)).alias("q16"), rounded(F.lit(high)).alias("q84"), F.count("*").alias("items")
    )


@query(
    "f4_quantiles_of_lines",
    """SELECT count(*) AS n, round(quantile_cont(l_extendedprice, 0.16), 6) AS q16,
    round(quantile_cont(l_extendedprice, 0.84), 6) AS q84 FROM lineitem""",
)
def f4_lines(t):
    low, high = Z.quantiles(t.lineitem, "l_extendedprice")
    return t.lineitem.agg(
        F.count("*").alias("n"), rounded(F.lit(low)).alias("q16"), rounded(F.lit(high)).alias("q84")
    )


@query(
    "f5_fit_anchor",
    f"WITH {ANCHOR_SQL} SELECT item, round(a * pow(target, lam) - b, 6) + 0.0 AS scaled FROM target, anchor",
)
def f5(t):
    items = fit_input(t)
    scaler = Z.fit_anchor(items, "target")
    return scaler.scale(items, "target").select("item", rounded("scaled").alias("scaled"))


@query(
    "f6_unscale",
    f"""WITH {ANCHOR_SQL} SELECT item, CAST(first_sale AS VARCHAR) AS first_sale, target,
    round(a * pow(target, lam) - b, 6) + 0.0 AS scaled, round(target, 6) AS restored FROM target, anchor""",
)
def f6(t):
    items = fit_input(t)
    scaler = Z.fit_anchor(items, "target")
    scaled = scaler.unscale(scaler.scale(items, "target"))
    return scaled.select(
        "item", F.col("first_sale").cast("string").alias("first_sale"), "target",
        rounded("scaled").alias("scaled"), rounded("restored").alias("restored"),
    )


@query(
    "f7_boxcox_form",
    f"""WITH {ANCHOR_SQL} SELECT item, round(a * (pow(target, lam) - 1) / lam - b, 6) + 0.0 AS scaled,
    round(target, 6) AS restored FROM target, anchor""",
)
def f7(t):
    items = fit_input(t)
    scaler = Z.fit_anchor(items, "target", form="boxcox")
    scaled = scaler.unscale(scaler.scale(items, "target"))
    return scaled.select("item", rounded("scaled").alias("scaled"), rounded("restored").alias("restored"))


@query(
    "f8_fit_standard",
    f"""WITH {TARGET_SQL}, {LAMBDA_SQL}, bc AS (SELECT item, target, (pow(target, lam) - 1) / lam AS v FROM target, b4)
    SELECT item, round((v - avg(v) OVER ()) / stddev_pop(v) OVER (), 6) + 0.0 AS scaled,
    round(target, 6) AS restored FROM bc""",
)
def f8(t):
    items = fit_input(t)
    scaler = Z.fit_standard(items, "target")
    scaled = scaler.unscale(scaler.scale(items, "target"))
    return scaled.select("item", rounded("scaled").alias("scaled"), rounded("restored").alias("restored"))


@query(
    "f9_fit_minmax",
    f"""WITH {TARGET_SQL} SELECT item, round((target - min(target) OVER ()) / (max(target) OVER () - min(target) OVER ()), 6)
    AS scaled, round(target, 6) AS restored FROM target""",
)
def f9(t):
    items = fit_input(t)
    scaler = Z.fit_linear_scaler(items, "target", "minmax")
    scaled = scaler.unscale(scaler.scale(items, "target"))
    return scaled.select("item", rounded("scaled").alias("scaled"), rounded("restored").alias("restored"))


@query(
    "f5_fit_anchor_rounded",
    f"WITH {ANCHOR_SQL} SELECT item, round_even(a * pow(target, lam) - b, 4) + 0.0 AS scaled FROM target, anchor",
)
def f5_rounded(t):
    items = fit_input(t)
    scaler = Z.fit_anchor(items, "target", digits=4)
    return scaler.scale(items, "target").select("item", (F.col("scaled") + F.lit(0.0)).alias("scaled"))


@query(
    "f9_fit_zscore",
    f"""WITH {TARGET_SQL} SELECT item, round((target - avg(target) OVER ()) / stddev_pop(target) OVER (), 6) + 0.0
    AS scaled FROM target""",
)
def f9_zscore(t):
    items = fit_input(t)
    scaler = Z.fit_linear_scaler(items, "target", "standard")
    return scaler.scale(items, "target").select("item", rounded("scaled").alias("scaled"))


_RANKED = (0.16, 0.5, 0.84)


@query(
    "f4_merged_sketches",
    f"""WITH s AS ({SEASON_SQL}), q AS (SELECT unnest([0.16, 0.5, 0.84]::DOUBLE[]) AS p)
    SELECT coalesce(season, 'all') AS season, p, n, true AS within FROM (
      SELECT season, count(*) AS n FROM s GROUP BY GROUPING SETS ((season), ())) CROSS JOIN q""",
)
def f4_sketches(t):
    """Stored sketches per season and their merge, held against the ranks of all values."""
    lines = materialize(seasonal_lines(t).select("season", F.col("l_extendedprice").alias("y")))
    stored = materialize(Z.quantile_sketches(lines, "y", "season"))
    total = Z.merge_quantile_sketches(stored).select(F.lit("all").alias("season"), "sketch")
    found = Z.sketched_quantiles(stored.unionByName(total), _RANKED).select("season", F.posexplode("quantiles").alias("i", "value"))
    found = found.select("season", F.element_at(F.array(*[F.lit(p) for p in _RANKED]), F.col("i") + 1).alias("p"), "value")
    rows = lines.unionByName(lines.withColumn("season", F.lit("all")))
    ranked = rows.join(F.broadcast(found), "season").groupBy("season", "p").agg(
        F.count("*").alias("n"), F.count_if(F.col("y") < F.col("value")).alias("below"), F.count_if(F.col("y") <= F.col("value")).alias("upto")
    )
    # the stated error holds for one rank with 99 % certainty, twice of it for all of these
    slack = F.col("n") * F.lit(2 * Z.sketch_rank_error())
    within = (F.col("below") <= F.col("p") * F.col("n") + slack) & (F.col("upto") >= F.col("p") * F.col("n") - slack)
    return ranked.select("season", "p", "n", within.alias("within"))
