"""Sales preparation: typing, seasons, cohorts, discount bands, targets."""

from __future__ import annotations

import operator
from collections.abc import Mapping, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Season = tuple[str, date, date]


def spring_summer(years: Sequence[int]) -> list[Season]:
    """Half-open seasons from 1 March to 1 September."""
    return [(str(y), date(y, 3, 1), date(y, 9, 1)) for y in years]


def cast_columns(df: DataFrame, types: Mapping[str, str], lenient: bool = False) -> DataFrame:
    """Cast columns; numbers truncate toward zero, malformed text raises.

    ``lenient`` turns malformed values into null instead.
    """
    casts = {
        name: F.col(f"`{name}`").try_cast(kind) if lenient else F.col(f"`{name}`").cast(kind)
        for name, kind in types.items()
    }
    return df.withColumns(casts)


def season_slice(df: DataFrame, date_col: str, seasons: Sequence[Season]) -> DataFrame:
    """Rows inside the half-open date ranges, with the season's name.

    The ranges are literals, so they reach the scan as pushed filters.
    """
    day = F.col(date_col)
    spans = [(name, (day >= F.lit(start)) & (day < F.lit(end))) for name, start, end in seasons]
    label = reduce(lambda acc, s: F.when(s[1], F.lit(s[0])).otherwise(acc), reversed(spans), F.lit(None))
    return df.filter(reduce(operator.or_, [inside for _, inside in spans])).withColumn(
        "season", label.cast("string")
    )


def season_join(df: DataFrame, date_col: str, seasons: DataFrame, bin_days: int | None = None) -> DataFrame:
    """Rows beside the ``season`` of every range that holds their day; overlapping ranges repeat a row.

    ``seasons`` has ``season``, ``start`` and ``end`` (half-open dates).  Days and ranges
    are cut into bins of ``bin_days`` (without it, the mean length of a range, so
    the cut ranges are at most two for each range and one more), and an equality
    join on the bin is checked by the dates.  A row has one bin and meets a range there once.
    Rows without a date or range, and ranges without an end or before their start, give nothing.
    """
    number = lambda day: F.unix_date(F.col(day).cast("date"))
    spans = seasons.select(F.col("season").alias("__season"), number("start").alias("__start"), number("end").alias("__end")).filter("__start < __end")
    if bin_days is None:
        bin_days = max(1, round(spans.agg(F.avg(F.col("__end") - F.col("__start"))).first()[0] or 1))
    cut = lambda day: F.floor(day / F.lit(bin_days))
    bins = F.explode(F.sequence(cut(F.col("__start")), cut(F.col("__end") - 1)))
    spans = spans.withColumn("__bin", bins)
    rows = df.withColumn("__day", number(date_col)).withColumn("__bin", cut(F.col("__day")))
    met = rows.join(spans, "__bin").filter("__day >= __start AND __day < __end")
    kept = [F.col(f"`{c}`") for c in df.columns if c != "season"]
    return met.select(*kept, F.col("__season").alias("season"))


def growing_patterns(seasons: Sequence[str], prefixes: Sequence[str]) -> dict[str, str]:
    """Per season the cohort prefixes that are already old: one more each season."""
    return {s: "|".join(prefixes[: i + 1]) for i, s in enumerate(seasons)}


def exclude_old_cohorts(
    df: DataFrame, item: str, rules: Mapping[str, str], season: str = "season"
) -> DataFrame:
    """Drop items whose code contains an earlier cohort's prefix, per season.

    A null code is dropped; a season without a rule keeps its rows.
    """
    code, name = F.col(item), F.col(season)
    keep = reduce(
        lambda acc, rule: F.when(name == rule[0], ~code.rlike(rule[1])).otherwise(acc),
        rules.items(),
        F.lit(True),
    )
    return df.filter(code.isNotNull() & keep)


def exclude_by_rules(
    df: DataFrame, item: str, rules: DataFrame, season: str = "season", gram: int = 12
) -> DataFrame:
    """``exclude_old_cohorts`` with the rules in a table (``season``, ``pattern``), of any number.

    A pattern is found as a whole, or where it is longer than ``gram`` characters by one of its
    runs of that many, the one that the fewest patterns share.  Each different code
    offers its runs once for all seasons, an equality join finds the patterns that may occur, and
    those are looked for in the code.  A null code is dropped, an empty
    pattern is in every code, and a season without a rule keeps its rows.
    """
    known = rules.select(F.col("season").alias("__season"), F.col("pattern").alias("__pattern"))
    known = known.filter("__season IS NOT NULL AND __pattern IS NOT NULL").distinct()
    patterns = known.select("__pattern").distinct()
    size = F.least(F.length("__pattern"), F.lit(gram))
    runs = patterns.select("*", F.explode(_runs(F.col("__pattern"), size)).alias("__gram")).distinct()
    shared = runs.groupBy("__gram").agg(F.count("*").alias("__n"))
    rarest = F.min_by("__gram", F.struct("__n", "__gram")).alias("__gram")
    keyed = runs.join(shared, "__gram").groupBy("__pattern").agg(rarest)
    # at most gram + 1 lengths
    lengths = [r[0] for r in patterns.select(size).distinct().collect()]
    codes = df.select(F.col(item).alias("__code")).filter("__code IS NOT NULL").distinct()
    offered = F.array_distinct(F.flatten(F.array(*[_runs(F.col("__code"), F.lit(n)) for n in sorted(lengths)]).cast("array<array<string>>")))
    met = codes.select("*", F.explode(offered).alias("__gram")).join(keyed, "__gram")
    held = met.filter(F.contains("__code", "__pattern")).select("__code", "__pattern")
    old = held.join(known, "__pattern").select("__season", "__code").distinct()
    same = (F.col(season) == F.col("__season")) & (F.col(item) == F.col("__code"))
    return df.filter(F.col(item).isNotNull()).join(old, same, "left_anti")


def _runs(text: Column, size: Column) -> Column:
    """All runs of ``size`` characters; none if the text is shorter."""
    last = F.length(text) - size + 1
    begins = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(begins, lambda i: F.substring(text, i, size))


def union_seasons(*frames: DataFrame) -> DataFrame:
    """Row concatenation that keeps duplicates."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def discount_band(
    df: DataFrame, col: str, lo: float = 0, hi: float = 50, closed: str = "left"
) -> DataFrame:
    """``lo <= d < hi``, or ``lo < d < hi`` with ``closed='neither'``."""
    if closed not in ("left", "neither"):
        raise ValueError("closed must be 'left' or 'neither'")
    d = F.col(f"`{col}`")
    return df.filter(((d >= lo) if closed == "left" else (d > lo)) & (d < hi))


_COMPARE = {
    "=": operator.eq,
    "!=": operator.ne,
    "<": operator.lt,
    "<=": operator.le,
    ">": operator.gt,
    ">=": operator.ge,
}


def value_filter(df: DataFrame, col: str, op: str, value) -> DataFrame:
    """Rows where ``col op value`` holds."""
    return df.filter(_COMPARE[op](F.col(f"`{col}`"), F.lit(value)))


def exclude_containing(df: DataFrame, col: str, pattern: str) -> DataFrame:
    """Drop rows whose text contains ``pattern`` literally."""
    return df.filter(~F.col(col).contains(pattern))


def exclude_items(df: DataFrame, item: str, deny: DataFrame) -> DataFrame:
    """Drop the items listed in ``deny`` (same column name)."""
    return df.join(deny.select(item).distinct(), item, "left_anti")


def substring_filter(df: DataFrame, col: str, text: str) -> DataFrame:
    """Keep rows whose text contains ``text`` literally."""
    return df.filter(F.col(col).contains(text))


def fill_where_null(df: DataFrame, col: str, value, scope: Column | None = None) -> DataFrame:
    """Fill nulls of ``col``, only where ``scope`` holds."""
    hit = F.col(col).isNull()
    hit = hit if scope is None else hit & scope
    return df.withColumn(col, F.when(hit, F.lit(value)).otherwise(F.col(col)))


def drop_duplicates(
    df: DataFrame, cols: Sequence[str] | None = None, keep_first_by: Sequence[str] | None = None
) -> DataFrame:
    """Distinct rows, or the first row by ``keep_first_by`` per ``cols``."""
    if cols is None:
        return df.distinct()
    if not keep_first_by:
        raise ValueError("keep_first_by must name the order that decides which row stays")
    row = F.struct(*df.columns)
    kept = df.groupBy(*cols).agg(F.min_by(row, F.struct(*keep_first_by)).alias("__row"))
    return kept.select("__row.*")


def project(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Select columns by name."""
    return df.select(*[f"`{n}`" for n in names])


def project_out(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop the listed columns that are present."""
    return df.drop(*names)


def align_columns(test: DataFrame, train: DataFrame) -> DataFrame:
    """``test`` with the columns of ``train`` in the same order."""
    missing = [c for c in train.columns if c not in test.columns]
    if missing:
        raise ValueError(f"columns missing from the test table: {missing}")
    return project(test, train.columns)


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename columns that are present."""
    return df.withColumnsRenamed(dict(names))


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of ``a`` that are not in ``b``, sorted."""
    return a.subtract(b).orderBy(*a.columns)


def sales_target(
    df: DataFrame, item: str, date_col: str, qty: str, days: int = 112, name: str = "target"
) -> DataFrame:
    """Quantity per item in the ``days`` calendar days from its first sale.

    Lines are summed per item and day before anything else is shuffled, so the
    window of even the busiest item holds at most one row per calendar day.
    """
    daily = df.groupBy(item, F.to_date(date_col).alias("__day")).agg(F.sum(qty).alias("__qty"))
    first = F.min("__day").over(Window.partitionBy(item))
    return (
        daily.withColumn("first_sale", first)
        .filter(F.col("__day") < F.date_add("first_sale", days))
        .groupBy(item, "first_sale")
        .agg(F.sum("__qty").alias(name))
    )
