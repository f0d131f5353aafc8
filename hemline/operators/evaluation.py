"""Predictions and their metrics by row, batch, item and category."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from hemline.functions.metrics import METRICS, adjusted_smape
from hemline.operators.ordering import OrderKey, global_index
from hemline.session import materialize


def nan_guard(df: DataFrame, cols: Sequence[str], by: str | None = None, nulls: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows without NaN in ``cols``, and a report of how many were skipped; with ``nulls``, nulls count as NaN."""
    missing = [F.isnan(c) | F.col(c).isNull() if nulls else F.coalesce(F.isnan(c), F.lit(False)) for c in cols]
    bad = reduce(lambda a, b: a | b, missing)
    report = (df.groupBy(by) if by else df.groupBy()).agg(
        F.count_if(bad).alias("skipped"), F.count("*").alias("rows")
    )
    return df.filter(~bad), report


def write_guarded(
    df: DataFrame, cols: Sequence[str], by: str | None = None, groups: Sequence[str] = (), nulls: bool = False
) -> tuple[DataFrame, DataFrame]:
    """``nan_guard`` that reads its rows once: the counts are observed while the kept rows are written.

    Returns the written rows and the report.  The observed numbers are fixed when the job
    starts, so a report ``by`` a column needs its values as ``groups``; a row of any other value
    raises, and values without rows are left out.
    """
    missing = [F.isnan(c) | F.col(c).isNull() if nulls else F.coalesce(F.isnan(c), F.lit(False)) for c in cols]
    bad = reduce(lambda a, b: a | b, missing)
    asked = [F.col(by).eqNullSafe(F.lit(g)) for g in groups] if by else [F.lit(True)]
    counts = [F.count_if(c).alias(f"{name}{i}") for i, g in enumerate(asked) for name, c in (("skipped", g & bad), ("rows", g))]
    observation = Observation()
    kept = materialize(df.observe(observation, F.count("*").alias("all"), *counts).filter(~bad))
    found = observation.get
    pairs = [(found[f"skipped{i}"], found[f"rows{i}"]) for i in range(len(asked))]
    spark = df.sparkSession
    if by is None:
        return kept, spark.createDataFrame(pairs, "skipped long, rows long")
    if sum(n for _, n in pairs) != found["all"]:
        raise ValueError(f"rows of {by} outside the given groups")
    rows = [(g, *p) for g, p in zip(groups, pairs) if p[1]]
    return kept, spark.createDataFrame(rows, f"`{by}` string, skipped long, rows long")


def blended_loss(
    df: DataFrame,
    scaled: tuple[str, str],
    unscaled: tuple[str, str],
    ratio: float = 1.0,
    metric: str = "smape",
) -> DataFrame:
    """ratio x metric on the scaled pair + (1 - ratio) x metric on the unscaled pair."""
    measure = METRICS[metric]
    both = df.agg(measure(*scaled).alias("scaled"), measure(*unscaled).alias("unscaled"))
    loss = F.lit(ratio) * F.col("scaled") + F.lit(1 - ratio) * F.col("unscaled")
    return both.withColumn("loss", loss)


def batched_mean(
    df: DataFrame,
    metric: Column,
    order: OrderKey | Sequence[OrderKey],
    size: int = 64,
    name: str = "value",
) -> DataFrame:
    """Mean of batch means; a short last batch weighs as much as a full one."""
    batch = F.floor(F.col("__i") / F.lit(size)).alias("__batch")
    batches = global_index(df, order, "__i").groupBy(batch).agg(metric.alias(name))
    return batches.agg(F.avg(name).alias(name))


def item_level(
    df: DataFrame, item: str, true: str = "true", pred: str = "pred", per_row: bool = False
) -> DataFrame:
    """True and predicted sums per item; ``per_row`` repeats them per input row."""
    sums = df.groupBy(item).agg(F.sum(true).alias(true), F.sum(pred).alias(pred))
    return df.select(item).join(sums, item) if per_row else sums


def metric_by_category(
    df: DataFrame, category: str, metrics: Sequence[str] = ("smape",), true: str = "true", pred: str = "pred"
) -> DataFrame:
    """Metrics per category from one aggregate; rows without category are skipped."""
    return (
        df.filter(F.col(category).isNotNull())
        .groupBy(category)
        .agg(*[METRICS[m](pred, true).alias(m) for m in metrics])
    )


def predictions(
    df: DataFrame, scaler, scaled: str = "prediction", true: str = "target", keep: Sequence[str] = ()
) -> DataFrame:
    """Unscaled prediction at 2 decimals (half to even) beside the truth."""
    restored = scaler.unscale(df, scaled, "__pred") if scaler else df.withColumn("__pred", F.col(scaled))
    return restored.select(*keep, F.col(true).alias("true"), F.bround("__pred", 2).alias("pred"))


def best_run(
    history: DataFrame, metric: str, direction: str, epoch: str = "epoch"
) -> DataFrame:
    """History row with the lowest or highest metric; of equals the first epoch."""
    usable = history.filter(F.col(metric).isNotNull() & ~F.isnan(metric))
    row = F.struct(*history.columns)
    if direction == "min":
        top = F.min_by(row, F.struct(metric, epoch))
    elif direction == "max":
        top = F.max_by(row, F.struct(F.col(metric), -F.col(epoch)))
    else:
        raise ValueError("direction must be 'min' or 'max'")
    return usable.agg(top.alias("best")).select("best.*")


def metric_report(
    overall: Mapping[str, DataFrame], grouped: Mapping[str, tuple[DataFrame, str]], metrics: Sequence[str]
) -> DataFrame:
    """Metric rows (scope, category, metric, value).

    ``overall`` maps a scope to its prediction table; ``grouped`` maps a scope
    to a prediction table and its category column.
    """
    frames = []
    for scope, df in overall.items():
        row = df.agg(*[METRICS[m]("pred", "true").alias(m) for m in metrics])
        frames.append(_long(row, scope, F.lit(None).cast("string"), metrics))
    for scope, (df, category) in grouped.items():
        frames.append(_long(metric_by_category(df, category, metrics), scope, F.col(category), metrics))
    return reduce(DataFrame.unionByName, frames)


def _long(df: DataFrame, scope: str, category: Column, metrics: Sequence[str]) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])
    return df.select(F.lit(scope).alias("scope"), category.alias("category"), F.explode(entries).alias("e")).select(
        "scope", "category", "e.metric", "e.value"
    )


def overall_smape(df: DataFrame, true: str = "true", pred: str = "pred") -> DataFrame:
    """Adjusted SMAPE over all rows."""
    return df.agg(adjusted_smape(pred, true).alias("smape"))
