"""Fitted target scaling: Box-Cox with anchors or z-score, and residual scalers.

Fits reduce the training table to a few numbers; applying them is a projection.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Sequence
from dataclasses import asdict, dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemline.operators.ordering import running_total
from hemline.session import materialize

# |lambda| below this is the logarithm.
LOG_LAMBDA = 1e-6
# Up to so many distinct values are ranked in one place; beyond, in distributed order.
QUANTILE_LIMIT = 100_000
# Fits give up beyond this |lambda|.
LAMBDA_LIMIT = 10_000.0
# Rank error of the sketch that brackets a quantile: rows / accuracy.
SKETCH_ACCURACY = 10_000


def value_counts(df: DataFrame, y: str | Column) -> DataFrame:
    """Distinct values ``y`` with their counts ``n``: all a fit needs.  Null and NaN are left out."""
    col = F.col(y) if isinstance(y, str) else y
    return df.select(col.cast("double").alias("y")).filter("y is not null and not isnan(y)").groupBy("y").agg(
        F.count("*").alias("n")
    )


def positive_shift(train: DataFrame, y: str) -> float:
    """1.0 when any training value is not positive, else 0.0."""
    return _shift(value_counts(train, y).agg(F.min("y")).first()[0])


def _shift(low: float | None) -> float:
    return 1.0 if low is not None and low <= 0 else 0.0


def boxcox(y: Column, lam: float) -> Column:
    """(y^lam - 1) / lam, or ln y at 0."""
    if abs(lam) < LOG_LAMBDA:
        return F.log(y)
    return (F.pow(y, F.lit(lam)) - 1) / F.lit(lam)


def inv_boxcox(x: Column, lam: float) -> Column:
    """Inverse of ``boxcox``."""
    if abs(lam) < LOG_LAMBDA:
        return F.exp(x)
    return F.pow(x * F.lit(lam) + 1, F.lit(1 / lam))


@dataclass(frozen=True)
class _Logs:
    """Row count and log of the geometric mean."""

    total: int
    log_gm: float


def _logs(values: DataFrame) -> _Logs:
    total, logs, low = values.agg(F.sum("n"), F.sum(F.col("n") * F.log("y")), F.min("y")).first()
    if not total or low <= 0:
        raise ValueError("Box-Cox needs positive values; apply positive_shift first")
    return _Logs(total, logs / total)


def boxcox_llf(values: DataFrame, lambdas: Sequence[float], logs: _Logs | None = None) -> DataFrame:
    """Log-likelihood per candidate lambda over (y, n) rows.

    With z = y / geometric mean the likelihood is -n (ln gm + ln var(bc(z)) / 2),
    which avoids subtracting large sums.  Candidates are rows, so the work is
    one aggregate that is combined before the shuffle.
    """
    logs = logs or _logs(values)
    lam = F.col("lambda")
    ln_z = F.log("y") - F.lit(logs.log_gm)
    bc = F.when(F.abs(lam) < LOG_LAMBDA, ln_z).otherwise(F.expm1(lam * ln_z) / lam)
    grid = F.explode(F.array(*[F.lit(float(c)) for c in lambdas])).alias("lambda")
    sums = (
        values.select("y", "n", grid)
        .select("lambda", "n", bc.alias("t"))
        .groupBy("lambda")
        .agg(F.sum(F.col("n") * F.col("t")).alias("s1"), F.sum(F.col("n") * F.col("t") * F.col("t")).alias("s2"))
    )
    variance = F.col("s2") / logs.total - F.pow(F.col("s1") / logs.total, 2)
    return sums.select("lambda", (-(F.lit(logs.log_gm) + F.log(variance) / 2) * logs.total).alias("llf"))


def _fit_lambda(values: DataFrame, digits: int = 4) -> float:
    """Lambda of the highest likelihood over (y, n) rows.

    A grid over [-2, 2] moves outward, its step doubling, while the best sits on
    its edge; it is then refined tenfold per step around the best.  A likelihood
    that still rises at ``LAMBDA_LIMIT`` raises.
    """
    logs = _logs(values)

    def best(candidates: list[float]) -> float:
        scored = boxcox_llf(values, candidates, logs).filter("llf is not null")
        top = scored.agg(F.max_by("lambda", "llf")).first()[0]
        if top is None:
            raise ValueError("Box-Cox needs at least two different values")
        return top

    center, step = 0.0, 0.1
    while True:
        grid = [round(center + i * step, 1) for i in range(-20, 21)]
        top = best(grid)
        if grid[0] < top < grid[-1]:
            break
        if abs(top) > LAMBDA_LIMIT:
            raise ValueError(f"no maximum of the Box-Cox likelihood up to |lambda| = {LAMBDA_LIMIT:g}")
        center, step = top, step * 2
    while step > 10**-digits * 1.5:
        finer = max(step / 10, 10**-digits)
        reach = math.ceil(step / finer)
        top = best([round(top + i * finer, digits) for i in range(-reach, reach + 1)])
        step = finer
    return top


def _counted(df: DataFrame, y: str | Column) -> DataFrame:
    """The distinct values of ``y``, written once in as few files as they fill."""
    return materialize(value_counts(df, y))


def fit_boxcox(df: DataFrame, y: str | Column, digits: int = 4) -> float:
    """Lambda of the highest likelihood, to ``digits`` decimals."""
    return _fit_lambda(_counted(df, y), digits)


def quantiles(
    df: DataFrame, y: str | Column, probs: Sequence[float] = (0.16, 0.84), approx: bool = False
) -> list[float]:
    """Quantiles with linear interpolation, exact unless ``approx``.

    A sketch brackets every quantile, a second pass counts the rows below each
    bracket, and only the values inside the brackets are ranked.
    """
    col = F.col(y) if isinstance(y, str) else y
    rows = df.select(col.cast("double").alias("y")).filter("y is not null and not isnan(y)")
    if approx:
        return rows.agg(F.percentile_approx("y", list(probs))).first()[0]
    slack = 3 / SKETCH_ACCURACY
    edges = [max(0.0, p - slack) for p in probs] + [min(1.0, p + slack) for p in probs]
    total, bounds = rows.agg(F.count("*"), F.percentile_approx("y", edges, SKETCH_ACCURACY)).first()
    if not total:
        raise ValueError("no values to take quantiles of")
    spots = [(total - 1) * p for p in probs]
    lows, highs = bounds[: len(probs)], bounds[len(probs) :]
    counts = rows.agg(
        *[F.count_if(F.col("y") < lo) for lo in lows], *[F.count_if(F.col("y") <= hi) for hi in highs]
    ).first()
    brackets = []
    for spot, lo, hi, below, upto in zip(spots, lows, highs, counts[: len(probs)], counts[len(probs) :]):
        holds = below <= math.floor(spot) and math.ceil(spot) < upto
        brackets.append((lo, hi, below) if holds else (-math.inf, math.inf, 0))
    inside = reduce(operator.or_, [F.col("y").between(lo, hi) for lo, hi, _ in brackets])
    values = _counted(rows.filter(inside), "y")
    if values.count() <= QUANTILE_LIMIT:
        found = sorted(values.collect())
        held_y = np.array([r["y"] for r in found])
        held_n = np.array([r["n"] for r in found])

        def at(rank: int, lo: float, hi: float, below: int) -> float:
            mine = (held_y >= lo) & (held_y <= hi)
            return float(held_y[mine][np.searchsorted(below + np.cumsum(held_n[mine]), rank, side="right")])
    else:

        def at(rank: int, lo: float, hi: float, below: int) -> float:
            ranked = running_total(values.filter(F.col("y").between(lo, hi)), "n", "y", "upto")
            hit = (F.col("upto") + below > rank) & (F.col("upto") + below - F.col("n") <= rank)
            return ranked.filter(hit).first()["y"]

    out = []
    for spot, bracket in zip(spots, brackets):
        floor = at(math.floor(spot), *bracket)
        ceil = at(math.ceil(spot), *bracket) if spot % 1 else floor
        out.append(floor + (ceil - floor) * (spot % 1))
    return out


@dataclass(frozen=True)
class AnchorScaler:
    """Power scaling that puts the lower quantile at +1 and the upper at -1."""

    lam: float
    a: float
    b: float
    shift: float = 0.0
    # 'power' scales y^lam; 'boxcox' scales (y^lam - 1) / lam with the same a and b.
    form: str = "power"
    digits: int | None = None

    def scale(self, df: DataFrame, y: str, name: str = "scaled") -> DataFrame:
        v = F.col(y) + F.lit(self.shift)
        if self.form == "boxcox":
            body = boxcox(v, self.lam)
        else:
            body = F.log(v) if abs(self.lam) < LOG_LAMBDA else F.pow(v, F.lit(self.lam))
        scaled = body * F.lit(self.a) - F.lit(self.b)
        return df.withColumn(name, scaled if self.digits is None else F.bround(scaled, self.digits))

    def unscale(self, df: DataFrame, x: str = "scaled", name: str = "restored") -> DataFrame:
        body = (F.col(x) + F.lit(self.b)) / F.lit(self.a)
        if abs(self.lam) < LOG_LAMBDA:
            v = F.exp(body)
        elif self.form == "boxcox":
            v = F.pow(body * F.lit(self.lam) + 1, F.lit(1 / self.lam))
        else:
            v = F.pow(body, F.lit(1 / self.lam))
        return df.withColumn(name, v - F.lit(self.shift))

    def params(self) -> dict:
        return asdict(self)


def fit_anchor(
    train: DataFrame,
    y: str,
    probs: tuple[float, float] = (0.16, 0.84),
    form: str = "power",
    digits: int | None = None,
    lam: float | None = None,
) -> AnchorScaler:
    """Fit shift, lambda and the two anchors on the training target."""
    if form not in ("power", "boxcox"):
        raise ValueError("form must be 'power' or 'boxcox'")
    values = _counted(train, y)
    shift = _shift(values.agg(F.min("y")).first()[0])
    shifted = values.withColumn("y", F.col("y") + F.lit(shift))
    lam = _fit_lambda(shifted) if lam is None else lam
    lo, hi = quantiles(train, F.col(y) + F.lit(shift), probs)
    if lo == hi:
        raise ValueError("both quantiles are equal; the anchors are undefined")
    low, high = (math.log(lo), math.log(hi)) if abs(lam) < LOG_LAMBDA else (lo**lam, hi**lam)
    a = 2 / (low - high)
    return AnchorScaler(lam, a, a * low - 1, shift, form, digits)


def quantile_sketches(df: DataFrame, y: str, by: str, k: int = 200) -> DataFrame:
    """A sketch of a column's values per group, to be stored: group and ``sketch``.  Null and NaN are left out.

    Sketches are drawn with chance, so two runs differ; write them once and read them.
    The rank of a quantile from it, or from a merge of such sketches, is off by
    at most ``sketch_rank_error`` with 99 % certainty.
    """
    value = F.col(y).cast("double")
    return df.where(value.isNotNull() & ~F.isnan(value)).groupBy(by).agg(F.kll_sketch_agg_double(value, F.lit(k)).alias("sketch"))


def merge_quantile_sketches(sketches: DataFrame, by: str | None = None) -> DataFrame:
    """Sketches merged, in all or per group, without their rows."""
    return (sketches.groupBy(by) if by else sketches.groupBy()).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_rank_error(k: int = 200) -> float:
    """Largest error of a rank as a share of the rows, with 99 % certainty (one rank at a time)."""
    return 2.296 / k**0.9723


def sketched_quantiles(sketches: DataFrame, probs: Sequence[float], name: str = "quantiles") -> DataFrame:
    """The quantiles ``probs`` of every sketch as an array; each is a value that occurs."""
    found = F.array(*[F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))) for p in probs])
    return sketches.withColumn(name, found).drop("sketch")


def sketched_anchors(sketches: DataFrame, lam: float, probs: tuple[float, float] = (0.16, 0.84)) -> DataFrame:
    """The anchors ``a`` and ``b`` of each group's scaler, from its sketch of positive values; null where both quantiles are equal."""
    both = sketched_quantiles(sketches, probs, "__q")
    low, high = (F.log(q) if abs(lam) < LOG_LAMBDA else F.pow(q, F.lit(lam)) for q in (F.get("__q", F.lit(0)), F.get("__q", F.lit(1))))
    a = F.when(low != high, 2 / (low - high))
    return both.withColumns({"a": a, "b": a * low - 1}).drop("__q")


@dataclass(frozen=True)
class StandardScaler:
    """Box-Cox followed by a z-score with the population deviation."""

    lam: float
    mean: float
    std: float
    shift: float = 0.0

    def scale(self, df: DataFrame, y: str, name: str = "scaled") -> DataFrame:
        body = boxcox(F.col(y) + F.lit(self.shift), self.lam)
        return df.withColumn(name, (body - F.lit(self.mean)) / F.lit(self.std))

    def unscale(self, df: DataFrame, x: str = "scaled", name: str = "restored") -> DataFrame:
        body = F.col(x) * F.lit(self.std) + F.lit(self.mean)
        return df.withColumn(name, inv_boxcox(body, self.lam) - F.lit(self.shift))

    def params(self) -> dict:
        return asdict(self)


def fit_standard(train: DataFrame, y: str, lam: float | None = None) -> StandardScaler:
    """Fit shift, lambda, mean and deviation on the training target."""
    values = _counted(train, y)
    shift = _shift(values.agg(F.min("y")).first()[0])
    shifted = values.withColumn("y", F.col("y") + F.lit(shift))
    lam = _fit_lambda(shifted) if lam is None else lam
    n, body = F.col("n"), boxcox(F.col("y"), lam)
    total, mean = shifted.agg(F.sum(n), F.sum(n * body) / F.sum(n)).first()
    spread = F.sum(n * F.pow(body - F.lit(mean), 2)) / F.lit(total)
    std = math.sqrt(shifted.agg(spread).first()[0])
    return StandardScaler(lam, mean, std or 1.0, shift)


@dataclass(frozen=True)
class LinearScaler:
    """(x - offset) / width, for residuals."""

    offset: float
    width: float

    def scale(self, df: DataFrame, x: str, name: str = "scaled") -> DataFrame:
        return df.withColumn(name, (F.col(x) - F.lit(self.offset)) / F.lit(self.width))

    def unscale(self, df: DataFrame, x: str = "scaled", name: str = "restored") -> DataFrame:
        return df.withColumn(name, F.col(x) * F.lit(self.width) + F.lit(self.offset))

    def params(self) -> dict:
        return asdict(self)


def fit_linear_scaler(df: DataFrame, x: str, method: str = "minmax") -> LinearScaler:
    """``minmax`` maps to [0, 1]; ``standard`` is a z-score.  A constant column maps to 0."""
    if method == "minmax":
        lo, hi = df.agg(F.min(x), F.max(x)).first()
        return LinearScaler(float(lo), float(hi - lo) or 1.0)
    if method != "standard":
        raise ValueError("method must be 'minmax' or 'standard'")
    mean, std = df.agg(F.avg(x), F.stddev_pop(x)).first()
    return LinearScaler(mean, std or 1.0)
