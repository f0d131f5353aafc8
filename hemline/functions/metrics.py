"""Error measures as column expressions; use them per row or inside an aggregate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def row_smape(pred: str | Column, true: str | Column, eps: float = 1e-6) -> Column:
    """|p - t| / (|p| + |t| + eps), in [0, 1)."""
    p, t = _col(pred), _col(true)
    return F.abs(p - t) / (F.abs(p) + F.abs(t) + F.lit(eps))


def adjusted_smape(pred: str | Column, true: str | Column, eps: float = 1e-6) -> Column:
    """Mean of the row measure."""
    return F.avg(row_smape(pred, true, eps))


def squared_error(pred: str | Column, true: str | Column) -> Column:
    """(p - t)^2."""
    d = _col(pred) - _col(true)
    return d * d


def mse(pred: str | Column, true: str | Column) -> Column:
    """Mean squared error."""
    return F.avg(squared_error(pred, true))


def rmse(pred: str | Column, true: str | Column) -> Column:
    """Root of the mean squared error."""
    return F.sqrt(mse(pred, true))


METRICS = {"smape": adjusted_smape, "mse": mse, "rmse": rmse}
