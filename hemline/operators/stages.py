"""Target scalers as pipeline stages, so that scaling, model and unscaling are one saved object."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame

from hemline.operators import scaling

_SCALERS = {"anchor": scaling.AnchorScaler, "standard": scaling.StandardScaler}


class _Fitted(Params):
    """A scaler's kind and its numbers, which are saved with the stage."""

    kind = Param(Params._dummy(), "kind", "anchor or standard", TypeConverters.toString)
    numbers = Param(Params._dummy(), "numbers", "the fitted scaler as JSON", TypeConverters.toString)

    @property
    def scaler(self) -> scaling.AnchorScaler | scaling.StandardScaler:
        return _SCALERS[self.getOrDefault(self.kind)](**json.loads(self.getOrDefault(self.numbers)))


class TargetUnscaler(Transformer, HasInputCol, HasOutputCol, _Fitted, DefaultParamsReadable, DefaultParamsWritable):
    """Puts a scaled column back on the target's scale."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.scaler.unscale(df, self.getInputCol(), self.getOutputCol())


class TargetScalerModel(Model, HasInputCol, HasOutputCol, _Fitted, DefaultParamsReadable, DefaultParamsWritable):
    """Scales the target; a table to be scored has none and passes as it is."""

    def _transform(self, df: DataFrame) -> DataFrame:
        name = self.getInputCol()
        return self.scaler.scale(df, name, self.getOutputCol()) if name in df.columns else df

    def inverse(self, scaled: str = "prediction", name: str | None = None) -> TargetUnscaler:
        """The stage that undoes this scaling for ``scaled``, in place unless it gets a ``name``."""
        same = {"kind": self.getOrDefault(self.kind), "numbers": self.getOrDefault(self.numbers)}
        return TargetUnscaler()._set(**same, inputCol=scaled, outputCol=name or scaled)


class TargetScaler(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Fits the anchor scaler (``form`` power or boxcox) or the z-score to ``inputCol``; ``lam`` fixes the power."""

    kind = Param(Params._dummy(), "kind", "anchor or standard", TypeConverters.toString)
    form = Param(Params._dummy(), "form", "power or boxcox, of the anchor scaler", TypeConverters.toString)
    lam = Param(Params._dummy(), "lam", "the power; fitted if not set", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCol: str = "target", outputCol: str = "scaled", kind: str = "anchor", form: str = "power", lam: float | None = None):
        super().__init__()
        self._setDefault(inputCol="target", outputCol="scaled", kind="anchor", form="power")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> TargetScalerModel:
        lam = self.getOrDefault(self.lam) if self.isSet(self.lam) else None
        kind, y = self.getOrDefault(self.kind), self.getInputCol()
        if kind not in _SCALERS:
            raise ValueError(f"kind must be one of {sorted(_SCALERS)}")
        fitted = scaling.fit_anchor(df, y, form=self.getOrDefault(self.form), lam=lam) if kind == "anchor" else scaling.fit_standard(df, y, lam)
        return TargetScalerModel()._set(kind=kind, numbers=json.dumps(asdict(fitted)), inputCol=y, outputCol=self.getOutputCol())


def unscaled(model: PipelineModel, prediction: str = "prediction", name: str | None = None) -> PipelineModel:
    """A fitted pipeline that begins with a ``TargetScaler``, ended by the stage that undoes it."""
    scaler = next(s for s in model.stages if isinstance(s, TargetScalerModel))
    return PipelineModel([*model.stages, scaler.inverse(prediction, name)])
