"""Out-of-fold and held-out target rates as an estimator whose model is a saved contingency cube."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReader, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwright.operators.cube import contingency_cube, held_out_score, out_of_fold_rates, out_of_fold_score
from foldwright.session import materialize


class _HasFeatures(Params):
    features = Param(Params._dummy(), "features", "feature columns", typeConverter=TypeConverters.toListString)

    def getFeatures(self) -> list[str]:
        return self.getOrDefault(self.features)


class TargetRates(Estimator, _HasFeatures, DefaultParamsReadable, DefaultParamsWritable):
    """Counts rows and positives of every feature value and fold of a fold-tagged vector table (``fold``, ``n``, ``pos``)."""

    @keyword_only
    def __init__(self, *, features: Sequence[str] | None = None):
        super().__init__()
        if features is not None:
            self._set(features=list(features))

    def _fit(self, dataset: DataFrame) -> TargetRatesModel:
        cube = materialize(contingency_cube(dataset, self.getFeatures()), "rates")
        return TargetRatesModel(cube)._set(features=self.getFeatures())


class TargetRatesModel(Model, _HasFeatures):
    """Scores tables by the mean rate of their feature values; the cube is bounded by features x 256 x folds."""

    def __init__(self, cube: DataFrame | None = None):
        super().__init__()
        self.cube = cube

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Add ``score`` to later rows, by the rates of all folds; unseen values get the overall rate."""
        totals = self.cube.groupBy("feature", "value").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
        return held_out_score(dataset, totals, self.getFeatures())

    def rates(self) -> DataFrame:
        """The rate of every feature value over all folds but one."""
        return out_of_fold_rates(self.cube)

    def out_of_fold(self, dataset: DataFrame) -> DataFrame:
        """Add ``score`` to the fold-tagged table it was fitted on, or its rows, by the rates of the other folds."""
        return out_of_fold_score(dataset, self.rates(), self.getFeatures())

    def write(self) -> MLWriter:
        return _Writer(self)

    def save(self, path: str) -> None:
        self.write().save(path)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)

    @classmethod
    def load(cls, path: str) -> TargetRatesModel:
        return cls.read().load(path)


class _Writer(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        self.instance.cube.write.parquet(f"{path}/cube")


class _Reader(DefaultParamsReader):
    def load(self, path: str) -> TargetRatesModel:
        model = super().load(path)
        model.cube = self.sparkSession.read.parquet(f"{path}/cube")
        return model
