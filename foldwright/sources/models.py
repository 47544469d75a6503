"""Saved forests: one pipeline that scores and decides, with its feature list, positive class and threshold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.constants import DECISION_THRESHOLD, NEGATIVE_CLASS, POSITIVE_CLASS
from foldwright.functions.columns import predicted


class Decision(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Turns what a forest adds to a table into ``score``, ``predicted_label`` and ``predicted_class``.

    Holds what a reader of the model must know: the features in order, the classes and the inclusive threshold.
    """

    features = Param(Params._dummy(), "features", "feature columns in order", typeConverter=TypeConverters.toListString)
    positiveClass = Param(Params._dummy(), "positiveClass", "name of class 1", typeConverter=TypeConverters.toString)
    negativeClass = Param(Params._dummy(), "negativeClass", "name of class 0", typeConverter=TypeConverters.toString)
    threshold = Param(Params._dummy(), "threshold", "least score of class 1", typeConverter=TypeConverters.toFloat)
    scoreCol = Param(Params._dummy(), "scoreCol", "column of the score or of class probabilities", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, *, features: Sequence[str] | None = None, positiveClass: str = POSITIVE_CLASS,
                 negativeClass: str = NEGATIVE_CLASS, threshold: float = DECISION_THRESHOLD, scoreCol: str = "prediction"):
        super().__init__()
        self._setDefault(positiveClass=POSITIVE_CLASS, negativeClass=NEGATIVE_CLASS, threshold=DECISION_THRESHOLD, scoreCol="prediction")
        self._set(**self._input_kwargs)

    def value(self, name: str):
        return self.getOrDefault(self.getParam(name))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        source = self.value("scoreCol")
        score = (F.col(source) if source == "prediction"
                 else F.coalesce(F.try_element_at(vector_to_array(source), F.lit(2)), F.lit(0.0)))
        label = predicted(F.col("score"), self.value("threshold"))
        named = F.when(label == 1, self.value("positiveClass")).otherwise(self.value("negativeClass"))
        added = dataset.withColumn("score", score).select("*", label.alias("predicted_label"), named.alias("predicted_class"))
        return added.drop("_x", "prediction", "rawPrediction", "probability")


def decision_of(model: PipelineModel) -> Decision:
    """The decision stage of a saved model."""
    return model.stages[-1]


def with_decision(model: PipelineModel, threshold: float = DECISION_THRESHOLD) -> PipelineModel:
    """A fitted forest with its decision as the last stage."""
    assembler, forest = model.stages[0], model.stages[1]
    source = "probability" if forest.hasParam("probabilityCol") else "prediction"
    return PipelineModel([assembler, forest, Decision(features=assembler.getInputCols(), threshold=threshold, scoreCol=source)])


def save_model(spark: SparkSession, model: PipelineModel, path: str, threshold: float = DECISION_THRESHOLD) -> None:
    """Save a fitted forest as one pipeline with its decision."""
    with_decision(model, threshold).write().session(spark).overwrite().save(path)


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, list[str], str]:
    """The pipeline, its features in order and its positive class. ``transform`` scores and decides."""
    model = PipelineModel.read().session(spark).load(path)
    decision = decision_of(model)
    return model, list(decision.value("features")), decision.value("positiveClass")
