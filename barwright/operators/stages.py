"""Stages of spark.ml pipelines that can be stored, read in another session, and used on rows that the fit hasn't seen."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasInputCols, HasLabelCol, HasOutputCol, HasWeightCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import LeafwiseBoosting
from .models import soft_rows
from .quantiles import quantiles


class MedianImputerModel(Model, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Missing, NaN and infinite values of the input columns become the stored medians."""

    medians = Param(Params._dummy(), "medians", "a value for each input column", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, medians: list[float] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        finite = lambda c: F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < F.lit(float("inf"))), F.col(c).cast("double"))
        filled = zip(self.getInputCols(), self.getOrDefault("medians"), strict=True)
        return df.withColumns({c: F.coalesce(finite(c), F.lit(m)) for c, m in filled})


class MedianImputer(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Fits the exact median of each input column (0 for one without values) by distributed selection."""

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> MedianImputerModel:
        found = quantiles(df, self.getInputCols(), [0.5])
        return MedianImputerModel(inputCols=self.getInputCols(), medians=[found[c][0] or 0.0 for c in self.getInputCols()])


class BalancedWeightsModel(Model, HasLabelCol, HasWeightCol, DefaultParamsReadable, DefaultParamsWritable):
    """Weights of the two classes, times a weight that is there. Rows without a label keep theirs."""

    weights = Param(Params._dummy(), "weights", "of label 0 and of label 1", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, labelCol: str = "y", weightCol: str = "weight", weights: list[float] | None = None):
        super().__init__()
        self._setDefault(labelCol="y", weightCol="weight")
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        w0, w1 = self.getOrDefault("weights")
        y = F.col(self.getLabelCol()) if self.getLabelCol() in df.columns else F.lit(None)
        own = F.when(y == 1, F.lit(w1)).when(y == 0, F.lit(w0)).otherwise(F.lit(1.0))
        return df.withColumn(self.getWeightCol(), own * F.col(self.getWeightCol()) if self.getWeightCol() in df.columns else own)


class BalancedWeights(Estimator, HasLabelCol, HasWeightCol, DefaultParamsReadable, DefaultParamsWritable):
    """Counts the two classes: their weights are n / (2 n_class); 1 for a class without rows."""

    @keyword_only
    def __init__(self, *, labelCol: str = "y", weightCol: str = "weight"):
        super().__init__()
        self._setDefault(labelCol="y", weightCol="weight")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> BalancedWeightsModel:
        y = F.col(self.getLabelCol())
        n = df.agg(F.count_if(y == 0).alias("n0"), F.count_if(y == 1).alias("n1")).first()
        weights = [(n.n0 + n.n1) / (2 * k) if k else 1.0 for k in (n.n0, n.n1)]
        return BalancedWeightsModel(labelCol=self.getLabelCol(), weightCol=self.getWeightCol(), weights=weights)


class ScoreColumn(Transformer, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """The probability of label 1 as a plain column in place of a classifier's own columns."""

    @keyword_only
    def __init__(self, *, outputCol: str = "score"):
        super().__init__()
        self._setDefault(outputCol="score")
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.getOutputCol(), vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


class PlattScalingModel(Model, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """1 / (1 + exp(-(slope * score + intercept)))."""

    slope = Param(Params._dummy(), "slope", "of the curve", TypeConverters.toFloat)
    intercept = Param(Params._dummy(), "intercept", "of the curve", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCol: str = "score", outputCol: str = "calibrated", slope: float = 1.0, intercept: float = 0.0):
        super().__init__()
        self._setDefault(inputCol="score", outputCol="calibrated", slope=1.0, intercept=0.0)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        z = F.col(self.getInputCol()) * self.getOrDefault("slope") + self.getOrDefault("intercept")
        return df.withColumn(self.getOutputCol(), 1 / (1 + F.exp(-z)))


class PlattScaling(Estimator, HasInputCol, HasOutputCol, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    """A logistic curve over a score, fitted on the rows for which `rows` (SQL) holds; the score itself, as log odds would
    give it, is left as it is (slope 1, intercept 0 on its log odds) if these rows have fewer than two labels."""

    rows = Param(Params._dummy(), "rows", "the rows to fit on", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCol: str = "score", outputCol: str = "calibrated", labelCol: str = "y", rows: str = "true"):
        super().__init__()
        self._setDefault(inputCol="score", outputCol="calibrated", labelCol="y", rows="true")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> PlattScalingModel:
        own = df.where(self.getOrDefault("rows")).where(F.col(self.getLabelCol()).isNotNull())
        out = {"inputCol": self.getInputCol(), "outputCol": self.getOutputCol()}
        if own.select(self.getLabelCol()).distinct().limit(2).count() < 2:
            return PlattScalingModel(**out, slope=4.0, intercept=-2.0)  # the tangent of log odds at 0.5
        vec = VectorAssembler(inputCols=[self.getInputCol()], outputCol="_f").transform(own)
        fit = LogisticRegression(featuresCol="_f", labelCol=self.getLabelCol(), maxIter=100).fit(vec)
        return PlattScalingModel(**out, slope=float(fit.coefficients[0]), intercept=float(fit.intercept))


class ArrayToVector(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """An array of numbers as a vector."""

    @keyword_only
    def __init__(self, *, inputCol: str = "embedding", outputCol: str = "features"):
        super().__init__()
        self._setDefault(inputCol="embedding", outputCol="features")
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.getOutputCol(), array_to_vector(F.col(self.getInputCol()).cast("array<double>")))


def train_head(rows: DataFrame, *, vector: str = "embedding", p: str = "p", weight: str | None = None, ridge: float = 0.01) -> PipelineModel:
    """A logistic head on embeddings (an array) with soft labels p in [0, 1]: each row counts as label 1 with p and as label
    0 with 1 - p. The pipeline gives a score and can be stored."""
    front = ArrayToVector(inputCol=vector)
    both = soft_rows(front.transform(rows), p, weight)
    return PipelineModel(stages=[front, LogisticRegression(labelCol="y", weightCol="weight", regParam=ridge, maxIter=50).fit(both), ScoreColumn()])


KINDS = ("logistic", "boosted", "leafwise")


def _balance(rows: DataFrame, label: str) -> float:
    """Rows of label 0 for each of label 1; 1 if a class has none."""
    n = rows.agg(F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1")).first()
    return n.n0 / n.n1 if n.n0 and n.n1 else 1.0


def train(rows: DataFrame, columns: list[str], *, kind: str = "logistic", label: str = "y", train_rows: str = "split = 'train'", validation: str = "split = 'val'", ridge: float = 0.01, trees: int = 20, depth: int = 4, seed: int = 7) -> PipelineModel:
    """A fitted pipeline: medians of the training rows, balanced weights (times a column `weight` if there is one), the
    classifier, the score of label 1, and a logistic curve over it fitted on the validation rows.

    `boosted` and `leafwise` grow up to `trees` trees and stop when the validation rows get no better (without such rows they
    don't stop). `leafwise` takes missing values as they are, and weighs label 1 by the ratio of the classes. write().save(path) stores it, PipelineModel.load(path) reads it in any session, transform() needs the columns only.
    """
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    own, held = rows.where(train_rows), rows.where(validation)
    if kind == "leafwise":
        both = own.withColumn("_val", F.lit(False)).unionByName(held.withColumn("_val", F.lit(True)))
        fit = LeafwiseBoosting(inputCols=columns, labelCol=label, weight="weight" if "weight" in rows.columns else "", held="_val", trees=trees, positive=_balance(own, label)).fit(both)
        return PipelineModel(stages=[fit, PlattScaling(labelCol=label).fit(fit.transform(held))])
    front = Pipeline(stages=[MedianImputer(inputCols=columns), BalancedWeights(labelCol=label), VectorAssembler(inputCols=columns, outputCol="features")]).fit(own)
    if kind == "logistic":
        classifier = LogisticRegression(labelCol=label, weightCol="weight", regParam=ridge, maxIter=50).fit(front.transform(own))
    else:
        both = front.transform(own.withColumn("_val", F.lit(False)).unionByName(held.withColumn("_val", F.lit(True))))
        options = {"validationIndicatorCol": "_val"} if held.limit(1).count() else {}
        classifier = GBTClassifier(labelCol=label, weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=0.1, seed=seed, **options).fit(both)
    scored = PipelineModel(stages=[*front.stages, classifier, ScoreColumn()])
    curve = PlattScaling(labelCol=label).fit(scored.transform(held))
    return PipelineModel(stages=[*scored.stages, curve])


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def scored(model: PipelineModel, rows: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of rows, with score and calibrated."""
    return model.transform(rows).select(*keep, "score", "calibrated")
