"""Feature extraction, sparse scaling and balanced linear classifiers as parts of Spark ML pipelines.

Feature and scaler stages work on array columns in Arrow batches; the classifiers are Spark's own linear models, fitted with the
penalties and weights of the analysed pipeline. All stages can be saved and loaded with the pipeline they belong to.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasInputCol, HasLabelCol, HasMaxIter, HasOutputCol
from pyspark.ml.regression import LinearRegression
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecohort.operators import metrics, models
from tidecohort.operators.features import Bank, feature_column

COUNTED = ("accuracy", "balanced_accuracy", "sensitivity", "specificity", "precision", "f1", "mcc")


def _param(name: str, text: str, convert) -> Param:
    return Param(Params._dummy(), name, text, typeConverter=convert)


class ConvolutionFeatures(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Competing-convolution features of windows (channels of samples) of a stated length and number of channels.

    The kernels follow from the parameters, so that a loaded stage has the same ones. A window of another shape is an error.
    """

    length = _param("length", "samples of a window", TypeConverters.toInt)
    channels = _param("channels", "channels of a window", TypeConverters.toInt)
    kernels = _param("kernels", "kernels of a group", TypeConverters.toInt)
    groups = _param("groups", "groups of kernels", TypeConverters.toInt)
    mostChannels = _param("mostChannels", "channels that a group adds up at most", TypeConverters.toInt)
    seed = _param("seed", "seed of the kernels", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol="x", outputCol="features", length=None, channels=None, kernels=8, groups=64, mostChannels=8, seed=42):
        super().__init__()
        self._setDefault(inputCol="x", outputCol="features", kernels=8, groups=64, mostChannels=8, seed=42)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def bank(self) -> Bank:
        g = self.getOrDefault
        return Bank(g("length"), g("channels"), g("kernels"), g("groups"), g("mostChannels"), g("seed"))

    def _transform(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(self.getOutputCol(), feature_column(self.bank(), (self.getOrDefault("channels"), self.getOrDefault("length")))(F.col(self.getInputCol())))


class _ScalerParams(HasInputCol, HasOutputCol):
    exponent = _param("exponent", "power of the share of zeros that is added to the deviation", TypeConverters.toFloat)
    mask = _param("mask", "whether zeros stay zero", TypeConverters.toBoolean)


class SparseScaler(Estimator, _ScalerParams, DefaultParamsReadable, DefaultParamsWritable):
    """Square roots of clipped features, centred and divided by a deviation that grows with the share of zeros."""

    @keyword_only
    def __init__(self, *, inputCol="features", outputCol="scaled", exponent=4.0, mask=True):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="scaled", exponent=4.0, mask=True)
        self._set(**self._input_kwargs)

    def _fit(self, rows: DataFrame) -> SparseScalerModel:
        arrays = models.scaler_arrays(rows.select(F.col(self.getInputCol()).alias("features")), self.getOrDefault("exponent")).first()
        return self._copyValues(SparseScalerModel(np.array(arrays["mean"], float), np.array(arrays["std"], float)))


class SparseScalerModel(Model, _ScalerParams, MLWritable, MLReadable):
    """The fitted scaler: ``mean`` and ``std`` by feature."""

    def __init__(self, mean: np.ndarray, std: np.ndarray):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="scaled", exponent=4.0, mask=True)
        self.mean, self.std = mean, std

    def _transform(self, rows: DataFrame) -> DataFrame:
        out = F.col(self.getOutputCol())
        arrays = rows.withColumn(self.getOutputCol(), scaled(F.col(self.getInputCol()), self.mean, self.std, self.getOrDefault("mask")))
        return arrays.withColumn(self.getOutputCol(), F.when(out.isNotNull(), array_to_vector(out)))

    def write(self) -> MLWriter:
        return _ScalerWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ScalerReader(cls)


class _ScalerWriter(MLWriter):
    def __init__(self, instance: SparseScalerModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:  # noqa: N802
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.sparkSession.createDataFrame([(self.instance.mean.tolist(), self.instance.std.tolist())], "mean array<double>, std array<double>").write.parquet(f"{path}/data")


class _ScalerReader(MLReader):
    def __init__(self, kind: type):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> SparseScalerModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        row = self.sparkSession.read.parquet(f"{path}/data").first()
        model = self.kind(np.array(row["mean"], float), np.array(row["std"], float))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


def scaled(features: Column, mean: np.ndarray, std: np.ndarray, mask: bool) -> Column:
    """Arrays of scaled features; null stays null, another width is an error."""

    @F.arrow_udf("array<double>")
    def scale(arrays: pa.Array) -> pa.Array:
        valid = arrays.drop_null()
        x = np.sqrt(np.maximum(np.asarray(valid.flatten()).astype(float), 0.0)).reshape(len(valid), -1)
        if len(valid) and x.shape[1] != len(mean):
            raise ValueError(f"{x.shape[1]} features for a scaler of {len(mean)}")
        out = (x - mean) / std
        if mask:
            out[x == 0] = 0.0
        width = len(mean) * np.asarray(arrays.is_valid()).astype(np.int32)
        offsets = np.concatenate([[0], np.cumsum(width)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel()), mask=arrays.is_null())

    return scale(features)


class _Classifier(Estimator, HasFeaturesCol, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    strength = _param("strength", "C of logistic regression, alpha of ridge", TypeConverters.toFloat)

    def _fit(self, rows: DataFrame):
        return self.fit_counted(rows, {int(r[0]): r[1] for r in rows.groupBy(self.getLabelCol()).count().collect()})

    def fit_counted(self, rows: DataFrame, sizes: dict[int, int]):
        """The model of rows whose number in each class is known already."""
        raise NotImplementedError


class BalancedLogistic(_Classifier, HasMaxIter):
    """Logistic regression with class weights n / (2 n_class) and penalty 1 / (strength * n); L1 or L2."""

    l1 = _param("l1", "whether the penalty is L1", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, featuresCol="scaled", labelCol="y", strength=1.0, l1=False, maxIter=100):
        super().__init__()
        self._setDefault(featuresCol="scaled", labelCol="y", strength=1.0, l1=False, maxIter=100)
        self._set(**self._input_kwargs)

    def fit_counted(self, rows: DataFrame, sizes: dict[int, int]):
        label, n = self.getLabelCol(), sum(sizes.values())
        weight = F.when(F.col(label) == 1, F.lit(n / (2 * sizes.get(1, n)))).otherwise(F.lit(n / (2 * sizes.get(0, n))))
        data = rows.select(F.col(self.getFeaturesCol()).alias("vector"), F.col(label).cast("double").alias("label"), weight.alias("weight"))
        fit = LogisticRegression(featuresCol="vector", weightCol="weight", regParam=1 / (self.getOrDefault("strength") * n), elasticNetParam=float(self.getOrDefault("l1")), standardization=False, maxIter=self.getMaxIter())
        return fit.fit(data).setFeaturesCol(self.getFeaturesCol())


class BalancedRidge(_Classifier):
    """Ridge regression on targets of -1 and 1; its prediction is the decision value."""

    @keyword_only
    def __init__(self, *, featuresCol="scaled", labelCol="y", strength=1.0):
        super().__init__()
        self._setDefault(featuresCol="scaled", labelCol="y", strength=1.0)
        self._set(**self._input_kwargs)

    def fit_counted(self, rows: DataFrame, sizes: dict[int, int]):
        data = rows.select(F.col(self.getFeaturesCol()).alias("vector"), (F.col(self.getLabelCol()).cast("double") * 2 - 1).alias("label"))
        fit = LinearRegression(featuresCol="vector", regParam=self.getOrDefault("strength") / sum(sizes.values()), elasticNetParam=0.0, standardization=False)
        return fit.fit(data).setFeaturesCol(self.getFeaturesCol())


def decision(rows: DataFrame) -> Column:
    """The decision value that a fitted classifier has added: above 0 is class 1."""
    return F.get(vector_to_array("rawPrediction"), F.lit(1)) if "rawPrediction" in rows.columns else F.col("prediction")


def decisions(models: list, rows: DataFrame) -> DataFrame:
    """(k, s, y) of the decision value of each row by each model, in one pass over the rows; ``k`` is the model's place."""
    for k, model in enumerate(models):
        own = model.copy()
        if isinstance(own, LogisticRegressionModel):
            rows = own.setRawPredictionCol(f"by_{k}").setProbabilityCol("").setPredictionCol("").transform(rows)
        else:
            rows = own.setPredictionCol(f"by_{k}").transform(rows)
    values = [F.get(vector_to_array(f"by_{k}"), F.lit(1)) if isinstance(m, LogisticRegressionModel) else F.col(f"by_{k}") for k, m in enumerate(models)]
    return rows.select(F.posexplode(F.array(*values)).alias("k", "s"), F.col("y"))


class BinaryScore(Evaluator, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    """One of the nine metrics of decision values; a metric without a value (one class only) counts as -1."""

    metricName = _param("metricName", "recall or a column of the metrics", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, metricName="balanced_accuracy", labelCol="y"):
        super().__init__()
        self._setDefault(metricName="balanced_accuracy", labelCol="y")
        self._set(**self._input_kwargs)

    def _evaluate(self, rows: DataFrame) -> float:
        return self.each(rows.select(F.lit(0).alias("k"), decision(rows).alias("s"), F.col(self.getLabelCol()).alias("y")), 1)[0]

    def each(self, rows: DataFrame, n: int) -> list[float]:
        """The metric of each of n sets of decision values, from rows (k, s, y) of all of them."""
        name = {"recall": "sensitivity"}.get(self.getOrDefault("metricName"), self.getOrDefault("metricName"))
        scores = rows.select("k", "s", F.col("y").cast("int").alias("y"))
        found = {r["k"]: r[name] for r in (metrics.counted if name in COUNTED else metrics.classification)(scores, ["k"]).collect()}
        return [-1.0 if found.get(k) is None else float(found[k]) for k in range(n)]

    def isLargerBetter(self) -> bool:  # noqa: N802
        return True


def dealt(rows: DataFrame, by: str, folds: int) -> tuple[DataFrame, int]:
    """``rows`` with ``fold``, cut by the hash of a column, and the number of folds that have rows (0 to that number - 1)."""
    raw = F.pmod(F.xxhash64(F.col(by).cast("string")), F.lit(folds))
    used = sorted(r[0] for r in rows.select(raw.alias("f")).distinct().collect())
    if len(used) < 2:
        raise ValueError(f"rows by {by} do not fill two folds")
    place = F.array_position(F.array(*[F.lit(f) for f in used]), raw) - 1
    return rows.withColumn("fold", place.cast("int")), len(used)


def load_pipeline(spark: SparkSession, path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.read().session(spark).load(path)
