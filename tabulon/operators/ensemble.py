"""Composite models that can be saved, and the train → evaluate → compare → choose path.

Voting and stacking are ``pyspark.ml`` models made of named members; the SVM is a stock pipeline of a scaler, random Fourier
features, a linear SVM and a sigmoid of its margin.  All of them write and read like any other model, members included, so
``save_model`` / ``load_model`` work for every model by path alone.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.ml import Model, PipelineModel, Transformer
from pyspark.ml.classification import LinearSVC, LinearSVCModel, LogisticRegression
from pyspark.ml.common import _py2java
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.operators import evaluate as V
from tabulon.operators import hinge as H
from tabulon.session import cut_lineage

#: Independent fits that run side by side: each is a chain of short jobs that leave most of a cluster idle.
SIDE_BY_SIDE = 6


def side_by_side(tasks: Sequence) -> list:
    """Results of functions without arguments, run in a few threads of the driver (their jobs share the cluster)."""
    with ThreadPool(max(1, min(SIDE_BY_SIDE, len(tasks)))) as pool:
        return pool.map(lambda f: f(), tasks)


# ---------------------------------------------------------------- #87
class RandomFourier(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """``sqrt(2 / D) cos(W x + b)`` of a vector column, a kernel map of the RBF kernel (Rahimi & Recht 2007).  ``W`` and ``b``
    follow from the seed, so the parameters are all there is to save."""

    inputCol = Param(Params._dummy(), "inputCol", "vector", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "mapped vector", TypeConverters.toString)
    width = Param(Params._dummy(), "width", "length of the input vector", TypeConverters.toInt)
    components = Param(Params._dummy(), "components", "length of the output vector", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "of the kernel exp(-gamma |x - y|^2)", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "of W and b", TypeConverters.toInt)

    @classmethod
    def of(cls, **params) -> RandomFourier:
        return cls()._set(**params)

    def matrices(self) -> tuple[np.ndarray, np.ndarray]:
        d, n, g = (self.getOrDefault(p) for p in ("width", "components", "gamma"))
        rng = np.random.default_rng(self.getOrDefault("seed"))
        return rng.normal(0.0, math.sqrt(2.0 * g), size=(n, d)), rng.uniform(0.0, 2.0 * math.pi, size=n)

    def _transform(self, df: DataFrame) -> DataFrame:
        w, b = self.matrices()
        scale = math.sqrt(2.0 / len(b))

        @F.pandas_udf("array<double>")
        def project(x: pd.Series) -> pd.Series:
            rows = np.stack(x.to_numpy()) if len(x) else np.zeros((0, w.shape[1]))
            return pd.Series(list(scale * np.cos(rows @ w.T + b)))

        return df.withColumn(self.getOrDefault("outputCol"), array_to_vector(project(vector_to_array(F.col(self.getOrDefault("inputCol"))))))


class MarginSigmoid(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """``probability`` as a sigmoid of a linear SVM's margin; the prediction stays the margin's sign."""

    slope = Param(Params._dummy(), "slope", "of the margin", TypeConverters.toFloat)
    intercept = Param(Params._dummy(), "intercept", "added to it", TypeConverters.toFloat)

    @classmethod
    def of(cls, slope: float, intercept: float) -> MarginSigmoid:
        return cls()._set(slope=slope, intercept=intercept)

    def _transform(self, df: DataFrame) -> DataFrame:
        margin = vector_to_array(F.col("rawPrediction"))[1]
        p = 1.0 / (1.0 + F.exp(-(F.lit(self.getOrDefault("slope")) * margin + F.lit(self.getOrDefault("intercept")))))
        return df.withColumn("_p", p).withColumn("probability", array_to_vector(F.array(1.0 - F.col("_p"), F.col("_p")))).drop("_p", "_scaled", "_rff")


class SharedSVC(LinearSVC):
    """A ``LinearSVC`` on the mapped numbers of ``hinge.packed`` rows without the fold ``without[at]`` (-1: of all).  Passes are
    shared: the first fit finds the models of all folds and leaves them in ``found``."""

    def __init__(self, found: list, kernel: tuple, without: Sequence[int], at: int, **params):
        super().__init__(**params)
        self.found, self.kernel, self.without, self.at = found, kernel, list(without), at

    def _fit(self, rows: DataFrame) -> LinearSVCModel:
        if not self.found:
            self.found += H.fit_folds(rows, *self.kernel, self.without, self.getRegParam(), self.getMaxIter(), self.getTol())
        coef, intercept = self.found[self.at]
        sc = rows.sparkSession.sparkContext
        model = sc._jvm.org.apache.spark.ml.classification.LinearSVCModel(self.uid, _py2java(sc, Vectors.dense(coef)), intercept)
        return self._copyValues(LinearSVCModel(model))


def fit_rbf_svm(train: DataFrame, n_features: int, components: int = 200, gamma: float | None = None, c: float = 1.0, seed: int = 42,
                max_iter: int = 100, folds: int = 3) -> PipelineModel:
    """RBF SVM (re-aimed: random Fourier features and a linear SVM on standardised inputs; ``gamma='scale'`` is then
    1 / n_features).  The margin's sigmoid is fitted on out-of-fold margins, rows dealt to folds by a hash of their features."""
    scaler = StandardScaler(inputCol="features", outputCol="_scaled", withMean=True, withStd=True).fit(train)
    rff = RandomFourier.of(inputCol="_scaled", outputCol="_rff", width=n_features, components=components,
                           gamma=gamma if gamma is not None else 1.0 / max(n_features, 1), seed=seed)
    fold = F.pmod(F.xxhash64(vector_to_array("features"), F.lit(seed)), F.lit(folds))
    rows, kernel, found = H.packed(scaler.transform(train), "_scaled", fold), rff.matrices(), []
    *parts, final = [SharedSVC(found, kernel, [*range(folds), -1], i, featuresCol="_rff", labelCol="label", regParam=1.0 / max(c, 1e-12) / 1000.0, maxIter=max_iter).fit(rows)
                     for i in range(folds + 1)]
    margins = H.margins(rows, *kernel, {k: (m.coefficients.toArray(), m.intercept) for k, m in enumerate(parts)})
    fitted = LogisticRegression(featuresCol="m", labelCol="label").fit(cut_lineage(VectorAssembler(inputCols=["margin"], outputCol="m").transform(margins)))
    return PipelineModel([scaler, rff, final, MarginSigmoid.of(float(fitted.coefficients[0]), float(fitted.intercept))])


# ---------------------------------------------------------------- #90, #91, #4
class _CompositeWriter(MLWriter):
    def __init__(self, instance: CompositeModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata={"members": list(self.instance.members)})
        for i, m in enumerate(self.instance.members.values()):
            m.write().save(f"{path}/members/{i}")


class _CompositeReader(MLReader):
    def __init__(self, cls: type):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> CompositeModel:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        members = {n: DefaultParamsReader.loadParamsInstance(f"{path}/members/{i}", self.sparkSession) for i, n in enumerate(meta["members"])}
        model = self.cls(members)
        model._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(model, meta)
        return model


class CompositeModel(Model, MLReadable, MLWritable):
    """A model of named members."""

    def __init__(self, members: dict | None = None):
        super().__init__()
        self.members = members or {}

    def write(self) -> MLWriter:
        return _CompositeWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _CompositeReader(cls)


def member_probabilities(models: dict, df: DataFrame) -> DataFrame:
    """``df`` with one column ``p_<name>`` a member: scoring is row-local, so the members chain and nothing is joined."""
    for name, m in models.items():
        keep = [F.col(f"`{c}`") for c in df.columns]
        df = m.transform(df).select(*keep, vector_to_array(F.col("probability"))[1].alias(f"p_{name}"))
    return df


def _with_probability(df: DataFrame, p, drop: Sequence[str]) -> DataFrame:
    out = df.withColumn("_p", p)
    return out.withColumns({"probability": array_to_vector(F.array(1.0 - F.col("_p"), F.col("_p"))),
                            "prediction": (F.col("_p") > 0.5).cast("double")}).drop("_p", *drop)


class VotingModel(CompositeModel):
    """Mean of the members' positive probabilities."""

    def _transform(self, df: DataFrame) -> DataFrame:
        cols = [f"p_{n}" for n in self.members]
        return _with_probability(member_probabilities(self.members, df), sum((F.col(c) for c in cols[1:]), F.col(cols[0])) / len(cols), cols)


class StackedModel(CompositeModel):
    """A logistic regression, member ``meta``, on the other members' positive probabilities."""

    def _transform(self, df: DataFrame) -> DataFrame:
        bases = {n: m for n, m in self.members.items() if n != "meta"}
        cols = [f"p_{n}" for n in bases]
        meta = self.members["meta"]
        margin = sum((F.col(c) * float(w) for c, w in zip(cols, meta.coefficients, strict=True)), F.lit(float(meta.intercept)))
        return _with_probability(member_probabilities(bases, df), 1.0 / (1.0 + F.exp(-margin)), cols)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(spark: SparkSession, path: str):
    """Any model of this library or of ``pyspark.ml``, by what its metadata says it is."""
    return DefaultParamsReader.loadParamsInstance(path, spark)


def predict_by_name(spark: SparkSession, folder: str, name: str, df: DataFrame) -> DataFrame:
    """Predictions and positive scores of the model saved as ``folder/name``."""
    out = load_model(spark, f"{folder.rstrip('/')}/{name}").transform(df)
    return out.withColumn("score", vector_to_array(F.col("probability"))[1])


# ---------------------------------------------------------------- #99–#102
def evaluate_models(models: dict, test: DataFrame) -> DataFrame:
    """``model, model_order, accuracy, precision, recall, f1_score, roc_auc`` of every model on the test rows, in the order given."""
    def one(order: int, name: str) -> DataFrame:
        scored = models[name].transform(test).select("label", "prediction", vector_to_array(F.col("probability"))[1].alias("score"))
        metrics = V.classification_metrics(cut_lineage(scored), score="score")
        return cut_lineage(metrics.select(F.lit(name).alias("model"), F.lit(order).alias("model_order"), "*"))

    parts = side_by_side([lambda i=i, n=n: one(i, n) for i, n in enumerate(models)])
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def choose(metrics: DataFrame) -> DataFrame:
    """``section, name, model, value``: every metric of every model, then per metric the best, mean and spread over the models,
    the recommendations, and the best models by accuracy and F1."""
    long = V.metrics_long(metrics)
    row = lambda section, name, model, value: (F.lit(section).alias("section"), name.alias("name"), model.alias("model"), value.cast("double").alias("value"))
    none = F.lit(None).cast("string")
    comparison = V.model_comparison(long)
    parts = [long.select(*row("metric", F.col("metric"), F.col("model"), F.col("score"))),
             comparison.select(*row("comparison_best", F.col("metric"), F.col("best_model"), F.col("best_score"))),
             comparison.select(*row("comparison_mean", F.col("metric"), none, F.col("mean_score"))),
             comparison.select(*row("comparison_std", F.col("metric"), none, F.col("std_score"))),
             V.recommendations(metrics).select(*row("recommendation", F.col("criterion"), F.col("model"), F.col("score")))]
    for m in ("accuracy", "f1_score"):
        parts.append(V.best_model(metrics, m).select(*row("best", F.lit(m), F.col("model"), F.col(m))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
