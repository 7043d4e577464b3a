"""Classifiers on ``pyspark.ml``: builders, an RBF-kernel SVM, soft voting.

Every model reads a vector column ``features`` and is summarised by one
double column ``score`` (probability of the positive class) plus ``pred``
(``score >= 0.5``, inclusive, unlike Spark's own ``prediction``).

* Linear models follow the usual in-memory loss: C * sum(loss) + |w|^2 / 2,
  i.e. Spark's regParam = 1 / (C * n) with ``standardization=False``.
* The RBF SVM has no Spark counterpart; it is re-expressed as random Fourier
  features (Rahimi & Recht, 2007) computed as column expressions, a
  ``LinearSVC`` and Platt scaling (a one-feature logistic regression on the
  margin).
* Soft voting fits its members and averages their probabilities.
"""

from __future__ import annotations

import importlib
import json
import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasInputCols, HasOutputCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.derive import predicted_label
from .prep import PopStandardScaler

SCORE = "score"
PRED = "pred"


def feature_stages(features: Sequence[str], scaled: bool = True, out: str = "features") -> list:
    """Scaler (population std, fitted on the training rows) + assembler."""
    if not scaled:
        return [VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="error")]
    zcols = [f"_z_{f}" for f in features]
    return [
        PopStandardScaler(inputCols=list(features), outputCols=zcols),
        VectorAssembler(inputCols=zcols, outputCol=out, handleInvalid="error"),
    ]


def positive_probability(df: DataFrame, probability_col: str = "probability") -> DataFrame:
    """Adds ``score`` = P(class 1) and the inclusive label ``pred``."""
    out = df.withColumn(SCORE, vector_to_array(F.col(probability_col))[1])
    return out.withColumn(PRED, predicted_label(F.col(SCORE)))


# ------------------------------------------------------------------ builders
def logistic(n_train: int, C: float = 1.0, max_iter: int = 1000, **kw) -> LogisticRegression:
    return LogisticRegression(
        maxIter=max_iter, regParam=1.0 / (C * max(1, n_train)), elasticNetParam=0.0, standardization=False, **kw
    )


def _memory_mb(text: str | None, default: int = 1024) -> int:
    if not text:
        return default
    units = {"k": 1 / 1024, "m": 1, "g": 1024, "t": 1024 * 1024}
    t = text.strip().lower().rstrip("b")
    # a bare number is MiB for Spark's memory settings
    return int(float(t[:-1]) * units[t[-1]]) if t and t[-1] in units else int(float(t))


def tree_memory_mb(cap: int = 1024) -> int:
    """Histogram memory for tree training: an eighth of the executor heap
    (the driver's in local mode), capped.  More memory means more nodes per
    pass over the data, i.e. fewer jobs per tree level."""
    spark = SparkSession.getActiveSession()
    conf = spark.sparkContext.getConf() if spark else None
    heap = _memory_mb(conf.get("spark.executor.memory", conf.get("spark.driver.memory", "1g"))) if conf else 1024
    return int(max(256, min(cap, heap // 8)))


def random_forest(trees: int = 200, depth: int = 30, seed: int = 42, **kw) -> RandomForestClassifier:
    """A forest of trees grown as deep as Spark allows (30), unless the caller asks for less."""
    return RandomForestClassifier(
        numTrees=trees,
        maxDepth=depth,
        featureSubsetStrategy="sqrt",
        seed=seed,
        maxMemoryInMB=tree_memory_mb(),
        cacheNodeIds=True,
        checkpointInterval=10,
        **kw,
    )


def boosted_trees(rounds: int = 150, step: float = 0.05, depth: int = 4, seed: int = 42, **kw) -> GBTClassifier:
    # checkpointInterval cuts the lineage of the boosting iterations into the
    # shared checkpoint folder (spark.checkpoint.dir)
    return GBTClassifier(
        maxIter=rounds, stepSize=step, maxDepth=depth, seed=seed, maxMemoryInMB=tree_memory_mb(), cacheNodeIds=True, checkpointInterval=10, **kw
    )


# --------------------------------------------------------- RBF kernel SVM
class RandomFourierFeatures(Transformer, HasFeaturesCol, HasOutputCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """z(x) = sqrt(2/D) cos(W x + b), W ~ N(0, 2 gamma), b ~ U(0, 2 pi).

    Approximates the RBF kernel exp(-gamma |x - y|^2).  The weights are a
    seeded constant (D x d numbers); the map is one array expression, so it
    runs in codegen on the executors.
    """

    numFeatures = Param(Params._dummy(), "numFeatures", "number of random features D", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "RBF kernel width", TypeConverters.toFloat)
    inputDim = Param(Params._dummy(), "inputDim", "length of the input vector", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featuresCol="features", outputCol="rff", numFeatures=200, gamma=0.125, inputDim=8, seed=42):
        super().__init__()
        self._set(**self._input_kwargs)

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.RandomState(self.getOrDefault(self.seed) % (2**32))
        d, D = self.getOrDefault(self.inputDim), self.getOrDefault(self.numFeatures)
        W = rng.normal(0.0, math.sqrt(2.0 * self.getOrDefault(self.gamma)), size=(D, d))
        b = rng.uniform(0.0, 2.0 * math.pi, size=D)
        return W, b

    def _transform(self, dataset: DataFrame) -> DataFrame:
        W, b = self.weights()
        x = vector_to_array(F.col(self.getFeaturesCol()))
        scale = math.sqrt(2.0 / len(b))
        # one row of W plus its phase per output: a constant array, folded once
        table = F.array(
            *[F.struct(F.array(*[F.lit(float(v)) for v in W[i]]).alias("w"), F.lit(float(b[i])).alias("b")) for i in range(len(b))]
        )
        comps = F.transform(
            table,
            lambda r: F.lit(scale)
            * F.cos(r["b"] + F.aggregate(F.zip_with(r["w"], x, lambda a, v: a * v), F.lit(0.0), lambda acc, t: acc + t)),
        )
        return dataset.withColumn(self.getOutputCol(), array_to_vector(comps))


class VectorElement(Transformer, HasInputCols, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """One element of a vector column as a one-element vector (Platt's input)."""

    index = Param(Params._dummy(), "index", "element index", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCol=None, index=1):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        col = self.getInputCols()[0]
        el = vector_to_array(F.col(col))[self.getOrDefault(self.index)]
        return dataset.withColumn(self.getOutputCol(), array_to_vector(F.array(el)))


def rbf_svm(n_train: int, dim: int, C: float = 1.0, gamma: float | None = None, components: int = 200, seed: int = 42) -> Pipeline:
    """RFF + LinearSVC + Platt scaling, as one Pipeline over ``features``.

    ``gamma`` defaults to 1 / (d * Var X) with Var X = 1 for standardised
    input.
    """
    g = gamma if gamma is not None else 1.0 / dim
    return Pipeline(
        stages=[
            RandomFourierFeatures(featuresCol="features", outputCol="_rff", numFeatures=components, gamma=g, inputDim=dim, seed=seed),
            LinearSVC(featuresCol="_rff", regParam=1.0 / (C * max(1, n_train)), maxIter=100, standardization=False, rawPredictionCol="_svm_raw", predictionCol="_svm_pred"),
            VectorElement(inputCols=["_svm_raw"], outputCol="_margin", index=1),
            LogisticRegression(featuresCol="_margin", regParam=0.0, maxIter=100),
        ]
    )


# -------------------------------------------------------------- soft voting
class SoftVotingClassifier(Estimator, HasFeaturesCol):
    """Mean of the members' positive-class probabilities.

    Members are fitted concurrently (independent Spark jobs from a small
    driver thread pool).
    """

    def __init__(self, members: Sequence[tuple[str, Estimator]], parallelism: int = 3):
        super().__init__()
        self.members = list(members)
        self.parallelism = parallelism

    def _fit(self, dataset: DataFrame) -> "SoftVotingModel":
        with ThreadPoolExecutor(max_workers=self.parallelism) as pool:
            fitted = list(pool.map(lambda m: (m[0], m[1].fit(dataset)), self.members))
        return SoftVotingModel(fitted)


class SoftVotingModel(Model, MLWritable, MLReadable):
    def __init__(self, fitted: Sequence[tuple[str, Model]]):
        super().__init__()
        self.fitted = list(fitted)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = dataset
        probs = []
        for i, (_, m) in enumerate(self.fitted):
            scored = m.transform(out)
            col = f"_vote_p{i}"
            out = scored.withColumn(col, vector_to_array(F.col("probability"))[1]).drop(
                "probability", "rawPrediction", "prediction"
            )
            probs.append(F.col(col))
        mean = sum(probs[1:], probs[0]) / F.lit(float(len(probs)))
        return out.withColumn(SCORE, mean).withColumn(PRED, predicted_label(F.col(SCORE)))

    def write(self) -> MLWriter:
        return _SoftVotingWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _SoftVotingReader()


class _SoftVotingWriter(MLWriter):
    """Members saved with their own writers under ``member_i``; names and
    classes in a one-line JSON ``metadata`` table."""

    def __init__(self, instance: SoftVotingModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        meta = [
            {"name": name, "class": f"{type(m).__module__}.{type(m).__name__}", "dir": f"member_{i}"}
            for i, (name, m) in enumerate(self.instance.fitted)
        ]
        self.sparkSession.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode(
            "overwrite"
        ).text(f"{path}/metadata")
        for entry, (_, m) in zip(meta, self.instance.fitted):
            m.write().overwrite().save(f"{path}/{entry['dir']}")


class _SoftVotingReader(MLReader):
    def load(self, path: str) -> SoftVotingModel:
        meta = json.loads(self.sparkSession.read.text(f"{path}/metadata").first()[0])
        fitted = []
        for entry in meta:
            module, _, name = entry["class"].rpartition(".")
            cls = getattr(importlib.import_module(module), name)
            fitted.append((entry["name"], cls.load(f"{path}/{entry['dir']}")))
        return SoftVotingModel(fitted)


def fit_scored(estimator: Estimator, train: DataFrame, test: DataFrame) -> tuple[Model, DataFrame]:
    """Fit on ``train`` and score ``test`` (adds ``score`` and ``pred``)."""
    model = estimator.fit(train)
    scored = model.transform(test)
    if SCORE not in scored.columns:
        scored = positive_probability(scored)
    return model, scored


def last_stage(model: Model) -> Model:
    return model.stages[-1] if isinstance(model, PipelineModel) else model
