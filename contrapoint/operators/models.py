"""Classifiers on features, as Spark ML pipelines: they supply the predictions that outcome needs."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import IDF, PCA, CountVectorizer, NGram, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .analytics import macro_metrics

CLASSIFIERS = {"logistic": LogisticRegression, "forest": RandomForestClassifier, "boosting": GBTClassifier}


def fit(rows: DataFrame, kind: str = "logistic", weight: str | None = None, **options):
    """A model of ``label`` from the array column ``value``."""
    model = CLASSIFIERS[kind](featuresCol="features", labelCol="label", **({"weightCol": weight} if weight else {}), **options)
    return model.fit(rows.withColumn("features", array_to_vector("value")))


def predict(model, rows: DataFrame) -> DataFrame:
    """``rows`` with ``probability`` (an array) and ``pred``."""
    out = model.transform(rows.withColumn("features", array_to_vector("value")))
    return out.select(*rows.columns, vector_to_array("probability").alias("probability"), F.col("prediction").cast("int").alias("pred"))


def text_pipeline(weight: str | None = None, max_features: int = 10_000, **options) -> Pipeline:
    """Unigrams and bigrams, TF-IDF, logistic regression over ``text`` and ``label``."""
    from pyspark.ml.feature import VectorAssembler

    words = RegexTokenizer(inputCol="text", outputCol="words", pattern=r"\W+", minTokenLength=2)
    stages = [words, NGram(n=2, inputCol="words", outputCol="pairs")]
    for c in ("words", "pairs"):
        stages += [CountVectorizer(inputCol=c, outputCol=f"{c}_tf", vocabSize=max_features), IDF(inputCol=f"{c}_tf", outputCol=f"{c}_idf")]
    stages += [
        VectorAssembler(inputCols=["words_idf", "pairs_idf"], outputCol="features"),
        LogisticRegression(**({"weightCol": weight} if weight else {}), **options)
    ]
    return Pipeline(stages=stages)


def best_regularisation(train: DataFrame, valid: DataFrame, strengths: list[float]):
    """The text model of the highest validation macro F1, then the lower strength, with its score."""
    best = None
    for s in sorted(strengths):
        model = text_pipeline(regParam=s).fit(train)
        rows = model.transform(valid).select(F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("pred"))
        f1 = macro_metrics(rows).first().macro_f1
        if best is None or f1 > best[1]:
            best = model, f1
    return best


def predict_udf(f: Callable[[np.ndarray], np.ndarray]):
    """A column function from a Python predictor (matrix -> class probabilities), in Arrow batches."""

    @F.pandas_udf("array<double>")
    def udf(v: pd.Series) -> pd.Series:
        return pd.Series(np.asarray(f(np.stack(v.to_list())), float).tolist()) if len(v) else pd.Series([], dtype=object)

    return udf


@dataclass(frozen=True)
class Network:
    """A fitted feed-forward network: sizes of its layers, and for each step the weights (outputs x inputs) and biases.

    Hidden layers are sigmoid, the last one is a softmax.
    """

    weights: tuple[np.ndarray, ...]
    biases: tuple[np.ndarray, ...]

    @classmethod
    def of(cls, model) -> Network:
        """The layers of a fitted Spark ML perceptron, whose weights stand column by column, each layer's biases after them."""
        sizes, flat, at, weights, biases = list(model.getLayers()), model.weights.toArray(), 0, [], []
        for a, b in itertools.pairwise(sizes):
            weights.append(flat[at : at + a * b].reshape(a, b).T)
            biases.append(flat[at + a * b : at + a * b + b])
            at += a * b + b
        return cls(tuple(weights), tuple(biases))

    def forward(self, x: np.ndarray, layer: int = -1) -> np.ndarray:
        """What comes out of a layer, counted from the end if negative; 0 is the input."""
        steps = layer if layer >= 0 else len(self.weights) + 1 + layer
        if not 0 <= steps <= len(self.weights):
            raise ValueError(f"the network has no layer {layer}")
        for i in range(steps):
            z = x @ self.weights[i].T + self.biases[i]
            if i + 1 < len(self.weights):
                x = 1 / (1 + np.exp(-z))
            else:
                e = np.exp(z - z.max(1, keepdims=True))
                x = e / e.sum(1, keepdims=True)
        return x

    def output(self, rows: DataFrame, layer: int = -2) -> DataFrame:
        """``rows`` with ``value``, the network's input, replaced by a layer's output, in Arrow batches.

        A value that is null, holds nulls or is of another length becomes null.
        """
        width, names = self.weights[0].shape[1], rows.columns
        rows = rows.withColumn("value", F.col("value").cast("array<double>"))
        at = names.index("value")

        def run(batches):
            for batch in batches:
                found = batch.column(at).to_pylist()
                fits = [i for i, v in enumerate(found) if v is not None and len(v) == width and None not in v]
                out = [None] * len(found)
                if fits:
                    for i, v in zip(fits, self.forward(np.array([found[i] for i in fits], float), layer).tolist(), strict=True):
                        out[i] = v
                columns = list(batch.columns)
                columns[at] = pa.array(out, pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

        return rows.mapInArrow(run, rows.schema)


def fit_network(rows: DataFrame, hidden: list[int], seed: int = 7, **options) -> Network:
    """A network of ``label`` from the array column ``value``, fitted by Spark ML."""
    first = rows.select(F.size("value").alias("n")).first()
    if first is None:
        raise ValueError("no rows to fit on")
    classes = int(rows.agg(F.max("label")).first()[0]) + 1
    layers = [first["n"], *hidden, max(2, classes)]
    model = MultilayerPerceptronClassifier(layers=layers, featuresCol="features", labelCol="label", seed=seed, **options)
    return Network.of(model.fit(rows.withColumn("features", array_to_vector("value"))))


def components(train: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """``rows`` with ``value`` projected on the k principal directions of the training rows; signs are arbitrary."""
    vector = lambda df: df.withColumn("features", array_to_vector("value"))
    model = PCA(k=k, inputCol="features", outputCol="projected").fit(vector(train))
    return model.transform(vector(rows)).withColumn("value", vector_to_array("projected")).drop("features", "projected")


def truncated_svd(train: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """``rows`` with ``value`` projected on the k leading right singular vectors of the training rows, which are not centred.

    The vectors come from a distributed decomposition and are as long as a row, so only k of those are sent to the tasks.
    """
    from pyspark.mllib.linalg import Vectors
    from pyspark.mllib.linalg.distributed import RowMatrix

    matrix = RowMatrix(train.select("value").rdd.map(lambda r: Vectors.dense(r[0])))
    v = matrix.computeSVD(k).V.toArray()
    sent = rows.sparkSession.sparkContext.broadcast(v)

    @F.pandas_udf("array<double>")
    def project(x: pd.Series) -> pd.Series:
        return pd.Series((np.stack(x.to_list()) @ sent.value).tolist()) if len(x) else pd.Series([], dtype=object)

    return rows.withColumn("value", project("value"))


def convolution_features(rows: DataFrame, kernels: int = 200, seed: int = 7) -> DataFrame:
    """``rows`` with ``value``, a series, replaced by random convolutions' features (Dempster et al., 2020).

    Each kernel has a random length, weights, bias, dilation and channel; it gives the share of positive outputs and the
    largest one. Series are of equal length; the kernels depend on the seed and that length alone.
    """

    def features(x: np.ndarray) -> np.ndarray:
        rng, out = np.random.default_rng([seed, x.shape[1], x.shape[2]]), []
        steps = x.shape[2]
        for _ in range(kernels):
            length = int(rng.choice([n for n in (7, 9, 11) if n <= steps] or [steps]))
            weights = rng.standard_normal(length)
            weights -= weights.mean()
            dilation = int(2 ** rng.uniform(0, np.log2(max(1, (steps - 1) / max(1, length - 1)))))
            pad = (length - 1) * dilation // 2 if rng.integers(2) else 0
            channel, bias = int(rng.integers(x.shape[1])), rng.uniform(-1, 1)
            series = np.pad(x[:, channel], ((0, 0), (pad, pad)))
            span = series.shape[1] - (length - 1) * dilation
            got = sum(w * series[:, i * dilation : i * dilation + span] for i, w in enumerate(weights)) + bias
            out += [(got > 0).mean(1), got.max(1)]
        return np.stack(out, 1)

    @F.pandas_udf("array<double>")
    def udf(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        return pd.Series(features(np.array([[list(c) for c in s] for s in v], float)).tolist())

    return rows.withColumn("value", udf("value"))


def best_branch(branches: dict[str, DataFrame]) -> str:
    """The branch (validation rows with ``label`` and ``pred``) of the highest macro F1, then the least name."""
    return min(branches, key=lambda n: (-macro_metrics(branches[n]).first().macro_f1, n))


def random_options(axes: dict[str, list], count: int, seed: int = 0) -> list[dict]:
    """So many draws from the axes' values, for a random search."""
    rng = np.random.default_rng(seed)
    return [{k: v[int(rng.integers(len(v)))] for k, v in axes.items()} for _ in range(count)]
