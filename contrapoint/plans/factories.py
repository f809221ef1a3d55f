"""Datasets with a model's predictions, by the strategy that fuses their branches.

``early`` gives all branches to one predictor, ``late`` averages the probabilities of one predictor a branch, and
``intermediate`` puts the fused vectors through a network. Each makes the dataset's samples anew with ``pred`` (null where a
row can't be scored) and ``error`` (why). Rows are joined by split and id; a branch that a predictor doesn't name isn't read.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.kept import written
from ..operators.models import Network
from ..operators.predictors import Predictor, label, predict
from ..operators.preprocess import late_fusion
from ..sources.dataset import Dataset
from .generators import EarlyFusionNN

KEYS = ["split", "sample_id"]


def branch_rows(ds: Dataset, names: list[str], vectors: dict[str, DataFrame] | None = None) -> DataFrame:
    """The samples' keys with a column for each named branch; ``vectors`` are texts' or images' own."""
    stores = {**ds.tabular, **ds.series, **ds.images, **(vectors or {})}
    if unknown := [n for n in names if n not in stores]:
        raise ValueError(f"no branch {unknown}")
    branches = [stores[n].select(*KEYS, F.col("value").alias(n)) for n in names]
    return reduce(lambda a, b: a.join(b, KEYS, "left"), branches, ds.samples.select(*KEYS))


def _with_predictions(ds: Dataset, said: DataFrame) -> Dataset:
    columns = [c for c in ds.samples.columns if c not in ("pred", "error")]
    return replace(ds, samples=written(ds.samples.select(*columns).join(said.select(*KEYS, "pred", "error"), KEYS, "left"), "samples"))


def early(ds: Dataset, predictor: Predictor, vectors: dict[str, DataFrame] | None = None) -> Dataset:
    rows = predict(branch_rows(ds, predictor.columns(), vectors), predictor)
    return _with_predictions(ds, rows.withColumn("pred", label(F.col("probability"))))


def late(ds: Dataset, branches: dict[str, Predictor], vectors: dict[str, DataFrame] | None = None) -> Dataset:
    """A row is scored by all of the branches' predictors or by none; they give equally many probabilities."""
    names = list(dict.fromkeys(c for p in branches.values() for c in p.columns()))
    rows = branch_rows(ds, names, vectors)
    for name, p in branches.items():
        rows = predict(rows, p, f"_{name}_")
    errors = F.coalesce(*[F.concat(F.lit(f"{n}: "), F.col(f"_{n}_error")) for n in branches])
    mean = late_fusion([F.col(f"_{n}_probability") for n in branches])
    return _with_predictions(ds, rows.withColumn("error", errors).withColumn("pred", F.when(F.col("error").isNull(), label(mean))))


def intermediate(ds: Dataset, network: Network, text_vectors: list[DataFrame] | None = None) -> Dataset:
    rows = network.output(EarlyFusionNN(text_vectors=text_vectors or []).fused(ds), -1)
    said = rows.withColumn("pred", label(F.col("value"))).withColumn("error", F.when(F.col("value").isNull(), "the fused vector doesn't fit"))
    return _with_predictions(ds, said)
