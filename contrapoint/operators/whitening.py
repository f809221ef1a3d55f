"""Distances that know how the features vary: Mahalanobis and standardised Euclidean, as Euclidean ones of turned vectors.

Sums, products and the count of all rows are added up in one pass, in Arrow batches, a matrix a partition, then position by
position; the covariance is as large as a row's square, which is bounded by ``MOST``. A triangular factor of its inverse
turns vectors so that their Euclidean distance is the one wanted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .search import knn

#: Features of a row at most, and the part of the largest variance below which a direction counts as without any.
MOST, FLAT = 4096, 1e-12


def moments(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(count, mean, covariance over n - 1) of the vectors in ``value``; null vectors and those holding nulls are left out."""
    rows = rows.where(F.col("value").isNotNull() & F.forall("value", lambda x: x.isNotNull())).select(F.col("value").cast("array<double>").alias("value"))
    first = rows.first()
    if first is None:
        return 0, np.empty(0), np.empty((0, 0))
    width = len(first[0])
    if width > MOST:
        raise ValueError(f"{width} features are more than {MOST}")
    middle = np.array(first[0])  # any point near the data keeps sums of squares small

    def add(batches):
        total = np.zeros(1 + width + width * width)
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(-1, width) - middle
            total += np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["sums"])

    parts = rows.mapInArrow(add, "sums array<double>").select(F.posexplode("sums").alias("at", "x"))
    sums = np.zeros(1 + width + width * width)
    for at, x in parts.groupBy("at").agg(F.sum("x")).collect():  # a row's square
        sums[at] = x
    n, shift = int(sums[0]), sums[1 : 1 + width]
    cov = (sums[1 + width :].reshape(width, width) - np.outer(shift, shift) / n) / max(1, n - 1)
    return n, middle + shift / n, cov


def whitening(cov: np.ndarray) -> np.ndarray:
    """The matrix W with |x W - y W| the Mahalanobis distance of x and y.

    It is the triangular factor of the inverse where there is one. A singular covariance is inverted on the directions that
    vary, so that a difference in others counts nothing.
    """
    if not cov.size:
        return cov
    values, vectors = np.linalg.eigh(cov)
    if values.min() > FLAT * max(values.max(), 0):
        return np.linalg.inv(np.linalg.cholesky(cov)).T
    varies = values > FLAT * max(values.max(), 0)
    return vectors[:, varies] / np.sqrt(values[varies])


def scaling(cov: np.ndarray) -> np.ndarray:
    """The same for standardised differences: each feature over its deviation; one without variance counts nothing."""
    var = np.diag(cov) if cov.size else np.empty(0)
    return np.diag(np.where(var > 0, 1 / np.sqrt(np.where(var > 0, var, 1)), 0))


def turned(rows: DataFrame, matrix: np.ndarray) -> DataFrame:
    """``rows`` with ``value`` times the matrix; vectors of another length become null."""
    sent = rows.sparkSession.sparkContext.broadcast(matrix)  # a row's square at most
    rows = rows.withColumn("value", F.col("value").cast("array<double>"))
    names, at = rows.columns, rows.columns.index("value")

    def run(batches):
        m = sent.value
        for batch in batches:
            values = batch.column(at)
            fits = np.array([v is not None and len(v) == len(m) and None not in v for v in values.to_pylist()], bool)
            x = values.filter(pa.array(fits)).flatten().to_numpy().reshape(-1, len(m)) @ m
            out = [None] * len(fits)
            for i, v in zip(np.flatnonzero(fits), x.tolist(), strict=True):
                out[i] = v
            columns = list(batch.columns)
            columns[at] = pa.array(out, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, rows.schema)


def knn_by_covariance(
    queries: DataFrame, candidates: DataFrame, k: int, metric: str = "mahalanobis", reference: DataFrame | None = None, **options
) -> DataFrame:
    """``knn`` by the ``mahalanobis`` or ``seuclidean`` distance; covariance is that of ``reference``, or of both sides' rows."""
    rows = reference if reference is not None else queries.select("value").unionByName(candidates.select("value"))
    n, _, cov = moments(rows)
    if metric not in ("mahalanobis", "seuclidean"):
        raise ValueError(f"unknown metric {metric!r}")
    matrix = (whitening if metric == "mahalanobis" else scaling)(cov)
    if not n:
        matrix = np.empty((0, 0))
    return knn(turned(queries, matrix), turned(candidates, matrix), k, "euclidean", **options)
