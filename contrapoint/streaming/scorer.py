"""Neighbour search for a stream of queries against a static reference set (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.search import knn


def start(queries: DataFrame, candidates: DataFrame, k: int, out: str, checkpoint: str, metric="euclidean", kind: str = "vector"):
    """A started query: every micro-batch of (``sample_id``, ``value``) is searched and its neighbours are stored.

    Each batch overwrites its own partition of ``out``, so a batch that runs again after a failure leaves no duplicates.
    """

    def step(batch: DataFrame, epoch: int) -> None:
        found = knn(batch, candidates, k, metric, kind)
        found.withColumn("processed", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return queries.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
