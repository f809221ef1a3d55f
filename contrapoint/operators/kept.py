"""Tables that outlive a job: intermediate rows, and fitted scores kept by the digest of what was scored."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share; a local session without one takes a temporary one."""
    sc = spark.sparkContext
    if base := sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir():
        return base
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="contrapoint-"))
    return sc.getCheckpointDir()


def written(rows: DataFrame, name: str = "rows") -> DataFrame:
    """``rows`` written to the shared folder and read again, so that what made them runs once."""
    path = f"{shared_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    schema = rows.schema
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(schema).parquet(path)


def digest(value: Column) -> list[Column]:
    """128 bits of a value of any type, as two columns ``d0`` and ``d1``."""
    return [F.xxhash64(F.lit(i), value).alias(f"d{i}") for i in range(2)]


class ScoreTable:
    """Scores of values by their digest, for one fitted model named by ``fit``; values that are there are not scored again.

    The table at ``path`` holds (``fit``, ``d0``, ``d1``, ``score``) and only grows: a run appends the scores of the values
    that it lacked, in one job that is committed as a whole. Two runs at a time may both append a value; its scores are
    equal, and one of them is read. A null value has no score.
    """

    def __init__(self, spark: SparkSession, path: str, fit: str):
        self.spark, self.path, self.fit = spark, path, fit

    def known(self) -> DataFrame:
        """(``d0``, ``d1``, ``score``) of this fit."""
        schema = "fit string, d0 long, d1 long, score double"
        try:
            rows = self.spark.read.schema(schema).parquet(self.path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = self.spark.createDataFrame([], schema)
        return rows.where(F.col("fit") == self.fit).groupBy("d0", "d1").agg(F.min("score").alias("score"))

    def missing(self, rows: DataFrame) -> DataFrame:
        """(``d0``, ``d1``, ``value``): the distinct values without a score; equal values are one."""
        own = rows.where("value IS NOT NULL").select(*digest(F.col("value")), "value").dropDuplicates(["d0", "d1"])
        return own.join(self.known(), ["d0", "d1"], "left_anti")

    def score(self, rows: DataFrame, f: Callable[[DataFrame], DataFrame], out: str = "score") -> DataFrame:
        """``rows`` with ``out``. ``f`` gives (``sample_id``, ``score``) for the misses (``sample_id``, ``value``), if there are any."""
        todo = written(self.missing(rows).withColumn("sample_id", F.monotonically_increasing_id()), "misses")
        if not todo.isEmpty():
            found = todo.join(f(todo.select("sample_id", "value")), "sample_id")
            found.select(F.lit(self.fit).alias("fit"), "d0", "d1", F.col("score").cast("double").alias("score")).write.mode("append").parquet(self.path)
        keyed = rows.select("*", *[c.alias(f"_k{i}") for i, c in enumerate(digest(F.col("value")))])
        known = self.known().select(F.col("d0").alias("_k0"), F.col("d1").alias("_k1"), F.col("score").alias("_score"))
        return keyed.join(known, ["_k0", "_k1"], "left").select(*[F.col(c) for c in rows.columns if c != out], F.when(F.col("value").isNotNull(), F.col("_score")).alias(out))
