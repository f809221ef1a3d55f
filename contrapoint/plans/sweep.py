"""Sweeps over distance configurations: the grid, shared searches, scoring, resume and the k curve."""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics
from ..operators.kept import written
from ..operators.objectives import KINDS, Modality, assemble
from ..sources import tables
from ..sources.dataset import Dataset
from .generators import CounterfactualLibrary, Generator

RUN = "combo_id string, status string, error string, runtime_sec double, n_samples long, started string, finished string"


def grid(axes: dict[str, list], most: int | None = None) -> list[dict]:
    """The product of the axes in order, its head if limited; an empty axis means none, not a default."""
    names = [n for n, values in axes.items() if values]
    combos = itertools.product(*(axes[n] for n in names))
    return [{"combo_id": f"combo_{i:04d}", **dict(zip(names, c, strict=True))} for i, c in enumerate(itertools.islice(combos, most))]


def available(options: list[str], usable: Callable[[str], bool]) -> list[str]:
    return [o for o in options if usable(o)]


def query_count(ds: Dataset, limit: int | None = None) -> DataFrame:
    """The test samples, or the first ``limit`` of them by id."""
    rows = ds.part(ds.samples, "test").orderBy("sample_id")
    return rows.limit(limit) if limit is not None else rows


def modalities(
    ds: Dataset, candidates: DataFrame, target: int, keys: list[str], names: list[str] | None = None,
    vectors: dict[str, DataFrame] | None = None, weights: dict[str, float] | None = None
) -> list[Modality]:
    """The branches that candidates are scored on: all tabular and series ones, and the texts and images with ``vectors``.

    ``vectors`` (split, sample_id, value) hold a text's embeddings; images are vectors themselves. References for
    plausibility are the target class's training rows. ``names`` picks branches.
    """
    out, vectors, weights = [], vectors or {}, weights or {}
    test = lambda df, *c: ds.part(df, "test").select(F.col("sample_id").alias("query_id"), *c)
    for kind in KINDS:
        for name, rows in ds.store(kind).items():
            if (names is not None and name not in names) or (kind == "text" and name not in vectors):
                continue
            if kind in ("tabular", "series"):
                store = F.col("num" if kind == "tabular" else "ser")
                cand, factual, reference = candidates.where(F.map_contains_key(store, F.lit(name))).select(*keys, store[name].alias("value")), test(rows, "value"), ds.candidates(rows, target)
            else:
                values = vectors.get(name, rows)
                column = ["text"] if kind == "text" else []
                both = lambda split, values=values, rows=rows, column=column: ds.part(values, split).join(
                    ds.part(rows, split).select("sample_id", *column), "sample_id"
                ) if column else ds.part(values, split)
                anchored = candidates.where(F.map_contains_key("anchors", F.lit(name))).withColumn("_anchor", F.col("anchors")[name])
                cand = anchored.join(
                    both("train").select(F.col("sample_id").alias("_anchor"), "value", *column), "_anchor", "left"
                ).select(*keys, "value", *column)
                factual, reference = both("test").select(F.col("sample_id").alias("query_id"), "value", *column), ds.candidates(values, target)
            out.append(Modality(name, kind, cand, factual, reference, weights.get(name, 1.0)))
    return out


def score(
    ds: Dataset, candidates: DataFrame, target: int, branch: str | None = None, predictions: DataFrame | None = None,
    extra: tuple[str, ...] = (), vectors: dict[str, DataFrame] | None = None, weights: dict[str, float] | None = None
) -> DataFrame:
    """All objectives of candidates against their factuals over all branches, or one; outcome by the anchor's prediction if there is one."""
    keys, candidates = [*extra, "generator", "query_id", "cand_rank"], written(candidates, "candidates")  # every branch reads them
    pred = (predictions if predictions is not None else ds.part(ds.samples, "train")).select(F.col("sample_id").alias("anchor_id"), "pred")
    said = candidates.select(*keys, "anchor_id").join(pred, "anchor_id", "left").select(*keys, "pred")
    return assemble(modalities(ds, candidates, target, keys, [branch] if branch else None, vectors, weights), keys, target, said)


def run(
    spark: SparkSession, ds: Dataset, combos: list[dict], build: Callable[[dict], dict[str, Generator]], target: int, queries: DataFrame,
    out: str, run_id: str, k: int = 20, keep_candidates: bool = False
) -> DataFrame:
    """Run the configurations that are not finished yet; candidates, scores and statuses go to tables under ``out``.

    A configuration that fails is recorded with its error and tried again by the next run.
    """
    status = tables.read_optional(spark, f"{out}/status")
    done = {r.combo_id for r in status.where("status = 'ok'").select("combo_id").distinct().collect()} if status is not None else set()
    n = queries.count()
    for combo in combos:
        if combo["combo_id"] in done:
            continue
        began, started, error = time.time(), datetime.now(UTC).isoformat(), None
        try:
            found = CounterfactualLibrary(build(combo)).run(ds, queries, target, k)
            if keep_candidates:
                found.write.mode("overwrite").parquet(f"{out}/candidates/combo={combo['combo_id']}")
                found = spark.read.parquet(f"{out}/candidates/combo={combo['combo_id']}")
            scored = score(ds, found, target).withColumn("combo_id", F.lit(combo["combo_id"])).withColumn("run_id", F.lit(run_id))
            scored.write.mode("overwrite").parquet(f"{out}/scores/combo={combo['combo_id']}")
        except Exception as e:  # one configuration must not end the sweep
            error = str(e)[:2000]
        row = (combo["combo_id"], "failed" if error else "ok", error, time.time() - began, n, started, datetime.now(UTC).isoformat())
        spark.createDataFrame([row], RUN).write.mode("append").parquet(f"{out}/status")
    return tables.last_row_per(spark.read.parquet(f"{out}/status"), ["combo_id"], "finished")


def rescore(spark: SparkSession, ds: Dataset, target: int, out: str, version: str) -> DataFrame:
    """Score kept candidates anew into ``scores-<version>``; earlier scores stay as they are."""
    found = spark.read.parquet(f"{out}/candidates")
    scored = score(ds, found, target, extra=("combo",)).withColumnRenamed("combo", "combo_id")
    scored.write.mode("overwrite").partitionBy("combo_id").parquet(f"{out}/scores-{version}")
    return spark.read.parquet(f"{out}/scores-{version}")


def objectives(spark: SparkSession, out: str) -> DataFrame:
    """Means by configuration and generator of all scores under ``out``."""
    rows = spark.read.option("basePath", f"{out}/scores").parquet(f"{out}/scores")
    return analytics.means(rows, ["combo_id", "generator"])


def k_ablation(scores: DataFrame, ks: list[int]) -> DataFrame:
    """Scored once, sliced at every k: the mean over configurations of their means."""
    per = analytics.k_curve(scores, ks, ("combo_id", "generator"))
    return per.groupBy("k", "generator").agg(*[F.avg(c).alias(c) for c in analytics.OBJECTIVES], F.sum("n").alias("n"))
