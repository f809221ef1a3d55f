"""Outcome, proximity, sparsity and plausibility of candidates over any number of tabular, series, text and image branches."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores, series
from ..functions import text as text_functions
from .kept import digest, written
from .lof import Plausibility

KINDS = ("tabular", "series", "text", "image")
OBJECTIVES = ("proximity", "sparsity", "plausibility")


@dataclass
class Modality:
    """One branch of the candidates and what it is judged against.

    ``candidate`` has the keys, ``query_id`` among them, and ``value``; ``factual`` has ``query_id`` and ``value``.
    Values are vectors, channel-major series, or embeddings of texts and images; texts also have ``text``, images may have
    ``pixels``. ``reference`` (``sample_id``, ``value``) is the class, or all rows, for plausibility, which is left out
    without it; with under three reference rows a text's plausibility is 1. ``how`` is ``percentile``, ``unit`` or ``raw``. ``tau`` are a series'
    thresholds by channel; ``distances`` (``distance``) make proximity a percentile rank.
    """

    name: str
    kind: str
    candidate: DataFrame
    factual: DataFrame
    reference: DataFrame | None = None
    weight: float = 1.0
    how: str = "percentile"
    tau: list[float] = field(default_factory=list)
    distances: DataFrame | None = None
    threshold: float = 0.0


def _paired(m: Modality) -> DataFrame:
    return m.candidate.join(m.factual.select("query_id", *[F.col(c).alias(f"_f_{c}") for c in m.factual.columns if c != "query_id"]), "query_id")


def _near_and_sparse(m: Modality, rows: DataFrame):
    a, b = F.col("_f_value"), F.col("value")
    if m.kind == "tabular":
        return scores.tabular_proximity(a, b), scores.tabular_sparsity(a, b)
    if m.kind == "series":
        return series.proximity(a, b), series.sparsity(a, b, F.array(*[F.lit(float(t)) for t in m.tau]) if m.tau else None)
    if m.kind == "text":
        tokens = (text_functions.tokens(F.col("_f_text")), text_functions.tokens(F.col("text"))) if {"text", "_f_text"} <= set(rows.columns) else None
        return scores.embedding_proximity(a, b), text_functions.edit_sparsity(*tokens) if tokens else F.lit(None).cast("double")
    pixels = (F.col("_f_pixels"), F.col("pixels")) if {"pixels", "_f_pixels"} <= set(rows.columns) else (a, b)
    return F.coalesce(scores.cosine_proximity(a, b), F.lit(1.0)), scores.image_sparsity(*pixels, m.threshold)


def judged_values(values: DataFrame, reference: DataFrame, how: str = "percentile", judge: Plausibility | None = None) -> DataFrame:
    """(``d0``, ``d1``, ``plausibility``) by the values' digests; each distinct value of ``value`` is scored once."""
    judge = judge or Plausibility(reference)
    own = values.where("value IS NOT NULL").select("value", *digest(F.col("value"))).dropDuplicates(["d0", "d1"])
    own = written(own.withColumn("sample_id", F.monotonically_increasing_id()), "values")  # searched several times
    rows = own.select("sample_id", "value")
    found = judge.raw(rows).withColumnRenamed("lof", "plausibility") if how == "raw" or judge.n <= 2 else judge.scaled(rows, how)
    return own.select("sample_id", "d0", "d1").join(found, "sample_id").select("d0", "d1", "plausibility")


def plausibility(m: Modality) -> DataFrame | None:
    """The candidates' digests with ``plausibility``. None without a reference, or for a text with under three reference rows."""
    if m.reference is None:
        return None
    flat = (lambda df: df.withColumn("value", F.flatten("value"))) if m.kind == "series" else (lambda df: df)
    reference = flat(m.reference.select("sample_id", "value")).where("value IS NOT NULL")
    judge = Plausibility(reference)
    if not judge.n or (m.kind == "text" and judge.n < 3):
        return None
    return judged_values(flat(m.candidate.select("value")), reference, m.how, judge)


def assemble(modalities: list[Modality], keys: list[str], target: int, predictions: DataFrame | None = None, renormalise: bool = False) -> DataFrame:
    """(keys, ``outcome``, ``proximity``, ``sparsity``, ``plausibility``), one row per candidate of any modality.

    Weights are made to add up to one over all modalities; a part that a modality can't give is skipped and keeps its
    weight, unless ``renormalise``. A text or image without a candidate has proximity and plausibility 1. The outcome
    needs ``predictions`` (keys, ``pred``). The modalities' rows are summed by key in one shuffle.
    """
    total = sum(m.weight for m in modalities)
    if not modalities or total < 1e-8:
        raise ValueError("no modality, or weights that sum to zero")
    if unknown := {m.kind for m in modalities} - set(KINDS):
        raise ValueError(f"unknown kinds of modality {sorted(unknown)}")
    parts = []
    for m in modalities:
        rows = _paired(m)
        near, sparse = _near_and_sparse(m, rows)
        rows = rows.select(
            *keys, *[c.alias(f"_d{i}") for i, c in enumerate(digest(F.flatten("value") if m.kind == "series" else F.col("value")))],
            F.col("value").isNull().alias("_none"),
            near.alias("proximity"), sparse.alias("sparsity")
        )
        if m.distances is not None:
            rows = scores.with_percentile_rank(rows.withColumnRenamed("proximity", "_raw"), "_raw", m.distances, "distance", "proximity").drop("_raw")
        judged = plausibility(m)
        if judged is not None:
            missing = F.when(F.col("_none") & F.lit(m.kind in ("text", "image")), 1.0)
            rows = rows.join(
                judged.withColumnsRenamed({"d0": "_d0", "d1": "_d1"}), ["_d0", "_d1"], "left"
            ).withColumn("plausibility", F.coalesce("plausibility", missing))
        else:
            least = 1.0 if m.kind == "text" and m.reference is not None else None
            rows = rows.withColumn("plausibility", F.lit(least).cast("double"))
        share = F.lit(m.weight / total)
        parts.append(
            rows.select(
                *keys, *[(F.col(c) * share).alias(c) for c in OBJECTIVES],
                *[F.when(F.col(c).isNotNull(), share).alias(f"_w_{c}") for c in OBJECTIVES]
            )
        )
    summed = reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in OBJECTIVES], *[F.sum(f"_w_{c}").alias(f"_w_{c}") for c in OBJECTIVES]
    )
    out = summed.select(*keys, *[(F.col(c) / F.col(f"_w_{c}") if renormalise else F.col(c)).alias(c) for c in OBJECTIVES])
    if predictions is None:
        return out.select(*keys, F.lit(None).cast("double").alias("outcome"), *OBJECTIVES)
    return out.join(predictions.select(*keys, "pred"), keys, "left").select(
        *keys, scores.outcome(F.col("pred"), F.lit(target)).alias("outcome"), *OBJECTIVES
    )


def summed(parts: dict, base_weight: float = 1.0, text_weight: float = 1.0):
    """The unnormalised sum of tabular and series parts, then with the text's part as a weighted sum."""
    base = sum((parts[k] for k in ("tabular", "series") if parts.get(k) is not None), F.lit(0.0))
    return base if parts.get("text") is None else base_weight * base + text_weight * parts["text"]
