"""The four objectives (lower is better) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import dot, norm


def _mean(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b) / F.size(x)


def outcome(pred: Column, target: Column) -> Column:
    """How far the prediction is from the target class; null without a prediction."""
    return F.abs(pred - target).cast("double")


def flipped(pred_before: Column, pred_after: Column) -> Column:
    return pred_before != pred_after


def tabular_proximity(factual: Column, candidate: Column) -> Column:
    return _mean(F.zip_with(factual, candidate, lambda x, y: F.abs(x - y)))


def tabular_sparsity(factual: Column, candidate: Column) -> Column:
    return _mean(F.zip_with(factual, candidate, lambda x, y: (x != y).cast("double")))


def _clipped(value: Column) -> Column:
    """The value between 0 and 1; null stays null, which least and greatest would pass over."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))


def embedding_proximity(factual: Column, candidate: Column) -> Column:
    """(1 - dot product) / 2 between 0 and 1; the embeddings are taken as they are. Without one of them it is 1."""
    return F.coalesce(_clipped((1 - dot(factual, candidate)) / 2), F.lit(1.0))


def cosine_proximity(factual: Column, candidate: Column) -> Column:
    """The same for vectors brought to length one first; null without one of them."""
    size = norm(factual) * norm(candidate)
    return F.when(size < 1e-16, F.lit(0.5)).otherwise(_clipped((1 - dot(factual, candidate) / size) / 2))


def image_sparsity(factual: Column, candidate: Column, threshold: float) -> Column:
    """The share of elements that differ by more than ``threshold``; bytes are scaled to 0..1, each image by itself.

    The longer image is cut to the shorter; without a candidate it is 1.
    """
    scaled = lambda v: F.when(F.array_max(v) > 1, F.transform(v, lambda x: x / 255.0)).otherwise(v)
    n = F.least(F.size(factual), F.size(candidate))
    pairs = F.zip_with(F.slice(scaled(factual), 1, n), F.slice(scaled(candidate), 1, n), lambda x, y: (F.abs(x - y) > threshold).cast("double"))
    return F.when(candidate.isNull(), F.lit(1.0)).otherwise(_mean(pairs))


def unit_interval(value: Column, low: Column, high: Column) -> Column:
    """Clipped to 0..1 between the bounds; 0.5 where they coincide or are not finite."""
    span = high - low
    flat = F.isnull(span) | F.isnan(span) | (F.abs(span) == float("inf")) | (span < 1e-8)
    return F.when(flat, F.lit(0.5)).otherwise(F.least(F.greatest((value - low) / span, F.lit(0.0)), F.lit(1.0)))


def with_percentile_rank(rows: DataFrame, value: str, reference: DataFrame, ref_value: str, out: str) -> DataFrame:
    """``rows`` with the share of reference values up to the row's; 1 for an empty reference.

    Rows and reference are merged in one sorted window over value buckets instead of a pairwise join: bucket counts give
    the rank before a bucket, a window inside each bucket the rest. Buckets are cut at the reference's quantiles.
    """
    from pyspark.sql import Window

    ref = reference.select(F.col(ref_value).cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    total, cuts = ref.agg(F.count("*"), F.percentile_approx("_v", [i / 512 for i in range(1, 512)], 5000)).first()
    if not total:
        return rows.withColumn(out, F.lit(1.0))
    bounds = F.array(*[F.lit(c) for c in sorted(set(cuts))])  # at most 511 numbers
    bucket = lambda v: F.size(F.filter(bounds, lambda c: c < v))
    counts = ref.groupBy(bucket(F.col("_v")).alias("_b")).agg(F.count("*").alias("_n"))
    before = counts.withColumn(
        "_before", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).select("_b", "_before", "_n")
    values = ref.groupBy("_v").agg(F.count("*").alias("_c")).select("_v", "_c", bucket(F.col("_v")).alias("_b"))
    wanted = rows.select(F.col(value).cast("double").alias("_v")).distinct().where("_v IS NOT NULL").withColumn("_b", bucket(F.col("_v"))).withColumn("_c", F.lit(0).cast("long"))
    inside = values.select("_b", "_v", "_c").unionByName(wanted.select("_b", "_v", "_c")).groupBy("_b", "_v").agg(F.sum("_c").alias("_c"))
    upto = inside.withColumn("_in", F.sum("_c").over(Window.partitionBy("_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
    # A bucket without reference values takes the count of all lower ones.
    known = before.select("_b", "_before").unionByName(
        upto.select("_b").distinct().join(before, "_b", "left_anti").withColumn("_before", F.lit(None).cast("long"))
    )
    ends = known.join(before.select("_b", "_n"), "_b", "left").withColumn(
        "_upto", F.max(F.col("_before") + F.col("_n")).over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    )
    known = ends.select("_b", F.coalesce("_before", "_upto", F.lit(0)).alias("_before"))
    share = upto.join(known, "_b").select("_v", ((F.col("_before") + F.col("_in")) / F.lit(total)).alias(out))
    return rows.withColumn("_v", F.col(value).cast("double")).join(share, "_v", "left").drop("_v")


def weighted(parts: dict[str, Column], weights: dict[str, float], renormalise: bool = False) -> Column:
    """The weighted sum over modalities; weights are made to add up to one over all that are supplied.

    A null part is skipped and keeps its weight, unless ``renormalise`` spreads it over the others.
    """
    total = sum(weights.get(k, 1.0) for k in parts) or 1.0
    shares = {k: weights.get(k, 1.0) / total for k in parts}
    value = sum((F.coalesce(v * shares[k], F.lit(0.0)) for k, v in parts.items()), F.lit(0.0))
    used = sum((F.when(v.isNotNull(), shares[k]).otherwise(0.0) for k, v in parts.items()), F.lit(0.0))
    value = value / used if renormalise else value
    return F.when(used > 0, value)


def merged_plausibility(
    tabular: Column, series: Column, tab_weight: float = 0.5, text: Column | None = None, base_weight: float = 1.0,
    text_weight: float = 1.0, how: str = "weighted_mean"
) -> Column:
    """Tabular and series plausibility by weight, then with the text's as a weighted sum or mean."""
    w = min(max(tab_weight, 0.0), 1.0)
    base = w * tabular + (1 - w) * series
    if text is None:
        return base
    both = base_weight * base + text_weight * text
    return both if how == "weighted_sum" else both / max(1e-8, base_weight + text_weight)


def baseline_tabular(factual: Column, candidate: Column) -> tuple[Column, Column]:
    """The baselines' own proximity (mean difference) and sparsity (number of changed features)."""
    return tabular_proximity(factual, candidate), F.aggregate(
        F.zip_with(factual, candidate, lambda x, y: (x != y).cast("double")), F.lit(0.0), lambda a, b: a + b
    )


def baseline_embedding(factual: Column, candidate: Column) -> tuple[Column, Column]:
    """The baselines' own proximity (1 - cosine) and sparsity (mean difference)."""
    size = norm(factual) * norm(candidate)
    return F.when(
        (norm(factual) < 1e-12) | (norm(candidate) < 1e-12), F.lit(1.0)
    ).otherwise(1 - dot(factual, candidate) / size), tabular_proximity(factual, candidate)


def baseline_series(factual: Column, candidate: Column) -> tuple[Column, Column]:
    """The baselines' own proximity (mean difference) and sparsity (share of channels that change on average)."""
    per = F.zip_with(factual, candidate, lambda x, y: _mean(F.zip_with(x, y, lambda p, q: F.abs(p - q))))
    return _mean(per), _mean(F.transform(per, lambda v: (v > 1e-6).cast("double")))
