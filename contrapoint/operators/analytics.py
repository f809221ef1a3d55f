"""Aggregations over score tables: k curves, best configurations, pivots, fronts, and classifier metrics."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .preprocess import numbered

#: Rows of a block of a Pareto front.
FRONT_ROWS = 4096
OBJECTIVES = ("outcome", "proximity", "sparsity", "plausibility")


def finite(c: str | Column) -> Column:
    """The value, or null where it is not a finite number, so that means skip it."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def means(scores: DataFrame, keys: list[str], columns=OBJECTIVES) -> DataFrame:
    return scores.groupBy(*keys).agg(*[F.avg(finite(c)).alias(c) for c in columns])


def k_curve(scores: DataFrame, ks: list[int], keys=("generator",), columns=OBJECTIVES) -> DataFrame:
    """Means over each query's first k candidates for every k at once; ``n`` counts them."""
    spread = scores.withColumn("k", F.explode(F.filter(F.array(*[F.lit(k) for k in sorted(ks)]), lambda k: k >= F.col("cand_rank"))))
    return spread.groupBy("k", *keys).agg(*[F.avg(finite(c)).alias(c) for c in columns], F.count("*").alias("n"))


def mean_of_means(scores: DataFrame, inner: list[str], outer: list[str], columns=OBJECTIVES) -> DataFrame:
    """The unweighted mean over groups of their means."""
    return means(means(scores, inner, columns), outer, columns)


def candidate_counts(scores: DataFrame, keys=("generator",)) -> DataFrame:
    return scores.groupBy(*keys).agg(F.count("*").alias("n_candidates"))


def best_configs(scores: DataFrame, group: list[str], config: list[str], metric: str, higher: bool = False) -> DataFrame:
    """The configurations of the best mean in each group; ties are all kept."""
    mean = scores.groupBy(*group, *config).agg(F.avg(finite(metric)).alias(metric)).where(F.col(metric).isNotNull())
    order = F.col(metric).desc() if higher else F.col(metric).asc()
    return mean.withColumn("place", F.rank().over(Window.partitionBy(*group).orderBy(order))).where("place = 1").drop("place")


def pivot_means(scores: DataFrame, row: str, column: str, values: list[str], metric: str, digits: int = 4) -> DataFrame:
    """One row per ``row``, one column per listed value of ``column``, the rounded mean in each cell."""
    wide = scores.groupBy(row).pivot(column, values).agg(F.avg(finite(metric)))
    return wide.select(row, *[F.round(F.col(f"`{v}`"), digits).alias(v) for v in values])


def last_per_cell(scores: DataFrame, row: str, column: str, values: list[str], metric: str, order: str) -> DataFrame:
    """As ``pivot_means``, but the cell's last row by ``order``."""
    return scores.groupBy(row).pivot(column, values).agg(F.max_by(metric, order))


def summary(scores: DataFrame, keys: list[str], columns=OBJECTIVES, digits: int = 4) -> DataFrame:
    """Rounded mean and sample standard deviation of each column."""
    return scores.groupBy(*keys).agg(
        *[
            f(finite(c)).alias(f"{c}_{n}")
            for c in columns
            for n, f in (("mean", lambda x: F.round(F.avg(x), digits)), ("std", lambda x: F.round(F.stddev_samp(x), digits)))
        ]
    )


def pareto_front(points: DataFrame, columns: list[str], key: str) -> DataFrame:
    """The rows that no other row beats (as small everywhere and smaller somewhere); equal rows all stay.

    Rows with a null or NaN in ``columns`` take no part. Each partition first keeps its own front, the fronts of few
    partitions are joined and thinned again, and what is left is dealt to tiles of two blocks, each of which drops the
    rows that the other block beats. So no task holds more than two blocks, however long the front is.
    """
    distinct = points.select(*[F.col(c).cast("double").alias(c) for c in columns]).where(reduce(
        lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) for c in columns]
    )).distinct()

    def thinned(batches):
        held = np.empty((0, len(columns)))
        for batch in batches:
            held = _front(np.concatenate([held, batch.to_numpy(np.float64)]))
            if len(held) > FRONT_ROWS:
                yield pd.DataFrame(held, columns=columns)
                held = held[:0]
        yield pd.DataFrame(held, columns=columns)

    kept = distinct.mapInPandas(thinned, distinct.schema).repartition(8).mapInPandas(thinned, distinct.schema)
    kept = kept.withColumn("_i", F.xxhash64(*columns)).cache()  # fronts of partitions only
    blocks = max(1, -(-kept.count() // FRONT_ROWS))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    left = kept.withColumn("_a", F.pmod("_i", F.lit(blocks))).withColumn("_b", other)
    right = kept.withColumn("_b", F.pmod("_i", F.lit(blocks))).withColumn("_a", other)

    def beaten(x: pa.Table, y: pa.Table) -> pa.Table:
        a, b = (np.column_stack([t[c].to_numpy() for c in columns]) if t.num_rows else np.empty((0, len(columns))) for t in (x, y))
        return x.select(columns).filter(pa.array(_beaten(a, b), pa.bool_()))

    out = left.groupBy("_a", "_b").cogroup(right.groupBy("_a", "_b")).applyInArrow(beaten, distinct.schema)
    front = kept.join(out.distinct(), columns, "left_anti").select(*[F.col(c).alias(f"_f{i}") for i, c in enumerate(columns)])
    return points.join(front, reduce(lambda a, b: a & b, [F.col(c).cast("double") == F.col(f"_f{i}") for i, c in enumerate(columns)]), "left_semi")


def _beaten(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of ``a`` some row of ``b`` beats."""
    out = np.zeros(len(a), bool)
    for row in b[np.argsort(b.sum(1), kind="stable")]:
        rest = np.flatnonzero(~out)
        if not len(rest):
            break
        out[rest[(row <= a[rest]).all(1) & (row < a[rest]).any(1)]] = True
    return out


def _front(rows: np.ndarray) -> np.ndarray:
    """The rows that no other of them beats: in the order of their sums, each drops what it beats."""
    rows, at = rows[np.argsort(rows.sum(1), kind="stable")], 0
    while at < len(rows):
        row = rows[at]
        rows = rows[~((row <= rows).all(1) & (row < rows).any(1))]
        at += 1
    return rows


def running_sum(rows: DataFrame, keys: list[str], order: str, value: str, out: str, parts: int = 256) -> DataFrame:
    """``rows`` with ``out``, the sum of ``value`` up to each row's ``order`` (distinct numbers within ``keys``).

    Rows are cut into ranges at approximate quantiles; a window sums inside a range, and the ranges' totals are carried over.
    """
    cuts = F.percentile_approx(F.col(order).cast("double"), [i / parts for i in range(1, parts)], 1000).alias("_cuts")
    bounds = rows.groupBy(*keys).agg(cuts).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_cuts")
    same = lambda: reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.lit(True))
    names = [f"_k{i}" for i in range(len(keys))]
    rows = (rows.join(bounds, same()) if keys else rows.crossJoin(F.broadcast(bounds)))  # without keys one row
    rows = rows.withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col(order)))).drop("_cuts", *names)
    totals = rows.groupBy(*keys, "_part").agg(F.sum(value).alias("_t"))
    lower = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"),
        F.coalesce(F.sum("_t").over(lower), F.lit(0)).alias("_shift")
    )
    inside = F.sum(value).over(Window.partitionBy(*keys, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(out, inside).join(
        shifts, same() & (F.col("_part") == F.col("_p"))
    ).withColumn(out, F.col(out) + F.col("_shift")).drop("_part", "_p", "_shift", *names)


def coverage(runs: DataFrame) -> DataFrame:
    """``runs`` with candidates per sample and whether there are any at all."""
    return runs.withColumn("coverage", F.col("n_candidates") / F.col("n_samples")).withColumn(
        "coverage_flag", (F.col("n_candidates") > 0).cast("int")
    )


def runtime_per_sample(runs: DataFrame, keys: list[str]) -> DataFrame:
    """The mean of run time over the group's mean number of samples."""
    size = Window.partitionBy(*keys)
    return runs.withColumn("_n", F.avg("n_samples").over(size)).groupBy(*keys).agg(F.avg(F.col("runtime_sec") / F.col("_n")).alias("sec_per_sample"))


def flip_rate(patients: DataFrame, keys: list[str]) -> DataFrame:
    return patients.groupBy(*keys).agg(F.avg((F.col("n_feasible") > 0).cast("double")).alias("flip_rate"))


def config_label(parts: list[str], fallback: str) -> Column:
    """The present parts joined by slashes, or the fallback column if there are none."""
    label = F.concat_ws("/", *[F.col(p) for p in parts])
    return F.when(label == "", F.col(fallback)).otherwise(label)


def auroc(rows: DataFrame, keys: list[str] | None = None, score: str = "score", label: str = "label") -> DataFrame:
    """Area under the ROC curve from average ranks, so ties count half; null with one class only.

    Scores are counted before they are ranked, and distinct scores are summed in ranges. Rows without a score take no part.
    """
    keys = keys or []
    counts = rows.where(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.sum(F.col(label).cast("long")).alias("p"), F.count("*").alias("n"))
    ranked = running_sum(counts, keys, score, "n", "_upto").withColumn("rank", F.col("_upto") - (F.col("n") - 1) / 2)
    out = ranked.groupBy(*keys) if keys else ranked.groupBy()
    pos, neg = F.sum("p"), F.sum(F.col("n") - F.col("p"))
    area = (F.sum(F.col("rank") * F.col("p")) - pos * (pos + 1) / 2) / (pos * neg)
    return out.agg(F.when((pos > 0) & (neg > 0), area).alias("auroc"))


def auroc_in_order(rows: DataFrame, order: str, score: str = "score", label: str = "label") -> DataFrame:
    """The area under the ROC curve by trapezoids over single rows, the highest score first, equal scores in ``order``.

    Ties don't count half here: which of them comes first decides. Null with one class only.
    """
    cuts = rows.agg(F.percentile_approx(score, [i / 256 for i in range(1, 256)], 1000).alias("_cuts"))
    dealt = rows.where(F.col(score).isNotNull()).crossJoin(F.broadcast(cuts))  # one row
    placed = numbered(dealt, F.size(F.filter("_cuts", lambda c: c > F.col(score))), [F.desc(score), F.asc(order)], "_i")
    pos, all_ = F.sum(F.col(label).cast("long")), F.count("*")
    before = F.sum(F.col("_i") * F.col(label)) - pos * (pos - 1) / 2  # negatives before positives
    return placed.agg(F.when((pos > 0) & (all_ > pos), 1 - before / (pos * (all_ - pos))).alias("auroc"))


def auroc_ovr(rows: DataFrame, classes: list[int], score_array: str = "scores", label: str = "label") -> DataFrame:
    """The mean over classes of one-versus-rest areas."""
    each = rows.select(
        F.explode(F.arrays_zip(F.array(*[F.lit(c) for c in classes]).alias("cls"), F.col(score_array).alias("score"))).alias("z"),
        F.col(label).alias("y")
    )
    flat = each.select("z.cls", "z.score", (F.col("y") == F.col("z.cls")).cast("int").alias("label"))
    return auroc(flat, ["cls"]).agg(F.avg("auroc").alias("auroc"))


def class_report(rows: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Precision, recall, F1 and support by class; absent denominators give 0."""
    confusion = rows.groupBy(F.col(label).alias("y"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    both = confusion.select(
        F.explode(
            F.array(
                F.struct(F.col("y").alias("cls"), F.col("n").alias("real"), F.lit(0).cast("long").alias("said")),
                F.struct(F.col("p").alias("cls"), F.lit(0).cast("long").alias("real"), F.col("n").alias("said"))
            )
        ).alias("z"),
        (F.col("y") == F.col("p")).alias("hit")
    )
    sums = both.groupBy("z.cls").agg(
        F.sum("z.real").alias("support"), F.sum("z.said").alias("said"),
        F.sum(F.when(F.col("hit"), F.col("z.real")).otherwise(0)).alias("tp")
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = sums.withColumn("precision", ratio(F.col("tp"), F.col("said"))).withColumn("recall", ratio(F.col("tp"), F.col("support")))
    return out.select("cls", "precision", "recall", ratio(2.0 * F.col("tp"), F.col("said") + F.col("support")).alias("f1"), "support")


def macro_metrics(rows: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Macro F1 and accuracy."""
    report = class_report(rows, label, pred)
    return report.agg(F.avg("f1").alias("macro_f1"), (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("accuracy"))


def best_model(models: DataFrame, group: str = "strategy", metric: str = "macro_f1") -> DataFrame:
    """Each strategy's model of the highest metric, then the least name."""
    first = F.row_number().over(Window.partitionBy(group).orderBy(F.col(metric).desc(), "model"))
    return models.withColumn("_r", first).where("_r = 1").drop("_r")


def top_values(rows: DataFrame, values: Column, k: int, out: str = "value") -> DataFrame:
    """The k most frequent elements of an array column, ties in order of the element."""
    counts = rows.select(F.explode(values).alias(out)).groupBy(out).agg(F.count("*").alias("n"))
    return counts.orderBy(F.col("n").desc(), out).limit(k)
