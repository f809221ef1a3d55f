"""Combining neighbour lists of several spaces, and candidates from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import column_medians


def union_spaces(lists: dict[str, DataFrame]) -> DataFrame:
    """One frame of neighbours with a ``space`` column."""
    return reduce(DataFrame.unionByName, [df.withColumn("space", F.lit(name)) for name, df in lists.items()])


def consensus(lists: dict[str, DataFrame], k: int) -> DataFrame:
    """Training rows that every space lists for a query, by the sum of their distances, then id.

    One shuffle: the union is grouped by query and training row. Distances are summed as they are.
    """
    summed = union_spaces(lists).groupBy("query_id", "train_id").agg(F.sum("distance").alias("distance"), F.count("*").alias("n"))
    ranked = summed.where(F.col("n") == len(lists)).withColumn(
        "rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "train_id"))
    )
    return ranked.where(F.col("rank") <= k).select("query_id", "train_id", "rank", "distance")


def gathered(neighbours: DataFrame, rows: DataFrame) -> DataFrame:
    """Each query's neighbours' vectors in rank order: (``query_id``, ``n``, ``ids``, ``rows``). At most k per query."""
    joined = neighbours.join(rows.select(F.col("sample_id").alias("train_id"), "value"), "train_id")
    packed = F.array_sort(F.collect_list(F.struct("rank", "train_id", "value")))
    return joined.groupBy("query_id").agg(packed.alias("all")).select(
        "query_id", F.size("all").alias("n"), F.col("all.train_id").alias("ids"), F.col("all.value").alias("rows")
    )


def _prefix(i: Column, n: Column, step: str) -> Column:
    if step not in ("odd", "step"):
        raise ValueError("step is odd or step")
    return F.least(2 * i - 1, n) if step == "odd" else i


def progressive_medians(neighbours: DataFrame, rows: DataFrame, step: str = "odd", anchor: str = "rank") -> DataFrame:
    """Candidate i: the coordinate-wise median of the first 2i - 1 (``odd``) or i (``step``) neighbours.

    Rows: ``query_id``, ``cand_rank``, ``n_used``, ``anchor_id``, ``value``. The anchor, for parts that have no median, is
    the neighbour of rank i, or of the prefix's last rank with ``anchor='odd'``. One shuffle gathers a query's at most k
    vectors; medians are taken inside the JVM.
    """
    each = gathered(neighbours, rows).withColumn("cand_rank", F.explode(F.sequence(F.lit(1), F.col("n"))))
    used = _prefix(F.col("cand_rank"), F.col("n"), step)
    at = F.col("cand_rank") if anchor == "rank" else F.least(2 * F.col("cand_rank") - 1, F.col("n"))
    each = each.withColumn("n_used", used).withColumn("anchor_id", F.get("ids", at - 1))
    return each.select(
        "query_id", "cand_rank", "n_used", "anchor_id",
        column_medians(F.slice("rows", 1, F.col("n_used")), F.size(F.get("rows", F.lit(0)))).alias("value")
    )


def progressive_series_medians(neighbours: DataFrame, rows: DataFrame, step: str = "odd") -> DataFrame:
    """The same for channel-major series: medians of each channel and step."""
    flat = rows.select("sample_id", F.flatten("value").alias("value"), F.size("value").alias("channels"))
    steps = flat.select(F.col("sample_id").alias("anchor_id"), "channels")
    out = progressive_medians(neighbours, flat, step).join(steps, "anchor_id")
    width = (F.size("value") / F.col("channels")).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.col("channels") - 1), lambda c: F.slice(F.col("value"), c * width + 1, width))
    return out.select("query_id", "cand_rank", "n_used", "anchor_id", cut.alias("value"))


def synthesis(numeric: dict[str, tuple[DataFrame, DataFrame]], anchored: dict[str, DataFrame], k: int) -> DataFrame:
    """Candidate i joins each numeric branch's median of its first i neighbours with the others' i-th neighbour.

    ``numeric`` maps a branch to its neighbours and rows, ``anchored`` a text or image branch to its neighbours. A query
    has as many candidates as its shortest list, at most k; a branch without neighbours leaves none. Rows: ``query_id``,
    ``cand_rank``, ``num`` (branch -> vector), ``anchors`` (branch -> training id).
    """
    keys = ["query_id", "cand_rank"]
    frames = [
        progressive_medians(n, rows, "step").where(F.col("cand_rank") <= k).select(
            *keys, F.col("value").alias(f"num_{b}"), F.col("anchor_id").alias(f"id_{b}")
        )
        for b, (n, rows) in numeric.items()
    ]
    frames += [
        n.where(F.col("rank") <= k).select("query_id", F.col("rank").alias("cand_rank"), F.col("train_id").alias(f"id_{b}"))
        for b, n in anchored.items()
    ]
    joined = reduce(lambda a, b: a.join(b, keys), frames)
    num = F.create_map(*[
        x
        for b in numeric
        for x in (F.lit(b), F.col(f"num_{b}"))
    ]) if numeric else F.expr("CAST(map() AS map<string,array<double>>)")
    return joined.select(
        *keys, num.alias("num"), F.create_map(*[x for b in (*numeric, *anchored) for x in (F.lit(b), F.col(f"id_{b}"))]).alias("anchors")
    )


def early_fusion(branches: list[DataFrame]) -> DataFrame:
    """Branch vectors (``sample_id``, ``value``) joined and concatenated in the given order."""
    named = [b.select("sample_id", F.col("value").alias(f"v{i}")) for i, b in enumerate(branches)]
    joined = reduce(lambda a, b: a.join(b, "sample_id"), named)
    return joined.select("sample_id", F.concat(*[f"v{i}" for i in range(len(branches))]).alias("value"))


def with_anchor_texts(candidates: DataFrame, texts: DataFrame, out: str = "text") -> DataFrame:
    """Candidates with the text of their anchor."""
    return candidates.join(texts.select(F.col("sample_id").alias("anchor_id"), F.col("text").alias(out)), "anchor_id", "left")
