"""Local outlier factor (Breunig et al., 2000) as neighbour search and three aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kept import written
from .search import knn

#: Keeps densities of coinciding points finite.
TINY = 1e-10


def neighbour_count(n: int, most: int = 20) -> int:
    return max(2, min(most, n - 1))


def neighbours(reference: DataFrame, k: int) -> DataFrame:
    """Each reference row's k nearest others, written: the search is the work, and its lists are read more than once."""
    return written(knn(reference, reference, k, exclude_self=True), "neighbours")


def fit(reference: DataFrame, k: int | None = None, own: DataFrame | None = None) -> DataFrame:
    """Each reference row's k-distance and local reachability density: (``sample_id``, ``value``, ``k_distance``, ``lrd``).

    ``own`` are the reference's ``neighbours``, where they are there already.
    """
    if own is None:
        own = neighbours(reference, k or neighbour_count(reference.count()))
    far = own.groupBy("query_id").agg(F.max("distance").alias("k_distance"))
    reach = own.join(
        far.select(F.col("query_id").alias("train_id"), "k_distance"), "train_id"
    ).groupBy("query_id").agg((1 / (F.avg(F.greatest("distance", "k_distance")) + TINY)).alias("lrd"))
    return reference.select("sample_id", "value").join(far, F.col("sample_id") == far.query_id).drop("query_id").join(
        reach, F.col("sample_id") == reach.query_id
    ).drop("query_id")


def score(fitted: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Each query's outlier factor against the reference: (``sample_id``, ``lof``); about 1 inside, more outside.

    A query that is itself a reference row counts as a new point, so it is its own nearest neighbour.
    """
    return _factors(knn(queries, fitted, k), fitted)


def score_reference(fitted: DataFrame, own: DataFrame, k: int) -> DataFrame:
    """``score`` of the reference rows as new points, from their ``neighbours``: a row itself is one more, at distance 0."""
    finite = F.coalesce(F.forall("value", lambda x: F.abs(x.cast("double")) < float("inf")), F.lit(False))  # NaN is the largest
    selves = fitted.where(finite).select(F.col("sample_id").alias("query_id"), F.col("sample_id").alias("train_id"), F.lit(0.0).alias("distance"))
    near = own.select("query_id", "train_id", "distance").unionByName(selves)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "train_id"))
    return _factors(near.withColumn("rank", rank).where(F.col("rank") <= k), fitted)


def _factors(near: DataFrame, fitted: DataFrame) -> DataFrame:
    near = near.join(fitted.select(F.col("sample_id").alias("train_id"), "k_distance", "lrd"), "train_id")
    sums = near.groupBy("query_id").agg((1 / (F.avg(F.greatest("distance", "k_distance")) + TINY)).alias("own"), F.avg("lrd").alias("around"))
    return sums.select(F.col("query_id").alias("sample_id"), (F.col("around") / F.col("own")).alias("lof"))


def bounds(scores: DataFrame, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """The quantiles between which plausibility is scaled: (``low``, ``high``)."""
    return scores.agg(F.percentile("lof", F.lit(low)).alias("low"), F.percentile("lof", F.lit(high)).alias("high"))


class Plausibility:
    """A fitted reference: plausibility of queries as raw factor, share of its range, or percentile among its own.

    ``reference`` has ``sample_id`` and ``value``; it is the target class, or all rows, as the caller filters it. With two
    rows or fewer there is no density, and the raw score is the least mean difference to any of them.
    """

    def __init__(self, reference: DataFrame, most: int = 20):
        self.reference, self.n = reference, reference.count()
        self.k = neighbour_count(self.n, most)
        self.own = neighbours(reference, self.k) if self.n > 2 else None
        self.fitted = written(fit(reference, self.k, self.own), "fitted") if self.n > 2 else None

    def raw(self, queries: DataFrame) -> DataFrame:
        """(``sample_id``, ``lof``)."""
        if self.fitted is not None:
            return score(self.fitted, queries, min(self.k, self.n))
        near = knn(queries, self.reference, 1, "manhattan")
        size = queries.select(F.col("sample_id").alias("query_id"), F.size("value").alias("d"))
        return near.join(size, "query_id").select(F.col("query_id").alias("sample_id"), (F.col("distance") / F.col("d")).alias("lof"))

    def scaled(self, queries: DataFrame, how: str = "unit") -> DataFrame:
        """(``sample_id``, ``plausibility``): ``unit`` scales between the 5th and 95th percentile, ``percentile`` ranks.

        Scores are ranked to 9 digits, so that a query equal to a reference row ranks as that row does.
        """
        from ..functions.scores import unit_interval, with_percentile_rank

        # No search for the reference's own factors: its neighbours are known.
        own = score_reference(self.fitted, self.own, min(self.k, self.n)) if self.fitted is not None else self.raw(self.reference)
        own, raw = written(own, "own"), written(self.raw(queries), "raw")  # both are read several times below
        if how == "percentile":
            own, raw = (df.withColumn("lof", F.round("lof", 9)) for df in (own, raw))
            return with_percentile_rank(raw, "lof", own, "lof", "plausibility").select("sample_id", "plausibility")
        low, high = bounds(own).first()
        return raw.select("sample_id", unit_interval(F.col("lof"), F.lit(low), F.lit(high)).alias("plausibility"))
