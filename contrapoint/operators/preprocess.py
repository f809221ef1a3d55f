"""Feature preparation: encoding, scaling, imputation, splits and weights, all fitted by aggregation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .search import knn


def draw(*parts) -> Column:
    """A whole number from 0 to 2 ** 32 - 1, drawn from the parts' text by MD5; the same in any engine."""
    key = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def numbered(rows: DataFrame, bucket: Column, order: list, out: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``out``, their numbers from 0 within ``keys`` in the order of ``bucket``, then ``order``.

    Rows are numbered inside each bucket and shifted by the counts of the lower ones, so no window holds more than a
    bucket, and the window over buckets holds one row of each.
    """
    rows = rows.withColumn("_bucket", bucket)
    counts = rows.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    lower = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_shift")
    )
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.col("_bucket").eqNullSafe(F.col("_b")))
    inside = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)) - 1
    return rows.withColumn(out, inside).join(shifts, same).withColumn(out, (F.col(out) + F.col("_shift")).cast("long")).drop(
        "_bucket", "_b", "_shift", *[f"_k{i}" for i in range(len(keys))]
    )


def missing_share(df: DataFrame) -> DataFrame:
    """(``name``, ``missing``, ``n_distinct``) for every column, in one pass."""
    row = df.agg(
        *[
            F.struct(
                F.lit(c).alias("name"), F.avg(F.col(c).isNull().cast("double")).alias("missing"),
                F.count_distinct(F.col(c)).alias("n_distinct")
            ).alias(c)
            for c in df.columns
        ]
    )
    return row.select(F.explode(F.array(*[F.col(f"`{c}`") for c in df.columns])).alias("z")).select("z.*")


def drop_sparse(df: DataFrame, most_missing: float, constant: bool = True, also: tuple[str, ...] = ()) -> DataFrame:
    """Without columns that miss more than a share of values, are constant, or are listed."""
    stats = missing_share(df).collect()  # one row per column
    gone = {r.name for r in stats if r.missing > most_missing or (constant and r.n_distinct <= 1)} | set(also)
    return df.drop(*gone)


def date_parts(ts: Column) -> list[Column]:
    """Hour, day of week from Monday = 0, and month."""
    return [F.hour(ts).alias("hour"), F.weekday(ts).alias("weekday"), F.month(ts).alias("month")]


def split_location(location: Column) -> list[Column]:
    """Country, state and city of a comma-joined location; missing or empty parts are null."""
    parts = F.split(location, ",")
    return [F.nullif(F.trim(F.get(parts, F.lit(i))), F.lit("")).alias(n) for i, n in enumerate(("country", "state", "city"))]


def salary_midpoint(salary: Column) -> Column:
    """The mean of a low-high range, or the one number; null if it is neither."""
    parts = F.transform(F.split(salary, "-"), lambda p: F.try_to_number(F.trim(p), F.lit("999999999999")).cast("double"))
    return F.when((F.size(parts) <= 2) & ~F.exists(parts, F.isnull), F.aggregate(parts, F.lit(0.0), lambda a, b: a + b) / F.size(parts))


def fill_median(df: DataFrame, column: str, train: Column) -> DataFrame:
    """``column`` with the training rows' median for nulls."""
    middle = df.where(train).agg(F.median(column).alias("_m"))
    return df.crossJoin(F.broadcast(middle)).withColumn(column, F.coalesce(column, "_m")).drop("_m")  # one row


def ordinal_codes(df: DataFrame, column: str, train: Column, out: str) -> DataFrame:
    """Codes of the training rows' values in alphabetical order; unknown values and nulls are -1."""
    values = df.where(train & F.col(column).isNotNull()).select(F.col(column).alias("_v")).distinct()
    codes = numbered(
        values, F.substring(F.col("_v").cast("string"), 1, 2) if dict(df.dtypes)[column] == "string" else F.lit(0), ["_v"], out
    ).withColumn(out, F.col(out).cast("int"))
    return df.join(codes, F.col(column) == F.col("_v"), "left").drop("_v").withColumn(out, F.coalesce(out, F.lit(-1)))


def standard_scale(df: DataFrame, columns: list[str], train: Column) -> DataFrame:
    """Columns less the training mean over the training population deviation; a constant is only centred."""
    stats = df.where(train).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    out = df.crossJoin(F.broadcast(stats))  # one row
    scaled = [
        ((F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0)).alias(c) if c in columns else F.col(c)
        for c in df.columns
    ]
    return out.select(*scaled)


def knn_impute(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """Nulls replaced by the mean over the k nearest rows that have the value; the column mean if none can be compared.

    Distance is euclidean over the columns both rows have, scaled up for the missing ones.
    """
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))
    filled = []
    for c in columns if len(columns) > 1 else []:  # a column's own value is on one side alone, so the others tell the distance
        rows = df.select("sample_id", F.array(*[number(x) for x in columns if x != c]).alias("value"), F.isnan(number(c)).alias("gone"))
        near = knn(rows.where("gone"), rows.where("NOT gone"), k, "nan_euclidean", size=len(columns))
        values = df.select(F.col("sample_id").alias("train_id"), F.col(c).alias("_v"))
        filled.append(near.join(values, "train_id").groupBy(F.col("query_id").alias("sample_id")).agg(F.avg("_v").alias(f"_f_{c}")))
    means = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])
    out = reduce(lambda a, b: a.join(b, "sample_id", "left"), filled, df).crossJoin(F.broadcast(means))  # one row
    return out.select(*[F.coalesce(F.col(c).cast("double"), f"_f_{c}", f"_m_{c}").alias(c) if c in columns else F.col(c) for c in df.columns])


def stratified_split(df: DataFrame, label: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """A ``split`` column: in every class the share of rows with the least seeded hashes is the test set.

    A class is ranked in buckets of its hashes, so a large one is no single task.
    """
    hashed = df.withColumn("_hash", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("sample_id").cast("string"))))
    ranked = numbered(hashed, F.substring("_hash", 1, 3), ["_hash", "sample_id"], "_place", (label,))
    sizes = df.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_size"))
    test = F.col("_place") < F.lit(test_share) * (F.col("_size") - 1)
    return ranked.join(sizes, F.col(label).eqNullSafe(F.col("_label"))).withColumn(
        "split", F.when(test | (F.col("_size") == 1), "test").otherwise("train")
    ).select(*df.columns, "split")


def balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Each row's weight: rows / (classes x rows of its class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    totals = counts.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))
    return df.join(counts, label).crossJoin(F.broadcast(totals)).withColumn(
        out, F.col("_all") / (F.col("_k") * F.col("_n"))
    ).drop("_n", "_all", "_k")  # one row


def feature_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """(``name``, ``kind``): categorical if a column holds only 0 and 1, else continuous."""
    row = df.agg(*[F.struct(F.lit(c).alias("name"), F.bool_and(F.col(c).isin(0, 1)).alias("binary")).alias(c) for c in columns])
    flat = row.select(F.explode(F.array(*[F.col(f"`{c}`") for c in columns])).alias("z")).select("z.*")
    return flat.select("name", F.when(F.col("binary"), "categorical").otherwise("continuous").alias("kind"))


def late_fusion(branches: list[Column]) -> Column:
    """The mean of branch probability arrays."""
    total = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), branches)
    return F.transform(total, lambda x: x / len(branches))


def mad_threshold(series: DataFrame, factor: float = 0.0) -> DataFrame:
    """(``channel``, ``tau``): factor times the median absolute deviation of each channel over all rows and steps."""
    values = series.select(F.posexplode("value").alias("channel", "ch")).select("channel", F.explode("ch").alias("v"))
    middle = values.groupBy("channel").agg(F.median("v").alias("m"))
    return values.join(middle, "channel").groupBy("channel").agg((F.median(F.abs(F.col("v") - F.col("m"))) * factor).alias("tau"))


def proximity_pairs(rows: DataFrame, per_row: int = 1, cross_class: bool = True, seed: int = 7) -> DataFrame:
    """Mean differences of sampled pairs: (``distance``). Each row meets ``per_row`` rows at seeded shifts of a hash order.

    Rows are numbered within hash buckets, so pairing is an equi-join; with labels, pairs of one class are left out.
    """
    from ..functions.scores import tabular_proximity

    bucket = F.pmod(F.xxhash64(F.lit(seed), "sample_id"), F.lit(64))
    w = Window.partitionBy("bucket").orderBy(F.xxhash64(F.lit(seed + 1), "sample_id"))
    numbered = rows.withColumn("bucket", bucket).withColumn("i", F.row_number().over(w)).withColumn(
        "n", F.count("*").over(Window.partitionBy("bucket"))
    )
    left = numbered.withColumn(
        "shift", F.explode(F.sequence(F.lit(1), F.lit(per_row)))
    ).withColumn("j", (F.col("i") + F.col("shift") - 1) % F.col("n") + 1)
    right = numbered.select(
        "bucket", F.col("i").alias("j"), F.col("value").alias("other"), F.col("label").alias("other_label"),
        F.col("sample_id").alias("other_id")
    )
    pairs = left.join(right, ["bucket", "j"]).where("sample_id <> other_id")
    pairs = pairs.where("label <> other_label") if cross_class else pairs
    return pairs.select(tabular_proximity(F.col("value"), F.col("other")).alias("distance"))
