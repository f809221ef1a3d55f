"""Importance resampling towards a target distribution over hashed word runs.

Features are all runs of 1 to 3 words, hashed to ``BUCKETS`` buckets by CRC-32. The first Arrow pass counts a partition's
features with ``np.bincount``, one vector a partition, and ``treeReduce`` merges the vectors of the corpus and of the
target. A bucket's gain is a smoothed log-ratio of both; gains are one short vector, which goes to all tasks. The second
pass gathers each document's gains and sums them with ``np.bincount`` weights. A Gumbel draw by a hash of the id then
turns the highest scores into a weighted sample without replacement.

The CRC of a run is combined from those of its words: that of A followed by B is that of A moved on by B's length, which
is linear in its bits (four lookups), plus that of B.

A null text has no words and a weight of 0; a null id is drawn by the hash of an empty one. Rows that repeat are documents
of their own and are ranked one after the other. Documents of fewer than ``least_words`` words are not drawn. Rank comes
from range partitions and their counts, so no task sorts more than its range. An empty table gives an empty one.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, staged
from .words import words

#: Fixed values of the scores: buckets, words of a run, the unit of gains.
BUCKETS, RUN, UNIT = 10000, 3, 1000
#: Words of at most so many bytes have their CRC by table; documents of a range.
SHORT, RANGE = 64, 50_000


def _moved_on(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By lengths up to ``SHORT`` + 1 and by powers of two, how a CRC moves on; a byte's part of a CRC by its place from the end."""
    basis = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    one = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
    lengths = [basis]
    for _ in range(SHORT + 1):
        lengths.append((lengths[-1] >> 8) ^ one[lengths[-1] & 255])
    powers = [lengths[1]]
    for _ in range(32):
        powers.append(_moved_on(powers[-1], powers[-1]))
    parts = [one]
    for _ in range(SHORT - 1):
        parts.append((parts[-1] >> 8) ^ one[parts[-1] & 255])
    return np.array(lengths), np.array(powers), np.array(parts)


_LENGTHS, _POWERS, _PARTS = _tables()
_NOTHING = np.array([zlib.crc32(b"\0" * n) for n in range(SHORT + 1)], np.uint32)


def move_on(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The CRCs' parts of the CRCs of their bytes and ``length`` more."""
    near = np.minimum(length, SHORT + 1)
    flat, base = _LENGTHS.reshape(-1), near.astype(np.int64) * 1024
    out = flat[base + (crc & 255)]
    for k in (1, 2, 3):
        out ^= flat[base + 256 * k + ((crc >> np.uint32(8 * k)) & 255)]
    far = np.flatnonzero(length > SHORT + 1)
    if len(far):
        c, n = crc[far], length[far]
        for j in range(int(n.max()).bit_length()):
            on = (n >> j) & 1 == 1
            c[on] = _moved_on(_POWERS[j], c[on])
        out[far] = c
    return out


def word_crcs(letters: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """CRC-32 of each word."""
    if len(offsets) < 2:
        return np.empty(0, np.uint32)
    lengths = np.diff(offsets)
    from_end = np.repeat(offsets[1:] - 1, lengths) - np.arange(len(letters))
    parts = _PARTS.reshape(-1)[np.minimum(from_end, SHORT - 1) * 256 + letters]
    out = np.bitwise_xor.reduceat(parts, offsets[:-1]) ^ _NOTHING[np.minimum(lengths, SHORT)]
    for i in np.flatnonzero(lengths > SHORT):
        out[i] = zlib.crc32(letters[offsets[i] : offsets[i + 1]])
    return out


def features(texts: pa.ChunkedArray):
    """(buckets, rows, words' rows) of the texts' runs, a step at a time."""
    space = np.uint32(zlib.crc32(b" "))
    for letters, offsets, rows, old in words(texts, carry=RUN - 1):
        lengths, crc = np.diff(offsets), word_crcs(letters, offsets)
        spaced = move_on(np.full(len(crc), space, np.uint32), lengths) ^ crc
        run, buckets, owners = crc, [crc[old:] % BUCKETS], [rows[old:]]
        for n in range(1, RUN):
            run = move_on(run[:-1], lengths[n:] + 1) ^ spaced[n:]  # the run that ends at word n, n + 1, ...
            whole = (rows[n:] == rows[: len(run)]) & (np.arange(n, n + len(run)) >= old)
            buckets.append(run[whole] % BUCKETS)
            owners.append(rows[n:][whole])
        yield np.concatenate(buckets), np.concatenate(owners), rows[old:]


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """How many features of all ``docs`` fall into each bucket: a vector for each partition, merged in a tree."""
    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for found, _, _ in features(batch.column(0)):
                total += np.bincount(found, minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["counts"])

    vectors = small_batches(docs).select("text").mapInArrow(count, "counts binary").rdd.map(lambda r: np.frombuffer(bytes(r[0]), np.int64))
    zero = docs.sparkSession.sparkContext.parallelize([np.zeros(BUCKETS, np.int64)], 1)  # an empty table has no partitions
    return vectors.union(zero).treeReduce(np.add, depth=3)


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain in whole units, rounded down."""
    s, t = float(corpus.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    return np.array([math.floor(UNIT * math.log((float(y) + 1) * s / ((float(x) + 1) * t))) for x, y in zip(corpus, target, strict=True)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features`` and ``weight``, the sum of its features' gains, of every document."""
    def weigh(batches):
        for batch in batches:
            n = batch.num_rows
            total, many, count = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for found, rows, own in features(batch.column(1)):
                total += np.bincount(rows, weights=gain[found], minlength=n)
                many += np.bincount(rows, minlength=n)
                count += np.bincount(own, minlength=n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count), pa.array(many), pa.array(total.astype(np.int64))], ["doc_id", "n_words", "n_features", "weight"])

    ids = small_batches(docs).select(F.col("doc_id").cast("long"), "text")
    return ids.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, seed: int = 42, least_words: int = 20) -> DataFrame:
    """``doc_id``, ``n_features``, ``weight``, ``score`` and ``rank`` of every document; undrawn ones have no rank."""
    gain = gains(bucket_counts(docs), bucket_counts(target))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    gumbel = F.floor(-UNIT * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0)))
    rows = weights(docs, gain).withColumn("score", F.col("weight") + gumbel)
    rows = staged(rows.withColumn("number", F.monotonically_increasing_id()), "scores")
    able = rows.where(F.col("n_words") >= least_words)
    n, cut = able.agg(F.count("*"), F.percentile_approx("score", 1 - (percent + 1) / 100, 10_000)).first()
    wanted = percent * n // 100
    out = ["doc_id", "n_features", "weight", "score"]
    if not wanted:
        return rows.select(*out, F.lit(None).cast("long").alias("rank"))
    high = able.where(F.col("score") >= cut)
    if high.count() < wanted:  # the quantile is approximate
        high = able
    drawn = staged(ranked(high, [F.desc("score"), F.asc("doc_id"), F.asc("number")], 1 + percent * n // 100 // RANGE).where(F.col("rank") <= wanted), "drawn")
    last = drawn.where(F.col("rank") == wanted).select("score", "doc_id", "number").first()
    # Drawn are the rows up to the last one in the order of score, id and number.
    key = F.struct((-F.col("score")).alias("score"), "doc_id", "number")
    end = F.struct(*[F.lit(x).cast("long").alias(c) for x, c in ((-last.score, "score"), (last.doc_id, "doc_id"), (last.number, "number"))])
    rest = rows.where((F.col("n_words") < least_words) | (key > end)).select(*out, F.lit(None).cast("long").alias("rank"))
    return drawn.select(*out, "rank").unionByName(rest)


def ranked(rows: DataFrame, order: list, parts: int) -> DataFrame:
    """``rows`` with ``rank`` (1, 2, 3...) in a total ``order``: sorted within range partitions, after the rows of those before."""
    dealt = staged(rows.repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id()), "ranges")
    own = dealt.withColumn("own", F.row_number().over(Window.partitionBy("range").orderBy(*order)))
    sizes = dealt.groupBy("range").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)))
    before = F.broadcast(before.select("range", F.coalesce("before", F.lit(0)).alias("before")))  # one row a range
    return own.join(before, "range").withColumn("rank", F.col("before") + F.col("own")).drop("range", "own", "before")
