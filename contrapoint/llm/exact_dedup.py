"""Exact duplicates by two passes of Bloom filters, with DataFrame functions only.

Texts are equal when they are identical after lower-casing A-Z. A Bloom filter holds one bit for each place on which at
least two rows' hashes fell; every copy has such a place, and few other rows do. The first pass makes the filter of all
rows, the second one with another hash of the rows that the first let through. Only rows that both filters let through
are shuffled by their digest and grouped; the rest are known to stand alone and pass straight through. A row is its
digest, its id and its number from then on, so no text moves.

A filter is a table of 64-bit words sized from the rows' count. One of at most ``MOST_WORDS`` words is broadcast; a larger
one is joined by shuffles, words of more than a thousandth of the rows (under a thousand words) apart from the others.
Groups of copies are counted with partial sums, and those of more than a thousandth of the rows, which are under a
thousand too, are broadcast to their rows, so no task holds a hot group.

A null text counts as empty. Of equal texts the row with the largest ``doc_id`` stays; a null id is the smallest, and of
rows with the same id exactly one stays. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, staged

#: Places of a filter for each row, words that are broadcast, and the part of all rows that makes a word or a group hot.
PLACES, MOST_WORDS, HOT = 16, 1 << 21, 1e-3


def digest(text: Column) -> Column:
    """SHA-256 of a text after lower-casing A-Z."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)
    return F.unhex(F.sha2(F.when(ascii_only, F.lower(text)).otherwise(ascii_lower(text)), 256))


def _place(seed: int, bits: int) -> Column:
    return F.xxhash64("digest", F.lit(seed)).bitwiseAND(F.lit(bits - 1))


def _filter(rows: DataFrame, seed: int) -> tuple[int, int, DataFrame, int]:
    """A filter of ``rows``: its seed, its number of places, its words (``w``, ``b``, ``rows``) and their number."""
    bits = 1 << max(10, (PLACES * rows.count() - 1).bit_length())
    hits = rows.groupBy(_place(seed, bits).alias("p")).agg(F.count("*").alias("n")).where("n > 1")
    bit = F.expr("bit_or(shiftleft(1L, cast(p & 63 AS int)))")
    words = staged(hits.groupBy(F.shiftright("p", 6).alias("w")).agg(bit.alias("b"), F.sum("n").alias("rows")), "bloom")
    return seed, bits, words, words.count()


def _flagged(rows: DataFrame, filters: list, total: int) -> DataFrame:
    """``rows`` with ``hit``: whether every filter lets the row through."""
    columns = [F.col(c) for c in rows.columns]
    for i, (seed, bits, words, n) in enumerate(filters):
        rows = rows.withColumn("p", _place(seed, bits)).withColumn("w", F.shiftright("p", 6))
        set_there = F.coalesce(F.expr("shiftright(b, cast(p & 63 AS int)) & 1 = 1"), F.lit(False))
        if n <= MOST_WORDS:
            rows = rows.join(F.broadcast(words.select("w", "b")), "w", "left").withColumn(f"hit{i}", set_there)
        else:
            hot = words.where(F.col("rows") > HOT * total).select("w", F.lit(True).alias("hot"))
            rows = rows.join(F.broadcast(hot), "w", "left")  # under 1 / HOT words
            rest = rows.where("hot IS NULL").join(words.select("w", "b"), "w", "left").withColumn(f"hit{i}", set_there)
            rows = rest.drop("b").unionByName(rows.where("hot").withColumn(f"hit{i}", F.lit(True))).withColumn("b", F.lit(None)).drop("hot")
        rows = rows.select(*columns, *[f"hit{j}" for j in range(i + 1)])
    return rows.select(*columns, F.expr(" AND ".join(f"hit{i}" for i in range(len(filters)))).alias("hit"))


def _filters(rows: DataFrame, total: int) -> list:
    first = _filter(rows, 1)
    through = staged(_flagged(rows, [first], total).where("hit").drop("hit"), "through")
    return [first, _filter(through, 2)]


def _numbered(docs: DataFrame, *extra: Column) -> DataFrame:
    return staged(docs.select(F.monotonically_increasing_id().alias("number"), "doc_id", digest(F.col("text")).alias("digest"), *extra), "digests")


def _resolved(maybe: DataFrame, total: int) -> DataFrame:
    """``maybe`` with each row's group: ``keep_id``, ``group_size`` and the ``first`` row's number."""
    groups = staged(maybe.groupBy("digest").agg(
        F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"), F.max(F.struct("doc_id", "number")).alias("last")
    ).select("digest", "keep_id", "group_size", F.col("last.number").alias("first")), "groups")
    hot = groups.where(F.col("group_size") > HOT * total)
    cold = maybe.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(groups, "digest")
    return maybe.join(F.broadcast(hot), "digest").unionByName(cold)  # under 1 / HOT groups


def duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` of every row of ``docs``."""
    rows = _numbered(docs)
    total = rows.count()
    flagged = _flagged(rows, _filters(rows, total), total)
    found = _resolved(flagged.where("hit").drop("hit"), total).select(
        "doc_id", "keep_id", "group_size", (F.col("number") == F.col("first")).alias("kept"), "digest"
    )
    alone = flagged.where("NOT hit").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    return found.unionByName(alone).withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; whole rows move only where both filters let them through."""
    rows = _numbered(docs, F.struct(*docs.columns).alias("doc"))
    slim = rows.drop("doc")
    total = slim.count()
    filters = _filters(slim, total)
    found = _resolved(_flagged(slim, filters, total).where("hit").drop("hit"), total)
    gone = staged(found.where("number <> first").select("number"), "copies")
    flagged = _flagged(rows, filters, total)
    stay = flagged.where("hit").join(gone, "number", "left_anti")
    return flagged.where("NOT hit").select("doc.*").unionByName(stay.select("doc.*"))
