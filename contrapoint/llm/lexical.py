"""Ranked lexical search: every document scored against every item by sorted accumulation.

Items are taken in blocks of bounded bytes; a block's terms go to all tasks. One Arrow pass over the documents finds the
block's terms in each of them and writes postings (document, length, terms, occurrences); the numbers of documents and
of terms, and each term's documents, come from there. A second pass over the postings concatenates the matched item,
document and impact arrays, sorts their packed keys by radix and sums equal keys with ``np.add.reduceat``. A task keeps
each item's best k and leaves out sums below them; what the tasks found is dealt by ranges of item and place, each range
selects its items' best k with a heap, and a window merges the ranges' lists.

A null text has no term; a document without an id counts in all statistics but is not returned. Documents that share an id
are documents of their own. Rows of items alike in id and text count once; those that share an id have a list each; an
item without a term, or whose terms no document holds, has none. Scores are whole numbers, ties go to the smaller
``doc_id``. An empty table gives an empty one.
"""

from __future__ import annotations

import heapq
import math
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, staged
from .words import words

#: Fixed values of the score.
UNIT, LENGTH_PERCENT, SATURATION, SCALE = 1000, 25, 12, 1_000_000_000
#: Bytes and items of a block of items; items of a step's sums.
BLOCK_BYTES, BLOCK_ITEMS, STEP = 1 << 22, 1 << 15, 1 << 21


def _strings(letters: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Words as an Arrow array, without copies."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(letters)])


class Block:
    """A block of items: its terms, and by term the items that hold it and how often."""

    def __init__(self, texts: list[str]):
        found, owners = [], []
        for letters, offsets, rows, _ in words(pa.array(texts, pa.large_string())):
            found.append(_strings(letters, offsets))
            owners.append(rows)
        coded = pa.chunked_array(found, pa.binary()).combine_chunks().dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        self.terms = coded.dictionary
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        keys, self.times = np.unique(codes * len(texts) + np.concatenate([*owners, np.empty(0, np.int64)]), return_counts=True)
        self.items, term = keys % max(1, len(texts)), keys // max(1, len(texts))
        self.degree = np.bincount(term, minlength=len(self.terms))
        self.first = np.cumsum(self.degree) - self.degree


def postings(docs: DataFrame, block: Block) -> DataFrame:
    """``doc_id``, ``n`` (terms with repeats), and of the block's terms the ``terms`` and ``times`` of every document."""
    values, size = block.terms, max(1, len(block.terms))

    def look_up(batches):
        for batch in batches:
            n, keys = np.zeros(batch.num_rows, np.int64), [np.empty(0, np.int64)]
            for letters, offsets, rows, _ in words(batch.column(1)):
                n += np.bincount(rows, minlength=len(n))
                place = pc.fill_null(pc.index_in(_strings(letters, offsets), value_set=values), -1).to_numpy()
                there = place >= 0
                keys.append(rows[there] * size + place[there])
            pairs, times = np.unique(np.concatenate(keys), return_counts=True)
            ends = np.searchsorted(pairs, np.arange(len(n) + 1) * size).astype(np.int32)
            columns = [pa.ListArray.from_arrays(ends, pa.array((x).astype(np.int32))) for x in (pairs % size, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *columns], ["doc_id", "n", "terms", "times"])

    rows = small_batches(docs).select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(look_up, "doc_id long, n long, terms array<int>, times array<int>")


def document_counts(found: DataFrame, terms: int) -> np.ndarray:
    """How many documents hold each of the block's terms, counted by partition first."""
    def count(batches):
        total = np.zeros(terms, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=terms)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "df"])

    out = np.zeros(terms, np.int64)
    sums = found.select("terms").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    for r in sums.collect():  # at most the block's terms
        out[r["term"]] = r["df"]
    return out


def radix_order(keys: np.ndarray, most: int) -> np.ndarray:
    """The stable order of whole numbers up to ``most``, by digits of 16 bits, which numpy sorts by radix."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    for shift in range(16, max(1, int(most).bit_length()), 16):
        digit = (keys >> shift).astype(np.uint16)
        order = order[np.argsort(digit[order], kind="stable")]
    return order


def _sums(block: Block, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, docs: int):
    """(item, document, score) of all matched pairs, in the order of items, then documents."""
    degree = block.degree[term]
    posting = np.repeat(np.arange(len(term)), degree)
    at = np.arange(len(posting)) - np.repeat(np.cumsum(degree) - degree, degree) + block.first[term][posting]
    keys = block.items[at] * docs + doc[posting]
    order = radix_order(keys, int(keys.max(initial=0)))
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    score = np.add.reduceat((impact[posting] * block.times[at])[order], first) if len(keys) else np.empty(0, np.int64)
    return keys[first] // docs, keys[first] % docs, score


def _best(item: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int):
    """Each item's k best, equal scores by id."""
    order = np.lexsort((ids, -score, item))
    item, ids, score = item[order], ids[order], score[order]
    keep = np.arange(len(item)) - np.searchsorted(item, item) < k
    return item[keep], ids[keep], score[keep]


def _scored(found: DataFrame, block: Block, items: int, weight: np.ndarray, documents: int, length: int, k: int) -> DataFrame:
    """``item`` (its number in the block), ``doc_id``, ``score``: the best k of each task."""
    def accumulate(batches):
        best = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        least = np.ones(items, np.int64)  # of an item's scores, those that can still be among its best
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column(0)))
            ids, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            term, tf = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in (2, 3))
            doc = np.repeat(np.arange(len(ids)), pc.list_value_length(batch.column(2)).to_numpy())
            m = 100 - LENGTH_PERCENT + LENGTH_PERCENT * n * documents // max(1, length)
            impact = weight[term] * (SCALE * tf // (UNIT * tf + SATURATION * m[doc]))
            matched = np.cumsum(block.degree[term])
            at = 0
            while at < len(term):  # whole documents of about STEP matches together
                to = int(np.searchsorted(matched, (matched[at - 1] if at else 0) + STEP, "right"))
                to = int(np.searchsorted(doc, doc[min(max(to, at + 1), len(term)) - 1], "right"))
                low = int(doc[at])
                item, own, score = _sums(block, doc[at:to] - low, term[at:to], impact[at:to], int(doc[to - 1]) - low + 1)
                high = score >= least[item]
                found = item[high], ids[own[high] + low], score[high]
                best = _best(*(np.concatenate(x) for x in zip(best, found, strict=True)), k)
                last = np.searchsorted(best[0], np.arange(items), "right")
                full = last - np.searchsorted(best[0], np.arange(items)) == k
                least[full] = best[2][last[full] - 1]
                at = to
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in best], ["item", "doc_id", "score"])

    return found.select("doc_id", "n", "terms", "times").mapInArrow(accumulate, "item long, doc_id long, score long")


def _select(k: int):
    """Of each item of a range the best k, with a heap."""
    def select(batches):
        heaps: dict[int, list] = {}
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("item", "score", "doc_id")), strict=True)
            for item, own in groupby(rows, key=lambda r: r[0]):
                heaps[item] = heapq.nsmallest(k, heaps.get(item, []) + [(-s, d) for _, s, d in own])
        out = [(item, d, -s) for item, heap in heaps.items() for s, d in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], ["item", "doc_id", "score"])

    return select


def top_documents(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id`` and ``score``: each item's k best documents with a score above 0."""
    spark = docs.sparkSession
    items = staged(items.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).distinct(), "items")
    size, many = items.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    blocks = max(1, -(-(size or 0) // BLOCK_BYTES), -(-many // BLOCK_ITEMS))
    block_of = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    out = None
    for b in range(blocks):
        rows = items.where(block_of == b).collect()  # about BLOCK_BYTES of text
        block = Block([r["text"] for r in rows])
        found = staged(postings(docs, block), "postings")
        documents, length = found.where("n > 0").agg(F.count("*"), F.sum("n")).first()
        df = document_counts(found, len(block.terms))
        weight = np.array([math.floor(UNIT * math.log((2 * documents + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        lists = _scored(found, block, len(rows), weight, documents, length or 0, k)
        lists = staged(lists.withColumn("place", F.monotonically_increasing_id()), "lists")  # ranges are sampled first
        lists = lists.repartitionByRange("item", "place").mapInArrow(_select(k), "item long, doc_id long, score long")
        order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
        best = lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], "item long, item_id long")
        best = best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # a block's items
        out = best if out is None else out.unionByName(best)
    return out
