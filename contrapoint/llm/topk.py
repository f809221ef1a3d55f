"""Exact top-k by integer inner product: tiled matrix products, partial selection per tile, tree merge.

Queries and corpus are dealt to blocks of bounded bytes by a hash; a tile is one query block and one corpus shard, a
matrix product in bounded steps. A tile keeps each query's best k, and lists merge eight at a time.

Vectors that are null or hold null or non-finite components take no part, nor do rows without an id. Every corpus row is
a candidate of its own, also where ids repeat, but for those with the query's id; queries alike in id and vector are one,
others that share an id have a list each. Only vectors of equal length are compared. Ties go to the smaller id. A query
without candidates gives no rows; with fewer than k, all of them. Scores are exact: products that a double can't hold are
worked out in whole numbers, and those beyond 64 bits are reported as the nearest 64-bit value. An empty table gives an
empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a query block and of a corpus shard as doubles, rows and columns of one product, lists merged at a time.
BLOCK_BYTES, SHARD_BYTES, ROWS, STEP, FAN_IN = 1 << 23, 1 << 24, 1024, 2048, 8


def _usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    x = F.col(vector).cast("array<double>")
    rows = df.select(F.col(vec_id).cast("long").alias("id"), x.alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    return rows.where(F.forall(
        "v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    )).withColumn("key", F.xxhash64("id", "v"))


def _blocks(rows: DataFrame, most: int) -> int:
    return max(1, -(-8 * (rows.agg(F.sum(F.size("v"))).first()[0] or 0) // most))


def _stack(table: pa.Table, scale: float) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: the ids in order, the floor of each scaled component, and the rows' keys."""
    out, ids, keys = {}, table["id"].to_numpy(), table["key"].to_numpy()
    lists = table["v"].combine_chunks()
    lens, flat = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(lens)
    for n in np.unique(lens):
        rows = np.flatnonzero(lens == n)
        rows = rows[np.argsort(ids[rows], kind="stable")]
        out[int(n)] = ids[rows], np.floor(scale * flat[(ends[rows] - n)[:, None] + np.arange(n)]), keys[rows]
    return out


def _best(q: np.ndarray, qid: np.ndarray, c: np.ndarray, cid: np.ndarray, k: int):
    """For each query the k best (score, id) of a shard; shorter lists end in the mask's False."""
    exact = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * q.shape[1] < 2**49
    scores, ids, there = np.empty((len(q), 0), np.int64 if exact else object), np.empty((len(q), 0), np.int64), np.empty((len(q), 0), bool)
    big = [[int(x) for x in row] for row in q] if not exact else None
    for a in range(0, len(c), STEP):
        part, pid = c[a : a + STEP], cid[a : a + STEP]
        own = qid[:, None] == pid[None, :]
        if exact:
            s = (q @ part.T).astype(np.int64)
            key = np.where(own, np.iinfo(np.int64).min, s * STEP + (STEP - 1 - np.arange(len(pid))))
            top = np.argpartition(key, max(0, len(pid) - k), axis=1)[:, -k:]
        else:
            s = np.array(big, object) @ np.array([[int(x) for x in row] for row in part], object).T
            top = np.array([sorted(range(len(pid)), key=lambda j, r=r: (own[r, j], -s[r, j], j))[:k] for r in range(len(q))])
        scores = np.concatenate([scores, np.take_along_axis(s, top, 1)], 1)
        ids = np.concatenate([ids, pid[top]], 1)
        there = np.concatenate([there, ~np.take_along_axis(own, top, 1)], 1)
        keep = np.array(
            [sorted(range(scores.shape[1]), key=lambda j, r=r: (not there[r, j], -scores[r, j], ids[r, j]))[:k] for r in range(len(q))]
        ) if not exact else np.lexsort((ids, -scores, ~there), axis=1)[:, :k]
        scores, ids, there = (np.take_along_axis(x, keep, 1) for x in (scores, ids, there))
    if not exact:
        scores = np.array([[min(max(x, -(2**63)), 2**63 - 1) for x in row] for row in scores], np.int64)
    return scores, ids, there


def top_k(queries: DataFrame, corpus: DataFrame, k: int = 20, scale: float = 64.0, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(``query_id``, ``rank``, ``vec_id``, ``score``): each query's k best corpus rows but its own."""
    q, c = _usable(queries, vec_id, vector).distinct(), _usable(corpus, vec_id, vector)
    blocks, shards = _blocks(q, BLOCK_BYTES), _blocks(c, SHARD_BYTES)
    deal = lambda df, n, name, *key: df.withColumn(name, F.pmod(F.xxhash64(*key), F.lit(n)).cast("int"))
    q = deal(q, blocks, "b", "key").withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    # Rows alike are spread by their places, which only change who works on them.
    c = deal(c, shards, "s", "key", F.monotonically_increasing_id()).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    schema = "query_id long, key long, s int, best array<struct<neg:long,vec_id:long>>"

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[dict] = []
        if left.num_rows and right.num_rows:
            shard, own = left["s"][0].as_py(), _stack(right, scale)
            for n, (qid, qv, keys) in _stack(left, scale).items():
                for at in range(0, len(qid) if n in own else 0, ROWS):
                    part = slice(at, at + ROWS)
                    scores, ids, there = _best(qv[part], qid[part], own[n][1], own[n][0], k)
                    for i, key, s, d, ok in zip(qid[part].tolist(), keys[part].tolist(), scores.tolist(), ids.tolist(), there.tolist(), strict=True):
                        best = [{"neg": ~x, "vec_id": y} for x, y, z in zip(s, d, ok, strict=True) if z]
                        found.append({"query_id": i, "key": key, "s": shard, "best": best})
        best = pa.list_(pa.struct([("neg", pa.int64()), ("vec_id", pa.int64())]))
        return pa.Table.from_pylist(found, pa.schema([("query_id", pa.int64()), ("key", pa.int64()), ("s", pa.int32()), ("best", best)]))

    lists = q.groupBy("s", "b").cogroup(c.groupBy("s", "b")).applyInArrow(tile, schema)
    while shards > 1:
        shards = -(-shards // FAN_IN)
        merged = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best")
        lists = lists.groupBy("query_id", "key", F.expr(f"s DIV {FAN_IN}").cast("int").alias("s")).agg(merged)
    return lists.select("query_id", F.posexplode("best").alias("p", "e")).select(
        "query_id", (F.col("p") + 1).alias("rank"), "e.vec_id", F.expr("~e.neg").alias("score")
    )
