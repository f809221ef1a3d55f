"""Embedding near-duplicates by spherical-cap filters with product codes.

A filter direction joins one code word for each half of the vector, so there are ``codewords`` squared of them. Each
vector is assigned its nearest direction, found by halves, and has a cap there as wide as its own angle to it plus the
angle of the threshold. By the triangle inequality its partners all lie in that cap. The rows of a label are dealt to
square tiles of two blocks; in a tile, one block's vectors are decoded to the caps of the other's, and what they hold is
verified by cosine in double precision. A row goes to as many tiles as its label has blocks, and decoded vectors are
never moved or written.

Equal vectors of a label are one class, compared once and counted as often as they occur. Tiles return counts and
component labels, never pairs. Vectors that are null, empty, zero or hold null
or non-finite components, and rows without label or id, link with nothing; vectors of unlike length never link. Rows that
repeat an id count as vectors of their own. An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, staged, tile_rows, worker_cache

#: Caps and decoded vectors worked on at a time, rows of a block, rows of a group of small tiles, parts that a class's rows are dealt by.
ASSIGNED, DECODED, BLOCK, GROUP_ROWS, SALTS = 512, 4096, 65_536, 8192, 8
#: Of a part's pairs more than one in so many are verified all together.
DENSE = 32


def code(dim: int, codewords: int) -> tuple[np.ndarray, np.ndarray]:
    """Random unit code words of the two halves; the seed is the dimension."""
    cache = worker_cache("capfilters", hold=True)
    if (key := ("caps", dim, codewords)) not in cache:
        rng = np.random.default_rng(dim)
        halves = []
        for d in (dim // 2, dim - dim // 2):
            c = rng.standard_normal((codewords, d))
            halves.append(c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300) / np.sqrt(2))
        cache[key] = halves
    return cache[key]


def _stack(lists) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: the rows' numbers and their unit vectors."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    lens, flat = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends, out = np.cumsum(lens), {}
    for n in np.unique(lens):
        rows = np.flatnonzero(lens == n)
        x = flat[(ends[rows] - n)[:, None] + np.arange(n)]
        x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
        out[int(n)] = rows, x / np.linalg.norm(x, axis=1, keepdims=True)
    return out


def _forest(rows: np.ndarray, cols: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least id of each component of the links rows[i] - cols[i], for both sides."""
    a, b = left.copy(), right.copy()
    while True:
        was = a.copy(), b.copy()
        np.minimum.at(a, rows, b[cols])
        np.minimum.at(b, cols, a[rows])
        if (a == was[0]).all() and (b == was[1]).all():
            return a, b


def _linked(ids, copies, x, filters, cosines, left, right, threshold: float, codewords: int):
    """Links of the rows of two blocks: each row's number of linked vectors, and edges between ids that join what is linked.

    ``left`` and ``right`` are the blocks' rows, in one order; where they are the same block each pair is met once. A row
    begins with its own id as its label; whenever links lower it, an edge from the old to the new label is kept.
    """
    n = x.shape[1]
    (c1, c2), angle, same = code(n, codewords), np.arccos(threshold) + 1e-6, left is right
    caps = np.cos(np.minimum(np.pi, np.arccos(np.clip(cosines[left], -1, 1)) + angle)) - 1e-9 - 2.4e-7 * (n + 8)  # of 32 bits below
    single, links, label, edges = x[right].astype(np.float32).T, np.zeros(len(ids), np.int64), ids.copy(), []
    for s in range(0, len(left), ASSIGNED):
        a = left[s : s + ASSIGNED]
        axes = np.concatenate([c1[filters[a] // codewords], c2[filters[a] % codewords]], 1).astype(np.float32)
        cap = caps[s : s + ASSIGNED, None].astype(np.float32)
        for t in range(s if same else 0, len(right), DECODED):
            b = right[t : t + DECODED]
            at = np.flatnonzero(axes @ single[:, t : t + DECODED] >= cap)
            if len(at) * DENSE > len(a) * len(b):
                r, c = np.nonzero(x[a] @ x[b].T >= threshold)
            else:
                r, c = np.divmod(at, len(b))
                found = np.einsum("ij,ij->i", x[a[r]], x[b[c]]) >= threshold
                r, c = r[found], c[found]
            if same:
                once = b[c] > a[r]
                r, c = r[once], c[once]
            if not len(r):
                continue
            links[a] += np.bincount(r, copies[b[c]], len(a)).astype(np.int64)
            links[b] += np.bincount(c, copies[a[r]], len(b)).astype(np.int64)
            rows, old = np.concatenate([a, b]), np.concatenate([label[a], label[b]])
            new = np.concatenate(_forest(r, c, label[a], label[b]))
            lower = np.flatnonzero(new < old)
            edges.append(np.unique(np.stack([old[lower], new[lower]], 1), axis=0))
            np.minimum.at(label, rows[lower], new[lower])
    return links, np.concatenate([*edges, np.empty((0, 2), np.int64)])


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.98, codewords: int = 1024, vec_id: str = "vec_id", vector: str = "embedding",
    label: str = "label"
) -> DataFrame:
    """(``vec_id``, ``n_links``, ``component_id``, ``kept``) for every row of ``vectors``.

    ``codewords`` change the work, not the result: more make narrower caps, and take longer to assign.
    """
    zero = F.lit(0).cast(vectors.schema[vector].dataType.elementType)
    plain = F.transform(vector, lambda x: F.when(x == 0, zero).otherwise(x))  # without negative zeros, so that equal vectors hash alike
    every = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), plain.alias("v"), F.col(label).cast("string").alias("label"))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
    usable &= F.coalesce(
        F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))), F.lit(False)
    ) & F.exists("v", lambda c: c != 0)
    good = every.where(usable)
    classes = staged(good.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "classes")

    def assign(batches):
        for batch in batches:
            filters, cosines = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for n, (rows, x) in _stack(batch.column("v")).items():
                c1, c2 = code(n, codewords)
                for i in range(0, len(rows), 2048):
                    p, q = x[i : i + 2048, : n // 2] @ c1.T, x[i : i + 2048, n // 2 :] @ c2.T
                    filters[rows[i : i + 2048]] = p.argmax(1) * codewords + q.argmax(1)
                    cosines[rows[i : i + 2048]] = p.max(1) + q.max(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(filters), pa.array(cosines)], names=[*batch.schema.names, "f", "cosine"])

    assigned = classes.mapInArrow(assign, classes.withColumn("f", F.lit(0).cast("long")).withColumn("cosine", F.lit(0.0)).schema)
    sizes = classes.groupBy("label", F.size("v").alias("dim")).agg(F.count("*").alias("n"))
    small = max(1, -(-(sizes.where(F.col("n") <= GROUP_ROWS).agg(F.sum("n")).first()[0] or 0) // GROUP_ROWS))
    # Small tiles share groups, larger ones have one each.
    group = F.when(F.col("n") <= GROUP_ROWS, F.pmod(F.xxhash64("label", "dim"), F.lit(small))).otherwise(F.lit(-1).cast("long"))
    tiles = tile_rows(assigned.withColumn("dim", F.size("v")), ["label", "dim"], sizes.withColumn("g", group), "rep", BLOCK)

    def compare(t: pa.Table) -> pa.Table:
        """The rows' links in the tile, and edges that join its components."""
        ids, links, leasts = [], [], []
        own, copies, filters, cosines, ti, tj, tb = (t[c].to_numpy() for c in ("rep", "copies", "f", "cosine", "ti", "tj", "tb"))
        names = t["label"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        for rows, x in _stack(t["v"]).values():
            order = np.lexsort((tj[rows], ti[rows], names[rows]))
            keys = np.stack([names[rows], ti[rows], tj[rows]])[:, order]
            for at in np.split(order, np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1):
                r = rows[at]
                left = np.flatnonzero(tb[r] == ti[r])
                right = left if ti[r[0]] == tj[r[0]] else np.flatnonzero(tb[r] == tj[r])
                found, edges = _linked(own[r], copies[r], x[at], filters[r], cosines[r], left, right, threshold, codewords)
                some = np.flatnonzero(found)
                ids += [own[r[some]], edges[:, 0]]
                links += [found[some], np.zeros(len(edges), np.int64)]
                leasts += [own[r[some]], edges[:, 1]]
        return pa.table(
            [np.concatenate([*z, np.empty(0, np.int64)]).astype(np.int64) for z in (ids, links, leasts)], names=["id", "links", "least"]
        )

    # A large tile's g is -1, so that label, length and place tell it apart; a small one's label has one tile.
    alone = lambda c: F.when(F.col("g") < 0, F.col(c))
    tiles = tiles.withColumns({"own": alone("label"), "length": alone("dim")}).drop("dim")
    found = staged(tiles.groupBy("g", "own", "length", "ti", "tj").applyInArrow(compare, "id long, links long, least long"), "links")
    components = connected_components(found.select(F.col("id").alias("u"), F.col("least").alias("v")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    # Vectors stay where they are: rows meet their class by two hashes of label and vector, each class in several parts.
    digest = [F.xxhash64(F.lit(seed), "label", "v").alias(f"d{seed}") for seed in (1, 2)]
    result = classes.select(*digest, "rep", "copies").join(links, F.col("rep") == links.id, "left").join(
        components, F.col("rep") == F.col("node"), "left"
    )
    result = result.select(
        "d1", "d2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    )
    linked = good.select(
        "vec_id", *digest, F.pmod(F.xxhash64("vec_id", F.lit(4)), F.lit(SALTS)).cast("int").alias("salt")
    ).join(result, ["d1", "d2", "salt"]).select("vec_id", "n_links", "component_id")
    alone = every.where(~F.coalesce(usable, F.lit(False))).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
