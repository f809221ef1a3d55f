"""Near-duplicate documents by HyperMinHash over word shingles.

One pass turns every whole text into its set of 64-bit shingle hashes and a sketch: a hash's first bits choose a
register, which stores the leading zeros and the next mantissa bits of the least rest; empty registers borrow from
hash-chosen full ones. Documents with equal sets are one class. Four registers are one band; classes that share a band
are compared by their sizes, which bound the similarity, and, if both sets have ``DIRECT`` members, by the
collision-corrected estimate: those whose estimate is no more than ``SLACK`` standard deviations under the threshold form
candidate groups. Smaller sets, whose borrowed registers vary more, go there by size alone. Each group's full sets are
then verified; a Bloom filter keeps texts without candidates where they are. Hot bands are dealt to square tiles; a tile
searches from member to member and returns component labels, never pairs. Large groups meet a few of their members first,
and only those that stay apart meet all others.

A null or blank text has an empty set (size 0) and links with nothing; a text with fewer words than a shingle has one
shingle, the whole sequence. Rows without an id link with nothing (``component_id`` null, kept). Rows that repeat an id
are one document: they share its component. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, drop_staged, maybe_among, small_batches, staged, staged_so_far, tile_rows, worker_cache

#: Registers and their index bits, mantissa bits, registers of a band.
REGISTERS, INDEX_BITS, MANTISSA, ROWS = 128, 7, 10, 4
#: Standard deviations that an estimate may fall short, members of a set from which it counts; classes of a band tile
#: and rows of a group of them.
SLACK, DIRECT, BAND_BLOCK, GROUP_ROWS = 6.0, 64, 4096, 20_000
#: Documents and bytes of a set tile, bytes of a group of tiles, members that all others of a large group meet first.
SET_BLOCK, SET_BYTES, SET_GROUP_BYTES, PIVOTS = 512, 1 << 25, 1 << 20, 8
#: Words that a task remembers.
KEPT_WORDS = 200_000
#: The expected share of accidentally equal registers of equally large sets, for one mantissa bit (Yu and Weber, 2017).
COLLISIONS = 0.169919487159739093975315012348 * 2

REST = 64 - INDEX_BITS
EMPTY = np.uint64(2**64 - 1)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, in order; A-Z is lower-cased and words end at ASCII white space."""
    known = worker_cache("minhash").setdefault("minhash_words", _Words())
    if len(known) > KEPT_WORDS:
        known.clear()
    words = [t.lower().split() for t in texts]
    lens = [len(w) for w in words]
    h = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.uint64, sum(lens))
    acc = _mix(h)
    for i in range(1, width):
        acc = acc[: max(0, len(h) - i)]
        acc = _mix(acc + h[i : i + len(acc)])
    out, at = [], 0
    for n in lens:
        if n >= width:
            out.append(np.unique(acc[at : at + n - width + 1]))
        elif n:
            short = _mix(h[at : at + 1])
            for x in h[at + 1 : at + n]:
                short = _mix(short + x)
            out.append(_mix(short + np.uint64(n)))
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out


def _probes() -> np.ndarray:
    cache = worker_cache("minhash")
    if "minhash_probes" not in cache:
        cache["minhash_probes"] = np.random.default_rng(1).integers(0, REGISTERS, (512, REGISTERS))
    return cache["minhash_probes"]


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 16-bit registers for each set: leading zeros, then mantissa bits; empty ones borrow."""
    least = np.full((len(sets), REGISTERS), EMPTY)
    for row, s in zip(least, sets, strict=True):
        if len(s):
            place = (s >> np.uint64(REST)).astype(np.int64)
            first = np.flatnonzero(np.diff(place, prepend=-1))
            row[place[first]] = s[first] & np.uint64(2**REST - 1)
    full = least != EMPTY
    rest = least | np.uint64(1)
    zeros = REST - 1 - np.floor(np.log2(rest.astype(np.float64))).astype(np.int64)
    zeros = np.clip(zeros, 0, 63)
    shift = REST - 1 - zeros - MANTISSA
    mantissa = np.where(
        shift >= 0, rest >> np.maximum(shift, 0).astype(np.uint64), rest << np.maximum(-shift, 0).astype(np.uint64)
    ) & np.uint64(2**MANTISSA - 1)
    regs = (zeros.astype(np.uint64) << np.uint64(MANTISSA) | mantissa).astype(np.uint16)
    row, col = np.nonzero(~full & full.any(axis=1, keepdims=True))
    source = regs.copy()
    for probe in _probes():
        if not len(row):
            break
        hit = full[row, probe[col]]
        regs[row[hit], col[hit]] = source[row[hit], probe[col[hit]]]
        row, col = row[~hit], col[~hit]
    for r, c in zip(row, col, strict=True):  # none of the probes met a full register
        filled = np.flatnonzero(full[r])
        regs[r, c] = source[r, filled[np.searchsorted(filled, c) % len(filled)]]
    return regs


def estimate(equal: np.ndarray, n_a, n_b) -> np.ndarray:
    """Jaccard similarity from the number of equal registers, less the expected accidental ones."""
    ratio = n_a / np.maximum(n_b, 1)
    p = COLLISIONS * 2.0**-MANTISSA * 4 * ratio / (1 + ratio) ** 2
    return (equal / REGISTERS - p) / (1 - p)


def _groups(sizes: np.ndarray):
    ends = np.cumsum(sizes)
    return zip((ends - sizes).tolist(), ends.tolist(), strict=True)


def _components(ids: np.ndarray, near) -> np.ndarray:
    """The least id of each member's component; ``near(i, rest)`` tells which of ``rest`` member i links to."""
    label, rest = ids.copy(), np.arange(len(ids))
    while len(rest):
        queue, found, rest = [rest[0]], [rest[0]], rest[1:]
        while queue and len(rest):
            hit = near(queue.pop(), rest)
            queue += rest[hit].tolist()
            found += rest[hit].tolist()
            rest = rest[~hit]
        label[found] = ids[found].min()
    return label


_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _edges(ids: list, labels: list) -> pa.Table:
    u, v = (np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64) for x in (ids, labels))
    linked = u != v
    return pa.table([u[linked], v[linked]], schema=_EDGES)


def _tiles(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """The rows in the order of their tiles, and the tiles' sizes."""
    table = table.sort_by("tile")
    return table, np.unique(table["tile"].to_numpy(), return_counts=True)[1]


class _Sets:
    """Shingle sets of one tile; tells which of some rows are similar to one of them."""

    def __init__(self, raw: list[bytes], percent: int):
        own = [np.frombuffer(x, np.uint64) for x in raw]
        self.lens, self.percent = np.array([len(s) for s in own]), percent
        self.ends = np.cumsum(self.lens)
        self.number = np.unique(np.concatenate(own), return_inverse=True)[1]
        self.mark = np.zeros(self.number.max(initial=0) + 1, bool)

    def near(self, i: int, rest: np.ndarray) -> np.ndarray:
        lens, mine = self.lens, self.number[self.ends[i] - self.lens[i] : self.ends[i]]
        self.mark[mine] = True
        hit = np.zeros(len(rest), bool)
        for s in range(0, len(rest), 256):
            r = rest[s : s + 256]
            at = np.repeat(self.ends[r] - np.cumsum(lens[r]), lens[r]) + np.arange(lens[r].sum())
            shared = np.add.reduceat(self.mark[self.number[at]].astype(np.int64), np.cumsum(lens[r]) - lens[r])
            hit[s : s + 256] = 100 * shared >= self.percent * (lens[r] + lens[i] - shared)
        self.mark[mine] = False
        return hit


def _compared(dealt: DataFrame, percent: int, total: int | None) -> DataFrame:
    """Edges (``u``, ``v``) between the components found in each tile of ``dealt`` (``rep``, ``first``, ``shingles``, ``tile``).

    Rows with ``first`` are compared with all of the tile; where no row has it, all are. ``total`` are the sets' bytes.
    """
    groups = max(1, -(-(total or 0) // SET_GROUP_BYTES))

    def verify(table: pa.Table) -> pa.Table:
        table, sizes = _tiles(table)
        ids, raw, first = table["rep"].to_numpy(), table["shingles"].combine_chunks(), table["first"].to_numpy()
        out_ids, out_labels = [], []
        for a, b in _groups(sizes):
            sets, own = _Sets(raw.slice(a, b - a).to_pylist(), percent), ids[a:b]
            if not (some := np.flatnonzero(first[a:b])).size:
                out_ids.append(own)
                out_labels.append(_components(own, sets.near))
                continue
            label, every = own.copy(), np.arange(len(own))
            for i in some.tolist():  # joins what it is similar to, and the components that these were in
                met = np.unique(label[every[sets.near(i, every)]])
                label[np.isin(label, met)] = met[0]
            out_ids.append(own)
            out_labels.append(label)
        return _edges(out_ids, out_labels)

    return dealt.withColumn("g", F.pmod("tile", F.lit(groups))).groupBy("g").applyInArrow(verify, "u long, v long")


def _verified(whole: DataFrame, percent: int) -> DataFrame:
    """Edges between similar sets of the candidate groups ``whole`` (``rep``, ``component``, ``shingles``).

    A group that fits into one tile is compared there. The members of a larger one are first compared with ``PIVOTS`` of
    them; then only the members that are not in the group's largest component are compared with all members, in tiles.
    So a large group of near copies costs a few copies of each set, and no link is lost: two members of the largest
    component need no comparison.
    """
    blocks = lambda n, size: F.ceil(F.greatest(n / SET_BLOCK, size / SET_BYTES)).cast("int")
    sums = [F.count("*").alias("n"), F.sum(F.length("shingles")).alias("bytes")]
    sizes = staged(whole.groupBy("component").agg(*sums).withColumn("blocks", blocks(F.col("n"), F.col("bytes"))), "sizes")
    total, most = sizes.agg(F.sum("bytes"), F.max("blocks")).first()
    if (most or 0) <= 1:
        return _compared(whole.select("rep", F.lit(False).alias("first"), "shingles", F.xxhash64("component").alias("tile")), percent, total)
    rows = whole.join(sizes.select("component", "blocks"), "component")
    edges = _compared(
        rows.where("blocks = 1").select("rep", F.lit(False).alias("first"), "shingles", F.xxhash64("component").alias("tile")), percent,
        total
    )
    large = staged(rows.where("blocks > 1").withColumn("block", F.pmod(F.xxhash64("rep", F.lit(7)), F.col("blocks"))), "large")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))
    deal = lambda df, first, *c: df.select("rep", F.lit(first).alias("first"), "shingles", F.xxhash64("component", *c).alias("tile"))
    weigh = lambda df: (df, percent, df.agg(F.sum(F.length("shingles"))).first()[0])
    least = large.groupBy("component", F.pmod(F.xxhash64("rep", F.lit(8)), F.lit(PIVOTS)).alias("p")).agg(F.min("rep").alias("rep")).select("rep")
    pivots = large.join(least, "rep", "left_semi").withColumn("other", each("blocks"))
    edges = edges.union(
        staged(_compared(*weigh(deal(large.join(least, "rep", "left_anti"), False, "block").union(deal(pivots, True, "other")))), "pivot-links")
    )
    found = connected_components(edges).select(F.col("node").alias("rep"), F.col("component").alias("part"))
    parts = large.select("rep", "component").join(found, "rep", "left").withColumn("part", F.coalesce("part", "rep"))
    counts = parts.groupBy("component", "part").agg(F.count("*").alias("n"))
    largest = counts.groupBy("component").agg(F.max(F.struct("n", "part"))["part"].alias("largest"))
    loose = staged(parts.join(largest, "component").where("part <> largest").select("rep"), "loose")
    if loose.isEmpty():
        return edges
    loose = large.join(loose, "rep", "left_semi")
    sizes = loose.groupBy("component").agg(*sums).select("component", blocks(F.col("n"), F.col("bytes")).alias("loose_blocks"))
    one = loose.join(sizes, "component").withColumn(
        "own", F.pmod(F.xxhash64("rep", F.lit(9)), F.col("loose_blocks"))
    ).withColumn("other", each("blocks"))
    every = large.join(sizes, "component").withColumn("own", each("loose_blocks"))
    return edges.union(_compared(*weigh(deal(one, True, "own", "other").union(deal(every, False, "own", "block")))))


def sketch_documents(docs: DataFrame, width: int) -> DataFrame:
    """(``doc_id``, ``n``, ``key``, ``bands``) for every document: set size, digest of the set, registers by band."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = shingle_sets(pc.cast(part.column(1), pa.binary()).to_pylist(), width)
                bands = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(sets) + 1, dtype=np.int32) * (REGISTERS // ROWS)),
                    pa.array(sketches(sets).view(np.int64).ravel())
                )
                keys = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), keys, bands], names=["doc_id", "n", "key", "bands"]
                )

    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, key binary, bands array<long>")


def near_duplicates(docs: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """(``doc_id``, ``n_shingles``, ``component_id``, ``kept``) for every row of ``docs`` (``doc_id``, ``text``)."""
    percent = round(100 * threshold)
    least = threshold - SLACK * float(np.sqrt(threshold * (1 - threshold) / REGISTERS))
    sketched = staged(sketch_documents(docs, width), "sketches")
    classes = staged(
        sketched.where("n > 0 AND doc_id IS NOT NULL").groupBy("key").agg(
            F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")
        ),
        "classes"
    )
    spark, since = docs.sparkSession, staged_so_far()
    # A set of fewer members can't reach the threshold with any other set.
    wide = classes.where(F.col("n") >= int(np.ceil(threshold / (1 - threshold) - 1e-9)))
    banded = wide.select("rep", F.posexplode("bands").alias("band", "h"))
    sizes = banded.groupBy("band", "h").agg(F.count("*").alias("n")).where("n > 1")
    members = staged(
        tile_rows(banded, ["band", "h"], sizes, "rep", BAND_BLOCK).select("rep", F.xxhash64("band", "h", "ti", "tj").alias("tile")), "bands"
    )
    groups = max(1, -(-members.count() // GROUP_ROWS))

    def possible(equal: np.ndarray, n_a, n_b) -> np.ndarray:
        small, large = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
        return (100 * small >= percent * large) & ((small < DIRECT) | (estimate(equal, n_a, n_b) >= least))

    def similar(table: pa.Table) -> pa.Table:
        table, sizes = _tiles(table)
        ids, n = table["rep"].to_numpy(), table["n"].to_numpy()
        regs = table["bands"].combine_chunks().flatten().to_numpy().view(np.uint16).reshape(-1, REGISTERS)
        out_ids, out_labels = [], []
        pairs = np.flatnonzero(np.repeat(sizes == 2, sizes))[::2]
        if len(pairs):
            ok = possible((regs[pairs] == regs[pairs + 1]).sum(1), n[pairs], n[pairs + 1])
            out_ids.append(np.maximum(ids[pairs[ok]], ids[pairs[ok] + 1]))
            out_labels.append(np.minimum(ids[pairs[ok]], ids[pairs[ok] + 1]))
        for a, b in _groups(sizes):
            if b - a > 2:
                r, m = regs[a:b], n[a:b]
                out_ids.append(ids[a:b])
                out_labels.append(_components(ids[a:b], lambda i, rest, r=r, m=m: possible((r[rest] == r[i]).sum(1), m[rest], m[i])))
        return _edges(out_ids, out_labels)

    met = members.join(wide.select("rep", "n", "bands"), "rep").withColumn("g", F.pmod("tile", F.lit(groups)))
    candidates = staged(connected_components(met.groupBy("g").applyInArrow(similar, "u long, v long")), "candidates")

    def sets(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = shingle_sets(pc.cast(part.column(2), pa.binary()).to_pylist(), width)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([s.tobytes() for s in found], pa.binary())],
                    names=["rep", "component", "shingles"]
                )

    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").where("node IS NOT NULL AND text IS NOT NULL")
    near = maybe_among(texts, "node", candidates.select("node")).join(candidates, "node")
    whole = near.select(F.col("node").alias("rep"), "component", "text").mapInArrow(
        sets, "rep long, component long, shingles binary"
    ).where("length(shingles) > 0")
    components = connected_components(_verified(staged(whole, "sets"), percent))
    drop_staged(spark, since, but=1)  # of these tables only the components' last round is read from here on
    by_class = classes.join(components, classes.rep == components.node, "left").select("key", F.coalesce("component", "rep").alias("component"))
    # Documents without words or id link with nothing, so they keep out of the join on the digest.
    linked = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    rows = sketched.where(linked).select("doc_id", "n", "key").join(by_class, "key").select("doc_id", "n", "component")
    rows = rows.union(sketched.where(~linked).select("doc_id", "n", F.col("doc_id").alias("component")))
    return rows.select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
