"""URL rules by a Bloom filter cascade: exact membership over the corpus's own keys, without joins.

A rule is a host and the start of a path; it fits the host, its subdomains and every path that starts so. A url's keys
are its host suffixes, each with every start of its path that is as long as some rule's path. A cascade is built for the
allow rules and one for the block rules: the first level encodes the listed keys, the next those unlisted keys of the
corpus that pass it, the third the listed ones that pass the second, and so on until none is left. Membership is exact
for the keys of the corpus, which the cascade was built over.

Null urls and urls without ``://`` have an empty host and path, fit no rule and get the default verdict. Repeated rows
give repeated results, and an empty table an empty one. The longest fitting rule wins (host and path together, then the
longer host); a rule in both lists blocks. Urls may be of any length: of a host with many labels only as many are looked
at as the longest rule has. Rules without host or path play no part; without any rule every url gets the default verdict.
More than ``MOST_RULES`` rules of a kind, or ``MOST_LENGTHS`` lengths of their paths, raise: the cascades would no longer
fit into the tasks. ``host``, ``path``, ``rule`` and ``verdict`` replace kept columns of these names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, staged

#: Rules that a list may hold; the cascades are sent to the tasks, with about two bytes a rule and level.
MOST_RULES, MOST_LENGTHS = 5_000_000, 4096


def hashes(keys) -> np.ndarray:
    """Spark's signed 64-bit hashes as unsigned integers."""
    return np.asarray(keys, dtype=np.int64).view(np.uint64)


class Level:
    """One Bloom filter with double hashing, salted by its place in the cascade."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray, rate: float, salt: int):
        self.salt = np.uint64((2 * salt + 1) * 0x9E3779B97F4A7C15 % 2**64)
        rate = min(0.5, max(rate, 1e-9))
        self.bits = np.uint64(max(64, math.ceil(-len(h1) * math.log(rate) / math.log(2) ** 2)))
        self.k = max(1, round(-math.log2(rate)))
        self.data = np.zeros(int(self.bits) // 8 + 1, np.uint8)
        for i in range(self.k):
            at = self.places(h1, h2, i)
            np.bitwise_or.at(self.data, at >> np.uint64(3), (1 << (at & np.uint64(7))).astype(np.uint8))

    def places(self, h1, h2, i):
        start = (h1 ^ self.salt) * self.salt
        start ^= start >> np.uint64(31)
        return (start + np.uint64(i) * (h2 | np.uint64(1))) % self.bits

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        ok = np.ones(len(h1), bool)
        for i in range(self.k):
            at = self.places(h1, h2, i)
            ok &= ((self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
        return ok


def member(levels: list[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether each key is listed: the first level that it fails decides."""
    out, open_ = np.zeros(len(h1), bool), np.ones(len(h1), bool)
    for i, level in enumerate(levels):
        now = np.flatnonzero(open_)
        passed = level.has(h1[now], h2[now])
        out[now[~passed]] = i % 2 == 1
        open_[now[~passed]] = False
    out[open_] = len(levels) % 2 == 1
    return out


def split_url(url) -> tuple:
    """The host (A-Z lower-cased) and path columns of a url column."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def url_keys(host, path, lengths: list[int], most_labels: int):
    """Host suffixes of at most so many labels, each with the path's starts of these lengths: (host, path) structs."""
    labels = F.split(host, r"\.", -1)
    labels = F.slice(labels, F.greatest(F.size(labels) - (most_labels - 1), F.lit(1)), F.lit(most_labels))
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda p: F.struct(s.alias("host"), p.alias("path")))))
    return F.when(host != "", pairs).otherwise(F.expr("CAST(array() AS array<struct<host:string,path:string>>)"))


def _pair_hash(key) -> list:
    return [F.xxhash64(F.lit(seed), key["host"], key["path"]) for seed in (1, 2)]


def build(listed: DataFrame, universe: DataFrame) -> list[Level]:
    """The cascade of ``listed`` over ``universe``; both hold distinct hash pairs (``h1``, ``h2``).

    The first level's rate is set so that about as many unlisted keys pass it as are listed; every later level halves,
    so what comes to the driver is a few times the rules, however large the corpus.
    """
    rows = listed.limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    inside = np.array([[r.h1, r.h2] for r in rows], np.int64).reshape(-1, 2)
    total = universe.count()
    levels = [Level(*hashes(inside).T, rate=max(len(inside), 1) / max(total, 1) / 2, salt=0)]
    first = levels[0]

    @F.pandas_udf("boolean")
    def passes(h1: pd.Series, h2: pd.Series) -> pd.Series:
        return pd.Series(first.has(hashes(h1), hashes(h2)))

    outside = np.empty((0, 2), np.int64)
    if inside.size:
        # What passes are the listed keys of the corpus and about half as many others; the listed ones leave here.
        known = {(r.h1, r.h2) for r in rows}
        passed = universe.where(passes("h1", "h2")).toPandas().to_numpy(np.int64).reshape(-1, 2)
        outside = np.array([key for key in map(tuple, passed.tolist()) if key not in known], np.int64).reshape(-1, 2)
    keep, other = inside, outside
    while len(other):
        level = Level(*hashes(other).T, rate=0.5, salt=len(levels))
        levels.append(level)
        keep, other = other, keep[level.has(*hashes(keep).T)]
    return levels


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``keep`` columns with ``host``, ``path``, ``rule`` and ``verdict``; ``rules`` has host, path and verdict."""
    rules = rules.where("host IS NOT NULL AND path IS NOT NULL").withColumn("host", ascii_lower(F.col("host"))).distinct()
    keep = [c for c in keep if c not in ("host", "path", "rule", "verdict")]
    lengths = [r[0] for r in rules.select(F.length("path")).distinct().limit(MOST_LENGTHS + 1).collect()]
    if len(lengths) > MOST_LENGTHS:
        raise ValueError(f"more than {MOST_LENGTHS} lengths of rule paths")
    most_labels = rules.agg(F.max(F.size(F.split("host", r"\.", -1)))).first()[0] or 1
    host, path = split_url(F.col(url))
    pages = pages.select(*keep, host.alias("host"), path.alias("path"))
    if not lengths:
        return pages.select(*keep, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    keyed = pages.withColumn("keys", url_keys(F.col("host"), F.col("path"), lengths, most_labels))
    pair = lambda key: [h.alias(n) for h, n in zip(_pair_hash(key), ("h1", "h2"), strict=True)]
    universe = staged(keyed.select(F.explode("keys").alias("key")).select(*pair(F.col("key"))).distinct(), "universe")
    cascades = {}
    for verdict in ("allow", "block"):
        own = rules.where(F.col("verdict") == verdict).select(*pair(F.struct("host", "path"))).distinct()
        cascades[verdict] = build(own, universe)

    @F.pandas_udf("array<int>")
    def verdicts(h1: pd.Series, h2: pd.Series) -> pd.Series:
        """Of each url's keys: 1 allow, 2 block, 3 both, 0 neither."""
        lens = h1.map(len).to_numpy(dtype=np.int64)
        flat = [hashes(np.concatenate([*x, np.empty(0, np.int64)])) for x in (h1, h2)]
        found = member(cascades["allow"], *flat) + 2 * member(cascades["block"], *flat).astype(np.int32)
        return pd.Series(np.split(found.astype(np.int32), np.cumsum(lens)[:-1])) if len(lens) else pd.Series([], dtype=object)

    marked = keyed.withColumn("found", verdicts(F.transform("keys", lambda k: _pair_hash(k)[0]), F.transform("keys", lambda k: _pair_hash(k)[1])))
    fits = F.filter(F.arrays_zip("keys", "found"), lambda z: z["found"] > 0)
    ranked = F.transform(
        fits,
        lambda z: F.struct(
            (F.length(z["keys"]["host"]) + F.length(z["keys"]["path"])).alias("n"), F.length(z["keys"]["host"]).alias("m"),
            z["found"].alias("found"), F.concat(z["keys"]["host"], z["keys"]["path"]).alias("rule")
        )
    )
    best = marked.withColumn("best", F.array_max(ranked))
    verdict = F.when(F.col("best.found").isNull(), default).when(F.col("best.found") == 1, "allow").otherwise("block")
    return best.select(*keep, "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))
