"""Vector distances: column expressions for pairs of array columns, and numpy kernels for blocks."""

from __future__ import annotations

from functools import cached_property

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Other names of the metrics.
ALIASES = {
    "l2": "euclidean", "euclid": "euclidean", "cos": "cosine", "l1": "manhattan", "cityblock": "manhattan", "manhattan_distance": "manhattan",
    "hamming_distance": "hamming", "linf": "chebyshev", "sq_euclidean": "sqeuclidean",
}


def metric_name(name: str) -> str:
    """The canonical metric; unknown names raise."""
    key = str(name).strip().lower()
    key = ALIASES.get(key, key)
    if key not in KERNELS:
        raise ValueError(f"unknown vector metric {name!r}")
    return key


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x * x)))


def distance(metric: str, a: Column, b: Column, p: float = 2.0) -> Column:
    """The distance of two array<double> columns of equal length, inside the JVM; ``p`` is Minkowski's power."""
    metric = metric_name(metric)
    gap = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    square = _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))
    if metric == "euclidean":
        return F.sqrt(square)
    if metric == "sqeuclidean":
        return square
    if metric == "cosine":
        size = norm(a) * norm(b)
        return F.when(size < 1e-16, F.lit(1.0)).otherwise(1 - dot(a, b) / size)
    if metric == "manhattan":
        return _sum(gap)
    if metric == "chebyshev":
        return F.array_max(gap)
    if metric == "hamming":
        return _sum(F.zip_with(a, b, lambda x, y: (x != y).cast("double"))) / F.size(a)
    if metric == "canberra":
        return _sum(F.zip_with(a, b, lambda x, y: F.when((x == 0) & (y == 0), 0.0).otherwise(F.abs(x - y) / (F.abs(x) + F.abs(y)))))
    if metric == "minkowski":
        return F.pow(_sum(F.transform(gap, lambda x: F.pow(x, F.lit(float(p))))), F.lit(1.0 / p))
    if metric == "correlation":
        centred = lambda v: F.transform(v, lambda x: x - _sum(v) / F.size(v))
        return distance("cosine", centred(a), centred(b))
    if metric == "jaccard":
        either = _sum(F.zip_with(a, b, lambda x, y: ((x != 0) | (y != 0)).cast("double")))
        return F.when(either == 0, F.lit(0.0)).otherwise(_sum(F.zip_with(a, b, lambda x, y: ((x != 0) != (y != 0)).cast("double"))) / either)
    total = _sum(F.zip_with(a, b, lambda x, y: F.abs(x + y)))
    return F.when(total == 0, F.lit(0.0)).otherwise(_sum(gap) / total)


def _by_row(f):
    """A kernel that takes one query at a time, so that a block's memory follows the candidates alone."""
    return lambda q, c: np.stack([f(row, c) for row in q]) if len(q) else np.empty((0, len(c)))


def _cosine(q: np.ndarray, c: np.ndarray, k: int | None = None) -> np.ndarray:
    """Cosine distances; with ``k``, those that a matrix product leaves no chance to be among a query's k least are infinite."""
    size = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(c, axis=1)
    flat = size < 1e-16
    safe = np.where(flat, 1, size)
    if k is None or k >= len(c) or not np.isfinite(size).all():
        return np.where(flat, 1.0, 1 - np.array([(c * row).sum(1) for row in q]).reshape(len(q), len(c)) / safe)
    near = np.where(flat, 1.0, 1 - q @ c.T / safe)
    edge = np.partition(near, k - 1, axis=1)[:, k - 1] + 2e-8 + 2 * (4 * q.shape[1] + 16) * np.finfo(np.float64).eps
    r, j = np.nonzero(near <= edge[:, None])
    out = np.full(near.shape, np.inf)
    for s in range(0, len(r), 65_536):
        a, b = r[s : s + 65_536], j[s : s + 65_536]
        out[a, b] = np.where(flat[a, b], 1.0, 1 - (c[b] * q[a]).sum(1) / safe[a, b])
    return out


def _canberra(row, c):
    size = np.abs(row) + np.abs(c)
    return (np.abs(row - c) / np.where(size == 0, 1, size)).sum(1)


def _braycurtis(row, c):
    total = np.abs(row + c).sum(1)
    return np.abs(row - c).sum(1) / np.where(total == 0, 1, total)


def _correlation(q: np.ndarray, c: np.ndarray, k: int | None = None) -> np.ndarray:
    return _cosine(q - q.mean(1, keepdims=True), c - c.mean(1, keepdims=True), k)


def _jaccard(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Shares of the features that either has and one lacks; the counts are sums of ones, exact in any order."""
    x, y = (np.asarray(v != 0, np.float64) for v in (q, c))
    both = x @ y.T
    either = x.sum(1)[:, None] + y.sum(1) - both
    return (either - both) / np.maximum(either, 1)


def _minkowski(q: np.ndarray, c: np.ndarray, k: int | None = None, p: float = 2.0) -> np.ndarray:
    """Minkowski distances; with ``k``, those that can't be among a query's k least are infinite.

    A matrix product gives euclidean distances, and with them bounds from below; of the pairs that these leave, only those whose
    sum by repeated products (of a whole ``p``) comes near the k-th are worked out by powers.
    """
    every = lambda a, b: (np.abs(c[b] - q[a]) ** p).sum(1) ** (1 / p)
    if k is None or k >= len(c) or p < 1 or not len(q):
        return _by_row(lambda row, c: (np.abs(c - row) ** p).sum(1) ** (1 / p))(q, c)
    size_q, size_c = (q * q).sum(1), (c * c).sum(1)
    most = size_q + size_c.max()
    if not np.isfinite(most).all() or most.max() > 1e60 or p > 5:
        return _minkowski(q, c, None, p)
    near = size_q[:, None] + size_c - 2 * (q @ c.T)
    slip = 2 * (4 * q.shape[1] + 16) * np.finfo(np.float64).eps * most
    low = np.sqrt(np.maximum(near - slip[:, None], 0)) * min(1.0, q.shape[1] ** (1 / p - 0.5)) * (1 - 1e-9)
    first = np.argpartition(near, k - 1, axis=1)[:, :k]
    edge = every(np.repeat(np.arange(len(q)), k), first.ravel()).reshape(-1, k).max(1) + 2e-8
    r, j = np.nonzero(low <= edge[:, None])
    out = np.full(near.shape, np.inf)

    def fill(r, j, f):
        for s in range(0, len(r), 16_384):
            a, b = r[s : s + 16_384], j[s : s + 16_384]
            out[a, b] = f(a, b)

    if p == int(p):

        def rough(a, b):
            gap = np.abs(c[b] - q[a])
            total = gap
            for _ in range(int(p) - 1):
                total = total * gap
            return total.sum(1) ** (1 / p)

        fill(r, j, rough)
        edge = np.partition(out, k - 1, axis=1)[:, k - 1] * (1 + 1e-12) + 2e-8
        r, j = np.nonzero(out <= edge[:, None])
        out[:] = np.inf
    fill(r, j, every)
    return out


def _nan_euclidean(q: np.ndarray, c: np.ndarray, size: int | None = None) -> np.ndarray:
    """Euclidean over the features that both rows have, scaled up to ``size`` features (all of them); NaN if they share none."""
    size = size or q.shape[1]

    def one(row, c):
        gaps = c - row
        both = ~np.isnan(gaps)
        n = both.sum(1)
        return np.where(n > 0, np.sqrt(np.where(both, gaps * gaps, 0).sum(1) * size / np.maximum(n, 1)), np.nan)

    return _by_row(one)(q, c)


def _squared(row: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c - row) ** 2).sum(1)


def _by_product(finish):
    """A kernel of squared euclidean distances that, with ``k``, works out only what can be among a query's k least.

    A matrix product gives all squares up to its rounding error, which is bounded by the sizes of the vectors; those that
    may be below the k-th, or within 1e-8 of it, are worked out plainly, the others are infinite. Rows of values that are not finite, or whose
    squares are not, are all worked out.
    """

    def f(q: np.ndarray, c: np.ndarray, k: int | None = None) -> np.ndarray:
        if not len(q) or not len(c):
            return np.empty((len(q), len(c)))
        size_q, size_c = (q * q).sum(1), (c * c).sum(1)
        most = size_q + size_c.max()
        if k is None or k >= len(c) or not np.isfinite(most).all():
            return np.stack([finish(_squared(row, c)) for row in q])
        near = size_q[:, None] + size_c - 2 * (q @ c.T)
        edge = np.maximum(np.partition(near, k - 1, axis=1)[:, k - 1], 0)
        edge += 2e-8 * np.sqrt(edge) + 1e-8  # distances may be rounded to eight digits before they are compared
        edge += 2 * (4 * q.shape[1] + 16) * np.finfo(np.float64).eps * most
        r, j = np.nonzero(near <= edge[:, None])
        out = np.full(near.shape, np.inf)
        for s in range(0, len(r), 65_536):
            a, b = r[s : s + 65_536], j[s : s + 65_536]
            out[a, b] = finish(((c[b] - q[a]) ** 2).sum(1))
        return out

    return f


#: (queries, candidates) -> matrix, for the tiles of the neighbour search; those of ``PRUNED`` take k too.
PRUNED = ("euclidean", "sqeuclidean", "cosine", "correlation", "minkowski")
KERNELS = {
    "euclidean": _by_product(np.sqrt),
    "sqeuclidean": _by_product(lambda x: x),
    "cosine": _cosine,
    "manhattan": _by_row(lambda row, c: np.abs(c - row).sum(1)),
    "chebyshev": _by_row(lambda row, c: np.abs(c - row).max(1)),
    "hamming": _by_row(lambda row, c: (c != row).mean(1)),
    "canberra": _by_row(_canberra),
    "braycurtis": _by_row(_braycurtis),
    "minkowski": _minkowski,
    "correlation": _correlation,
    "jaccard": _jaccard,
    "nan_euclidean": _nan_euclidean,
}


def _gaps(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Each feature's gap between one box and others; 0 where they meet or a side isn't a number."""
    return np.nan_to_num(np.maximum(np.maximum(lows - high, low - highs), 0), nan=0.0, posinf=np.inf)


def _canberra_bound(low, high, lows, highs):
    gaps = _gaps(low, high, lows, highs)
    size = np.where(lows > high, np.abs(lows) + np.abs(high), np.abs(low) + np.abs(highs))  # of the two ends that face each other
    return np.nan_to_num(gaps / np.where(gaps > 0, size, 1), nan=0.0).sum(1)


def _braycurtis_bound(low, high, lows, highs):
    most = np.maximum(np.abs(low + lows), np.abs(high + highs)).sum(1)
    return np.nan_to_num(_gaps(low, high, lows, highs).sum(1) / np.where(most == 0, 1, most), nan=0.0)


#: (a box's low and high corner, other boxes' corners) -> the least distance that a row of the one can have to a row of each other.
BOUNDS = {
    "euclidean": lambda *b: np.sqrt((_gaps(*b) ** 2).sum(1)),
    "sqeuclidean": lambda *b: (_gaps(*b) ** 2).sum(1),
    "manhattan": lambda *b: _gaps(*b).sum(1),
    "chebyshev": lambda *b: _gaps(*b).max(1),
    "hamming": lambda *b: (_gaps(*b) > 0).mean(1),
    "canberra": _canberra_bound,
    "braycurtis": _braycurtis_bound,
    "minkowski": lambda *b, p=2.0: (_gaps(*b) ** p).sum(1) ** (1 / p),
    "nan_euclidean": lambda *b, size=None: np.sqrt((_gaps(*b) ** 2).sum(1) * (size or b[0].size) / b[0].size),
}


def _leaves(x: np.ndarray, size: int) -> list[np.ndarray]:
    """The rows' numbers, halved along the widest feature until no part has more than ``size``."""
    todo, out = [np.arange(len(x))], []
    while todo:
        own = todo.pop()
        if len(own) <= size:
            out.append(own)
            continue
        rows = np.nan_to_num(x[own])
        at = rows[:, np.argmax(rows.max(0) - rows.min(0))]
        order = np.argpartition(at, len(own) // 2)
        todo += [own[order[: len(own) // 2]], own[order[len(own) // 2 :]]]
    return out


def _distinct(x: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' order by value and then id, and where in it each distinct value begins."""
    bits = np.ascontiguousarray(x + 0.0).view(np.int64)
    order = np.lexsort((ids, *bits.T))
    new = np.ones(len(x), bool)
    new[1:] = (bits[order[1:]] != bits[order[:-1]]).any(1)
    return order, np.flatnonzero(new)


#: Distinct queries that are searched together, and distinct candidates of a leaf.
GROUP, LEAF = 32, 64


def nearest(q: np.ndarray, c: np.ndarray, ids: np.ndarray, k: int, distances, bound, digits: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of ``q``, candidates' ids, distances) of each query's k nearest, ties to smaller ids, for vectors of few features.

    Equal vectors are searched once: of equal candidates the k least ids can be among the k nearest, and a query's k nearest lie
    among the k distinct values that come first by distance and least id. Queries near each other are searched together: the
    leaves nearest to each give distances, and only leaves whose bound does not exceed it are worked out, all by ``distances``.
    """
    c_order, c_at = _distinct(c, ids)
    values, least = c[c_order[c_at]], ids[c_order[c_at]]
    counts = np.minimum(np.diff(np.append(c_at, len(c))), k)
    q_order, q_at = _distinct(q, np.arange(len(q)))
    wanted = q[q_order[q_at]]
    leaves = _leaves(values, LEAF)
    lows, highs = (np.stack([f(values[own], axis=0) for own in leaves]) for f in (np.min, np.max))
    middles = np.nan_to_num((np.maximum(lows, -1e150) + np.minimum(highs, 1e150)) / 2)
    sizes_of = (middles * middles).sum(1)
    slack, some = 0.0 if digits is None else 10.0**-digits, max(1, -(-2 * k // LEAF))
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]

    def measured(rows, own):
        d = np.asarray(distances(rows, values[own]), np.float64)
        return np.where(np.isnan(d), np.inf, d if digits is None else d.round(digits))

    for group in _leaves(wanted, GROUP):
        rows = wanted[group]
        low = bound(rows.min(0), rows.max(0), lows, highs)
        apart = sizes_of - 2 * (np.nan_to_num(rows, posinf=1e150, neginf=-1e150) @ middles.T)  # where to begin; any order gives the same
        first = np.unique(np.argpartition(apart, some - 1, axis=1)[:, :some]) if some < len(leaves) else np.arange(len(leaves))
        own = np.concatenate([leaves[i] for i in first])
        d = measured(rows, own)
        edge = np.partition(d, k - 1, axis=1)[:, k - 1].max() if k < len(own) else np.inf
        more = low * (1 - 1e-9) <= edge + slack
        more[first] = False
        if more.any():
            rest = np.concatenate([leaves[i] for i in np.flatnonzero(more)])
            own, d = np.concatenate([own, rest]), np.concatenate([d, measured(rows, rest)], 1)
        most = min(k, len(own))
        edges = np.partition(d, most - 1, axis=1)[:, most - 1]
        r, j = np.nonzero((d <= edges[:, None]) & (d < np.inf))
        order = np.lexsort((least[own[j]], d[r, j], r))
        r, j = r[order], j[order]
        keep = np.arange(len(r)) - np.searchsorted(r, r) < most
        found.append((group[r[keep]], own[j[keep]], d[r[keep], j[keep]]))
    n, v, d = (np.concatenate(x) for x in zip(*found, strict=True))

    def spread(sizes):  # each entry's number and place within its entry, repeated as often as its size
        at = np.repeat(np.arange(len(sizes)), sizes)
        return at, np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)

    at, place = spread(counts[v])
    n, d, near = n[at], d[at], ids[c_order[c_at[v[at]] + place]]
    order = np.lexsort((near, d, n))
    n, d, near = n[order], d[order], near[order]
    keep = np.arange(len(n)) - np.searchsorted(n, n) < k
    n, d, near = n[keep], d[keep], near[keep]
    starts, ends = (np.searchsorted(n, np.arange(len(wanted)), side) for side in ("left", "right"))
    sizes = np.diff(np.append(q_at, len(q)))
    of_row = np.repeat(np.arange(len(wanted)), sizes)  # the distinct query of every row, in order
    at, place = spread((ends - starts)[of_row])
    here = starts[of_row[at]] + place
    return q_order[at], near[here], d[here]


def l2_normalised(v: Column) -> Column:
    """The vector over its length; vectors of next to no length stay as they are."""
    size = norm(v)
    return F.when(size < 1e-8, v).otherwise(F.transform(v, lambda x: x / size))


def median_of(values: Column) -> Column:
    """The median of an array, the mean of the middle two for an even count."""
    n = F.size(values)
    middle = lambda a: (F.get(a, ((n - 1) / 2).cast("int")) + F.get(a, (n / 2).cast("int"))) / 2
    # Nulls are sorted last; without them the plain sort gives the same, much faster. The array is sorted once.
    ordered = F.when(F.exists(values, lambda x: x.isNull()), F.array_sort(values)).otherwise(F.sort_array(values))
    return F.get(F.transform(F.array(ordered), middle), 0)


def column_medians(rows: Column, dims: Column) -> Column:
    """Coordinate-wise medians of an array of vectors."""
    column = lambda d: F.transform(rows, lambda r: F.get(r, d))
    return F.transform(F.transform(F.sequence(F.lit(0), dims - 1), column), median_of)


class SparseRows:
    """Sparse rows of a block: the numbers and weights of row i lie from ``starts[i]`` to ``starts[i + 1]``."""

    def __init__(self, lengths: np.ndarray, numbers: np.ndarray, weights: np.ndarray):
        self.starts, self.numbers, self.weights = np.concatenate([[0], np.cumsum(lengths)]), numbers, weights

    def __len__(self) -> int:
        return len(self.starts) - 1

    @cached_property
    def postings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted numbers, the rows that hold them and their weights there."""
        order = np.argsort(self.numbers, kind="stable")
        return self.numbers[order], np.repeat(np.arange(len(self)), np.diff(self.starts))[order], self.weights[order]
