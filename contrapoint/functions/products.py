"""The k nearest rows by matrix products: bounds of all distances from below, exact ones of the few pairs that these leave."""

from __future__ import annotations

import numpy as np

#: Queries and candidates of a step, whose bounds stay in a core's cache.
ROWS, COLUMNS = 256, 2048
#: The share of a step's pairs, after a query's first step, above which bounds are made finer.
MANY = 0.05
#: Whole numbers below this are exact in 32 bits of a matrix product.
WHOLE = 2.0**24


class Vectors:
    """Euclidean distances of vectors; the bounds' rounding errors, in 32 or 64 bits, are bounded by the vectors' sizes."""

    def __init__(self, q: np.ndarray, c: np.ndarray, kind=np.float32):
        self.q, self.c, self.kind = q, c, kind
        self.size, size_c = (q * q).sum(1), (c * c).sum(1)
        most = float(size_c.max(initial=0.0))
        self.left = np.hstack([-2 * q, np.ones((len(q), 1))]).astype(kind)
        self.right = np.ascontiguousarray(np.hstack([c, size_c[:, None]]).astype(kind).T)
        self.slip = 2 * (q.shape[1] + 16) * float(np.finfo(kind).eps) * (self.size + 2 * most)

    @staticmethod
    def fit(q: np.ndarray, c: np.ndarray) -> bool:
        return all(np.isfinite(x).all() and np.abs(x).max(initial=0.0) < 1e15 for x in (q, c)) and q.shape[1] == c.shape[1]

    def finer(self):
        """The same in 64 bits, where 32 leave too many pairs."""
        return self if self.kind is np.float64 else Vectors(self.q, self.c, np.float64)

    def low(self, rows: slice, columns: slice) -> np.ndarray:
        """Squares less those of the queries."""
        return self.left[rows] @ self.right[:, columns]

    def limit(self, rows: slice, edge: np.ndarray) -> np.ndarray:
        """What ``low`` does not exceed where a distance is ``edge`` at most."""
        return edge * edge + self.slip[rows] - self.size[rows]

    def exact(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.c[b] - self.q[a]) ** 2).sum(1))


class Counts:
    """Sums over channels of euclidean distances of series of whole numbers, whose squares are exact in 32 bits."""

    def __init__(self, q: np.ndarray, c: np.ndarray):
        self.q, self.c, self.left, self.right = q, c, [], []
        for ch in range(q.shape[1]):
            x, y = q[:, ch], c[:, ch]
            self.left.append(np.hstack([-2 * x, (x * x).sum(1)[:, None], np.ones((len(x), 1))]).astype(np.float32))
            self.right.append(np.ascontiguousarray(np.hstack([y, np.ones((len(y), 1)), (y * y).sum(1)[:, None]]).astype(np.float32).T))

    @staticmethod
    def fit(q: np.ndarray, c: np.ndarray) -> bool:
        if q.shape[1:] != c.shape[1:] or not all(np.isfinite(x).all() and (np.trunc(x) == x).all() for x in (q, c)):
            return False
        size = lambda x: np.sqrt((x * x).sum(2).max(initial=0.0))
        return (size(q) + size(c)) ** 2 < WHOLE

    def finer(self):
        return self

    def low(self, rows: slice, columns: slice) -> np.ndarray:
        out = None
        for left, right in zip(self.left, self.right, strict=True):
            d = left[rows] @ right[:, columns]
            np.sqrt(d, out=d)
            out = d if out is None else np.add(out, d, out=out)
        return out

    def limit(self, rows: slice, edge: np.ndarray) -> np.ndarray:
        return edge * (1 + 1e-5)

    def exact(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a))
        for ch in range(self.q.shape[1]):
            out += np.sqrt(((self.c[b, ch] - self.q[a, ch]) ** 2).sum(1))
        return out


def fitting(q, c):
    """The distances of a kind that fits both sides, or None."""
    if not isinstance(q, np.ndarray) or not isinstance(c, np.ndarray) or q.ndim != c.ndim or not len(q) or not len(c):
        return None
    kind = {2: Vectors, 3: Counts}.get(q.ndim)
    return kind(q, c) if kind and kind.fit(q, c) else None


def nearest(of, own: np.ndarray, ids: np.ndarray, k: int, digits: int | None = None, exclude_self: bool = False):
    """(rows of queries, candidates' ids, distances) of each query's k nearest, ties to smaller ids; ``of`` are their distances.

    With ``digits`` distances are rounded before they are compared. With ``exclude_self`` no query meets a candidate of its id.
    """
    slack = 1e-12 if digits is None else 1.01 * 10.0**-digits
    out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    by_id = np.argsort(ids, kind="stable") if exclude_self else None

    def measured(a, b):
        d = np.concatenate([np.empty(0), *[of.exact(a[s : s + 16_384], b[s : s + 16_384]) for s in range(0, len(a), 16_384)]])
        return d if digits is None else d.round(digits)

    for at in range(0, len(own), ROWS):
        rows = slice(at, min(at + ROWS, len(own)))
        n = rows.stop - at
        best, names, edge = np.full((n, k), np.inf), np.zeros((n, k), np.int64), np.full(n, np.inf)
        if exclude_self:
            first, last = (np.searchsorted(ids, own[rows], side, sorter=by_id) for side in ("left", "right"))
            count = last - first
            twins = np.repeat(np.arange(n), count)
            place = by_id[np.repeat(first - np.cumsum(count) + count, count) + np.arange(len(twins))]
        for s in range(0, len(ids), COLUMNS):
            columns = slice(s, min(s + COLUMNS, len(ids)))
            low = of.low(rows, columns)
            here = (twins[m := (place >= s) & (place < columns.stop)], place[m] - s) if exclude_self else ()
            if here:
                low[here] = np.inf
            if low.shape[1] > k and np.isinf(edge).any():  # the distances of the k least bounds are enough to begin with
                some = np.argpartition(low, k - 1, axis=1)[:, :k]
                r = np.flatnonzero(np.isinf(edge) & np.isfinite(np.take_along_axis(low, some, 1)).all(1))
                edge[r] = measured(np.repeat(r, k) + at, some[r].ravel() + s).reshape(-1, k).max(1)
            limit = np.nextafter(of.limit(rows, edge * (1 + 1e-12) + slack).astype(low.dtype), low.dtype.type(np.inf))
            hit = low <= limit[:, None]
            if here:
                hit[here] = False
            r, j = np.nonzero(hit)
            if not len(r):
                continue
            if s and len(r) > MANY * hit.size:
                of = of.finer()
            d, near, old = measured(r + at, j + s), ids[j + s], np.unique(r)
            kept = np.isfinite(best[old])
            r, near, d = np.concatenate([r, np.repeat(old, kept.sum(1))]), np.concatenate([near, names[old][kept]]), np.concatenate([d, best[old][kept]])
            order = np.lexsort((near, d, r))
            r, near, d = r[order], near[order], d[order]
            nth = np.arange(len(r)) - np.searchsorted(r, r)
            r, near, d, nth = (x[nth < k] for x in (r, near, d, nth))
            best[r, nth], names[r, nth] = d, near
            edge[old] = np.minimum(edge[old], best[old, k - 1])
        r, nth = np.nonzero(np.isfinite(best))
        out.append((r + at, names[r, nth], best[r, nth]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def alike(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each distinct row, and each row's number among these."""
    seen: dict[bytes, int] = {}
    number = np.array([seen.setdefault(x.tobytes(), len(seen)) for x in rows + 0.0], np.int64)
    return np.unique(number, return_index=True)[1], number
