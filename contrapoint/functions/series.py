"""Time-series distances over channel-major series: arrays of channels, each an array of steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Other names of the metrics; default share of the steps that warping may stray, and default match width.
ALIASES = {
    "l2": "euclidean", "euclid": "euclidean", "euclidean_distance": "euclidean", "ed": "euclidean", "dynamic_time_warping": "dtw",
    "dtw_distance": "dtw", "longest_common_subsequence": "lcss", "lcss_distance": "lcss",
}
WINDOW, EPSILON = 0.10, 1.0


def metric_name(name: str) -> str:
    key = ALIASES.get(str(name).strip().lower(), str(name).strip().lower())
    if key not in ("euclidean", "dtw", "lcss", "dtw_dependent"):
        raise ValueError(f"unknown series metric {name!r}")
    return key


def euclidean(a: Column, b: Column) -> Column:
    """The sum over channels of the euclidean distance, inside the JVM."""
    one = lambda x, y: F.sqrt(F.aggregate(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))
    return F.aggregate(F.zip_with(a, b, one), F.lit(0.0), lambda s, v: s + v)


def _band(n: int, m: int, window: float | None) -> int:
    """Half width of the band round the diagonal: the window's share of the longer series, rounded down."""
    return max(n, m) if window is None else int(window * max(n, m))


def warp(costs, n: int, m: int, count: int, window: float | None, kind=np.float64, far=np.inf) -> np.ndarray:
    """Dynamic time warping for ``count`` pairs at once; ``costs(i, a, b)`` gives all pairs' local costs of step i and steps a to b.

    The sum of squared local costs along the best path, without a final root. ``far``, in numbers of ``kind``, is above any
    path's sum.
    """
    band = _band(n, m, window)
    before, now, best = (np.empty((m + 1, count), kind) for _ in range(3))
    rows, next_rows, best_rows = list(before), list(now), list(best)
    before[0], before[1:], low, high = 0, far, 0, 0
    for i in range(1, n + 1):
        middle, was = i * m / n, (low, high)
        low = max(1, int(np.ceil(middle - band)) if window is not None else 1)
        high = min(m, int(np.floor(middle + band)) if window is not None else m)
        before[max(was[1] + 1, low - 1) : high + 1] = far
        before[low - 1 : was[0]] = far
        np.minimum(before[low : high + 1], before[low - 1 : high], out=best[low : high + 1])
        last = next_rows[low - 1]
        last[:] = far
        for least, local, cell in zip(best_rows[low : high + 1], costs(i - 1, low - 1, high), next_rows[low : high + 1], strict=True):
            np.minimum(least, last, cell)
            np.add(cell, local, cell)
            last = cell
        before, now, rows, next_rows = now, before, next_rows, rows
    out = before[m].astype(np.float64)
    return out if far == np.inf else np.where(out >= far, np.inf, out)


def _stacked(batch) -> np.ndarray:
    return np.asarray(batch, np.float64)


#: Pairs that are warped together, pairs whose bounds are held together, candidates taken at a time and pairs of those with
#: queries warped together, and bytes of costs remembered meanwhile.
PAIRS, BOUNDS, WIDTH, TOGETHER, COSTS = 20_000, 1_000_000, 4096, 32_768, 1 << 27
#: Queries on which bounds are tried, and the share of pairs above which they are not worth their while.
TRIED, WORTH = 8, 0.125
#: Candidates whose diagonals are worked on together, and cells of a step and channel above which bounds are tried before warping.
COLUMNS, CELLS = 4096, 128


def _envelope(x: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Each step's highest and lowest value within ``band`` steps."""
    steps = x.shape[-1]
    sides = [(max(0, t - band), min(steps, t + band + 1)) for t in range(steps)]
    return np.stack([x[..., a:b].max(-1) for a, b in sides], -1), np.stack([x[..., a:b].min(-1) for a, b in sides], -1)


def _nearest(q: np.ndarray, c: np.ndarray, k: int | None, bound, exact, dense) -> np.ndarray:
    """A block of distances; with ``k``, only those that can be among a query's k least, the others may be infinite.

    ``bound(i)`` gives query i's lower bounds, ``exact(qi, ci)`` the distances of pairs, ``dense(i, j)`` those of queries i to j
    and all candidates. The k least bounds are taken first; then whatever bound does not exceed the k-th distance found. Where the
    first queries' bounds leave too many pairs, all are worked out.
    """
    out = np.full((len(q), len(c)), np.inf)

    def fill(qi: np.ndarray, ci: np.ndarray) -> None:
        for s in range(0, len(qi), PAIRS):
            a, b = qi[s : s + PAIRS], ci[s : s + PAIRS]
            out[a, b] = exact(a, b)

    at = 0
    while k is not None and k < len(c) and bound is not None and at < len(q):
        rows = min(len(q) - at, max(1, BOUNDS // len(c)), len(q) if at else TRIED)
        low = np.stack([bound(n) for n in range(at, at + rows)])
        first = np.argpartition(low, k - 1, axis=1)[:, :k]
        fill(np.repeat(np.arange(rows) + at, k), first.ravel())
        edge = np.take_along_axis(out[at : at + rows], first, 1).max(1)
        left = low <= edge[:, None] + 1e-8
        if not at and left.mean() > WORTH:
            break
        n, j = np.nonzero(left & np.isinf(out[at : at + rows]))
        fill(n + at, j)
        at += rows
    group = max(1, TOGETHER // min(len(c), WIDTH))
    for i in range(at, len(q), group):
        out[i : i + group] = dense(i, min(i + group, len(q)))
    return out


def _kind(qs: np.ndarray, cs: np.ndarray) -> tuple:
    """The numbers to warp in, and one above any path's sum: small integers where values are integers, else doubles."""
    if qs.size and cs.size and all(np.isfinite(x).all() and (np.trunc(x) == x).all() for x in (qs, cs)):
        widest = max(qs.max(), cs.max()) - min(qs.min(), cs.min())
        far = (qs.shape[2] + cs.shape[2]) * qs.shape[1] * widest**2 + 1
        for kind in (np.int16, np.int32):
            if 2 * far < np.iinfo(kind).max and max(np.abs(qs).max(), np.abs(cs).max()) < np.iinfo(kind).max / 2:
                return kind, int(far)
    return np.float64, np.inf


def _diagonals(n: int, m: int, window: float | None) -> list[tuple[int, int]]:
    """The first and last step of the first series on each diagonal of the table, from the sum of steps 2 on; (1, 0) for none."""
    band, rows = _band(n, m, window), [[] for _ in range(n + m + 1)]
    for i in range(1, n + 1):
        low = max(1, int(np.ceil(i * m / n - band))) if window is not None else 1
        high = min(m, int(np.floor(i * m / n + band))) if window is not None else m
        for j in range(low, high + 1):
            rows[i + j].append(i)
    return [(x[0], x[-1]) if x else (1, 0) for x in rows[2:]]


class _Counts:
    """Warping of small whole numbers by diagonals in one or two bytes; paths of ``limit`` or more count as infinite.

    ``groups`` are the channels of each path. Costs and sums are cut at the limit, so a sum below it met no cut.
    """

    def __init__(self, qs: np.ndarray, cs: np.ndarray, groups: list[slice], window: float | None, kind):
        self.n, self.m, self.groups, self.kind, self.limit = qs.shape[2], cs.shape[2], groups, kind, np.iinfo(kind).max // 2
        self.spans, low = _diagonals(self.n, self.m, window), min(qs.min(), cs.min())
        self.steps, self.other = (qs - low).transpose(0, 2, 1).astype(np.int32), (cs - low).transpose(1, 2, 0).astype(np.int32)

    @staticmethod
    def fit(qs: np.ndarray, cs: np.ndarray) -> bool:
        whole = all(np.isfinite(x).all() and (np.trunc(x) == x).all() for x in (qs, cs))
        return whole and qs.shape[1] * (max(qs.max(), cs.max()) - min(qs.min(), cs.min())) ** 2 < 2**31

    def near(self, first: int, last: int) -> np.ndarray:
        """The distances of queries first to last and all candidates, those of ``limit`` or more infinite."""
        out = np.empty((last - first, self.other.shape[2]))
        for at in range(0, out.shape[1], COLUMNS):
            self._part(first, last, self.other[:, :, at : at + COLUMNS], out[:, at : at + COLUMNS])
        return out

    def _part(self, first: int, last: int, part: np.ndarray, out: np.ndarray) -> None:
        count, numbers, points = part.shape[2], [], []
        for g in self.groups:
            distinct, number = np.unique(self.steps[first:last, :, g].reshape(-1, len(range(self.steps.shape[2])[g])), axis=0, return_inverse=True)
            numbers.append(number.reshape(last - first, self.n) + len(points))
            points += [(g, x) for x in distinct]
        if last - first > 1 and len(points) * self.m * count * self.kind().nbytes > COSTS:
            middle = (first + last) // 2
            self._part(first, middle, part, out[: middle - first])
            self._part(middle, last, part, out[middle - first :])
            return
        table = np.empty((len(points), self.m, count), self.kind)  # the costs of each distinct point and the candidates' steps
        cap, squares, channels = np.full(part.shape[1:], self.limit, self.kind), {}, range(len(part))
        for row, (g, x) in zip(table, points, strict=True):
            for nth, (ch, v) in enumerate(zip(channels[g], x.tolist(), strict=True)):
                if (known := squares.get((ch, v))) is None:
                    if (len(squares) + 1) * row.nbytes > COSTS:
                        squares.clear()
                    known = squares[ch, v] = np.minimum(np.square(part[ch] - v), self.limit).astype(self.kind)
                if nth:
                    np.add(row, known, out=row)
                    np.minimum(row, cap, out=row)
                else:
                    row[:] = known
        # A diagonal adds the largest cost at most, so that sums are cut every so many only.
        often = max(1, (np.iinfo(self.kind).max - self.limit) // max(1, int(table.max())))
        table, paths = table.reshape(-1, count), len(self.groups)
        most = np.full((self.n, paths, count), self.limit, self.kind)  # an array, as numpy is slow to compare with one number
        lines = np.stack(numbers, 2) * self.m  # queries x steps x paths
        held, local = np.empty((3, self.n + 2, paths, count), self.kind), np.empty((self.n, paths, count), self.kind)
        plan, steps, others = [], [], []
        for d, (a, b) in enumerate(self.spans, 2):
            before, prior, now = (held[x % 3] for x in (d - 2, d - 1, d))
            after = [x for x in self.spans[d - 1 : d + 1] if x[0] <= x[1]]  # the next two diagonals read these
            low, high = min([a, *[x for x, _ in after]]) - 1, max([b, *[x for _, x in after]])
            if a > b:
                plan.append((None, [now[low : high + 1]]))
                continue
            cells, cut = slice(len(steps), len(steps) + b - a + 1), most[: b - a + 1] if d % often == 0 else None
            steps += range(a - 1, b)
            others += range(d - a - 1, d - b - 2, -1)
            work = (cells, local[: b - a + 1], prior[a - 1 : b], prior[a : b + 1], before[a - 1 : b], now[a : b + 1], cut)
            plan.append((work, [x for x in (now[low:a], now[b + 1 : high + 1]) if len(x)]))
        others, last_row = np.array(others)[:, None], held[(self.n + self.m) % 3, self.n]
        for line, row in zip(lines, out, strict=True):
            held[:2].fill(self.limit)
            held[0, 0] = 0
            places = line[steps] + others
            for work, edges in plan:
                if work is not None:
                    cells, cost, above, left, across, now, cut = work
                    np.take(table, places[cells], axis=0, out=cost, mode="clip")
                    np.minimum(above, left, out=now)
                    np.minimum(now, across, out=now)
                    if cut is not None:
                        np.minimum(now, cut, out=now)
                    np.add(now, cost, out=now)
                for edge in edges:
                    edge.fill(self.limit)
            total = last_row.sum(0, dtype=np.int32)
            row[:] = total
            row[total >= self.limit] = np.inf


def _by_counts(qs: np.ndarray, cs: np.ndarray, groups: list[slice], k: int | None, window: float | None) -> np.ndarray | None:
    """A block of distances by ``_Counts``, infinite where they can't be among a query's k least; None if most don't fit its numbers."""
    if k is None or k >= len(cs) or not _Counts.fit(qs, cs) or max(b - a + 1 for a, b in _diagonals(qs.shape[2], cs.shape[2], window)) > CELLS:
        return None
    out, left = np.empty((len(qs), len(cs))), np.arange(len(qs))
    for kind in (np.uint8, np.uint16):
        of, lack = _Counts(qs[left], cs, groups, window, kind), []
        for a, b in [(0, min(TRIED, len(left))), (TRIED, len(left))]:
            if a < b:
                found = of.near(a, b)
                out[left[a:b]] = found
                lack.append(np.isfinite(found).sum(1) < k)
                if not a and lack[0].mean() > 0.5:
                    lack.append(np.ones(len(left) - b, bool))
                    break
        left = left[np.concatenate(lack)]
        if not len(left):
            return out
    return None


def _squares(x, y) -> np.ndarray:
    """Sums over the first axis of squared differences."""
    out = None
    for a, b in zip(x, y, strict=True):
        d = a - b
        np.multiply(d, d, out=d)
        out = d if out is None else np.add(out, d, out=out)
    return out


class _Warping:
    """Warping distances along one path for all channels (rows x channels x steps), of pairs or of queries and all candidates."""

    def __init__(self, qs: np.ndarray, cs: np.ndarray, window: float | None):
        self.kind, self.far = _kind(qs, cs)
        self.steps, self.whole = qs.transpose(0, 2, 1).astype(self.kind), np.ascontiguousarray(cs.transpose(1, 2, 0).astype(self.kind))
        self.size, self.window, self.held = (qs.shape[2], cs.shape[2]), window, {}

    def exact(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = np.ascontiguousarray(self.steps[a].transpose(1, 2, 0)), np.ascontiguousarray(self.whole[:, :, b])
        return warp(lambda i, s, e: _squares(x[i][:, None], y[:, s:e]), *self.size, len(a), self.window, self.kind, self.far)

    def dense(self, first: int, last: int) -> np.ndarray:
        parts = []
        for at in range(0, self.whole.shape[2], WIDTH):
            part = self.whole[:, :, at : at + WIDTH]
            local = np.empty((self.size[1], last - first, part.shape[2]), self.kind)

            def costs(step, s, e, at=at, part=part, local=local):
                for g in range(last - first):
                    x = self.steps[first + g, step]
                    if self.kind is np.float64:
                        local[s:e, g] = _squares(x, part[:, s:e])
                        continue
                    if (known := self.held.get(key := (at, x.tobytes()))) is None:  # small integers recur
                        known = _squares(x, part)
                        if (len(self.held) + 1) * known.nbytes > COSTS:
                            self.held.clear()
                        self.held[key] = known
                    local[s:e, g] = known[s:e]
                return local[s:e].reshape(e - s, (last - first) * part.shape[2])

            found = warp(costs, *self.size, (last - first) * part.shape[2], self.window, self.kind, self.far)
            parts.append(found.reshape(last - first, -1))
        return np.concatenate(parts, 1)


def _keogh(q: np.ndarray, c: np.ndarray, window: float | None):
    """Lower bounds of warping (Keogh, 2002): what lies outside the envelope of the steps that may be met. Equal lengths only."""
    if q.shape[2] != c.shape[2]:
        return None
    high, low = _envelope(q, _band(q.shape[2], c.shape[2], window))
    return lambda i: ((np.maximum(c - high[i], 0) + np.maximum(low[i] - c, 0)) ** 2).sum((1, 2))


def dtw(q: list, c: list, window: float | None = WINDOW, k: int | None = None) -> np.ndarray:
    """The sum over channels of each channel's own warping distance."""
    if not len(q) or not len(c):
        return np.zeros((len(q), len(c)))
    qs, cs = _stacked(q), _stacked(c)
    if (found := _by_counts(qs, cs, [slice(ch, ch + 1) for ch in range(qs.shape[1])], k, window)) is not None:
        return found
    pairs = [_Warping(qs[:, ch : ch + 1], cs[:, ch : ch + 1], window) for ch in range(qs.shape[1])]
    return _nearest(
        qs, cs, k, _keogh(qs, cs, window), lambda a, b: sum(p.exact(a, b) for p in pairs), lambda i, j: sum(p.dense(i, j) for p in pairs)
    )


def dtw_dependent(q: list, c: list, window: float | None = None, k: int | None = None) -> np.ndarray:
    """One warping path for all channels together, by default without a window."""
    if not len(q) or not len(c):
        return np.zeros((len(q), len(c)))
    qs, cs = _stacked(q), _stacked(c)
    if (found := _by_counts(qs, cs, [slice(None)], k, window)) is not None:
        return found
    pairs = _Warping(qs, cs, window)
    return _nearest(qs, cs, k, _keogh(qs, cs, window), pairs.exact, pairs.dense)


def lcss(q: list, c: list, window: float | None = WINDOW, epsilon: float = EPSILON, k: int | None = None) -> np.ndarray:
    """The sum over channels of 1 - matched steps / shorter length; steps match within ``epsilon``.

    With ``k``, the bound counts the steps that have any value to match within the window.
    """
    if not len(q) or not len(c):
        return np.zeros((len(q), len(c)))
    qs, cs = _stacked(q), _stacked(c)
    n, m = qs.shape[2], cs.shape[2]
    band = _band(n, m, window)

    def exact(a, b):
        out = np.zeros(len(a))
        for ch in range(qs.shape[1]):
            x, y = np.ascontiguousarray(qs[a, ch].T), np.ascontiguousarray(cs[b, ch].T)
            before = np.zeros((m + 1, len(a)))
            for i in range(1, n + 1):
                now = np.zeros((m + 1, len(a)))
                for j in range(1, m + 1):
                    now[j] = np.maximum(before[j], now[j - 1])
                    if abs(i - j) <= band:
                        match = np.abs(x[i - 1] - y[j - 1]) <= epsilon
                        now[j] = np.where(match, before[j - 1] + 1, now[j])
                before = now
            out += 1 - before[m] / min(n, m)
        return out

    if m <= 64:  # a candidate's steps as bits: by addition (Hyyro, 2004) a query's step takes all candidates at once
        word = np.uint32 if m <= 32 else np.uint64
        bits = word(1) << np.arange(m, dtype=word)
        full, out, channels = word(bits.sum(dtype=word)), np.empty((len(qs), len(cs))), qs.shape[1]
        inside = [word(bits[max(0, i - band) : i + band + 1].sum(dtype=word)) for i in range(n)]
        for at in range(0, len(cs), COLUMNS):
            part, hits = cs[at : at + COLUMNS], {}
            state, now, less = (np.empty((channels, len(part)), word) for _ in range(3))
            for row, steps in zip(out, qs, strict=True):
                state[:] = full
                for i, values in enumerate(steps.T.tolist()):
                    for ch, v in enumerate(values):
                        if (hit := hits.get((ch, v, i))) is None:
                            if (len(hits) + 1) * now[0].nbytes > COSTS:
                                hits.clear()
                            if (every := hits.get((ch, v))) is None:
                                every = hits[ch, v] = np.where(np.abs(v - part[:, ch]) <= epsilon, bits, word(0)).sum(1, dtype=word)
                            hit = hits[ch, v, i] = every & inside[i]
                        np.bitwise_and(state[ch], hit, out=now[ch])
                    np.subtract(state, now, out=less)
                    np.add(state, now, out=state)  # what goes beyond the steps' bits stays there
                    np.bitwise_or(state, less, out=state)
                matched = m - np.bitwise_count(state & full).astype(np.int64)
                row[at : at + COLUMNS] = sum((1 - x / min(n, m) for x in matched), np.zeros(len(part)))
        return out

    high, low = _envelope(qs, band)

    def bound(i):
        return (1 - np.minimum(((cs <= high[i] + epsilon) & (cs >= low[i] - epsilon)).sum(2), n) / n).sum(1)

    every = np.arange(len(cs))
    return _nearest(qs, cs, k, bound if n == m else None, exact, lambda i, j: np.stack([
        np.concatenate([exact(np.full(len(b), x), b) for b in np.split(every, range(PAIRS, len(cs), PAIRS))]) for x in range(i, j)
    ]))


def euclidean_kernel(q: list, c: list, k: int | None = None) -> np.ndarray:
    """Sums over channels of euclidean distances; integers, whose products are exact in any order, by matrix products."""
    if not len(q) or not len(c):
        return np.empty((len(q), len(c)))
    qs, cs = _stacked(q), _stacked(c)
    if _kind(qs, cs)[0] is not np.float64:
        out = np.zeros((len(qs), len(cs)))
        for ch in range(qs.shape[1]):
            x, y = np.ascontiguousarray(qs[:, ch]), np.ascontiguousarray(cs[:, ch])
            out += np.sqrt((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * (x @ y.T))
        return out
    return np.stack([np.sqrt(((cs - s) ** 2).sum(2)).sum(1) for s in qs])


KERNELS = {"euclidean": euclidean_kernel, "dtw": dtw, "lcss": lcss, "dtw_dependent": dtw_dependent}


def time_mean(series: Column) -> Column:
    """The mean over time of each channel."""
    return F.transform(series, lambda ch: F.aggregate(ch, F.lit(0.0), lambda s, v: s + v) / F.size(ch))


def proximity(a: Column, b: Column) -> Column:
    """The mean absolute difference over all channels and steps."""
    gaps = F.flatten(F.zip_with(a, b, lambda x, y: F.zip_with(x, y, lambda p, q: F.abs(p - q))))
    return F.aggregate(gaps, F.lit(0.0), lambda s, v: s + v) / F.size(gaps)


def sparsity(a: Column, b: Column, tau: Column | None = None) -> Column:
    """The mean over channels of the share of steps that differ by more than the channel's ``tau`` (else by anything)."""
    tau = F.transform(a, lambda ch: F.lit(0.0)) if tau is None else tau
    triples = F.arrays_zip(a.alias("a"), b.alias("b"), tau.alias("t"))
    share = F.transform(
        triples,
        lambda z: F.aggregate(
            F.zip_with(z["a"], z["b"], lambda p, q: (F.abs(p - q) > z["t"]).cast("double")), F.lit(0.0), lambda s, v: s + v
        ) / F.size(z["a"])
    )
    return F.aggregate(share, F.lit(0.0), lambda s, v: s + v) / F.size(share)


def split_proximity(parts: list[tuple[Column, Column]]) -> Column:
    """The mean absolute difference over all values of several series together, such as laboratory values and medication."""
    size = sum((F.size(F.flatten(a)) for a, _ in parts), F.lit(0))
    return sum((proximity(a, b) * F.size(F.flatten(a)) for a, b in parts), F.lit(0.0)) / size


def split_sparsity(parts: list[tuple[Column, Column]], taus: list[Column | None] | None = None) -> Column:
    """The mean of several series' sparsity."""
    taus = taus or [None] * len(parts)
    return sum((sparsity(a, b, t) for (a, b), t in zip(parts, taus, strict=True)), F.lit(0.0)) / len(parts)


def split_plausibility(parts: list[tuple[Column, Column]]) -> Column:
    """Several series' plausibility weighted by their numbers of values: pairs of (score, series)."""
    sizes = [F.greatest(F.size(F.flatten(s)), F.lit(1)) for _, s in parts]
    return sum((p * n for (p, _), n in zip(parts, sizes, strict=True)), F.lit(0.0)) / sum(sizes, F.lit(0))


def fused(static: Column, own: Column) -> Column:
    """One series of a static vector's constant channels and a series' own channels (from neighbours of either, or from parts)."""
    return F.concat(repeat_static(static, F.size(F.get(own, F.lit(0)))), own)


def fused_compressed(values: Column, steps: int) -> Column:
    """The same from a vector of static values and then channel means, all of them constant."""
    return repeat_static(values, F.lit(steps))


def repeat_static(static: Column, steps: Column) -> Column:
    """A static vector as constant channels of so many steps."""
    return F.transform(static, lambda x: F.array_repeat(x, steps))


def split_columns(series: Column, first: int) -> tuple[Column, Column]:
    """Channel-major series cut into the first channels and the rest, the rest reduced to its first step."""
    return F.slice(series, 1, first), F.transform(F.slice(series, first + 1, F.greatest(F.size(series) - first, F.lit(0))), lambda ch: F.get(ch, 0))


def concatenated(static: Column, first: Column, second: Column | None = None, text: Column | None = None, sequence: bool = False) -> Column:
    """One sample of all parts as a channel-major series: the static vector, one or two series, and a text's vector.

    The static and the text's values are repeated over the steps; a text given as a ``sequence`` of vectors counts by their
    mean. Null where a part is, or where the two series are of different lengths.
    """
    steps = F.size(F.get(first, F.lit(0)))
    parts = [repeat_static(static, steps), first]
    if second is not None:
        parts.append(F.when(F.size(F.get(second, F.lit(0))) == steps, second))
    if text is not None:
        if sequence:
            total = F.aggregate(F.slice(text, 2, F.greatest(F.size(text) - 1, F.lit(0))), F.get(text, F.lit(0)), lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
            text = F.transform(total, lambda x: x / F.size(text))
        parts.append(repeat_static(text, steps))
    return F.concat(*parts)
