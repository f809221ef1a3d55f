"""Hand-computed cases and brute force for the distance, text and objective functions."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from contrapoint.functions import scores, series, text, vectors


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def arr(*x):
    return F.array(*[F.lit(float(v)) for v in x])


def test_vector_columns_equal_kernels(spark):
    rng = np.random.default_rng(0)
    a, b = rng.integers(-3, 3, (20, 5)).astype(float), rng.integers(-3, 3, (20, 5)).astype(float)
    a[0] = b[1] = 0
    df = spark.createDataFrame(
        [(i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(a, b, strict=True))], "i int, a array<double>, b array<double>"
    )
    for m in vectors.KERNELS:
        got = [r[0] for r in df.orderBy("i").select(vectors.distance(m, F.col("a"), F.col("b"))).collect()]
        assert np.allclose(got, np.diag(vectors.KERNELS[m](a, b))), m


def test_metric_names():
    assert vectors.metric_name("L2") == "euclidean" and vectors.metric_name("cityblock") == "manhattan"
    for f in (vectors.metric_name, series.metric_name, text.metric_name):
        with pytest.raises(ValueError):
            f("no such")
    assert text.encoder_name("sbert") == "bert" and text.encoder_name("raw_text") == "raw"


def test_text_case(spark):
    a, b = F.split(F.lit("a b c d"), " "), F.split(F.lit("a c d e"), " ")
    r1, r2, edits, sparse = one(spark, text.rouge_n(a, b, 1), text.rouge_n(a, b, 2), text.token_edits(a, b), text.edit_sparsity(a, b))
    assert (1 - r1, edits, sparse) == (0.25, 2, 0.5) and math.isclose(1 - r2, 2 / 3)
    assert text.lcs_length("a b c d".split(), "a c d e".split()) == 3
    assert text.rouge_l_similarity("a b c d".split(), "a c d e".split()) == 0.75
    assert math.isclose(text.bleu_similarity("a b c d".split(), "a c d e".split()), 7.07e-7, rel_tol=0.01)
    assert text.rouge_l_similarity([], []) == text.lcs_similarity([], []) == text.bleu_similarity([], []) == 1.0
    assert text.bleu_similarity(["a"], []) == 0.0


def _edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old, row = row, [0]
        for j, y in enumerate(b, 1):
            row.append(old[j - 1] + 1 if x == y else max(old[j], row[j - 1]))
    return row[-1]


def test_edits_and_lcs_by_recursion(spark):
    rng = random.Random(1)
    pairs = [
        ([f"w{rng.randrange(400)}" for _ in range(rng.randrange(30))], [f"w{rng.randrange(400 if i % 2 else 5)}" for _ in range(rng.randrange(30))])
        for i in range(60)
    ] + [([], []), (["a"], []), (["a"] * 9, ["a"] * 4)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    got = [r[0] for r in df.orderBy("i").select(text.token_edits(F.col("a"), F.col("b"))).collect()]
    assert got == [_edit(a, b) for a, b in pairs]
    assert [text.lcs_length(a, b) for a, b in pairs] == [_lcs(a, b) for a, b in pairs]
    for n in (1, 2):
        native = [r[0] for r in df.orderBy("i").select(text.rouge_n(F.col("a"), F.col("b"), n)).collect()]
        assert np.allclose(native, [text.rouge_n_similarity(n)(a, b) for a, b in pairs])


def _dtw(x, y, band):
    best = {(0, 0): 0.0}
    for i, j in itertools.product(range(1, len(x) + 1), range(1, len(y) + 1)):
        if abs(i - j) <= band:
            best[i, j] = (x[i - 1] - y[j - 1]) ** 2 + min(best.get(p, math.inf) for p in ((i - 1, j), (i, j - 1), (i - 1, j - 1)))
    return best.get((len(x), len(y)), math.inf)


def test_series_kernels():
    rng = np.random.default_rng(3)
    q, c = rng.random((3, 2, 12)), rng.random((4, 2, 12))
    want = [[sum(_dtw(a[ch], b[ch], int(0.25 * 12)) for ch in range(2)) for b in c] for a in q]
    assert np.allclose(series.dtw(list(q), list(c), 0.25), want)
    same = series.dtw(list(q), list(q), None)
    assert np.allclose(np.diag(same), 0) and np.allclose(same, same.T)
    assert np.allclose(np.diag(series.lcss(list(q), list(q))), 0)
    assert (series.dtw_dependent(list(q), list(c)) >= series.dtw(list(q), list(c), None) - 1e-9).all()
    far = series.lcss([[[0.0, 0, 0]]], [[[5.0, 5, 5]]])
    assert far[0, 0] == 1.0


def test_series_sparsity_case(spark):
    a = F.array(arr(0, 0, 0, 0), arr(0, 0, 0, 0))
    b = F.array(arr(1, 0, 0, 0), arr(1, 1, 1, 0))
    assert one(spark, series.sparsity(a, b), series.proximity(a, b)) == (0.5, 0.5)


def test_objective_cases(spark):
    a, b = arr(1, 2, 3, 4), arr(1, 2, 5, 8)
    assert one(spark, scores.tabular_proximity(a, b), scores.tabular_sparsity(a, b)) == (1.5, 0.5)
    assert one(
        spark, scores.outcome(F.lit(1), F.lit(0)), scores.outcome(F.lit(0), F.lit(0)), scores.outcome(F.lit(None).cast("int"), F.lit(0))
    ) == (1.0, 0.0, None)
    assert one(
        spark, scores.unit_interval(F.lit(5.0), F.lit(0.0), F.lit(4.0)), scores.unit_interval(F.lit(5.0), F.lit(4.0), F.lit(4.0))
    ) == (1.0, 0.5)
    part = {"a": F.lit(0.5), "b": F.lit(None).cast("double")}
    assert one(spark, scores.weighted(part, {}), scores.weighted(part, {}, True)) == (0.25, 0.5)
    assert one(spark, scores.merged_plausibility(F.lit(0.2), F.lit(0.4), 0.5, F.lit(0.9)))[0] == pytest.approx(0.6)
    assert one(spark, scores.image_sparsity(arr(0, 255, 128), arr(0, 0, 128), 0.1))[0] == pytest.approx(1 / 3)
    assert one(spark, scores.image_sparsity(arr(0, 1), F.lit(None).cast("array<double>"), 0.1))[0] == 1.0


def test_percentile_rank(spark):
    ref = [1.0, 2.0, 2.0, 5.0, float("nan")]
    rows = spark.createDataFrame([(x,) for x in (0.0, 1.0, 2.0, 3.0, 5.0, 9.0)], "v double")
    got = {r.v: r.p for r in scores.with_percentile_rank(rows, "v", spark.createDataFrame([(x,) for x in ref], "r double"), "r", "p").collect()}
    assert got == {0.0: 0.0, 1.0: 0.25, 2.0: 0.75, 3.0: 0.75, 5.0: 1.0, 9.0: 1.0}
    empty = spark.createDataFrame([], "r double")
    assert {r.p for r in scores.with_percentile_rank(rows, "v", empty, "r", "p").collect()} == {1.0}


def test_pruned_kernels_find_the_nearest():
    rng = np.random.default_rng(3)
    words = [[f"w{x}" for x in rng.integers(0, 12, rng.integers(0, 15))] for _ in range(40)]
    q, c = words[:8], words[8:]
    for name, similarity in text.SIMILARITIES.items():
        full = np.array([[1 - min(1.0, max(0.0, similarity(a, b))) for b in c] for a in q])
        assert np.allclose(text.kernel(name)(q, c), full), name
        few = text.kernel(name)(q, c, 4)
        for want, got in zip(full, few, strict=True):
            edge = np.sort(want)[3]
            assert np.allclose(got[want <= edge + 1e-12], want[want <= edge + 1e-12]) and (np.isinf(got) | np.isclose(got, want)).all(), name
    series_ = rng.integers(0, 5, (30, 3, 12)).astype(float)
    a, b = list(series_[:6]), list(series_[6:])
    for f in (series.dtw, series.dtw_dependent, series.lcss):
        full = f(a, b)
        for k in (1, 3, 24):
            few = f(a, b, k=k)
            for want, got in zip(full, few, strict=True):
                edge = np.sort(want)[k - 1]
                assert np.allclose(got[want <= edge], want[want <= edge]) and (np.isinf(got) | np.isclose(got, want)).all()
    assert series.dtw([], b).shape == (0, 24) and np.isfinite(series.dtw(a, [x[:, :9] for x in b], k=2)).any()


def test_aliases():
    assert vectors.metric_name("manhattan_distance") == "manhattan" and vectors.metric_name("hamming_distance") == "hamming"
    assert [
        series.metric_name(x)
        for x in ("ed", "euclid", "euclidean_distance", "dtw_distance", "lcss_distance")
    ] == ["euclidean"] * 3 + ["dtw", "lcss"]
    assert [text.encoder_name(x) for x in ("sentence-bert", "all-minilm-l6-v2", "word2vec_avg")] == ["bert", "minilm", "word2vec"]


def test_split_series_and_fusion(spark):
    df = spark.createDataFrame(
        [([[1.0, 2.0]], [[2.0, 2.0]], [[0.0, 0.0], [1.0, 1.0]], [[0.0, 0.0], [1.0, 4.0]], [7.0, 8.0])],
        "a array<array<double>>, b array<array<double>>, c array<array<double>>, d array<array<double>>, s array<double>"
    )
    pairs = [(F.col("a"), F.col("b")), (F.col("c"), F.col("d"))]
    r = df.select(
        series.split_proximity(pairs).alias("p"), series.split_sparsity(pairs).alias("s"),
        series.split_plausibility([(F.lit(3.0), F.col("a")), (F.lit(0.0), F.col("c"))]).alias("l"),
        series.fused(F.col("s"), F.col("a")).alias("f"), series.fused_compressed(F.col("s"), 2).alias("g")
    ).first()
    assert r.p == pytest.approx(4 / 6) and r.s == pytest.approx((0.5 + 0.25) / 2) and r.l == pytest.approx(1.0)
    assert r.f == [[7.0, 7.0], [8.0, 8.0], [1.0, 2.0]] and r.g == [[7.0, 7.0], [8.0, 8.0]]


def test_series_of_small_integers_are_warped_in_integers():
    rng = np.random.default_rng(6)
    q, c = rng.poisson(0.5, (9, 3, 10)).astype(float), rng.poisson(0.5, (70, 3, 10)).astype(float)
    assert series._kind(q, c)[0] is np.int16 and series._kind(q + 0.5, c)[0] is np.float64 and series._kind(q * 1e6, c)[0] is np.float64

    def plain(x, y, band):
        t = np.full((11, 11), np.inf)
        t[0, 0] = 0
        for i in range(1, 11):
            for j in range(max(1, i - band), min(10, i + band) + 1):
                t[i, j] = ((x[:, i - 1] - y[:, j - 1]) ** 2).sum() + min(t[i - 1, j], t[i, j - 1], t[i - 1, j - 1])
        return t[10, 10]

    for scale in (1, 40, 1e6, 0.1):
        a, b = q * scale, c * scale
        whole = np.array([[plain(x, y, 10) for y in b] for x in a])
        own = np.array([[sum(plain(x[h : h + 1], y[h : h + 1], 1) for h in range(3)) for y in b] for x in a])
        for k in (None, 4):
            got, apart = series.dtw_dependent(a, b, k=k), series.dtw(a, b, 0.1, k=k)
            assert np.allclose(np.sort(got, 1)[:, :4], np.sort(whole, 1)[:, :4]) and np.allclose(np.sort(apart, 1)[:, :4], np.sort(own, 1)[:, :4])
        assert np.allclose(series.euclidean_kernel(a, b), [[np.sqrt(((x - y) ** 2).sum(1)).sum() for y in b] for x in a])


def test_common_subsequences_by_bits_equal_the_table():
    rng = np.random.default_rng(7)
    for n, m in ((10, 10), (40, 40), (64, 50), (70, 70), (9, 33)):
        q, c = rng.normal(0, 1, (2, 2, n)), rng.normal(0, 1, (5, 2, m))
        band, want = int(0.2 * max(n, m)), np.zeros((2, 5))
        for a, b, h in np.ndindex(2, 5, 2):
            t = np.zeros((n + 1, m + 1), int)
            for i, j in np.ndindex(n, m):
                close = abs(i - j) <= band and abs(q[a, h, i] - c[b, h, j]) <= 0.3
                t[i + 1, j + 1] = t[i, j] + 1 if close else max(t[i, j + 1], t[i + 1, j])
            want[a, b] += 1 - t[n, m] / min(n, m)
        assert np.allclose(series.lcss(q, c, 0.2, 0.3), want)


def test_a_block_of_series_is_read_as_an_array():
    import pyarrow as pa

    from contrapoint.operators.search import _payload

    cube = np.arange(24.0).reshape(4, 2, 3)
    column = pa.chunked_array([pa.array(cube.tolist(), pa.list_(pa.list_(pa.float64())))])
    assert isinstance(_payload(column), np.ndarray) and (_payload(column) == cube).all() and (_payload(column.slice(1)) == cube[1:]).all()
    uneven = pa.chunked_array([pa.array([[[1.0], [2.0]], [[1.0, 2.0], [3.0]]], pa.list_(pa.list_(pa.float64())))])
    assert _payload(uneven) == uneven.to_pylist()


def test_products_keep_what_can_be_nearest():
    rng = np.random.default_rng(8)
    for scale, shift in ((1, 0), (1, 1e6), (1e-200, 0), (1e200, 0)):
        q, c = rng.normal(shift, 1, (20, 6)) * scale, rng.normal(shift, 1, (300, 6)) * scale
        c[100:120], c[120:140] = q, c[:20]
        want = np.stack([np.sqrt(((c - row) ** 2).sum(1)) for row in q])
        got = vectors.KERNELS["euclidean"](q, c, 5)
        edge = np.sort(want, 1)[:, 4:5]
        assert (got[want <= edge] == want[want <= edge]).all() and ((got == want) | np.isinf(got)).all()
        if shift == 0 and scale == 1:
            assert np.isinf(got).mean() > 0.9


@pytest.mark.parametrize("exclude_self", [False, True])
def test_nearest_by_products_equals_plain_distances(monkeypatch, exclude_self):
    from contrapoint.functions import products

    monkeypatch.setattr(products, "ROWS", 16)
    monkeypatch.setattr(products, "COLUMNS", 32)
    rng = np.random.default_rng(5)
    near = rng.normal(size=(150, 12))
    sides = [
        (rng.poisson(0.4, (70, 3, 6)).astype(float), rng.poisson(0.4, (150, 3, 6)).astype(float)), (near[:70], near), (near[:70] * 1e-3 + 1e4, near * 1e-3 + 1e4),
        (near[:70].round(0), near.round(0)),
    ]
    for q, c in sides:
        own, ids = np.arange(70) * 3, rng.permutation(150)
        for k, digits in ((1, None), (5, 9), (40, 1), (200, None)):
            got = products.nearest(products.fitting(q, c), own, ids, k, digits, exclude_self)
            want = []
            for i, row in enumerate(q):
                d = np.sqrt(((c - row) ** 2).sum(-1))
                d = d.sum(1) if d.ndim == 2 else d
                d = d if digits is None else d.round(digits)
                order = [j for j in np.lexsort((ids, d)) if not exclude_self or ids[j] != own[i]][:k]
                want += [(i, int(ids[j]), d[j]) for j in order]
            assert [(int(r), int(n)) for r, n, _ in zip(*got, strict=True)] == [w[:2] for w in want]
            assert got[2] == pytest.approx([w[2] for w in want])
    assert products.fitting(np.full((2, 3), np.nan), np.ones((2, 3))) is None and products.fitting(np.full((2, 2, 3), 0.5), np.ones((2, 2, 3))) is None


@pytest.mark.parametrize(("n", "m", "window"), [(9, 9, 0.2), (9, 9, None), (9, 9, 0.0), (6, 11, None), (1, 1, None), (20, 14, 0.4)])
@pytest.mark.parametrize("most", [2, 9, 60])
def test_small_counts_are_warped_by_diagonals(monkeypatch, n, m, window, most):
    """In a byte where a query's nearest fit, else in two; equal to plain warping, far pairs left out."""
    rng = np.random.default_rng(n + most)
    q, c = rng.integers(-1, most, (11, 2, n)).astype(float), rng.integers(-1, most, (70, 2, m)).astype(float)
    monkeypatch.setattr(series, "COLUMNS", 32)
    monkeypatch.setattr(series, "COSTS", 4000)  # the costs of few queries at a time
    monkeypatch.setattr(series, "_Warping", None)  # no pair is left to warping in cells
    found = [f(q, c, window, k=4) for f in (series.dtw, series.dtw_dependent)]
    monkeypatch.undo()
    for f, got in zip((series.dtw, series.dtw_dependent), found, strict=True):
        every = f(q, c, window)
        near = every <= np.partition(every, 3, axis=1)[:, 3:4]
        assert (got[near] == every[near]).all() and (np.isinf(got) | (got == every)).all()
    if n == m:
        band = n if window is None else int(window * n)
        assert np.isin(found[0], [np.inf, *{sum(_dtw(a[ch], b[ch], band) for ch in range(2)) for b in c for a in q}]).all()
