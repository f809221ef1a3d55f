"""Hand-computed cases, properties and brute force for the operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from contrapoint.functions import scores
from contrapoint.operators import analytics, baselines, combine, encoders, lof, preprocess
from contrapoint.operators.search import check_queries, knn
from contrapoint.plans import catalog, generators, sweep
from contrapoint.sources import tables
from contrapoint.sources.dataset import Dataset

TRAIN = [(0, 0, [0.0]), (1, 1, [3.0]), (2, 0, [2.0]), (3, 0, [4.0]), (4, 0, [9.0])]


@pytest.fixture(scope="module")
def train(spark):
    return spark.createDataFrame(TRAIN, "sample_id long, label int, value array<double>")


@pytest.fixture(scope="module")
def query(spark):
    return spark.createDataFrame([(7, [3.0])], "sample_id long, value array<double>")


def near(query, train, k, target=0):
    return knn(query, train.where(F.col("label") == target), k)


def test_ranks_and_medians(query, train):
    got = [tuple(r) for r in near(query, train, 4).orderBy("rank").collect()]
    assert got == [(7, 2, 1, 1.0), (7, 3, 2, 1.0), (7, 0, 3, 3.0), (7, 4, 4, 6.0)]
    for step, want in (("odd", [2, 2, 3, 3]), ("step", [2, 3, 2, 3])):
        rows = combine.progressive_medians(near(query, train, 4), train, step).orderBy("cand_rank").collect()
        assert [r.value[0] for r in rows] == want and [r.anchor_id for r in rows] == [2, 3, 0, 4]
    assert near(query, train, 10).count() == 4 and near(query, train, 3, 7).count() == 0
    with pytest.raises(ValueError):
        near(query, train, 0)


def test_knn_by_brute_force_over_many_tiles(spark, monkeypatch):
    from contrapoint.operators import search

    monkeypatch.setattr(search, "QUERY_BLOCK", 7)
    monkeypatch.setattr(search, "SHARD", 11)
    x = np.random.default_rng(0).integers(0, 4, (60, 3)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "sample_id long, value array<double>")
    got = {(r.query_id, r.rank): r.train_id for r in knn(df, df, 4, exclude_self=True).collect()}
    for i in range(60):
        order = sorted((float(((x[i] - x[j]) ** 2).sum()), j) for j in range(60) if j != i)
        assert [got[i, r] for r in range(1, 5)] == [j for _, j in order[:4]]


def test_query_ids(spark, train):
    assert [r.sample_id for r in check_queries(train, [3, 0, 3]).collect()] == [3, 0, 3]
    with pytest.raises(IndexError):
        check_queries(train, [99])


def lists(spark, rows):
    return spark.createDataFrame([(7, t, float(d), r) for r, (t, d) in enumerate(rows, 1)], "query_id long, train_id long, distance double, rank int")


def test_consensus_case(spark):
    a, b = lists(spark, [(1, 1), (3, 1), (0, 3)]), lists(spark, [(4, 0), (0, 0.5), (3, 2)])
    a = lists(spark, [(2, 1), (3, 1), (0, 3)])
    assert [(r.train_id, r.distance) for r in combine.consensus({"a": a, "b": b}, 5).orderBy("rank").collect()] == [(3, 3.0), (0, 3.5)]
    assert combine.consensus({"a": a, "b": lists(spark, [(9, 1)])}, 5).count() == 0


def test_synthesis_takes_the_shortest_list(spark, train):
    a, b = lists(spark, [(2, 1), (3, 1), (0, 3), (4, 6)]), lists(spark, [(0, 1), (1, 1), (2, 2)])
    rows = combine.synthesis({"x": (a, train)}, {"t": b}, 10).orderBy("cand_rank").collect()
    assert [(r.cand_rank, r.num["x"], r.anchors["x"], r.anchors["t"]) for r in rows] == [(1, [2.0], 2, 0), (2, [3.0], 3, 1), (3, [2.0], 0, 2)]


def test_lof_by_brute_force(spark):
    x = np.random.default_rng(4).random((30, 2))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "sample_id long, value array<double>")
    k, d = 5, np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    own = [sorted((d[i, j], j) for j in range(30) if j != i)[:k] for i in range(30)]
    kd = np.array([o[-1][0] for o in own])
    lrd = np.array([1 / (np.mean([max(a, kd[j]) for a, j in o]) + 1e-10) for o in own])
    new = [sorted((d[i, j], j) for j in range(30))[:k] for i in range(30)]
    want = [np.mean([lrd[j] for _, j in o]) * (np.mean([max(a, kd[j]) for a, j in o]) + 1e-10) for o in new]
    got = {r.sample_id: r.lof for r in lof.score(lof.fit(df, k), df, k).collect()}
    assert np.allclose([got[i] for i in range(30)], want)
    assert lof.neighbour_count(3) == 2 and lof.neighbour_count(100) == 20


def test_a_references_own_factors_need_no_search(spark, monkeypatch):
    """Copies, ties and values that are not finite included; scaling searches once for the fit and once for the queries."""
    x = np.random.default_rng(5).integers(0, 4, (60, 3)).astype(float)
    x[7, 1], x[8, 0] = np.inf, np.nan
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "sample_id long, value array<double>")
    searches, search = [], lof.knn
    monkeypatch.setattr(lof, "knn", lambda *a, **b: searches.append(a) or search(*a, **b))
    p = lof.Plausibility(df, 6)
    got, want = ({r.sample_id: r.lof for r in rows.collect()} for rows in (lof.score_reference(p.fitted, p.own, p.k), p.raw(df)))
    assert got.keys() == want.keys() and np.allclose([got[i] for i in got], [want[i] for i in got], equal_nan=True)
    searches.clear()
    assert lof.Plausibility(df, 6).scaled(df.where("sample_id < 5")).count() == 5 and len(searches) == 2


def test_plausibility(spark):
    x = [(i, [float(i % 5), float(i // 5)]) for i in range(25)]
    ref = spark.createDataFrame(x, "sample_id long, value array<double>")
    q = spark.createDataFrame([(100, [2.0, 2.0]), (101, [40.0, 40.0])], "sample_id long, value array<double>")
    p = lof.Plausibility(ref, 5)
    for how in ("unit", "percentile"):
        got = {r.sample_id: r.plausibility for r in p.scaled(q, how).collect()}
        assert got[101] == 1.0 and 0 <= got[100] < 1
    two = lof.Plausibility(ref.where("sample_id < 2")).raw(q).collect()
    assert {r.sample_id: r.lof for r in two}[100] == 1.5


def test_pareto_case(spark):
    pts = [(1, 4), (2, 2), (3, 3), (4, 1), (2, 2)]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "id int, a double, b double")
    assert {r.id for r in analytics.pareto_front(df, ["a", "b"], "id").collect()} == {0, 1, 3, 4}


def test_tau_case(spark):
    df = spark.createDataFrame([(0, [[1.0, 2.0, 3.0, 4.0, 100.0]])], "sample_id long, value array<array<double>>")
    assert preprocess.mad_threshold(df, 1.1).first().tau == pytest.approx(1.1)
    assert preprocess.mad_threshold(df).first().tau == 0


def test_metrics_by_brute_force(spark):
    rng = np.random.default_rng(5)
    y, s = rng.integers(0, 2, 80), rng.integers(0, 9, 80).astype(float)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s, strict=True)], "label int, score double")
    p, n = s[y == 1], s[y == 0]
    want = ((p[:, None] > n).sum() + 0.5 * (p[:, None] == n).sum()) / (len(p) * len(n))
    assert analytics.auroc(df).first().auroc == pytest.approx(want)
    assert analytics.auroc(df.where("label = 1")).first().auroc is None


def test_k_curve_skips_nan(spark):
    df = spark.createDataFrame(
        [("g", 1, 1, 2.0), ("g", 1, 2, float("nan")), ("g", 1, 3, 6.0)], "generator string, query_id int, cand_rank int, outcome double"
    )
    got = {r.k: (r.outcome, r.n) for r in analytics.k_curve(df, [1, 2, 3], columns=("outcome",)).collect()}
    assert got == {1: (2.0, 1), 2: (2.0, 2), 3: (4.0, 3)}


def test_preparation(spark):
    df = spark.createDataFrame(
        [(0, "US, NY, New York", "10000-20000", 1.0), (1, "DE", "x", None), (2, None, "5", 3.0)],
        "sample_id long, place string, pay string, v double"
    )
    rows = df.orderBy("sample_id").select(*preprocess.split_location(F.col("place")), preprocess.salary_midpoint(F.col("pay")).alias("pay")).collect()
    assert [tuple(r) for r in rows] == [("US", "NY", "New York", 15000.0), ("DE", None, None, None), (None, None, None, 5.0)]
    assert [r.v for r in preprocess.fill_median(df, "v", F.lit(True)).orderBy("sample_id").collect()] == [1.0, 2.0, 3.0]
    assert "v" not in preprocess.drop_sparse(df, 0.3).columns and "v" in preprocess.drop_sparse(df, 0.5).columns
    got = preprocess.knn_impute(
        spark.createDataFrame([(0, 1.0, 1.0), (1, None, 1.1), (2, 9.0, 9.0)], "sample_id long, a double, b double"), ["a", "b"], 1
    )
    assert {r.sample_id: r.a for r in got.collect()} == {0: 1.0, 1: 1.0, 2: 9.0}


def test_split_is_stratified(spark):
    df = spark.range(1000).select(F.col("id").alias("sample_id"), (F.col("id") % 4).alias("label"))
    counts = {tuple(r)[:2]: r["count"] for r in preprocess.stratified_split(df, "label").groupBy("label", "split").count().collect()}
    assert all(counts[c, "test"] == 50 for c in range(4))


def test_proximity_pairs(spark):
    df = spark.createDataFrame([(i, i % 2, [float(i % 2)]) for i in range(400)], "sample_id long, label int, value array<double>")
    got = preprocess.proximity_pairs(df, 2)
    assert 200 < got.count() < 800 and {r.distance for r in got.collect()} == {1.0}


def test_lookup_prefers_training_entries_and_encodes_misses(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "ccc"), (4, None)], "sample_id long, text string")
    train, test = spark.createDataFrame([("a", [1.0])], "text string, value array<double>"), spark.createDataFrame(
        [("a", [9.0]), ("b", [2.0])], "text string, value array<double>"
    )
    got = {r.sample_id: r.value for r in encoders.lookup_or_encode(rows, train, test, lambda x: np.array([[float(len(t))] for t in x])).collect()}
    assert got[1] == [1.0] and got[2] == [2.0] and got[3] == [3.0] and got[4] is None


def test_branches(spark, train):
    other = train.limit(1)
    with pytest.raises(ValueError):
        Dataset(train, texts={"a": train}, text=other, primary_text="a")
    with pytest.raises(ValueError):
        Dataset(train, texts={"a": train, "b": other}, primary_text="z")
    two = Dataset(train, texts={"a": train, "b": other})
    with pytest.raises(ValueError):
        two.branch("text")
    with pytest.raises(ValueError):
        two.branch("text", "z")
    one = Dataset(train, static=train, series={"labs": other}, texts={"a": train})
    assert one.branch("text") is train and one.available() == ["tabular", "labs", "text"] and one.branch("image") is None


def test_generators_share_searches_and_start_at_the_nearest(spark):
    ds = tables.synthetic(spark)
    tab, labs, report = generators.TabularNN(k=4), generators.labs_nn(k=4), generators.TextNN("report", k=4)
    lib = generators.CounterfactualLibrary(
        {
            "tab": tab, "labs": labs, "text": report, "early": generators.EarlyFusionNN(k=4), "all": generators.MCR([tab, labs], 4, 50),
            "mix": generators.MPS([tab, labs, report], 4, 20)
        }
    )
    queries = ds.part(ds.samples, "test").where("sample_id < 5")
    rows = lib.run(ds, queries, 1, 4).cache()
    counts = {r.generator: r["count"] for r in rows.groupBy("generator").count().collect()}
    assert counts["tab"] == counts["labs"] == counts["text"] == counts["early"] == counts["mix"] == 20 and counts["all"] == 20
    first = rows.where("generator = 'tab' AND cand_rank = 1").collect()
    near_ = {r.query_id: r.train_id for r in tab.search(ds, queries, 1, 1).collect()}
    assert all(r.anchor_id == near_[r.query_id] for r in first)
    assert {k for r in rows.where("generator = 'mix'").collect() for k in r.anchors} == {"__primary__", "labs", "report"}


def test_sweep_resumes_without_duplicates(spark, tmp_path):
    ds, out = tables.synthetic(spark), str(tmp_path / "sweep")
    combos = sweep.grid({"tab": ["euclidean", "manhattan"], "image": []})
    queries, calls = ds.part(ds.samples, "test").where("sample_id < 3"), []

    def build(combo, broken=True):
        calls.append(combo["combo_id"])
        if broken and combo["tab"] == "manhattan":
            raise RuntimeError("no")
        return {"tab": generators.TabularNN(k=3, distance=combo["tab"])}

    status = sweep.run(spark, ds, combos, build, 1, queries, out, "r1", 3)
    assert {(r.combo_id, r.status) for r in status.collect()} == {("combo_0000", "ok"), ("combo_0001", "failed")}
    status = sweep.run(spark, ds, combos, lambda c: build(c, False), 1, queries, out, "r1", 3, keep_candidates=True)
    again = sweep.rescore(spark, ds, 1, out, "v2")
    assert {(r.combo_id, r.n) for r in again.groupBy("combo_id").agg(F.count("*").alias("n")).collect()} == {("combo_0001", 9)}
    curve = {r.k: r.n for r in sweep.k_ablation(again, [1, 2, 50]).collect()}
    assert curve == {1: 3, 2: 6, 50: 9}
    assert {r.status for r in status.collect()} == {"ok"} and calls == ["combo_0000", "combo_0001", "combo_0001"]
    assert {r.combo_id for r in sweep.objectives(spark, out).collect()} == {"combo_0000", "combo_0001"}


def test_segment_swap_by_hand():
    q, r = np.zeros((2, 4)), np.array([[5.0, 5, 0, 0], [0, 0, 1, 1]])
    predict = lambda x: np.stack([(x[:, 1].sum(1) > 0).astype(float), (x[:, 1].sum(1) <= 0).astype(float)], 1)
    assert baselines.swap_segments(q, r, predict, 0, 2, False).tolist() == r.tolist()
    assert baselines.swap_segments(q, r, predict, 0, 2, True).tolist() == r.tolist()
    assert baselines.swap_segments(q, np.zeros((2, 4)), predict, 0, 2, False) is None


def test_random_copy_and_gradient_reach_the_target(spark):
    q = spark.createDataFrame([(1, [0.0, 0.0, 1.0, 1.0])], "sample_id long, value array<double>")
    refs = spark.createDataFrame([(5, [3.0, 3.0, 0.0, 0.0])], "sample_id long, value array<double>")
    rows = baselines.random_copy(q, refs, catalog.heavy_first, 0, 2, 5).collect()
    assert baselines.random_copy(q, refs.limit(0), catalog.heavy_first, 0, 2, 5).count() == 0
    assert [r.cand_rank for r in rows] == [1, 2] and all(catalog.heavy_first([r.value])[0].argmax() == 0 for r in rows)
    w = np.array([[1.0, -1], [1, -1], [-1, 1], [-1, 1]])
    rows = baselines.gradient_logistic(q, w, np.zeros(2), 0, 2).collect()
    assert len(rows) == 2 and all((np.array(r.value) @ w).argmax() == 0 for r in rows)


def test_flatten_and_override(spark):
    schema = "dataset string, run_id string, rows array<struct<combo_id:string,n_samples:long,runtime_sec:double,candidate_counts:map<string,long>,objectives:map<string,struct<outcome:double,proximity:double,sparsity:double,plausibility:double>>>>"
    df = spark.createDataFrame([("d", "r", [("c", 2, 1.0, {"g": 4}, {"g": (0.0, 1.0, 2.0, 3.0), "h": (1.0, 1.0, 1.0, 1.0)})])], schema)
    flat = tables.flatten_summary(df)
    assert {(r.generator, r.candidate_count, r.plausibility) for r in flat.collect()} == {("g", 4, 3.0), ("h", 0, 1.0)}
    better = spark.createDataFrame([("g", 9.0)], "generator string, outcome double")
    assert {r.generator: r.outcome for r in tables.with_override(flat, better, ["generator"], ["outcome"]).collect()} == {"g": 9.0, "h": 1.0}


def test_streaming_scorer(spark, train, tmp_path):
    from contrapoint.streaming import scorer

    src = str(tmp_path / "q")
    spark.createDataFrame([(7, [3.0]), (8, [9.0])], "sample_id long, value array<double>").write.parquet(src)
    stream = spark.readStream.schema("sample_id long, value array<double>").parquet(src)
    scorer.start(stream, train, 2, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.query_id, r.rank): r.train_id for r in got.collect()}[8, 1] == 4 and got.count() == 4


def test_models_and_sources(spark, tmp_path):
    from contrapoint.functions import text
    from contrapoint.operators import models

    rng = np.random.default_rng(0)
    df = spark.createDataFrame(
        [(i, int(i % 2), (rng.normal(0, 0.1, 3) + (i % 2)).tolist()) for i in range(60)], "sample_id long, label int, value array<double>"
    )
    rows = models.predict(models.fit(preprocess.balanced_weights(df, "label"), "logistic", "weight"), df)
    assert analytics.macro_metrics(rows).first().accuracy > 0.95
    assert len(models.components(df, df, 2).first().value) == 2 and len(models.random_options({"a": [1, 2]}, 3)) == 3
    words = spark.createDataFrame([("good fine day", 0), ("bad awful day", 1)] * 10, "text string, label int")
    assert models.best_regularisation(words, words, [0.01, 0.1])[1] == 1.0
    np.save(tmp_path / "x.npy", np.arange(12.0).reshape(2, 3, 2))
    raw = tables.read_npy(spark, str(tmp_path / "x.npy"), "train")
    series_, static = tables.split_raw_series(raw, 1)
    assert series_.first().value == [[0.0, 2.0, 4.0]] and static.first().value == [1.0]
    got = spark.createDataFrame([("['a', \"b c\"]",), ("x",), (None,)], "t string").select(text.parse_list(F.col("t"))).collect()
    assert [r[0] for r in got] == [["a", "b c"], [], []]


def test_evaluation(spark):
    from contrapoint.operators.evaluate import evaluate

    factual = spark.createDataFrame([(1, [0.0, 0.0], [[0.0, 0.0]], 1)], "query_id long, tab array<double>, ser array<array<double>>, target int")
    cands = spark.createDataFrame(
        [(1, "a", [2.0, 0.0], None), (1, "b", None, [[1.0, 0.0]])],
        "query_id long, method string, tab array<double>, ser array<array<double>>"
    )
    predict = lambda tab, ser: F.array(
        F.when(F.get(tab, F.lit(0)) > 1, 0.0).otherwise(1.0), F.when(F.get(tab, F.lit(0)) > 1, 1.0).otherwise(0.0)
    )
    rows = {r.method: r for r in evaluate(cands, factual, predict).collect()}
    assert rows["a"].flipped and rows["a"].outcome == 0 and rows["a"].proximity == 0.5
    assert not rows["b"].flipped and rows["b"].outcome == 1 and rows["b"].sparsity == 0.25


def test_values_with_nulls_take_no_part(spark):
    q = spark.createDataFrame([(1, [0.0]), (2, None), (3, [None])], "sample_id long, value array<double>")
    c = spark.createDataFrame([(10, [1.0]), (11, [float("nan")]), (12, None), (13, [None]), (14, [3.0])], "sample_id long, value array<double>")
    assert [(r.query_id, r.train_id) for r in knn(q, c, 5).collect()] == [(1, 10), (1, 14)]
    s = spark.createDataFrame([(1, [[0.0, 1.0]]), (2, [[0.0, None]]), (3, [None])], "sample_id long, value array<array<double>>")
    assert [(r.query_id, r.train_id) for r in knn(s, s, 5, "dtw", "series").collect()] == [(1, 1)]


def test_generators_of_other_vectors_are_not_shared(spark):
    ds = tables.synthetic(spark)
    rows = ds.texts["report"].select("split", "sample_id")
    ways = [rows.withColumn("value", F.array(F.col("sample_id").cast("double") * s)) for s in (1.0, -1.0)]
    a, b = (generators.TextNN("report", k=2, encoder="bert", distance="euclidean", vectors=v) for v in ways)
    c, d = (generators.EarlyFusionNN(k=2, text_vectors=[v]) for v in ways)
    e, f = (generators.TextNN("report", k=2, transform=t) for t in (F.upper, F.reverse))
    assert len({g.key(ds) for g in (a, b, c, d, e, f)}) == 6
    pixels = rows.withColumn("px", F.encode(F.col("sample_id").cast("string"), "UTF-8"))
    raw = Dataset(ds.samples, images={"x": pixels})
    queries = ds.part(ds.samples, "test").where("sample_id < 2")
    with pytest.raises(ValueError):
        generators.ImageNN("x").search(raw, queries, 1, 1)
    near_ = generators.ImageNN("x", distance="euclidean", encoder=lambda px: np.array([[float(x)] for x in px])).search(raw, queries, 1, 1).collect()
    given = generators.ImageNN("x", distance="euclidean", vectors=ways[0]).search(raw, queries, 1, 1).collect()
    assert sorted(map(tuple, near_)) == sorted(map(tuple, given)) and len(near_) == 2


def test_objectives_of_missing_parts_and_weights(spark):
    from contrapoint.operators.objectives import Modality, assemble, summed

    key = "query_id long, cand_rank int, "
    tab = Modality("t", "tabular", spark.createDataFrame(
        [(1, 1, [0.0, 2.0]), (1, 2, [0.0, 0.0])], key + "value array<double>"
    ), spark.createDataFrame([(1, [0.0, 0.0])], "query_id long, value array<double>"),
                   spark.createDataFrame([(i, [float(i), 0.0]) for i in range(5)], "sample_id long, value array<double>"), weight=3.0)
    words = Modality(
        "w", "text", spark.createDataFrame([(1, 1, [1.0, 0.0], "a b"), (1, 2, None, None)], key + "value array<double>, text string"),
        spark.createDataFrame([(1, [0.0, 1.0], "a c")], "query_id long, value array<double>, text string")
    )
    pred = spark.createDataFrame([(1, 1, 2)], "query_id long, cand_rank int, pred int")
    rows = {r.cand_rank: r for r in assemble([tab, words], ["query_id", "cand_rank"], 0, pred).collect()}
    assert rows[1].outcome == 2 and rows[2].outcome is None
    assert rows[1].proximity == pytest.approx(0.75 * 1 + 0.25 * 0.5) and rows[1].sparsity == pytest.approx(0.75 * 0.5 + 0.25 * 0.5)
    assert rows[2].proximity == pytest.approx(0.25 * 1) and 0 < rows[2].plausibility <= rows[1].plausibility <= 0.75
    whole = assemble([tab, words], ["query_id", "cand_rank"], 0, renormalise=True).where("cand_rank = 2").first()
    assert whole.plausibility == pytest.approx(rows[2].plausibility / 0.75)
    with pytest.raises(ValueError):
        assemble([], ["query_id"], 0)
    words.reference = spark.createDataFrame([(1, [0.0, 1.0])], "sample_id long, value array<double>")
    few = {r.cand_rank: r.plausibility for r in assemble([tab, words], ["query_id", "cand_rank"], 0).collect()}
    assert few[1] == pytest.approx(rows[1].plausibility + 0.25) and few[2] == pytest.approx(rows[2].plausibility + 0.25)  # too few texts: 1
    s = spark.range(1).select(summed({"tabular": F.lit(1.0), "series": F.lit(2.0), "text": F.lit(4.0)}, 1.0, 0.5).alias("s")).first().s
    assert s == 5.0


def test_percentile_ranks_of_skewed_scores(spark):
    ref = spark.createDataFrame([(x,) for x in [0.0] * 50 + [1e-9 * i for i in range(200)] + [1e6]], "v double")
    rows = spark.createDataFrame([(-1.0,), (0.0,), (5.5e-9,), (1e-7,), (1e6,), (2e6,), (None,)], "x double")
    got = {r.x: r.p for r in scores.with_percentile_rank(rows, "x", ref, "v", "p").collect()}
    values = [r.v for r in ref.collect()]
    assert all(got[x] == pytest.approx(np.mean([v <= x for v in values])) for x in got if x is not None) and got[None] is None


def test_numbers_and_running_sums(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(50)], "g int, x long")
    got = sorted((r.g, r.x, r.n) for r in preprocess.numbered(df, F.col("x") % 7, ["x"], "n", ("g",)).collect())
    want = [(g, x, n) for g in range(3) for n, x in enumerate(sorted((i for i in range(50) if i % 3 == g), key=lambda i: (i % 7, i)))]
    assert got == sorted(want)
    sums = {(r.g, r.x): r.s for r in analytics.running_sum(df, ["g"], "x", "x", "s", 4).collect()}
    assert all(s == sum(i for i in range(50) if i % 3 == g and i <= x) for (g, x), s in sums.items()) and len(sums) == 50
    front = spark.createDataFrame(
        [(i, float(i), float(-i)) for i in range(300)] + [(999, 300.0, 1.0), (998, None, 0.0)], "id long, a double, b double"
    )
    assert analytics.pareto_front(front, ["a", "b"], "id").count() == 300


def test_runs_are_found_and_read(spark, tmp_path):
    import json

    run = tmp_path / "proj" / "data" / "ablation_runs" / "r1"
    run.mkdir(parents=True)
    rows = [
        {
            "combo_id": "c1", "status": "ok", "tab_metrics": {"__primary__": "l2", "t": "cosine"},
            "ts_metrics": {"labs": {"metric": "dtw"}}, "text_config": {"encoder": "raw", "metric": "lcs"}, "n_samples": 2,
            "runtime_sec": 1.5, "candidate_counts": {"g": 3},
            "objectives": {"g": {"outcome": 0.0, "proximity": 1.0, "sparsity": 2.0, "plausibility": 3.0}}
        },
        {"combo_id": "c2", "status": "failed"}
    ]
    (run / "summary.json").write_text(json.dumps({"rows": rows}))
    assert [(r.dataset, r.run_id) for r in tables.discover_runs(spark, str(tmp_path)).collect()] == [("proj", "r1")]
    flat = tables.read_summaries(spark, str(tmp_path)).collect()
    assert [
        (
            r.dataset, r.run_id, r.combo_id, r.tab_metric, r.ts_metric, r.text_encoder, r.text_metric, r.image_encoder, r.candidate_count,
            r.plausibility
        )
        for r in flat
    ] == [("proj", "r1", "c1", "l2+t:cosine", "labs:dtw", "raw", "lcs", "", 3, 3.0)]
    assert [r.combo_id for r in tables.combo_metadata(spark, str(run)).collect()] == ["c1"]
    (run / "summary.jsonl").write_text(
        "\n".join(["broken", "", json.dumps(rows[0] | {"n_samples": 1}), json.dumps(rows[0] | {"n_samples": 9}), json.dumps(rows[1])])
    )
    assert [(r.combo_id, r.n_samples) for r in tables.combo_metadata(spark, str(run)).collect()] == [("c1", 9)]
    assert [
        (r.strategy, r.generator)
        for r in tables.read_strategies(spark, {("s", None): str(run / "summary.json"), ("none", 1): str(run / "absent.json")}).collect()
    ] == [("s", "g")]
    for fold, v in enumerate(("1.0", "NaN")):
        (tmp_path / f"k{fold}.json").write_text('{"results": {"5": {"objectives": {"old": {"outcome": ' + v + ', "proximity": 2.0}}}}}')
    got = tables.read_k_ablation(spark, str(tmp_path / "k*.json"), {"old": "new"}).collect()
    assert [(r.k, r.generator, r.outcome, r.proximity, r.sparsity) for r in got] == [(5, "new", 1.0, 2.0, None)]
    doc = tables.baseline_summary("b", "d", "m", "tab", {"b": {"outcome": 0.0}}, {"b": 4}, sample_indices=[1, 2], n_total=2)
    assert doc["rows"][0]["total_candidates"] == 4 and doc["rows"][0]["status"] == "ok" and doc["n_total"] == 2
    tables.write_document(spark, doc, str(tmp_path / "doc"))
    assert json.loads(spark.read.text(str(tmp_path / "doc")).first().value) == doc
    tables.register_model(spark, str(tmp_path / "models"), "s", "rf", ["a"], 0.5, 0.6)
    tables.register_model(spark, str(tmp_path / "models"), "s", "lr", ["b"], 0.7, 0.6)
    assert analytics.best_model(spark.read.parquet(str(tmp_path / "models"))).first().model == "lr"
    vec = spark.createDataFrame([("train", 1, [1.0]), ("train", 0, [2.0])], "split string, sample_id long, value array<double>")
    tables.write_vectors(vec, str(tmp_path / "cache"), "e5")
    assert tables.read_vectors(spark, str(tmp_path / "cache"), "e5").count() == 2 and tables.read_vectors(spark, str(tmp_path / "cache"), "x").count() == 0 and tables.read_vectors(spark, str(tmp_path / "no"), "x") is None
    tables.write_npz({"v": vec}, str(tmp_path / "a.npz"))
    assert np.load(tmp_path / "a.npz")["v"].tolist() == [[2.0], [1.0]]
    with pytest.raises(ValueError):
        tables.write_npz({"v": vec}, str(tmp_path / "b.npz"), 1)
    tables.log_trials(spark.createDataFrame([(1, 0.5)], "depth int, score double"), str(tmp_path / "trials"))
    assert spark.read.option("header", True).csv(str(tmp_path / "trials")).count() == 1
    found = spark.createDataFrame(
        [(1, True, 0.0, 1.0, 2.0, 3.0), (1, False, 1.0, 1.0, 2.0, 3.0)],
        "patient int, feasible boolean, outcome double, proximity double, sparsity double, plausibility double"
    )
    assert [(r.outcome, r.n_feasible) for r in tables.genetic_means(found).collect()] == [(0.5, 1)]


def test_gradient_of_many_queries_equals_one_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(baselines, "DESCENTS", 3)  # several blocks, and rows of other lengths within them
    w = np.stack([np.where(np.arange(4) < 2, 1.0, -1.0), np.where(np.arange(4) < 2, -1.0, 1.0)], 1)
    rows = [(i, np.random.default_rng(i).normal(size=4).tolist()) for i in range(11)]
    find = lambda some: {(r.query_id, r.cand_rank): r.value for r in baselines.gradient_logistic(spark.createDataFrame(some, "sample_id int, value array<float>").coalesce(1), w, np.zeros(2), 0, 2, 40).collect()}
    got, want = find(rows), {key: v for row in rows[:4] for key, v in find([row]).items()}
    assert {i for i, _ in got} <= set(range(11)) and want and all(got[key] == pytest.approx(v) for key, v in want.items())
    assert {key for key in got if key[0] < 4} == set(want)


def test_convolutions_svd_series_gradient_and_best_branch(spark):
    from contrapoint.operators import models

    rng = np.random.default_rng(0)
    rows = [(i, i % 2, [[float(x) for x in rng.normal(0, 1, 24) + (np.sin(np.arange(24)) * 3 if i % 2 else 0)]]) for i in range(60)]
    df = spark.createDataFrame(rows, "sample_id long, label int, value array<array<double>>")
    features = models.convolution_features(df, 40)
    assert len(features.first().value) == 80
    said = models.predict(models.fit(features, "logistic", regParam=0.1), features)
    assert analytics.macro_metrics(said).first().accuracy > 0.9
    x = rng.normal(0, 1, (30, 5))
    flat = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "sample_id long, value array<double>")
    got = np.array([r.value for r in models.truncated_svd(flat, flat, 2).orderBy("sample_id").collect()])
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(u[:, :2] * s[:2]), atol=1e-6)
    good = spark.createDataFrame([(1, 1), (0, 0)], "label int, pred int")
    bad = spark.createDataFrame([(1, 0), (0, 0)], "label int, pred int")
    assert models.best_branch({"b": bad, "c": good, "a": bad}) == "c" and models.best_branch({"z": good, "y": good}) == "y"
    query_ = spark.createDataFrame([(1, [[0.0, 0.0], [1.0, 1.0]])], "sample_id long, value array<array<double>>")
    w = np.array([[1.0, -1], [1, -1], [-1, 1], [-1, 1]])
    found = baselines.gradient_series(query_, w, np.zeros(2), 0, 2).collect()
    assert len(found) == 2 and all(len(r.value) == 2 and len(r.value[0]) == 2 and (np.ravel(r.value) @ w).argmax() == 0 for r in found)


def plain_vectors(texts, dim, window):
    """Word vectors by neighbours, in Python."""
    import hashlib
    from collections import Counter

    pairs = Counter()
    for text in texts:
        w = (text or "").lower().split()
        for i, a in enumerate(w):
            for b in w[i + 1 : i + 1 + window]:
                pairs[a, b] += 1
                pairs[b, a] += 1
    own, n, out = Counter(), sum(pairs.values()), {}
    for (a, _), k in pairs.items():
        own[a] += k
    drawn = lambda seed, w: int(hashlib.md5(f"{seed}:{w}".encode()).hexdigest()[:8], 16)
    for (a, b), k in pairs.items():
        out.setdefault(a, np.zeros(dim))[drawn(0, b) % dim] += max(0, np.log(k * n / (own[a] * own[b]))) * (drawn(1, b) % 2 * 2 - 1)
    return {w: v / max(np.linalg.norm(v), 1e-8) for w, v in out.items()}


def test_word_vectors_are_learned_from_neighbours(spark):
    rng = np.random.default_rng(8)
    filler = [f"w{i}" for i in range(30)]
    places = [f"the {x} of {rng.choice(['rome', 'paris'])} {rng.choice(filler)}" for x in ("king", "queen") * 300]
    drinks = [f"{rng.choice(filler)} drink cold {x} now" for x in ("milk", "juice") * 300]
    texts = [*places, *drinks, None, "", "alone", "A  a\ta", "x y", "x y"]
    df = spark.createDataFrame([(t, "extra") for t in texts], "text string, word string").repartition(3)
    got = {r.word: np.array(r.vec) for r in encoders.cooccurrence_vectors(df, 64, 3).collect()}
    want = plain_vectors(texts, 64, 3)
    assert got.keys() == want.keys() and "alone" not in got and all(np.allclose(got[w], want[w]) for w in want)
    near = lambda a, b: got[a] @ got[b]
    assert near("king", "queen") > near("king", "milk") + 0.2 and near("milk", "juice") > near("queen", "juice") + 0.2
    assert encoders.cooccurrence_vectors(df.where("text IS NULL"), 64, 3).count() == 0


def test_fitted_text_encoders_of_a_generator(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(12)]
    texts = [" ".join(rng.choice(words, rng.integers(1, 9))) for _ in range(24)] + ["", None, "unseen words"]
    rows = [("train" if i % 3 else "test", i // 3, t) for i, t in enumerate(texts)]
    ds = Dataset(
        spark.createDataFrame([(s, i, i % 2, 1) for s, i, _ in dict.fromkeys((s, i, None) for s, i, _ in rows)], "split string, sample_id long, label int, pred int"),
        text=spark.createDataFrame([(s, 2 * i + (n % 3 == 2), t) for n, (s, i, t) in enumerate(rows)], "split string, sample_id long, text string"),
    )
    ds.samples = spark.createDataFrame([(r.split, r.sample_id, 0, 1) for r in ds.branch("text").select("split", "sample_id").collect()], ds.samples.schema)
    train = {r.sample_id: r.text for r in ds.part(ds.branch("text"), "train").collect()}
    test = {r.sample_id: r.text for r in ds.part(ds.branch("text"), "test").collect()}
    found = generators.TextNN(encoder="tfidf", distance="cosine").search(ds, ds.part(ds.samples, "test"), 0, 4).collect()
    got = {(r.query_id, r.rank): (r.train_id, r.distance) for r in found}
    split = {i: (t or "").split() for i, t in train.items()}
    idf = {w: np.log((1 + len(train)) / (1 + sum(w in t for t in split.values()))) + 1 for w in {w for t in split.values() for w in t}}

    def weights(t):
        v = np.array([(t or "").split().count(w) * idf[w] for w in sorted(idf)])
        return v / max(np.linalg.norm(v), 1e-12)

    for q, t in test.items():
        order = sorted((round(1 - weights(t) @ weights(x), 9), i) for i, x in train.items())[:4]
        assert [got[q, n + 1][0] for n in range(4)] == [i for _, i in order]
        assert np.allclose([got[q, n + 1][1] for n in range(4)], [d for d, _ in order])
    learned = plain_vectors(train.values(), 64, 4)
    mean = lambda t: np.mean([learned[w] for w in (t or "").split() if w in learned] or [np.zeros(64)], 0)
    near = generators.TextNN(encoder="w2v", distance="euclidean").search(ds, ds.part(ds.samples, "test"), 0, 1).collect()
    assert len(near) == len(test)
    assert all(np.isclose(r.distance, min(np.linalg.norm(mean(test[r.query_id]) - mean(x)) for x in train.values()), atol=1e-6) for r in near)
    with pytest.raises(ValueError):
        generators.TextNN(encoder="tfidf", distance="manhattan").search(ds, ds.part(ds.samples, "test"), 0, 1)


def test_word_vectors_of_some_words_are_those_of_all(spark):
    texts = ["a b a c d", "b b b", "c", None, "d a b c a d b", "e f"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    every = {r.word: r.vec for r in encoders.cooccurrence_vectors(df, 16, 2).collect()}
    only = spark.createDataFrame([("a",), ("f",), ("a",), ("unknown",)], "word string")
    some = {r.word: r.vec for r in encoders.cooccurrence_vectors(df, 16, 2, only=only).collect()}
    assert set(some) == {"a", "f"} and all(np.allclose(v, every[w]) for w, v in some.items())


@pytest.mark.parametrize("metric", ["euclidean", "sqeuclidean", "manhattan", "chebyshev", "hamming", "canberra", "braycurtis", "minkowski", "nan_euclidean"])
def test_few_features_are_searched_by_boxes(metric):
    from contrapoint.functions import vectors

    rng = np.random.default_rng(5)
    options = {"p": 3.0} if metric == "minkowski" else {}
    for features, rounded, digits in ((2, 2, None), (3, 0, 6), (3, 1, 2), (1, 3, 9)):
        q, c = (rng.normal(size=(n, features)).round(rounded) * 3 for n in (300, 2500))
        if features == 3:
            c[:40, 0], q[:5, 0] = np.inf, -np.inf
        if metric == "nan_euclidean":
            c[rng.random(c.shape) < 0.1] = q[rng.random(q.shape) < 0.1] = np.nan
        ids, worked = rng.permutation(len(c)) * 3, []

        def distances(x, y):
            worked.append(len(x) * len(y))
            return vectors.KERNELS[metric](x, y, **options)

        with np.errstate(all="ignore"):
            at, near, d = vectors.nearest(q, c, ids, 4, distances, lambda *b: vectors.BOUNDS[metric](*b, **options), digits)
            every = vectors.KERNELS[metric](q, c, **options)
        every = np.where(np.isnan(every), np.inf, every if digits is None else every.round(digits))
        for i, row in enumerate(every):
            want = [j for j in np.lexsort((ids, row))[:4] if row[j] < np.inf]
            assert near[at == i].tolist() == ids[want].tolist() and (d[at == i] == row[want]).all()


def test_boxes_leave_most_pairs_out():
    from contrapoint.functions import vectors

    rng, worked = np.random.default_rng(6), []
    q, c = rng.normal(size=(2000, 3)), rng.normal(size=(20_000, 3))

    def distances(x, y):
        worked.append(len(x) * len(y))
        return vectors.KERNELS["euclidean"](x, y)

    at, _, _ = vectors.nearest(q, c, np.arange(len(c)), 5, distances, vectors.BOUNDS["euclidean"])
    assert len(at) == 10_000 and sum(worked) < len(q) * len(c) / 4


def test_equal_vectors_keep_their_own_neighbours(spark):
    rows = [(i, [float(i % 3), 1.0]) for i in range(30)] + [(90, [0.0, None]), (91, None), (92, [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, "sample_id long, value array<double>")
    got = {}
    for r in knn(df, df, 2, exclude_self=True).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.train_id)
    assert got == {i: [j for j in range(i % 3, 30, 3) if j != i][:2] for i in range(30)}


@pytest.mark.parametrize(("metric", "options"), [("cosine", {}), ("correlation", {}), ("minkowski", {"p": 3.0}), ("minkowski", {"p": 1.5})])
def test_products_leave_out_what_is_far(metric, options):
    from contrapoint.functions import vectors

    rng = np.random.default_rng(7)
    q, c = rng.normal(size=(40, 20)), rng.normal(size=(600, 20))
    c[100:130], c[5], q[3], q[:2] = c[0], 0, 0, c[:2]
    every, some = vectors.KERNELS[metric](q, c, **options), vectors.KERNELS[metric](q, c, k=4, **options)
    near = every <= np.partition(every, 3, axis=1)[:, 3:4]
    assert (some[near] == every[near]).all() and (np.isinf(some) | (some == every)).all() and np.isinf(some).mean() > 0.5


def test_jaccard_counts_by_products():
    from contrapoint.functions import vectors

    rng = np.random.default_rng(8)
    q, c = (rng.integers(0, 2, (n, 9)).astype(float) for n in (20, 50))
    q[0], c[0] = 0, 0
    either, other = (((x(q[:, None] != 0, c != 0)).sum(2)) for x in (np.logical_or, np.logical_xor))
    assert (vectors.KERNELS["jaccard"](q, c) == other / np.maximum(either, 1)).all()


def test_a_shard_of_many_rows_is_taken_in_parts(spark, monkeypatch):
    from contrapoint.operators import search

    rows = [(i, [float(i % 7)] * 9) for i in range(60)]
    df = spark.createDataFrame(rows, "sample_id long, value array<double>")
    want = sorted(map(tuple, knn(df, df, 3, exclude_self=True).collect()))
    monkeypatch.setattr(search, "SHARD", 8)
    assert sorted(map(tuple, knn(df, df, 3, exclude_self=True).collect())) == want


@pytest.mark.parametrize("metric", ["bleu", "lcs", "rouge_2"])
def test_texts_are_held_in_parts(spark, monkeypatch, metric):
    from contrapoint.functions import text
    from contrapoint.operators import search

    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(i, [f"w{x}" for x in rng.integers(0, 6, rng.integers(1, 9))]) for i in range(50)], "sample_id long, value array<string>")
    want = sorted(map(tuple, knn(df, df, 3, metric, "text", digits=9).collect()))
    assert search.TEXTS < search.SHARD
    monkeypatch.setattr(search, "TEXTS", 7)
    plain = text.kernel(metric)

    def counted(q, c, k=None):
        assert len(c) <= 7
        return plain(q, c, k)

    monkeypatch.setattr(search.text, "kernel", lambda name: counted)
    assert sorted(map(tuple, knn(df, df, 3, metric, "text", digits=9).collect())) == want


@pytest.mark.parametrize("metric", ["dtw", "dtw_dependent", "lcss"])
def test_equal_series_are_searched_once(spark, monkeypatch, metric):
    """Copies of queries and candidates get the lists that a search of each alone gives; parts of a shard are joined."""
    from contrapoint.functions import series
    from contrapoint.operators import search

    rng, rows = np.random.default_rng(11), []
    distinct = rng.integers(0, 3, (30, 2, 6)).astype(float)
    for i in range(120):
        rows.append((i, distinct[i % 30].tolist()))
    q = spark.createDataFrame(rows, "sample_id long, value array<array<double>>")
    c = q.select((F.col("sample_id") + 1000).alias("sample_id"), "value")
    every = series.KERNELS[metric](distinct, distinct)
    plain, pairs = series.KERNELS[metric], spark.sparkContext.accumulator(0)

    def counted(a, b, k=None):
        pairs.add(len(a) * len(b))
        return plain(a, b, k=k)

    monkeypatch.setitem(series.KERNELS, metric, counted)
    monkeypatch.setattr(search, "SHARD", 16)
    got = {}
    for r in knn(q, c, 3, metric, "series", digits=9).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.train_id, r.distance))
    for i in range(120):
        want = sorted((round(float(every[i % 30, j % 30]), 9), 1000 + j) for j in range(120))[:3]
        assert got[i] == [(j, d) for d, j in want]
    assert pairs.value == 30 * 90


def test_levels_leave_out_what_is_far():
    """Whatever can be nearest is exact; values outside the columns' limits, columns of one value and categories included."""
    rng = np.random.default_rng(3)
    for spread, kinds in ((1.0, np.arange(40) >= 38), (4.0, np.arange(40) >= 30)):
        q, c = spread * rng.normal(size=(30, 40)), rng.normal(size=(3000, 40))
        c[50:60], c[:, 3], q[4] = c[0], 1.0, c[7]
        q[:, kinds], c[:, kinds] = rng.integers(0, 3, (30, kinds.sum())), rng.integers(0, 3, (3000, kinds.sum()))
        f = baselines.heom_kernel(c.min(0), c.max(0), kinds)
        every, some = f(q, c), f(q, c, 5)
        near = every <= np.partition(every, 4, axis=1)[:, 4:5]
        assert (some[near] == every[near]).all() and (np.isinf(some) | (some == every)).all() and (spread > 1 or np.isinf(some).mean() > 0.2)
    c[9, 2] = np.nan
    assert np.array_equal(f(q, c, 5), f(q, c), equal_nan=True)


def test_a_callable_of_vectors_searches_equal_rows_once(spark):
    pairs = spark.sparkContext.accumulator(0)

    def f(q, c):
        pairs.add(len(q) * len(c))
        return np.abs(np.asarray(q)[:, None] - np.asarray(c)[None]).sum(2)

    df = spark.createDataFrame([(i, [float(i % 10), 1.0]) for i in range(50)], "sample_id long, value array<double>")
    got = {(r.query_id, r.rank): (r.train_id, r.distance) for r in knn(df, df, 2, f, digits=9).collect()}
    assert got == {(i, r): (i % 10 + 10 * (r - 1), 0.0) for i in range(50) for r in (1, 2)} and pairs.value == 10 * 20


def test_neighbours_are_counted_before_they_leave_a_task(monkeypatch):
    """One row for each word of some texts, whatever its uses; no pair reaches over texts."""
    import pyarrow as pa

    texts = [["a", "b"] * 50, ["a"], ["c", "a", "b"], [], ["b", "b"]]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.list_(pa.string()))], names=["w"])
    want = {}
    for t in texts:
        for i, j in ((i, j) for i in range(len(t)) for j in range(len(t)) if 0 < abs(i - j) <= 3):
            want[t[i], t[j]] = want.get((t[i], t[j]), 0) + 1
    for most in (1 << 18, 4):
        monkeypatch.setattr(encoders, "TOKENS", most)
        rows = [r for x in encoders._neighbours([batch, batch.slice(0, 0)], 3) for r in x.to_pylist()]
        got = {}
        for r in rows:
            for x in r["near"]:
                got[r["a"], x["b"]] = got.get((r["a"], x["b"]), 0) + x["n"]
        assert got == want and (most == 4 or len(rows) == 3)
