"""Predictors, networks, evaluation with faults, covariance distances, kept scores and runs of tasks, by hand and brute force."""

import os
import uuid

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from contrapoint.functions import series, vectors
from contrapoint.operators import baselines, evaluate, kept, lof, models, predictors, search, whitening
from contrapoint.operators.predictors import Input, Predictor, predict
from contrapoint.plans import factories, generators, runner
from contrapoint.sources.dataset import Dataset

MIXED = "sample_id long, tab array<double>, labs array<array<double>>, meds array<array<double>>, text array<double>, rank double"


@pytest.fixture(scope="module")
def mixed(spark):
    rng, rows = np.random.default_rng(3), []
    for i in range(40):
        rows.append((i, rng.random(3).tolist(), rng.random((2, 5)).tolist(), rng.random((4, 5)).tolist(), rng.random(2).tolist() if i % 4 else None, float(i)))
    rows += [
        (100, None, rows[0][2], rows[0][3], None, 1.0), (101, [1.0, None, 2.0], rows[0][2], rows[0][3], None, 1.0),
        (102, [1.0, 2.0, 3.0], [[1.0] * 5, [1.0] * 4], rows[0][3], None, 1.0), (103, [1.0, 2.0, 3.0], [], rows[0][3], None, 1.0),
        (104, [1.0, 2.0, 3.0], rows[0][2], [[1.0] * 6] * 4, None, 1.0), (105, [1.0, 2.0], rows[0][2], rows[0][3], None, None),
    ]
    return spark.createDataFrame(rows, MIXED).repartition(3).cache()


def test_inputs_of_every_layout(spark, mixed):
    plain = {r.sample_id: r for r in mixed.collect()}

    def one(x):
        assert x.ndim == 3 and x.shape[1:] == (5, 9)
        return x[:, 0, :3].sum(1) + x[:, 4, 3:].sum(1)

    got = {r.sample_id: r for r in predict(mixed.where("sample_id < 100"), predictors.fused(one, "tab", "labs", "meds")).collect()}
    assert all(got[i].score == pytest.approx(sum(plain[i].tab) + sum(ch[4] for ch in plain[i].labs + plain[i].meds)) for i in range(40))

    def four(meds, labs, static, text):
        assert meds.shape[1:] == (5, 4) and labs.shape[1:] == (5, 2) and static.shape[1:] == (3,) and text.ndim == 3 and text.shape[1] == 5
        return np.stack([meds.sum((1, 2)), labs.sum((1, 2)) + static[:, 0] + text[:, 3].sum(1)], 1)

    got = {r.sample_id: r for r in predict(mixed.where("sample_id < 100"), predictors.four(four, "meds", "labs", "tab", "text", 3, batch_size=7)).collect()}
    for i in range(40):
        want = sum(map(sum, plain[i].labs)) + plain[i].tab[0] + sum(plain[i].text or [0])
        assert got[i].probability == pytest.approx([sum(map(sum, plain[i].meds)), want]) and got[i].score == got[i].probability[0]
    rank = Predictor(lambda r, t: r + t[:, 0], (Input(("rank",), 1), Input(("tab", "rank"), 2, (2, 4), 2)))
    got = {r.sample_id: r for r in predict(mixed.where("sample_id < 100"), rank).collect()}
    assert all(got[i].score == pytest.approx(i + plain[i].tab[2]) for i in range(40))
    assert predict(mixed.limit(0), rank).count() == 0
    with pytest.raises(ValueError):
        predict(mixed.withColumn("score", F.lit(1)), rank)


def test_faults_stay_with_their_rows(spark, mixed):
    def f(static, ts):
        if len(static) > 1 and (static[:, 0] > 0.9).any():
            raise RuntimeError("batch refused")
        if (static[:, 0] > 0.9).any():
            raise RuntimeError("too large")
        return np.where(static[:, 1] < 0.05, np.nan, static.sum(1))

    got = {r.sample_id: r for r in predict(mixed, predictors.paired(f, "tab", "labs", "meds")).collect()}
    plain = {r.sample_id: r for r in mixed.collect()}
    for i in range(40):
        t = plain[i].tab
        if t[0] > 0.9:
            assert got[i].error == "too large" and got[i].score is None
        elif t[1] < 0.05:
            assert got[i].error == "the prediction is not finite"
        else:
            assert got[i].error is None and got[i].score == pytest.approx(sum(t))
    assert [got[100 + i].error for i in range(5)] == [
        "tab is null", "tab holds nulls".replace("holds", "is ragged or holds"), "labs is ragged or holds nulls", "labs is ragged or holds nulls",
        "meds has 6 steps, not 5"
    ]
    assert got[105].score == pytest.approx(3.0) or got[105].error == "too large"


def test_evaluation_isolates_bad_candidates(spark):
    facts = [(1, [0.0, 0.0], [[0.0, 0.0]], 1), (2, [5.0, 5.0], [[0.0, 0.0]], 1), (3, [9.0, 9.0], [[0.0, 0.0]], 1)]
    factuals = spark.createDataFrame(facts, "query_id long, tab array<double>, ser array<array<double>>, target int")
    cands = [
        (1, "a", 1, [2.0, 0.0], None, None), (1, "a", 2, None, [[4.0, 0.0]], None), (1, "b", 1, [1.0, None], None, None), (1, "c", 1, None, [[1.0]], None),
        (1, "d", 1, [8.0, 0.0], None, None), (1, "e", 1, None, None, "gave up"), (2, "a", 1, None, None, None), (3, "a", 1, [0.0, 0.0], None, None),
        (77, "a", 1, [0.0, 0.0], None, None)
    ]
    candidates = spark.createDataFrame(cands, "query_id long, method string, cand_rank int, tab array<double>, ser array<array<double>>, error string")

    def f(static, ts):
        if (static[:, 0] > 7).any():
            raise ValueError("refused")
        return (static.sum(1) + ts.sum((1, 2)) > 1).astype(float)

    rows = {(r.query_id, r.method, r.cand_rank): r for r in evaluate.evaluate_methods(candidates, factuals, predictors.paired(f, "tab", "ser")).collect()}
    assert len(rows) == len(cands)
    r = rows[1, "a", 1]
    assert (r.kind, r.before, r.after, r.flipped, r.outcome, r.proximity, r.sparsity, r.error) == ("tab-only", 0, 1, True, 0.0, 0.5, 0.25, None)
    assert (rows[1, "a", 2].kind, rows[1, "a", 2].proximity) == ("series-only", 1.0)
    why = {k: r.error for k, r in rows.items()}
    assert why[1, "b", 1] == "tab holds nulls" and why[1, "c", 1] == "ser has another shape than the factual" and why[1, "d", 1] == "refused"
    assert why[1, "e", 1] == "gave up" and why[2, "a", 1] == "no branch is given" and why[3, "a", 1] == "factual: refused" and why[77, "a", 1] == "no factual"
    assert all(r.score is None and r.proximity is None and r.plausibility is None for r in rows.values() if r.error)


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 4))
    rows = [(i, int(v[0] + v[1] > 0), v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "sample_id long, label int, value array<double>").cache()
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    ready = df.withColumn("features", array_to_vector("value"))
    model = MultilayerPerceptronClassifier(layers=[4, 5, 3, 2], featuresCol="features", labelCol="label", seed=1, maxIter=30).fit(ready)
    said = {r.sample_id: list(r.p) for r in model.transform(ready).select("sample_id", vector_to_array("probability").alias("p")).collect()}
    return df, model, said


def test_network_layers_equal_the_fitted_model(spark, fitted):
    df, model, said = fitted
    net = models.Network.of(model)
    assert all(list(r.value) == pytest.approx(said[r.sample_id], abs=1e-9) for r in net.output(df, -1).collect())
    x = np.array([r.value for r in df.orderBy("sample_id").collect()])
    hidden = 1 / (1 + np.exp(-(1 / (1 + np.exp(-(x @ net.weights[0].T + net.biases[0]))) @ net.weights[1].T + net.biases[1])))
    got = {r.sample_id: r.value for r in net.output(df, -2).collect()}
    assert np.allclose([got[i] for i in range(200)], hidden) and {len(r.value) for r in net.output(df, 1).collect()} == {5}
    odd = spark.createDataFrame([(1, None), (2, [1.0]), (3, [1.0, None, 1.0, 1.0])], "sample_id long, value array<double>")
    assert [r.value for r in net.output(odd).collect()] == [None] * 3
    with pytest.raises(ValueError):
        net.forward(x, 9)
    assert len(models.fit_network(df, [3], maxIter=5).weights) == 2


def _dataset(df, **options):
    both = lambda d: d.withColumn("split", F.lit("train")).unionByName(d.withColumn("split", F.lit("test")))
    samples = both(df.select("sample_id", "label").withColumn("pred", F.col("label")))
    return Dataset(samples, static=both(df.select("sample_id", "value")), **options)


def test_latent_search_through_a_network(spark, fitted):
    df, model, _ = fitted
    ds, net = _dataset(df), models.Network.of(model)
    queries = ds.part(ds.samples, "test").where("sample_id < 10")
    near = generators.IntermediateFusionNN(net, k=3).search(ds, queries, 0, 3).collect()
    rows = {r.sample_id: (r.label, r.value) for r in df.collect()}
    h = {i: net.forward(np.array([v]), -2)[0] for i, (_, v) in rows.items()}
    for i in range(10):
        order = sorted((float(np.sqrt(((h[i] - h[j]) ** 2).sum())), j) for j, (label, _) in rows.items() if label == 0)
        assert [r.train_id for r in sorted(near, key=lambda r: r.rank) if r.query_id == i] == [j for _, j in order[:3]]
    said = factories.intermediate(ds, net)
    top = {i: int(net.forward(np.array([v]), -1)[0].argmax()) for i, (_, v) in rows.items()}
    assert all(r.pred == top[r.sample_id] for r in said.samples.collect())


def test_an_encoder_meets_every_text_once(spark, tmp_path):
    log = str(tmp_path / "calls")

    def encode(texts):
        with open(f"{log}-{os.getpid()}-{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(texts))
        return np.array([[len(t), t.count("a")] for t in texts], float)

    rows = spark.createDataFrame([(i, i % 2, f"a{'ab' * (i % 7)}") for i in range(30)], "sample_id long, label int, text string")
    both = lambda d: d.withColumn("split", F.lit("train")).unionByName(d.withColumn("split", F.lit("test")))
    ds = Dataset(both(rows.select("sample_id", "label").withColumn("pred", F.col("label"))), text=both(rows.select("sample_id", "text")))
    near = generators.TextNN(encoder=encode, distance="euclidean").search(ds, ds.part(ds.samples, "test"), 0, 2)
    assert near.count() == 60
    calls = [t for name in os.listdir(tmp_path) for t in open(tmp_path / name).read().split("\n")]
    assert len(calls) == len(set(calls)) == 7


def test_callable_text_distances_and_lcss_epsilon(spark):
    rows = spark.createDataFrame([(i, 0, "x " * i, [[float(i), 0.0, 1.0]]) for i in range(1, 6)], "sample_id long, label int, text string, value array<array<double>>")
    both = lambda d: d.withColumn("split", F.lit("train")).unionByName(d.withColumn("split", F.lit("test")))
    ds = Dataset(
        both(rows.select("sample_id", "label").withColumn("pred", F.lit(0))), text=both(rows.select("sample_id", "text")),
        series={"s": both(rows.select("sample_id", "value"))}
    )
    queries = ds.part(ds.samples, "test").where("sample_id = 2")
    gap = lambda q, c: np.abs(np.array([[len(a) - len(b) for b in c] for a in q]) + 0.1)
    assert [r.train_id for r in generators.TextNN(distance=gap).search(ds, queries, 0, 3).orderBy("rank").collect()] == [2, 3, 1]
    wide, thin = (
        {r.train_id: r.distance for r in generators.TimeSeriesNN("s", distance="lcss", epsilon=e, window=1.0).search(ds, queries, 0, 5).collect()} for e in (10.0, 0.5)
    )
    assert set(wide.values()) == {0.0} and thin[2] == 0 < thin[5]


def test_diverse_copies(spark):
    rng = np.random.default_rng(8)
    rows = spark.createDataFrame([(i, [float(i % 3), *rng.normal(size=2).tolist(), 1.0]) for i in range(50)], "sample_id long, value array<double>")
    spread = baselines.feature_spread(rows, [True, False, False, False])
    assert spread[0][0] and spread[0][4] == [0.0, 1.0, 2.0] and spread[3][3] == 1.0  # no deviation counts as 1
    f = lambda x: np.stack([1.0 * (x[:, 1] <= 0.3), 1.0 * (x[:, 1] > 0.3)], 1)
    got = baselines.diverse_copies(rows.where("sample_id < 12"), spread, f, 1, 4, 60).collect()
    assert all(r.value[1] > 0.3 and r.value[0] in (0, 1, 2) for r in got) and {r.query_id for r in got} == set(range(12))
    scale, kinds = np.array([s[3] for s in spread]), np.array([s[0] for s in spread])
    query, found = np.zeros(4), rng.normal(size=(30, 4))
    found[:, 0] = rng.integers(0, 3, 30)
    gap = lambda a, b: np.where(kinds, a != b, np.abs(a - b) / scale).mean()
    least = lambda rows: min(gap(found[a], found[b]) for a in rows for b in rows if a < b)
    for k in (2, 3, 6):
        chosen = baselines.most_diverse(query, found, kinds, scale, k)
        assert len(set(chosen)) == k and least(chosen) >= least(range(k)) - 1e-8
    assert baselines.most_diverse(query, found[:2], kinds, scale, 5) == [0, 1]


def test_covariance_distances(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 3)) @ np.array([[2.0, 1, 0], [0, 1, 0.5], [0, 0, 3]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None), (98, [1.0, None, 2.0])], "sample_id long, value array<double>").repartition(4)
    n, mean, cov = whitening.moments(df)
    assert n == 60 and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T))
    inverse = np.linalg.inv(np.cov(x.T))
    got = {(r.query_id, r.rank): (r.train_id, r.distance) for r in whitening.knn_by_covariance(df, df, 4, reference=df, exclude_self=True).collect()}
    for i in range(60):
        order = sorted((float(np.sqrt((x[i] - x[j]) @ inverse @ (x[i] - x[j]))), j) for j in range(60) if j != i)
        assert [got[i, r + 1] for r in range(4)] == [(j, pytest.approx(d)) for d, j in order[:4]]
    flat = df.withColumn("value", F.concat("value", F.array(F.lit(7.0)), F.slice("value", 1, 1)))  # a constant and a copy
    singular = {(r.query_id, r.rank): r.train_id for r in whitening.knn_by_covariance(flat, flat, 3, reference=flat, exclude_self=True, digits=6).collect()}
    assert len(singular) == 180 and sum(singular[i, 1] == got[i, 1][0] for i in range(60)) >= 58
    assert whitening.knn_by_covariance(df.limit(0), df.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        whitening.knn_by_covariance(df, df, 3, "other")


@pytest.mark.parametrize(("metric", "options"), [("minkowski", {"p": 3.0}), ("correlation", {}), ("jaccard", {})])
def test_further_metrics_agree_in_both_forms(spark, metric, options):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 3, (20, 6)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "sample_id long, value array<double>")
    pairs = df.alias("a").crossJoin(df.alias("b")).select("a.sample_id", F.col("b.sample_id").alias("other"), vectors.distance(metric, F.col("a.value"), F.col("b.value"), **options).alias("d"))
    plain = {(r.sample_id, r.other): r.d for r in pairs.collect()}
    near = search.knn(df, df, 20, metric, **options).collect()
    assert len(near) == 400 and all(plain[r.query_id, r.train_id] == pytest.approx(r.distance, abs=1e-9) for r in near)


def test_lists_merge_in_levels(spark, monkeypatch):
    for name, n in (("QUERY_BLOCK", 9), ("SHARD", 3), ("FAN_IN", 2), ("STEP", 4)):
        monkeypatch.setattr(search, name, n)
    x = np.random.default_rng(4).integers(0, 5, (50, 2)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "sample_id long, value array<double>")
    got = {(r.query_id, r.rank): r.train_id for r in search.knn(df, df, 5, exclude_self=True).collect()}
    for i in range(50):
        order = sorted((float(((x[i] - x[j]) ** 2).sum()), j) for j in range(50) if j != i)
        assert [got[i, r] for r in range(1, 6)] == [j for _, j in order[:5]]


def test_known_scores_are_not_worked_out_again(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i % 9), 1.0]) for i in range(40)] + [(99, None)], "sample_id long, value array<double>")
    table, asked = kept.ScoreTable(spark, str(tmp_path / "scores"), "sum"), []

    def score(values):
        asked.append(sorted(tuple(r.value) for r in values.collect()))
        return values.select("sample_id", F.aggregate("value", F.lit(0.0), lambda a, b: a + b).alias("score"))

    first = {r.sample_id: r.score for r in table.score(rows.where("sample_id < 5 OR value IS NULL"), score).collect()}
    assert first == {i: i + 1.0 for i in range(5)} | {99: None}
    second = {r.sample_id: r.score for r in table.score(rows, score).collect()}
    assert second == {i: i % 9 + 1.0 for i in range(40)} | {99: None}
    assert asked == [[(float(i), 1.0) for i in range(5)], [(float(i), 1.0) for i in range(5, 9)]]
    assert table.score(rows, score).count() == 41 and len(asked) == 2
    other = kept.ScoreTable(spark, str(tmp_path / "scores"), "another fit")
    assert other.missing(rows).count() == 9 and lof.neighbour_count(3) == 2


def _twice(block: pa.Table) -> pa.Table:
    ids, values = block["query_id"].to_pylist(), block["value"].to_pylist()
    return pa.table({"query_id": ids, "cand_rank": [1] * len(ids), "value": [[2 * x for x in v] for v in values]})


def test_runs_resume_without_duplicates(spark, tmp_path):
    rows = spark.createDataFrame([(f"d{i % 2}", i, [float(i)]) for i in range(60)], "dataset string, query_id long, value array<double>")
    out, broken = str(tmp_path / "out"), {"twice": _twice}

    def fails(block):
        if block["dataset"][0].as_py() == "d1":
            raise KeyError("no model")
        return _twice(block)

    planned = runner.plan(rows, ["twice", "other"], 6)
    tasks = planned.select(*runner.TASK).distinct().count()
    assert runner.run(spark, out, planned, broken | {"other": fails}, waves=4, most_waves=1) == tasks  # ends after one of four jobs
    done = runner.finished(spark, out).count()
    assert 0 < done < tasks
    assert runner.run(spark, out, planned, broken | {"other": fails}, waves=2) == tasks - done
    states = runner.states(spark, out).collect()
    assert len(states) == tasks and all((r.state == "failed") == (r.baseline == "other" and r.dataset == "d1") for r in states)
    assert all("no model" in r.error for r in states if r.state == "failed")
    left = sum(r.state == "failed" for r in states)
    assert runner.run(spark, out, planned, broken | {"other": _twice}) == left > 0
    assert runner.run(spark, out, planned, broken) == 0
    got = [(r.baseline, r.query_id, r.value) for r in runner.candidates(spark, out).collect()]
    assert sorted(got) == sorted((b, i, [2.0 * i]) for b in ("twice", "other") for i in range(60))


def test_samples_of_all_parts(spark):
    rows = spark.createDataFrame([([1.0, 2.0], [[1.0, 2.0, 3.0]], [[4.0, 5.0]], [[1.0], [3.0]])], "s array<double>, a array<array<double>>, b array<array<double>>, t array<array<double>>")
    got = rows.select(
        series.concatenated(F.col("s"), F.col("a"), None, F.col("t"), True).alias("x"), series.concatenated(F.col("s"), F.col("a"), F.col("b")).alias("y")
    ).first()
    assert got.x == [[1.0] * 3, [2.0] * 3, [1.0, 2.0, 3.0], [2.0] * 3] and got.y is None


@pytest.mark.parametrize("features", [2, 9])
def test_lists_of_shards_merge_in_levels(spark, monkeypatch, features):
    for name, n in (("QUERY_BLOCK", 9), ("SHARD", 3), ("WIDE_SHARD", 6), ("NARROW_ROWS", 6), ("FAN_IN", 2), ("STEP", 25)):
        monkeypatch.setattr(search, name, n)
    x = np.random.default_rng(4).integers(0, 5, (50, features)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "sample_id long, value array<double>")
    got = {(r.query_id, r.rank): r.train_id for r in search.knn(df, df, 5, exclude_self=True).collect()}
    for i in range(50):
        order = sorted((float(((x[i] - x[j]) ** 2).sum()), j) for j in range(50) if j != i)
        assert [got[i, r + 1] for r in range(5)] == [j for _, j in order[:5]]
