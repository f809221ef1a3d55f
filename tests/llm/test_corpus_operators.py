"""Exact duplicates, importance resampling and lexical search against brute force, with awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from contrapoint.llm import exact_dedup, lexical, queries, resampling
from contrapoint.llm.words import words
from tests.llm.test_text_operators import AWKWARD, DATA

SCHEMA = "doc_id long, text string, number int, rank string, hit string, score string, n string, term string"
MORE = [
    (-20, "Straße ÉÀ İ ſ ABC"), (-21, "straße ÉÀ İ ſ abc"), (-22, "straße éÀ i̇ ſ abc"), (None, None), (None, ""), (-23, "x" * 5000 + " " + "é" * 4000 + " Y2"),
    (-24, "the " * 3000 + "漢字かな " * 500), (-25, "".join(map(chr, range(1, 0x250)))), (-26, "a"), (-26, "A"), (-26, "b a"), (-27, "c " * 19), (-28, "c " * 20)
]


def _plain(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def docs(spark):
    own = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    rows = [(i, t, None, "x", "x", "x", "x", "x") for i, t in AWKWARD + MORE]
    return spark.createDataFrame([(r.doc_id, r.text, 1, "x", "x", "x", "x", "x") for r in own.collect()] + rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.mark.parametrize("most", [exact_dedup.MOST_WORDS, 0])
def test_exact_copies_equal_brute_force(docs, texts, most, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MOST_WORDS", most)  # 0: filters are joined by shuffles
    monkeypatch.setattr(exact_dedup, "HOT", 0.02)
    groups = defaultdict(list)
    for i, t in texts:
        groups[hashlib.sha256(_plain(t).encode()).hexdigest()].append(i)
    got = exact_dedup.duplicates(docs)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    rows = got.collect()
    keep = {h: max((i for i in g if i is not None), default=None) for h, g in groups.items()}
    assert Counter((r.doc_id, r.text_sha256) for r in rows) == Counter((i, h) for h, g in groups.items() for i in g)
    assert all(r.keep_id == keep[r.text_sha256] and r.group_size == len(groups[r.text_sha256]) for r in rows)
    assert Counter(r.text_sha256 for r in rows if r.kept) == Counter(groups.keys()) and all(r.doc_id == r.keep_id for r in rows if r.kept)
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    assert Counter((r.doc_id, _plain(r.text)) for r in left.collect()) == Counter(
        (keep[h], next(_plain(t) for _, t in texts if hashlib.sha256(_plain(t).encode()).hexdigest() == h)) for h in groups
    )


def test_exact_copies_of_hot_groups_and_empty_tables(spark, docs):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "Hot").otherwise(F.concat(F.lit("t"), (F.col("id") / 1.5).cast("int"))).alias("text"))
    found = exact_dedup.duplicates(rows)
    assert found.count() == 6000
    hot = found.where("group_size = 2000").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("kept"), F.max("keep_id").alias("id")).first()
    assert (hot.n, hot.kept, hot.id) == (2000, 1, 5997)
    assert exact_dedup.duplicates(docs.limit(0)).count() == 0 and exact_dedup.drop_copies(docs.limit(0)).count() == 0


def test_most_unique_rows_pass_straight_through(spark):
    rows = exact_dedup._numbered(spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.least("id", F.lit(19_990))).alias("text")))
    through = exact_dedup._flagged(rows, exact_dedup._filters(rows, 20_000), 20_000).where("hit")
    assert 10 <= through.count() < 200 and through.where("doc_id >= 19990").count() == 10


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def _words(t):
    return WORD.findall(_plain(t))


@pytest.mark.parametrize("step", [1 << 21, 7])
@pytest.mark.parametrize("carry", [0, 2])
def test_words_of_any_step(texts, step, carry):
    sample = [t for _, t in texts if step > 100 or len(t or "") < 3000][-60:]
    for a in (pa.array(sample), pa.array(["skipped", *sample], pa.large_string())[1:]):
        got = defaultdict(list)
        for letters, offsets, rows, old in words(a, carry, step):
            own = [bytes(letters[x:y]).decode() for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
            assert old <= carry and (not old or (own[:old] == got[rows[0]][-old:] and (rows[:old] == rows[0]).all()))
            for r, w in list(zip(rows, own, strict=True))[old:]:
                got[r].append(w)
        assert [got[i] for i in range(len(sample))] == [_words(t) for t in sample]


def _features(t):
    w = _words(t)
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def test_crcs_are_combined_rightly(texts):
    sample = [t for _, t in texts][-60:]
    got = defaultdict(Counter)
    for buckets, rows, _ in resampling.features(pa.chunked_array([sample], pa.string())):
        for r in np.unique(rows):
            got[r] += Counter(buckets[rows == r].tolist())
    assert [got[i] for i in range(len(sample))] == [Counter(zlib.crc32(f.encode()) % 10000 for f in _features(t)) for t in sample]


def _draw(rows, target, percent=5, least=20):
    feats = [[zlib.crc32(f.encode()) % 10000 for f in _features(t)] for _, t in rows]
    s, t = Counter(x for f in feats for x in f), Counter(zlib.crc32(f.encode()) % 10000 for x in target for f in _features(x))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in range(10000)]
    out = []
    for (i, text), f in zip(rows, feats, strict=True):
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(_words(text)) >= least))
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], -math.inf if r[0] is None else r[0]))
    drawn = able[: percent * len(able) // 100]
    return Counter([(*r[:4], n + 1) for n, r in enumerate(drawn)]) + (Counter((*r[:4], None) for r in out) - Counter((*r[:4], None) for r in drawn))


@pytest.mark.parametrize(("percent", "span"), [(5, 3), (60, 10)])
def test_resampling_equals_brute_force(spark, docs, texts, percent, span, monkeypatch):
    monkeypatch.setattr(resampling, "RANGE", span)
    target = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()] + [None, "", "the the the"]
    rows = resampling.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), percent)
    assert rows.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(tuple(r) for r in rows.collect()) == _draw(texts, target, percent)


def test_resampling_query_equals_brute_force(spark):
    read = lambda t: spark.read.parquet(f"{DATA}/{t}.parquet").collect()
    want = _draw([(r.doc_id, r.text) for r in read("documents")], [r.text for r in read("benchmark")])
    assert Counter(tuple(r) for r in queries.op12_importance_resampling(spark, DATA).collect()) == want


def test_resampling_of_empty_tables(spark, docs, texts):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(none, none).count() == 0
    assert {(r.weight, r.rank) for r in resampling.resample(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), none).collect()} == {(0, None)}
    assert resampling.resample(docs, none).where("rank IS NOT NULL").count() == 5 * sum(len(_words(t)) >= 20 for _, t in texts) // 100


def _ranked(rows, items, k):
    docs = [(i, Counter(_words(t)), len(_words(t))) for i, t in rows]
    big_n, length = sum(n > 0 for _, _, n in docs), sum(n for _, _, n in docs)
    df = Counter(w for _, c, _ in docs for w in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in docs:
            m = 75 + 25 * n * big_n // max(1, length)
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w in _words(text) if c[w])
            if s > 0 and i is not None:
                scores.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return Counter(out)


@pytest.mark.parametrize(("k", "block", "step"), [(20, 1 << 22, 1 << 21), (3, 800, 50)])
def test_lexical_search_equals_brute_force(spark, docs, texts, k, block, step, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_BYTES", block)
    monkeypatch.setattr(lexical, "STEP", step)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()][:12]
    items += [(-1, None), (-2, ""), (-3, "nosuchword"), (-4, "The THE the ABC 漢字かな straße"), (None, "c a b"), (-5, "word"), (-5, "c")]
    table = spark.createDataFrame([*items, items[0]], "item_id long, text string").withColumn("score", F.lit(1)).withColumn("rank", F.lit(1))
    got = lexical.top_documents(docs, table, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(tuple(r) for r in got.collect()) == _ranked(texts, items, k)


def test_lexical_search_of_empty_tables(spark, docs):
    items = spark.createDataFrame([(1, "the one")], "item_id long, text string")
    assert lexical.top_documents(docs.limit(0), items).count() == 0 and lexical.top_documents(docs, items.limit(0)).count() == 0
    assert lexical.top_documents(spark.createDataFrame([(1, None)], "doc_id long, text string"), items).count() == 0


def test_radix_order_is_stable():
    keys = np.random.default_rng(0).integers(0, 1 << 40, 5000)
    keys[::3] = keys[0]
    assert (lexical.radix_order(keys, int(keys.max())) == np.argsort(keys, kind="stable")).all()
    assert len(lexical.radix_order(keys[:0], 0)) == 0
