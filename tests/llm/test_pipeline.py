"""The pipeline's stages on planted cases, and llm queries against their SQL."""

import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as C
from contrapoint.llm import gru_language, queries, subword_classifier
from contrapoint.llm.common import held_out, staged
from tests.llm.test_text_operators import PATTERNS, _valid

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect(config={"threads": 2})
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.queries()[name](spark, DATA)
    rows = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in rows.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(repr, rows.fetchall()))


def test_stages_keep_clean_rows_and_act(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    text = docs.where("length(text) BETWEEN 600 AND 4000").orderBy("doc_id").first().text
    planted = [
        (9001, None), (9002, "12 34 !!"), (9003, text), (9004, text + " extra word"),
        (9005, text[:300] + " mail me at jo.doe@example.com now " + text[300:])
    ]
    docs = docs.union(spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in planted], docs.schema))
    columns, labels = docs.columns, {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    before = {r.doc_id for r in docs.collect()}
    lang = C.language(spark, docs, DATA).cache()
    after = {r.doc_id for r in lang.collect()}
    assert lang.columns == columns and not {9001, 9002} & after and len(before - after) <= 6
    good = C.quality(spark, lang, DATA).cache()
    kept = {r.doc_id for r in good.collect()}
    assert good.columns == columns and sum(labels.get(i) == 1 for i in after - kept) <= 1 and sum(labels.get(i) == 0 for i in kept) <= 2
    near = C.near_duplicates(spark, good, DATA).cache()
    left = {r.doc_id for r in near.collect()}
    assert near.columns == columns and not {9003, 9004} & left
    clean = C.personal_data(spark, near, DATA).cache()
    rows = {r.doc_id: r for r in clean.collect()}
    assert clean.columns == columns and set(rows) == left and "@example.com" not in " ".join(r.text for r in rows.values()) and all(
        r.n_chars == len(r.text)
        for r in rows.values()
    )
    packed = C.packed(spark, clean, DATA).collect()
    assert {r.doc_id for r in packed} == left


def test_near_duplicates_of_repeated_and_null_ids(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(5, a), (5, a), (None, b), (None, b + " more"), (7, c), (8, c), (8, d), (9, ""), (9, ""), (4, d + " more"), (None, c)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], spark.read.parquet(f"{DATA}/documents.parquet").schema).repartition(3)
    left = C.near_duplicates(spark, docs, DATA)
    got = [(r.doc_id, r.text) for r in left.collect()]
    assert left.columns == docs.columns and len(got) == 6
    assert sorted(t[:2] for i, t in got if i is None) == ["b0"] and sorted((i, t[:2]) for i, t in got if i is not None) == [
        (4, "d0"), (5, "a0"), (7, "c0"), (9, ""), (9, "")
    ]


def test_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{DATA}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert C.run(spark, str(tmp_path)).count() == 0


def _fast_components(links, n):
    label = list(range(n))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in links:
        label[root(a)] = root(b)
    return [root(i) for i in range(n)]


def test_pipeline_equals_plain_recomputation(spark):
    """Every row of run(): only the two fitted models are taken from the operators; all decisions are recomputed."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: r[0])
    # Languages by plain recurrences over windows with their context.
    names, p = gru_language.fit(docs, lambda i: ~held_out(i, 4, 2))
    size, context = gru_language.BYTES, gru_language.CONTEXT

    def language(t):
        total = np.zeros(len(names))
        for a in range(0, len(t), size):
            before, window, after = (
                np.frombuffer(x, np.uint8)
                for x in (t[max(0, a - context) : a], t[a : a + size], t[a + size : a + size + context])
            )
            f = gru_language._forward(p["xf"], p["uf"], s := np.concatenate([before, window])[:, None], np.ones(s.shape, np.float32))[len(before) :]
            b = gru_language._forward(p["xb"], p["ub"], s := np.concatenate([window, after])[::-1, None], np.ones(s.shape, np.float32))[::-1]
            z = np.exp(p["w"] @ np.array([np.concatenate([x[5], y[5]])[:, 0] for x, y in zip(f, b[: len(window)], strict=True)]).T + p["c"])
            total += (z / z.sum(0)).sum(1)
        return total.max() / len(t)

    rows = [(i, t) for i, t in rows if t and regex.search(r"\p{L}", t) and language(t.encode()) >= C.LEAST_LANGUAGE]
    kept = spark.createDataFrame(rows, "doc_id long, text string")
    table, weights, bias = subword_classifier.fit(kept, spark.read.parquet(f"{DATA}/labels.parquet"), "quality", lambda i: ~held_out(i, 4, 2))

    def quality(t):
        words = t.encode().split()
        ids, counts, hashes = subword_classifier.word_features(words) if words else ([], 0, np.empty(0, np.uint64))
        every = np.concatenate([ids, subword_classifier.pair_buckets(hashes)]).astype(int)
        z = table[every].mean(0) @ weights + bias
        return 1 / (1 + np.exp(z[0] - z[1]))

    rows = [(i, t) for i, t in rows if quality(t) >= C.LEAST_QUALITY]
    # Near duplicates by all pairs of shingle sets.
    words = [t.encode().lower().split() for _, t in rows]
    sets = [frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []) for w in words]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    group = _fast_components(links, len(rows))
    first = {}
    for k, (i, _) in enumerate(rows):
        first.setdefault(group[k], i)
    rows = [(i, t) for k, (i, t) in enumerate(rows) if first[group[k]] == i]
    # Personal data by Python's patterns, terms by counts.
    spans = [[(k, m.start(), m.end(), m[0]) for k, q in PATTERNS.items() for m in re.finditer(q, t) if _valid(k, m[0])] for _, t in rows]
    wider = {"email": lambda v: v.lower().split("@")[-1], "ip": lambda v: v.rsplit(".", 1)[0], "card": lambda v: re.sub("[^0-9]", "", v)[:6], "phone": lambda v: re.sub("[^0-9]", "", v)[:4]}
    exact = lambda k, v: v.lower() if k in ("email", "ip") else re.sub("[^0-9]", "", v)
    seen = [
        ({e for k, _, _, v in s for e in ((k, exact(k, v)), (f"wider {k}", wider[k](v)))}, [(m.start(), m.end(), m[0]) for m in regex.finditer(r"[\p{L}\p{M}\p{N}]+", t)])
        for s, (_, t) in zip(spans, rows, strict=True)
    ]
    lower = [{w.lower() for _, _, w in ws} for _, ws in seen]
    n_term = Counter(t for ts in lower for t in ts)
    holders = {e: frozenset(i for i, (es, _) in enumerate(seen) if e in es) for es, _ in seen for e in es}
    both = Counter((h, t) for (es, _), ts in zip(seen, lower, strict=True) for h in {holders[e] for e in es} for t in ts)
    z2 = 1.64**2
    able = {(h, t): k for (h, t), k in both.items() if z2 < len(h) <= len(rows) / 2 and z2 < n_term[t] < 2 * len(h)}

    def discloses(h, t, k):
        m, bits = n_term[t], math.log2(len(rows) / len(h))
        p = min(np.roots([1 + z2 / m, -2 * k / m - z2 / m, (k / m) ** 2]).real)
        return p >= 0.5 and math.log2(p) + bits >= 1 and k * bits >= math.log2(len(able)) + 7

    flagged = {x for x, k in able.items() if discloses(*x, k)}
    kind = lambda k, v: k if k != "term" else "number" if regex.fullmatch(r"\p{N}+", v) else "name" if regex.match(r"\p{Lu}", v) else "term"
    clean = []
    for (i, t), s, (es, ws) in zip(rows, spans, seen, strict=True):
        terms = [("term", a, b, w) for a, b, w in ws if any((holders[e], w.lower()) in flagged for e in es) and not any(x < b and a < y for _, x, y, _ in s)]
        out, at = "", 0
        for k, a, b, v in sorted([*s, *terms], key=lambda x: (x[1], x[2], x[0])):
            if a >= at:
                out += t[at:a] + f"<{kind(k, v)}>"
            at = max(at, b)
        clean.append((i, out + t[at:]))
    tokenizer, want = Tokenizer.from_file(queries.WORD_BPE), Counter()
    for i, t in clean:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        want.update((i, n, a, len(c := ids[a : a + 4096]), zlib.crc32(np.array(c, "<u4").tobytes())) for n, a in enumerate(range(0, len(ids), 4096)))
    got = C.run(spark, DATA).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(
        sum(n for _, n in x[:k]) == x[k][0]
        for x in map(sorted, bins.values())
        for k in range(len(x))
    ) and all(sum(n for _, n in x) <= 4096 for x in bins.values())


def test_stages_pass_further_columns_of_any_name(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    for name in ("score", "lang_pred", "spans", "terms", "number", "row", "kept", "component_id", "doc", "words"):
        docs = docs.withColumn(name, F.lit(f"own {name}"))
    out = docs
    for _, stage in C.STAGES[:-1]:
        out = staged(stage(spark, out, DATA), "clash")
        assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(r.score == "own score" and r.spans == "own spans" and r.number == "own number" and r.doc == "own doc" for r in rows)
    assert {r.doc_id for r in C.packed(spark, out, DATA).collect()} == {r.doc_id for r in rows}
