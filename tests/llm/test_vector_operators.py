"""Search, near-duplicate vectors and url rules against brute force, with awkward rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from contrapoint.llm import capfilters, queries, topk, url_cascade

NAN, INF = float("nan"), float("inf")


def brute_top(rows, queries_, k):
    out = set()
    for q, v in queries_:
        scored = sorted(
            (-sum(int(np.floor(64 * a)) * int(np.floor(64 * b)) for a, b in zip(v, w, strict=True)), i)
            for i, w in rows if i != q and len(w) == len(v)
        )
        out |= {(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)}
    return out


def test_top_k_takes_every_row_of_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (1, [0.0, 3.0]), (2, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(df.where("vec_id = 0"), df, 3).collect())
    first = [(0, 1, 1, 8192), (0, 2, 1, 8192), (0, 3, 2, 4096)]
    second = [(0, 1, 1, 12288), (0, 2, 2, 4096), (0, 3, 1, 0)]
    assert got == sorted(first + second)


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_BYTES", 5 * 48)
    monkeypatch.setattr(topk, "SHARD_BYTES", 9 * 48)
    monkeypatch.setattr(topk, "ROWS", 2)
    monkeypatch.setattr(topk, "STEP", 4)
    rng = np.random.default_rng(0)
    good = [(i, rng.integers(-2, 3, 6).astype(float).tolist()) for i in range(150)] + [(200, [1e30] * 6), (201, [1.0, 2.0])]
    odd = [(300, None), (301, []), (302, [NAN] * 6), (303, [INF] + [0.0] * 5), (304, [None] + [0.0] * 5), (None, [0.0] * 6)]
    df = spark.createDataFrame([(i, v, "x") for i, v in good + odd], "vec_id long, embedding array<double>, score string")
    usual = [r for r in good if r[0] != 200]
    got = {tuple(r) for r in topk.top_k(df.where("vec_id % 10 = 0 AND vec_id <> 200"), df.where("vec_id <> 200 OR vec_id IS NULL"), 7).collect()}
    assert got == brute_top(usual, [r for r in usual if r[0] % 10 == 0], 7)
    huge = topk.top_k(df.where("vec_id = 200"), df, 3).collect()
    assert [r.rank for r in sorted(huge)] == [1, 2, 3] and all(abs(r.score) <= 2**63 for r in huge)
    assert topk.top_k(df.limit(0), df, 3).count() == 0 and topk.top_k(df.where("vec_id = 201"), df, 3).count() == 0


@pytest.mark.parametrize("blocks", [(512, 4096), (3, 4)])
def test_cap_filters_find_every_link(spark, monkeypatch, blocks):
    monkeypatch.setattr(capfilters, "ASSIGNED", blocks[0])
    monkeypatch.setattr(capfilters, "DECODED", blocks[1])
    rng = np.random.default_rng(1)
    base = rng.standard_normal((12, 8))
    rows = [(i, (base[i % 12] + rng.normal(0, 0.12, 8)).tolist(), i % 3) for i in range(150)]
    rows += [(200 + i, rows[0][1], rows[0][2]) for i in range(20)] + [
        (300, [2 * x for x in rows[1][1]], rows[1][2]), (301, [1e200, *[0.0] * 7], 0), (302, [1.0, *[0.0] * 7], 0)
    ]
    odd = [
        (400, None, 0), (401, [0.0] * 8, 0), (402, [NAN] * 8, 0), (403, rows[0][1], None), (404, [], 0), (405, [None] * 8, 0),
        (406, rows[0][1][:4], rows[0][2])
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows + odd], "vec_id long, embedding array<double>, label int, component_id string")
    unit = {}
    for i, v, c in rows + [odd[-1]]:
        x = np.array(v) / np.abs(v).max()
        unit[i] = x / np.linalg.norm(x), c
    links = {i: {j for j, (y, d) in unit.items() if j != i and c == d and len(x) == len(y) and x @ y >= 0.98} for i, (x, c) in unit.items()}

    def least(i):
        seen, todo = {i}, [i]
        while todo:
            new = links.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        return min(seen)

    want = {(i, len(links.get(i, ())), least(i), least(i) == i) for i, *_ in rows + odd}
    assert {tuple(r) for r in capfilters.near_duplicates(df, 0.98, codewords=16).collect()} == want
    assert capfilters.near_duplicates(df.limit(0)).count() == 0


def test_url_rules(spark):
    urls = [
        "https://a.com/x", "http://COM/", "https://com", "https://example.com/en/1?q", "https://www.Example.com/en/",
        "https://www.example.com/e", "x://b.net/es/é#f", "x://net/fr/", "x://net.example/fr/", "no scheme", None, "", "a://b://c.com/",
        "http://x.com\n/en/", "https://notexample.com/en/", "https://a.example.com/en/x/y", "://com/"
    ]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate([*urls, urls[0]])], "page_id long, url string, host string")
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")

    def judge(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest.split("/")[0].split("?")[0].split("#")[0])
        path = rest[len(host) :].split("?")[0].split("#")[0]
        fit = [(len(h + p), h + p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, max(fit)[1], max(fit)[2]) if fit else (host, path, None, "allow")

    assert sorted(
        (r.page_id, r.host, r.path, r.rule, r.verdict)
        for r in url_cascade.judge(pages, rules).collect()
    ) == [(i, *judge(u)) for i, u in enumerate([*urls, urls[0]])]
    assert url_cascade.judge(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_cascade.judge(pages, rules.limit(0), "block").collect()} == {"block"}


def test_cascade_is_exact_over_its_universe():
    rng = np.random.default_rng(3)
    keys = rng.integers(-(2**63), 2**63 - 1, (20_000, 2))
    inside, outside = keys[:3000], keys[3000:]
    levels = [url_cascade.Level(*url_cascade.hashes(inside).T, rate=0.2, salt=0)]
    keep, other = inside, outside[levels[0].has(*url_cascade.hashes(outside).T)]
    while len(other):
        levels.append(url_cascade.Level(*url_cascade.hashes(other).T, rate=0.5, salt=len(levels)))
        keep, other = other, keep[levels[-1].has(*url_cascade.hashes(keep).T)]
    got = url_cascade.member(levels, *url_cascade.hashes(keys).T)
    assert got[:3000].all() and not got[3000:].any() and len(levels) > 2


def test_urls_of_any_length_and_rules_in_both_lists(spark):
    rules = spark.createDataFrame(
        [("b.c", "/", "allow"), ("b.c", "/", "block"), ("c", "/x", "allow"), (None, "/", "block"), ("c", None, "block")],
        "host string, path string, verdict string"
    )
    long = "a." * 20_000 + "b.c"
    pages = spark.createDataFrame(
        [(1, f"http://{long}/x"), (2, "http://z.c/x" + "y" * 100_000), (3, None), (4, "http://"), (5, "no url")], "page_id long, url string"
    ).withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in url_cascade.judge(pages, rules, default="allow", keep=("page_id", "host")).collect()}
    assert got[1].host == long and (got[1].rule, got[1].verdict) == ("b.c/", "block")
    assert (got[2].rule, got[2].verdict) == ("c/x", "allow") and {
        (got[i].host, got[i].rule, got[i].verdict)
        for i in (3, 4, 5)
    } == {("", None, "allow")}
    assert url_cascade.judge(pages.limit(0), rules).count() == 0


def test_cap_filters_take_negative_zeros_for_zeros(spark):
    rows = [(1, [0.0, 1.0], 0), (2, [-0.0, 1.0], 0), (3, [1.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert {(r.vec_id, r.n_links, r.component_id) for r in capfilters.near_duplicates(df).collect()} == {(1, 1, 1), (2, 1, 1), (3, 0, 3)}


def test_cap_filters_write_no_decoded_rows(spark, monkeypatch):
    from contrapoint.llm import common

    monkeypatch.setattr(capfilters, "BLOCK", 100)
    monkeypatch.setattr(capfilters, "GROUP_ROWS", 50)
    rng, since = np.random.default_rng(4), common.staged_so_far()
    x = rng.standard_normal((300, 6))
    x[250:] = x[:50] + rng.normal(0, 0.05, (50, 6))
    df = spark.createDataFrame([(i, v.tolist(), i % 2 if i < 20 else 2) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in capfilters.near_duplicates(df, codewords=8).collect()}
    unit, label = x / np.linalg.norm(x, axis=1, keepdims=True), np.array([i % 2 if i < 20 else 2 for i in range(300)])
    linked = (unit @ unit.T >= 0.98) & (label[:, None] == label) & ~np.eye(300, dtype=bool)
    assert [got[i] for i in range(300)] == linked.sum(1).tolist() and linked.any()
    written = [p for p in common._STAGED[since:] if "components" not in p]
    assert sum(spark.read.parquet(p).count() for p in written) < 2 * len(x)
