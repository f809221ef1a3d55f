"""The text operators against their libraries, brute force and held-out accuracy, with awkward rows."""

import base64
import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from contrapoint.llm import byte_bpe, disclosure, gru_language, lattice_lm, minhash, packing, queries, subword_classifier
from contrapoint.llm.common import connected_components, held_out, labelled_sample, worker_cache

DATA = "/root/testdata/sf0.001"
AWKWARD = [
    (-1, None), (-2, ""), (-3, " \n\t "), (-4, "one"), (-5, "ONE two"), (-5, "ONE two"), (-6, "a" * 6000 + " " * 300 + "-" * 1000), (-7, "xqzj%" * 500 + "QWE" * 800),
    (
        -8, "12 345  \n\n  é́ \x1c x\x85y   漢字🎉 <|endoftext|> don't İıſ %%% w%%% é!"
    ), (-9, "word " * 20000), (None, "one two"), (-10, "a b c d e f g h i j"), (-11, "a b c d e f g h i j k"), (-12, "12 34"),
]


@pytest.fixture(scope="module")
def docs(spark):
    own = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    return own.union(spark.createDataFrame(AWKWARD, "doc_id long, text string")).withColumn("score", F.lit("clash")).withColumn("ids", F.lit(1)).withColumn("n", F.lit(None).cast("int")).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def texts(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_byte_bpe_equals_tiktoken_and_round_trips(docs, empty):
    enc, want = _tiktoken(), Counter()
    for i, t in texts(docs):
        ids = enc.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in byte_bpe.digest(docs, queries.RANKS, P.PATTERN).collect()) == want
    assert byte_bpe.digest(empty, queries.RANKS, P.PATTERN).count() == 0
    assert set(byte_bpe.encode(docs, queries.RANKS, P.PATTERN).columns) == {"doc_id", "score", "ids", "n"}


def _tiktoken():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _letters(seed, n, alphabet):
    return "".join(np.array(list(alphabet))[np.random.default_rng(seed).integers(0, len(alphabet), n)])


def test_byte_bpe_of_long_words_equals_tiktoken(monkeypatch):
    codec, enc = byte_bpe.Codec(byte_bpe.read_ranks(queries.RANKS), P.PATTERN), _tiktoken()
    ids = lambda t: np.frombuffer(codec.encode([t])[0], np.int32)
    few, all_letters = "aeinst", "abcdefghijklmnopqrstuvwxyz"
    for n in (63, 64, 65, 66, 127, 128, 129, 3000):  # round the length at which the recursion changes
        for alphabet in (few, all_letters, "ab", "=-", "漢字a"):
            t = _letters(n, n, alphabet)
            assert ids(t).tolist() == enc.encode_ordinary(t), t
    for t in ("a" * 200_000, " " * 200_000 + "x", _letters(1, 200_000, all_letters), _letters(2, 60_000, few)):
        assert ids(t).tolist() == enc.encode_ordinary(t) and codec.decode([ids(t)]) == [t.encode()]
    monkeypatch.setattr(byte_bpe, "LONG_QUERY", 150)  # many blocks with open ends
    for i in range(60):
        t = _letters(i, 65 + 11 * i, (few, "ab", "eEtTaA", "the quick", " ")[i % 5])
        assert ids(t).tolist() == enc.encode_ordinary(t), t


@pytest.mark.parametrize(
    "text", ["a" * 10_000_000, " " * 10_000_000, _letters(3, 10_000_000, "abcdefghijklmnopqrstuvwxyz"), " the cat sat, " * 2_500_000],
    ids=["run", "blanks", "word", "tokens"]
)
def test_byte_bpe_of_ten_millions(text):
    codec = byte_bpe.Codec(byte_bpe.read_ranks(queries.RANKS), P.PATTERN)
    ids = np.frombuffer(codec.encode([text])[0], np.int32)
    assert codec.decode([ids])[0] == text.encode()
    tail = np.frombuffer(codec.encode([text[:50_000]])[0], np.int32)[:5000]  # far from the cut, the shorter text's ids
    assert (ids[:5000] == tail).all() and tail.tolist() == _tiktoken().encode_ordinary(text[:50_000])[:5000]


def test_byte_bpe_steps_and_slices_give_the_same(monkeypatch):
    codec, enc = byte_bpe.Codec(byte_bpe.read_ranks(queries.RANKS), P.PATTERN), _tiktoken()
    for name, value in (("STEP_CHARS", 50), ("STEP_WORDS", 7), ("STEP_TOKENS", 9)):
        monkeypatch.setattr(byte_bpe, name, value)
    texts = ["a b c " * 40, "", "x", "word, " * 30 + "é漢" * 40, "short one"]
    got = [np.frombuffer(x, np.int32) for x in codec.encode(texts)]
    assert [x.tolist() for x in got] == [enc.encode_ordinary(t) for t in texts]
    assert codec.decode(got) == [t.encode() for t in texts]


def test_byte_bpe_null_ids_and_clashing_names(spark):
    rows = spark.createDataFrame([([31373, None, 995], "x"), (None, "y"), ([10**6], "z")], "ids array<int>, decoded string")
    assert [bytes(r.decoded) for r in byte_bpe.decode(rows, queries.RANKS, P.PATTERN).collect()] == [b"hello world", b"", b""]


def _tokens(t):
    return (t or "").encode().lower().split()


def test_lattice_counts_and_marginals(docs, empty):
    pieces = lattice_lm.read_pieces(queries.PIECES)
    lattice = lattice_lm.Vocabulary(pieces)

    def brute(word):
        word = lattice_lm.START + word
        a = [0.0] + [-math.inf] * len(word)
        for e in range(1, len(word) + 1):
            terms = [a[s] + pieces[word[s:e]] for s in range(max(0, e - lattice.longest), e) if word[s:e] in pieces]
            if word[e - 1] not in pieces:
                terms.append(a[e - 1] + sum(pieces[f"<0x{b:02X}>"] for b in word[e - 1].encode()))
            a[e] = max(terms) + math.log(sum(math.exp(x - max(terms)) for x in terms)) if terms else -math.inf
        return a[-1]

    words = ["the", "x", "theaea", "漢字a", "🎉", "unción%%%", "a" * 200]
    assert np.allclose(lattice.marginals(words), [brute(w) for w in words])
    uses = lattice.expected(["the"], np.array([3.0]))
    assert sum(
        uses[i] * len(p)
        for i, p in enumerate(lattice.pieces) if uses[i]
    ) == pytest.approx(12)  # every character is covered, as often as the word occurs
    got = lattice_lm.score(docs, pieces, held_out(F.col("doc_id"), 10, 0)).collect()
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for i, t in texts(docs) if not out(i) for w in _tokens(t))
    ends = sum(not out(i) for i, _ in texts(docs))
    n, v = c.total() + ends, len(c) + 1
    base = lambda k: math.log10((k + 0.1) / (n + 0.1 * (v + 1)))
    want = Counter(
        (i, out(i), len(w := _tokens(t)) + 1, sum(x in c for x in w) + 1, n, round(sum(base(c[x]) for x in w) + base(ends), 5))
        for i, t in texts(docs)
    )
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(-math.inf < r.score <= 0 for r in got)
    assert lattice_lm.score(empty, pieces, held_out(F.col("doc_id"), 10, 0)).count() == 0


def _segmentations(word, pieces):
    """All ways to write a word in pieces; a character without a piece is one of its own."""
    if not word:
        yield ()
    for n in range(1, len(word) + 1):
        if word[:n] in pieces or n == 1:
            for rest in _segmentations(word[n:], pieces):
                yield (word[:n], *rest)


def _plain_model(rows, pieces, passes=lattice_lm.PASSES):
    """The model by enumeration: rows (class, words). Gives a function of (class, word), and the classes' log chances."""
    known = {p for p in pieces if not p.startswith("<0x")}
    spell = lambda p: 1.0 if p in known else math.prod(math.exp(weights[f"<0x{b:02X}>"]) for b in p.encode())
    weights, tokens = dict(pieces), Counter((z, w) for z, words in rows for w in words)
    ways = lambda w: list(_segmentations(lattice_lm.START + w, known))
    plain = lambda p: math.exp(weights[p]) if p in known else spell(p)

    def chances(w):
        each = [(way, math.prod(map(plain, way))) for way in ways(w)]
        total = sum(c for _, c in each)
        return [(way, c / total) for way, c in each]

    for _ in range(passes):
        uses = Counter()
        for (_, w), n in tokens.items():
            for way, c in chances(w):
                for p in way:
                    if p in known:
                        uses[p] += n * c
        total = sum(uses.values()) + lattice_lm.PRIOR
        weights = {p: math.log((uses[p] + lattice_lm.PRIOR * math.exp(x)) / total) for p, x in weights.items()}
    counts = Counter()
    for (z, w), n in tokens.items():
        pairs = Counter()
        for way, c in chances(w):
            counts[z, "^", way[0] if way[0] in known else None] += n * c
            counts[z, way[-1] if way[-1] in known else None, "$"] += n * c
            at = 0
            for a, b in zip(way, way[1:], strict=False):
                at += len(a)
                pairs[at, a, b] += c
        for (_, a, b), c in pairs.items():
            if c >= lattice_lm.LEAST and b in known:
                counts[z, a if a in known else None, b] += n * c
    classes, k = sorted({z for z, _ in rows}), lattice_lm.BACKOFF
    following, ending, of_class, every = Counter(), 0.0, Counter(), Counter()
    for (z, a, b), n in counts.items():
        of_class[z, a, b] += n
        every[a, b] += n
        following[z, a] += n
        following[None, a] += n
        ending += n * (b == "$")
    share = ending / sum(n for (z, a), n in following.items() if z is None and a != "^")

    def after(z, a, b):
        one = lambda p: p if p in known else None
        own = share if b == "$" else (plain(b) if b in known else 1.0) * (1.0 if a == "^" else 1 - share)
        key_a, key_b = (a if a == "^" else one(a)), (b if b == "$" else one(b))
        if key_b is None and a != "^":
            n, m = 0.0, 0.0
        else:
            n, m = every[key_a, key_b], of_class[z, key_a, key_b]
        base = (n + k * own) / (following[None, key_a] + k)
        return (m + k * base) / (following[z, key_a] + k) * (spell(b) if b != "$" and b not in known else 1.0)

    word = lambda z, w: sum(math.prod(after(z, a, b) for a, b in zip(("^", *way), (*way, "$"), strict=True)) for way in ways(w))
    texts, words = Counter(z for z, _ in rows), {z: sum(len(ws) for x, ws in rows if x == z) for z in classes}

    def text(ws):
        total = sum(
            (texts[z] + 1) / (len(rows) + len(classes)) * (texts[z] + 1) / (texts[z] + words[z] + 2) * math.prod(
                word(z, w) * (words[z] + 1) / (texts[z] + words[z] + 2)
                for w in ws
            )
            for z in classes
        )
        return math.log10(total)

    return text


def test_lattice_scores_equal_enumeration(spark):
    rng = np.random.default_rng(6)
    raw = {
        p: float(x)
        for p, x in zip(
            ["▁", "▁a", "▁ab", "a", "b", "c", "ab", "bc", "abc", "▁c", "é", *(f"<0x{i:02X}>" for i in range(256))],
            [*(-rng.random(11) * 3), *[-9.0] * 256], strict=True
        )
    }
    total = math.log(sum(map(math.exp, raw.values())))
    pieces = {p: x - total for p, x in raw.items()}
    vocab = ["ab", "abc", "a", "cab", "bcé", "éx", "漢a", "AB"]
    rows = [(i, " ".join(rng.choice(vocab[: 4 if i % 3 else 8], rng.integers(1, 9))), ("one", "two", "three")[i % 3], "clash") for i in range(40)]
    rows += [
        (100, None, "one", "x"), (101, " \t", "two", "x"), (None, "ab ab", "two", "x"), (None, "ab ab", "two", "x"),
        (102, "ab abcabc zz", None, "x")
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, word string")
    held = F.coalesce(F.col("doc_id") % 5 == 0, F.lit(False))
    got = lattice_lm.score(docs, pieces, held, F.col("lang")).collect()
    text = _plain_model([(z or "", [w.decode() for w in _tokens(t)]) for i, t, z, _ in rows if i is None or i % 5], pieces)
    want = sorted((i if i is not None else -1, text([w.decode() for w in _tokens(t)])) for i, t, _, _ in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in got) == [i for i, _ in want]
    assert [
        x
        for _, x in sorted((r.doc_id if r.doc_id is not None else -1, r.score) for r in got)
    ] == pytest.approx([x for _, x in want], rel=1e-5, abs=1e-5)


def test_lattice_scores_are_by_all_pairs(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").repartition(3)
    pieces, held = lattice_lm.read_pieces(queries.PIECES), held_out(F.col("doc_id"), 10, 0)
    scores = lambda: [x for _, x in sorted((r.doc_id, r.score) for r in lattice_lm.score(docs, pieces, held, F.col("lang")).collect())]
    want = scores()
    monkeypatch.setattr(lattice_lm, "PAIRS", 500)  # the others are joined to the words that have them
    monkeypatch.setattr(lattice_lm, "JOINED", 1000)
    assert scores() == pytest.approx(want, rel=1e-6)
    monkeypatch.setattr(lattice_lm, "FILTER_BITS", 1024)  # pairs are too many for a filter
    assert scores() == pytest.approx(want, rel=1e-6)


def test_unigram_marginals_equal_enumeration(spark, monkeypatch):
    monkeypatch.setattr(lattice_lm, "GROUP_BYTES", 40)
    monkeypatch.setattr(lattice_lm, "SERVES", 2)  # frequent words' rows serve two groups each
    monkeypatch.setattr(lattice_lm, "FREQUENT", 0.1)
    rng = np.random.default_rng(3)
    known = ["▁", "▁a", "▁ab", "a", "b", "ab", "bab", "aa", "é"]
    pieces = {p: -1.5 - float(x) for p, x in zip(known, rng.random(len(known)), strict=True)} | {f"<0x{i:02X}>": -9.0 for i in range(256)}
    spell = lambda p: math.exp(pieces[p]) if p in known else math.prod(math.exp(pieces[f"<0x{b:02X}>"]) for b in p.encode())
    marginal = lambda w: sum(math.prod(map(spell, way)) for way in _segmentations("▁" + w, set(known)))
    words = ["ab", "abab", "babaab", "a", "xaéb", "漢ab", "aabbaabbaab"]
    rows = [(i, " ".join(rng.choice(words, 1 + i % 6))) for i in range(30)] + [(None, "AB ab")] * 4 + [(50, None), (51, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, round(r.unigram_score, 4)) for r in lattice_lm.score(docs, pieces, F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False))).collect())
    want = Counter((i, round(math.log10(math.prod(marginal(w.decode()) for w in _tokens(t))), 4) + 0.0) for i, t in rows)
    assert got == want
    monkeypatch.setattr(lattice_lm, "SEGMENT", 3)  # longer words go through several segments
    cut = lattice_lm.Vocabulary(pieces).marginals(words)
    assert cut == pytest.approx([math.log(marginal(w)) for w in words])


def test_lattice_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "ab cd"), (2, None)], "doc_id long, text string")
    got = lattice_lm.score(docs, lattice_lm.read_pieces(queries.PIECES), F.lit(True)).collect()
    assert len(got) == 2 and all(r.held_out and r.train_tokens == 0 and r.n_known == 0 and -math.inf < r.score < 0 for r in got)


def test_lattice_beats_the_base_on_held_out_rows(spark):
    sums = queries.op2_lattice_lm(spark, "/root/testdata/sf0.01").where("held_out").agg(
        F.sum("score").alias("score"), F.sum("base_score").alias("base")
    ).first()
    assert sums.score > sums.base


def test_lattice_of_long_words_and_full_tables(monkeypatch):
    pieces = lattice_lm.read_pieces(queries.PIECES)
    model = lattice_lm.Model(pieces, np.array([0, 0]), np.array([5 << 20 | 7, 7 << 20 | lattice_lm.FINISH]), np.array([2.0, 2.0]), [10], [2])
    whole = model.word_scores(["theaea", "the" * 3000, "x" * 100_000])
    assert np.isfinite(whole).all() and (whole < 0).all()
    monkeypatch.setattr(lattice_lm, "SEGMENT", 3)
    parts = model.word_scores(["theaea"])[0, 0] - model.more[0]
    assert parts < whole[0, 0]  # a cut leaves ways out
    keys = np.random.default_rng(0).integers(1, 2**60, 3000).astype(np.uint64)
    table = lattice_lm.Table(keys, 11)  # more keys than places
    assert (table.lookup(keys) == np.arange(3000)).all() and (table.lookup(keys + np.uint64(2**61)) == 3000).all()


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"
}


def _valid(kind, value):
    d = [int(x) for x in re.sub("[^0-9]", "", value)]
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or (9 <= len(d) <= 15 if kind == "phone" else all(int(x) <= 255 for x in value.split(".")))


def test_pattern_spans_equal_brute_force(spark, docs, empty):
    odd = [
        "a@b.com_x@c.de a@b-c.d.e. @x.y 1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.255 é🎉 me@é.com z@q.r 4111 1111 1111 1111 4111-1111-1111-1112 +1 (22) 333-4444.5) +123 +12345678901234567",
        "x.y" * 30 + " a@b " + "1 2 3 4 5 6 7 8 9 0 1 2 8 " + "12--34" + "9" * 5000 + "a." * 5000 + "@b.c"
    ]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame([(-100 - i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    want = Counter(
        (i, ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, t or "") if _valid(k, m[0])))
        for i, t in texts(rows)
    )
    assert Counter(tuple(r) for r in disclosure.find(rows).select("doc_id", disclosure.listed(F.col("spans"))).collect()) == want
    assert disclosure.find(empty).count() == 0


def test_near_duplicates_of_short_sets_whose_estimate_is_far_off(spark):
    words = [f"w9806x{i}" for i in range(20)]
    rows = minhash.near_duplicates(
        spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:17]))], "doc_id long, text string"), 1, 0.85
    ).collect()
    assert {(r.doc_id, r.component_id) for r in rows} == {(1, 1), (2, 1)}


def test_pattern_spans_of_random_texts(spark):
    rng = np.random.default_rng(4)
    parts = ["0", "0.", "1", "25", "255", "256", ".", "00", " ", "+", "-", "@", "a", "b.c", "(", ")", "4111", "é"]
    rows = [(i, "".join(rng.choice(parts, 40))) for i in range(4000)] + [
        (-1, "192.168.0.1 127.0.0.1 x 1.2.3.00 8.8.8.8 0.0.0.0 10.0.0.1 000.1.2.3 000.000.000.000 00256.1.1.1 0.0.0.0.0.0.0.0")
    ]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = dict(tuple(r) for r in table.select("doc_id", disclosure.listed(disclosure.base_spans(F.col("text")))).collect())
    assert got == {i: ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, t) if _valid(k, m[0])) for i, t in rows}
    assert got[-1].count("ip:") == 10


def test_long_texts_take_time_in_proportion(spark):
    rng = np.random.default_rng(5)
    ips = " ".join(f"{a}.{b}.{c}.0 é" + "x" * (a % 90) for a, b, c in rng.integers(0, 256, (30_000, 3)))
    words = "a@b.com 0.0.0.0 " + " ".join(f"w{i}é" for i in rng.integers(0, 10**9, 100_000))
    docs = spark.createDataFrame([(1, ips), (2, words)], "doc_id long, text string")
    assert {r.doc_id: len(r.spans) for r in disclosure.find(docs).collect()} == {1: 30_000, 2: 2}
    clean = {r.doc_id: r.text for r in disclosure.sanitise(docs).collect()}
    assert clean[1] == re.sub(r"[0-9]+[.][0-9]+[.][0-9]+[.]0", "<ip>", ips) and clean[2] == "<email> <ip>" + words[15:]


def test_disclosing_terms_and_sanitising(spark):
    rows = [(i, f"call Zorblax ann at zz@a.com about 987 the number {i}", "clash") for i in range(4)]
    rows += [(10 + i, f"about the weather ann {i}", None) for i in range(400)] + [(99, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    found = {r.doc_id: [t.value for t in r.terms] for r in disclosure.find(docs).collect()}
    assert found[0] == ["call", "Zorblax", "at", "987", "number"] and found[10] == [] and found[99] == []
    clean = {r.doc_id: r for r in disclosure.sanitise(docs).collect()}
    assert clean[1].text == "<term> <name> ann <term> <email> about <number> the <term> 1" and clean[1].spans == "clash"
    assert clean[99].text is None and clean[11].text == "about the weather ann 1"


def test_terms_of_rare_entities_are_found_by_what_recurs(spark):
    one = ["p{}@glim.org", "10.20.30.{}", "4111 1100 0000 {:04d}", "+49 30 55500{}"]
    cards = [n for n in range(10_000) if _valid("card", f"4111 1100 0000 {n:04d}")]
    rows = [(10 * k + i, f"glimworth{k} wrote {x.format(cards[i] if k == 2 else i + 10)} rare{k}{i}") for k, x in enumerate(one) for i in range(6)]
    rows += [(100 + i, f"she wrote solo{i}@single{i}.net odd{i} strange{i // 2}") for i in range(20)] + [(200 + i, f"she wrote again {i}") for i in range(400)]
    found = {r.doc_id: [t.value for t in r.terms] for r in disclosure.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[10 * k + i] == [f"glimworth{k}"] for k in range(4) for i in range(6))
    assert not any(found[i] for i in range(100, 120))  # words of one or two documents prove nothing


def test_planted_names_are_found_and_random_rare_words_left(spark):
    rng = np.random.default_rng(9)
    common, rows = [f"common{i}" for i in range(60)], []
    for i in range(3000):
        person = i // 5 if i < 250 else None
        words = [*rng.choice(common, 12), *(f"rare{x}" for x in rng.integers(0, 3000, 4))]
        if person is not None:
            words += [f"Name{person}", f"p{person}@host{person}.org"]
        elif i < 500:
            words += [f"u{i}@mail.com"]
        rows.append((i, " ".join(rng.permutation(words))))
    terms = [(r.doc_id, t.value) for r in disclosure.find(spark.createDataFrame(rows, "doc_id long, text string")).collect() for t in r.terms]
    names = {t for t in terms if t[1].startswith("Name")}
    assert len(names) == 250 and len(names) >= 0.98 * len(terms)  # all found, next to nothing else


def test_disclosing_terms_equal_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    docs = docs.union(docs.where("text LIKE '%@%'").limit(3)).union(docs.where("text LIKE '%@%'").limit(3)).union(
        spark.createDataFrame([(-i, f"Ann{i % 3} x{i % 2} İ shared@a.com u{i}@b.org ΟΔΟΣ.Α q{i} 10.0.{i % 2}.{i}") for i in range(1, 19)], "doc_id long, text string")
    ).cache()
    rows = disclosure.find(docs).join(docs.select("doc_id", "text").distinct(), "doc_id").collect()

    def entities(s):
        digits = re.sub("[^0-9]", "", s.value)
        return {
            "email": (s.value.lower(), "@" + s.value.lower().split("@")[-1]), "ip": (s.value, s.value.rsplit(".", 1)[0]),
            "card": ("c" + digits, "i" + digits[:6]), "phone": ("p" + digits, "f" + digits[:4])
        }[s.kind]

    seen = [({e for s in r.spans for e in entities(s)}, {w.lower() for w in regex.findall(r"[\p{L}\p{M}\p{N}]+", r.text or "")}) for r in rows]
    n_entity, n_term = Counter(e for es, _ in seen for e in es), Counter(t for _, ts in seen for t in ts)
    holders = {e: frozenset(i for i, (es, _) in enumerate(seen) if e in es) for e in n_entity}
    both = Counter((h, t) for es, ts in seen for h in {holders[e] for e in es} for t in ts)
    z2 = 1.64**2
    able = {(h, t): k for (h, t), k in both.items() if len(h) > z2 and 2 * len(h) <= len(rows) and n_term[t] > z2 and n_term[t] < 2 * len(h)}

    def discloses(h, t, k):
        m = n_term[t]
        roots = np.roots([1 + z2 / m, -2 * k / m - z2 / m, (k / m) ** 2])  # (p - k/m)^2 = z^2 p (1 - p) / m
        p, bits = min(roots.real), math.log2(len(rows) / len(h))
        return p >= 0.5 and math.log2(p) + bits >= 1 and k * bits >= math.log2(len(able)) + 7

    flagged = {x for x, k in able.items() if discloses(*x, k)}
    for r, (es, _) in zip(rows, seen, strict=True):
        hits = [
            (m.start(), m.end(), m.group())
            for m in regex.finditer(r"[\p{L}\p{M}\p{N}]+", r.text or "") if any((holders[e], m.group().lower()) in flagged for e in es)
        ]
        assert [(t.start, t.end, t.value) for t in r.terms] == [h for h in hits if not any(s.start < h[1] and h[0] < s.end for s in r.spans)]
    assert sum(len(r.terms) for r in rows) > 20


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(docs, empty, width, percent, monkeypatch):
    monkeypatch.setattr(minhash, "BAND_BLOCK", 4)
    monkeypatch.setattr(minhash, "SET_BLOCK", 4)
    sets, same = [], defaultdict(list)
    for i, t in texts(docs):
        w = _tokens(t)
        sets.append(
            (i, frozenset(tuple(w[j : j + width]) for j in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
        )
        same[i].append(len(sets) - 1)
    links = defaultdict(set)
    for a, (i, x) in enumerate(sets):
        for b, (j, y) in enumerate(sets):
            if None not in (i, j) and x and y and 100 * len(x & y) >= percent * len(x | y):
                links[a].add(b)
        links[a] |= set(same[i]) if i is not None else {a}

    def least(a):
        seen, todo = {a}, [a]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        return min(sets[b][0] for b in seen)

    want = Counter((i, len(s), None if i is None else least(a), i is None or least(a) == i) for a, (i, s) in enumerate(sets))
    assert Counter(tuple(r) for r in minhash.near_duplicates(docs, width, percent / 100).collect()) == want
    assert minhash.near_duplicates(empty, width, percent / 100).count() == 0


def test_small_sets_share_sketches_as_jaccard_says():
    rng = np.random.default_rng(0)
    gaps = []
    for n in (7, 30, 400):
        for _ in range(20):
            common = rng.integers(0, 2**63, n).astype(np.uint64)
            extra = rng.integers(0, 2**63, max(1, n // 8)).astype(np.uint64)
            a, b = np.unique(common), np.unique(np.concatenate([common, extra]))
            regs = minhash.sketches([a, b])
            gaps.append(minhash.estimate((regs[0] == regs[1]).sum(), len(a), len(b)) - len(a) / len(b))
    assert abs(np.mean(gaps)) < 0.02 and np.abs(gaps).max() < 0.2


def test_components_of_hubs(spark, monkeypatch):
    from contrapoint.llm import common

    monkeypatch.setattr(common, "HUB_EDGES", 3)
    rng = np.random.default_rng(2)
    edges = [(100 + i, 1) for i in range(20)] + [(500, 500 + i) for i in range(1, 30)] + [(int(a), int(b)) for a, b in rng.integers(1000, 1060, (70, 2))] + [(105, 520)]
    label = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = dict(tuple(r) for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {x: z for x, z in label.items() if any(x in e and e[0] != e[1] for e in edges)}


def test_rows_that_may_be_among_ids(spark):
    from contrapoint.llm import common

    rows, ids = spark.range(20_000).withColumn("text", F.lit("x")), spark.range(0, 20_000, 40).select(F.col("id").alias("k"))
    some = common.maybe_among(rows, "id", ids)
    assert some.columns == ["id", "text"] and some.join(ids, F.col("id") == F.col("k")).count() == 500 and some.count() < 1100
    assert common.maybe_among(rows, "id", ids, 512).count() == 20_000 and common.maybe_among(rows, "id", ids.limit(0)).count() == 0


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 2), (9, 8), (7, 7), (2, 1), (8, 10), (None, 3)]
    got = dict(tuple(r) for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8, 10: 8}


def test_quality_on_held_out_rows(spark, docs, empty):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [r for r in queries.op6_quality_classifier(spark, d).collect() if r.held_out and r.doc_id in labels]
    assert np.mean([(r.score >= 0.5) == labels[r.doc_id] for r in rows]) > 0.93
    model = subword_classifier.train([b"good words here", b"bad!!! stuff!!!"] * 20, [1, 0] * 20)
    got = subword_classifier.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got) and subword_classifier.score(empty, model).count() == 0
    none = subword_classifier.train([], [])
    assert {r.score for r in subword_classifier.score(docs, none).collect()} == {0.5}


def test_language_on_held_out_rows(spark, docs, empty):
    d = "/root/testdata/sf0.01"
    real = {r.doc_id: (r.lang, r.n_chars) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = [r for r in queries.op8_language_id(spark, d).collect() if r.held_out]
    assert np.mean([r.lang_pred == real[r.doc_id][0] for r in rows]) > 0.97
    model = gru_language.fit(spark.read.parquet(f"{DATA}/documents.parquet"), lambda i: i.isNotNull())
    got = defaultdict(set)
    for r in gru_language.predict(docs, model).collect():
        got[r.doc_id].add((r.lang_pred, r.score))
    assert got[-1] == got[-2] == got[-3] == got[-12] == {("und", 0.0)} and all(len(x) == 1 for x in got.values())
    assert gru_language.predict(empty, model).count() == 0
    assert {r.lang_pred for r in gru_language.predict(docs, ([], {})).collect()} == {"und"}


def test_gru_gradients():
    rng = np.random.default_rng(0)
    seq, mask = rng.integers(0, 256, (5, 3)).astype(np.uint8), np.ones((5, 3), np.float32)
    x, u = rng.normal(0, 0.2, (24, 256)) + 0.3, rng.normal(0, 0.2, (24, 8))
    loss = lambda x, u: sum((k[5] ** 2).sum() for k in gru_language._forward(x, u, seq, mask))
    dx, du = gru_language._backward(x, u, seq, mask, kept := gru_language._forward(x, u, seq, mask), [2 * k[5] for k in kept])
    for i, j in ((1, 2), (10, 3), (20, 5)):
        step = np.zeros_like(u)
        step[i, j] = 1e-4
        assert (loss(x, u + step) - loss(x, u - step)) / 2e-4 == pytest.approx(du[i, j], rel=0.02, abs=2e-3)
    step = np.zeros_like(x)
    step[20, seq[2, 1]] = 1e-4
    assert (loss(x + step, u) - loss(x - step, u)) / 2e-4 == pytest.approx(dx[20, seq[2, 1]], rel=0.02, abs=2e-3)


def test_gru_fast_path_equals_plain_states(monkeypatch):
    for name, value in (("BYTES", 16), ("CONTEXT", 8), ("TOGETHER", 5)):
        monkeypatch.setattr(gru_language, name, value)
    p, rng = gru_language._init(3, seed=8), np.random.default_rng(1)
    texts = [rng.integers(0, 256, n).astype(np.uint8).tobytes() for n in (0, 1, 7, 16, 17, 24, 40, 90)]
    want = np.zeros((len(texts), 3))
    for i, t in enumerate(texts):
        for a in range(0, len(t), 16):
            before, window, after = (np.frombuffer(x, np.uint8) for x in (t[max(0, a - 8) : a], t[a : a + 16], t[a + 16 : a + 24]))
            f = gru_language._forward(p["xf"], p["uf"], s := np.concatenate([before, window])[:, None], np.ones(s.shape, np.float32))[len(before) :]
            b = gru_language._forward(p["xb"], p["ub"], s := np.concatenate([window, after])[::-1, None], np.ones(s.shape, np.float32))[::-1]
            for t_f, t_b in zip(f, b[: len(window)], strict=True):
                z = np.exp(p["w"] @ np.concatenate([t_f[5], t_b[5]]) + p["c"])
                want[i] += (z / z.sum())[:, 0]
    assert np.allclose(gru_language.text_sums(p, texts), want, atol=1e-4)


def test_language_learns_from_whole_texts(spark):
    rows = [
        (i, "x" * 3000 + ("ab" if i % 2 else "cd") * 700, "one" if i % 2 else "two")
        for i in range(40)
    ] + [(99, None, "one"), (None, "ab", "two"), (98, "", "three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = gru_language.fit(docs, lambda i: i.isNotNull())
    assert model[0] == ["one", "three", "two"]
    got = gru_language.predict(spark.createDataFrame([("ab" * 50,), ("cd" * 50,)], "text string"), model).collect()
    assert [r.lang_pred for r in got] == ["one", "two"]


def test_labelled_sample_is_bounded_and_takes_whole_texts(spark):
    rows = spark.createDataFrame(
        [(i, i % 2, "y" * (50 if i == 3 else 10)) for i in range(20)] + [(7, 1, "y" * 10)], "id long, label int, text string"
    )
    got = labelled_sample(rows, 15, 100)
    assert 5 <= len(got) <= 10 and {len(r.text) for r in got} <= {10, 50} and sum(len(r.text) for r in got) <= 100
    assert len(labelled_sample(rows, 100, 1000)) == 20


def test_quality_score_equals_plain_recomputation(spark):
    table, weights, bias = model = subword_classifier.train([b"good words here", b"bad!!! stuff!!!"] * 20, [1, 0] * 20)
    mix = lambda x: ((y := (x ^ x >> 32) * 0xD6E8FEB86659FD93 % 2**64) ^ y >> 29)

    def plain(text):
        ids, hashes = [], []
        for w in text.encode().split():
            raw = b"\x01" + w + b"\x02"
            hashes.append(mix(sum(mix(c + (i << 8)) for i, c in enumerate(raw)) % 2**64))
            ids += [hashes[-1], *(mix((n << 8 * n) + int.from_bytes(raw[i : i + n], "big")) for n in (3, 4) for i in range(len(raw) - n + 1))]
        ids += [mix((a * 3 + b) % 2**64) for a, b in zip(hashes, hashes[1:], strict=False)]
        z = (np.mean([table[i % subword_classifier.BUCKETS] for i in ids], axis=0) if ids else np.zeros(subword_classifier.DIM)) @ weights + bias
        return 1 / (1 + math.exp(z[0] - z[1]))

    texts = ["good words", "", "x", "bad!!! é漢 good good " * 30]
    got = subword_classifier.score(spark.createDataFrame([(t,) for t in texts], "text string"), model).collect()
    assert [r.score for r in got] == pytest.approx([plain(t) for t in texts], abs=1e-6)


def test_packing(docs, empty):
    rows = packing.pack_documents(docs, queries.WORD_BPE).collect()
    t = Tokenizer.from_file(queries.WORD_BPE)
    want = Counter()
    for i, x in texts(docs):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        want.update((i, n, a, len(c := ids[a : a + 4096]), zlib.crc32(np.array(c, "<u4").tobytes())) for n, a in enumerate(range(0, len(ids), 4096)))
    assert Counter(tuple(r)[:5] for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= -(-sum(r.length for r in rows) // 4096) * 1.05 + 2
    assert packing.pack_documents(empty, queries.WORD_BPE).count() == 0


def test_packing_ids_of_marks_and_odd_letters_equal_the_tokenizer():
    with open(queries.WORD_BPE, encoding="utf-8") as f:
        own = packing.WordIds(f.read())
    rng = np.random.default_rng(5)
    parts = [
        *"aBjJtTzİıſßŉΣςДЪñÉ漢字ﬁ７٣5xQ", *"\u030c\u0308\u0301\u0323\u0345\u200d\u1c89", *",.!?'-<|>_", "'s", "'LL", "<|endoftext|>",
        "<|startoftext|>", " ", "\u00a0", "\u0085", "\t", "ARİ", "K", "Å"
    ]
    texts = ["TARİHİ, J\u030c T\u0308! ǰ Ǆ! A\u0323\u0302."] + [
        "".join(parts[k] for k in rng.integers(0, len(parts), rng.integers(1, 14)))
        for _ in range(30_000)
    ]
    words = [own.split(t.encode()) for t in texts]
    own.learn(list(set().union(*words)))
    for t, ws, e in zip(texts, words, Tokenizer.from_file(queries.WORD_BPE).encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(b"".join(own.known[w] for w in ws), np.uint32).tolist() == e.ids, t


def test_packing_of_rows_alike_and_clashing_names(spark):
    rows = spark.createDataFrame(
        [(None, 0, 0, 100, 7, "x", 1, 2, 3)] * 300,
        "doc_id long, piece int, start long, length long, ids_crc32 long, salt string, rank int, row int, offset int"
    )
    got = packing.pack(rows).collect()
    assert len(got) == 300 and len({(r.sequence_id, r.offset) for r in got}) == 300 and {r.salt for r in got} == {"x"} and all(r.offset % 100 == 0 for r in got)


def test_plan_fills_every_rank_once():
    rng = np.random.default_rng(2)
    for _ in range(100):
        counts = {int(n): int(rng.integers(1, 200)) for n in rng.integers(1, 41, 12)}
        plan, bins = packing.plan(counts, 40), defaultdict(list)
        for length, count in counts.items():
            own = plan[plan["length"] == length].sort_values("rank")
            for r in range(count):
                s = own.iloc[np.searchsorted(own["rank"].to_numpy(), r, side="right") - 1]
                n = r - s["rank"]
                bins[s["bin"] + n // s["each"]].append((s["offset"] + n % s["each"] * length, length))
        for parts in bins.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 40


def test_new_words_of_a_text_take_little_memory():
    """Features of many new words are looked up a few at a time."""
    table, words = np.ones((subword_classifier.BUCKETS, subword_classifier.DIM), np.float32), [b"word%09d" % i for i in range(40_000)]
    features = subword_classifier.Features()
    tracemalloc.start()
    total, number = features.texts([b" ".join(words)], table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6
    assert number[0] == 40_000 * (1 + 13 + 12) + 39_999 and np.allclose(total[0], number[0])


def test_a_model_that_is_made_leaves_no_freed_memory():
    """What making a model takes goes back to the system, not only what lies at the heap's end."""

    def held():
        return int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024

    def make(value):
        return [np.ones(8000) for _ in range(4000)][::20]  # 256 MB, of which 13 lie between what is freed

    worker_cache("another")
    before = held()
    assert len(lattice_lm._cached(SimpleNamespace(value=("key", None)), make)) == 200
    after = held()
    worker_cache("another")
    assert after - before < 60
