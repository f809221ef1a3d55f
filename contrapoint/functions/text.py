"""Text similarity: tokens, n-gram overlap, longest common subsequence, BLEU and token edits."""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Other names of the metrics and encoders.
METRIC_ALIASES = {
    "rouge1": "rouge_1", "rouge-1": "rouge_1", "rouge2": "rouge_2", "rouge-2": "rouge_2", "rougel": "rouge_l", "rouge-l": "rouge_l",
    "levenshtein_lcs": "lcs"
}
ENCODER_ALIASES = {
    "sbert": "bert", "sentence-bert": "bert", "all-minilm-l6-v2": "minilm", "w2v": "word2vec", "word2vec_avg": "word2vec", "raw_text": "raw",
    "none": "raw", "tf-idf": "tfidf",
}
#: White space that ends a token, in Java's and Python's pattern syntax alike.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"
SMOOTH = 1e-12


def encoder_name(name: str) -> str:
    key = str(name).strip().lower()
    return ENCODER_ALIASES.get(key, key)


def metric_name(name: str) -> str:
    key = METRIC_ALIASES.get(str(name).strip().lower(), str(name).strip().lower())
    if key not in SIMILARITIES:
        raise ValueError(f"unknown text metric {name!r}")
    return key


def tokens(text: Column) -> Column:
    """Lower-cased tokens between white space; a null text has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), lambda t: t != "")


def ngrams(toks: Column, n: int) -> Column:
    """The n-grams of a token array in order, joined by blanks."""
    count = F.size(toks) - n + 1
    return F.when(count < 1, F.expr("CAST(array() AS array<string>)")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.array_join(F.slice(toks, i, n), " "))
    )


def rouge_n(a: Column, b: Column, n: int) -> Column:
    """F1 of the shared n-grams, counted with repeats; two empty sides score 1, one empty side 0. JVM only."""
    x, y = ngrams(a, n), ngrams(b, n)
    times = lambda arr, t: F.size(F.filter(arr, lambda u: u == t))
    shared = F.aggregate(F.array_distinct(x), F.lit(0), lambda s, t: s + F.least(times(x, t), times(y, t)))
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(2.0 * shared / (F.size(x) + F.size(y)))


def token_edits(a: Column, b: Column) -> Column:
    """Levenshtein distance over tokens: each distinct token of a pair becomes one character.

    Characters run from U+0100 to U+D7FF, so a pair may hold 55,039 distinct tokens; more raise.
    """
    words = F.array_distinct(F.concat(a, b))
    letter = lambda t: F.decode(F.unhex(F.lpad(F.hex((F.array_position(words, t) + 255).cast("long")), 4, "0")), "UTF-16BE")
    coded = F.levenshtein(F.array_join(F.transform(a, letter), ""), F.array_join(F.transform(b, letter), ""))
    return F.when(F.size(words) <= 55_039, coded).otherwise(F.raise_error(F.lit("too many distinct tokens in a pair")).cast("int"))


def edit_sparsity(factual: Column, candidate: Column) -> Column:
    """Token edits per factual token (at least one); it may exceed 1."""
    return token_edits(factual, candidate) / F.greatest(F.size(factual), F.lit(1))


def lcs_length(a: list, b: list) -> int:
    """Longest common subsequence by bit-parallel addition (Crochemore et al.; Hyyrö)."""
    if not a or not b:
        return 0
    places: dict = {}
    for i, t in enumerate(a):
        places[t] = places.get(t, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for t in b:
        hit = row & places.get(t, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def lcs_similarity(a: list, b: list) -> float:
    return lcs_length(a, b) / max(len(a), len(b)) if a or b else 1.0


def rouge_l_similarity(a: list, b: list) -> float:
    if not a or not b:
        return float(not a and not b)
    return 2.0 * lcs_length(a, b) / (len(a) + len(b))


def rouge_n_similarity(n: int):
    def f(a: list, b: list) -> float:
        x, y = (Counter(zip(*(t[i:] for i in range(n)), strict=False)) for t in (a, b))
        if not x or not y:
            return float(not x and not y)
        return 2.0 * (x & y).total() / (x.total() + y.total())

    return f


def bleu_similarity(a: list, b: list, most: int = 4) -> float:
    """Geometric mean of smoothed n-gram precisions of ``b`` against ``a``, with a brevity penalty."""
    if not b:
        return float(not a)
    orders = range(1, min(most, len(b), max(len(a), 1)) + 1)
    logs = []
    for n in orders:
        x, y = (Counter(zip(*(t[i:] for i in range(n)), strict=False)) for t in (a, b))
        logs.append(math.log(max(((x & y).total() + SMOOTH) / (y.total() + SMOOTH), SMOOTH)))
    penalty = 1.0 if len(b) > len(a) else math.exp(1 - len(a) / len(b))
    return min(1.0, max(0.0, penalty * math.exp(sum(logs) / len(logs))))


SIMILARITIES = {
    "lcs": lcs_similarity, "rouge_l": rouge_l_similarity, "rouge_1": rouge_n_similarity(1), "rouge_2": rouge_n_similarity(2),
    "bleu": bleu_similarity
}


def _grams(tokens_: list, n: int) -> Counter:
    return Counter(zip(*(tokens_[i:] for i in range(n)), strict=False))


class _Postings:
    """The n-grams of a block of candidates: each n-gram of a query adds to the candidates that hold it."""

    def __init__(self, c: list, n: int):
        own = [_grams(list(t), n) for t in c]
        self.sizes, postings = np.array([g.total() for g in own], float), {}
        for j, g in enumerate(own):
            for gram, k in g.items():
                places, counts = postings.setdefault(gram, ([], []))
                places.append(j)
                counts.append(k)
        self.postings = {gram: (np.array(j), np.array(k)) for gram, (j, k) in postings.items()}
        self.n = n

    def shared(self, t: list) -> tuple[np.ndarray, int]:
        """How many n-grams of ``t`` each candidate shares, counted with repeats, and how many ``t`` has."""
        out, g = np.zeros(len(self.sizes)), _grams(t, self.n)
        for gram, k in g.items():
            if gram in self.postings:
                j, counts = self.postings[gram]
                out[j] += np.minimum(k, counts)
        return out, g.total()


def _rouge_kernel(n: int):
    """ROUGE-n distances of a block by postings."""

    def f(q: list, c: list, k: int | None = None) -> np.ndarray:
        held, out = _Postings(c, n), np.empty((len(q), len(c)))
        for row, t in zip(out, q, strict=True):
            shared, size = held.shared(list(t))
            both = size + held.sizes
            row[:] = 1 - np.where(both > 0, 2 * shared / np.maximum(both, 1), 1.0)
        return out

    return f


def _bleu_kernel(q: list, c: list, k: int | None = None, most: int = 4) -> np.ndarray:
    """BLEU distances of a block: the clipped counts of every order come from postings."""
    held, out = [_Postings(c, n) for n in range(1, most + 1)], np.empty((len(q), len(c)))
    lens = np.array([len(t) for t in c], float)
    for row, t in zip(out, q, strict=True):
        t = list(t)
        orders = np.minimum(np.minimum(most, lens), max(len(t), 1))
        logs = np.zeros(len(c))
        for n, p in enumerate(held, 1):
            shared, _ = p.shared(t)
            logs += np.where(n <= orders, np.log(np.maximum((shared + SMOOTH) / (p.sizes + SMOOTH), SMOOTH)), 0.0)
        safe = np.maximum(lens, 1)
        penalty = np.where(lens > len(t), 1.0, np.exp(1 - len(t) / safe))
        value = np.clip(penalty * np.exp(logs / np.maximum(orders, 1)), 0.0, 1.0)
        row[:] = 1 - np.where(lens > 0, value, float(not t))
    return out


def _subsequence_kernel(of_length):
    """Distances 1 - ``of_length``(common length, lengths) of a block; with ``k``, only those that can be among a query's k least.

    A common subsequence is no longer than the tokens that both share, counted with repeats, so postings bound every
    distance from below. Candidates are taken in the order of their bounds until none can enter the k best; the others
    are infinite. Equal bounds are all taken, so ties are kept.
    """

    def f(q: list, c: list, k: int | None = None) -> np.ndarray:
        held, lens = _Postings(c, 1), np.array([len(t) for t in c])
        out = np.full((len(q), len(c)), np.inf)
        for row, t in zip(out, q, strict=True):
            places: dict = {}
            for i, x in enumerate(t):
                places[x] = places.get(x, 0) | 1 << i
            full, shared = (1 << len(t)) - 1, held.shared(list(t))[0]
            bound = 1 - of_length(shared, len(t), lens)
            order = np.argsort(bound, kind="stable")
            best, most = [], len(c) if k is None else k
            for j in order.tolist():
                if len(best) == most and bound[j] > -best[0] + 1e-8:
                    break
                common = 0
                if shared[j]:
                    state = full
                    for hit in [places[x] for x in c[j] if x in places]:
                        now = state & hit
                        state = ((state + now) | (state - now)) & full
                    common = len(t) - state.bit_count()
                row[j] = 1 - of_length(np.array([common]), len(t), lens[j : j + 1])[0]
                (heapq.heappush if len(best) < most else heapq.heappushpop)(best, -row[j])
        return out

    return f


def _rouge_l(common: np.ndarray, n: int, lens: np.ndarray) -> np.ndarray:
    return np.where((lens > 0) & (n > 0), 2 * common / np.maximum(lens + n, 1), ((lens == 0) & (n == 0)).astype(float))


def _lcs(common: np.ndarray, n: int, lens: np.ndarray) -> np.ndarray:
    return np.where((lens > 0) | (n > 0), common / np.maximum(np.maximum(lens, n), 1), 1.0)


KERNELS = {
    "rouge_1": _rouge_kernel(1), "rouge_2": _rouge_kernel(2), "rouge_l": _subsequence_kernel(_rouge_l), "lcs": _subsequence_kernel(_lcs),
    "bleu": _bleu_kernel
}


def kernel(metric: str):
    """(queries' tokens, candidates' tokens, k) -> matrix of 1 - similarity; what can't be among a query's k least may be infinite."""
    return KERNELS[metric_name(metric)]


def distance(metric: str):
    """A function of two token columns that gives 1 - similarity, in Arrow batches."""
    f = SIMILARITIES[metric_name(metric)]

    @F.pandas_udf("double")
    def udf(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([1.0 - min(1.0, max(0.0, f(list(x), list(y)))) for x, y in zip(a, b, strict=True)])

    return udf


def clean_html(text: Column) -> Column:
    """Without tags, white space runs as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", " "), r"\s+", " "))


def url_domain(url: Column) -> Column:
    """The host without a leading www."""
    return F.regexp_replace(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), r"^www\.", "")


def parse_list(text: Column) -> Column:
    """The quoted elements of a list that was written as text, such as ['a', "b"]; none for anything else."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"""'((?:[^'\\]|\\.)*)'|"((?:[^"\\]|\\.)*)\""""), F.lit(0))
    return F.when(
        F.coalesce(text, F.lit("")).rlike(r"^\s*\["), F.transform(found, lambda t: F.substring(t, F.lit(2), F.length(t) - 2))
    ).otherwise(F.expr("CAST(array() AS array<string>)"))
