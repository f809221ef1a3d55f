"""Supervised subword embeddings: averaged hashed n-gram vectors under a softmax, trained by stochastic gradient descent.

A text's features are its words, its neighbouring word pairs and the byte 3- and 4-grams of each word between boundary
marks, all hashed to one table of learned vectors; their mean goes through a softmax layer. ``fit`` trains in numpy on the
whole texts of a bounded sample of labelled rows (at most ``SAMPLE`` rows, the least hashes of the ids, and
``SAMPLE_BYTES`` bytes); ``score`` reads every whole text.

Null and empty texts have no features and score the learned bias. Rows without a label or id do not train; with no
labelled row at all the bias is even. Repeated rows score alike. An empty table gives an empty one.
"""

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, labelled_sample, small_batches, worker_cache

#: Labelled rows that train at most; vectors and their length; passes and first learning rate; words a task remembers.
SAMPLE, BUCKETS, DIM, EPOCHS, RATE, KEPT_WORDS = 2000, 1 << 16, 16, 4, 0.5, 150_000
#: Texts of a step and new words whose features are looked up at a time, so that a worker's memory has no peaks.
STEP, STEP_WORDS = 100, 4000
#: Bytes of the sample's texts at most.
SAMPLE_BYTES = 16_000_000
#: Steps at least, so that few rows are passed more often.
LEAST_STEPS = 1500


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of all words' own features, each word's number of them, and each word's hash."""
    marked = [b"\x01%b\x02" % w for w in words]
    lens = np.fromiter(map(len, marked), np.int64, len(words))
    raw = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    owner, ends = np.repeat(np.arange(len(words)), lens), np.cumsum(lens)
    place = np.arange(len(raw)) - np.repeat(ends - lens, lens)
    # A word's hash sums its bytes' mixes with their places.
    whole = _mix(np.add.reduceat(_mix(raw + (place.astype(np.uint64) << np.uint64(8))), ends - lens))
    buckets, owners = [whole], [np.arange(len(words))]
    for n in (3, 4):
        m = len(raw) - n + 1
        if m > 0:
            gram = np.full(m, n, np.uint64)
            for i in range(n):
                gram = gram << np.uint64(8) | raw[i : i + m]
            inside = owner[:m] == owner[n - 1 :]
            buckets.append(_mix(gram[inside]))
            owners.append(owner[:m][inside])
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return (np.concatenate(buckets)[order] % np.uint64(BUCKETS)).astype(np.int32), np.bincount(owners, minlength=len(words)), whole


class Features:
    """Words seen so far: row numbers, hashes and features."""

    def __init__(self):
        self.rows: dict[bytes, int] = {}
        self.hash, self.count, self.sums = np.empty(0, np.uint64), np.empty(0, np.int64), None

    def texts(self, texts: list[bytes], table: np.ndarray):
        """Sums of the texts' feature vectors and their numbers of features."""
        words = [t.split() for t in texts]
        new = list(set().union(*words).difference(self.rows))
        if len(self.rows) + len(new) > KEPT_WORDS and self.rows:
            self.__init__()
            new = list(set().union(*words))
        if new:
            parts = []
            for a in range(0, len(new), STEP_WORDS):
                buckets, counts, hashes = word_features(new[a : a + STEP_WORDS])
                parts.append((hashes, counts, np.add.reduceat(table[buckets], np.cumsum(counts) - counts)))
            hashes, counts, sums = zip(*parts, strict=True)
            self.rows.update(zip(new, range(len(self.hash), len(self.hash) + len(new)), strict=True))
            self.hash, self.count = np.concatenate([self.hash, *hashes]), np.concatenate([self.count, *counts])
            self.sums = np.concatenate([*([] if self.sums is None else [self.sums]), *sums])
        lens = np.fromiter(map(len, words), np.int64, len(words))
        at = np.fromiter(map(self.rows.__getitem__, chain.from_iterable(words)), np.int64, lens.sum())
        total, number = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts), np.int64)
        ends = np.cumsum(lens)
        for i, (a, b) in enumerate(zip((ends - lens).tolist(), ends.tolist(), strict=True)):
            if b > a:
                own = at[a:b]
                total[i] = self.sums[own].sum(0)
                pairs = pair_buckets(self.hash[own])
                total[i] += table[pairs].sum(0)
                number[i] = self.count[own].sum() + len(pairs)
        return total, number


def pair_buckets(hashes: np.ndarray) -> np.ndarray:
    return (_mix(hashes[:-1] * np.uint64(3) + hashes[1:]) % np.uint64(BUCKETS)).astype(np.int32)


def train(texts: list[bytes], labels: list[int], classes: int = 2, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vectors, the softmax weights and its bias."""
    rng = np.random.default_rng(seed)
    table = (rng.random((BUCKETS, DIM), np.float32) - np.float32(0.5)) / DIM
    weights, bias = np.zeros((DIM, classes)), np.zeros(classes)
    passes = max(EPOCHS, -(-LEAST_STEPS // max(1, len(texts))))
    steps, done = max(1, passes * len(texts)), 0
    for _ in range(passes):
        for i in rng.permutation(len(texts)):
            rate = RATE * (1 - done / steps)
            done += 1
            if words := texts[i].split():
                distinct = {w: k for k, w in enumerate(dict.fromkeys(words))}
                buckets, counts, hashes = word_features(list(distinct))
                own = np.fromiter(map(distinct.__getitem__, words), np.int64, len(words))
                times = np.repeat(np.bincount(own, minlength=len(distinct)), counts)
                ids = np.concatenate([buckets, pair_buckets(hashes[own])])
                times = np.concatenate([times, np.ones(len(words) - 1, np.int64)])
                ids, place = np.unique(ids, return_inverse=True)
                share = np.bincount(place, times) / times.sum()
                hidden = share @ table[ids]
            else:
                ids, share, hidden = np.empty(0, np.int64), np.empty(0), np.zeros(DIM)
            p = np.exp((z := hidden @ weights + bias) - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = weights @ p
            weights -= rate * np.outer(hidden, p)
            bias -= 0.05 * rate * p
            # Each vector moves by its share of the mean against an even share, at most threefold.
            table[ids] -= (rate * np.minimum(len(ids) * share, 3)[:, None] * back).astype(np.float32)
    return table, weights, bias


def fit(docs: DataFrame, labels: DataFrame, label: str, train_rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Train on at most ``SAMPLE`` rows of ``labels`` for whose id ``train_rows`` holds.

    A row with labels of both kinds trains with both; an id that no document has does not train.
    """
    own = labels.select(
        F.col("doc_id").alias("id"), F.col(label).cast("int").alias("label")
    ).where("label IN (0, 1) AND id IS NOT NULL").where(train_rows(F.col("id"))).distinct()
    # So many labels at most meet the documents; their size is bounded by SAMPLE.
    own = own.orderBy(F.xxhash64("id"), "id", "label").limit(SAMPLE)
    rows = labelled_sample(docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(own), "id"), SAMPLE, SAMPLE_BYTES)
    return train([r.text.encode() for r in rows], [r.label for r in rows])


def score(docs: DataFrame, model, out: str = "score") -> DataFrame:
    """``docs`` with ``out``, the probability of class 1, in place of a column of that name; only the text goes to Python."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        worker_cache("subword_classifier")
        table, weights, bias = sent.value
        features = Features()
        for batch in batches:
            found = []
            for at in range(0, len(batch), STEP):
                total, number = features.texts(pc.cast(batch.slice(at, STEP), pa.binary()).to_pylist(), table)
                z = total / np.maximum(number, 1)[:, None] @ weights + bias
                found.append(1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -700, 700))))
            yield pa.array(np.concatenate([*found, np.empty(0)]))
        del features
        give_back()

    # Called non-deterministic so that a filter on the result does not run it twice.
    udf = F.arrow_udf(run, "double").asNondeterministic()
    return small_batches(docs).withColumn(out, udf(F.coalesce("text", F.lit(""))))
