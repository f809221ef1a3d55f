"""Text and image representations: TF-IDF, word vector means, lookups with live fallback, and encoder hooks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, NumericType

from ..functions.vectors import SparseRows, l2_normalised
from .kept import written
from .preprocess import draw, numbered
from .search import knn

#: Letters, digits and underscores, two at least.
WORD = r"[\p{L}\p{N}_]{2,}"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def tfidf_fit(train: DataFrame, max_features: int | None = None) -> DataFrame:
    """(``term``, ``idf``) over training texts: ln((1 + n) / (1 + df)) + 1; the most frequent terms if limited."""
    total = train.count()
    terms = train.select("sample_id", F.explode(words(F.col("text"))).alias("term"))
    counts = terms.groupBy("term").agg(F.count_distinct("sample_id").alias("df"), F.count("*").alias("cf"))
    if max_features is not None:
        counts = counts.orderBy(F.col("cf").desc(), "term").limit(max_features)
    return counts.select("term", (F.log((F.lit(1.0) + total) / (F.col("df") + 1)) + 1).alias("idf"))


def numbered_terms(fitted: DataFrame) -> DataFrame:
    """``fitted`` with ``number``, its terms' numbers from 0, written once, as each side of a search reads it."""
    return written(numbered(fitted, F.pmod(F.xxhash64("term"), F.lit(1024)), ["term"], "number"), "terms")


def tfidf_transform(texts: DataFrame, fitted: DataFrame, sublinear: bool = False) -> DataFrame:
    """Sparse rows (``sample_id``, ``term``, ``weight``, and ``number`` where terms have one) of length one per text."""
    tf = texts.select("sample_id", F.explode(words(F.col("text"))).alias("term")).groupBy("sample_id", "term").agg(F.count("*").alias("tf"))
    part = (F.log("tf") + 1 if sublinear else F.col("tf")) * F.col("idf")
    keep = ["sample_id", "term", *[c for c in fitted.columns if c == "number"]]
    raw = tf.join(fitted, "term").select(*keep, part.alias("w"))
    size = raw.groupBy("sample_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    return raw.join(size, "sample_id").select(*keep, (F.col("w") / F.col("size")).alias("weight"))


def gathered_terms(weights: DataFrame, ids: DataFrame) -> DataFrame:
    """(``sample_id``, ``value``) for every id: a text's weights by its terms' numbers, none for a text without known terms."""
    own = weights.groupBy(F.col("sample_id").alias("_id")).agg(F.collect_list(F.struct("number", "weight")).alias("value"))
    none = F.expr("CAST(array() AS array<struct<number:bigint,weight:double>>)")
    return ids.select("sample_id").join(own, F.col("sample_id") == F.col("_id"), "left").select("sample_id", F.coalesce("value", none).alias("value"))


def sparse_cosine(q: SparseRows, c: SparseRows) -> np.ndarray:
    """1 - dot product of sparse unit rows: a query's terms find their postings among the candidates' sorted terms."""
    terms, places, weights = c.postings
    low, high = np.searchsorted(terms, q.numbers), np.searchsorted(terms, q.numbers, "right")
    out = np.ones((len(q), len(c)))
    for i, row in enumerate(out):
        own = slice(q.starts[i], q.starts[i + 1])
        n = high[own] - low[own]
        at = np.arange(n.sum()) + np.repeat(low[own] - (np.cumsum(n) - n), n)
        row -= np.bincount(places[at], np.repeat(q.weights[own], n) * weights[at], len(row))
    return out


def sparse_cosine_knn(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """Nearest candidates by cosine over sparse unit rows (``gathered_terms``), in tiles, so a common term joins no pairs.

    Candidates without a common term are at distance 1. Distances are rounded to 9 digits before they are compared.
    """
    return knn(queries, candidates, k, sparse_cosine, "sparse", digits=9)


def word_vector_mean(texts: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """The mean vector of a text's known tokens (with repeats), zeros if there are none."""
    from ..functions.text import tokens

    each = texts.select(
        "sample_id", F.explode(tokens(F.col("text"))).alias("word")
    ).join(vectors, "word").select("sample_id", F.posexplode("vec").alias("d", "x"))
    means = each.groupBy("sample_id", "d").agg(F.avg("x").alias("x")).groupBy("sample_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda z: z["x"]).alias("value")
    )
    return texts.select("sample_id").join(means, "sample_id", "left").select(
        "sample_id", F.coalesce("value", F.array_repeat(F.lit(0.0), dim)).alias("value")
    )


#: Tokens whose neighbours are counted together, short of a text more.
TOKENS = 1 << 18


def _neighbours(batches, window: int):
    """(``a``, ``near``): what stands within ``window`` tokens of each word of some texts, and how often; the next texts' are further rows."""
    for batch in batches:
        texts = batch.column(0)
        ends = np.cumsum(texts.value_lengths().to_numpy(zero_copy_only=False))
        cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1] if len(ends) else 0, TOKENS)), len(ends)))
        for first, last in zip(cuts[:-1], cuts[1:], strict=True):
            part = texts.slice(first, last - first)
            words = part.flatten().dictionary_encode()
            codes, names = words.indices.to_numpy().astype(np.int64), words.dictionary
            text = np.repeat(np.arange(len(part)), part.value_lengths().to_numpy(zero_copy_only=False))
            keys = [np.empty(0, np.int64)]
            for gap in range(1, min(window, len(codes) - 1) + 1):
                same = text[gap:] == text[:-gap]
                left, right = codes[:-gap][same], codes[gap:][same]
                keys += [left * len(names) + right, right * len(names) + left]
            keys, counts = np.unique(np.concatenate(keys), return_counts=True)
            a, b = np.divmod(keys, max(len(names), 1))
            starts = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.empty(0, np.int64)
            pairs = pa.StructArray.from_arrays([names.take(pa.array(b)), pa.array(counts.astype(np.int64))], names=["b", "n"])
            near = pa.ListArray.from_arrays(pa.array(np.append(starts, len(a)).astype(np.int32)), pairs)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(a[starts])), near], names=["a", "near"])


def cooccurrence_vectors(texts: DataFrame, dim: int = 64, window: int = 4, seed: int = 0, only: DataFrame | None = None) -> DataFrame:
    """(``word``, ``vec``): unit vectors learned from which words stand within ``window`` tokens of each other in ``texts``.

    A word's neighbours weigh by their positive pointwise information, ln(n(a, b) * n / (n(a) * n(b))), where n counts pairs
    in both directions. Every neighbour's weight is added, with a drawn sign, at one of ``dim`` drawn places, so words of
    like neighbours have near vectors and no matrix is held. A word without neighbours has no row; one whose neighbours all
    weigh nothing has zeros. Pairs are counted in some texts at a time before they are shuffled, once. With ``only`` (``word``) these
    words alone have vectors, the same as without it, and only their pairs are counted; totals come from the words' places.
    """
    from ..functions.text import tokens

    w = texts.select(tokens(F.col("text")).alias("w")).where(F.size("w") > 1)
    reach = lambda t, i: F.struct(t.alias("a"), (F.least(i, F.lit(window)) + F.least(F.size("w") - 1 - i, F.lit(window))).alias("n"))
    totals = written(w.select(F.inline(F.transform("w", reach))).groupBy("a").agg(F.sum("n").alias("na")), "totals")
    n = F.lit(float(totals.agg(F.sum("na")).first()[0] or 0))
    near = w.mapInArrow(lambda batches: _neighbours(batches, window), "a string, near array<struct<b: string, n: long>>")
    if only is not None:
        near = near.join(only.select(F.col("word").alias("a")).distinct(), "a", "left_semi")
    pairs = near.select("a", F.inline("near")).groupBy("a", "b").agg(F.sum("n").alias("n"))
    gain = F.greatest(F.log(F.col("n") * n / (F.col("na") * F.col("nb"))), F.lit(0.0))
    weighed = pairs.join(totals, "a").join(totals.select(F.col("a").alias("b"), F.col("na").alias("nb")), "b")
    place, sign = draw(seed, F.col("b")) % dim, draw(seed + 1, F.col("b")) % 2 * 2 - 1
    parts = weighed.groupBy("a", place.cast("int").alias("place")).agg(F.sum(gain * sign).alias("x"))
    held = parts.groupBy(F.col("a").alias("word")).agg(
        F.map_from_entries(F.collect_list(F.struct("place", "x"))).alias("m"), F.greatest(F.sqrt(F.sum(F.col("x") * F.col("x"))), F.lit(1e-8)).alias("s")
    )
    one = lambda i: F.coalesce(F.try_element_at("m", i) / F.col("s"), F.lit(0.0))
    return held.select("word", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), one).alias("vec"))


def embedding_udf(f: Callable[[list], np.ndarray]):
    """A column function from a Python encoder (list -> matrix), called once per Arrow batch."""

    @F.pandas_udf("array<double>")
    def udf(x: pd.Series) -> pd.Series:
        return pd.Series(list(np.asarray(f(x.tolist()), np.float64))) if len(x) else pd.Series([], dtype=object)

    return udf


def encode_distinct(rows: DataFrame, column: str, f: Callable[[list], np.ndarray], out: str = "value") -> DataFrame:
    """``rows`` with ``out``; every distinct text is encoded once and joined back."""
    known = rows.select(column).where(F.col(column).isNotNull()).distinct().withColumn(out, embedding_udf(f)(F.col(column)))
    return rows.join(known, column, "left")


def mean_pooled(tokens: Column, mask: Column) -> Column:
    """The mean of the token vectors that a mask of 0 and 1 keeps, over at least 1e-12 of them."""
    kept = F.zip_with(tokens, mask, lambda v, m: F.transform(v, lambda x: x * m))
    total = F.aggregate(
        kept, F.transform(F.get(tokens, F.lit(0)), lambda x: F.lit(0.0)), lambda s, v: F.zip_with(s, v, lambda a, b: a + b)
    )
    count = F.greatest(F.aggregate(mask, F.lit(0.0), lambda s, m: s + m), F.lit(1e-12))
    return F.transform(total, lambda x: x / count)


def first_pooled(tokens: Column) -> Column:
    """The first token's vector."""
    return F.get(tokens, F.lit(0))


def prefixed_pooled(tokens: Column, mask: Column) -> Column:
    """The masked mean brought to length one, as encoders that expect a prefix (``normalised_prefix``) return it."""
    return l2_normalised(mean_pooled(tokens, mask))


def precomputed(rows: DataFrame) -> bool:
    """Whether a branch holds vectors (arrays of numbers in ``value``) and not raw images or texts."""
    kind = rows.schema["value"].dataType if "value" in rows.columns else None
    return isinstance(kind, ArrayType) and isinstance(kind.elementType, NumericType)


def lookup_or_encode(rows: DataFrame, train: DataFrame, test: DataFrame, f: Callable[[list], np.ndarray] | None = None) -> DataFrame:
    """Vectors by text: training entries win over test entries, and only misses are encoded live."""
    first = lambda df: df.where("text IS NOT NULL").groupBy("text").agg(F.min("value").alias("value"))
    table = first(train).unionByName(first(test).join(train.select("text"), "text", "left_anti"))
    hit = rows.join(table, "text", "left")
    if f is None:
        return hit
    found = hit.where("value IS NOT NULL")
    missing = rows.join(table, "text", "left_anti")
    return found.unionByName(encode_distinct(missing, "text", f))


class EncoderRegistry:
    """Named encoders and the columns that hold their precomputed vectors."""

    def __init__(self):
        self.functions: dict[str, Callable] = {}

    def add(self, name: str, f: Callable) -> None:
        self.functions[name] = f

    def available(self, name: str, has_train: bool = False, has_test: bool = False) -> bool:
        """Whether a function is registered or both splits are precomputed; raw text and TF-IDF always are."""
        from ..functions.text import encoder_name

        name = encoder_name(name)
        return name in ("raw", "tfidf") or name in self.functions or (has_train and has_test)


def normalised_prefix(texts: Column, prefix: str = "query: ") -> Column:
    """The prefix that some encoders expect before a text."""
    return F.concat(F.lit(prefix), F.coalesce(texts, F.lit("")))
