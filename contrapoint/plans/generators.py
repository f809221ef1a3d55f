"""The public generators: each turns queries, a target class and k into candidate rows.

All return ``query_id``, ``cand_rank``, ``n_used``, ``anchor_id``, ``num`` (branch -> vector), ``ser`` (branch -> series) and
``anchors`` (branch -> training id); absent modalities are left out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import series as series_functions
from ..functions import text as text_functions
from ..functions import vectors
from ..operators import combine, encoders
from ..operators.encoders import encode_distinct, precomputed
from ..operators.kept import written
from ..operators.models import Network
from ..operators.search import knn
from ..sources.dataset import Dataset

_NO_NUM = "CAST(map() AS map<string,array<double>>)"
_NO_SER = "CAST(map() AS map<string,array<array<double>>>)"


def _materialised(ds: Dataset, near: DataFrame, step: str = "odd", anchor: str = "rank", only_series: str | None = None) -> DataFrame:
    """Prefix medians of every numeric branch, and anchors for the rest."""
    keys = ["query_id", "cand_rank"]
    train = lambda df: ds.part(df, "train").select("sample_id", "value")
    names = {k: v for k, v in ds.series.items() if only_series in (None, k)}
    parts = [
        combine.progressive_medians(near, train(df), step, anchor).select(*keys, "n_used", "anchor_id", F.col("value").alias(f"num_{b}"))
        for b, df in ds.tabular.items()
    ]
    parts += [
        combine.progressive_series_medians(near, train(df), step).select(*keys, "n_used", "anchor_id", F.col("value").alias(f"ser_{b}"))
        for b, df in names.items()
    ]
    if not parts:
        parts = [near.select("query_id", F.col("rank").alias("cand_rank"), F.lit(1).alias("n_used"), F.col("train_id").alias("anchor_id"))]
    joined = reduce(lambda a, b: a.join(b.drop("n_used", "anchor_id"), keys), parts)
    column = lambda prefix, store, empty: F.create_map(*[
        x
        for b in store
        for x in (F.lit(b), F.col(f"{prefix}_{b}"))
    ]) if store else F.expr(empty)
    anchors = [b for b in (*ds.texts, *ds.images)]
    return joined.select(*keys, "n_used", "anchor_id", column("num", ds.tabular, _NO_NUM).alias("num"), column("ser", names, _NO_SER).alias("ser"),
                         (
                             F.create_map(*[
                                 x
                                 for b in anchors
                                 for x in (F.lit(b), F.col("anchor_id"))
                             ]) if anchors else F.expr("CAST(map() AS map<string,bigint>)")
                         ).alias("anchors"))


def _search(ds: Dataset, df: DataFrame, queries: DataFrame, target: int, k: int, metric, kind: str, **options) -> DataFrame:
    return knn(ds.queries(df, queries), ds.candidates(df, target), k, metric, kind, **options)


def _encoded_once(rows: DataFrame) -> DataFrame:
    """An encoder's vectors, written before they are searched, as a search reads its rows more than once."""
    return written(rows.select("split", "sample_id", "value"), "vectors")


class Generator:
    """``search`` gives ranked neighbours, ``run`` candidates; ``key`` names the search so that others can reuse it."""

    def key(self, ds: Dataset) -> tuple:
        raise NotImplementedError

    def search(self, ds: Dataset, queries: DataFrame, target: int, k: int) -> DataFrame:
        raise NotImplementedError

    def run(self, ds: Dataset, queries: DataFrame, target: int, k: int | None = None, found: dict | None = None) -> DataFrame:
        k = k or self.k
        near = (found or {}).get(self.key(ds))
        near = self.search(ds, queries, target, k) if near is None else near.where(F.col("rank") <= k)
        return self.materialise(ds, near)

    def materialise(self, ds: Dataset, near: DataFrame) -> DataFrame:
        return _materialised(ds, near)


@dataclass
class TabularNN(Generator):
    tab_name: str | None = None
    k: int = 50
    distance: str | Callable = "euclidean"

    def key(self, ds):
        return "tabular", self.tab_name, self.distance

    def search(self, ds, queries, target, k):
        return _search(ds, ds.branch("tabular", self.tab_name), queries, target, k, self.distance, "vector")


@dataclass
class TimeSeriesNN(Generator):
    ts_name: str | None = None
    k: int = 50
    distance: str | Callable = "dtw"
    window: float | None = series_functions.WINDOW
    epsilon: float | None = None

    def key(self, ds):
        return "series", self.ts_name, self.distance, self.window, self.epsilon

    def search(self, ds, queries, target, k):
        name = None if callable(self.distance) else series_functions.metric_name(self.distance)
        options = {"window": self.window} if name in ("dtw", "lcss") else {}
        if name == "lcss" and self.epsilon is not None:
            options["epsilon"] = self.epsilon
        return _search(ds, ds.branch("series", self.ts_name), queries, target, k, self.distance, "series", **options)

    def materialise(self, ds, near):
        return _materialised(ds, near, only_series=self.ts_name or next(iter(ds.series)))


def labs_nn(**options) -> TimeSeriesNN:
    return TimeSeriesNN(ts_name="labs", **options)


def meds_nn(**options) -> TimeSeriesNN:
    return TimeSeriesNN(ts_name="meds", **options)


@dataclass
class TextNN(Generator):
    """Texts compared directly, or by vectors of a precomputed branch (``vectors``) or of an ``encoder`` function.

    The encoders ``tfidf`` (by cosine) and ``word2vec`` are fitted to the training texts, the second by its words' neighbours.
    A ``distance`` that is a function compares token lists, or vectors where there are any: (queries, candidates) -> matrix.
    """

    text_name: str | None = None
    k: int = 20
    encoder: str | Callable = "raw"
    distance: str | Callable = "rouge_l"
    vectors: DataFrame | None = None
    transform: Callable | None = None

    def key(self, ds):
        return "text", self.text_name, self.encoder, self.distance, id(self.vectors), id(self.transform)

    def search(self, ds, queries, target, k):
        df = ds.branch("text", self.text_name)
        if self.transform is not None:
            df = df.withColumn("text", self.transform(F.col("text")))
        direct = callable(self.distance) and self.vectors is None and not callable(self.encoder)
        if direct or self.distance in text_functions.SIMILARITIES or self.distance in text_functions.METRIC_ALIASES:
            return _search(ds, df.withColumn("value", text_functions.tokens(F.col("text"))), queries, target, k, self.distance, "text")
        if self.vectors is not None:
            return _search(ds, self.vectors, queries, target, k, self.distance, "vector")
        if callable(self.encoder):
            encoded = encode_distinct(df.withColumn("text", F.coalesce("text", F.lit(""))), "text", self.encoder)
            return _search(ds, _encoded_once(encoded), queries, target, k, self.distance, "vector")
        if text_functions.encoder_name(self.encoder) == "raw":  # a vector metric can't compare raw text
            return _search(ds, df.withColumn("value", text_functions.tokens(F.col("text"))), queries, target, k, "rouge_l", "text")
        name = text_functions.encoder_name(self.encoder)
        if name == "tfidf" and vectors.metric_name(self.distance) == "cosine":
            return _search(ds, _fitted_texts(ds, df, name), queries, target, k, encoders.sparse_cosine, "sparse", digits=9)
        if name == "word2vec":
            return _search(ds, _fitted_texts(ds, df, name), queries, target, k, self.distance, "vector")
        raise ValueError(f"encoder {self.encoder!r} needs precomputed vectors or a function")


def _fitted_texts(ds: Dataset, df: DataFrame, encoder: str) -> DataFrame:
    """Both splits' texts by an encoder fitted to the training texts, written once."""
    train, splits = ds.part(df, "train"), ("train", "test")
    if encoder == "tfidf":
        fitted = encoders.numbered_terms(encoders.tfidf_fit(train))
        encode = lambda t: encoders.gathered_terms(encoders.tfidf_transform(t, fitted), t)
    else:
        learned = written(encoders.cooccurrence_vectors(train), "words")
        encode = lambda t: encoders.word_vector_mean(t, learned, 64)
    parts = [encode(ds.part(df, split)).withColumn("split", F.lit(split)) for split in splits]
    return written(reduce(DataFrame.unionByName, parts), "encoded")


@dataclass
class ImageNN(Generator):
    """Images by an ``encoder`` function of their pixels (``px``), else by precomputed vectors, given or in the branch."""

    image_name: str | None = None
    k: int = 20
    distance: str | Callable = "cosine"
    encoder: Callable | None = None
    vectors: DataFrame | None = None

    def key(self, ds):
        return "image", self.image_name, self.distance, self.encoder, id(self.vectors)

    def search(self, ds, queries, target, k):
        rows = ds.branch("image", self.image_name)
        if self.encoder is not None:
            rows = _encoded_once(encode_distinct(rows, "px", self.encoder))
        elif self.vectors is not None:
            rows = self.vectors
        elif not precomputed(rows):
            raise ValueError("images without vectors need an encoder")
        return _search(ds, rows, queries, target, k, self.distance, "vector")


@dataclass
class EarlyFusionNN(Generator):
    """One vector of all numeric branches: tabular, series means, text vectors, images."""

    k: int = 20
    distance: str | Callable = "euclidean"
    text_vectors: list[DataFrame] = field(default_factory=list)

    def key(self, ds):
        return "early", self.distance, *map(id, self.text_vectors)

    def fused(self, ds: Dataset) -> DataFrame:
        parts = [
            *ds.tabular.values(), *(s.withColumn("value", series_functions.time_mean(F.col("value"))) for s in ds.series.values()),
            *self.text_vectors, *ds.images.values()
        ]
        named = [p.select("split", "sample_id", F.col("value").alias(f"v{i}")) for i, p in enumerate(parts)]
        joined = reduce(lambda a, b: a.join(b, ["split", "sample_id"]), named)
        value = F.concat(*[f"v{i}" for i in range(len(parts))])
        return joined.select("split", "sample_id", (vectors.l2_normalised(value) if self.distance == "cosine" else value).alias("value"))

    def search(self, ds, queries, target, k):
        return _search(ds, self.fused(ds), queries, target, k, self.distance, "vector")


@dataclass
class IntermediateFusionNN(Generator):
    """Neighbours in a latent space: rows (split, sample_id, value), a function of the dataset, or a fitted network.

    A network's latent vectors are what comes out of its ``layer`` (-2: the one before the last) for the fused vectors.
    """

    latent: DataFrame | Callable | Network
    k: int = 5
    distance: str | Callable = "euclidean"
    layer: int = -2
    text_vectors: list[DataFrame] = field(default_factory=list)

    def key(self, ds):
        return "latent", id(self.latent), self.distance, self.layer, *map(id, self.text_vectors)

    def search(self, ds, queries, target, k):
        if isinstance(self.latent, Network):
            rows = _encoded_once(self.latent.output(EarlyFusionNN(text_vectors=self.text_vectors).fused(ds), self.layer))
        else:
            rows = self.latent(ds) if callable(self.latent) else self.latent
        return _search(ds, rows, queries, target, k, self.distance, "vector")


@dataclass
class MultimodalConsensusRetrieval(Generator):
    """Rows that all parts list among their ``pool`` nearest, by the sum of distances."""

    parts: list[Generator]
    k: int = 5
    pool: int = 50

    def key(self, ds):
        return "consensus", *(p.key(ds) for p in self.parts), self.pool

    def lists(self, ds, queries, target, k, found=None) -> list[DataFrame]:
        pool, found = max(self.pool, k), found or {}
        # A shared search may hold more neighbours than this generator's pool.
        return [found[key].where(F.col("rank") <= pool) if (key := p.key(ds)) in found else p.search(ds, queries, target, pool) for p in self.parts]

    def run(self, ds, queries, target, k=None, found=None):
        k = k or self.k
        lists = self.lists(ds, queries, target, k, found)
        return self.materialise(ds, combine.consensus({str(i): n for i, n in enumerate(lists)}, k))


@dataclass
class ModalityWisePrototypeSynthesis(MultimodalConsensusRetrieval):
    """Candidate i from each part's own first i neighbours; as many as the shortest list."""

    def run(self, ds, queries, target, k=None, found=None):
        k, keys, frames, num, ser, anchors = k or self.k, ["query_id", "cand_rank"], [], [], [], []
        for i, (part, near) in enumerate(zip(self.parts, self.lists(ds, queries, target, k or self.k, found), strict=True)):
            if isinstance(part, TabularNN | TimeSeriesNN):
                kind, name = ("tabular", part.tab_name) if isinstance(part, TabularNN) else ("series", part.ts_name)
                df = ds.part(ds.branch(kind, name), "train").select("sample_id", "value")
                step = (combine.progressive_medians if kind == "tabular" else combine.progressive_series_medians)(near, df, "step")
                frames.append(step.select(*keys, F.col("value").alias(f"v{i}"), F.col("anchor_id").alias(f"a{i}")))
                branch = name or ds.primaries[kind] or next(iter(ds.store(kind)))
                (num if kind == "tabular" else ser).extend((F.lit(branch), F.col(f"v{i}")))
            else:
                kind, name = ("text", part.text_name) if isinstance(part, TextNN) else ("image", part.image_name)
                frames.append(near.select("query_id", F.col("rank").alias("cand_rank"), F.col("train_id").alias(f"a{i}")))
                branch = name or ds.primaries[kind] or next(iter(ds.store(kind)))
            anchors.extend((F.lit(branch), F.col(f"a{i}")))
        joined = reduce(lambda a, b: a.join(b, keys), frames).where(F.col("cand_rank") <= k)
        return joined.select(
            *keys, F.col("cand_rank").alias("n_used"), F.col("a0").alias("anchor_id"),
            (F.create_map(*num) if num else F.expr(_NO_NUM)).alias("num"), (F.create_map(*ser) if ser else F.expr(_NO_SER)).alias("ser"),
            F.create_map(*anchors).alias("anchors")
        )


MCR, MPS = MultimodalConsensusRetrieval, ModalityWisePrototypeSynthesis


class CounterfactualLibrary:
    """Runs named generators over the same queries; searches that several of them need run once."""

    def __init__(self, generators: dict[str, Generator]):
        self.generators = generators

    def run(self, ds: Dataset, queries: DataFrame, target: int, k: int | None = None) -> DataFrame:
        """All generators' candidates with a ``generator`` column."""
        used: dict[tuple, list] = {}
        for g in self.generators.values():
            for part in getattr(g, "parts", [g]):
                used.setdefault(part.key(ds), []).append((part, max(k or 0, getattr(g, "pool", 0), g.k)))
        found = {key: written(each[0][0].search(ds, queries, target, max(n for _, n in each)), "near") for key, each in used.items() if len(each) > 1}
        return reduce(
            DataFrame.unionByName,
            [g.run(ds, queries, target, k, found).withColumn("generator", F.lit(name)) for name, g in self.generators.items()]
        )
