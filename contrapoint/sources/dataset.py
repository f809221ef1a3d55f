"""The dataset: samples with optional tabular, series, text and image branches, each a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The branch name that a flat, unnamed value takes.
UNNAMED = "__primary__"


def merged(named: dict | None, flat, name: str | None, what: str) -> dict:
    """Named branches and the flat one; different values under one name raise."""
    out = dict(named or {})
    if flat is not None:
        key = name or UNNAMED
        if out.get(key, flat) is not flat:
            raise ValueError(f"two different values for {what} branch {key!r}")
        out[key] = flat
    return out


def primary_of(store: dict, name: str | None, what: str) -> str | None:
    """The configured branch, else the only one, else none; a configured name that is missing raises."""
    if name is not None and name in store:
        return name
    if store and name not in (None, UNNAMED):
        raise ValueError(f"primary {what} branch {name!r} is not among {sorted(store)}")
    return next(iter(store)) if len(store) == 1 else None


def branch_of(store: dict, name: str | None, primary: str | None, what: str) -> str | None:
    """The asked branch, else the primary, else the only one; unknown or ambiguous names raise."""
    if not store:
        return None
    if name is not None:
        if name not in store:
            raise ValueError(f"{what} branch {name!r} is not among {sorted(store)}")
        return name
    if primary is None and len(store) > 1:
        raise ValueError(f"{what} branches {sorted(store)}: name one")
    return primary or next(iter(store))


@dataclass
class Dataset:
    """``samples`` (split, sample_id, label, pred) is required; branches hold (split, sample_id, value or text).

    ``static`` and ``text`` and ``image`` are the flat forms of the primary branches; insertion order fixes the order of
    early fusion.
    """

    samples: DataFrame
    static: DataFrame | None = None
    tabular: dict[str, DataFrame] | None = None
    series: dict[str, DataFrame] | None = None
    text: DataFrame | None = None
    texts: dict[str, DataFrame] | None = None
    image: DataFrame | None = None
    images: dict[str, DataFrame] | None = None
    primary_tabular: str | None = None
    primary_text: str | None = None
    primary_image: str | None = None
    primaries: dict[str, str | None] = field(init=False)

    def __post_init__(self):
        self.tabular = merged(self.tabular, self.static, self.primary_tabular, "tabular")
        self.texts = merged(self.texts, self.text, self.primary_text, "text")
        self.images = merged(self.images, self.image, self.primary_image, "image")
        self.series = dict(self.series or {})
        self.primaries = {
            "tabular": primary_of(self.tabular, self.primary_tabular, "tabular"), "text": primary_of(self.texts, self.primary_text, "text"),
            "image": primary_of(self.images, self.primary_image, "image"), "series": primary_of(self.series, None, "series")
        }

    def store(self, kind: str) -> dict[str, DataFrame]:
        return {"tabular": self.tabular, "text": self.texts, "image": self.images, "series": self.series}[kind]

    def branch(self, kind: str, name: str | None = None) -> DataFrame | None:
        key = branch_of(self.store(kind), name, self.primaries[kind], kind)
        return None if key is None else self.store(kind)[key]

    def secondary_tabular(self) -> dict[str, DataFrame]:
        """The named tabular branches without the primary."""
        return {k: v for k, v in self.tabular.items() if k != self.primaries["tabular"]}

    def available(self) -> list[str]:
        """``tabular`` with a primary branch, each series and further tabular branch by name, ``text``, ``image``."""
        return [
            *["tabular"] * (self.primaries["tabular"] is not None), *self.series, *self.secondary_tabular(), *["text"] * bool(self.texts),
            *["image"] * bool(self.images)
        ]

    def part(self, df: DataFrame, split: str) -> DataFrame:
        return df.where(F.col("split") == split)

    def candidates(self, df: DataFrame, target: int) -> DataFrame:
        """Training rows of the target class, by their true label."""
        return self.part(df, "train").join(
            self.part(self.samples, "train").where(F.col("label") == target).select("sample_id", "label"), "sample_id", "left_semi"
        )

    def queries(self, df: DataFrame, ids: DataFrame) -> DataFrame:
        return self.part(df, "test").join(ids.select("sample_id"), "sample_id", "left_semi")
