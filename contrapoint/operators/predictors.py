"""Predictors over several inputs: one Arrow function over nested columns, with an error for each row that can't be scored.

An ``Input`` says which columns go into one input of the predictor and in which layout; a ``Predictor`` is a picklable
function of those arrays that gives one score or one probability a class for every row. Columns may be numbers, vectors
(``array<double>``) or channel-major series (``array<array<double>>``).

Rows of one shape go to the predictor together, ``batch_size`` at a time. A row with a null, ragged or wrongly sized value
is never passed on; where the predictor itself fails on a batch, the batch is halved until the rows that it fails on stand
alone. Those rows get a null score and a message, and all others their scores. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

#: Characters of a message.
MESSAGE = 200


@dataclass(frozen=True)
class Input:
    """One input array: rank 1 is (rows), rank 2 (rows, features), rank 3 (rows, steps, channels).

    Columns are put side by side on the last axis. In rank 3 numbers and vectors are repeated over the steps of the series
    beside them, or of the column ``steps_of``. ``take`` cuts the last axis, ``width`` is what it must then measure, and
    ``missing`` stands for a null column.
    """

    columns: tuple[str, ...]
    rank: int = 2
    take: tuple[int, int] | None = None
    width: int | None = None
    steps_of: str | None = None
    missing: float | None = None


@dataclass(frozen=True)
class Predictor:
    f: Callable
    inputs: tuple[Input, ...]
    batch_size: int = 32

    def columns(self) -> list[str]:
        names = [c for i in self.inputs for c in (*i.columns, *([i.steps_of] if i.steps_of else []))]
        return list(dict.fromkeys(names))


def fused(f: Callable, static: str, *series: str, **options) -> Predictor:
    """One input of rank 3: the static vector repeated over the steps, then the series' channels."""
    return Predictor(f, (Input((static, *series), 3),), **options)


def paired(f: Callable, static: str, *series: str, **options) -> Predictor:
    """Two inputs: the static vector, and the series."""
    return Predictor(f, (Input((static,)), Input(series, 3)), **options)


def four(f: Callable, first: str | tuple, second: str | tuple, static: str, text: str, text_rank: int = 2, **options) -> Predictor:
    """Four inputs: two series, the static vector, and a text's vector, number or sequence; a missing text is 0.

    A series may be part of a longer one: (column, from, to).
    """
    part = lambda s: Input((s,), 3) if isinstance(s, str) else Input((s[0],), 3, (s[1], s[2]), s[2] - s[1])
    steps = first if isinstance(first, str) else first[0]
    words = Input((text,), text_rank, steps_of=steps if text_rank == 3 else None, missing=0.0)
    return Predictor(f, (part(first), part(second), Input((static,)), words), **options)


class _Part:
    """One column of a batch: each row's shape, None for a null, and rows of one shape as an array."""

    def __init__(self, column: pa.Array):
        n, self.bad = len(column), np.zeros(len(column), bool)
        there = pc.is_valid(column).to_numpy(zero_copy_only=False)
        if not pa.types.is_list(column.type):
            self.values = column.cast(pa.float64()).to_numpy(zero_copy_only=False)
            self.shapes = [() if ok else None for ok in there]
            self.starts = np.arange(n)
            return
        lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
        inner, ends = column.flatten(), np.cumsum(lengths)
        starts = ends - lengths
        if not pa.types.is_list(inner.type):
            self.shapes = [(int(m),) if ok else None for m, ok in zip(lengths, there, strict=True)]
            self.starts, nulls = starts, inner
        else:
            steps = pc.fill_null(pc.list_value_length(inner), -1).to_numpy().astype(np.int64)
            at = np.concatenate([[0], np.cumsum(np.maximum(steps, 0))])
            self.shapes = []
            for i, (a, b, ok) in enumerate(zip(starts, ends, there, strict=True)):
                own = steps[a:b]
                self.bad[i] = ok and (not len(own) or own.min() != own.max() or own.min() < 0)
                self.shapes.append((int(b - a), int(own[0])) if ok and not self.bad[i] else None)
            self.starts, nulls = at[starts], inner.flatten()
            starts, ends = at[starts], at[ends]
        self.values = nulls.cast(pa.float64()).to_numpy(zero_copy_only=False)
        gaps = np.concatenate([[0], np.cumsum(nulls.is_null().to_numpy(zero_copy_only=False))])
        self.bad |= gaps[ends] > gaps[starts]

    def rows(self, at: np.ndarray) -> np.ndarray:
        """(rows), (rows, features) or (rows, steps, channels)."""
        shape = self.shapes[at[0]]
        out = self.values[self.starts[at][:, None] + np.arange(int(np.prod(shape, dtype=int)))].reshape(len(at), *shape)
        return out.transpose(0, 2, 1) if len(shape) == 2 else out


def _array(spec: Input, parts: dict[str, _Part], at: np.ndarray) -> np.ndarray:
    n, found = len(at), []
    steps = next((parts[c].shapes[at[0]][1] for c in (*spec.columns, spec.steps_of) if c and len(parts[c].shapes[at[0]] or ()) == 2), None)
    if spec.rank == 3 and steps is None:
        raise ValueError("no series gives the steps")
    for c in spec.columns:
        if parts[c].shapes[at[0]] is None:
            x = np.full((n, spec.width or 1), spec.missing)
        else:
            x = parts[c].rows(at)
        x = x[:, None] if x.ndim == 1 else x
        if spec.rank < 3 and x.ndim == 3:
            raise ValueError(f"{c} is a series, the input has rank {spec.rank}")
        if spec.rank == 3:
            x = np.repeat(x[:, None], steps, 1) if x.ndim == 2 else x
            if x.shape[1] != steps:
                raise ValueError(f"{c} has {x.shape[1]} steps, not {steps}")
        found.append(x)
    out = np.concatenate(found, -1)
    if spec.take:
        if out.shape[-1] < spec.take[1]:
            raise ValueError(f"{'+'.join(spec.columns)} has {out.shape[-1]} columns, {spec.take[1]} are needed")
        out = out[..., spec.take[0] : spec.take[1]]
    if spec.width is not None and out.shape[-1] != spec.width:
        raise ValueError(f"{'+'.join(spec.columns)} has {out.shape[-1]} columns, not {spec.width}")
    if spec.rank == 1:
        if out.shape[-1] != 1:
            raise ValueError(f"{'+'.join(spec.columns)} has {out.shape[-1]} columns, not 1")
        out = out[:, 0]
    return out


def _said(f: Callable, arrays: list[np.ndarray]) -> list:
    """Each row's probabilities or the error that it raises; a batch that fails is halved."""
    n = len(arrays[0])
    try:
        out = np.asarray(f(*arrays), float)
        out = out.reshape(n, -1)
        return [row if np.isfinite(row).all() and len(row) else ValueError("the prediction is not finite") for row in out]
    except Exception as e:  # whatever a predictor raises is its row's error
        if n == 1:
            return [e]
    half = n // 2
    return _said(f, [a[:half] for a in arrays]) + _said(f, [a[half:] for a in arrays])


def scored_batch(predictor: Predictor, columns: dict[str, pa.Array], n: int) -> tuple[list, list]:
    """(probabilities, messages) of a batch's rows, one of them None in each row."""
    parts = {c: _Part(a) for c, a in columns.items()}
    optional = {c for i in predictor.inputs if i.missing is not None for c in i.columns}
    probabilities, messages, groups = [None] * n, [None] * n, {}
    for i in range(n):
        wrong = next((c for c in sorted(parts) if parts[c].bad[i]), None)
        none = next((c for c in sorted(parts) if parts[c].shapes[i] is None and c not in optional), None)
        if wrong or none:
            messages[i] = f"{wrong} is ragged or holds nulls" if wrong else f"{none} is null"
        else:
            groups.setdefault(tuple(p.shapes[i] for p in parts.values()), []).append(i)
    for rows in groups.values():
        for a in range(0, len(rows), predictor.batch_size):
            at = np.array(rows[a : a + predictor.batch_size])
            try:
                out = _said(predictor.f, [_array(spec, parts, at) for spec in predictor.inputs])
            except ValueError as e:  # an input that rows of this shape can't make
                out = [e] * len(at)
            for i, x in zip(at, out, strict=True):
                if isinstance(x, Exception):
                    messages[i] = (str(x) or type(x).__name__)[:MESSAGE]
                else:
                    probabilities[i] = x.tolist()
    return probabilities, messages


def predict(rows: DataFrame, predictor: Predictor, prefix: str = "") -> DataFrame:
    """``rows`` with ``probability``, ``score`` (its first value) and ``error``, each name after ``prefix``."""
    names, out = predictor.columns(), [f"{prefix}{c}" for c in ("probability", "score", "error")]
    if clash := set(out) & set(rows.columns):
        raise ValueError(f"columns {sorted(clash)} are there already")
    schema = StructType([*rows.schema.fields, *(StructField(c, t) for c, t in zip(out, (ArrayType(DoubleType()), DoubleType(), StringType()), strict=True))])

    def run(batches):
        for batch in batches:
            said, messages = scored_batch(predictor, {c: batch.column(c) for c in names}, batch.num_rows)
            own = [pa.array(said, pa.list_(pa.float64())), pa.array([x and x[0] for x in said], pa.float64()), pa.array(messages, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], names=[*batch.schema.names, *out])

    return rows.mapInArrow(run, schema)


def label(probability: Column) -> Column:
    """The class: of one probability whether it is 0.5 or more, of several the first of the largest."""
    return F.when(F.size(probability) == 1, (F.get(probability, F.lit(0)) >= 0.5).cast("int")).otherwise(
        (F.array_position(probability, F.array_max(probability)) - 1).cast("int")
    )
