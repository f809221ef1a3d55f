"""The words of whole texts as flat arrays, for operators that count them in numpy.

A word is a run of ASCII letters, digits and anything outside ASCII, lower-cased in A-Z alone. Texts are worked on in
steps of bounded bytes that end between words, so a text of any length takes no more than a step and its longest word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of a step.
STEP = 1 << 21

#: A byte as it stands in a word, 0 outside of words.
LETTER = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 0 for b in range(256)], np.uint8)


def _after(data: np.ndarray, at: int, end: int) -> int:
    """The first place from ``at`` on that is in no word, at most ``end``."""
    while at < end:
        gaps = np.flatnonzero(LETTER[data[at : min(at + 65536, end)]] == 0)
        if len(gaps):
            return at + int(gaps[0])
        at = min(at + 65536, end)
    return end


def words(texts: pa.ChunkedArray | pa.Array, carry: int = 0, step: int = STEP) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(letters, offsets, rows, old) of each step: its words' bytes, where they begin and end, and their rows.

    A null text has no words. Where a step ends within a text, the next one begins with the text's last ``carry`` words
    again; ``old`` is how many of its first words were there before.
    """
    texts = pc.fill_null(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, "")
    if not len(texts):
        return
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, values = texts.buffers()
    off = np.frombuffer(offsets, width, len(texts) + 1, texts.offset * np.dtype(width).itemsize).astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values else np.empty(0, np.uint8)
    at = done = int(off[0])
    old = 0
    while done < off[-1]:
        stop = min(done + step, int(off[-1]))
        edge = int(off[np.searchsorted(off, stop, "right") - 1])
        row_end = int(off[np.searchsorted(off, done, "right")])
        stop = edge if edge > done else _after(data, stop, row_end)
        inner = off[(off > at) & (off < stop)] - at
        letters = LETTER[data[at:stop]]
        inside = letters != 0
        before, after = np.zeros(len(inside), bool), np.zeros(len(inside), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[inner], after[inner - 1] = False, False
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        rows = np.searchsorted(off, starts + at, "right") - 1
        yield letters[inside], np.concatenate([[0], np.cumsum(ends - starts)]), rows, old
        done, old, first = stop, 0, stop
        if carry and stop < row_end:
            same = np.flatnonzero(rows == np.searchsorted(off, stop, "right") - 1)[-carry:]
            old = len(same)
            first = int(starts[same[0]]) + at if old else stop
        at = first
