"""Best-fit packing planned on the histogram of piece lengths.

``pieces`` tokenises every whole document and cuts only those longer than a sequence. ``plan`` runs best-fit decreasing
over the counts of the at most ``capacity`` lengths: equal sequences are kept as intervals, so its size follows the
histogram and not the documents. ``pack`` ranks the pieces within each length and gives each its planned slot by that
rank. Hot lengths are ranked in salted parts whose offsets come from their counts.

A null text counts as empty; an empty document is the single end token. Rows are packed one by one, so repeated rows take
places of their own, and rows without an id are packed too. An empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import small_batches, staged, worker_cache

#: Words that a task remembers, rows of a salted rank part, parts of any length at least.
KEPT_WORDS, PART_ROWS, LEAST_PARTS = 800_000, 20_000, 64

#: The vocabulary marks tokens that end a word; letters, then ASCII marks without the apostrophe.
WORD_END, MARKS = "</w>", rb"[!-&(-/:-@\[-`{-~]+"
#: Letters of ASCII and Latin-1, whose normal forms are letters, and other bytes above ASCII, whose words are looked at.
LATIN = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+"
PLAIN, PLAIN_MARKED, MARKED = re.compile(LATIN + rb"\Z"), re.compile(rb"(" + LATIN + rb")(" + MARKS + rb")\Z"), re.compile(rb"([A-Za-z\x80-\xff]+)(" + MARKS + rb")\Z")
#: A capital before a mark (from U+0300 on) may compose otherwise than its small letter does, so it must stay.
COMPOSING = re.compile(rb"[A-Z][\xcc-\xff]")
#: Letters below this code point are letters in every Unicode version of the libraries.
OLD_LETTERS = "\u0530"

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordIds:
    """The ids of each word seen, as little-endian 32-bit integers."""

    def __init__(self, data: str):
        self.tokenizer = Tokenizer.from_str(data)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(WORD_END)]] = True
        self.special = any(b"<|" in t.encode() for t in (x.content for x in self.tokenizer.get_added_tokens_decoder().values()))
        self.known: dict[bytes, bytes] = {}

    def split(self, text: bytes) -> list[bytes]:
        """White space cuts a text; ASCII letters are lower-cased here already, so that fewer words differ, unless a
        special token may be meant or the tokenizer, which composes letters first, might then see another letter."""
        if self.special and b"<|" in text:
            return text.split()
        if COMPOSING.search(text):
            return [w.lower() if w.isascii() else w for w in text.split()]
        return text.lower().split()

    @staticmethod
    def one_run(word: str) -> bool:
        """Whether the tokenizer's normal form of a word is letters alone, which it keeps in one piece."""
        return max(word) < OLD_LETTERS and word.isalpha() and unicodedata.normalize("NFC", word).lower().isalpha()

    def one(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def letters(self, words: list[bytes]) -> None:
        """Learn words of letters only: one call for many, cut where a token ends a word."""
        ids = np.array(self.tokenizer.encode(b" ".join(words).decode(), add_special_tokens=False).ids, np.uint32)
        ends = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
        if len(ends) != len(words) + 1 or ends[-1] != 4 * len(ids):
            self.known.update((w, self.one(w.decode())) for w in words)
        else:
            raw = ids.tobytes()
            self.known.update(zip(words, [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)], strict=True))

    def learn(self, words: list[bytes]) -> None:
        """A word whose normal form is letters and final ASCII marks has the ids of the letters, then of the marks."""
        plain, parted = set(), []
        for w in words:
            if w.isalpha() or PLAIN.match(w):
                plain.add(w)
            elif (m := PLAIN_MARKED.match(w)) or ((m := MARKED.match(w)) and self.one_run(m[1].decode())):
                parted.append((w, *m.groups()))
                plain.add(m[1])
            elif self.one_run(t := w.decode()):
                plain.add(w)
            else:
                self.known[w] = self.one(t)
        plain = list(plain.difference(self.known))
        for i in range(0, len(plain), 1000):
            self.letters(plain[i : i + 1000])
        for w, core, marks in parted:
            if marks not in self.known:
                self.known[marks] = self.one(marks.decode())
            self.known[w] = self.known[core] + self.known[marks]


def _word_ids(data: str) -> WordIds:
    cache = worker_cache("packing", hold=True)
    if (key := ("word_bpe", hash(data))) not in cache:
        cache[key] = WordIds(data)
    return cache[key]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, kept_words: int = KEPT_WORDS) -> DataFrame:
    """The documents' token pieces: (``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``).

    The tokenizer drops white space and never joins tokens across it, so a text's ids are its words' ids; a task
    encodes each of its words once, and a worker remembers about ``kept_words`` of them. Words are cut at ASCII white space only; the tokenizer cuts the rest.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())
    end, types = np.uint32(end_id).tobytes(), [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches):
        ids_of = _word_ids(data.value)
        known = ids_of.known
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                words = [ids_of.split(t) for t in pc.cast(part.column(1), pa.binary()).to_pylist()]
                every = set().union(*words)
                if len(known) > kept_words:  # only the words at hand stay
                    kept = {w: known[w] for w in every if w in known}
                    known.clear()
                    known.update(kept)
                ids_of.learn(list(every.difference(known)))
                rows = []
                for doc_id, ws in zip(part.column(0).to_pylist(), words, strict=True):
                    ids = b"".join([*map(known.__getitem__, ws), end])
                    for n, a in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[a : a + 4 * capacity]
                        rows.append((doc_id, n, a // 4, len(cut) // 4, zlib.crc32(cut)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"]
                )

    return small_batches(docs, 1000).select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, PIECES)


def plan(counts: dict[int, int], capacity: int) -> pd.DataFrame:
    """Best-fit decreasing over counts: rows (length, rank, bin, each, offset).

    Pieces of ``length`` from ``rank`` on fill the sequences from ``bin`` on, ``each`` of them in every sequence, the
    first at ``offset``; a row ends where the next of its length begins.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens -> intervals of sequences
    levels: list[int] = []  # the free amounts in use, in order
    rows, bins = [], 0

    def put(free: int, first: int, last: int) -> None:
        if free:
            if free not in room:
                room[free] = []
                insort(levels, free)
            room[free].append((first, last))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            i = bisect_left(levels, length)
            if i == len(levels):
                per = capacity // length
                put(capacity, bins, bins + -(-left // per))
                bins += -(-left // per)
                continue
            free = levels[i]
            first, last = room[free].pop()
            if not room[free]:
                del room[free], levels[i]
            per = free // length
            whole = min(last - first, left // per)
            if whole:
                rows.append((length, rank, first, per, capacity - free))
                put(free - per * length, first, first + whole)
                rank, left, first = rank + whole * per, left - whole * per, first + whole
            if left and first < last:  # fewer than fit into the next sequence
                rows.append((length, rank, first, per, capacity - free))
                put(free - left * length, first, first + 1)
                rank, left, first = rank + left, 0, first + 1
            if first < last:
                put(free, first, last)
    return pd.DataFrame(rows, columns=["length", "rank", "bin", "each", "offset"]).astype("int64")


def pack(parts: DataFrame, capacity: int = 4096) -> DataFrame:
    """``parts`` with ``sequence_id`` and ``offset``; ``length`` is 1 to ``capacity``.

    The parts are staged with a random number each, so that rows alike, too, are ranked in many salted parts. Columns of
    ``parts`` that are called ``sequence_id`` or ``offset`` are replaced.
    """
    spark, names = parts.sparkSession, [c for c in parts.columns if c not in ("sequence_id", "offset")]
    parts = staged(parts.select(*names).withColumn("_number", F.xxhash64(F.monotonically_increasing_id())), "pieces")
    counts = {r[0]: r[1] for r in parts.groupBy("length").agg(F.count("*")).collect()}
    if any(n is None or not 1 <= n <= capacity for n in counts):
        raise ValueError("lengths must be from 1 to the capacity")
    slots = plan(counts, capacity).sort_values(["length", "rank"])
    most = max(counts.values(), default=0)
    salts = max(LEAST_PARTS, -(-most // PART_ROWS))
    salted = parts.withColumn("_salt", F.pmod("_number", F.lit(salts)))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("length", "_salt").agg(F.count("*").alias("_count")).select(
        "length", "_salt", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_earlier")
    )
    within = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("_number"))
    ranked = salted.withColumn("_row", within).join(offsets, ["length", "_salt"]).withColumn("_rank", F.col("_earlier") + F.col("_row") - 1)
    #: One row per run of equal slots; at most a few for each pair of lengths.
    known = spark.sparkContext.broadcast(
        {c: slots[c].to_numpy() for c in slots} | {"key": slots["length"].to_numpy() * (1 << 48) + slots["rank"].to_numpy()}
    )

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        s = known.value
        i = np.searchsorted(s["key"], length.to_numpy() * (1 << 48) + rank.to_numpy(), side="right") - 1
        nth = rank.to_numpy() - s["rank"][i]
        return pd.DataFrame({"sequence_id": s["bin"][i] + nth // s["each"][i], "offset": s["offset"][i] + nth % s["each"][i] * length.to_numpy()})

    return ranked.withColumn("_slot", place("length", "_rank")).select(*names, "_slot.*")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, kept_words: int = KEPT_WORDS) -> DataFrame:
    """Tokenise once into the shared folder, then plan and place; ``kept_words`` bound a worker's memory, not the result."""
    return pack(pieces(docs, tokenizer_path, capacity, kept_words=kept_words), capacity)
