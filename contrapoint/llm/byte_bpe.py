"""Byte-level BPE encoding and decoding by recursive DuckDB queries inside each partition.

``encode`` splits a text by the tokenizer's pattern. A match that is itself a token has that id, as the tokenizer rules.
The bytes of every other word become token-position rows, and a recursive query joins neighbouring rows with the merge
table and contracts each word's leftmost pair of least rank until no pair is left. ``decode`` joins token-position rows
with the vocabulary and aggregates the bytes in order.

Words of more than ``LONG_BYTES`` bytes are first cut where no token of the vocabulary spans two bytes, which no merge can
cross. Parts that are still longer go through ``LONG``, which contracts at once every pair that is the least within reach:
a token holds at most ``reach`` bytes, so what lies farther off can't change a pair's tokens before its turn. A part of
more than ``LONG_QUERY`` bytes is read in blocks; near a block's open end nothing contracts, and the next block starts at
the last place that no merge can cross any more. So memory is bounded for any text, whatever its words.

Null texts and null id lists count as empty; an empty text has no ids. Rows are independent: repeated rows give repeated
results, and an empty table gives an empty one. Whole texts are encoded, whatever their length. An input column called
like the output column is replaced.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, worker_cache

#: Words of one recursive query, and the sum of their squared lengths, which bounds its rows; words that a task
#: remembers; text characters and tokens of one step; words of one step of a text longer than that.
QUERY_WORDS, QUERY_ROWS, KEPT_WORDS, STEP_CHARS, STEP_TOKENS, STEP_WORDS = 80_000, 16_000_000, 600_000, 6_000_000, 500_000, 200_000
#: Longest word of the plain recursion; steps of one long recursion, which are all held, and its bytes.
LONG_BYTES, LONG_STEPS, LONG_QUERY = 64, 16, 100_000
#: A row's key of the long recursion holds its part and its position.
SHIFT = 1 << 32
#: Bytes whose tokens are looked up together.
SPAN_BLOCK = 1 << 20

#: One contraction per word and step: the leftmost pair of least rank.
SHORT = f"""
WITH RECURSIVE step(it, k, tok) AS (
  SELECT 0::TINYINT, k, tok FROM chars
  UNION ALL
  (WITH pair AS (SELECT it, k, tok, lead(tok) OVER o AS nt, lead(k) OVER o AS nk, lag(k) OVER o AS pk FROM step WINDOW o AS (ORDER BY k)),
   best AS (SELECT k // {LONG_BYTES} AS w, min(m.id * {LONG_BYTES} + k % {LONG_BYTES}) AS b FROM pair JOIN merges m ON m.l = pair.tok AND m.r = pair.nt
            WHERE nk // {LONG_BYTES} = k // {LONG_BYTES} GROUP BY 1),
   live AS (SELECT it, k, tok, pk, b, w * {LONG_BYTES} + b % {LONG_BYTES} AS spot FROM pair JOIN best ON w = k // {LONG_BYTES})
   SELECT it + 1::TINYINT, k, CASE WHEN k = spot THEN b // {LONG_BYTES} ELSE tok END FROM live WHERE pk IS DISTINCT FROM spot)
)
SELECT it, k, tok FROM step
"""

#: All pairs that are the least within reach, every other one in a run of equal pairs whose start is among them. A pair
#: whose new token is part of one of lower rank (not ``safe``) waits until it is the leftmost of its rank within reach.
#: The token -1 stands for an open end: it is less than any pair, so nothing within reach of it contracts.
LONG = """
WITH RECURSIVE step(it, k, tok) AS (
  SELECT 0, k, tok FROM chars
  UNION ALL
  (WITH pair AS (SELECT it, k, tok, lead(tok) OVER o AS nt, lead(k) OVER o AS nk, row_number() OVER o AS rn FROM step WHERE it < {steps} WINDOW o AS (ORDER BY k)),
   hit AS (SELECT k, nk, rn, m.id, m.safe FROM pair JOIN merges m ON m.l = pair.tok AND m.r = pair.nt WHERE nk // {shift} = k // {shift}
           UNION ALL SELECT k, k, rn, -1, false FROM pair WHERE tok = -1),
   near AS (SELECT *, min(id) OVER (ORDER BY k RANGE BETWEEN {reach} PRECEDING AND 2 * {reach} FOLLOWING) = id AS least,
                   rn - row_number() OVER (PARTITION BY id ORDER BY rn) AS run, k - lag(k) OVER (PARTITION BY id ORDER BY rn) AS gap FROM hit),
   chosen AS (SELECT k, nk, id, k // {shift} AS w FROM near WHERE id >= 0
              WINDOW r AS (PARTITION BY id, run ORDER BY rn)
              QUALIFY CASE WHEN safe THEN bool_and(least) OVER r AND row_number() OVER r % 2 = 1 ELSE least AND coalesce(gap > 3 * {reach}, true) END)
   SELECT it + 1, p.k, coalesce(c.id, p.tok) FROM pair p LEFT JOIN chosen c ON c.k = p.k
   SEMI JOIN chosen own ON own.w = p.k // {shift} ANTI JOIN chosen gone ON gone.nk = p.k)
)
SELECT k, tok, it FROM (SELECT *, max(it) OVER (PARTITION BY k // {shift}) AS last FROM step) WHERE it = last ORDER BY k
"""

DECODE = "SELECT doc, unhex(string_agg(hex, '' ORDER BY pos)) AS bytes FROM tokens JOIN vocab USING (id) GROUP BY doc"


def read_ranks(path: str) -> bytes:
    """The rank file's lines; read by the driver and sent to the tasks (its size is the vocabulary's)."""
    with open(path, "rb") as f:
        return f.read()


class Spans:
    """The longest token that begins at each byte, by a walk down the tokens' tree for many bytes at once."""

    def __init__(self, tokens):
        child, self.longest = {}, max(map(len, tokens), default=1)
        ends = [False]
        for token in tokens:
            node = 0
            for byte in token:
                node = child.setdefault(node << 8 | byte, len(ends))
                if node == len(ends):
                    ends.append(False)
            ends[node] = True
        self.keys = np.array(sorted(child), np.int64)
        self.next, self.ends = np.array([child[k] for k in self.keys.tolist()], np.int64), np.array(ends)

    def lengths(self, raw: np.ndarray) -> np.ndarray:
        """The longest token from each byte on; at least 1."""
        out = np.ones(len(raw), np.int32)
        for start in range(0, len(raw), SPAN_BLOCK):
            part = raw[start : start + SPAN_BLOCK + self.longest].astype(np.int64)
            at = np.arange(min(SPAN_BLOCK, len(raw) - start))
            node = np.zeros(len(at), np.int64)
            for depth in range(self.longest):
                inside = at + depth < len(part)
                at, node = at[inside], node[inside]
                key = node << 8 | part[at + depth]
                slot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                found = self.keys[slot] == key
                at, node = at[found], self.next[slot[found]]
                if not len(at):
                    break
                done = self.ends[node]
                out[start + at[done]] = depth + 1
        return out


class Codec:
    """Vocabulary and merge table in an in-memory DuckDB, and the words of the last steps."""

    def __init__(self, lines: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines()) if a}
        self.pattern, self.words, self.spans = regex.compile(pattern), {}, None
        self.lut = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.digits = {i: b"%d" % i for i in self.ranks.values()}
        merges = [
            (a, b, i)
            for t, i in self.ranks.items()
            for k in range(1, len(t)) if (a := self.ranks.get(t[:k])) is not None and (b := self.ranks.get(t[k:])) is not None
        ]
        self.pairs = np.sort(np.array([a << 32 | b for a, b, _ in merges], np.int64))
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "256MB", "temp_directory": ""})
        left, right, ids = (pa.array(x, pa.int32()) for x in zip(*merges, strict=True)) if merges else (pa.array([], pa.int32()),) * 3
        self.con.register("m0", pa.table({"l": left, "r": right, "id": ids}))
        self.con.execute(
            "CREATE TABLE merges AS SELECT l, r, id, id <= coalesce(least((SELECT min(a.id) FROM m0 a WHERE a.l = m0.id), (SELECT min(a.id) FROM m0 a WHERE a.r = m0.id)), id) AS safe FROM m0"
        )
        self.con.unregister("m0")
        self.con.register("v0", pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "hex": [t.hex() for t in self.ranks]}))
        self.con.execute("CREATE TABLE vocab AS SELECT * FROM v0")
        self.con.unregister("v0")

    def query(self, sql: str, **tables) -> dict:
        for name, table in tables.items():
            self.con.register(name, pa.table(table))
        out = self.con.execute(sql).fetchnumpy()
        for name in tables:
            self.con.unregister(name)
        return out

    def _rows(self, words: list[bytes], shift: int):
        """The token-position rows of words: keys and the tokens of single bytes."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        w = np.repeat(np.arange(len(words)), lens)
        return w * shift + np.arange(len(w)) - np.repeat(np.cumsum(lens) - lens, lens), self.lut[np.frombuffer(b"".join(words), np.uint8)]

    @staticmethod
    def _split(key: np.ndarray, tok: np.ndarray, shift: int) -> list[bytes]:
        ends = [0, *(4 * (np.flatnonzero(np.diff(key // shift)) + 1)).tolist(), 4 * len(tok)]
        raw = tok.astype(np.int32).tobytes()
        return [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def contract(self, words: list[bytes]) -> list[bytes]:
        """The token ids of words of at most ``LONG_BYTES`` bytes, as little-endian 32-bit integers."""
        key, tok = self._rows(words, LONG_BYTES)
        out = self.query(SHORT, chars={"k": key.astype(np.int32), "tok": tok})
        # A word is done with the rows of its last step.
        word, last = out["k"] // LONG_BYTES, np.zeros(len(words), np.int8)
        np.maximum.at(last, word, out["it"])
        done = out["it"] == last[word]
        key, tok = out["k"][done], out["tok"][done]
        order = np.argsort(key)
        return self._split(key[order], tok[order], LONG_BYTES)

    def _fixpoint(self, key: np.ndarray, tok: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of long parts contracted until no pair is left, in bounded recursions."""
        sql = LONG.format(steps=LONG_STEPS, shift=SHIFT, reach=reach)
        keys, toks = [], []
        while len(key):
            out = self.query(sql, chars={"k": key, "tok": tok})
            more = out["it"] >= LONG_STEPS
            keys.append(out["k"][~more])
            toks.append(out["tok"][~more])
            key, tok = out["k"][more], out["tok"][more]
        key, tok = np.concatenate(keys), np.concatenate(toks)
        order = np.argsort(key, kind="stable")
        return key[order], tok[order]

    def contract_long(self, parts: list[bytes], reach: int) -> list[bytes]:
        """The token ids of parts of more than ``LONG_BYTES`` bytes whose tokens hold at most ``reach`` bytes."""
        out: list[bytes] = []
        group, size = [], 0
        for part in [*parts, None]:
            if group and (part is None or size + len(part) > LONG_QUERY):
                out += self._split(*self._fixpoint(*self._rows(group, SHIFT), reach), SHIFT)
                group, size = [], 0
            if part is not None:
                if len(part) > LONG_QUERY:
                    out.append(self._blocks(part, reach))
                else:
                    group.append(part)
                    size += len(part)
        return out

    def _blocks(self, part: bytes, reach: int) -> bytes:
        """A part's ids, block by block."""
        out, start, most = bytearray(), 0, LONG_QUERY
        while len(part) - start > most:
            key, tok = self._rows([part[start : start + most]], SHIFT)
            key, tok = self._fixpoint(np.append(key, most), np.append(tok, np.int32(-1)), reach)
            pair = tok[:-1].astype(np.int64) << 32 | tok[1:].astype(np.int64)
            slot = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            open_pairs = np.flatnonzero((self.pairs[slot] == pair) | (tok[1:] == -1))
            # No merge crosses the last place that lies a token's length before the first pair that is left.
            final = np.searchsorted(key, key[open_pairs[0]] - reach, side="right") - 1
            if final <= 0:
                most *= 2
                continue
            out += tok[:final].astype(np.int32).tobytes()
            start, most = start + int(key[final]), LONG_QUERY
        return bytes(out + self._split(*self._fixpoint(*self._rows([part[start:]], SHIFT), reach), SHIFT)[0])

    def _cut(self, word: bytes) -> tuple[list[bytes], int]:
        """Parts that end between bytes that no token spans, and the longest token in the word.

        Of neighbouring places the last in every ``LONG_BYTES`` / 2 bytes is cut, so a part with more inside is short.
        """
        if self.spans is None:
            self.spans = Spans(self.ranks)
        lengths = self.spans.lengths(np.frombuffer(word, np.uint8))
        far = np.maximum.accumulate(np.arange(len(word)) + lengths)
        cuts = np.append(np.flatnonzero(far[:-1] == np.arange(1, len(word))) + 1, len(word))
        bucket = cuts // (LONG_BYTES // 2)
        cuts = [0, *cuts[np.append(bucket[:-1] != bucket[1:], True)].tolist()]
        return [word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], int(lengths.max())

    def _learn(self, words) -> dict[str, bytes]:
        """The ids of new words: short ones are remembered, long ones returned."""
        short, long = {}, {}
        for w in words:
            raw = w.encode()
            if (i := self.ranks.get(raw)) is not None:
                self.words[w] = i.to_bytes(4, "little")
            elif len(raw) <= LONG_BYTES:
                short[raw] = w
            else:
                long[w] = raw
        found, reach, parts = {}, 1, {}
        for w, raw in long.items():
            parts[w], own = self._cut(raw)
            reach = max(reach, own)
        pieces = set(chain.from_iterable(parts.values()))
        queued = [*short, *(x for x in pieces if len(x) <= LONG_BYTES and x not in short)]
        queued.sort(key=len)
        while queued:
            n, rows = 0, 0
            while n < min(QUERY_WORDS, len(queued)) and (not n or rows + len(queued[-1 - n]) ** 2 <= QUERY_ROWS):
                rows += len(queued[-1 - n]) ** 2
                n += 1
            batch = queued[-n:]
            del queued[-n:]
            for raw, ids in zip(batch, self.contract(batch), strict=True):
                if raw in short:
                    self.words[short[raw]] = ids
                if raw in pieces:
                    found[raw] = ids
        far = [x for x in pieces if len(x) > LONG_BYTES]
        found.update(zip(far, self.contract_long(far, reach), strict=True))
        return {w: b"".join(map(found.__getitem__, p)) for w, p in parts.items()}

    def _ids(self, split: list[list[str]]) -> list[bytes]:
        """The ids of lists of words."""
        every = set().union(*split)
        if len(self.words) + len(every) > KEPT_WORDS and self.words:
            self.words = {w: self.words[w] for w in every if w in self.words}
        far = self._learn(every.difference(self.words))
        if far:
            return [b"".join([far[w] if w in far else self.words[w] for w in ws]) for ws in split]
        return [b"".join(map(self.words.__getitem__, ws)) for ws in split]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit integers; a text of more than ``STEP_CHARS`` is read in steps."""
        if sum(map(len, texts)) <= STEP_CHARS:
            return self._ids([self.pattern.findall(t) for t in texts])
        out = []
        for t in texts:
            if len(t) <= STEP_CHARS:
                out += self._ids([self.pattern.findall(t)])
                continue
            ids, words, size = bytearray(), [], 0
            for m in self.pattern.finditer(t):
                words.append(m.group())
                size += m.end() - m.start()
                if len(words) >= STEP_WORDS or size >= STEP_CHARS:
                    ids += self._ids([words])[0]
                    words, size = [], 0
            out.append(bytes(ids + self._ids([words])[0]))
        return out

    def decode(self, lists: list[np.ndarray]) -> list[bytes]:
        """The bytes of each id list, in slices of at most ``STEP_TOKENS`` ids."""
        out = [bytearray() for _ in lists]
        held, size = [], 0
        for i, ids in enumerate(lists):
            for a in range(0, len(ids), STEP_TOKENS):
                part = ids[a : a + STEP_TOKENS]
                if size + len(part) > STEP_TOKENS:
                    self._decode(held, out)
                    held, size = [], 0
                held.append((i, part))
                size += len(part)
        self._decode(held, out)
        return [bytes(x) for x in out]

    def _decode(self, held: list[tuple[int, np.ndarray]], out: list[bytearray]) -> None:
        if held:
            doc = np.repeat(np.arange(len(held), dtype=np.int32), [len(x) for _, x in held])
            got = self.query(
                DECODE,
                tokens={"doc": doc, "pos": np.arange(len(doc), dtype=np.int32), "id": np.concatenate([x for _, x in held]).astype(np.int32)}
            )
            found = dict(zip(got["doc"].tolist(), got["bytes"], strict=True))
            for n, (i, _) in enumerate(held):
                out[i] += bytes(found.get(n, b""))


def _codec(lines, pattern: str) -> Codec:
    cache = worker_cache("byte_bpe", hold=True)
    key = ("byte_bpe", hash(lines.value), pattern)
    if key not in cache:
        cache[key] = Codec(lines.value, pattern)
    return cache[key]


def _steps(sizes, most: int):
    """Slices of rows whose sizes add up to about ``most``."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def _encoded(codec: Codec, texts):
    """Slices of a column of texts with their id lists."""
    for a, b in _steps(pc.binary_length(texts).to_numpy(zero_copy_only=False), STEP_CHARS):
        yield a, b, [np.frombuffer(x, np.int32) for x in codec.encode(texts.slice(a, b - a).to_pylist())]


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with its text column replaced by ``out``, the array of token ids."""
    keep = [c for c in docs.columns if c not in (text, out)]
    lines = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches):
        codec = _codec(lines, pattern)
        for batch in batches:
            n = batch.num_columns - 1
            for a, b, found in _encoded(codec, batch.column(n)):
                ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(n)), ids], names=[*keep, out])

    rows = small_batches(docs, 1000).select(*keep, F.coalesce(F.col(text), F.lit("")).alias(text))
    return rows.mapInArrow(run, rows.drop(text).withColumn(out, F.expr("CAST(array() AS array<int>)")).schema)


def decode(rows: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the column ``out``, the bytes that its ids stand for; an id outside the vocabulary stands for none."""
    keep = [c for c in rows.columns if c not in (ids, out)]
    lines = rows.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches):
        codec = _codec(lines, pattern)
        for batch in batches:
            n = batch.num_columns - 1
            lists = batch.column(n)
            for a, b in _steps(lists.value_lengths().to_numpy(zero_copy_only=False), STEP_TOKENS):
                part = lists.slice(a, b - a)
                raw = codec.decode(
                    np.split(part.flatten().to_numpy(zero_copy_only=False), np.cumsum(part.value_lengths().to_numpy(zero_copy_only=False))[:-1])
                )
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(a, b - a) for i in range(n)), part, pa.array(raw, pa.binary())], names=[*keep, ids, out]
                )

    rows = rows.select(*keep, F.coalesce(F.filter(F.col(ids), lambda i: i.isNotNull()), F.expr("CAST(array() AS array<int>)")).alias(ids))
    return rows.mapInArrow(run, rows.withColumn(out, F.lit(b"")).schema)


def digest(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per document: its number of tokens, and SHA-256 of its ids and of the bytes decoded from them.

    The ids of a text are decoded where they were encoded, so that neither ids nor bytes travel.
    """
    lines = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches):
        codec = _codec(lines, pattern)
        digits = codec.digits
        for batch in batches:
            for a, b, lists in _encoded(codec, batch.column(1)):
                hashes = []
                for ids in lists:
                    h = hashlib.sha256()
                    for at in range(0, len(ids), STEP_TOKENS):
                        h.update((b" " if at else b"") + b" ".join([digits[i] for i in ids[at : at + STEP_TOKENS].tolist()]))
                    hashes.append(h.hexdigest())
                raw = [hashlib.sha256(x).hexdigest() for x in codec.decode(lists)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a), pa.array([len(x) for x in lists], pa.int64()), pa.array(hashes, pa.string()),
                        pa.array(raw, pa.string())
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                )

    rows = small_batches(docs, 1000).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    schema = rows.select("doc_id", F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256")).schema
    return rows.mapInArrow(run, schema)
