"""Subword-lattice language model: the marginal probability of a text over all segmentations of its words.

Every word, known or not, is scored by its lattice: an arc for each vocabulary piece that it holds (characters without one
have an arc of their bytes' pieces), and a log-space recursion that sums all paths. The vocabulary's existing scores
weight the arcs. Training rows correct these weights in two ways. First the pieces are re-weighted ``PASSES`` times by
their expected uses over all segmentations of all training words, each as often as it occurs, with the existing scores as
``PRIOR`` uses. Then one more pass counts which pieces follow which, begin and end words: a piece's weight after another
is its expected uses there plus ``BACKOFF`` times its own weight, over all uses there.

A text is drawn from one of a few classes, such as its language, which have such counts of their own, again with
``BACKOFF`` times those of all classes. The text's probability sums over all classes; the class of a scored text is never
read. Words are independent given the class, so a text's log-probability sums its words' and one end token's.

Beside the learned score stands ``unigram_score``: the marginal log10 probability of the text's words by the vocabulary's
existing scores alone, by the forward recursion over all segmentations of each word, without anything learned.

The pieces of a vocabulary that only ranks them start at 1 / (``ZIPF`` + rank). The learned model takes words of more than
``SEGMENT`` characters for several segments, each with a lattice of its own, of which only the first begins with the word's
mark; ``unigram_score`` carries the nodes' sums from one to the next, so it sums all segmentations of a word of any length.
Neighbours of less than ``LEAST`` chance in a word count as no uses.

Counts cover every training row and every pair; what goes to all tasks is bounded by the vocabulary, the classes and
``PAIRS``. Pairs beyond those are joined to the words whose lattices have them, so all scores are by all pairs. Rows are
dealt to groups of bounded bytes by a hash of the row and its place; a group's distinct words are joined with the corpus's
word table, the most frequent words in several parts, so no task needs all words. Rows without words need no group.

Null and empty texts hold the end token alone. Rows without an id count as training rows. Repeated rows count as often
as they occur. An empty table gives an empty one. Columns of the input other than those named play no part.
"""

from __future__ import annotations

import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, give_back, small_batches, staged, staged_so_far, worker_cache

#: Offset of a ranked piece's weight, smoothing of the base, bytes of a group, documents of a step, words that a task holds
#: counts of.
ZIPF, SMOOTH, GROUP_BYTES, STEP_DOCS, COUNTED = 10.0, 0.1, 12_000_000, 2000, 1_000_000
#: Passes that re-weight the pieces, the uses that the existing scores stand for, and the uses that a piece's own weight
#: stands for after each other piece.
PASSES, PRIOR, BACKOFF = 1, 100.0, 2.0
#: Pairs of neighbouring pieces that every task holds (those of most uses; the others are joined to the words that have
#: them), least chance of a pair in a word that is counted.
PAIRS, LEAST = 1_000_000, 1e-3
#: Words and their bytes that are weighed together where pairs are joined; bits of the filter of these pairs, for each and at most.
JOINED, JOINED_BYTES, FILTER_PLACES, FILTER_BITS = 100_000, 4_000_000, 16, 1 << 27
#: Classes of texts at most (the most frequent; the others are one more), characters of a segment and of a step.
CLASSES, SEGMENT, STEP_CHARS = 8, 4096, 120_000
#: Groups for which a frequent word's row of the word table serves, and the part of all words that makes one frequent.
SERVES, FREQUENT = 1000, 1e-3
#: The mark that starts a word in the vocabulary; slots of the piece table as a power of two.
START, SLOT_BITS = "▁", 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
LOG10 = np.log(10)


def read_pieces(path: str) -> dict[str, float]:
    """The pieces of a sentencepiece model with their natural log weights, normalised.

    Unigram models hold log-probabilities; where scores are whole ranks they are turned into weights.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    scores = {sp.id_to_piece(i): sp.get_score(i) for i in own}
    scores = {p: s for p, s in scores.items() if START not in p[1:] and p}
    if all(s == int(s) for s in scores.values()):
        scores = {p: -np.log(ZIPF + abs(s) if s or not p.startswith("<0x") else ZIPF + len(scores)) for p, s in scores.items()}
    total = np.logaddexp.reduce(np.array(list(scores.values())))
    return {p: float(s - total) for p, s in scores.items()}


def _slots(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    return [((keys ^ (keys >> np.uint64(29))) * np.uint64(m) >> np.uint64(64 - bits)).astype(np.int64) for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class Table:
    """Row numbers of distinct 64-bit keys: a hash table with a few places for each key."""

    def __init__(self, keys: np.ndarray, bits: int):
        self.bits, self.size = bits, len(keys)
        self.keys, self.rows = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        left = np.arange(len(keys))
        for n in range(4):
            at = _slots(keys[left], bits)[n]
            free = self.rows[at] < 0
            place, first = np.unique(at[free], return_index=True)
            won = left[free][first]
            self.keys[place], self.rows[place] = keys[won], won
            left = np.setdiff1d(left, won)
        self.late = {int(k): int(i) for k, i in zip(keys[left], left, strict=True)}

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """The keys' row numbers; the number of rows for keys that are not there."""
        out, left = np.full(len(keys), self.size, np.int32), None
        for n in range(4):
            some = keys if left is None else keys[left]
            at = _slots(some, self.bits)[n]
            rows = self.rows[at]
            hit = (rows >= 0) & (self.keys[at] == some)
            if left is None:
                out[hit] = rows[hit]
                left = np.flatnonzero(~hit & (rows >= 0))  # a free place: the key is not there
            else:
                out[left[hit]] = rows[hit]
                left = left[~hit & (rows >= 0)]
            if not len(left):
                return out
        if self.late:
            out[left] = [self.late.get(k, self.size) for k in keys[left].tolist()]
        return out


class Arcs:
    """The lattices of many words: arcs from node to node, in the order of their ends, and where each word's lie.

    ``number`` is the arc's piece; the number after the last is that of a character without a piece.
    """

    def __init__(self, codes: np.ndarray, lens: np.ndarray, vocabulary: Vocabulary):
        self.lens, total = lens, len(codes)
        owner = np.repeat(np.arange(len(lens)), lens)
        last = np.cumsum(self.lens)[owner]
        code, h, at = codes.astype(np.uint64) + np.uint64(1), np.zeros(total, np.uint64), np.arange(total)
        starts, sizes, numbers = [], [], []
        plain = np.zeros(total, bool)
        for n in range(1, vocabulary.longest + 1):
            inside = at + n <= last[at]
            at = at[inside]
            h = h[inside] * MULTIPLIER + code[at + n - 1]
            row = vocabulary.table.lookup(h)
            found = row < vocabulary.table.size  # the first n characters begin some piece
            at, h = at[found], h[found]
            if not len(at):
                break
            number = vocabulary.number[row[found]]
            found = number < vocabulary.size
            starts.append(at[found])
            numbers.append(number[found])
            sizes.append(np.full(len(starts[-1]), n, np.int64))
            if n == 1:
                plain[starts[0]] = True
        lost = np.flatnonzero(~plain)
        own, place = np.unique(codes[lost], return_inverse=True)
        spell = lambda b: np.array([b[list(chr(c).encode("utf-8", "surrogatepass"))].sum() for c in own.tolist()])[place] if len(own) else np.empty(0)
        at, size = np.concatenate([*starts, lost]), np.concatenate([*sizes, np.ones(len(lost), np.int64)])
        number = np.concatenate([*numbers, np.full(len(lost), vocabulary.size, np.int32)])
        spelled = lambda b: np.concatenate([np.zeros(len(at) - len(lost)), spell(b)])
        part = owner[at]
        first = (np.cumsum(self.lens) - self.lens)[part]
        # A part of n characters has n + 1 nodes.
        order = np.argsort(at + size + part, kind="stable")
        self.start, self.end, self.part = (at + part)[order], (at + size + part)[order], part[order]
        self.number = number[order].astype(np.int64)
        #: The log weight of the bytes of characters without a piece, by arc, and by the existing scores.
        self.extra = spelled(vocabulary.bytes)[order]
        self.existing = vocabulary.existing[self.number] + (self.extra if vocabulary.existing_bytes is vocabulary.bytes else spelled(vocabulary.existing_bytes)[order])
        self.begin, self.stop = (at - first)[order], (at + size - first)[order]
        self.nodes = total + len(lens)
        self.heads = np.cumsum(self.lens + 1) - self.lens - 1  # each part's first node
        self.tails = self.heads + self.lens

    def levels(self, by: np.ndarray):
        """The arcs with equal places, in the order of places."""
        order = np.argsort(by, kind="stable")
        cuts = np.flatnonzero(np.diff(by[order])) + 1
        return np.split(order, cuts) if len(order) else []

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """All arcs that meet at a node: the numbers of the first, in order, and of the second."""
        own = np.bincount(self.start, minlength=self.nodes)
        low, order = np.cumsum(own) - own, np.argsort(self.start, kind="stable")
        count = own[self.end]
        before = np.repeat(np.arange(len(count)), count)
        after = order[np.repeat(low[self.end] - (np.cumsum(count) - count), count) + np.arange(len(before))]
        return before, after


def _log_sums(target: np.ndarray, places: np.ndarray, values: np.ndarray) -> None:
    """``target`` at each of the ``places`` (in order) becomes the log of the summed exponentials of its ``values``."""
    if len(places):
        new = np.diff(places, prepend=places[0] - 1) != 0
        cut = np.flatnonzero(new)
        most = np.maximum(np.maximum.reduceat(values, cut), -1e300)  # so that no way at all stays minus infinity
        with np.errstate(divide="ignore"):
            target[places[cut]] = most + np.log(np.add.reduceat(np.exp(values - most[np.cumsum(new) - 1]), cut))


class Vocabulary:
    """Piece lookups, and lattices with a weight for each piece whatever is next to it."""

    def __init__(self, pieces: dict[str, float], existing: dict[str, float] | None = None):
        in_bytes = lambda p: np.array([p.get(f"<0x{i:02X}>", np.log(1e-9)) for i in range(256)])
        self.bytes = in_bytes(pieces)
        self.pieces = [p for p in pieces if not (p.startswith("<0x") and len(p) == 6)]
        self.size, self.longest = len(self.pieces), max(map(len, self.pieces), default=1)
        #: The log weights by piece, and 0 for a character without a piece, whose bytes have their own.
        self.weights = np.array([*(pieces[p] for p in self.pieces), 0.0])
        #: The same by the existing scores, which ``pieces`` are unless they were re-weighted.
        self.existing = self.weights if existing is None else np.array([*(existing[p] for p in self.pieces), 0.0])
        self.existing_bytes = self.bytes if existing is None else in_bytes(existing)
        numbers = {p[:n]: self.size for p in self.pieces for n in range(1, len(p) + 1)} | {p: i for i, p in enumerate(self.pieces)}
        #: All beginnings of pieces; a beginning that is a piece has its number.
        self.table, self.number = Table(np.array([self.key(p) for p in numbers], np.uint64), SLOT_BITS), np.array(list(numbers.values()), np.int32)

    @staticmethod
    def key(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(MULTIPLIER) + ord(c) + 1) % 2**64
        return h

    def steps(self, words):
        """Arcs of some words (a list or an Arrow array) at a time, and the words' numbers by part."""
        words = pa.array(words, pa.string()) if isinstance(words, list) else words
        lens = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = np.flatnonzero(np.diff((np.cumsum(lens + 1) - 1) // STEP_CHARS, prepend=-1))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(lens)], strict=True):
            some, size = words.slice(a, b - a), lens[a:b]
            offsets = np.frombuffer(some.buffers()[1], np.int32)[some.offset : some.offset + b - a + 1]
            raw = some.buffers()[2][int(offsets[0]) : int(offsets[-1])].to_pybytes() if offsets[-1] > offsets[0] else b""
            chars = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
            # A word's first segment has the mark and SEGMENT characters, each other one SEGMENT of them.
            parts = np.maximum(1, -(-size // SEGMENT))
            owner = np.repeat(np.arange(a, b), parts)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
            own = np.minimum(SEGMENT, size[owner - a] - nth * SEGMENT) + (nth == 0)
            codes, marked = np.empty(len(chars) + b - a, np.uint32), np.zeros(len(chars) + b - a, bool)
            marked[(np.cumsum(own) - own)[nth == 0]] = True
            codes[marked], codes[~marked] = ord(START), chars
            yield Arcs(codes, own, self), owner

    def sums(self, arcs: Arcs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The arcs' log weights, and for each node the log sums of all ways from its word's start and to its end."""
        weight = self.weights[arcs.number] + arcs.extra
        ahead, behind = np.full(arcs.nodes, -np.inf), np.full(arcs.nodes, -np.inf)
        ahead[arcs.heads], behind[arcs.tails] = 0, 0
        for level in arcs.levels(arcs.stop):
            _log_sums(ahead, arcs.end[level], ahead[arcs.start[level]] + weight[level])
        for level in reversed(arcs.levels(arcs.begin)):
            level = level[np.argsort(arcs.start[level], kind="stable")]
            _log_sums(behind, arcs.start[level], weight[level] + behind[arcs.end[level]])
        return weight, ahead, behind

    def marginals(self, words: list[str]) -> np.ndarray:
        """Each word's natural log of the summed probability of all its segmentations, by the existing scores."""
        out = np.zeros(len(words))
        for arcs, owner in self.steps(words):
            self.add_marginals(arcs, owner, words, out)
        return out

    def add_marginals(self, arcs: Arcs, owner: np.ndarray, words, out: np.ndarray) -> None:
        """The marginals of the words of these arcs, put into ``out``; words of several segments go through theirs in order."""
        ahead = np.full(arcs.nodes, -np.inf)
        ahead[arcs.heads] = 0
        for level in arcs.levels(arcs.stop):
            _log_sums(ahead, arcs.end[level], ahead[arcs.start[level]] + arcs.existing[level])
        out[owner] = ahead[arcs.tails]
        numbers, parts = np.unique(owner, return_counts=True)
        for i in numbers[parts > 1].tolist():
            word = words[i] if isinstance(words, list) else words[i].as_py()
            out[i] = self.long_marginal(np.frombuffer((START + word).encode("utf-32-le"), np.uint32))

    def long_marginal(self, codes: np.ndarray) -> float:
        """The marginal of one word's characters: arcs of a segment at a time, the sums of all nodes kept."""
        ahead = np.full(len(codes) + 1, -np.inf)
        ahead[0] = 0
        for a in range(0, len(codes), SEGMENT):
            own = codes[a : a + SEGMENT + self.longest]  # pieces that begin in the segment may end behind it
            arcs = Arcs(own, np.array([len(own)]), self)
            begins = np.flatnonzero(arcs.begin < SEGMENT)
            order = begins[np.argsort(arcs.stop[begins], kind="stable")]
            for level in np.split(order, np.flatnonzero(np.diff(arcs.stop[order])) + 1):
                if len(level):
                    end = a + arcs.stop[level[0]]
                    ahead[end] = np.logaddexp.reduce(np.append(ahead[a + arcs.begin[level]] + arcs.existing[level], ahead[end]))
        return float(ahead[-1])

    def expected(self, words: list[str], times: np.ndarray) -> np.ndarray:
        """How often each piece is used in all words, over their segmentations."""
        out = np.zeros(self.size + 1)
        for arcs, owner in self.steps(words):
            weight, ahead, behind = self.sums(arcs)
            chance = np.exp(ahead[arcs.start] + weight + behind[arcs.end] - ahead[arcs.tails][arcs.part])
            out += np.bincount(arcs.number, chance * times[owner[arcs.part]], len(out))
        return out

    def expected_pairs(self, words: list[str], times: np.ndarray, into: Uses) -> None:
        """How often each piece follows each, begins (after ``BEGIN``) or ends a word (before ``FINISH``), by ``_pair``."""
        for arcs, owner in self.steps(words):
            weight, ahead, behind = self.sums(arcs)
            total, often = ahead[arcs.tails][arcs.part], times[owner[arcs.part]]
            chance = np.exp(ahead[arcs.start] + weight + behind[arcs.end] - total) * often
            head = np.flatnonzero((arcs.begin == 0) & np.append(True, owner[1:] != owner[:-1])[arcs.part])
            last = np.flatnonzero(arcs.end == arcs.tails[arcs.part])
            before, after = arcs.pairs()
            both = np.exp(ahead[arcs.start[before]] + weight[before] + weight[after] + behind[arcs.end[after]] - total[after])
            kept = np.flatnonzero((both >= LEAST) & (arcs.number[after] < self.size))
            into.add(_pair(np.full(len(head), BEGIN), arcs.number[head]), chance[head])
            into.add(_pair(arcs.number[last], np.full(len(last), FINISH)), chance[last])
            into.add(_pair(arcs.number[before[kept]], arcs.number[after[kept]]), both[kept] * often[after[kept]])


class Uses:
    """Sums by key; what was added is put together once it is as much as what is there."""

    def __init__(self):
        self.keys, self.uses, self.added, self.size = np.empty(0, np.int64), np.empty(0), [], 0

    def add(self, keys: np.ndarray, uses: np.ndarray) -> None:
        self.added.append((keys, uses))
        self.size += len(keys)
        if self.size > max(250_000, len(self.keys)):
            self.total()

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if self.added:
            keys, uses = (np.concatenate(x) for x in zip((self.keys, self.uses), *self.added, strict=True))
            self.keys, place = np.unique(keys, return_inverse=True)
            self.uses = np.bincount(place, uses, len(self.keys))
            self.added, self.size = [], 0
        return self.keys, self.uses


#: What stands for the place before a word's first piece and for its end.
BEGIN, FINISH = (1 << 20) - 2, (1 << 20) - 1


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.int64) << 20 | b.astype(np.int64)


class Model:
    """Lattices whose pieces' weights depend on the piece before and on the text's class.

    ``pieces`` are log weights; ``classes``, ``keys`` and ``uses`` tell how often a class has two pieces next to each other
    (``_pair``), ``words`` and ``texts`` how many words and texts it has. Where they are not all pairs, ``following`` has all
    uses after each piece by class, and those left out can be given to ``both_scores`` as ``more``.
    """

    def __init__(self, pieces: dict[str, float], classes, keys, uses, words, texts, existing: dict[str, float] | None = None, following=None):
        self.vocabulary = v = Vocabulary(pieces, existing)
        count, n = len(words), v.size + 1
        a, b = keys >> 20, keys & (1 << 20) - 1
        ends, starts, after = np.zeros((count, n)), np.zeros((count, n)), np.zeros((count, n))
        for z in range(count):
            own = classes == z
            first, last = own & (a == BEGIN), own & (b == FINISH)
            starts[z, b[first]], ends[z, a[last]] = uses[first], uses[last]
            after[z] = np.bincount(a[own & ~first], uses[own & ~first], n) if following is None else following[z]
        share = ends.sum() / after.sum() if after.sum() else 0.5  # a word's end among all that follows pieces
        own, plain = np.exp(v.weights) * (1 - share), np.exp(v.weights)
        blend = self.blend
        every, inner = after.sum(0), np.flatnonzero((a != BEGIN) & (b != FINISH))
        pairs, place = np.unique(keys[inner], return_inverse=True)
        self.chance, self.after = own, after
        of_class = np.zeros((count, len(pairs)))
        np.add.at(of_class, (classes[inner], place), uses[inner])
        self.table, self.pair = self.weighed(pairs, of_class)
        with np.errstate(divide="ignore"):
            self.own = np.log(own)
            self.rest = np.log(BACKOFF / (every + BACKOFF)) + np.log(BACKOFF / (after + BACKOFF))
            self.stop = np.log(blend(ends, blend(ends.sum(0), share, every), after))
            self.start = np.log(blend(starts, blend(starts.sum(0), plain, starts.sum()), starts.sum(1, keepdims=True)))
        words, texts = np.asarray(words, float), np.asarray(texts, float)
        self.prior, (self.end, self.more) = priors(words, texts)

    @staticmethod
    def blend(some, base, total):
        return (some + BACKOFF * base) / (total + BACKOFF)

    def weighed(self, pairs: np.ndarray, uses: np.ndarray) -> tuple[Table, np.ndarray]:
        """The table of some distinct pairs and, by class, the log weights of their second pieces; ``uses`` are classes x pairs."""
        a, b = pairs >> 20, pairs & (1 << 20) - 1
        base = self.blend(uses.sum(0), self.chance[b], self.after.sum(0)[a])
        with np.errstate(divide="ignore"):
            logs = np.array([np.log(self.blend(some, base, after[a])) for some, after in zip(uses, self.after, strict=True)], np.float32)
        return Table(pairs.astype(np.uint64), max(8, int(len(pairs)).bit_length() + 1)), logs

    def unheld(self, words, may: np.ndarray | None) -> np.ndarray:
        """The pairs in the words' lattices that the model doesn't hold, of which ``may`` (bits by ``_bit``), if given, leaves most out."""
        out, added, size = np.empty(0, np.int64), [], 0
        for arcs, _ in self.vocabulary.steps(words):
            before, after = arcs.pairs()
            keys = np.unique(_pair(arcs.number[before], arcs.number[after]))
            keys = keys[self.table.lookup(keys.astype(np.uint64)) == self.table.size]
            if may is not None:
                at = _bit(keys, 64 * len(may))
                keys = keys[may[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1) == 1]
            added.append(keys)
            size += len(keys)
            if size > max(250_000, len(out)):
                out, added, size = np.unique(np.concatenate([out, *added])), [], 0
        return np.unique(np.concatenate([out, *added]))

    def word_scores(self, words: list[str]) -> np.ndarray:
        """(words x classes) natural logs of each word's probability, that it is no end among it."""
        return self.both_scores(words)[0]

    def both_scores(self, words, more: tuple[Table, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """``word_scores``, and the words' marginals by the existing scores, from the same lattices; ``more`` are ``weighed`` pairs."""
        v, out, plain_out = self.vocabulary, np.zeros((len(words), len(self.start))), np.zeros(len(words))
        for arcs, owner in v.steps(words):
            v.add_marginals(arcs, owner, words, plain_out)
            before, after = arcs.pairs()
            # From the words' ends on: the pairs by the place where they meet, then by their first arc.
            order = np.argsort(arcs.stop[before].astype(np.uint16), kind="stable")
            before, after = before[order], after[order]
            place = arcs.stop[before]
            cuts = np.append(np.flatnonzero(np.diff(place, prepend=-1)), len(place))
            ranges = list(zip(cuts[-2::-1].tolist(), cuts[:0:-1].tolist(), strict=True))
            number = arcs.number
            keys, plain = _pair(number[before], number[after]).astype(np.uint64), self.own[number[after]] + arcs.extra[after]
            tables = []
            for table, logs in ((self.table, self.pair), *([more] if more else [])):
                row = table.lookup(keys)
                known = np.flatnonzero(row < table.size)
                tables.append((known, row[known], logs))
            last, begins = np.flatnonzero(arcs.end == arcs.tails[arcs.part]), np.append(True, owner[1:] != owner[:-1])
            head = np.flatnonzero(arcs.begin == 0)
            head = head[np.argsort(arcs.part[head], kind="stable")]
            first = begins[arcs.part[head]]
            for z in range(out.shape[1]):
                step = self.rest[z][number[before]] + plain
                for known, row, logs in tables:
                    step[known] = logs[z][row]
                behind = np.full(len(number), -np.inf)
                behind[last] = self.stop[z][number[last]]
                for a, b in ranges:
                    _log_sums(behind, before[a:b], step[a:b] + behind[after[a:b]])
                way = np.where(first, self.start[z][number[head]], self.own[number[head]]) + arcs.extra[head] + behind[head]
                sums = np.full(len(arcs.lens), -np.inf)
                _log_sums(sums, arcs.part[head], way)
                np.add.at(out[:, z], owner, sums)
        return out + self.more, plain_out


def priors(words, texts):
    """The classes' log chances, and those of an end and of a word where either may follow."""
    words, texts = np.asarray(words, float), np.asarray(texts, float)
    return np.log((texts + 1) / (texts.sum() + len(texts))), np.log(np.stack([texts + 1, words + 1]) / (words + texts + 2))


def _cached(sent, make):
    """What ``make`` makes of a broadcast value, once for each Python process."""
    cache, (key, value) = worker_cache("lattice_lm"), sent.value
    if cache.get("made", (None,))[0] != key:
        cache.pop("made", None)
        cache["made"] = key, make(value)
        give_back()  # making a model frees more than it keeps
    return cache["made"][1]


def _sent(spark, value):
    return spark.sparkContext.broadcast((uuid.uuid4().hex, value))


def _gathered(batches, rows: int = 50_000):
    """Record batches joined to about ``rows`` rows: the recursion works on many words at once."""
    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, count = [], 0
    if count:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _bit(keys: np.ndarray, bits: int) -> np.ndarray:
    """A place among ``bits``, a power of two, for each key."""
    return _slots(keys.astype(np.uint64), bits.bit_length() - 1)[3]


def _uses(words: DataFrame, pieces: dict[str, float], pairs: bool) -> DataFrame:
    """Expected uses over ``words`` (``word``, ``z``, ``n``): (``z``, ``key``, ``n``), keys being pairs, or pieces and no classes."""
    sent = _sent(words.sparkSession, pieces)

    def run(batches):
        vocabulary, found = _cached(sent, Vocabulary), defaultdict(Uses)
        for batch in _gathered(batches):
            texts, times = batch.column("word"), batch.column("n").to_numpy().astype(float)
            z = batch.column("z").to_numpy() if pairs else np.zeros(len(texts), np.int32)
            for k in np.unique(z).tolist():
                own = np.flatnonzero(z == k)
                some = texts.take(pa.array(own))
                if pairs:
                    vocabulary.expected_pairs(some, times[own], found[k])
                else:
                    found[k].add(np.arange(vocabulary.size + 1), vocabulary.expected(some, times[own]))
        for k, sums in found.items():
            keys, uses = sums.total()
            kept = np.flatnonzero(uses)
            for at in range(0, len(kept), 20_000):
                own = kept[at : at + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), k, np.int32)), pa.array(keys[own]), pa.array(uses[own])], names=["z", "key", "n"])
        del found
        give_back()

    return words.mapInArrow(run, "z int, key long, n double").groupBy("z", "key").agg(F.sum("n").alias("n"))


def _arrays(got: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    got = got.toPandas().sort_values(["z", "key"])
    return got["z"].to_numpy(np.int64), got["key"].to_numpy(np.int64), got["n"].to_numpy(np.float64)


def _pairs(got: DataFrame, classes: int, pieces: int):
    """The pairs that every task holds (classes, keys, uses), and if these are not all: all uses after each piece by class, and
    the table of the other pairs (``key``, ``uses`` by class), written.

    What a task holds are the pairs that begin or end a word, bounded by the vocabulary, and about ``PAIRS`` of most uses.
    """
    got = staged(got, "pairs")
    if (count := got.count()) <= PAIRS:
        return *_arrays(got), None, None
    of_class = [F.sum(F.when(F.col("z") == z, F.col("n")).otherwise(0.0)) for z in range(classes)]
    by = staged(got.groupBy("key").agg(F.sum("n").alias("n"), F.array(*of_class).alias("uses")), "pairs-by-key")
    edge = by.agg(F.percentile_approx("n", 1 - PAIRS / count, 100_000)).first()[0]
    held = (F.col("n") > edge) | (F.shiftright("key", 20) == BEGIN) | (F.col("key") % (1 << 20) == FINISH)
    z, keys, uses = _arrays(by.where(held).select("key", F.posexplode("uses").alias("z", "n")).where("n > 0"))
    after, following = got.where(F.shiftright("key", 20) != BEGIN), np.zeros((classes, pieces + 1))
    for r in after.groupBy("z", F.shiftright("key", 20).alias("a")).agg(F.sum("n").alias("n")).toLocalIterator():  # a row for a piece and class
        following[r["z"], r["a"]] = r["n"]
    return z, keys, uses, following, by.where(~held).select("key", "uses")


def reweigh(pieces: dict[str, float], words: DataFrame) -> dict[str, float]:
    """The pieces' log weights after one pass over ``words`` (``word``, ``n``)."""
    names = Vocabulary(pieces).pieces
    _, keys, uses = _arrays(_uses(words, pieces, False))
    counts = {names[k]: n for k, n in zip(keys.tolist(), uses.tolist(), strict=True) if k < len(names)}
    total = sum(counts.values()) + PRIOR
    return {p: float(np.log((counts.get(p, 0.0) + PRIOR * np.exp(w)) / total)) for p, w in pieces.items()}


def fit(words: DataFrame, pieces: dict[str, float], sizes: list[tuple[int, int]]) -> tuple[tuple, DataFrame | None]:
    """The arguments of a ``Model`` from training words (``word``, ``z``, ``n``) and each class's number of words and texts.

    With them come the pairs that the model doesn't hold, if there are any (``_pairs``).
    """
    every, existing = staged(words.groupBy("word").agg(F.sum("n").alias("n")), "training-words"), pieces
    for _ in range(PASSES):
        pieces = reweigh(pieces, every)
    *held, following, rest = _pairs(_uses(words, pieces, True), len(sizes), len(Vocabulary(pieces).pieces))
    return (pieces, *held, [w for w, _ in sizes], [t for _, t in sizes], existing, following), rest


def _filter(rest: DataFrame) -> np.ndarray | None:
    """Bits (``_bit``) that tell which pairs may be in ``rest``; None where they are so many that most would be told to be."""
    count = rest.count()
    bits = min(FILTER_BITS, 1 << max(10, (FILTER_PLACES * count - 1).bit_length()))
    if count > bits // 2:
        return None

    def places(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_bit(batch.column(0).to_numpy(), bits))], names=["p"])

    own = rest.select("key").mapInArrow(places, "p long").groupBy(F.shiftright("p", 6).alias("w"))
    words, out = own.agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 AS int)))").alias("b")).toPandas(), np.zeros(bits // 64, np.uint64)
    out[words["w"].to_numpy()] = words["b"].to_numpy(np.int64).view(np.uint64)
    return out


def _weighed_by_join(words: DataFrame, rest: DataFrame, sent, logs) -> DataFrame:
    """``words`` (``word``, ``c``) with ``logs``, in groups of words that get the pairs of ``rest`` that their lattices have."""
    about = words.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0))).first()
    groups = max(1, -(-about[0] // JOINED), -(-about[1] // JOINED_BYTES))
    words = words.withColumn("g", F.pmod(F.xxhash64("word"), F.lit(groups)))
    may = _sent(words.sparkSession, _filter(rest))

    def needed(group: pa.Table) -> pa.Table:
        keys = _cached(sent, lambda x: Model(*x)).unheld(group["word"].combine_chunks(), may.value[1])
        return pa.table([pa.array(np.full(len(keys), group["g"][0].as_py(), np.int64)), pa.array(keys)], names=["g", "key"])

    def weigh(group: pa.Table, pairs: pa.Table) -> pa.Table:
        model, pairs = _cached(sent, lambda x: Model(*x)), pairs.sort_by("key")
        more = None
        if pairs.num_rows:
            uses = pairs["uses"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(pairs.num_rows, -1).T
            more = model.weighed(pairs["key"].to_numpy(), uses)
        batches = group.select(["word", "c"]).to_batches()
        return pa.Table.from_batches([logs(model, batch, more) for batch in _gathered(batches)]) if batches else pa.table([[], [], []], names=["word", "c", "logs"])

    own = words.groupBy("g").applyInArrow(needed, "g long, key long").join(rest, "key")
    return words.groupBy("g").cogroup(own.groupBy("g")).applyInArrow(weigh, "word string, c long, logs array<float>")


def _words(column) -> tuple[pa.Array, np.ndarray]:
    """All words of a column of texts, one after the other, and each text's number of them."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(column))
    flat, lens = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False)
    there = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)  # white space at an end leaves an empty word
    if there.all():
        return flat, lens.astype(np.int64)
    return flat.filter(pa.array(there)), np.bincount(np.repeat(np.arange(len(lens)), lens)[there], minlength=len(lens))


def _summed(tables: list[pa.Table]):
    """The tables' rows, summed by word and class."""
    both = pa.concat_tables(tables).group_by(["word", "z"]).aggregate([("n", "sum")]).rename_columns(["word", "z", "n"])
    yield from both.to_batches(max_chunksize=50_000)


def score(docs: DataFrame, pieces: dict[str, float], held_out, of_class: Column | None = None) -> DataFrame:
    """Scores of every row of ``docs``; ``held_out`` is the column that keeps a row from training.

    ``of_class`` tells a training row's class; without it there is one. Columns: ``doc_id``, ``held_out``, ``n_tokens``,
    ``n_known``, ``train_tokens``, ``base_score``, ``score``, ``unigram_score``.
    """
    kind = F.lit("") if of_class is None else F.coalesce(of_class.cast("string"), F.lit(""))
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), held_out.alias("held_out"), kind.alias("kind"))
    about = rows.groupBy("kind").agg(F.count_if(~F.col("held_out")).alias("texts"), F.sum(F.octet_length("text")).alias("bytes")).orderBy(F.col("texts").desc(), "kind")
    heads = about.limit(CLASSES + 1).collect()
    total_bytes, ends = about.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("texts"), F.lit(0))).first()
    names = [r["kind"] for r in heads[:CLASSES] if r["texts"]]
    # The classes' numbers; kinds beyond them are one more class.
    classes = max(1, len(names) + (len(heads) > CLASSES))
    z = F.coalesce(*[F.when(F.col("kind") == n, i) for i, n in enumerate(names)], F.lit(classes - 1))
    rows = rows.withColumn("z", F.when(F.col("held_out"), -1).otherwise(z).cast("int")).drop("kind")
    groups = max(1, -(-total_bytes // GROUP_BYTES))

    def count(batches):
        """Words with their class and number; those of rows that don't train with class -1 and number 0."""
        held, size = [], 0
        for batch in batches:
            z = batch.column(1).to_numpy()
            for k in np.unique(z).tolist():
                found = _words(batch.column(0).filter(pa.array(z == k)))[0].value_counts()
                n = found.field("counts") if k >= 0 else pa.array(np.zeros(len(found), np.int64))
                held.append(pa.table([found.field("values"), pa.array(np.full(len(found), k, np.int32)), n], names=["word", "z", "n"]))
                size += len(found)
            if size > COUNTED:
                yield from _summed(held)
                held, size = [], 0
        if held:
            yield from _summed(held)
        del held
        give_back()

    spark, since = docs.sparkSession, staged_so_far()
    counts = staged(rows.select("text", "z").mapInArrow(count, "word string, z int, n long").groupBy("word", "z").agg(F.sum("n").alias("n")), "counts")
    sizes = {r["z"]: r["n"] for r in counts.groupBy("z").agg(F.sum("n").alias("n")).collect()}
    texts = {r["z"]: r["n"] for r in rows.groupBy("z").agg(F.count("*").alias("n")).collect()}
    model, rest = fit(counts.where("n > 0"), pieces, [(sizes.get(k, 0), texts.get(k, 0)) for k in range(classes)])
    sent = _sent(docs.sparkSession, model)

    def logs(made, batch, more=None):
        found = np.column_stack(made.both_scores(batch.column("word"), more)).astype(np.float32)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), classes + 1).cast(pa.list_(pa.float32()))
        return pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "logs"])

    def weigh(batches):
        made = _cached(sent, lambda x: Model(*x))
        yield from (logs(made, batch) for batch in _gathered(batches))
        give_back()

    words_ = counts.groupBy("word").agg(F.sum("n").alias("c"))
    weighed = words_.mapInArrow(weigh, "word string, c long, logs array<float>") if rest is None else _weighed_by_join(words_, rest, sent, logs)
    vocabulary = staged(weighed, "vocabulary")
    drop_staged(spark, since, but=1)  # only the vocabulary is read from here on
    seen, distinct = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    total, kinds = seen + ends, distinct + (ends > 0)
    base = lambda c: np.log10((c + SMOOTH) / (total + SMOOTH * (kinds + 1)))
    end = float(base(ends))
    prior, (ends_, _) = priors(*model[4:6])
    prior = prior + ends_
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, unigram_score double"
    worded = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    texts_ = rows.where(worded).withColumn("g", F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(groups))).select("g", "doc_id", "text", "held_out")
    none = rows.where(~worded).select("doc_id", "held_out", F.lit(1).cast("long").alias("n_tokens"), F.lit(int(ends > 0)).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), F.lit(end).alias("base_score"), F.lit(float(np.logaddexp.reduce(prior) / LOG10)).alias("score"), F.lit(0.0).alias("unigram_score"))

    def distinct_words(table: pa.Table) -> pa.Table:
        worker_cache("lattice_lm texts")  # the model is of no more use
        parts = [_words(batch.column("text"))[0].unique() for batch in table.to_batches(max_chunksize=STEP_DOCS)]
        every = pa.chunked_array(parts).unique()
        return pa.table([pa.array(np.full(len(every), table["g"][0].as_py(), np.int64)), every], names=["g", "word"])

    def sums(texts: pa.Table, own: pa.Table) -> pa.Table:
        worker_cache("lattice_lm texts")
        c, logs = own["c"].to_numpy(), np.empty((0, classes + 1))
        if own.num_rows:
            logs = own["logs"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, classes + 1).astype(np.float64)
        plain, known = base(c), (c > 0).astype(float)
        known_words, out = own["word"].combine_chunks(), []
        for batch in texts.to_batches(max_chunksize=STEP_DOCS):
            words, lens = _words(batch.column("text"))
            at = pc.index_in(words, value_set=known_words)
            if at.null_count:
                raise RuntimeError("a group's words are not those of its texts")
            at, owner = at.to_numpy(), np.repeat(np.arange(len(lens)), lens)
            add = lambda x, at=at, owner=owner, n=len(lens): np.bincount(owner, x[at], n)
            whole = np.logaddexp.reduce([add(logs[:, k]) + prior[k] for k in range(classes)], axis=0)
            columns = [
                batch.column("doc_id"), batch.column("held_out"), pa.array(lens + 1), pa.array(add(known).astype(np.int64) + (ends > 0)),
                pa.array(np.full(len(lens), total, np.int64)), pa.array(add(plain) + end), pa.array(whole / LOG10), pa.array(add(logs[:, classes]) / LOG10),
            ]
            out.append(pa.table(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "unigram_score"]))
        give_back()
        return pa.concat_tables(out)

    # Both uses of the texts read the same exchange.
    own, parts = texts_.groupBy("g").applyInArrow(distinct_words, "g long, word string"), 1 + groups // SERVES
    if parts == 1:
        own = own.join(vocabulary, "word")
    else:  # a frequent word stands in about every group
        frequent = vocabulary.where(F.col("c") > FREQUENT * seen).select("word", F.lit(True).alias("often"))
        own = own.join(F.broadcast(frequent), "word", "left")  # under 1 / FREQUENT words
        own = own.withColumn("part", F.when(F.col("often"), F.pmod("g", F.lit(parts))).otherwise(0).cast("int"))
        each = F.explode(F.when(F.col("c") > FREQUENT * seen, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0))))
        own = own.join(vocabulary.withColumn("part", each), ["word", "part"])
    own = own.select("g", "word", "c", "logs")
    return texts_.groupBy("g").cogroup(own.groupBy("g")).applyInArrow(sums, schema).unionByName(none)
