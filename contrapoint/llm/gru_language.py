"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's bytes both ways and labels every position; a document's probabilities are the mean over its
positions. Gates are hard sigmoids, which clip, and the candidate is a hyperbolic tangent. ``fit`` trains in numpy by
backpropagation through time (Adam) on the whole texts of a bounded sample of labelled rows (at most ``SAMPLE`` rows, the
least hashes of the ids, and ``SAMPLE_BYTES`` bytes), cut into windows. ``predict`` reads every byte of every text, also
in windows, so that a long text's positions are worked on side by side; each way the states of ``CONTEXT`` bytes before a
window are carried into it, so no position but those at a text's ends has less context than that.

Texts that are null or hold no letter are ``und`` with score 0; so are all if nothing was learned. Rows without a label
do not train. Repeated rows are predicted alike. An empty table gives an empty one.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, small_batches, worker_cache

#: Labelled rows that train at most, bytes of their texts at most, windows of a step, step size, states each way.
SAMPLE, SAMPLE_BYTES, STEP, RATE, STATES = 1500, 8_000_000, 128, 0.01, 8
#: Steps at least, so that few rows are passed more often.
LEAST_STEPS = 300
#: Bytes of a window when training and when predicting, bytes read before it, windows predicted together.
TRAIN_BYTES, BYTES, CONTEXT, TOGETHER = 48, 256, 64, 1536


def _init(languages: int, seed: int = 3) -> dict[str, np.ndarray]:
    rng, h = np.random.default_rng(seed), STATES
    p = {}
    for way in "fb":
        p["x" + way] = rng.normal(0, 0.3, (3 * h, 256))
        p["x" + way][: 2 * h] += 0.5
        p["u" + way] = rng.normal(0, 0.3, (3 * h, h))
    p["w"], p["c"] = rng.normal(0, 0.3, (languages, 2 * h)), np.zeros((languages, 1))
    return {k: v.astype(np.float32) for k, v in p.items()}


def _forward(x, u, seq, mask):
    """States at every position of the windows ``seq`` (positions x windows), and what going back needs."""
    h, n = STATES, seq.shape[1]
    state, kept = np.zeros((h, n), np.float32), []
    for t in range(len(seq)):
        a, b = x[:, seq[t]], u @ state
        z, r = np.clip(a[:h] + b[:h], 0, 1), np.clip(a[h : 2 * h] + b[h : 2 * h], 0, 1)
        c = np.tanh(a[2 * h :] + r * b[2 * h :])
        new = (c + z * (state - c)) * mask[t]
        kept.append((state, z, r, c, b[2 * h :]))
        state = new
        kept[-1] += (new,)
    return kept


def _backward(x, u, seq, mask, kept, grads):
    """Gradients of the byte table and the recurrent weights from those of every state."""
    h = STATES
    du, da_all, carry = np.zeros_like(u), [], np.zeros_like(grads[0])
    for t in range(len(seq) - 1, -1, -1):
        state, z, r, c, bn, _ = kept[t]
        g = (grads[t] + carry) * mask[t]
        dc = g * (1 - z) * (1 - c * c)
        dz = g * (state - c) * ((z > 0) & (z < 1))
        dr = dc * bn * ((r > 0) & (r < 1))
        db = np.concatenate([dz, dr, dc * r])
        da_all.append(np.concatenate([dz, dr, dc]))
        du += db @ state.T
        carry = g * z + u.T @ db
    dx = np.zeros((256, 3 * h), np.float32)
    np.add.at(dx, seq[::-1].ravel(), np.stack(da_all).transpose(0, 2, 1).reshape(-1, 3 * h))
    return dx.T, du


def train(windows: np.ndarray, lengths: np.ndarray, labels: np.ndarray, languages: int, seed: int = 3) -> dict[str, np.ndarray]:
    """The parameters learned from windows (rows of bytes, of these lengths) that carry these labels."""
    p, rng = _init(languages, seed), np.random.default_rng(seed)
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    for _ in range(max(1, -(-LEAST_STEPS * STEP // len(windows)))):
        order = rng.permutation(len(windows))
        for i in range(0, len(order), STEP):
            own = order[i : i + STEP]
            seq, mask = windows[own].T, (np.arange(windows.shape[1])[:, None] < lengths[own]).astype(np.float32)
            kf, kb = _forward(p["xf"], p["uf"], seq, mask), _forward(p["xb"], p["ub"], seq[::-1], mask[::-1])
            hs = [np.concatenate([kf[t][5], kb[len(seq) - 1 - t][5]]) for t in range(len(seq))]
            g, gf, gb, total = {"w": 0, "c": 0}, [], [], mask.sum()
            for t, hid in enumerate(hs):
                z = p["w"] @ hid + p["c"]
                e = np.exp(z - z.max(0))
                e /= e.sum(0)
                e[labels[own], np.arange(len(own))] -= 1
                e *= mask[t] / total
                g["w"] += e @ hid.T
                g["c"] += e.sum(1, keepdims=True)
                back = p["w"].T @ e
                gf.append(back[:STATES])
                gb.append(back[STATES:])
            g["xf"], g["uf"] = _backward(p["xf"], p["uf"], seq, mask, kf, gf)
            g["xb"], g["ub"] = _backward(p["xb"], p["ub"], seq[::-1], mask[::-1], kb, gb[::-1])
            step += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                p[k] = (p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return p


def _states(x, u, seq, partial):
    """States at every position; ``partial`` masks the windows that are not full."""
    h, n = STATES, seq.shape[1]
    out, state = np.empty((len(seq), h, n), np.float32), np.zeros((h, n), np.float32)
    a, b, c, part = (np.empty((k * h, n), np.float32) for k in (3, 3, 1, 1))
    for t in range(len(seq)):
        np.take(x, seq[t], axis=1, out=a, mode="clip")
        np.matmul(u, state, out=b)
        gates = a[: 2 * h]
        gates += b[: 2 * h]
        np.clip(gates, 0, 1, out=gates)
        np.multiply(a[h : 2 * h], b[2 * h :], out=c)
        c += a[2 * h :]
        np.tanh(c, out=c)
        np.subtract(state, c, out=part)
        part *= a[:h]
        state = out[t]
        np.add(c, part, out=state)
        if partial is not None:
            state *= partial[t]
    return out


def position_sums(p: dict[str, np.ndarray], raw: np.ndarray, at: np.ndarray, size: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For each window the sum of its positions' language probabilities.

    Window i is the bytes of ``raw`` from ``at[i]``, ``size[i]`` of them, of the text from ``first[i]`` to ``last[i]``.
    ``raw`` has ``CONTEXT`` + ``BYTES`` more bytes at both ends.
    """
    width = int(size.max())
    steps = np.arange(CONTEXT + width)[:, None]
    states = []
    for way, place in (("f", at - CONTEXT + steps), ("b", at + (width + CONTEXT - 1) - steps)):
        inside = (place >= first) & (place < last)
        states.append(_states(p["x" + way], p["u" + way], raw[place], None if inside.all() else inside.astype(np.float32)))
    f, b = states
    mask = None if (size == width).all() else (steps[:width] < size).astype(np.float32)
    total, wf, wb = np.zeros((len(p["w"]), len(at)), np.float32), np.ascontiguousarray(p["w"][:, :STATES]), np.ascontiguousarray(p["w"][:, STATES:])
    for t in range(width):
        z = wf @ f[CONTEXT + t]
        z += wb @ b[width + CONTEXT - 1 - t]
        z += p["c"]
        np.minimum(z, 60, out=z)
        np.exp(z, out=z)
        z /= z.sum(0)
        if mask is not None:
            z *= mask[t]
        total += z
    return total.T


def text_sums(p: dict[str, np.ndarray], texts: list[bytes]) -> np.ndarray:
    """For each text the sum of its positions' language probabilities."""
    lens, pad = np.fromiter(map(len, texts), np.int64, len(texts)), bytes(CONTEXT + BYTES)
    raw = np.frombuffer(b"".join([pad, *texts, pad]), np.uint8)
    number = -(-lens // BYTES)
    owner = np.repeat(np.arange(len(texts)), number)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
    last = (np.cumsum(lens) + len(pad))[owner]
    first = last - lens[owner]
    at = first + nth * BYTES
    size = np.minimum(BYTES, last - at)
    sums, order = np.zeros((len(texts), len(p["w"]))), np.lexsort((nth == 0, -size))
    for s in range(0, len(order), TOGETHER):
        now = order[s : s + TOGETHER]
        np.add.at(sums, owner[now], position_sums(p, raw, at[now], size[now], first[now], last[now]))
    return sums


def fit(docs: DataFrame, train_rows) -> tuple[list[str], dict[str, np.ndarray]]:
    """Languages and parameters from the whole texts of a bounded sample of the rows with a language.

    Only rows for whose id ``train_rows`` holds train; those without id or text don't.
    """
    own = docs.select(
        F.col("doc_id").alias("id"), F.col("lang").alias("label"), "text"
    ).where("label IS NOT NULL AND text IS NOT NULL AND id IS NOT NULL").where(train_rows(F.col("id")))
    rows = labelled_sample(own, SAMPLE, SAMPLE_BYTES)
    names = sorted({r.label for r in rows})
    texts = [np.frombuffer(r.text.encode(), np.uint8) for r in rows]
    number = np.array([-(-len(t) // TRAIN_BYTES) for t in texts], np.int64)
    if not number.sum():
        return [], {}
    windows = np.concatenate([np.pad(t, (0, n * TRAIN_BYTES - len(t))) for t, n in zip(texts, number.tolist(), strict=True)]).reshape(-1, TRAIN_BYTES)
    lengths = np.full(len(windows), TRAIN_BYTES)
    full = number > 0
    lengths[np.cumsum(number)[full] - 1] = [len(t) - (n - 1) * TRAIN_BYTES for t, n in zip(texts, number.tolist(), strict=True) if n]
    labels = np.repeat([names.index(r.label) for r in rows], number)
    return names, train(windows, lengths, labels, len(names))


def predict(docs: DataFrame, model, lang: str = "lang_pred", out: str = "score") -> DataFrame:
    """``docs`` with ``lang`` and ``out``, the mean probability of that language; only the text goes to Python.

    The two replace columns of their names.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def some(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        names, p = sent.value
        best, chance = np.full(len(texts), "und", object), np.zeros(len(texts))
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        if names and (there := lens > 0).any():
            probs = text_sums(p, texts) / np.maximum(lens, 1)[:, None]
            top = probs.argmax(1)
            best[there] = np.array(names, object)[top[there]]
            chance[there] = np.clip(probs[np.arange(len(texts)), top], 0, 1)[there]
        return best, chance

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        worker_cache("gru_language")
        for texts, letters in batches:
            parts = []
            for at in range(0, len(texts), 400):
                own = zip(pc.cast(texts.slice(at, 400), pa.binary()).to_pylist(), letters.slice(at, 400).to_pylist(), strict=True)
                parts.append(some([t if ok else b"" for t, ok in own]))
            best, chance = (np.concatenate([*x, []]) for x in zip(*parts, strict=True)) if parts else ([], [])
            yield pa.StructArray.from_arrays([pa.array(best, pa.string()), pa.array(chance, pa.float64())], names=["lang", "score"])

    # Called non-deterministic so that a filter on the result does not run it twice.
    udf = F.arrow_udf(run, "lang string, score double").asNondeterministic()
    found = udf(F.coalesce("text", F.lit("")), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    rows = small_batches(docs).withColumn("_language", found)
    return rows.withColumn(lang, F.col("_language.lang")).withColumn(out, F.col("_language.score")).drop("_language")
