"""Language of texts by a bidirectional gated recurrent network over bytes, in numpy.

A text is read in windows of ``WINDOW`` bytes. In each, one gated recurrent
unit runs forwards and one backwards; at every position their two states give
a distribution over the languages, and a document's probabilities are the mean
over all its positions. The network is trained by backpropagation through time
on a bounded sample of labelled texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltascope.llm.common import named

WINDOW = 256
HIDDEN = 8
#: Labelled texts of each language taken for training, and characters of each; the documented bound of the sample.
TRAIN_TEXTS, TRAIN_CHARS = 300, 1024
#: Spans into which the characters are dealt in a longer text.
TRAIN_SPANS = 4
OVERDRAW = 2
STEPS, BATCH, SPAN, RATE = 260, 128, 48, 0.02
#: Windows that run through the network together.
LANES = 4096
UNKNOWN = "und"


@dataclass
class Network:
    """Weights of the two directions: input (256, 3h), state (h, 3h), bias of the candidate's state; output (2h, L)."""
    languages: list[str]
    inputs: list[np.ndarray]
    states: list[np.ndarray]
    biases: list[np.ndarray]
    output: np.ndarray
    shift: np.ndarray


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _direction(x: np.ndarray, w: np.ndarray, u: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    """States (T, B, h) for input bytes (T, B), with what backpropagation needs."""
    steps, lanes = x.shape
    h = np.zeros((lanes, u.shape[0]), dtype=np.float32)
    n, out, kept = u.shape[0], np.empty((steps, lanes, u.shape[0]), dtype=np.float32), []
    for t in range(steps):
        a, g = w[x[t]], h @ u
        gates = sigmoid(a[:, :2 * n] + g[:, :2 * n])
        z, r = gates[:, :n], gates[:, n:]
        s = g[:, 2 * n:] + c
        new = np.tanh(a[:, 2 * n:] + r * s)
        kept.append((h, z, r, s, new))
        h = new + z * (h - new)
        out[t] = h
    return out, kept


def _direction_back(x: np.ndarray, u: np.ndarray, kept: list[tuple], d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of input weights, state weights and bias, through all steps."""
    n = u.shape[0]
    dw, du, dc = np.zeros((256, 3 * n), dtype=np.float32), np.zeros_like(u), np.zeros(n, dtype=np.float32)
    dh = np.zeros_like(d_out[0])
    for t in range(len(x) - 1, -1, -1):
        h, z, r, s, new = kept[t]
        dh = dh + d_out[t]
        d_new = dh * (1 - z) * (1 - new * new)
        dz = dh * (h - new) * z * (1 - z)
        dr = d_new * s * r * (1 - r)
        ds = d_new * r
        np.add.at(dw, x[t], np.concatenate([dz, dr, d_new], axis=1))
        dg = np.concatenate([dz, dr, ds], axis=1)
        du += h.T @ dg
        dc += ds.sum(axis=0)
        dh = dh * z + dg @ u.T
    return dw, du, dc


def train(texts: list[bytes], labels: list[int], languages: list[str], seed: int = 3) -> Network:
    """Fit the network with Adam on random spans; every position of a span is labelled with its text's language."""
    rng = np.random.default_rng(seed)
    n, k = HIDDEN, len(languages)
    parts = [(rng.normal(0, 0.1, (256, 3 * n)), rng.normal(0, 0.3, (n, 3 * n)), np.zeros(n)) for _ in range(2)]
    weights = [w.astype(np.float32) for p in parts for w in p]
    weights += [rng.normal(0, 0.3, (2 * n, k)).astype(np.float32), np.zeros(k, dtype=np.float32)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    usable = [i for i, t in enumerate(texts) if t]
    by_label = [[i for i in usable if labels[i] == j] for j in range(k)]
    by_label = [x for x in by_label if x]
    steps = STEPS * -(-len(by_label) // BATCH)
    for step in range(1, steps + 1):
        x, y = np.full((SPAN, BATCH), 32, dtype=np.uint8), np.empty(BATCH, dtype=np.int64)
        for b in range(BATCH):
            group = by_label[((step - 1) * BATCH + b) % len(by_label)]  # all labels in turn, however many
            i = group[int(rng.integers(len(group)))]
            at = int(rng.integers(max(1, len(texts[i]) - SPAN + 1)))
            piece = np.frombuffer(texts[i][at:at + SPAN], dtype=np.uint8)
            x[:len(piece), b], y[b] = piece, labels[i]
        ahead, kept_a = _direction(x, *weights[0:3])
        back, kept_b = _direction(x[::-1], *weights[3:6])
        both = np.concatenate([ahead, back[::-1]], axis=2)
        logits = both @ weights[6] + weights[7]
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        p[:, np.arange(BATCH), y] -= 1
        p /= SPAN * BATCH
        d_both = p @ weights[6].T
        grads = [*_direction_back(x, weights[1], kept_a, d_both[:, :, :n]),
                 *_direction_back(x[::-1], weights[4], kept_b, d_both[::-1, :, n:]),
                 np.tensordot(both, p, axes=([0, 1], [0, 1])), p.sum(axis=(0, 1))]
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for w, g, m, v in zip(weights, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return Network(languages, [weights[0], weights[3]], [weights[1], weights[4]], [weights[2], weights[5]], weights[6], weights[7])


def _logits(net: Network, x: np.ndarray, sizes: np.ndarray, way: int) -> np.ndarray:
    """One direction's share of the logits, (T, L, B), for windows (T, B) of the given sizes.

    Lanes are the last axis. Backwards, a lane's state stays zero until its
    last byte is reached, so a short window gives what it would alone.
    """
    steps, lanes = x.shape
    n, k = HIDDEN, len(net.languages)
    w, u, c = net.inputs[way], net.states[way].T.copy(), net.biases[way][:, None]
    o = net.output[way * n:(way + 1) * n].T.copy()
    # gates as tanh of half the sum: fold the halves into the weights
    scale = np.concatenate([np.full(2 * n, 0.5), np.ones(n)]).astype(np.float32)
    wt, u = (w * scale).T.copy(), u * scale[:, None]
    h = np.zeros((n, lanes), dtype=np.float32)
    out = np.empty((steps, k, lanes), dtype=np.float32)
    a, g = np.empty((3 * n, lanes), dtype=np.float32), np.empty((3 * n, lanes), dtype=np.float32)
    least = int(sizes.min()) if lanes else 0
    for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
        np.take(wt, x[t], axis=1, out=a, mode="clip")
        np.matmul(u, h, out=g)
        gates = a[:2 * n]
        gates += g[:2 * n]
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        s = g[2 * n:]
        s += c
        s *= gates[n:]
        s += a[2 * n:]
        np.tanh(s, out=s)
        h -= s
        h *= gates[:n]
        h += s
        if way == 1 and t >= least:
            h *= sizes > t
        np.matmul(o, h, out=out[t])
    return out


def position_probabilities(net: Network, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum over the positions of each window of the distribution over languages, (windows, L)."""
    sums = np.empty((len(starts), len(net.languages)))
    order = np.argsort(-sizes, kind="stable")
    for a in range(0, len(order), LANES):
        some = order[a:a + LANES]
        steps = int(sizes[some[0]])
        at = starts[some][None, :] + np.arange(steps)[:, None]
        x = data[np.minimum(at, len(data) - 1)]
        logits = _logits(net, x, sizes[some], 0)
        logits += _logits(net, x, sizes[some], 1)
        logits += net.shift[None, :, None].astype(np.float32)
        np.clip(logits, -60, 60, out=logits)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        logits *= (np.arange(steps)[:, None] < sizes[some][None, :])[:, None, :]
        sums[some] = logits.sum(axis=0, dtype=np.float64).T
    return sums


def predict(net: Network, texts: list[bytes]) -> np.ndarray:
    """Probabilities of the languages for each text, (texts, L); an empty text gets zeros."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    count = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(texts)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    starts = (np.cumsum(sizes) - sizes)[owner] + nth * WINDOW
    lengths = np.minimum(sizes[owner] - nth * WINDOW, WINDOW)
    out = np.zeros((len(texts), len(net.languages)))
    if len(owner):
        np.add.at(out, owner, position_probabilities(net, data, starts, lengths))
    return out / np.maximum(sizes, 1)[:, None]


def held_out(id_column: str = "doc_id"):
    """crc32 of the id as text, modulo 3, is 1; a NULL id is not held out."""
    return F.coalesce(F.crc32(named(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame, id_column: str, text_column: str, lang_column: str) -> tuple[list[bytes], list[str]]:
    """Spans of at most ``TRAIN_TEXTS`` texts of each language, ``TRAIN_CHARS`` characters each.

    They are those whose ids have the smallest hashes. A longer text gives
    ``TRAIN_SPANS`` spans, one from each equal part of it, whose starts are
    drawn by a hash of the id, so that a common beginning is not all of it. The languages are
    counted first; then about ``OVERDRAW`` times as many texts as wanted are
    drawn by a bound on the hash, whatever the number of tasks.
    """
    text, width = named(text_column), TRAIN_CHARS // TRAIN_SPANS
    room = F.length(text) - width  # last start, from 0

    def span(i: int) -> Column:
        draw = F.pmod(F.xxhash64(F.lit(11 + i), named(id_column)), F.lit(2**30)) / F.lit(2.0**30)
        return F.substring(text, F.floor((F.lit(i) + draw) * (room + 1) / TRAIN_SPANS).cast("int") + 1, F.lit(width))

    spans = F.when(F.length(text) <= TRAIN_CHARS, F.array(text)).otherwise(F.array(*[span(i) for i in range(TRAIN_SPANS)]))
    rows = docs.filter(~held_out(id_column) & named(lang_column).isNotNull() & text.rlike(r"\p{L}")).select(
        named(lang_column).alias("lang"), F.xxhash64(F.lit(5), named(id_column)).alias("rank"), spans.alias("spans"))
    drawn = F.lit(False)
    for lang, n in rows.groupBy("lang").count().collect():
        share = min(1.0, OVERDRAW * TRAIN_TEXTS / n)
        drawn = drawn | ((F.col("lang") == lang) & (F.col("rank") <= min(int(share * 2**64) - 2**63, 2**63 - 1)))
    texts, labels, taken = [], [], {}
    for r in sorted(rows.filter(drawn).collect(), key=lambda r: (r["lang"], r["rank"], r["spans"])):
        taken[r["lang"]] = taken.get(r["lang"], 0) + 1
        if taken[r["lang"]] <= TRAIN_TEXTS:
            for part in r["spans"]:
                texts.append(part.encode())
                labels.append(r["lang"])
    return texts, labels


#: Bytes that run through the network together.
SLICE_BYTES = 4_000_000


def identify(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of each document, one row for each input row.

    The language is learned from the texts and labels of the documents not
    held out. A prediction uses nothing but the text. A text that is NULL or
    has no letter, and any text if nothing could be learned, gets ``und`` with
    score 0. Equal texts get equal results. Other columns are left out.
    """
    texts, labels = training_sample(docs, id_column, text_column, lang_column)
    languages = sorted(set(labels))
    net = train(texts, [languages.index(x) for x in labels], languages)
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value

        def flush(part: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
            some = np.array([bool(t) for t in texts])
            if not own.languages:
                langs, none = [UNKNOWN] * len(texts), np.zeros(len(texts))
                return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(none)],
                                                  names=["doc_id", "held_out", "lang_pred", "score"])
            p = predict(own, texts)
            best = p.argmax(axis=1)
            langs = [own.languages[b] if s else UNKNOWN for b, s in zip(best, some)]
            score = np.where(some, np.minimum(p.max(axis=1), 1.0), 0.0)
            return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(score)],
                                              names=["doc_id", "held_out", "lang_pred", "score"])

        for batch in batches:
            texts, size, first = [], 0, 0
            for i, t in enumerate(batch.column(2)):
                texts.append((t.as_py() or "").encode())
                size += len(texts[-1])
                if size > SLICE_BYTES:
                    yield flush(batch.slice(first, i + 1 - first), texts)
                    texts, size, first = [], 0, i + 1
            if texts:
                yield flush(batch.slice(first), texts)

    usable = F.when(named(text_column).rlike(r"\p{L}"), named(text_column)) if languages else F.lit(None).cast("string")
    rows = docs.select(named(id_column).alias("doc_id"), held_out(id_column).alias("held_out"), usable.alias("text"))
    kind = docs.schema[id_column].dataType.simpleString()
    return rows.mapInArrow(label, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
