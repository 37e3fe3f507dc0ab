"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text is its words (runs of letters, lower-cased) in overlapping windows. A word's input joins a hashed word vector and
the mean of the hashed vectors of its character trigrams. Two gated recurrent layers read each window forward and
backward, attention pools their states, and a logistic unit scores the window. A document is as toxic as its worst
window. Training has only document labels: each step learns from every document's highest window.

The network is fitted on a bounded sample of labelled rows (SAMPLE); every window of every text is scored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, flat, held_out, map_arrow, mix64, span_hashes, utf8, word_spans

#: Labelled rows to learn from: at most so many of label 1 and of label 0, none longer than so many bytes.
SAMPLE = {1: 1200, 0: 2000}
SAMPLE_BYTES = 20_000
WINDOW, STRIDE = 48, 32
WORDS, TRIGRAMS = 1 << 14, 1 << 11
WORD_DIM, CHAR_DIM, HIDDEN, ATTEND = 8, 8, 8, 8
#: The rate falls to nothing in a straight line.
EPOCHS, BATCH, RATE = 10, 50, 0.02
THRESHOLD = 0.3

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


class Words:
    """The words of a flat batch: `which` gives each word's place among the distinct ones, `first` each row's first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        folded = _FOLD[data]
        starts, ends, self.first = word_spans(folded, offsets)
        hashes, at, self.which = np.unique(span_hashes(folded, starts, ends), return_index=True, return_inverse=True)
        self.ids = (hashes % np.uint64(WORDS)).astype(np.int64)
        s, e = starts[at], ends[at]
        # Trigrams with a space before and behind the word.
        self.sizes = e - s
        where = np.arange(self.sizes.sum()) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes) + np.repeat(s, self.sizes)
        of = np.repeat(np.arange(len(s)), self.sizes)
        mid = folded[where].astype(np.uint64)
        left = np.where(where > s[of], folded[np.maximum(where - 1, 0)], 32).astype(np.uint64)
        right = np.where(where + 1 < e[of], folded[np.minimum(where + 1, max(len(folded) - 1, 0))], 32).astype(np.uint64)
        self.trigrams = (mix64(left << np.uint64(16) | mid << np.uint64(8) | right) % np.uint64(TRIGRAMS)).astype(np.int64)
        self.of = of

    def some(self, pick: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, sizes, trigrams, the place of each trigram's word) of all distinct words, or of some."""
        if pick is None:
            return self.ids, self.sizes, self.trigrams, self.of
        sizes = self.sizes[pick]
        inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        first = np.cumsum(self.sizes) - self.sizes
        return self.ids[pick], sizes, self.trigrams[np.repeat(first[pick], sizes) + inside], np.repeat(np.arange(len(pick)), sizes)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, row) of all windows; a row without words has none."""
        n = np.diff(self.first)
        count = np.where(n > 0, np.maximum(-(-(n - WINDOW) // STRIDE), 0) + 1, 0)
        row = np.repeat(np.arange(len(n)), count)
        start = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
        return self.first[row] + start, np.minimum(n[row] - start, WINDOW), row


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """The parameters, a forward pass over windows and its gradient."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        small = lambda *shape, by=1.0: (rng.standard_normal(shape) * by).astype(np.float32)
        self.p = {"word": small(WORDS, WORD_DIM, by=0.05), "char": small(TRIGRAMS, CHAR_DIM, by=0.1)}
        for way in ("f", "b"):
            self.p |= {f"x{way}": small(d, 3 * h, by=d**-0.5), f"c{way}": np.zeros(3 * h, np.float32), f"u{way}": small(h, 3 * h, by=h**-0.5)}
        self.p |= {"attend": small(2 * h, ATTEND, by=(2 * h) ** -0.5), "choose": small(ATTEND, by=1.0), "out": small(2 * h, by=0.5), "bias": np.zeros(1, np.float32)}
        self.scale, self.shift = 1.0, 0.0

    def inputs(self, w: Words, pick: np.ndarray | None = None) -> np.ndarray:
        """The input vectors of all distinct words, or of some of them."""
        ids, sizes, trigrams, _ = w.some(pick)
        total = np.zeros((len(ids), CHAR_DIM), np.float32)
        if len(trigrams):
            total = np.add.reduceat(self.p["char"][trigrams], np.cumsum(sizes) - sizes, axis=0)
        return np.concatenate([self.p["word"][ids], total / np.maximum(sizes, 1)[:, None].astype(np.float32)], 1)

    def _layer(self, way: str, gates: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: list | None):
        u, h = self.p[f"u{way}"], HIDDEN
        state = np.zeros((len(at), h), gates.dtype)
        states = np.empty((at.shape[1], len(at), h), gates.dtype)
        for t in range(at.shape[1]) if way == "f" else range(at.shape[1] - 1, -1, -1):
            g = gates[at[:, t]]
            zr = _sigmoid(g[:, : 2 * h] + state @ u[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            cand = np.tanh(g[:, 2 * h :] + (r * state) @ u[:, 2 * h :])
            m = mask[:, t, None]
            new = state + m * z * (cand - state)
            if keep is not None:
                keep.append((t, state, z, r, cand))
            states[t] = state = new
        return states

    def forward(self, x: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: dict | None = None, gates: dict | None = None) -> np.ndarray:
        """The logit of each window: at (n, WINDOW) places in x, mask (n, WINDOW) of 0 and 1."""
        gates = gates or self.gates(x)
        kept = {"f": [], "b": []} if keep is not None else {"f": None, "b": None}
        states = np.concatenate([self._layer(w, gates[w], at, mask, kept[w]) for w in "fb"], 2)
        act = np.tanh(states @ self.p["attend"])
        score = act @ self.p["choose"] + np.where(mask.T > 0, 0, -1e9).astype(states.dtype)
        weight = np.exp(score - score.max(0))
        weight /= weight.sum(0)
        pooled = np.einsum("tn,tnd->nd", weight, states)
        if keep is not None:
            keep |= {"kept": kept, "states": states, "act": act, "weight": weight, "pooled": pooled}
        return pooled @ self.p["out"] + self.p["bias"][0]

    def gates(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {w: x @ self.p[f"x{w}"] + self.p[f"c{w}"] for w in "fb"}

    def gradient(self, x: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: dict, dlogit: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of all parameters but the two tables, and that of x."""
        p, h, g = self.p, HIDDEN, {}
        dpooled = dlogit[:, None] * p["out"]
        g["out"], g["bias"] = keep["pooled"].T @ dlogit, np.array([dlogit.sum()], np.float32)
        dweight = np.einsum("nd,tnd->tn", dpooled, keep["states"])
        dstates = keep["weight"][:, :, None] * dpooled
        dscore = keep["weight"] * (dweight - (keep["weight"] * dweight).sum(0))
        g["choose"] = np.einsum("tnk,tn->k", keep["act"], dscore)
        dact = dscore[:, :, None] * p["choose"] * (1 - keep["act"] ** 2)
        g["attend"] = np.einsum("tnd,tnk->dk", keep["states"], dact)
        dstates = dstates + dact @ p["attend"].T
        dx = np.zeros_like(x)
        for w, own in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            u, du, dgates = p[f"u{w}"], np.zeros_like(p[f"u{w}"]), np.zeros((len(x), 3 * h), x.dtype)
            carry = np.zeros((len(at), h), x.dtype)
            for t, state, z, r, cand in reversed(keep["kept"][w]):
                d = carry + dstates[t, :, own]
                m = mask[:, t, None]
                dz, dcand = d * m * (cand - state), d * m * z
                carry = d * (1 - m * z)
                ac = dcand * (1 - cand**2)
                back = ac @ u[:, 2 * h :].T
                carry = carry + back * r
                azr = np.concatenate([dz * z * (1 - z), back * state * r * (1 - r)], 1)
                carry = carry + azr @ u[:, : 2 * h].T
                du[:, : 2 * h] += state.T @ azr
                du[:, 2 * h :] += (r * state).T @ ac
                np.add.at(dgates, at[:, t], np.concatenate([azr, ac], 1))
            g[f"u{w}"], g[f"c{w}"], g[f"x{w}"] = du, dgates.sum(0), x.T @ dgates
            dx += dgates @ p[f"x{w}"].T
        return g, dx


def _places(w: Words, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = np.arange(WINDOW)
    mask = step < length[:, None]
    return w.which[np.minimum(start[:, None] + step, max(len(w.which) - 1, 0))] if len(w.which) else np.zeros((0, WINDOW), np.int64), mask.astype(np.float32)


def train(texts: list[bytes], labels: np.ndarray, base_rate: float, seed: int = 5) -> Network:
    """Fit on whole documents by their highest window; then scale logits to the base rate of label 1."""
    net = Network(seed)
    labels = labels.astype(np.float64)
    if len(labels) == 0 or labels.min() == labels.max():
        net.p["out"][:], net.shift = 0, float(np.log(max(base_rate, 1e-4) / max(1 - base_rate, 1e-4)))
        return net
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    w = Words(np.frombuffer(b"".join(texts), np.uint8), offsets)
    start, length, row = w.windows()
    at, mask = _places(w, start, length)
    by_row = np.searchsorted(row, np.arange(len(texts) + 1))
    usable = np.flatnonzero(np.diff(by_row) > 0)
    rng, moments, turn = np.random.default_rng(seed + 1), {}, 0
    steps = max(len(usable) // BATCH, 1)
    for epoch in range(EPOCHS):
        # Before anything is learned the first window stands for its document; from then on the highest does.
        logits = all_logits(net, w, start, length) if epoch else np.zeros(len(start))
        for part in np.array_split(rng.permutation(usable), steps):
            top = np.array([by_row[d] + np.argmax(logits[by_row[d] : by_row[d + 1]]) for d in part])
            pick, own = np.unique(at[top], return_inverse=True)
            own = own.reshape(at[top].shape)
            x, keep = net.inputs(w, pick), {}
            out = net.forward(x, own, mask[top], keep)
            dlogit = ((_sigmoid(out) - labels[part]) / len(part)).astype(np.float32)
            g, dx = net.gradient(x, own, mask[top], keep, dlogit)
            ids, sizes, trigrams, of = w.some(pick)
            g["word"], g["char"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["char"])
            np.add.at(g["word"], ids, dx[:, :WORD_DIM])
            np.add.at(g["char"], trigrams, (dx[:, WORD_DIM:] / np.maximum(sizes, 1)[:, None])[of])
            rate = RATE * (1 - turn / (EPOCHS * steps))
            turn += 1
            for k, v in g.items():
                m, s = moments.setdefault(k, (np.zeros_like(v), np.zeros_like(v)))
                m += 0.1 * (v - m)
                s += 0.01 * (v * v - s)
                net.p[k] -= (rate * (m / (1 - 0.9**turn)) / (np.sqrt(s / (1 - 0.99**turn)) + 1e-7)).astype(np.float32)
    logits = all_logits(net, w, start, length)
    worst = np.array([logits[by_row[d] : by_row[d + 1]].max() for d in usable])
    a, b, y = 1.0, 0.0, labels[usable]
    for _ in range(300):  # logistic scaling with a little pull towards slope 1
        e = _sigmoid(a * worst + b) - y
        a, b = a - 0.5 * ((e * worst).mean() / max(np.abs(worst).mean(), 1) ** 2 + 0.001 * (a - 1)), b - 0.5 * e.mean()
    share = y.mean()
    rate = min(max(base_rate, 1e-4), 1 - 1e-4)
    net.scale, net.shift = float(max(a, 0.1)), float(b + np.log(rate / (1 - rate)) - np.log(share / (1 - share)))
    return net


def all_logits(net: Network, w: Words, start: np.ndarray, length: np.ndarray, tile: int = 1024) -> np.ndarray:
    """The logits of all windows, some at a time."""
    gates, out = net.gates(net.inputs(w)), np.empty(len(start), np.float64)
    for a in range(0, len(start), tile):
        at, mask = _places(w, start[a : a + tile], length[a : a + tile])
        out[a : a + tile] = net.forward(None, at, mask, gates=gates)
    return out


def worst_windows(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each row's highest scaled logit over all its windows; that of no evidence for a row without words."""
    w = Words(data, offsets)
    out = np.full(len(offsets) - 1, -np.inf)
    if len(w.which):
        start, length, row = w.windows()
        np.maximum.at(out, row, all_logits(net, w, start, length))
    return np.where(np.isinf(out), min(net.shift, -3.0), net.scale * np.where(np.isinf(out), 0, out) + net.shift)


def fit(docs: DataFrame, labels: DataFrame) -> Network:
    """A network from a bounded sample of the labelled rows that are not held out, chosen by a hash of the id."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    rows = [r for k, n in SAMPLE.items() for r in known.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).collect()]
    if not rows:
        return train([], np.zeros(0), 0.0)
    chosen = docs.sparkSession.createDataFrame([(r.doc_id, r.toxic) for r in rows], "l_id long, toxic int")  # SUM(SAMPLE) rows at most
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("raw")).filter(F.length("raw") <= SAMPLE_BYTES).join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id"))
    # Of rows that share an id the least text, so that a rerun learns from the same.
    found = sorted((r.doc_id, bytes(r.raw), r.toxic) for r in texts.groupBy("doc_id").agg(F.min("raw").alias("raw"), F.max("toxic").alias("toxic")).collect())
    return train([r[1] for r in found], np.array([r[2] for r in found], float), counts.get(1, 0) / max(sum(counts.values()), 1))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Learns from labels (doc_id, toxic) of ids that are not held out. A text that is null, empty or without a letter has
    a low score; repeated rows get the same score; an id with both labels counts as 1; without labels of both kinds
    every text gets the base rate. Texts are scored whole, in all overlapping windows. An empty table gives no rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, fit(docs, labels)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, net = shared.value
        for whole in batches:
            for batch in chunks(whole, "raw"):
                p = 1 / (1 + np.exp(-np.clip(worst_windows(net, *flat(batch, "raw")), -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), utf8("text").alias("raw"))
    return rows.transform(map_arrow, run, "doc_id long, held_out boolean, score double, predicted int")
