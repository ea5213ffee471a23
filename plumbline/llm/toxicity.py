"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as two inputs: a vector of its own (by hash) and the mean vector of its character
trigrams, so bent forms of a word share most of what they say. A text is read in overlapping windows
of words, every one scored; the text's logit is the log-sum-exp over its windows, in training too, so
that a few bad lines in a long clean text count and clean windows learn to say nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import doc_frame, slices

WINDOW, STRIDE = 32, 24
WORD_BITS, CHAR_BITS, DIM, HIDDEN, ATTEND = 14, 13, 8, 8, 8
#: The most labelled documents of either kind that training reads, whole; and windows that a pass holds at once.
MAX_POSITIVE, MAX_NEGATIVE, HELD = 800, 900, 4096
_STRIP = ".,;:!?\"'()[]|*#$%&"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_inputs(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word bucket, trigram buckets of all words in a row, where each word's start)."""
    words = [w.strip(_STRIP) or w for w in words]
    codes = np.frombuffer(("\x01" + "\x01".join(words) + "\x01").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(lens + 1) - lens
    own = np.ones(len(codes), bool)
    own[start - 1], own[-1] = False, False
    at = np.flatnonzero(own)
    place = np.cumsum(lens) - lens
    with np.errstate(over="ignore"):
        tri = ((codes[at - 1] * np.uint64(31) + codes[at]) * np.uint64(1_000_003) + codes[at + 1] * np.uint64(8191)) * _MIX >> np.uint64(64 - CHAR_BITS)
        power = np.cumprod(np.full(int(lens.max(initial=1)), 1_000_003, np.uint64))
        word = np.add.reduceat((codes[at] + np.uint64(7)) * power[np.arange(len(at)) - np.repeat(place, lens)], place) * _MIX >> np.uint64(64 - WORD_BITS)
    return word.astype(np.int64), tri.astype(np.int64), place


class _Numbers(dict):
    """Numbers new words from 1."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self) + 1
        return n


def windows(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, windows of word numbers from 1, 0 being padding, windows of each text): all overlapping windows of whole texts."""
    seen = _Numbers()
    rows, counts = [], np.zeros(len(texts), np.int64)
    for k, t in enumerate(texts):
        ids = np.fromiter(map(seen.__getitem__, t.lower().split()), np.int32)
        n = 1 + max(0, -(-(len(ids) - WINDOW) // STRIDE))
        padded = np.zeros((n - 1) * STRIDE + WINDOW, np.int32)
        padded[: len(ids)] = ids
        rows.append(np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE][:n])
        counts[k] = n
    return list(seen), np.concatenate(rows), counts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """The parameters by name, and passes forwards and back. Direction 0 reads forwards, 1 backwards."""

    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        g = lambda *s, k=0.3: (k * r.standard_normal(s)).astype(np.float32)
        self.p = {"word": g(1 << WORD_BITS, DIM, k=0.1), "char": g(1 << CHAR_BITS, DIM), "x": g(2 * DIM, 6 * HIDDEN), "b": np.zeros(6 * HIDDEN, np.float32), "h": g(2, HIDDEN, 3 * HIDDEN), "a": g(2 * HIDDEN, ATTEND), "v": g(ATTEND), "u": g(2 * HIDDEN), "c": np.full(1, -4, np.float32)}
        self.shift = 0.0

    def inputs(self, words: list[str]) -> tuple[np.ndarray, tuple]:
        """Input projections of distinct words, row 0 being padding, that leaves the state as it is."""
        out = np.zeros((len(words) + 1, 6 * HIDDEN), np.float32)
        out[0, :HIDDEN] = out[0, 3 * HIDDEN : 4 * HIDDEN] = -30
        if not words:
            return out, ()
        w, tri, place = word_inputs(words)
        n = np.diff(np.r_[place, len(tri)])
        x = np.concatenate((self.p["word"][w], np.add.reduceat(self.p["char"][tri], place) / n[:, None].astype(np.float32)), axis=1)
        out[1:] = x @ self.p["x"] + self.p["b"]
        return out, (w, tri, n, x)

    def forward(self, proj: np.ndarray, win: np.ndarray, keep: bool = False):
        """Logit of each window; with ``keep`` also what the way back needs."""
        n, size = len(win), 3 * HIDDEN
        h, hs, kept = np.zeros((2, n, HIDDEN), np.float32), np.empty((WINDOW, n, 2 * HIDDEN), np.float32), []
        both = proj.reshape(len(proj), 2, size)
        for t in range(WINDOW):
            g = np.stack((both[win[:, t], 0], both[win[:, WINDOW - 1 - t], 1]))
            m = np.matmul(h, self.p["h"])
            zr = _sigmoid(g[..., : 2 * HIDDEN] + m[..., : 2 * HIDDEN])
            z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
            c = np.tanh(g[..., 2 * HIDDEN :] + r * m[..., 2 * HIDDEN :])
            if keep:
                kept.append((h, z, r, c, m[..., 2 * HIDDEN :]))
            h = h + z * (c - h)
            hs[t, :, :HIDDEN], hs[WINDOW - 1 - t, :, HIDDEN:] = h[0], h[1]
        tanh = np.tanh(hs @ self.p["a"])
        score = tanh @ self.p["v"]
        score[(win == 0).T] = -1e9
        att = np.exp(score - score.max(axis=0))
        att /= att.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", att, hs)
        logit = pooled @ self.p["u"] + self.p["c"]
        return (logit, (hs, tanh, att, pooled, kept)) if keep else logit

    def backward(self, proj, got, win, state, d_logit) -> dict[str, np.ndarray]:
        hs, tanh, att, pooled, kept = state
        w, tri, n, x = got
        d = {"u": pooled.T @ d_logit, "c": d_logit.sum(keepdims=True)}
        d_pool = d_logit[:, None] * self.p["u"]
        d_att = np.einsum("nh,tnh->tn", d_pool, hs)
        d_score = att * (d_att - (att * d_att).sum(axis=0))
        d["v"] = np.einsum("tn,tna->a", d_score, tanh)
        d_pre = d_score[..., None] * self.p["v"] * (1 - tanh**2)
        d["a"] = np.einsum("tnh,tna->ha", hs, d_pre)
        d_hs = att[..., None] * d_pool + d_pre @ self.p["a"].T
        d["h"] = np.zeros_like(self.p["h"])
        d_proj = np.zeros((len(proj), 2, 3 * HIDDEN), np.float32)
        dh = np.zeros((2, len(win), HIDDEN), np.float32)
        back = self.p["h"].transpose(0, 2, 1)
        for t in range(WINDOW - 1, -1, -1):
            h, z, r, c, mc = kept[t]
            dh = dh + np.stack((d_hs[t, :, :HIDDEN], d_hs[WINDOW - 1 - t, :, HIDDEN:]))
            dc = dh * z * (1 - c**2)
            dm = np.concatenate((dh * (c - h) * z * (1 - z), dc * mc * r * (1 - r), dc * r), axis=2)
            dg = np.concatenate((dm[..., : 2 * HIDDEN], dc), axis=2)
            d["h"] += np.matmul(h.transpose(0, 2, 1), dm)
            dh = dh * (1 - z) + np.matmul(dm, back)
            for k, at in ((0, win[:, t]), (1, win[:, WINDOW - 1 - t])):
                order = np.argsort(at, kind="stable")
                first = np.flatnonzero(np.diff(at[order], prepend=-1))
                d_proj[at[order][first], k] += np.add.reduceat(dg[k][order], first)
        flat = d_proj[1:].reshape(-1, 6 * HIDDEN)
        d["x"], d["b"] = x.T @ flat, flat.sum(axis=0)
        dx = flat @ self.p["x"].T
        d["word"], d["char"] = np.zeros_like(self.p["word"]), np.zeros_like(self.p["char"])
        np.add.at(d["word"], w, dx[:, :DIM])
        np.add.at(d["char"], tri, np.repeat(dx[:, DIM:] / n[:, None], n, axis=0))
        return d

    def slope(self, texts: list[str], labels: np.ndarray) -> dict[str, np.ndarray] | None:
        """The gradient of the mean loss of some whole texts, over all their windows, HELD at a time; none if they have no word."""
        words, win, counts = windows(texts)
        if not words:
            return None
        doc = np.repeat(np.arange(len(texts)), counts)
        proj, got = self.inputs(words)
        spans = [slice(k, k + HELD) for k in range(0, len(win), HELD)]
        state = None
        if len(spans) == 1:
            logit, state = self.forward(proj, win, keep=True)
        else:
            logit = np.concatenate([self.forward(proj, win[s]) for s in spans])
        first = np.cumsum(counts) - counts
        top = np.maximum.reduceat(logit, first)
        e = np.exp(logit - top[doc])
        whole = np.add.reduceat(e, first)
        error = (_sigmoid(top + np.log(whole)) - labels) / len(texts)
        d_logit = (error[doc] * e / whole[doc]).astype(np.float32)
        total: dict[str, np.ndarray] = {}
        for s in spans:
            d = self.backward(proj, got, win[s], state or self.forward(proj, win[s], keep=True)[1], d_logit[s])
            total = {k: total[k] + v for k, v in d.items()} if total else d
        return total

    def fit(self, texts: list[str], labels: np.ndarray, steps: int = 420, rate: float = 0.015, seed: int = 1) -> None:
        """Adam on batches of 16 whole texts: the same number of steps whatever the sample's size, but 24 rounds at most."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, size = 0, 16
        total = steps = min(steps, 24 * -(-len(texts) // size))
        for _ in range(-(-steps // -(-len(texts) // size))):
            order = r.permutation(len(texts))
            for lo in range(0, len(order), size):
                pick = order[lo : lo + size]
                d = self.slope([texts[i] for i in pick], labels[pick])
                if d is None:
                    continue
                step += 1
                pace = rate * (1 - 0.9 * step / total)
                for k, v in d.items():
                    m[k] += 0.1 * (v - m[k])
                    s[k] += 0.01 * (v * v - s[k])
                    self.p[k] -= pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-6)

    def score(self, texts: list[str]) -> np.ndarray:
        """Probability of label 1 for each whole text."""
        out = np.empty(len(texts))
        for at, to in slices(texts, 1 << 20):
            words, win, counts = windows(texts[at:to])
            proj, _ = self.inputs(words)
            logit = np.concatenate([self.forward(proj, win[k : k + 8192]) for k in range(0, len(win), 8192)]).astype(np.float64)
            out[at:to] = np.logaddexp.reduceat(logit, np.cumsum(counts) - counts)
        # rounded, so that equal texts score alike whatever batch they came in
        return 1 / (1 + np.exp(-np.round(out + self.shift, 3)))


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_positive: int = MAX_POSITIVE, max_negative: int = MAX_NEGATIVE) -> Network:
    """Fit on a bounded sample: of the labelled ids that are ``usable``, the first ``max_positive`` and ``max_negative`` by hash.

    Only the sample's texts reach the driver. The kinds are sampled apart, and the logit is shifted
    back to the share that they have among all labels. An id that is labelled twice counts as 1 if any
    label is. Without labels of both kinds every text gets the share of label 1.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    if usable is not None:
        known = known.where(usable)
    known = known.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    share = dict(known.groupBy("y").count().collect())
    pick = lambda y, n: known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(n)
    sample = pick(1, max_positive).unionAll(pick(0, max_negative))
    rows = sorted(doc_frame(docs, id_col, text_col).join(F.broadcast(sample), "id").select("id", "y", "text").collect())
    net = Network()
    y = np.array([r.y for r in rows], np.float32)
    a, b = share.get(1, 0), share.get(0, 0)
    if not y.sum() or y.all():
        net.p["u"][:] = 0
        net.shift = float(np.log((a + 0.5) / (b + 0.5)) - net.p["c"][0])
        return net
    net.fit([r.text for r in rows], y)
    net.shift = float(np.log(a / b) - np.log(y.sum() / (len(y) - y.sum())))
    return net


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) per row, from the text alone. Null and empty texts are one empty window. Repeated rows and ids stay; no rows give no rows; further columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(net.score(b.column(1).to_pylist()))], ["id", "score"])

    return doc_frame(docs, id_col, text_col).mapInArrow(run, "id long, score double")


def kept(docs: DataFrame, net: Network, below: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score less than ``below``, all columns as they are; nothing is shuffled. Null texts are scored as empty."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(net.score([t or "" for t in b.column(at).to_pylist()]) < below))

    return docs.mapInArrow(run, docs.schema)
