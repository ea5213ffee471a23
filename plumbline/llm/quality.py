"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. What a line looks like, and what its neighbours look like, are features;
the chain lets a run of bad lines hold together. Forward-backward gives each line's chance of being
good, and the mean of these, weighted by length, is the document's. Only documents carry labels, so
training takes them for their lines first, and then, twice, lets the chain say which lines of a bad
document are bad; the document's figure is put on the scale of the labels at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import doc_frame, slices

#: The most labelled documents of either kind that training reads.
MAX_GOOD, MAX_BAD = 800, 800
SHAPE = 14


def lines(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shape features of every line, its length, lines of each text). A text without text has one empty line."""
    cut = [t.split("\n") for t in texts]
    counts = np.fromiter(map(len, cut), np.int64, len(cut))
    flat = [x for c in cut for x in c]
    n = np.fromiter(map(len, flat), np.int64, len(flat))
    code = np.frombuffer("\n".join(flat).encode("utf-32-le", "surrogatepass") + b"\n\0\0\0", np.uint32)
    at = np.cumsum(n + 1) - n - 1
    low = np.minimum(code, 0x2FF)
    kind = _KIND[low]
    # counts of characters of each kind in each line, the closing line end taken off
    per = np.stack([np.add.reduceat((kind == k).astype(np.int32), at) for k in range(1, 7)], axis=1).astype(np.float64)
    letter, upper, digit, space, stop, odd = per[:, 0] + per[:, 1], per[:, 1], per[:, 2], per[:, 3] - 1, per[:, 4], per[:, 5]
    words, kinds, longest, again, whole = (np.zeros(len(flat)) for _ in range(5))
    seen_in: set[str] = set()
    k = 0
    for c in cut:
        seen_in.clear()
        for line in c:
            w = line.split()
            words[k], kinds[k] = len(w), len(set(w))
            longest[k] = max(map(len, w), default=0)
            again[k] = sum(map(str.__eq__, w, w[1:]))
            whole[k] = line in seen_in
            seen_in.add(line)
            k += 1
    m, w = np.maximum(n, 1), np.maximum(words, 1)
    x = np.stack((np.log1p(n) / 5, letter / m, 3 * upper / m, 5 * digit / m, space / m * 3, 5 * stop / m, 5 * odd / m, kinds / w, np.log1p(longest) / 3, 2 * again / w, whole, n / w / 10, odd > 0.02 * m, words < 3), axis=1)
    return x, n, counts


def _kinds() -> np.ndarray:
    """1 lower or other letter, 2 upper, 3 digit, 4 space, 5 common stop, 6 any other sign, by code point; the last stands for all above."""
    out = np.ones(0x300, np.uint8)
    for c in range(0x2FF):
        s = chr(c)
        out[c] = 2 if s.isupper() else 1 if s.isalpha() else 3 if s.isdigit() else 4 if s.isspace() else 5 if s in ".,;:'?-" else 6
    return out


_KIND = _kinds()


def neighbours(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each line's features beside those of the line before and after it (zero at the ends), a constant, and marks of the ends."""
    first = np.zeros(len(x), bool)
    last = first.copy()
    stop = np.cumsum(counts)
    first[stop - counts], last[stop - 1] = True, True
    before, after = np.roll(x, 1, axis=0), np.roll(x, -1, axis=0)
    before[first], after[last] = 0, 0
    return np.concatenate((x, before, after, first[:, None], last[:, None], np.ones((len(x), 1))), axis=1)


class Chain:
    """Two states (0 bad, 1 good): emission weights for good, transition scores, and the scale of the document figure."""

    def __init__(self):
        self.w = np.zeros(3 * SHAPE + 3)
        self.t = np.zeros((2, 2))
        self.scale = np.array([1.0, 0.0])

    def marginals(self, e: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(chance of good of each line, chance of each transition summed), by forward-backward over all texts at once, the longest first."""
        order = np.argsort(-counts, kind="stable")
        start, long = (np.cumsum(counts) - counts)[order], counts[order]
        emit = np.stack((np.zeros(len(e)), e), axis=1)
        move = np.exp(self.t)
        scaled = np.exp(emit - emit.max(axis=1, keepdims=True))
        alpha, beta = np.empty((len(e), 2)), np.ones((len(e), 2))
        alive = np.searchsorted(-long, -np.arange(1, long.max(initial=0) + 1), "right")
        for p, k in enumerate(alive):
            at = start[:k] + p
            a = scaled[at] if p == 0 else (alpha[at - 1] @ move) * scaled[at]
            alpha[at] = a / a.sum(axis=1, keepdims=True)
        for p in range(len(alive) - 1, 0, -1):
            at = start[: alive[p]] + p
            b = (beta[at] * scaled[at]) @ move.T
            beta[at - 1] = b / b.sum(axis=1, keepdims=True)
        both = alpha * beta
        later = np.ones(len(e), bool)
        later[np.cumsum(counts) - counts] = False
        at = np.flatnonzero(later)
        pair = alpha[at - 1][:, :, None] * move * (scaled[at] * beta[at])[:, None, :]
        return both[:, 1] / both.sum(axis=1), (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)

    def climb(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, counts: np.ndarray, steps: int = 120, rate: float = 0.1) -> None:
        """Raise the likelihood of line labels y by its gradient: observed less expected counts."""
        later = np.ones(len(x), bool)
        later[np.cumsum(counts) - counts] = False
        at = np.flatnonzero(later)
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[at - 1], y[at]), 1)
        m = [np.zeros_like(self.w), np.zeros_like(self.t)]
        s = [np.zeros_like(self.w), np.zeros_like(self.t)]
        for k in range(1, steps + 1):
            good, pair = self.marginals(x @ self.w, counts)
            g = ((weight * (y - good)) @ x / weight.sum() - 1e-4 * self.w, (seen - pair) / len(x) - 1e-4 * self.t)
            for i, (v, d) in enumerate(zip((self.w, self.t), g, strict=True)):
                m[i] += 0.1 * (d - m[i])
                s[i] += 0.01 * (d * d - s[i])
                v += rate * (m[i] / (1 - 0.9**k)) / (np.sqrt(s[i] / (1 - 0.99**k)) + 1e-8)

    def document(self, good: np.ndarray, n: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Log-odds of the length-weighted mean chance of good lines."""
        at = np.cumsum(counts) - counts
        w = n + 1e-6
        mean = np.clip(np.add.reduceat(good * w, at) / np.add.reduceat(w, at), 1e-4, 1 - 1e-4)
        return np.log(mean / (1 - mean))

    def fit(self, texts: list[str], labels: np.ndarray, rounds: int = 3) -> None:
        x, n, counts = lines(texts)
        x = neighbours(x, counts)
        doc = np.repeat(np.arange(len(counts)), counts)
        y = labels[doc].astype(np.int64)
        weight = (n + 20) / np.bincount(doc, n + 20)[doc]
        first = np.cumsum(counts) - counts
        for k in range(rounds):
            self.climb(x, y, weight, counts)
            good, _ = self.marginals(x @ self.w, counts)
            if k + 1 < rounds:
                worst = np.minimum.reduceat(good, first)
                y = np.where(labels[doc] == 1, 1, (good > 0.5) & (good > worst[doc])).astype(np.int64)
        z = self.document(good, n, counts)
        for _ in range(50):  # two weights by Newton's method
            p = 1 / (1 + np.exp(-(self.scale[0] * z + self.scale[1])))
            design = np.stack((z, np.ones_like(z)))
            self.scale += np.linalg.solve((design * (p * (1 - p) + 1e-9)) @ design.T + 1e-3 * np.eye(2), design @ (labels - p) - 1e-3 * (self.scale - [1, 0]))

    def score(self, texts: list[str]) -> np.ndarray:
        out = np.empty(len(texts))
        for at, to in slices(texts, 1 << 21):
            x, n, counts = lines(texts[at:to])
            good, _ = self.marginals(neighbours(x, counts) @ self.w, counts)
            # rounded, so that equal texts score alike whatever batch they came in
            z = np.round(self.scale[0] * self.document(good, n, counts) + self.scale[1], 6)
            out[at:to] = 1 / (1 + np.exp(-z))
        return out


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_good: int = MAX_GOOD, max_bad: int = MAX_BAD) -> Chain:
    """Fit on a bounded sample: of the labelled ids that are ``usable``, the first ``max_good`` and ``max_bad`` by hash; only their texts reach the driver.

    An id that is labelled twice counts as 0 if any label is. The scale is moved back to the share
    that the kinds have among all labels. Without labels of both kinds every text gets that share.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    if usable is not None:
        known = known.where(usable)
    known = known.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(F.col(label_col).cast("int")).alias("y"))
    share = dict(known.groupBy("y").count().collect())
    pick = lambda y, n: known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(n)
    sample = pick(1, max_good).unionAll(pick(0, max_bad))
    rows = sorted(doc_frame(docs, id_col, text_col).join(F.broadcast(sample), "id").select("id", "y", "text").collect())
    chain = Chain()
    y = np.array([r.y for r in rows], float)
    a, b = share.get(1, 0), share.get(0, 0)
    if not y.sum() or y.all():
        chain.scale = np.array([0, np.log((a + 0.5) / (b + 0.5))])
        return chain
    chain.fit([r.text for r in rows], y)
    chain.scale[1] += np.log(a / b) - np.log(y.sum() / (len(y) - y.sum()))
    return chain


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) per row, from the text alone. Null and empty texts are one empty line. Repeated rows and ids stay; no rows give no rows; further columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(chain.score(b.column(1).to_pylist()))], ["id", "score"])

    return doc_frame(docs, id_col, text_col).mapInArrow(run, "id long, score double")
