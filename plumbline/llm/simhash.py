"""Near-duplicates by SimHash, linked through a Gray-order hierarchical index.

Fingerprints are sorted by Gray rank, so that neighbours differ in few bits. Sixteen in a row make a
leaf, sixteen nodes in a row an upper node; a node keeps the bits that all below it share (a mask and
a pattern). A search goes down from the root: the differences inside the mask bound the distance to
everything below, so a node that already differs in more bits than the radius is dropped whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import doc_frame, skew_join, slices, written
from plumbline.llm.components import components

BITS, FAN = 64, 16
#: Of radius + AGREE bit blocks of two fingerprints within the radius, at least AGREE are equal.
AGREE = 2
#: The most fingerprints of a key that one task holds at once is twice this; a larger key is split into pairs of parts.
PART = 4096
#: Pairs of (query, node) that a search holds at once.
FRONTIER = 2_000_000


def shingle_hashes(text: str, shingle: int, seed: int = 42) -> list[int]:
    """XXH64 of each run of ``shingle`` words; a text of fewer words is one shingle, one without words has none."""
    from xxhash import xxh64_intdigest as h

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    line, n = b" ".join(words), len(words)
    if n <= shingle:
        return [h(line, seed)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[: n - shingle])).tolist()
    return [h(line[s:e], seed) for s, e in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]


def majority(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of ``counts`` codes, the bits that are set in over half of them; none for an empty run."""
    out, full = np.zeros(len(counts), np.uint64), np.flatnonzero(counts)
    if len(full):
        bits = np.unpackbits(codes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, np.r_[0, np.cumsum(counts[full])[:-1]], axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * ones > counts[full][:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprints(texts: list[str], shingle: int = 4, seed: int = 42) -> np.ndarray:
    """Unsigned 64-bit SimHash of each text: words are runs without ASCII white space, A-Z lower-cased; bit set if in over half of the shingles' XXH64."""
    out = np.zeros(len(texts), np.uint64)
    for at, to in slices(texts, 1 << 20):
        own = [shingle_hashes(t, shingle, seed) for t in texts[at:to]]
        out[at:to] = majority(np.array([h for x in own for h in x], np.uint64), np.fromiter(map(len, own), np.int64, to - at))
    return out


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp): the fingerprint as a signed long. Null and empty texts have zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = fingerprints(b.column(1).to_pylist(), shingle, seed)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    return doc_frame(docs, id_col, text_col).mapInArrow(run, "id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code word in the reflected Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """The hierarchical index over many groups at once. fps sorted by (group, Gray rank); group numbers ascend."""

    def __init__(self, fps: np.ndarray, group: np.ndarray):
        self.fps, self.group = fps, group
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # first child, last child + 1, mask, pattern
        lo = hi = fps
        owner = group
        while True:
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            place = np.arange(len(owner)) - np.repeat(first, np.diff(np.r_[first, len(owner)]))
            start = np.flatnonzero(place % FAN == 0)
            hi, lo = np.bitwise_or.reduceat(hi, start), np.bitwise_and.reduceat(lo, start)
            self.levels.append((start, np.r_[start[1:], len(owner)], ~(hi ^ lo), lo))
            owner = owner[start]
            if len(start) == len(first):
                break
        self.root = np.searchsorted(owner, group)

    def links(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places (i < j) in the same group within ``radius`` bits, a slice of queries at a time."""
        sizes = np.bincount(np.unique(self.group, return_inverse=True)[1])
        width = np.cumsum(np.repeat(sizes, sizes))
        start = 0
        while start < len(self.fps):
            stop = int(np.searchsorted(width, (width[start - 1] if start else 0) + FRONTIER, "right"))
            stop = max(stop, start + 1)
            q, node = np.arange(start, stop), self.root[start:stop]
            for k in range(len(self.levels) - 1, -1, -1):
                first, last, mask, pattern = self.levels[k]
                near = np.bitwise_count((self.fps[q] ^ pattern[node]) & mask[node]) <= radius
                q, node = q[near], node[near]
                n = last[node] - first[node]
                q, node = np.repeat(q, n), np.repeat(first[node] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            near = (node > q) & (np.bitwise_count(self.fps[q] ^ self.fps[node]) <= radius)
            yield q[near], node[near]
            start = stop


def spanning(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n places, the smallest place it reaches over the links."""
    label = np.arange(n)
    for i, j in links:
        while True:
            a, b = label[i], label[j]
            differ = a != b
            if not differ.any():
                break
            a, b = a[differ], b[differ]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label = label[label]
    return label


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, group) in blocks of at least 8 * PART rows, if there are as many: batches of long columns, sorted by the first ``keys``, one row of the matrix for each column, groups never cut and numbered upwards."""
    kept: list[np.ndarray] = []
    held = 0

    def told(rows: np.ndarray, upto: int | None):
        change = (rows[:keys, 1:] != rows[:keys, :-1]).any(axis=0)
        cut = rows.shape[1] if upto is None else (np.flatnonzero(change)[-1] + 1 if change.any() else 0)
        return cut, np.cumsum(np.r_[False, change])[:cut]

    for b in batches:
        kept.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns]))
        held += b.num_rows
        if held < 8 * PART:
            continue
        rows = np.concatenate(kept, axis=1)
        cut, group = told(rows, 0)
        if cut:
            yield rows[:, :cut], group
        kept, held = [rows[:, cut:]], rows.shape[1] - cut
    if held:
        rows = np.concatenate(kept, axis=1)
        yield rows, told(rows, None)[1]


def in_parts(dealt: DataFrame, key: str, wide: Column, by: str, size: int | None = None) -> DataFrame:
    """``dealt`` with the columns part, p and r: rows of a key with ``wide`` > ``size`` rows (PART) are dealt to parts by ``by``, and every pair of parts (p, r) gets the rows of both, so that no task holds over twice that at once and every two rows of a key meet where p is r or where their parts differ."""
    parts = F.greatest(F.ceil(wide / (size or PART)), F.lit(1)).cast("int")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64(by, F.lit(7)), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.withColumns({"p": F.least("part", "other"), "r": F.greatest("part", "other")}).repartition(key, "p", "r").sortWithinPartitions(key, "p", "r")


def shared_keys(dealt: DataFrame) -> DataFrame:
    """The rows whose key others have too, with ``wide``, how many. Counts are summed before the shuffle; a hot key's rows are split by Spark's adaptive skew join, and only rows that stay leave it."""
    wide = dealt.groupBy("key").agg(F.count("*").alias("wide")).where("wide > 1")
    return dealt.join(wide, "key")


def masks_of(radius: int) -> list[int]:
    """The bits that a key keeps, a choice of AGREE among radius + AGREE blocks each: two fingerprints within the radius share at least one key. The keys are the same at every size of table."""
    n = radius + AGREE
    edge = [BITS * k // n for k in range(n + 1)]
    masks = [sum(((1 << (edge[k + 1] - edge[k])) - 1) << edge[k] for k in c) for c in combinations(range(n), AGREE)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def near_edges(nodes: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b): links that connect the same fingerprints as all pairs within ``radius`` bits do. nodes: (fp), distinct."""
    masks = masks_of(radius)
    dealt = nodes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("block", "bits"))
    dealt = dealt.select("fp", F.xxhash64("block", "bits").alias("key"))
    dealt = in_parts(shared_keys(dealt), "key", F.col("wide"), "fp").select("key", "p", "r", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, group in whole_groups(batches, 3):
            fps = rows[3].view(np.uint64)
            order = np.lexsort((gray_rank(fps), group))
            fps, group = fps[order], group[order]
            label = spanning(len(fps), GrayIndex(fps, group).links(radius))
            at = np.flatnonzero(label != np.arange(len(fps)))
            yield pa.RecordBatch.from_arrays([pa.array(fps[label[at]].view(np.int64)), pa.array(fps[at].view(np.int64))], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """One row per document: (id, fp, component), the smallest id of all that it reaches over links of ``radius`` bits or fewer.

    Exact copies collapse to one fingerprint before any search, so a hot group of copies costs one
    entry. Null, empty and blank texts have fingerprint zero and are linked as any other. Repeated rows
    and null ids keep their rows; a null id never names a component unless nothing else is in it. An
    empty table gives an empty result; further columns are ignored.
    """
    prints = written(with_fingerprints(docs, id_col, text_col, shingle), "prints")
    nodes = written(prints.groupBy("fp").agg(F.min("id").alias("low"), F.count("*").alias("w")), "nodes")
    n, total = nodes.agg(F.count("*"), F.coalesce(F.sum("w"), F.lit(0))).first()
    roots = components(near_edges(nodes.select("fp"), radius), "a", "b")
    return named(prints, nodes, roots, "fp", n, total)


def named(rows: DataFrame, nodes: DataFrame, roots: DataFrame, node: str, n: int, total: int) -> DataFrame:
    """(id, fp, component): each row's smallest id of all that its node reaches. rows: (id, node); nodes: (node, low, w), n of them for ``total`` rows."""
    rooted = nodes.join(roots, nodes[node] == roots["node"], "left").select(F.col(node).alias("fp"), "low", "w", F.coalesce("root", F.col(node)).alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component"), F.count("*").alias("members"))
    known = skew_join(rooted.select("fp", "w", "root"), lowest, "root", "members", n, "fp", "inner")
    return skew_join(rows.select("id", F.col(node).alias("fp")), known.select("fp", "w", "component"), "fp", "w", total, "id", "inner")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """The rows of ``docs`` that stand for their group of near-duplicates: those with its smallest id, and of rows that repeat that id one.

    Rows without an id cannot stand for others and stay.
    """
    return standing(docs, near_duplicates(docs.where(F.col(id_col).isNotNull()), id_col, text_col, shingle, radius), id_col, text_col)


def standing(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with an id that names its component in ``found`` (one of those that repeat it), and those without an id."""
    stay = found.where(F.col("id") == F.col("component")).groupBy("id").agg(F.count("*").alias("n"))
    # rows go as one column, so that their names cannot clash with others
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("key"))
    met = rows.join(stay, rows["key"] == stay["id"], "left").where(F.col("n").isNotNull() | F.col("key").isNull())
    # only ids that repeat need their rows set in an order
    again = met.where(F.col("n") > 1).withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy(F.col("row")[text_col]))).where("k = 1").drop("k")
    return met.where(F.col("n").isNull() | (F.col("n") == 1)).unionByName(again).select("row.*")
