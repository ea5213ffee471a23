"""Near-duplicates that share a part of their distinct shingles (Jaccard), found by SimHash and decided exactly.

Candidates come from the Gray-order index of ``simhash``: a text's fingerprint is that of its distinct
shingles, and texts meet under keys of ROWS minima of its hashes each, BANDS keys a text whatever the
table's size. Two sets that share 0.8 have a key in common with probability 1 - (1 - 0.8^3)^6 = 0.987,
and are within RADIUS bits but for a few in a thousand; alike sets more surely. Under a key the index
drops whole groups of fingerprints beyond the radius. First each text is held against its nearest under
each key, the two whole sets joined in Spark; where texts under a key are still apart, their sets meet
under it and every candidate is decided there. No link is made or refused by an estimate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import doc_frame, skew_join, slices, written
from plumbline.llm.components import components
from plumbline.llm.simhash import GrayIndex, gray_rank, in_parts, majority, named, shared_keys, shingle_hashes, whole_groups

#: Keys of a text, minima in a key, and the differing bits up to which texts under a key are candidates.
BANDS, ROWS, RADIUS = 6, 3, 20
#: The most texts of a key whose sets a task holds at once, and the most codes of these sets, are about twice these; a larger key is split into pairs of parts.
SETS, CODES = 512, 1 << 23
#: More bits than two fingerprints differ in.
FAR = 99
_ODD = np.random.default_rng(11).integers(0, 1 << 63, BANDS * ROWS).astype(np.uint64) << np.uint64(1) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str, shingle: int, seed: int = 42) -> np.ndarray:
    """The distinct shingles of a text by their 64-bit hashes, ascending."""
    return np.unique(np.array(shingle_hashes(text, shingle, seed), np.uint64))


def name_of(codes: np.ndarray) -> int:
    """A signed 64-bit name of a set: equal sets have equal names."""
    from xxhash import xxh64_intdigest

    x = xxh64_intdigest(codes.tobytes(), 7)
    return x - (1 << 64) if x >> 63 else x


def band_keys(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One row of BANDS keys for each run of ``counts`` codes, none of them empty: the minima of ROWS hashes each."""
    first, out = np.r_[0, np.cumsum(counts)[:-1]], np.empty((len(counts), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(BANDS):
            key = np.full(len(counts), k, np.uint64)
            for odd in _ODD[k * ROWS : (k + 1) * ROWS]:
                key = (key ^ np.minimum.reduceat(codes * odd, first)) * _MIX
            out[:, k] = key ^ key >> np.uint64(32)
    return out


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*parts, np.zeros(0, np.uint64)]).view(np.int64)))


def _marked(docs: DataFrame, shingle: int) -> DataFrame:
    """(id, spot, name, n, fp, keys): the name, size, fingerprint and keys of each text's set; the empty set has no keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            for at, to in slices(texts, 1 << 20):
                sets = [shingle_set(t, shingle) for t in texts[at:to]]
                counts, codes = np.fromiter(map(len, sets), np.int64, to - at), np.concatenate(sets)
                keys = iter(band_keys(codes, counts[counts > 0]) if len(codes) else ())
                held = _lists([next(keys) if n else codes[:0] for n in counts])
                names, prints = pa.array([name_of(s) for s in sets], pa.int64()), pa.array(majority(codes, counts).view(np.int64))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, to - at), b.column(1).slice(at, to - at), names, pa.array(counts), prints, held], ["id", "spot", "name", "n", "fp", "keys"])

    return docs.mapInArrow(run, "id long, spot long, name long, n long, fp long, keys array<long>")


def _far(rows: np.ndarray, likeness: float, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of places cannot or need not be linked. rows, one for each column: p, r, part, n, root."""
    p, r, part, n, root = rows
    ok = (root[i] != root[j]) & (np.minimum(n[i], n[j]) >= likeness * np.maximum(n[i], n[j]) - 1e-6)
    return ~(ok & ((p[i] == r[i]) | (part[i] != part[j])))  # two of one part meet where p is r


def _nearest(spots: DataFrame, likeness: float) -> DataFrame:
    """(a, b): for each text under a key, the nearest of all and the nearest of those before it, within RADIUS bits. The latter connect whatever the index finds there. spots: (key, wide, name, n, fp)."""
    dealt = in_parts(spots, "key", F.col("wide"), "name").select("key", "p", "r", "part", "n", "name", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, group in whole_groups(batches, 3):
            rows = rows[:, np.lexsort((gray_rank(rows[6].view(np.uint64)), group))]
            name, fps = rows[5], rows[6].view(np.uint64)
            best = np.full((2, rows.shape[1]), FAR << 32, np.int64)
            for i, j in GrayIndex(fps, group).links(RADIUS):
                ok = ~_far(np.stack([*rows[1:5], name]), likeness, i, j)
                i, j = i[ok], j[ok]
                apart = np.bitwise_count(fps[i] ^ fps[j]).astype(np.int64) << 32
                np.minimum.at(best[0], j, apart | i)
                np.minimum.at(best[1], j, apart | i)
                np.minimum.at(best[1], i, apart | j)
            far, to = best >> 32 < FAR, best & 0xFFFFFFFF
            both = np.concatenate([np.stack((name[f], name[t[f]])) for f, t in zip(far, to, strict=True)], axis=1)
            both = np.unique(np.sort(both, axis=0), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """A row of bits for each set, four times as many as the largest has codes: codes set the bits that their last digits name."""
    width = 64 << max(0, (max(map(len, sets)) * 4 - 1).bit_length() - 6)
    out = np.empty((len(sets), width // 64), np.uint64)
    bits = np.empty(width, bool)
    for row, codes in zip(out, sets, strict=True):
        bits[:] = False
        bits[(codes & np.uint64(width - 1)).astype(np.int64)] = True
        row[:] = np.packbits(bits, bitorder="little").view(np.uint64)
    return out


def _most(n: np.ndarray, maps: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """A bound of what the sets of places i and j have in common: a bit that one lacks is a code that it lacks."""
    out, step = np.empty(len(i), np.int64), max(1, (1 << 21) // maps.shape[1])
    for k in range(0, len(i), step):
        a, b, at = maps[i[k : k + step]], maps[j[k : k + step]], slice(k, k + step)
        out[at] = np.minimum(n[i[at]] - np.bitwise_count(a & ~b).sum(axis=1, dtype=np.int64), n[j[at]] - np.bitwise_count(b & ~a).sum(axis=1, dtype=np.int64))
    return out


def _links_under(fps: np.ndarray, rows: np.ndarray, sets: list[np.ndarray], likeness: float) -> Iterator[tuple[int, int]]:
    """Pairs of places of one group that share enough and connect what all such pairs connect. rows as for ``_far``."""
    n, maps = rows[3], _bitmaps(sets)
    over = np.arange(len(sets))  # of each place, one that it is connected to

    def top(x: int) -> int:
        while over[x] != x:
            over[x] = over[over[x]]
            x = over[x]
        return x

    seen: dict[int, int] = {}
    for place, root in enumerate(rows[4].tolist()):
        over[place] = seen.setdefault(root, place)
    for i, j in GrayIndex(fps, np.zeros(len(fps), np.int64)).links(RADIUS):
        ok = ~_far(rows, likeness, i, j)
        i, j = i[ok], j[ok]
        least = likeness / (1 + likeness) * (n[i] + n[j]) - 1e-6
        ok = _most(n, maps, i, j) >= least
        i, j, least = i[ok], j[ok], least[ok]
        order = np.argsort(np.bitwise_count(fps[i] ^ fps[j]), kind="stable")
        for a, b, need in zip(i[order].tolist(), j[order].tolist(), least[order].tolist(), strict=True):
            x, y = top(a), top(b)
            if x != y and len(np.intersect1d(sets[a], sets[b], assume_unique=True)) >= need:
                over[y] = x
                yield a, b


def _rest(spots: DataFrame, sets: DataFrame, likeness: float) -> DataFrame:
    """(a, b): links between texts under a key that are not connected yet, decided where their whole sets meet, so that no pair that is refused leaves its task. spots: (key, wide, codes_under, name, n, fp, root)."""
    dealt = in_parts(spots.join(sets, "name"), "key", F.greatest("wide", F.col("codes_under") * SETS / CODES), "name", SETS).select("key", "p", "r", "part", "n", "root", "name", "fp", "codes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, list]] = []

        def found() -> pa.RecordBatch:
            rows, sets = np.concatenate([r for r, _ in kept], axis=1), [s for _, own in kept for s in own]
            order = np.argsort(gray_rank(rows[7].view(np.uint64)), kind="stable")
            rows, sets = rows[:, order], [sets[k] for k in order.tolist()]
            at = list(_links_under(rows[7].view(np.uint64), rows[1:6], sets, likeness))
            return pa.RecordBatch.from_arrays([pa.array([int(rows[6, x[k]]) for x in at], pa.int64()) for k in (0, 1)], ["a", "b"])

        for b in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns[:8]])
            sets = [s.view(np.uint64) for s in b.column(8).to_numpy(zero_copy_only=False)]
            edge = [0, *(np.flatnonzero((rows[:3, 1:] != rows[:3, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(edge, edge[1:], strict=False):
                if lo == hi:
                    continue
                if kept and (kept[-1][0][:3, -1] != rows[:3, lo]).any():
                    yield found()
                    kept.clear()
                kept.append((rows[:, lo:hi], sets[lo:hi]))
        if kept:
            yield found()

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _sets(texts: DataFrame, nodes: DataFrame, pairs: DataFrame, shingle: int) -> DataFrame:
    """(name, codes): the whole sets that the pairs need. One text of each is read; texts that repeat its id may add others."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct()
    need = nodes.join(ends, "name", "left_semi").select("spot").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = b.column(0).to_pylist()
            for at, to in slices(whole, 1 << 20):
                found = {name_of(own): own for own in (shingle_set(t, shingle) for t in whole[at:to])}
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), _lists(list(found.values()))], ["name", "codes"])

    got = texts.join(need, "spot", "left_semi").select("text").mapInArrow(run, "name long, codes array<long>")
    return got.groupBy("name").agg(F.first("codes").alias("codes"))


def alike_pairs(pairs: DataFrame, sets: DataFrame, likeness: float) -> DataFrame:
    """The pairs (a, b) of which the sets share at least ``likeness`` of their union."""
    total = pairs.count()
    for end, other in (("a", "b"), ("b", "a")):
        many = pairs.groupBy(F.col(end).alias("name")).agg(F.count("*").alias("w"))
        right = sets.join(many, "name").select(F.col("name").alias(end), F.col("codes").alias(f"codes_{end}"), "w")
        pairs = skew_join(pairs, right, end, "w", total, other, "inner")
    both = F.size(F.array_intersect("codes_a", "codes_b"))
    return pairs.where(both / (F.size("codes_a") + F.size("codes_b") - both) >= likeness).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, likeness: float = 0.8) -> DataFrame:
    """One row per document: (id, fp, component), the smallest id of all that it reaches over pairs that share ``likeness`` of their distinct shingles.

    fp names the set of shingles; texts with equal sets are one node, however many. Null, empty and
    blank texts have the empty set and are one group. Repeated rows and null ids keep their rows; a
    null id never names a component unless nothing else is in it. An empty table gives an empty result;
    further columns are ignored.
    """
    texts = doc_frame(docs, id_col, text_col).select("id", F.coalesce("id", F.xxhash64("text")).alias("spot"), "text")
    marked = written(_marked(texts, shingle), "marked")
    firsts = [F.first(c).alias(c) for c in ("n", "fp", "keys")]
    nodes = written(marked.groupBy("name").agg(F.min("id").alias("low"), F.min("spot").alias("spot"), F.count("*").alias("w"), *firsts), "nodes")
    n, total = nodes.agg(F.count("*"), F.coalesce(F.sum("w"), F.lit(0))).first()
    spots = written(shared_keys(nodes.select("name", "n", "fp", F.explode("keys").alias("key"))), "spots")
    pairs = written(_nearest(spots, likeness), "pairs")
    sets = written(_sets(texts, nodes, pairs, shingle), "sets")
    roots = written(components(written(alike_pairs(pairs, sets, likeness), "links"), "a", "b"), "roots")
    now = spots.join(roots, spots["name"] == roots["node"], "left").select(*spots.columns, F.coalesce("root", "name").alias("root"))
    apart = now.groupBy("key").agg(F.min("root").alias("one"), F.max("root").alias("two"), F.sum("n").alias("codes_under")).where("one <> two").select("key", "codes_under")
    links = written(_rest(now.join(apart, "key"), sets, likeness), "links")
    return named(marked, nodes.select("name", "low", "w"), _joined(roots, links), "name", n, total)


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after further links between the components that ``roots`` has; nodes that it lacks are their own."""
    for end in ("a", "b"):
        links = links.join(roots, links[end] == roots["node"], "left").withColumn(end, F.coalesce("root", end)).select("a", "b")
    again = components(links, "a", "b").select(F.col("node").alias("was"), F.col("root").alias("now"))
    moved = roots.join(again, roots["root"] == again["was"], "left").select("node", F.coalesce("now", "root").alias("root"))
    return moved.unionByName(again.join(roots, again["was"] == roots["node"], "left_anti").select(F.col("was").alias("node"), F.col("now").alias("root")))
