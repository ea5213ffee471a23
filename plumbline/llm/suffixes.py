"""Suffix-array dedup: every byte goes that a long enough string covers which also starts somewhere else.

A window is a string of ``size`` bytes. Of all grams (GRAM bytes) inside a window the one with the
smallest hash is its anchor, so equal windows have equal anchors at equal places, and consecutive
windows mostly share one. Windows can only be equal if their anchors' grams are: grams that occur once
are left out, and the stretches of text around the others meet by gram. There the contexts to the right
of the anchors and, read backwards, those to the left are sorted, each by deep-shallow sorting:
multikey quicksort to a shallow depth, then a blind trie for each group of contexts that is still
equal. In both orders, with the lengths of common prefixes between neighbours, a window with ``o``
bytes before its anchor is repeated if another stretch is with it in the run of left contexts that
share ``o`` bytes and in the run of right contexts that share the other ``size - o``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import skew_join, written
from plumbline.llm.sieve import passes, sieve

#: Bytes of a gram; bytes that multikey quicksort looks at beyond those known to be equal; bytes of text handled at once; stretches of one gram that a task holds at most (beyond, windows are compared one by one).
GRAM, SHALLOW, CHUNK, HEAVY = 64, 24, 1 << 20, 16_384
_BASE = np.uint64(0x9E3779B97F4A7C15)
_AT = np.uint64((1 << 24) - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA5A3564E27F8862D)
    return x ^ (x >> np.uint64(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    got = np.full(n, base, np.uint64)
    got[0] = 1
    return np.cumprod(got, dtype=np.uint64)


_POWER = _powers(_BASE, CHUNK + 4 * GRAM)
_UNDO = _powers(np.uint64(pow(int(_BASE), -1, 1 << 64)), CHUNK + 4 * GRAM)


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each GRAM bytes of ``b``, a function of these bytes alone."""
    n = len(b)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _POWER[:n], out=sums[1:])
    return _mixed((sums[GRAM:] - sums[:-GRAM]) * _UNDO[: n - GRAM + 1])


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` neighbours: of blocks of w, the tail of one and the head of the next."""
    n = len(x)
    blocks = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = x
    blocks = blocks.reshape(-1, w)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[: n - w + 1], head[w - 1 : n])


def anchors(b: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, at, hash) of each run of windows (by where they start) with one anchor, its place and its gram's hash.

    ``b`` holds whole texts one after another, which end at ``ends``; windows stay within a text. It is worked through in chunks.
    """
    runs = []
    windows = len(b) - size + 1
    change = np.zeros(max(windows, 0) + 1, np.int8)
    begin = np.r_[0, ends[:-1]]
    some = ends - begin >= size
    np.add.at(change, begin[some], 1)
    np.add.at(change, ends[some] - size + 1, -1)
    inside = np.cumsum(change[:-1], dtype=np.int8).astype(bool)
    for start in range(0, windows, CHUNK - size):
        n = min(CHUNK - size, windows - start)
        spot = np.flatnonzero(inside[start : start + n])
        if not len(spot):
            continue
        h = gram_hashes(b[start : start + n + size - 1])
        # 40 bits of the hash and the place: of equal hashes the first counts
        packed = (h & ~_AT) | np.arange(len(h), dtype=np.uint64)
        at = (sliding_least(packed, size - GRAM + 1) & _AT).astype(np.int64)[spot]
        edge = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        last = np.r_[edge[1:], len(spot)] - 1
        runs.append((spot[edge] + start, spot[last] + start, at[edge] + start, h[at[edge]]))
    if not runs:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    first, last, at, hashes = (np.concatenate(x) for x in zip(*runs, strict=True))
    # a run that a chunk's end has cut is one again
    keep = np.r_[True, at[1:] != at[:-1]]
    end = np.r_[np.flatnonzero(keep)[1:], len(at)] - 1
    return first[keep], last[end], at[keep], hashes[keep]


def _common(x: bytes, y: bytes) -> int:
    """Length of the common prefix of two strings of one length."""
    differ = int.from_bytes(x) ^ int.from_bytes(y)
    return len(x) - (differ.bit_length() + 7) // 8


def blind_trie(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """(order, common): the sorted order of different strings of one length, and how much each shares with the one before.

    Inner nodes hold a depth and, by the character there, their children; a string is led down by these
    characters alone, held once against the leaf that it comes to, and hung in where they part.
    """
    root: list | int = 0
    for i in range(1, len(strings)):
        s, node = strings[i], root
        while isinstance(node, list):
            node = node[1].get(s[node[0]], node[2])
        depth = _common(s, strings[node])
        above, node = None, root
        while isinstance(node, list) and node[0] < depth:
            above, node = node, node[1][s[node[0]]]
        if isinstance(node, list) and node[0] == depth:
            node[1][s[depth]] = i
            continue
        leaf = node
        while isinstance(leaf, list):
            leaf = leaf[2]
        new = [depth, {strings[leaf][depth]: node, s[depth]: i}, leaf]
        if above is None:
            root = new
        else:
            above[1][s[above[0]]] = new
    order, common, stack = [], [], [(root, 0)]
    while stack:
        node, shared = stack.pop()
        if isinstance(node, list):
            chars = sorted(node[1])
            stack += [(node[1][c], node[0]) for c in reversed(chars[1:])]
            stack.append((node[1][chars[0]], shared))
        else:
            order.append(node)
            common.append(shared)
    return order, common


def deep_shallow(rows: np.ndarray, group: np.ndarray, known: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common) of rows of bytes within ascending groups: the sorted order, and how many bytes each shares with the one before (0 at a group's first).

    The first ``known`` bytes of a group's rows are mostly equal. Multikey quicksort takes eight bytes
    as one character, the pivot's three parts being runs of a sort; after SHALLOW bytes beyond the known
    ones, rows that are still together are put in order by a blind trie, equal rows as one.
    """
    n, width = rows.shape
    shallow = min(width, -(-(known + SHALLOW) // 8) * 8)
    order = np.arange(n)
    common = np.zeros(n, np.int64)
    chars = np.ascontiguousarray(rows[:, : shallow // 8 * 8]).view(">u8").astype(np.uint64)
    label = group.copy()  # rows that are equal so far
    for c in range(chars.shape[1]):
        char = chars[order, c]
        # most groups do not part here: only the others are sorted
        start = np.flatnonzero(np.r_[True, label[1:] != label[:-1]])
        differs = np.zeros(n, bool)
        differs[1:] = (char[1:] != char[:-1]) & (label[1:] == label[:-1])
        count = np.add.reduceat(differs, start) if n else np.zeros(0)
        mixed = np.repeat(count > 0, np.diff(np.r_[start, n]))
        if not mixed.any():
            continue
        spot = np.flatnonzero(mixed)
        by = np.lexsort((char[spot], label[spot]))
        order[spot] = order[spot][by]
        carried = common[spot]  # a group's first row keeps what it shares with the group before
        char = chars[order, c]
        new = np.zeros(n, bool)
        new[1:] = (char[1:] != char[:-1]) & (label[1:] == label[:-1])
        common[spot] = carried
        part = np.flatnonzero(new)
        xor = char[part] ^ char[part - 1]
        same = np.zeros(len(part), np.int64)
        for k in range(1, 8):
            same += (xor >> np.uint64(64 - 8 * k)) == 0
        common[part] = 8 * c + same
        label = np.cumsum(np.r_[True, (label[1:] != label[:-1]) | new[1:]]) if n else label
    start = np.flatnonzero(np.r_[True, label[1:] != label[:-1]]) if n else np.zeros(0, np.int64)
    end = np.r_[start[1:], n]
    for lo, hi in zip(start[end - start > 1].tolist(), end[end - start > 1].tolist(), strict=True):
        members: dict[bytes, list[int]] = {}
        for r in order[lo:hi].tolist():
            members.setdefault(rows[r].tobytes(), []).append(r)
        strings = list(members)
        by, shared = blind_trie(strings)
        spot = lo
        for s, k in zip(by, shared, strict=True):
            same = members[strings[s]]
            order[spot : spot + len(same)] = same
            if spot > lo:
                common[spot] = k
            common[spot + 1 : spot + len(same)] = width
            spot += len(same)
    return order, common


def repeated_offsets(texts: list[bytes], before: np.ndarray, runs: np.ndarray, often: np.ndarray, gram: np.ndarray, size: int) -> np.ndarray:
    """For stretches by ascending ``gram``: a row each, whether the window with o bytes before the anchor is repeated.

    ``texts`` are the stretches, ``before`` the bytes of each before its anchor, which is the most that
    one of its windows has before it, ``runs`` how many windows it has, ``often`` how many places have
    this very stretch.
    """
    n, deep = len(texts), size - GRAM
    right, left = np.full((n, -(-size // 8) * 8), 255, np.uint8), np.full((n, -(-max(deep, 1) // 8) * 8), 255, np.uint8)
    for i, (t, p) in enumerate(zip(texts, before.tolist(), strict=True)):
        b = np.frombuffer(t, np.uint8)
        right[i, : len(b) - p] = b[p:]
        left[i, :p] = b[:p][::-1]
    offsets = np.arange(deep + 1)
    # the windows of a stretch have from before - runs + 1 to before bytes in front of the anchor
    has = (offsets <= before[:, None]) & (offsets > (before - runs)[:, None])
    by_right, share_right = deep_shallow(right, gram, GRAM)
    by_left, share_left = deep_shallow(left, gram, 0)
    first = np.r_[True, gram[1:] != gram[:-1]] if n else np.zeros(0, bool)
    found = has & (often > 1)[:, None]
    at_right, at_left = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in offsets.tolist():
        at_right[by_right] = np.cumsum((share_right < size - o) | first)
        at_left[by_left] = np.cumsum((share_left < o) | first)
        asked = np.flatnonzero(has[:, o])
        if not len(asked):
            continue
        pair = at_right[asked] * (n + 1) + at_left[asked]
        _, back, count = np.unique(pair, return_inverse=True, return_counts=True)
        found[asked, o] |= count[back] > 1
    return found


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes of their texts, where each ends): about CHUNK bytes at a time, or one longer text."""
    for b in batches:
        data = b.column("data")
        offsets = np.frombuffer(data.buffers()[1], np.int64 if pa.types.is_large_binary(data.type) else np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
        whole = np.frombuffer(data.buffers()[2], np.uint8) if data.buffers()[2] is not None else np.zeros(0, np.uint8)
        lo = 0
        while lo < len(data):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK, "right")) - 1)
            yield b.slice(lo, hi - lo), whole[offsets[lo] : offsets[hi]], offsets[lo + 1 : hi + 1] - offsets[lo]
            lo = hi


def _halves(digest: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    got = np.frombuffer(b"".join(digest), ">i8").astype(np.int64).reshape(-1, 2)
    return got[:, 0], got[:, 1]


def _grams(docs: DataFrame, size: int) -> DataFrame:
    """(key, n): anchors' grams by hash, counted for each chunk of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, b, ends in _texts(batches):
            key, n = np.unique(anchors(b, ends, size)[3].view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])

    return docs.select("data").mapInArrow(run, "key long, n long")


def _stretches(docs: DataFrame, size: int, grams, wanted=None) -> DataFrame:
    """The stretches whose gram passes ``grams``: where they are, or, of those that pass ``wanted``, what they hold (once a task, if it can remember)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, some = grams.value, wanted.value if wanted else None
        seen: set[bytes] = set()
        for rows, b, ends in _texts(batches):
            first, last, at, h = anchors(b, ends, size)
            pick = np.flatnonzero(passes(held, h))
            first, last, at, key = first[pick], last[pick], at[pick], h[pick].view(np.int64)
            text = b.tobytes()
            md5 = [hashlib.md5(text[i : j + size]).digest() for i, j in zip(first.tolist(), last.tolist(), strict=True)]
            s1, s2 = _halves(md5)
            own = [key, s1, s2, (at - first).astype(np.int32), (last - first + 1).astype(np.int32)]
            if some is None:
                doc = np.searchsorted(ends, first, "right")
                begin = np.r_[0, ends[:-1]][doc]
                d1, d2 = (rows.column(c).to_numpy(zero_copy_only=False)[doc] for c in ("d1", "d2"))
                own += [d1, d2, (first - begin).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in own], ["key", "s1", "s2", "before", "runs", "d1", "d2", "first"])
            else:
                if len(seen) > 500_000:
                    seen.clear()
                new = []
                for i in np.flatnonzero(passes(some, s1)).tolist():
                    if md5[i] not in seen:
                        seen.add(md5[i])
                        new.append(i)
                yield pa.RecordBatch.from_arrays([*(pa.array(x[new]) for x in own), pa.array([text[first[i] : last[i] + size] for i in new], pa.binary())], ["key", "s1", "s2", "before", "runs", "bytes"])

    if wanted is None:
        return docs.select("data", "d1", "d2").mapInArrow(run, "key long, s1 long, s2 long, before int, runs int, d1 long, d2 long, first int")
    return docs.select("data").mapInArrow(run, "key long, s1 long, s2 long, before int, runs int, bytes binary")


_FOUND = "key long, s1 long, s2 long, froms array<int>, tos array<int>"


def _sorted_groups(held: DataFrame, size: int) -> DataFrame:
    """Of stretches with their bytes, grouped by gram: ranges of their windows that another stretch repeats, counted from the stretch's first window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            kept.append(b)
            rows += b.num_rows
            if rows < 8192:
                continue
            table = pa.Table.from_batches(kept).combine_chunks()
            key = table["key"].to_numpy()
            cut = int(np.searchsorted(key, key[-1], "left"))  # the last gram may go on in the next batch
            if cut:
                yield from compared(table.slice(0, cut))
                table = table.slice(cut)
            kept, rows = table.to_batches(), table.num_rows
        if rows:
            yield from compared(pa.Table.from_batches(kept).combine_chunks())

    def compared(table: pa.Table) -> Iterator[pa.RecordBatch]:
        names = ("key", "s1", "s2", "before", "runs", "often")
        key, s1, s2, before, runs, often = (table[c].to_numpy() for c in names)
        group = np.cumsum(np.r_[0, key[1:] != key[:-1]])
        got = repeated_offsets(table["bytes"].to_pylist(), before, runs, often, group, size)
        pick = np.flatnonzero(got.any(axis=1))
        got = got[pick, ::-1]  # from the stretch's first window, which has the most before its anchor
        edge = np.diff(np.pad(got.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        shift = (got.shape[1] - 1 - before[pick]).astype(np.int32)
        row, start = np.nonzero(edge == 1)
        end = np.nonzero(edge == -1)[1] - 1
        at = np.searchsorted(row, np.arange(len(pick) + 1)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(at), pa.array((x - shift[row]).astype(np.int32))) for x in (start, end)]
        yield pa.RecordBatch.from_arrays([pa.array(key[pick]), pa.array(s1[pick]), pa.array(s2[pick]), *lists], ["key", "s1", "s2", "froms", "tos"])

    return held.repartition("key").sortWithinPartitions("key", "s1", "s2").mapInArrow(run, _FOUND)


def _one_by_one(held: DataFrame, size: int) -> DataFrame:
    """What ``_sorted_groups`` gives, for grams with so many stretches that no task should hold them: each window's hash is counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                text, runs = b.column("bytes")[i].as_py(), b.column("runs")[i].as_py()
                w1, w2 = _halves([hashlib.md5(text[j : j + size]).digest() for j in range(runs)])
                same = [pa.array(np.full(runs, b.column(c)[i].as_py(), np.int64)) for c in ("key", "s1", "s2", "often")]
                yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(runs, dtype=np.int32)), pa.array(w1), pa.array(w2)], ["key", "s1", "s2", "often", "at", "w1", "w2"])

    windows = written(held.mapInArrow(run, "key long, s1 long, s2 long, often long, at int, w1 long, w2 long"), "windows")
    many = windows.groupBy(F.struct("w1", "w2").alias("w")).agg(F.sum("often").alias("places"), F.count("*").alias("rows")).where("places > 1")
    met = skew_join(windows.withColumn("w", F.struct("w1", "w2")), many, "w", "rows", windows.count(), "s1", "inner")
    one = met.groupBy("key", "s1", "s2").agg(F.array_sort(F.collect_list("at")).alias("ats"))
    return one.select("key", "s1", "s2", F.col("ats").alias("froms"), F.col("ats").alias("tos"))


def repeated_ranges(docs: DataFrame, size: int = 200, heavy: int = HEAVY) -> DataFrame:
    """(d1, d2, starts, ends): for each different text its ranges of bytes that repeated windows cover, unmerged. docs: (d1, d2, data), a row a place, the digest's halves and the bytes."""
    spark: SparkSession = docs.sparkSession
    grams = written(_grams(docs, size).groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key"), "grams")
    held = spark.sparkContext.broadcast(sieve(grams, "key"))
    places = _stretches(docs, size, held)
    # equal texts are one from here on, and count as often as they are there
    places = places.groupBy("d1", "d2", "first").agg(*[F.first(c).alias(c) for c in ("key", "s1", "s2", "runs", "before")], F.count("*").alias("often"))
    places = written(places, "stretches")
    kinds = places.groupBy("key", "s1", "s2").agg(F.sum("often").alias("often"), F.count("*").alias("places"))
    kinds = written(kinds, "kinds")
    several = kinds.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1")
    met = written(kinds.join(several, "key").select("key", "s1", "s2", "often", "kinds"), "several")
    wanted = spark.sparkContext.broadcast(sieve(met, "s1"))
    bytes_of = _stretches(docs, size, held, wanted).groupBy("key", "s1", "s2").agg(*[F.first(c).alias(c) for c in ("before", "runs", "bytes")])
    full = met.join(bytes_of, ["key", "s1", "s2"])
    if met.where(F.col("kinds") > heavy).isEmpty():
        found = _sorted_groups(full.drop("kinds"), size)
    else:
        full = written(full, "bytes")
        found = _sorted_groups(full.where(F.col("kinds") <= heavy).drop("kinds"), size).unionByName(_one_by_one(full.where(F.col("kinds") > heavy), size))
    # a stretch that has two places is repeated as a whole
    alone = found.join(kinds.where("often = 1"), ["key", "s1", "s2"]).select("key", "s1", "s2", "places", "froms", "tos")
    every = kinds.where("often > 1").select("key", "s1", "s2", "places", F.lit(None).cast("array<int>").alias("froms"), F.lit(None).cast("array<int>").alias("tos"))
    every = written(every.unionByName(alone), "repeated")
    k = F.struct("key", "s1", "s2").alias("k")
    met = skew_join(places.select(k, "d1", "d2", "first", "runs"), every.select(k, "places", F.struct("froms", "tos").alias("found")), "k", "places", places.count(), "first", "inner")
    start = F.when(F.col("found.froms").isNull(), F.array("first")).otherwise(F.transform("found.froms", lambda x: x + F.col("first")))
    end = F.when(F.col("found.tos").isNull(), F.array(F.col("first") + F.col("runs") - 1 + size)).otherwise(F.transform("found.tos", lambda x: x + F.col("first") + size))
    return met.groupBy("d1", "d2").agg(F.flatten(F.collect_list(start)).alias("starts"), F.flatten(F.collect_list(end)).alias("ends"))


def _merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    if not len(starts):
        return []
    by = np.argsort(starts, kind="stable")
    starts, reach = starts[by], np.maximum.accumulate(ends[by])
    new = np.flatnonzero(np.r_[True, starts[1:] > reach[:-1]])
    return list(zip(starts[new].tolist(), reach[np.r_[new[1:], len(starts)] - 1].tolist(), strict=True))


def _cut(data: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
    kept, spans = [], []
    for b, s, e in zip(data, starts, ends, strict=True):
        runs = _merged(np.asarray(s, np.int64), np.asarray(e, np.int64))
        at, pieces = 0, []
        for lo, hi in runs:
            pieces.append(b[at:lo])
            at = hi
        kept.append(b"".join([*pieces, b[at:]]))
        spans.append([{"start": lo, "end": hi} for lo, hi in runs])
    return pd.DataFrame({"kept": kept, "spans": spans})


def without_repeats(docs: DataFrame, size: int = 200, text_col: str = "text", heavy: int = HEAVY) -> DataFrame:
    """``docs`` with the columns kept (binary) and spans (array of start, end): bytes under any ``size`` bytes that start more than once are removed.

    Every occurrence goes, the first as well, wherever the others are: in another row, in a row with the
    same id or text, or in the same text, overlaps included. What repeats is judged on the texts as they
    are given, and matches never cross rows. Spans are the maximal removed runs. A null text is
    empty; texts shorter than ``size`` keep all. Other columns stay, ids are not looked at, and columns
    named kept or spans are replaced. An empty table stays empty. A cut may fall inside a character, so
    what is kept is binary.

    A task holds a text, and the ``heavy`` stretches of one gram at most; larger groups are split by window.
    """
    if size <= GRAM:
        raise ValueError(f"size must be over {GRAM}")
    data = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    halves = [F.conv(F.substring(F.md5(data), i, 16), 16, -10).cast("long") for i in (1, 17)]
    long = F.octet_length(data) >= size
    ranges = repeated_ranges(docs.where(long).select(data.alias("data"), halves[0].alias("d1"), halves[1].alias("d2")), size, heavy)
    rows = docs.select(F.struct("*").alias("row"), data.alias("data"), *[F.when(long, h).alias(c) for h, c in zip(halves, ("e1", "e2"), strict=True)])
    met = rows.join(ranges, (F.col("e1") == F.col("d1")) & (F.col("e2") == F.col("d2")), "left")
    cut = F.pandas_udf(_cut, "kept binary, spans array<struct<start: int, end: int>>")("data", F.coalesce("starts", F.array().cast("array<int>")), F.coalesce("ends", F.array().cast("array<int>")))
    others = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("kept", "spans")]
    return met.withColumn("cut", cut).select(*others, F.col("cut.kept").alias("kept"), F.col("cut.spans").alias("spans"))
