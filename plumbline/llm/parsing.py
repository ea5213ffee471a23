"""Document fingerprints by locally consistent parsing.

A text is a row of symbols. Runs of one symbol become one symbol; deterministic coin tossing then
gives each a small label that depends on a few symbols before it only, and the local maxima of the
labels cut the row into short blocks. A block's name is a hash of what it holds, and the names are the
next level's symbols. Equal substrings are therefore cut alike but for a few symbols at their ends,
whatever their offset, and share the names of all phrases inside. The fingerprint keeps the smallest
hashes of the phrase names of the second level and above.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import doc_frame, slices

#: Hashes that a fingerprint keeps, the first level whose names it uses, and rounds of coin tossing that bring 64-bit names to labels under six.
KEEP, FIRST_LEVEL, TOSSES = 32, 2, 4
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    return (x ^ (x >> np.uint64(29))) * _A


def blocks(sym: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cut the rows of symbols into blocks: names and owners of the next level."""
    first = np.r_[True, doc[1:] != doc[:-1]]
    new = first.copy()
    new[1:] |= sym[1:] != sym[:-1]
    if not new.all():
        run = np.flatnonzero(new)
        n = np.diff(np.r_[run, len(sym)])
        sym, doc, first = sym[run], doc[run], first[run]
        many = np.flatnonzero(n > 1)
        sym[many] = _mix(sym[many] + _B * n[many].astype(np.uint64))
    label = sym.astype(np.uint32)
    for _ in range(TOSSES):
        one = label.dtype.type(1)
        differ = label.copy()
        differ[1:] ^= label[:-1]
        low = differ & (~differ + one)
        toss = np.bitwise_count(low - one)  # its number; 32 if the low halves of two names agree
        toss += toss
        toss |= (label & low) != 0
        toss[first] = label[first] & one
        label = toss
    start = first.copy()
    if len(label) > 2:
        start[1:-1] |= (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:]) & ~(first[2:] | first[:-2])
    at = np.flatnonzero(start)
    # a block's name is a polynomial in its symbols, from prefix sums: the power that its place brings is divided out
    power, inverse = _powers(1 << max(16, len(sym).bit_length()))
    total = np.r_[np.uint64(0), np.cumsum(sym * power[: len(sym)])]
    return _mix((total[np.r_[at[1:], len(sym)]] - total[at]) * inverse[at]), doc[at]


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    back = np.uint64(pow(int(_A), -1, 1 << 64))
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, _A, np.uint64)), np.cumprod(np.full(n, back, np.uint64))


def sketches(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash): the KEEP smallest different hashes of each text's phrase names, ascending. An empty text has none."""
    with np.errstate(over="ignore"):
        out = [_sketch(texts[a:b], a) for a, b in slices(texts, 1 << 17)]
    return (np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])) if out else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _sketch(texts: list[str], base: int) -> tuple[np.ndarray, np.ndarray]:
    sym = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.fromiter(map(len, texts), np.int64, len(texts)))
    keys, level = [], 0
    while len(sym):
        sym, doc = blocks(sym, doc)
        level += 1
        edge = doc[1:] != doc[:-1]
        only = np.r_[True, edge] & np.r_[edge, True]
        take = slice(None) if level >= FIRST_LEVEL else only
        keys.append(doc[take].astype(np.uint64) << np.uint64(32) | sym[take] >> np.uint64(32))
        if only.any():
            sym, doc = sym[~only], doc[~only]
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    key = np.sort(np.concatenate(keys))
    key = key[np.r_[True, key[1:] != key[:-1]]]
    doc = (key >> np.uint64(32)).astype(np.int64)
    at = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    keep = np.arange(len(key)) - np.repeat(at, np.diff(np.r_[at, len(key)])) < KEEP
    return doc[keep] + base, key[keep] & np.uint64(0xFFFFFFFF)


def as_text(n: int, doc: np.ndarray, value: np.ndarray) -> list[str]:
    """Fingerprints as text: eight hex digits for each hash."""
    digits = value.astype(">u4").tobytes().hex()
    edge = (8 * np.searchsorted(doc, np.arange(n + 1))).tolist()
    return [digits[a:b] for a, b in zip(edge, edge[1:], strict=False)]


def likeness(n: int, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Share of phrases in common, for n pairs of sketches: of the KEEP smallest hashes of both together, those that both have. Two without any are alike."""
    key = np.sort(np.concatenate([d.astype(np.uint64) << np.uint64(32) | v for d, v in (a, b)]))
    first = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    both = np.diff(np.r_[at, len(key)]) > 1
    doc = (key[at] >> np.uint64(32)).astype(np.int64)
    rank = np.arange(len(doc)) - np.searchsorted(doc, np.arange(n))[doc]
    count = np.minimum(np.bincount(doc, minlength=n), KEEP)
    common = np.bincount(doc[both & (rank < KEEP)], minlength=n)
    return np.where(count > 0, common / np.maximum(count, 1), 1.0)


def edited(text: str, following: str) -> str:
    """The text, its last quarter replaced by the beginning of the following text."""
    n = len(text)
    return text[: n - n // 4] + following[: n // 4]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) per row. Null texts are empty, with an empty fingerprint; rows and ids may repeat; further columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(as_text(len(texts), *sketches(texts)), pa.string())], ["id", "fingerprint"])

    return doc_frame(docs, id_col, text_col).mapInArrow(run, "id long, fingerprint string")


def _place() -> Column:
    """A text that sorts as (id, MD5 of the text) does, null ids first."""
    number = F.concat(F.lit("1"), F.lpad(F.hex(F.col("id").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))
    return F.concat(F.coalesce(number, F.lit("0")), F.md5("text"))


def with_following(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows dealt into ascending ranges of places, each sorted, and after each range's last row a copy of the first row of the next (after the last, of the first).

    (id, text, range, ahead): ahead is 1 for the copies. The order is that of ids, of equal ids that of
    their texts' MD5; null ids come first, so that they and equal ids are spread like others. Spark's
    range partitioner finds the ranges from the places alone; the driver sees the first place of each,
    49 characters, and the tasks look places up by bisection.
    """
    base = doc_frame(docs, id_col, text_col).withColumn("place", _place())
    spark = docs.sparkSession
    parts = 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = base.select("place").repartitionByRange(parts, "place").groupBy(F.spark_partition_id().alias("k")).agg(F.min("place").alias("place"))
    first = sorted(r.place for r in ranged.collect())
    bounds = np.array(first or [""])

    @F.pandas_udf("int")
    def range_of(place: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, place.to_numpy(str), "right") - 1)

    # one row for each range, a number that the table does not change
    ends = spark.createDataFrame([(x, (k - 1) % len(first)) for k, x in enumerate(first)], "place string, range int")
    copies = base.join(F.broadcast(ends), "place").groupBy("place", "range").agg(F.min("id").alias("id"), F.min("text").alias("text"))
    both = base.withColumn("range", range_of("place")).withColumn("ahead", F.lit(0)).unionByName(copies.withColumn("ahead", F.lit(1)))
    return both.repartition("range").sortWithinPartitions("range", "ahead", "place").select("id", "text", "range", "ahead")


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id, text length, edited text's SHA-256, both fingerprints, likeness to the edited text and to the next document).

    The edited text has its last quarter replaced by the beginning of the next document in the order of
    ids (equal ids: of their texts' MD5; null ids first; after the last comes the first). Whole texts are moved
    once, to the range of their id; a task holds one batch of them. Null texts are empty. A table of
    one row is followed by itself; an empty one gives no rows; further columns are ignored.
    """
    from hashlib import sha256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple | None = None
        for b in batches:
            ids, texts, where, ahead = (c.to_pylist() for c in b.columns)
            if kept:
                ids, texts, where, ahead = ([k, *x] for k, x in zip(kept, (ids, texts, where, ahead), strict=True))
            kept = ids[-1], texts[-1], where[-1], ahead[-1]
            own = [k for k in range(len(ids) - 1) if not ahead[k]]
            if not own:
                continue
            changed = [edited(texts[k], texts[k + 1]) for k in own]
            doc, value = sketches(texts)
            now, new = as_text(len(texts), doc, value), sketches(changed)
            edge = np.searchsorted(doc, np.arange(len(texts) + 1))

            def rows(which, doc=doc, value=value, edge=edge):
                n = edge[which + 1] - edge[which]
                at = np.repeat(edge[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                return np.repeat(np.arange(len(which)), n), value[at]

            which = np.array(own)
            mine = rows(which)
            yield pa.RecordBatch.from_pydict({"id": pa.array([ids[k] for k in own], pa.int64()), "n_chars": pa.array([len(texts[k]) for k in own], pa.int64()), "edited_sha256": [sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], "fingerprint": [now[k] for k in own], "edited_fingerprint": as_text(len(own), *new), "near_edited": likeness(len(own), mine, new), "near_next": likeness(len(own), mine, rows(which + 1))})

    return with_following(docs, id_col, text_col).select("id", "text", "range", "ahead").mapInArrow(run, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
