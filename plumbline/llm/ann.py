"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots, in order. Each block of vectors posts its members in
one inverted file for each pivot, with the place that the pivot has in their order. A query reads the
files of its own pivots and adds up what they say about the footrule distance of the orders; the
closest share of the block is then measured exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import written

#: Pivots, a bounded sample of the vectors; how many of them an order keeps; vectors of a block; share of a block that is measured, and the fewest.
PIVOTS, ORDER, BLOCK, SHARE, LEAST = 256, 64, 8192, 0.1, 800


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec): rows with an id and a finite vector that is not zero, of the dimension that most such rows have (ties: the smaller)."""
    inf = float("inf")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where(F.col("id").isNotNull())
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)) & F.exists("vec", lambda x: x != 0)
    rows = rows.where(fine)
    size = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").select("n").first()
    return rows.where(F.size("vec") == (size.n if size else 0))


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """(vec, ids): each different vector with its ``keep`` smallest ids. A hot vector's ids are cut down in parts of about 10,000 first."""
    parts = max(1, rows.count() // 10_000)
    lowest = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, keep)
    part = rows.groupBy("vec", F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part")).agg(lowest(F.collect_list("id")).alias("ids"))
    return part.groupBy("vec").agg(lowest(F.flatten(F.collect_list("ids"))).alias("ids"))


class Block:
    """The inverted files of one block."""

    def __init__(self, vecs: np.ndarray, ids: list[np.ndarray], pivots: np.ndarray):
        self.vecs, self.ids, self.pivots = vecs.astype(np.float64), ids, pivots
        self.norm = np.sqrt((self.vecs**2).sum(axis=1))
        order = self.orders(vecs)
        self.depth = order.shape[1]
        # a pivot's file has a number for each member: what its place in the member's order is worth, 0 if it is not in it
        self.file = np.zeros((len(pivots), len(vecs)), np.int16)
        for place in range(self.depth):
            self.file[order[:, place], np.arange(len(vecs))] = self.depth - place
        self.measured = max(LEAST, int(np.ceil(SHARE * len(vecs))))

    def orders(self, vecs: np.ndarray) -> np.ndarray:
        """The nearest pivots of each vector, nearest first, by cosine."""
        near = (vecs / np.linalg.norm(vecs.astype(np.float64), axis=1, keepdims=True)) @ self.pivots.T
        return np.argsort(-near, axis=1, kind="stable")[:, :ORDER]

    def search(self, query: np.ndarray, order: np.ndarray, own: int, k: int) -> list[tuple[int, float]]:
        """The k nearest of those measured, ties to smaller ids; all that tie at either cut are taken in."""
        # An order without a pivot has it at place len(order). The footrule distance falls by twice the smaller weight for each pivot in both orders.
        shared, held = np.zeros(len(self.vecs), np.int16), np.empty(len(self.vecs), np.int16)
        for place, p in enumerate(order.tolist()):
            shared += np.minimum(self.file[p], np.int16(len(order) - place), out=held)
        pick = np.arange(len(shared))
        if self.measured < len(shared):
            pick = np.flatnonzero(shared >= np.partition(shared, -self.measured)[-self.measured])
        q = query.astype(np.float64)
        if len(pick) > k + 1:
            # a fast product leaves those that rounding could bring among the nearest
            near = (self.vecs[pick] @ q) / self.norm[pick]
            cut = np.partition(near, -(k + 1))[-(k + 1)]
            pick = pick[near >= cut - 1e-9 * np.sqrt((q**2).sum())]
        score = (self.vecs[pick] * q).sum(axis=1) / (self.norm[pick] * np.sqrt((q**2).sum()))
        found = sorted((-s, i) for x, s in zip(pick.tolist(), score.tolist(), strict=True) for i in self.ids[x].tolist() if i != own)
        return [(i, -s) for s, i in found[:k]]


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the k nearest of all rows to each row of ``queries`` but itself, by cosine in double precision.

    Both tables have id and vector. Rows whose id or vector is null, and vectors that are zero, not
    finite or of another dimension than most, take no part. Equal vectors are one entry of the index
    with their k + 1 smallest ids, which is all that can be among the nearest; ties go to the smaller
    id. Queries meet the data block by block, in tasks that hold one block and a batch of queries; no
    task or row holds all. Fewer candidates than k give all of them. Empty tables give no rows. The
    fitted sample is PIVOTS different vectors by hash; every row is indexed.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col)
    data = written(distinct_vectors(rows, k + 1), "vectors")
    asked = usable(queries, id_col, vec_col).dropDuplicates(["id", "vec"])
    sample = data.orderBy(F.xxhash64("vec"), F.col("ids")[0]).limit(PIVOTS).collect()
    n = data.count()
    schema = "query_id long, id long, score double"
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    pivots = np.array([r.vec for r in sample], np.float64)
    pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
    blocks = -(-n // BLOCK)
    posted = data.select(F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(blocks)).cast("long").alias("block"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), "vec", "ids")
    met = asked.where(F.size("vec") == pivots.shape[1]).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.lit(1).alias("kind"), "id", "vec", F.array().cast("array<long>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ready = None, [], None
        for b in batches:
            block, kind = (b.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            edge = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (kind[1:] != kind[:-1]), True])
            for lo, hi in zip(edge, edge[1:], strict=False):
                part = b.slice(lo, hi - lo)
                vecs = np.stack(part.column(3).to_numpy(zero_copy_only=False))
                if block[lo] != now:
                    now, held, ready = block[lo], [], None
                if kind[lo] == 0:
                    held.append((vecs, part.column(4).to_numpy(zero_copy_only=False)))
                    continue
                if not held:
                    continue
                if ready is None:
                    ready = Block(np.concatenate([v for v, _ in held]), [i for _, ids in held for i in ids], pivots)
                ids = part.column(2).to_pylist()
                got = [(q, i, s) for q, v, o in zip(ids, vecs, ready.orders(vecs), strict=True) for i, s in ready.search(v, o, q, k)]
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in got], t) for c, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.float64()))], ["query_id", "id", "score"])

    best = posted.unionByName(met).repartition("block").sortWithinPartitions("block", "kind").mapInArrow(run, schema)
    best = best.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
