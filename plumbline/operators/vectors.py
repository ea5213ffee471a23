"""Vectors: exact nearest neighbours by blocks that pivots bound, agreement between views, separation of classes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.numeric import ratio
from plumbline.operators.graphs import settled

PIVOTS, RINGS, BLOCK = 64, 8, 2048
#: Bytes of vectors that one side of a product across cells holds at most; a vector is sent once for each such lot.
LOT = 2**24
#: Cosines are compared at so many decimals, so that equal vectors tie in every block and in every engine.
DECIMALS = 12
#: What rounding may add to a distance between unit vectors whose cosines are equal at DECIMALS.
SLACK = 1e-5


def unit(vector: str) -> Column:
    """The vector as doubles of length one; NULL if it is NULL, zero, or holds NULL or what is not finite."""
    # an expression inside a lambda is made anew for every number, so the length is bound first, as the one item of an array
    bound = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))
    length = lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))
    over = lambda x: bound(length(x), lambda n: F.when((n > 0) & (n < float("inf")), F.transform(x, lambda v: v / n)))
    return bound(F.transform(vector, lambda v: v.cast("double")), over)


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _nearest(queries: pd.DataFrame, members: pd.DataFrame, apart: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """For each query the best cosine (rounded) among members of another id, and the smallest id that has it; NaN without one. Members are held a block at a time, queries in slices of it. ``apart``: no query is among the members."""
    m = members.sort_values("id", kind="stable")
    have, theirs = np.stack(m["u"].to_numpy()), m["id"].to_numpy()
    score, near = np.full(len(queries), np.nan), np.empty(len(queries), object)
    for at in range(0, len(queries), BLOCK):
        part = queries.iloc[at : at + BLOCK]
        cos = np.stack(part["u"].to_numpy()) @ have.T
        if not apart:
            cos[part["id"].to_numpy()[:, None] == theirs[None, :]] = -np.inf
        top = cos.max(axis=1)
        # what may be equal to the best once it is rounded; then the first of equals, so the smallest id
        row, col = np.nonzero(cos >= top[:, None] - 2 * 10.0**-DECIMALS)
        top = np.round(top, DECIMALS)
        same = np.round(cos[row, col], DECIMALS) == top[row]
        row, first = np.unique(row[same], return_index=True)
        best = np.zeros(len(part), int)
        best[row] = col[same][first]
        ok = np.isfinite(top)
        score[at : at + len(part)][ok] = top[ok]
        near[at : at + len(part)][ok] = theirs[best[ok]]
    return score, near


def nearest_vectors(rows: DataFrame, keys: list[str], item: str, vector: str, pivots: int | None = None) -> DataFrame:
    """(keys, item, nearest, cosine, blocks, opened): the item of the same keys with the largest cosine, ties to the smallest; exact.

    An item is unique by (keys, item), vectors are of one length; those without a direction (see ``unit``) take no
    part, and an item without another has NULLs. Vectors go to the nearest of ``pivots`` vectors drawn by hash (if it
    is None, one for BLOCK / 8 rows, PIVOTS at most), from there, where it has more than BLOCK, to one of RINGS rings
    of distance, and there to parts of about BLOCK rows. A first pass finds the nearest in
    the own block; by the triangle inequality only cells within that distance are opened then. blocks says how
    many there are for the keys, opened how many of them the item was held against. Neither side of a product is
    larger than a few blocks, however many vectors a cell or its visitors have. On vectors without structure few
    cells can be left out, and the work is that of all pairs.
    """
    if not keys or set(keys) & {"id", "u", "pivot", "ring", "part", "r", "far", "salt", "cuts", "rows", "parts", "cells", "blocks", "score", "near", "n", "lot", "slot", "slots", "opened", "lo", "hi", "c", "salts", "reach"}:
        raise ValueError("keys are needed, and not by names that the blocks use")
    kind = _type(rows, item)
    placed = rows.select(*keys, F.col(item).alias("id"), unit(vector).alias("u")).where("u IS NOT NULL AND id IS NOT NULL")
    many = pivots or max(1, min(PIVOTS, 8 * placed.count() // BLOCK))
    drawn = placed.orderBy(F.xxhash64("id", *keys), "id", *keys).limit(many).select("u").collect()
    names = ", ".join(f"`{k}` {_type(rows, k)}" for k in keys)
    base = f"{names}, id {kind}, u array<double>"
    if not drawn:
        return rows.sparkSession.createDataFrame([], f"{names}, `{item}` {kind}, nearest {kind}, cosine double, blocks long, opened long")
    corners = np.array([r.u for r in drawn])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            far = np.sqrt(np.maximum(0.0, 2 - 2 * np.stack(b["u"].to_numpy()) @ corners.T)) if len(b) else np.zeros((0, len(corners)))
            own = far.argmin(axis=1)
            yield b.assign(far=list(far), pivot=own.astype(np.int32), r=far[np.arange(len(b)), own])

    placed = settled(placed.mapInPandas(place, base + ", far array<double>, pivot int, r double"))
    cuts = placed.groupBy(*keys, "pivot").agg(F.percentile_approx("r", [k / RINGS for k in range(1, RINGS)], 1000).alias("cuts"), F.count("*").alias("rows"))
    ring = F.when(F.col("rows") <= BLOCK, 0).otherwise(F.size(F.filter("cuts", lambda c: c < F.col("r"))))
    ringed = placed.join(cuts, [*keys, "pivot"]).withColumn("ring", ring).drop("cuts", "rows")
    cells = settled(ringed.groupBy(*keys, "pivot", "ring").agg(F.ceil(F.count("*") / BLOCK).alias("parts"), F.min("r").alias("lo"), F.max("r").alias("hi")))
    cell = [*keys, "pivot", "ring"]
    # parts of cells that lie beside each other make a lot, which a query is sent to once with the parts that it asks for
    most = max(BLOCK, min(LOT // (8 * corners.shape[1]), placed.count() // 8))
    part = F.pmod(F.xxhash64("id"), F.col("parts")).alias("part")
    members = settled(ringed.join(cells.select(*cell, "parts"), cell).select(*keys, "id", "u", "far", "pivot", "ring", part))

    def inside(block: pd.DataFrame) -> pd.DataFrame:
        score, near = _nearest(block, block)
        return block.assign(score=score, near=near)

    shape = f"{base}, far array<double>, pivot int, ring int, part long, score double, near {kind}"
    first = settled(members.select(*keys, "id", "u", "far", "pivot", "ring", "part").groupBy(*cell, "part").applyInPandas(inside, shape).withColumn("score", F.nanvl("score", F.lit(None))))
    sized = members.groupBy(*cell, "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*keys).orderBy("pivot", "ring", "part")) - F.col("n")
    lots = settled(sized.select(*cell, "part", F.floor(before / most).alias("lot"), F.row_number().over(Window.partitionBy(*keys).orderBy("pivot", "ring", "part")).alias("slot")))
    edge = lots.join(cells, cell)
    about = edge.groupBy(*keys).agg(F.collect_list(F.struct("pivot", "ring", "part", "lo", "hi", "lot", "slot")).alias("cells"), F.count("*").alias("blocks"))
    reach = F.when(F.col("score").isNull(), 2.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("score")))) + SLACK
    away = lambda c: F.greatest(F.get("far", c["pivot"]) - c["hi"], c["lo"] - F.get("far", c["pivot"]))
    home = lambda c: (c["pivot"] == F.col("pivot")) & (c["ring"] == F.col("ring")) & (c["part"] == F.col("part"))
    asked = first.withColumn("reach", reach).join(about, keys).select(*keys, "id", "u", F.filter("cells", lambda c: (away(c) <= F.col("reach")) & ~home(c)).alias("c"))
    asked = settled(asked.select(*keys, "id", "u", "c", F.explode(F.array_distinct("c.lot")).alias("lot")).select(*keys, "id", "u", "lot", F.transform(F.filter("c", lambda c: c["lot"] == F.col("lot")), lambda c: c["slot"]).alias("slots")))
    salts = asked.groupBy(*keys, "lot").agg(F.ceil(F.count("*") / most).alias("salts"))
    ask = asked.join(salts, [*keys, "lot"]).select(*keys, "lot", "id", "u", "slots", F.pmod(F.xxhash64("id"), F.col("salts")).alias("salt"))
    give = members.join(lots, [*cell, "part"]).join(salts, [*keys, "lot"]).select(*keys, "lot", "slot", "id", "u", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))

    def across(q: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        score, near = np.full(len(q), np.nan), np.empty(len(q), object)
        wants = [np.asarray(x) for x in q["slots"]]
        row, slot = np.repeat(np.arange(len(q)), [len(x) for x in wants]), np.concatenate(wants) if wants else np.zeros(0, int)
        for k, block in m.groupby("slot"):
            at = row[slot == k]
            if len(at):
                s, n = _nearest(q.iloc[at], block, apart=True)
                better = np.isnan(score[at]) | (s > score[at]) | ((s == score[at]) & np.array([a is not None and b is not None and a < b for a, b in zip(n, near[at], strict=True)], bool))
                score[at[better]], near[at[better]] = s[better], n[better]
        return q[[*keys, "id"]].assign(score=score, near=near, opened=[len(x) for x in wants])

    group = [*keys, "lot", "salt"]
    second = ask.groupBy(*group).cogroup(give.groupBy(*group)).applyInPandas(across, f"{names}, id {kind}, score double, near {kind}, opened long")
    both = first.select(*keys, "id", "score", "near", F.lit(1).cast("long").alias("opened")).unionByName(second.select(*keys, "id", F.nanvl("score", F.lit(None)).alias("score"), "near", "opened"))
    best = F.min(F.when(F.col("score").isNotNull(), F.struct((-F.col("score")).alias("s"), "near"))).alias("best")
    found = both.groupBy(*keys, "id").agg(best, F.sum("opened").alias("opened")).join(about.drop("cells"), keys)
    return found.select(*keys, F.col("id").alias(item), F.col("best.near").alias("nearest"), (-F.col("best.s")).alias("cosine"), "blocks", "opened")


def view_agreement(rows: DataFrame, view: str, item: str, vector: str) -> DataFrame:
    """(view_a, view_b, items, mean_cosine, stability) of each two views: the mean cosine of an item with itself, and the share of items whose nearest other item is the same in both (NULL if none has one). Items that a view lacks do not count there."""
    near = nearest_vectors(rows, [view], item, vector).select(F.col(view).alias("v"), F.col(item).alias("i"), "nearest")
    one = rows.select(F.col(view).alias("v"), F.col(item).alias("i"), unit(vector).alias("u")).where("u IS NOT NULL").join(near, ["v", "i"])
    a = one.select("i", F.col("v").alias("view_a"), F.col("u").alias("ua"), F.col("nearest").alias("na"))
    b = one.select("i", F.col("v").alias("view_b"), F.col("u").alias("ub"), F.col("nearest").alias("nb"))
    cosine = F.aggregate(F.zip_with("ua", "ub", lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    pairs = a.join(b, "i").where("view_a < view_b")
    return pairs.groupBy("view_a", "view_b").agg(F.count("*").alias("items"), F.avg(cosine).alias("mean_cosine"), F.avg((F.col("na") == F.col("nb")).cast("double")).alias("stability"))


def class_separation(rows: DataFrame, view: str, item: str, label: str, vector: str, pairs: list[tuple], decimals: int = 4) -> DataFrame:
    """(view, class_a, class_b, same, cross, auc): how well the cosine tells two of class a from one of each; NULL without both kinds of pairs.

    The measure is over all pairs of a view. They are made in tasks, block against block of about BLOCK vectors,
    and leave them as counts by cosine at ``decimals`` decimals (so ties there count half): what is shuffled are
    vectors once for each block they meet, and at most 2 * 10^decimals + 1 counts for each two blocks.
    """
    kind = _type(rows, label)
    wanted = rows.sparkSession.createDataFrame([(a, b) for a, b in pairs], f"a {kind}, b {kind}")
    one = rows.select(F.col(view).alias("view"), F.col(item).alias("id"), F.col(label).alias("label"), unit(vector).alias("u")).where("u IS NOT NULL")
    parts = one.groupBy("view", "label").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    dealt = one.join(parts, ["view", "label"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    # class a against itself: parts p <= q; class a against b: every part of the one with every part of the other
    count = lambda c: parts.select("view", F.col("label").alias(c), F.col("parts").alias(f"n{c}"))
    span = wanted.join(count("a"), "a").join(count("b"), ["b", "view"], "left").fillna(0, ["nb"])
    of_a = dealt.withColumnRenamed("label", "a").join(span, ["view", "a"])
    of_b = dealt.withColumnRenamed("label", "b").join(span, ["view", "b"])
    zero = F.lit(0).cast("long")
    laid = lambda d, alike, p, q: d.select("view", "a", "b", "id", "u", F.lit(alike).alias("alike"), p.alias("p"), "part", "na", "nb").select("view", "a", "b", "id", "u", "alike", "p", q.alias("q"))
    part = F.col("part")
    left = laid(of_a, True, part, F.explode(F.sequence(part, F.col("na") - 1)))
    left = left.unionByName(laid(of_a.where("nb > 0"), False, part, F.explode(F.sequence(zero, F.col("nb") - 1))))
    right = laid(of_a, True, F.explode(F.sequence(zero, part)), part)
    right = right.unionByName(laid(of_b, False, F.explode(F.sequence(zero, F.col("na") - 1)), part))
    right = right.toDF(*right.columns)  # attributes of its own, since both sides come from one table
    scale = 10**decimals

    def counted(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"view": [], "a": [], "b": [], "alike": [], "score": [], "n": []})
        cos = np.stack(x["u"].to_numpy()) @ np.stack(y["u"].to_numpy()).T
        at = np.rint(cos * scale).astype(np.int64)
        if x["alike"].iloc[0] and x["p"].iloc[0] == x["q"].iloc[0]:
            at = at[x["id"].to_numpy()[:, None] < y["id"].to_numpy()[None, :]]
        s, n = np.unique(at, return_counts=True)
        same = {k: pd.Series([x[k].iloc[0]] * len(s), dtype=object) for k in ("view", "a", "b", "alike")}
        return pd.DataFrame(same | {"score": s, "n": n})

    group = ["view", "a", "b", "alike", "p", "q"]
    shape = f"view {_type(rows, view)}, a {kind}, b {kind}, alike boolean, score long, n long"
    got = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(counted, shape)
    steps = got.groupBy("view", "a", "b", "score").agg(F.sum(F.when(F.col("alike"), F.col("n")).otherwise(0)).alias("s"), F.sum(F.when(F.col("alike"), 0).otherwise(F.col("n"))).alias("c"))
    totals = steps.groupBy("view", "a", "b").agg(F.sum("s").alias("same"), F.sum("c").alias("cross"), F.sort_array(F.collect_list(F.struct("score", "s", "c"))).alias("steps"))
    # pairs of unlike classes below each score, along at most 2 * 10^decimals + 1 steps
    fold = F.aggregate("steps", F.struct(F.lit(0.0).alias("won"), F.lit(0.0).alias("below")), lambda acc, t: F.struct((acc["won"] + t["s"] * (acc["below"] + t["c"] / 2)).alias("won"), (acc["below"] + t["c"]).alias("below")))
    auc = ratio(fold["won"], F.col("same").cast("double") * F.col("cross"))
    return totals.select(F.col("view").alias(view), F.col("a").alias("class_a"), F.col("b").alias("class_b"), "same", "cross", auc.alias("auc"))
