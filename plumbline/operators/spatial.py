"""Spatial joins by cells and bands, interpolation, traces, skylines. Every distance join is an equi-join on a cell with a residual test."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.numeric import angle_degrees, angle_distance, dot, finite, norm, ratio, wrapped
from plumbline.operators.graphs import settled, stored, united


def _renamed(df: DataFrame, suffix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(c + suffix) for c in df.columns])


def banded_pairs(points: DataFrame, frame: str, key: str, band: str, width: float) -> DataFrame:
    """All pairs key1 < key2 of a frame whose ``band`` values differ by ``width`` at most, columns suffixed 1 and 2: each row meets its own band and the next."""
    b = F.floor(F.col(band) / width).cast("long")
    left = _renamed(points, "1").withColumn("__b", F.explode(F.array(F.floor(F.col(band + "1") / width).cast("long") + F.lit(-1), F.floor(F.col(band + "1") / width).cast("long"), F.floor(F.col(band + "1") / width).cast("long") + F.lit(1))))
    right = _renamed(points.withColumn("__b", b), "2").withColumnRenamed("__b2", "__b")
    on = left.join(right, (left["__b"] == right["__b"]) & (left[frame + "1"] == right[frame + "2"])).drop("__b")
    return on.where((F.col(key + "1") < F.col(key + "2")) & (F.abs(F.col(band + "1") - F.col(band + "2")) <= width))


def ray_order(points: DataFrame, tolerance: float, gap: int, sector: float, margin: float) -> DataFrame:
    """Pairs at like height and angle with labels ``gap`` apart: inner has the smaller label; inverted if its radius is larger by more than ``margin``. points: frame, id, z, theta, r, w."""
    p = banded_pairs(points.select("frame", "id", "z", "theta", "r", "w"), "frame", "id", "z", tolerance)
    p = p.where((F.abs(F.col("w1") - F.col("w2")) >= gap) & (angle_distance(F.col("theta1"), F.col("theta2")) <= sector))
    low = F.col("w1") < F.col("w2")
    pick = lambda a, b: F.when(low, F.col(a)).otherwise(F.col(b))
    out = p.select(F.col("frame1").alias("frame"), pick("id1", "id2").alias("inner"), pick("id2", "id1").alias("outer"), pick("r1", "r2").alias("r_in"), pick("r2", "r1").alias("r_out"))
    return out.withColumn("inverted", F.col("r_in") - F.col("r_out") > margin)


def within_radius(points: DataFrame, frame: str, key: str, axes: list[str], radius: float) -> DataFrame:
    """Pairs key1 < key2 of different frames within ``radius``, with their distance: cells of twice that size, one side shown to the cells that its reach touches, eight at most for three axes. Neither side is small, so they are merged and never broadcast."""
    base, size, reach = points.select(frame, key, *axes), 2 * radius, radius * (1 + 1e-9)
    left, right = _renamed(base, "1"), _renamed(base, "2")
    for a in axes:
        left = left.withColumn(f"__{a}", F.explode(F.sequence(F.floor((F.col(a + "1") - reach) / size).cast("long"), F.floor((F.col(a + "1") + reach) / size).cast("long"))))
        right = right.withColumn(f"__{a}", F.floor(F.col(a + "2") / size).cast("long"))
    got = left.hint("merge").join(right, [f"__{a}" for a in axes]).where((F.col(key + "1") < F.col(key + "2")) & (F.col(frame + "1") != F.col(frame + "2")))
    d = norm([F.col(a + "1") - F.col(a + "2") for a in axes])
    return got.withColumn("d", d).where(F.col("d") <= radius).select(frame + "1", key + "1", frame + "2", key + "2", "d")


#: Ids of equal boxes are held in lists of about LIST, which are cut to SPELT before they are spelt; a task makes about TASK_ROWS pairs of them.
LIST, SPELT, TASK_ROWS = 2048, 32, 8_000_000


def _listed(rows: DataFrame, keys: list[str], key: str) -> DataFrame:
    """(keys, __n, __list, __ids): the ids of rows with equal keys in lists of about LIST, and how many they are in all."""
    n = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    part = F.pmod(F.xxhash64(key), F.ceil(F.col("__n") / LIST)).alias("__list")
    ids = F.transform(F.collect_list(F.struct(F.col(key).alias("id"))), lambda x: x["id"])  # a list of ids alone would lose NULL
    return rows.join(n, keys).groupBy(*keys, "__n", part).agg(ids.alias("__ids"))


def _spelt(met: DataFrame, rest: list[str], a: str, b: str) -> DataFrame:
    """(rest, a, b): every id of list a with every id of list b. All that a row makes is copied and held before it goes on, so rows are cut to SPELT x SPELT pairs first."""
    short = lambda c: F.transform(F.sequence(F.lit(0), F.floor((F.size(c) - 1) / SPELT)), lambda k: F.slice(c, (k * SPELT + 1).cast("int"), SPELT))
    met = met.select(*rest, F.explode(short(F.col(a))).alias(a), b).select(*rest, a, F.explode(short(F.col(b))).alias(b))
    return met.select(*rest, F.explode(a).alias(a), b).select(*rest, a, F.explode(b).alias(b))


def _tasks(work: DataFrame) -> int:
    """For how many tasks there is work. work: one number, of pairs."""
    return max(1, min(10_000, -(-int(work.first()[0] or 0) // TASK_ROWS)))


def box_overlaps(left: DataFrame, right: DataFrame, volume: str, axes: list[str], key: str, cell: int) -> DataFrame:
    """Half-open boxes of one volume that overlap, with the overlap's measure. There are as many pairs as there are.

    Equal boxes are measured once: different ones are shown to the cells of the first axis that they
    touch, and each pair counts in its lowest common one. The ids of either side follow as lists, and
    only the tasks that give out the pairs spell them.
    """
    shape = [volume, *[f"{a}{k}" for a in axes for k in (0, 1)]]
    listed = {s: stored(_renamed(_listed(df.select(*shape, key), shape, key), s)) for s, df in (("_a", left), ("_b", right))}

    def dealt(s: str) -> DataFrame:
        a, cols = axes[0], [f"{c}{s}" for c in shape]
        spans = F.sequence(F.floor(F.col(f"{a}0{s}") / cell), F.floor((F.col(f"{a}1{s}") - 1) / cell))
        return listed[s].select(*cols, f"__n{s}").distinct().withColumn("__c", F.explode(spans))

    p = dealt("_a").withColumnRenamed(f"{volume}_a", volume).join(dealt("_b").withColumnRenamed(f"{volume}_b", volume), [volume, "__c"])
    size = F.lit(1)
    for a in axes:
        lo, hi = F.greatest(f"{a}0_a", f"{a}0_b"), F.least(f"{a}1_a", f"{a}1_b")
        p = p.where(lo < hi)
        size = size * (hi - lo)
    a = axes[0]
    p = settled(p.where(F.col("__c") == F.floor(F.greatest(f"{a}0_a", f"{a}0_b") / cell)).withColumn("overlap", size))
    tasks = _tasks(p.agg(F.sum(F.col("__n_a") * F.col("__n_b"))))
    p = p.drop("__n_a", "__n_b", "__c")
    for s in ("_a", "_b"):
        p = p.join(listed[s].withColumnRenamed(f"{volume}{s}", volume).drop(f"__n{s}"), [volume, *[f"{c}{s}" for c in shape[1:]]])
    p = _spelt(p.select(volume, "overlap", "__ids_a", "__ids_b").repartition(tasks), [volume, "overlap"], "__ids_a", "__ids_b")
    return p.select(volume, F.col("__ids_a").alias(f"{key}_a"), F.col("__ids_b").alias(f"{key}_b"), "overlap")


def points_in_boxes(points: DataFrame, boxes: DataFrame, axes: list[str], point: str, box: str, margin: float, cell: float) -> DataFrame:
    """(point, box) for points inside a box widened by ``margin``, borders included. There are as many pairs as there are.

    Different boxes are dealt to the cells that they touch, so that a point is held against equal boxes
    once. The points of a box are lists as its ids are, and list meets list: what moves are two ids for
    each LIST pairs, and only the tasks that give out the pairs spell them.
    """
    shape = [f"{a}{k}" for a in axes for k in (0, 1)]
    listed = stored(_listed(boxes.select(*shape, box), shape, box).withColumnRenamed("__ids", "__ids_b"))
    shapes = stored(listed.groupBy(*shape).agg(F.max("__n").alias("__boxes")))
    b, p = shapes.select(*shape), points.select(point, *axes)
    for a in axes:
        b = b.withColumn(f"__{a}", F.explode(F.sequence(F.floor((F.col(f"{a}0") - margin) / cell), F.floor((F.col(f"{a}1") + margin) / cell))))
        p = p.withColumn(f"__{a}", F.floor(F.col(a) / cell))
    got = p.join(b, [f"__{a}" for a in axes])
    for a in axes:
        got = got.where((F.col(a) >= F.col(f"{a}0") - margin) & (F.col(a) <= F.col(f"{a}1") + margin))
    met = stored(_listed(stored(got.select(point, *shape)), shape, point).select(*shape, "__n", F.col("__ids").alias("__ids_p")))
    tasks = _tasks(met.join(shapes, shape).agg(F.sum(F.size("__ids_p") * F.col("__boxes"))))
    met = met.join(listed.select(*shape, "__ids_b"), shape).select("__ids_p", "__ids_b").repartition(tasks)
    return _spelt(met, [], "__ids_p", "__ids_b").select(F.col("__ids_p").alias(point), F.col("__ids_b").alias(box))


def nearest(queries: DataFrame, targets: DataFrame, keys: list[str], axes: list[str], query: str, target: str, cell: float, reach: float, most: int = 64) -> DataFrame:
    """(keys, query, target, d): the nearest target of the same keys within ``reach``, ties (to nine decimals) to the smaller id; NULL if none. Rows with a place that is NULL or not finite find nothing and are not found.

    Cells start at ``cell``, twice the reach at least, and are cut to a quarter of their size where they
    hold over ``most`` different places, so that a cell is as small as its own places ask. The cells that
    a query lies in say how far its nearest target is at most; it then meets the cells within that
    distance, from the level of its ball down to those that are not cut, and the places of these alone.
    Equal places are asked for once and found once.
    """
    n = range(len(axes))
    flat, c, up, lo, hi = ([f"__{x}{k}" for k in n] for x in ("q", "c", "up", "lo", "hi"))
    sound = lambda df: df.where(reduce(and_, [F.coalesce(finite(F.col(a)), F.lit(False)) for a in axes]))
    places = settled(sound(targets).groupBy(*keys, *axes).agg(F.min(target).alias("__t")))
    ends = places.agg(*[f(a) for a in axes for f in (F.min, F.max)]).first()
    widest = max(((ends[2 * k + 1] or 0) - (ends[2 * k] or 0) for k in n), default=0)
    size, depth = float(min(max(cell, 2 * reach), 2 * widest) if widest else max(cell, 2 * reach)), 0
    at = lambda x, level: F.floor(x / (F.lit(size) / F.pow(F.lit(4.0), level))).cast("long")
    while depth < 20:
        fullest = places.groupBy(*keys, *[at(F.col(a), F.lit(depth)) for a in axes]).count().agg(F.max("count")).first()[0]
        if not fullest or fullest <= most:
            break
        depth += 1

    # every level's cells with their counts and the hulls of their places, from the finest up; those below a cell that is not cut do not count
    levels = [settled(places.groupBy(*keys, *[at(F.col(a), F.lit(depth)).alias(x) for x, a in zip(c, axes, strict=True)]).agg(F.count("*").alias("__n"), *[F.min(a).alias(x) for x, a in zip(lo, axes, strict=True)], *[F.max(a).alias(x) for x, a in zip(hi, axes, strict=True)]))]
    above = [F.shiftright(x, 2) for x in c]
    for _ in range(depth):
        levels.insert(0, settled(levels[0].groupBy(*keys, *[x.alias(y) for x, y in zip(above, c, strict=True)]).agg(F.sum("__n").alias("__n"), *[F.min(x).alias(x) for x in lo], *[F.max(x).alias(x) for x in hi])))
    kept = []
    for k, level in enumerate(levels):
        level = level.withColumns(dict(zip(up, above, strict=True)))
        if k:
            level = level.join(levels[k - 1].where(F.col("__n") > most).select(*keys, *[F.col(x).alias(y) for x, y in zip(c, up, strict=True)]), [*keys, *up], "left_semi")
        kept.append(level.select(*keys, F.lit(k).alias("__level"), *c, *up, *lo, *hi, ((F.col("__n") <= most) | F.lit(k == depth)).alias("__last")))
    cells, cut = settled(united(kept)), [*keys, "__level", *c]

    def rungs(df: DataFrame, cols: list[str]) -> DataFrame:
        """Each row with the cell of every level that it lies in."""
        return df.withColumn("__level", F.explode(F.sequence(F.lit(0), F.lit(depth)))).withColumns({x: at(F.col(a), F.col("__level")) for x, a in zip(c, cols, strict=True)})

    near = norm([F.greatest(F.col(x) - F.col(q), F.lit(0.0), F.col(q) - F.col(y)) for q, x, y in zip(flat, lo, hi, strict=True)])
    far = norm([F.greatest(F.abs(F.col(q) - F.col(x)), F.abs(F.col(q) - F.col(y))) for q, x, y in zip(flat, lo, hi, strict=True)])
    todo = settled(sound(queries).select(*keys, *[F.col(a).alias(q) for q, a in zip(flat, axes, strict=True)]).distinct())
    own = rungs(todo, flat).join(cells, cut).groupBy(*keys, *flat).agg(F.min(far).alias("__far"), F.max("__level").alias("__deep"))
    ball = F.least(F.lit(float(reach)), F.coalesce("__far", F.lit(float(reach)))) * (1 + 1e-12) + 1e-8
    own = todo.join(own, [*keys, *flat], "left").withColumn("__ball", ball)
    top = F.least(F.coalesce("__deep", F.lit(0)), F.coalesce(F.floor(F.log(4.0, F.lit(size) / (2 * F.col("__ball")))), F.lit(0)))
    asked = own.withColumn("__top", F.greatest(F.lit(0), top).cast("int")).withColumn("__level", F.explode(F.sequence(F.lit(0), F.col("__top"))))
    for k, (q, x) in enumerate(zip(flat, c, strict=True)):
        low, high = F.greatest(F.col(q) - F.col("__ball"), F.lit(ends[2 * k])), F.least(F.col(q) + F.col("__ball"), F.lit(ends[2 * k + 1]))
        asked = asked.where(low <= high).withColumn(x, F.explode(F.sequence(at(low, F.col("__level")), at(high, F.col("__level")))))
    inside = near <= F.col("__ball")
    met = settled(asked.join(cells, cut).where((F.col("__last") | (F.col("__level") == F.col("__top"))) & inside).select(*cut, *flat, "__ball", "__last"))
    last = [met.where("__last")]
    while not met.where("NOT __last").isEmpty():
        met = met.where("NOT __last").select(*keys, (F.col("__level") + 1).alias("__level"), *[F.col(x).alias(y) for x, y in zip(c, up, strict=True)], *flat, "__ball")
        met = settled(met.join(cells, [*keys, "__level", *up]).where(inside).select(*cut, *flat, "__ball", "__last"))
        last.append(met.where("__last"))
    homes = rungs(places, axes).join(cells.where("__last").select(*cut), cut)
    d = norm([F.col(q) - F.col(a) for q, a in zip(flat, axes, strict=True)])
    got = united(last).join(homes, cut).withColumn("d", d).where((F.col("d") <= reach) & (F.col("d") <= F.col("__ball")))
    best = got.groupBy(*keys, *flat).agg(F.min(F.struct(F.round("d", 9).alias("d"), F.col("__t").alias("t"))).alias("b"))
    best = best.select(*keys, *[F.col(q).alias(a) for q, a in zip(flat, axes, strict=True)], "b")
    return queries.select(*keys, query, *axes).join(best, [*keys, *axes], "left").select(*keys, query, F.col("b.t").alias(target), F.col("b.d").alias("d"))


def interpolated(points: DataFrame, controls: DataFrame, at: str, values: list[str]) -> DataFrame:
    """Values of a control curve at ``at``, linear between controls and beyond the ends, which is marked; fewer than two controls give no rows.

    Controls are ranked without gathering them and meet the next by rank. Segments and points meet in
    equal bands, as many as there are segments, so that a segment stands in few of them in all; points
    beyond the ends go to the first and last band.
    """
    from plumbline.operators.sampling import global_rank

    ranked = global_rank(controls.select(at, *values), [at], "k")
    low, high, n = ranked.agg(F.min(at), F.max(at), F.count("*")).first()
    a = ranked.select("k", F.col(at).alias("z0"), *[F.col(v).alias(f"{v}0") for v in values])
    b = ranked.select((F.col("k") - 1).alias("k"), F.col(at).alias("z1"), *[F.col(v).alias(f"{v}1") for v in values])
    width = ((high - low) / max(1, n - 1) if n else 0) or 1.0
    band = lambda x: F.floor((x - low) / width)
    low = low if n else 0.0
    inner = F.greatest(F.lit(0), F.least(F.lit(max(0, n - 2)), band(F.col(at)))).cast("long")
    seg = a.join(b, "k").withColumn("lo", F.when(F.col("k") == 1, F.lit(float("-inf"))).otherwise(F.col("z0"))).withColumn("hi", F.when(F.col("k") == n - 1, F.lit(float("inf"))).otherwise(F.col("z1")))
    clip = lambda x: F.greatest(F.lit(0), F.least(F.lit(max(0, n - 2)), band(x))).cast("long")
    seg = seg.withColumn("band", F.explode(F.sequence(clip(F.col("z0")), clip(F.col("z1")))))
    rows = points.select(F.struct("*").alias("row"), F.col(at).alias("z"), inner.alias("band"))
    got = rows.join(seg, "band").where((F.col("z") >= F.col("lo")) & (F.col("z") < F.col("hi")))
    t = (F.col("z") - F.col("z0")) / (F.col("z1") - F.col("z0"))
    return got.select("row.*", *[(F.col(f"{v}0") + t * (F.col(f"{v}1") - F.col(f"{v}0"))).alias(f"c{v}") for v in values], ((t < 0) | (t > 1)).alias("extrapolated"))


def trace_steps(points: DataFrame, trace: str, order: str, axes: list[str], gap: float, turn: float) -> DataFrame:
    """Step lengths along each trace; a gap exceeds ``gap`` times the trace's median non-zero step, a turn exceeds ``turn`` degrees (0 next to a step of no length)."""
    w = Window.partitionBy(trace).orderBy(order)
    d = [F.col(a) - F.lag(a).over(w) for a in axes]
    out = points.select(trace, order, *[x.alias(f"d{a}") for a, x in zip(axes, d, strict=True)]).withColumn("step", norm([F.col(f"d{a}") for a in axes]))
    cosine = ratio(dot([F.col(f"d{a}") for a in axes], [F.lead(f"d{a}").over(w) for a in axes]), F.col("step") * F.lead("step").over(w))
    angle = F.when(F.lead("step").over(w).isNotNull() & F.col("step").isNotNull(), F.coalesce(angle_degrees(cosine), F.lit(0.0)))
    out = out.withColumn("turn", angle)
    middle = F.median(F.when(F.col("step") > 0, F.col("step"))).over(Window.partitionBy(trace))
    return out.withColumn("is_gap", F.coalesce(F.col("step") > gap * middle, F.lit(False))).withColumn("is_turn", F.coalesce(F.col("turn") > turn, F.lit(False))).select(trace, order, "step", "turn", "is_gap", "is_turn")


def trace_audit(steps: DataFrame, trace: str, least: int = 3) -> DataFrame:
    """Counts and length of each trace, and its status."""
    out = steps.groupBy(trace).agg(F.count("*").alias("points"), F.sum("step").alias("length"), F.count_if("is_gap").alias("gaps"), F.count_if("is_turn").alias("turns"))
    return out.withColumn("status", F.when(F.col("points") < least, "short").when(F.col("gaps") + F.col("turns") > 0, "findings").otherwise("clean"))


def islands(df: DataFrame, keys: list[str], order: str, flag: str, least: int) -> DataFrame:
    """Maximal runs of set flags in consecutive places, of ``least`` or more: first, last, length."""
    on = df.where(F.col(flag)).withColumn("__g", F.col(order) - F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    return on.groupBy(*keys, "__g").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length")).drop("__g").where(F.col("length") >= least)


def largest_gap(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The widest distance between consecutive values, where it begins and ends (ties: the first)."""
    nxt = df.withColumn("__n", F.lead(value).over(Window.partitionBy(*keys).orderBy(value)))
    best = nxt.where(F.col("__n").isNotNull()).groupBy(*keys).agg(F.max(F.struct((F.col("__n") - F.col(value)).alias("gap"), (-F.col(value)).alias("m"), F.col(value).alias("from"), F.col("__n").alias("to"))).alias("b"))
    return best.select(*keys, F.col("b.gap").alias("gap"), F.col("b.from").alias("from"), F.col("b.to").alias("to"))


def unwrapped(df: DataFrame, keys: list[str], order: str, angle: str, period: float) -> DataFrame:
    """Net turns along each chain, and steps over a quarter of the period."""
    d = wrapped(F.col(angle) - F.lag(angle).over(Window.partitionBy(*keys).orderBy(order)), period)
    out = df.withColumn("__d", d)
    return out.groupBy(*keys).agg((F.sum("__d") / period).alias("turns"), F.count_if(F.abs("__d") > period / 4).alias("wide_steps"))


def top_per_kind(df: DataFrame, kind: str, order: list[Column | str], k: int) -> DataFrame:
    """The first k of each kind by a full order, with how many there are and how many are shown."""
    w = Window.partitionBy(kind)
    out = df.withColumn("place", F.row_number().over(w.orderBy(*order))).withColumn("total", F.count("*").over(w))
    return out.where(F.col("place") <= k).withColumn("emitted", F.least(F.lit(k), F.col("total")))


def pareto(df: DataFrame, key: str, maximise: list[str], minimise: list[str], band: int = 2048) -> DataFrame:
    """Rows that no other row equals or beats everywhere and beats somewhere; rows with a NULL axis take no part. Skylines of parts first, so that only their members are compared with each other."""
    import pandas as pd

    axes = [*maximise, *minimise]
    signed = df.dropna(subset=axes).select(key, *[F.col(a).cast("double").alias(a) for a in axes], *[F.col(a).cast("double").alias(f"u{k}") for k, a in enumerate(maximise)], *[(-F.col(a).cast("double")).alias(f"u{len(maximise) + k}") for k, a in enumerate(minimise)])
    u = [f"u{k}" for k in range(len(axes))]

    def skyline(parts):
        import numpy as np

        kept = None
        for pdf in parts:
            pool = pdf if kept is None else pd.concat([kept, pdf])
            v = pool[u].to_numpy()
            order = np.argsort(-v.sum(axis=1), kind="stable")
            front: list[int] = []
            for i in order:  # a row can only be beaten by one with a larger sum
                f = v[front]
                if not len(f) or not ((f >= v[i]).all(axis=1) & (f > v[i]).any(axis=1)).any():
                    front.append(int(i))
            kept = pool.iloc[front]
        if kept is not None:
            yield kept

    from plumbline.operators.sampling import global_rank

    # survivors meet in pairs of bands of their rank, so that a task holds two bands at most
    local = settled(global_rank(signed.mapInPandas(skyline, signed.schema), ["u0", key], "__r"))
    bands = -(-local.count() // band) or 1
    own = F.floor((F.col("__r") - 1) / band).cast("int")
    dealt = local.select("__r", *u, own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("other"))
    dealt = dealt.select("__r", *u, "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))

    def beaten(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (pdf[pdf["own"] == pdf[c].iloc[0]] for c in "pq")
        out = []
        for x, y in ((a, b),) if pdf["p"].iloc[0] == pdf["q"].iloc[0] else ((a, b), (b, a)):
            v, w = x[u].to_numpy(), y[u].to_numpy()
            for k in range(0, len(v), 256):
                at = v[k : k + 256, None]
                hit = ((w >= at).all(axis=2) & (w > at).any(axis=2)).any(axis=1)
                out.append(x["__r"].iloc[k : k + 256][hit])
        return pd.DataFrame({"__r": pd.concat(out)})

    lost = dealt.groupBy("p", "q").applyInPandas(beaten, "__r long").distinct()
    return local.join(lost, "__r", "left_anti").select(key, *axes)


def _signed(df: DataFrame, maximise: list[str], minimise: list[str]) -> tuple[DataFrame, list[str]]:
    """Rows without NULL axes, with each axis as a double of which more is better, and those columns' names."""
    axes = [*maximise, *minimise]
    u = [f"__u{k}" for k in range(len(axes))]
    value = [F.col(a).cast("double") if k < len(maximise) else -F.col(a).cast("double") for k, a in enumerate(axes)]
    return df.dropna(subset=axes).withColumns(dict(zip(u, value, strict=True))), u


def _cell_pairs(rows: DataFrame, u: list[str], cells: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their cell in a grid of quantiles, and pairs of cells (__cell, __other, __sure): rows of the other may beat rows of the cell, or surely all beat all."""
    parts = max(2, int(cells ** (1 / len(u))))
    cuts = rows.agg(*[F.percentile_approx(n, [k / parts for k in range(1, parts)], 10_000).alias(n) for n in u]).first()
    bounds = {n: F.array(*[F.lit(float(x)) for x in sorted(set(cuts[n] or []))]).cast("array<double>") for n in u}
    place = lambda n: F.size(F.filter(bounds[n], lambda x: x <= F.col(n)))
    at = [f"__at{k}" for k in range(len(u))]
    rows = settled(rows.withColumns({a: place(n) for a, n in zip(at, u, strict=True)}).withColumn("__cell", F.xxhash64(*at)).drop(*at))
    low, high = [f"__lo{k}" for k in range(len(u))], [f"__hi{k}" for k in range(len(u))]
    corner = settled(rows.groupBy("__cell").agg(*[f(n).alias(x) for n, l, h in zip(u, low, high, strict=True) for f, x in ((F.min, l), (F.max, h))]))
    a, b = (_renamed(corner, x) for x in ("a", "b"))
    every = lambda test: F.forall(F.array(*[test(k) for k in range(len(u))]), lambda x: x)
    may = every(lambda k: F.col(f"__hi{k}b") >= F.col(f"__lo{k}a"))
    sure = every(lambda k: F.col(f"__lo{k}b") > F.col(f"__hi{k}a"))
    return rows, a.join(F.broadcast(b), may).select(F.col("__cella").alias("__cell"), F.col("__cellb").alias("__other"), sure.alias("__sure"))


def _better(u: list[str]) -> Column:
    """Whether the row with columns suffixed o equals or beats the other on all axes and beats it on one."""
    return reduce(and_, [F.col(f"{n}o") >= F.col(n) for n in u]) & reduce(or_, [F.col(f"{n}o") > F.col(n) for n in u])


def dominators(df: DataFrame, key: str, maximise: list[str], minimise: list[str], cells: int = 1024) -> DataFrame:
    """(key, by): every pair where ``by`` equals or beats the row on all axes and beats it on one; rows with a NULL axis take no part. There are as many pairs as there are.

    Rows lie in a grid of quantiles of the axes, ``cells`` of them at most: of two cells the corners say
    that no row of one can beat one of the other, that all do, or that the rows have to be compared. The
    table of cell pairs is bounded by ``cells`` squared whatever the table's size.
    """
    rows, u = _signed(df, maximise, minimise)
    rows, pairs = _cell_pairs(rows.select(key, *u), u, cells)
    mine = rows.select(key, "__cell", *u).join(pairs, "__cell")
    other = rows.select(F.col(key).alias("by"), F.col("__cell").alias("__other"), *[F.col(n).alias(f"{n}o") for n in u])
    return mine.join(other, "__other").where(F.col("__sure") | _better(u)).select(key, "by")


def dominated(df: DataFrame, key: str, maximise: list[str], minimise: list[str], cells: int = 1024) -> DataFrame:
    """(key, dominators, first, last): of each row how many ``dominators`` has, the first and the last, without spelling them; rows with a NULL axis are left out.

    Equal rows are one, with their number and ends. Cells that surely beat another count as a whole; rows
    of the others are compared, two cells in as many parts as they have pairs for (TASK_ROWS), and only
    sums leave a task.
    """
    rows, u = _signed(df, maximise, minimise)
    rows = settled(rows.select(key, *u))
    spots, pairs = _cell_pairs(rows.groupBy(*u).agg(F.count("*").alias("__n"), F.min(key).alias("__first"), F.max(key).alias("__last")), u, cells)
    pairs = settled(pairs)
    summed = [F.sum("__n").alias("__n"), F.min("__first").alias("__first"), F.max("__last").alias("__last")]
    whole = spots.groupBy(F.col("__cell").alias("__other")).agg(*summed)
    whole = pairs.where("__sure").join(whole, "__other").groupBy("__cell").agg(*summed)
    n = spots.groupBy("__cell").agg(F.count("*").alias("__many"))
    near = pairs.where("NOT __sure").join(n, "__cell").join(n.select(F.col("__cell").alias("__other"), F.col("__many").alias("__others")), "__other")
    near = settled(near.withColumn("__salts", F.ceil(F.col("__many") * F.col("__others") / TASK_ROWS)).select("__cell", "__other", "__salts", (F.col("__many") * F.col("__others")).alias("__work")))
    tasks = max(_tasks(near.agg(F.sum("__work"))), _tasks(near.agg(F.sum("__salts") * (TASK_ROWS // 64))))
    cut = ["__cell", "__other", "__salt"]
    mine = spots.select("__cell", *u).join(near, "__cell").withColumn("__salt", F.pmod(F.xxhash64(*u), F.col("__salts"))).select(*cut, *u)
    other = spots.select(F.col("__cell").alias("__other"), "__n", "__first", "__last", *[F.col(x).alias(f"{x}o") for x in u]).join(near, "__other")
    other = other.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__salts") - 1))).drop("__salts", "__work")
    met = mine.repartition(tasks, *cut).hint("merge").join(other.repartition(tasks, *cut), cut).where(_better(u)).groupBy(*u).agg(*summed)
    got = spots.select("__cell", *u).join(whole, "__cell").select(*u, "__n", "__first", "__last").unionByName(met).groupBy(*u).agg(*summed)
    return rows.join(got, u, "left").select(key, F.coalesce("__n", F.lit(0)).alias("dominators"), F.col("__first").alias("first"), F.col("__last").alias("last"))


def band_holdout(df: DataFrame, value: str, key: str, bands: int) -> DataFrame:
    """Equal-count bands; in each, the row nearest to the band's mean is held out (ties: smaller value, then key)."""
    from plumbline.operators.sampling import global_rank

    r = global_rank(df, [value, key], "__r").crossJoin(F.broadcast(df.agg(F.count("*").alias("__n"))))
    small, over = F.floor(F.col("__n") / bands), F.col("__n") % bands
    wide = over * (small + 1)
    band = F.when(F.col("__r") <= wide, F.floor((F.col("__r") - 1) / (small + 1)) + 1).otherwise(over + F.floor((F.col("__r") - 1 - wide) / small) + 1)
    out = r.withColumn("band", band.cast("int")).drop("__r", "__n")
    w = Window.partitionBy("band")
    far = F.round(F.abs(F.col(value) - F.avg(value).over(w)), 9)
    return out.withColumn("__f", far).withColumn("held", F.row_number().over(w.orderBy("__f", value, key)) == 1).drop("__f")


def axial_coverage(df: DataFrame, keys: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """How many values in each of equal bins, the last closed, empty bins kept."""
    width = (high - low) / bins
    b = F.when(F.col(value) == high, bins - 1).otherwise(F.floor((F.col(value) - low) / width).cast("int"))
    n = df.where((F.col(value) >= low) & (F.col(value) <= high)).groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"))
    frame = df.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return frame.join(n, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def crossings(points: DataFrame, zbin: float, sectors: int) -> DataFrame:
    """Median radius and count in each cell of height and angle, by label."""
    zb, tb = F.floor(F.col("z") / zbin).cast("int"), F.floor(F.col("theta") / (360.0 / sectors)).cast("int")
    return points.groupBy("frame", zb.alias("zb"), tb.alias("tb"), "w").agg(F.median("r").alias("r"), F.count("*").alias("n"))


def pitch(cells: DataFrame) -> DataFrame:
    """Inside each cell in the order of radius: step in radius, step in label, and whether the order of labels holds."""
    w = Window.partitionBy("frame", "zb", "tb").orderBy("r", "w")
    return cells.withColumn("pitch", F.col("r") - F.lag("r").over(w)).withColumn("step", F.col("w") - F.lag("w").over(w)).withColumn("in_order", F.col("step") > 0)


def _quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """(keys, q): exact interpolated percentiles of a value from 0 upwards, in the order of shares; no row where a group has no value. Values are counted by 64ths of an octave first, so that only those in the ranges asked for are put in order."""
    v = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    v = settled(v.withColumn("at", F.when(F.col("v") > 0, F.floor(F.log2("v") * 64).cast("int"))))
    upto = lambda *order: Window.partitionBy(*keys, *order[:-1]).orderBy(order[-1]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = v.groupBy(*keys, "at").agg(F.sum("n").alias("n"))
    ranges = ranges.withColumn("upto", F.sum("n").over(upto(F.asc_nulls_first("at")))).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    asked = ranges.withColumn("share", F.explode(F.array(*map(F.lit, shares)))).withColumn("place", (F.col("total") - 1) * F.col("share"))
    # the two values that a place lies between, each as so many values before it
    asked = asked.select(*keys, "at", "share", "place", (F.col("upto") - F.col("n")).alias("before"), "upto", F.explode(F.array(F.floor("place"), F.ceil("place"))).alias("want"))
    asked = settled(asked.where((F.col("before") <= F.col("want")) & (F.col("want") < F.col("upto"))).distinct())
    same = reduce(and_, [F.col(f"v.{k}").eqNullSafe(F.col(f"a.{k}")) for k in (*keys, "at")])
    some = v.alias("v").join(F.broadcast(asked.select(*keys, "at", "before").distinct()).alias("a"), same).select("v.*", "a.before")
    some = some.withColumn("upto", F.col("before") + F.sum("n").over(upto("at", "v")))
    same = reduce(and_, [F.col(f"s.{k}").eqNullSafe(F.col(f"a.{k}")) for k in (*keys, "at")] + [F.col("s.upto") - F.col("s.n") <= F.col("a.want"), F.col("a.want") < F.col("s.upto")])
    ends = some.alias("s").join(F.broadcast(asked).alias("a"), same).groupBy(*[F.col(f"a.{k}").alias(k) for k in keys], "a.share", "a.place").agg(F.min("s.v").alias("low"), F.max("s.v").alias("high"))
    part = F.col("place") - F.floor("place")
    met = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise((1 - part) * F.col("low") + part * F.col("high"))
    one = ends.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("share", met))).alias("q"))
    return one.select(*keys, F.array(*[F.try_element_at("q", F.lit(p)) for p in shares]).alias("q"))


def surface_recovery(truth: DataFrame, found: DataFrame, keys: list[str], axes: list[str], tolerance: float, reach: float, component: str) -> DataFrame:
    """Share of each side within ``tolerance`` of the other (recall, precision) and the smaller share; p50, p95 and maximum of the distances within ``reach`` and how many have none, each way; the share of truth's components that are met at all, and the least share of one."""
    def distances(a: DataFrame, b: DataFrame) -> DataFrame:
        d = nearest(a, b.withColumnRenamed("id", "other"), keys, axes, "id", "other", reach, reach).drop("other")
        return settled(d.withColumn("near", F.coalesce(F.col("d") <= tolerance, F.lit(False)).cast("double")))

    def summed(d: DataFrame, share: str, name: str) -> DataFrame:
        out = d.groupBy(*keys).agg(F.avg("near").alias(share), F.count_if(F.col("d").isNull()).alias(f"{name}_beyond")).alias("o")
        q = _quantiles(d, keys, "d", [0.5, 0.95, 1.0]).alias("q")
        out = out.join(q, reduce(and_, [F.col(f"o.{k}").eqNullSafe(F.col(f"q.{k}")) for k in keys]), "left")
        return out.select(*[f"o.{k}" for k in keys], share, *[F.col("q.q")[k].alias(f"{name}_{c}") for k, c in enumerate(("p50", "p95", "max"))], f"{name}_beyond")

    there = distances(truth, found)
    parts = there.join(truth.select(*keys, "id", component), [*keys, "id"]).groupBy(*keys, component).agg(F.avg("near").alias("covered"))
    parts = parts.groupBy(*keys).agg(F.avg((F.col("covered") > 0).cast("double")).alias("component_recall"), F.min("covered").alias("worst_component"))
    both = summed(there, "recall", "truth").join(summed(distances(found, truth), "precision", "found"), keys, "full").join(parts, keys, "left")
    return both.withColumn("worst", F.least(F.coalesce("recall", F.lit(0.0)), F.coalesce("precision", F.lit(0.0))))


def lattice(centres: DataFrame, keys: list[str], axes: list[str], n: int, step: float, basis: list[Column] | None = None) -> DataFrame:
    """n x n x n points of a step around each centre: keys, i, j, k from -(n // 2), and gx, gy, gz. ``basis``: three directions as arrays, else the axes; two of them in a tangent plane and the normal give a tangent lattice."""
    side = F.sequence(F.lit(-(n // 2)), F.lit(n - 1 - n // 2))
    out = centres
    for c in "ijk":
        out = out.withColumn(c, F.explode(side))
    unit = basis or [F.array(*[F.lit(float(a == b)) for b in range(3)]) for a in range(3)]
    moved = [F.col(a) + sum((step * F.col(c) * u[m] for c, u in zip("jk", unit[1:], strict=True)), step * F.col("i") * unit[0][m]) for m, a in enumerate(axes)]
    return out.select(*keys, "i", "j", "k", *[x.alias(f"g{a}") for x, a in zip(moved, axes, strict=True)])
