"""Chunked arrays as voxel rows: quality metrics, scores, censuses, supports, neighbourhoods."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.numeric import clamp, ratio

AXES = ("z", "y", "x")


def dead_slice_count(vox: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """Planes along z that hold nothing while both neighbours hold something."""
    plane = vox.groupBy(*keys, "z").agg(F.avg((F.col(value) != 0).cast("double")).alias("full"))
    w = Window.partitionBy(*keys).orderBy("z")
    dead = (F.col("full") == 0) & (F.lag("full").over(w) > 0) & (F.lead("full").over(w) > 0)
    return plane.withColumn("dead", dead).groupBy(*keys).agg(F.count_if("dead").alias("dead_slices"))


def chunk_metrics(vox: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """Per chunk: share of non-zero voxels, mean, population deviation, percentiles, dynamic range, saturation, mean neighbour difference per axis averaged, dead slices."""
    steps = vox
    for a in AXES:
        w = Window.partitionBy(*keys, *[b for b in AXES if b != a]).orderBy(a)
        steps = steps.withColumn(f"d{a}", F.abs(F.col(value) - F.lag(value).over(w)))
    v = F.col(value)
    out = steps.groupBy(*keys).agg(F.avg((v != 0).cast("double")).alias("nonzero_frac"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.percentile(v, F.array(F.lit(0.01), F.lit(0.5), F.lit(0.99))).alias("q"), F.avg((v == 255).cast("double")).alias("sat_frac"), ((F.avg("dz") + F.avg("dy") + F.avg("dx")) / 3).alias("grad_energy"))
    out = out.select(*keys, "nonzero_frac", "mean", "std", F.col("q")[0].alias("p1"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p99"), (F.col("q")[2] - F.col("q")[0]).alias("dyn_range"), "sat_frac", "grad_energy")
    return out.join(dead_slice_count(vox, keys, value), keys)


def quality_score(nonzero: Column, grad: Column, dyn: Column, sat: Column, dead: Column) -> Column:
    """0 to 100: credit for filled, sharp, ranged chunks, penalties for saturation and dead slices."""
    cap = lambda x, top: F.least(F.lit(1.0), x / top)
    return clamp(40 * cap(nonzero, 0.9) + 30 * cap(grad, 12.0) + 20 * cap(dyn, 200.0) - 25 * cap(sat, 0.05) - F.least(F.lit(30.0), 15.0 * dead), 0.0, 100.0)


_INPUTS = ("nonzero_frac", "grad_energy", "dyn_range", "sat_frac", "dead_slices")


def volume_scores(metrics: DataFrame, volume: str) -> DataFrame:
    """Mean metrics of a volume's chunks (dead slices summed), the score of these, and the spread of chunk scores."""
    each = metrics.withColumn("s", quality_score(*[F.col(c) for c in _INPUTS]))
    roll = each.groupBy(volume).agg(*[F.avg(c).alias(c) for c in _INPUTS[:4]], F.sum("dead_slices").alias("dead_slices"), F.count("*").alias("chunks"), F.stddev_pop("s").alias("score_std"), F.min("s").alias("score_min"), F.max("s").alias("score_max"))
    return roll.withColumn("score", quality_score(*[F.col(c) for c in _INPUTS]))


def leaderboard(scores: DataFrame, key: str, score: str = "score") -> DataFrame:
    """Rank by score (ties by key), tier, and the histogram bin from 25 to 80 in fives, the last closed."""
    s = F.col(score)
    tier = F.when(s >= 70, "S").when(s >= 60, "A").when(s >= 45, "B").otherwise("C")
    edge = F.when(s == 80, 75).when((s >= 25) & (s < 80), (F.floor(s / 5) * 5).cast("int"))
    from plumbline.operators.sampling import global_rank

    ranked = global_rank(scores.select(key, score, (-s).alias("__down")), ["__down", key], "rank")
    return ranked.select(key, score, F.col("rank").cast("int").alias("rank"), tier.alias("tier"), edge.alias("bin"))


def status_counts(df: DataFrame, keys: list[str], status: str, names: list[str]) -> DataFrame:
    """A column for each status of a fixed list, zero where none; other statuses are not lost but counted as other."""
    return df.groupBy(*keys).agg(*[F.count_if(F.col(status) == n).alias(n) for n in names], F.count_if(F.col(status).isNull() | ~F.col(status).isin(names)).alias("other"))


def distribution(df: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Exact quantiles (linear between ranks) of finite values, with how many there are."""
    fine = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    q = F.percentile(value, F.array(*[F.lit(p) for p in points.values()]))
    return fine.groupBy(*keys).agg(F.count("*").alias("n"), q.alias("q")).select(*keys, "n", *[F.col("q")[k].alias(n) for k, n in enumerate(points)])


def support_audit(vox: DataFrame, keys: list[str], pred: str, ct: str, threshold: int = 0) -> DataFrame:
    """Predicted voxels with and without scan support: counts, share supported, and the status that allows seeding."""
    on = F.col(pred) > threshold
    out = vox.groupBy(*keys).agg(F.count("*").alias("voxels"), F.count_if(on).alias("positives"), F.count_if(on & (F.col(ct) != 0)).alias("supported"), F.count_if(on & (F.col(ct) == 0)).alias("phantom"))
    status = F.when(F.col("voxels") == 0, "unverified").when(F.col("phantom") == 0, "seed_safe").otherwise("requires_filter")
    return out.withColumn("support", ratio(F.col("supported"), F.col("positives"))).withColumn("status", status)


def pooled_support(audit: DataFrame) -> DataFrame:
    """1 - phantoms / positives over all, with whether every chunk had something to inspect."""
    return audit.agg(F.sum("positives").alias("positives"), F.sum("phantom").alias("phantom"), F.bool_and(F.col("voxels") > 0).alias("complete")).withColumn("support", 1 - ratio(F.col("phantom"), F.col("positives")))


def size_census(listing: DataFrame, declared: DataFrame, level: str, key: str, size: str) -> DataFrame:
    """Objects by level against what the level declares: ok, mismatch, unverified (no object) or not_applicable (compressed, filtered or of unknown type), with the first five that differ.

    declared: level, chunks (array), itemsize (NULL: unknown), plain (false: compressed or filtered).
    Names that begin with a dot are no chunks. A level that is listed but not declared is unverified.
    """
    product = F.aggregate("chunks", F.lit(1).cast("long"), lambda a, x: a * x)
    known = declared.select(level, F.when(F.col("plain") & F.col("itemsize").isNotNull(), product * F.col("itemsize")).alias("expected"), F.lit(True).alias("declared"))
    chunks = listing.where(~F.substring_index(key, "/", -1).startswith("."))
    counts = chunks.groupBy(level, size).agg(F.count("*").alias("n"))
    odd = counts.join(known, level).where(F.col(size) != F.col("expected")).select(level, size)
    # of each level and size the first five names, then of each level
    first = F.row_number().over(Window.partitionBy(level, size).orderBy(key))
    some = chunks.join(odd, [level, size]).withColumn("__k", first).where(F.col("__k") <= 5)
    five = some.groupBy(level).agg(F.slice(F.array_sort(F.collect_list(key)), 1, 5).alias("examples"))
    sums = counts.groupBy(level).agg(F.sum("n").alias("objects"))
    out = known.join(sums, level, "full").join(counts.join(odd, [level, size]).groupBy(level).agg(F.sum("n").alias("bad")), level, "left").join(five, level, "left")
    out = out.withColumns({"objects": F.coalesce("objects", F.lit(0)), "bad": F.coalesce("bad", F.lit(0))})
    status = F.when(F.col("declared").isNull(), "unverified").when(F.col("expected").isNull(), "not_applicable").when(F.col("objects") == 0, "unverified").when(F.col("bad") > 0, "mismatch").otherwise("ok")
    return out.select(level, "expected", "objects", "bad", F.array_join("examples", ",").alias("examples"), status.alias("status"))


def value_census(vox: DataFrame, keys: list[str], value: str) -> DataFrame:
    """How many values occur, and whether the array is binary, graded or, with nothing in it, unverified."""
    hist = vox.groupBy(*keys, value).agg(F.count("*").alias("n"))
    out = hist.groupBy(*keys).agg(F.count("*").alias("values"), F.sum(F.when(F.col(value) != 0, F.col("n")).otherwise(0)).alias("nonzero"))
    return out.withColumn("kind", F.when(F.col("nonzero") == 0, "unverified").when(F.col("values") <= 2, "binary").otherwise("graded"))


def otsu(vox: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Best share of variance between two classes over all thresholds of the histogram (ties: the lower threshold)."""
    hist = vox.groupBy(*keys, F.col(value).alias("t")).agg(F.count("*").alias("n"))
    run, whole = Window.partitionBy(*keys).orderBy("t"), Window.partitionBy(*keys)
    total = F.sum("n").over(whole).cast("double")
    h = hist.select(*keys, "t", (F.sum("n").over(run) / total).alias("w"), (F.sum(F.col("n") * F.col("t")).over(run) / total).alias("m"), (F.sum(F.col("n") * F.col("t")).over(whole) / total).alias("mt"), (F.sum(F.col("n") * F.col("t") * F.col("t")).over(whole) / total).alias("s"))
    h = h.withColumn("eta", ratio(F.pow(F.col("mt") * F.col("w") - F.col("m"), F.lit(2)), F.col("w") * (1 - F.col("w")) * (F.col("s") - F.col("mt") * F.col("mt"))))
    return h.where(F.col("w") < 1).groupBy(*keys).agg(F.max(F.round("eta", 9)).alias("eta"), F.max_by("t", F.struct(F.round("eta", 9), -F.col("t"))).alias("threshold"))


def support_distance(vox: DataFrame, keys: list[str], pred: str, ct: str, edges: list[float]) -> DataFrame:
    """Distance of each phantom voxel to the nearest supported one of its chunk, in bins; -1 where there is none.

    Squared distances are sums over the axes, so the minimum is taken axis by axis: along x within each
    line that has support, then over y, then over z. A row holds one line of a chunk; the work is the
    side of a chunk for each of its voxels, not all pairs of voxels.
    """
    on = vox.where(F.col(pred) > 0)
    ghost = on.where(F.col(ct) == 0).select(*keys, *AXES)
    line = on.where(F.col(ct) != 0).groupBy(*keys, "z", "y").agg(F.collect_list("x").alias("at"))
    wanted = {a: ghost.groupBy(*keys).agg(F.collect_set(a).alias("to")) for a in ("x", "y")}
    square = lambda a, b: (a - b) * (a - b)
    d = line.join(wanted["x"], keys).select(*keys, "z", "y", "at", F.explode("to").alias("x"))
    d = d.select(*keys, "z", "x", F.struct("y", F.array_min(F.transform("at", lambda s: square(s, F.col("x")))).alias("d")).alias("s"))
    nearest = lambda to: F.array_min(F.transform("at", lambda s: s["d"] + square(s["k"], F.col(to))))
    d = d.groupBy(*keys, "z", "x").agg(F.collect_list(F.struct(F.col("s.y").alias("k"), F.col("s.d").alias("d"))).alias("at"))
    d = d.join(wanted["y"], keys).select(*keys, "z", "x", "at", F.explode("to").alias("y")).select(*keys, "x", "y", F.struct(F.col("z").alias("k"), nearest("y").alias("d")).alias("s"))
    d = d.groupBy(*keys, "x", "y").agg(F.collect_list("s").alias("at"))
    near = ghost.join(d, [*keys, "x", "y"], "left").select(*keys, F.sqrt(nearest("z")).alias("d"))
    which = sum(((F.col("d") > e).cast("int") for e in edges[1:]), (F.col("d") > edges[0]).cast("int"))
    return near.withColumn("bin", F.coalesce(which, F.lit(-1))).groupBy(*keys, "bin").agg(F.count("*").alias("n"))


def max_window(mask: DataFrame, keys: list[str], width: int, stride: int, extent: int) -> DataFrame:
    """The window with the most set cells among those on the stride; ties to the smallest (y, x)."""
    last = (extent - width) // stride
    first = lambda c: F.greatest(F.lit(0), F.ceil((F.col(c) - (width - 1)) / stride)).cast("int")
    upto = lambda c: F.least(F.lit(last), F.floor(F.col(c) / stride)).cast("int")
    span = lambda c: F.when(first(c) <= upto(c), F.sequence(first(c), upto(c)))
    all_ = mask.withColumn("wy", F.explode(span("y"))).withColumn("wx", F.explode(span("x")))
    sums = all_.groupBy(*keys, "wy", "wx").agg(F.sum("set").alias("mass"))
    best = sums.groupBy(*keys).agg(F.max_by(F.struct("wy", "wx", "mass"), F.struct("mass", -F.col("wy"), -F.col("wx"))).alias("b"))
    return best.select(*keys, (F.col("b.wy") * stride).alias("y0"), (F.col("b.wx") * stride).alias("x0"), F.col("b.mass").alias("mass"))


def neighbour_classes(chunks: DataFrame, volume: str, has: str) -> DataFrame:
    """supported if the chunk has support, halo if one of its 26 neighbours has, unresolved if one is missing, else beyond. chunks: cz, cy, cx."""
    off = F.array(F.lit(-1), F.lit(0), F.lit(1))
    around = chunks.select(volume, "cz", "cy", "cx", F.explode(off).alias("a")).select("*", F.explode(off).alias("b")).select("*", F.explode(off).alias("c")).where((F.col("a") != 0) | (F.col("b") != 0) | (F.col("c") != 0))
    around = around.select(volume, "cz", "cy", "cx", (F.col("cz") + F.col("a")).alias("nz"), (F.col("cy") + F.col("b")).alias("ny"), (F.col("cx") + F.col("c")).alias("nx"))
    other = chunks.select(volume, F.col("cz").alias("nz"), F.col("cy").alias("ny"), F.col("cx").alias("nx"), F.col(has).alias("nhas"))
    seen = around.join(other, [volume, "nz", "ny", "nx"], "left").groupBy(volume, "cz", "cy", "cx").agg(F.bool_or(F.coalesce("nhas", F.lit(False))).alias("near"), F.bool_or(F.col("nhas").isNull()).alias("gap"))
    out = chunks.join(seen, [volume, "cz", "cy", "cx"])
    return out.withColumn("class", F.when(F.col(has), "supported").when(F.col("near"), "halo").when(F.col("gap"), "unresolved").otherwise("beyond"))


def halo(vox: DataFrame, keys: list[str], size: int) -> DataFrame:
    """What each chunk gets from its 26 neighbours (those that exist): keys, cz, cy, cx, the places z, y, x in it, from -1 to ``size``, and v. A voxel is sent once for each neighbour that it touches; nothing is joined but the list of chunks."""
    out = vox
    for a in AXES:
        ways = F.array_compact(F.array(F.lit(0), F.when(F.col(a) == 0, -1), F.when(F.col(a) == size - 1, 1)))
        out = out.withColumn(f"d{a}", F.explode(ways))
    out = out.where("dz <> 0 OR dy <> 0 OR dx <> 0")
    sent = out.select(*keys, *[(F.col(f"c{a}") + F.col(f"d{a}")).alias(f"c{a}") for a in AXES], *[(F.col(a) - size * F.col(f"d{a}")).alias(a) for a in AXES], "v")
    place = [*keys, *[f"c{a}" for a in AXES]]
    return sent.join(vox.select(*place).distinct(), place, "left_semi")


def trilinear(points: DataFrame, vox: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """Value at fractional px, py, pz between eight corners; NULL if a corner is missing. points: keys, pid, pz, py, px."""
    corner = points.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7))))
    weight = F.lit(1.0)
    for n, a in enumerate(AXES):
        bit = F.col("k").bitwiseAND(1 << n) != 0
        low = F.floor(f"p{a}")
        corner = corner.withColumn(a, (low + bit.cast("int")).cast("int"))
        weight = weight * F.when(bit, F.col(f"p{a}") - low).otherwise(1 - (F.col(f"p{a}") - low))
    corner = corner.withColumn("wt", weight)
    got = corner.join(vox.select(*keys, *AXES, value), [*keys, *AXES], "left")
    return got.groupBy(*keys, "pid").agg(F.when(F.count(value) == 8, F.sum(F.col("wt") * F.col(value))).alias("sampled"))


def smoothed(vox: DataFrame, keys: list[str], value: str, weights: list[float], size: int) -> DataFrame:
    """Separable smoothing by a short symmetric kernel, reflected at the borders; one pass of shifted rows per axis."""
    half = len(weights) // 2
    kernel = F.array(*[F.struct(F.lit(k - half).alias("o"), F.lit(w).alias("w")) for k, w in enumerate(weights)])
    out = vox.select(*keys, *AXES, F.col(value).cast("double").alias("s"))
    for a in AXES:
        moved = out.select(*keys, *AXES, "s", F.explode(kernel).alias("t"))
        # a voxel gives its value to the places that see it directly or mirrored at either border
        places = F.array(F.col(a) - F.col("t.o"), -1 - F.col(a) - F.col("t.o"), 2 * size - 1 - F.col(a) - F.col("t.o"))
        moved = moved.withColumn("to", F.explode(places)).where((F.col("to") >= 0) & (F.col("to") < size))
        out = moved.groupBy(*keys, *[F.col("to").alias(a) if b == a else F.col(b) for b in AXES]).agg(F.sum(F.col("s") * F.col("t.w")).alias("s"))
    return out


def plate_response(vox: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """Largest absolute eigenvalue of the Hessian by second differences, and how far it stands out; interior voxels only. Closed form for a symmetric 3 x 3 matrix."""
    out = vox
    for a in AXES:
        w = Window.partitionBy(*keys, *[b for b in AXES if b != a]).orderBy(a)
        out = out.withColumn(f"h{a}", F.lag(value).over(w) + F.lead(value).over(w) - 2 * F.col(value)).withColumn(f"g{a}", (F.lead(value).over(w) - F.lag(value).over(w)) / 2.0)
    for a, b in (("z", "y"), ("z", "x"), ("y", "x")):
        w = Window.partitionBy(*keys, *[c for c in AXES if c != b]).orderBy(b)
        out = out.withColumn(f"h{a}{b}", (F.lead(f"g{a}").over(w) - F.lag(f"g{a}").over(w)) / 2.0)
    h = {k: F.col(f"h{k}").cast("double") for k in ("z", "y", "x", "zy", "zx", "yx")}
    out = out.dropna(subset=[f"h{k}" for k in h])
    q = (h["z"] + h["y"] + h["x"]) / 3
    p = F.sqrt((F.pow(h["z"] - q, 2) + F.pow(h["y"] - q, 2) + F.pow(h["x"] - q, 2) + 2 * (F.pow(h["zy"], 2) + F.pow(h["zx"], 2) + F.pow(h["yx"], 2))) / 6)
    b = [(h["z"] - q), (h["y"] - q), (h["x"] - q)]
    det = b[0] * (b[1] * b[2] - h["yx"] * h["yx"]) - h["zy"] * (h["zy"] * b[2] - h["yx"] * h["zx"]) + h["zx"] * (h["zy"] * h["yx"] - b[1] * h["zx"])
    phi = F.acos(clamp(F.coalesce(ratio(det, 2 * p * p * p), F.lit(0.0)), -1.0, 1.0)) / 3
    e1, e3 = q + 2 * p * F.cos(phi), q + 2 * p * F.cos(phi + 2.0943951023931953)
    e2 = 3 * q - e1 - e3
    out = out.select(*keys, *AXES, e1.alias("e1"), e2.alias("e2"), e3.alias("e3"))
    top = F.greatest(F.abs("e1"), F.abs("e2"), F.abs("e3"))
    return out.withColumn("strength", top).withColumn("trace", F.col("e1") + F.col("e2") + F.col("e3"))


def gaussian(sigma: float, reach: float = 3.0) -> list[float]:
    """Weights of a symmetric kernel out to ``reach`` deviations, summing to 1."""
    half = max(1, math.ceil(reach * sigma))
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-half, half + 1)]
    return [x / sum(w) for x in w]


def multiscale_plates(vox: DataFrame, keys: list[str], value: str, sigmas: list[float], size: int, beta: float = 0.5, gamma: float = 0.1, bright: bool = True) -> DataFrame:
    """(keys, z, y, x, response, scale): the strongest plate response over smoothing scales (ties: the smaller scale), interior voxels only.

    Second differences of the smoothed values are multiplied by the squared scale. Of the eigenvalues by
    magnitude, the middle over the largest tells a plate from a line or blob, and all three together tell
    structure from noise; bright plates have a negative largest eigenvalue, dark ones a positive one, and
    the wrong sign gives no response. A scale's kernel must not reach beyond one ``size``.
    """
    out = None
    for sigma in sigmas:
        soft = smoothed(vox, keys, value, gaussian(sigma), size)
        e = plate_response(soft, keys, "s").withColumn("e", F.sort_array(F.array(*[F.struct((F.abs(c) * sigma**2).alias("m"), (F.col(c) * sigma**2).alias("e")) for c in ("e1", "e2", "e3")])))
        middle, most = F.col("e")[1]["m"], F.col("e")[2]["m"]
        whole = F.sqrt(sum((F.pow(F.col("e")[k]["m"], 2) for k in (1, 2)), F.pow(F.col("e")[0]["m"], 2)))
        plate = F.exp(-0.5 * F.pow(middle / most / beta, 2)) * (1 - F.exp(-0.5 * F.pow(whole / gamma, 2)))
        right = (F.col("e")[2]["e"] < 0) if bright else (F.col("e")[2]["e"] > 0)
        one = e.select(*keys, *AXES, F.lit(sigma).alias("scale"), F.when((most > 1e-12) & right, plate).otherwise(0.0).alias("response"))
        out = one if out is None else out.unionByName(one)
    best = out.groupBy(*keys, *AXES).agg(F.max_by(F.struct("response", "scale"), F.struct("response", -F.col("scale"))).alias("b"))
    return best.select(*keys, *AXES, "b.response", "b.scale")
