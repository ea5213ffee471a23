"""Surface grids and triangle meshes: edges, quads, curvature, topology counts, components' geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.numeric import angle_distance, clamp, cross, dot, norm, ratio

AXES = ("x", "y", "z")


def _p(suffix: str = "") -> list[Column]:
    return [F.col(a + suffix) for a in AXES]


def _minus(a: list[Column], b: list[Column]) -> list[Column]:
    return [x - y for x, y in zip(a, b, strict=True)]


def grid_edges(grid: DataFrame) -> DataFrame:
    """Edges to the right and down between valid vertices: surface, row, col, dir, length. One window per direction, no self-join."""
    parts = []
    for name, fixed, moving in (("right", "row", "col"), ("down", "col", "row")):
        w = Window.partitionBy("surface", fixed).orderBy(moving)
        nxt = [F.lead(a).over(w).alias(f"{a}1") for a in (*AXES, "valid", moving)]
        e = grid.select("surface", "row", "col", *AXES, "valid", *nxt).where((F.col(f"{moving}1") == F.col(moving) + 1) & F.col("valid") & F.col("valid1"))
        parts.append(e.select("surface", "row", "col", F.lit(name).alias("dir"), norm(_minus(_p("1"), _p())).alias("length")))
    return parts[0].unionByName(parts[1])


def edge_metrics(edges: DataFrame, nominal: float, jump: float) -> DataFrame:
    """Per surface and direction: quantiles of length, mean stretch to nominal, edges longer than ``jump`` times the median."""
    q = edges.groupBy("surface", "dir").agg(F.percentile("length", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("q"), F.avg(F.col("length") / nominal).alias("stretch"))
    n = edges.join(q, ["surface", "dir"]).groupBy("surface", "dir").agg(F.count("*").alias("edges"), F.count_if(F.col("length") > jump * F.col("q")[1]).alias("jumps"))
    return n.join(q, ["surface", "dir"]).select("surface", "dir", "edges", F.col("q")[0].alias("p05"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p95"), "stretch", "jumps")


def quads(grid: DataFrame, spacing: float) -> DataFrame:
    """Quads of four valid vertices: area by diagonals, unit normal, singular values of the map from the grid, anisotropy, symmetric Dirichlet energy."""
    right, down = Window.partitionBy("surface", "row").orderBy("col"), Window.partitionBy("surface", "col").orderBy("row")
    cols = [*AXES, "valid"]
    g = grid.select("surface", "row", "col", *cols, *[F.lead(c).over(right).alias(f"{c}r") for c in (*cols, "col")])
    g = g.select("*", *[F.lead(c).over(down).alias(f"{c}d") for c in (*cols, "row")], *[F.lead(f"{c}r").over(down).alias(f"{c}e") for c in cols])
    g = g.where((F.col("colr") == F.col("col") + 1) & (F.col("rowd") == F.col("row") + 1) & F.col("valid") & F.col("validr") & F.col("validd") & F.col("valide"))
    n = cross(_minus(_p("e"), _p()), _minus(_p("d"), _p("r")))
    u, v = [c / spacing for c in _minus(_p("r"), _p())], [c / spacing for c in _minus(_p("d"), _p())]
    e, f, gg = dot(u, u), dot(u, v), dot(v, v)
    mid, dev = (e + gg) / 2, F.sqrt(F.pow((e - gg) / 2, 2) + f * f)
    out = g.select("surface", "row", "col", (norm(n) / 2).alias("area"), *[ratio(c, norm(n)).alias(f"n{a}") for a, c in zip(AXES, n, strict=True)], F.sqrt(mid + dev).alias("s1"), F.sqrt(F.greatest(mid - dev, F.lit(0.0))).alias("s2"))
    s1, s2 = F.col("s1"), F.col("s2")
    return out.withColumn("anisotropy", ratio(s1, s2)).withColumn("dirichlet", s1 * s1 + s2 * s2 + ratio(F.lit(1.0), s1 * s1) + ratio(F.lit(1.0), s2 * s2))


def reversals(q: DataFrame) -> DataFrame:
    """Neighbouring quads to the right whose normals turn by more than a right angle, and curvature: twice the sine of half the turn over the chord."""
    w = Window.partitionBy("surface", "row").orderBy("col")
    d = dot([F.col(f"n{a}") for a in AXES], [F.lead(f"n{a}").over(w) for a in AXES])
    out = q.select("surface", "row", "col", "area", F.when(F.lead("col").over(w) == F.col("col") + 1, clamp(d, -1.0, 1.0)).alias("dot"))
    return out.withColumn("curvature", 2 * F.sin(F.acos("dot") / 2) / F.sqrt("area"))


def tile_curvature(rev: DataFrame, tile: int) -> DataFrame:
    t = lambda c: F.floor(F.col(c) / tile).cast("int")
    has = rev.where(F.col("curvature").isNotNull())
    return has.groupBy("surface", t("row").alias("tr"), t("col").alias("tc")).agg(F.count("*").alias("units"), ratio(F.sum(F.col("area") * F.col("curvature")), F.sum("area")).alias("curvature"), F.count_if(F.col("dot") < 0).alias("reversals"))


def triangles(grid: DataFrame, width: int) -> DataFrame:
    """Two triangles for each quad with valid corners: fid, v0, v1, v2 (vertex = row * width + col)."""
    right, down = Window.partitionBy("surface", "row").orderBy("col"), Window.partitionBy("surface", "col").orderBy("row")
    g = grid.select("surface", "row", "col", "valid", F.lead("valid").over(right).alias("vr"), F.lead("col").over(right).alias("cr"))
    g = g.select("*", F.lead("valid").over(down).alias("vd"), F.lead("vr").over(down).alias("ve"), F.lead("row").over(down).alias("rd"))
    g = g.where(F.col("valid") & F.col("vr") & F.col("vd") & F.col("ve") & (F.col("cr") == F.col("col") + 1) & (F.col("rd") == F.col("row") + 1))
    v = F.col("row") * width + F.col("col")
    t = F.array(F.struct((2 * v).alias("fid"), v.alias("v0"), (v + 1).alias("v1"), (v + width).alias("v2")), F.struct((2 * v + 1).alias("fid"), (v + 1).alias("v0"), (v + width + 1).alias("v1"), (v + width).alias("v2")))
    return g.select("surface", F.explode(t).alias("t")).select("surface", "t.*")


def half_edges(tri: DataFrame) -> DataFrame:
    """Edges of a mesh with how many faces share them: boundary (1), interior (2), non-manifold (more); an interior edge is consistent if its faces run it in opposite directions."""
    ends = F.array(*[F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))])
    e = tri.select("surface", "fid", F.explode(ends).alias("e")).select("surface", F.least("e.a", "e.b").alias("lo"), F.greatest("e.a", "e.b").alias("hi"), F.when(F.col("e.a") < F.col("e.b"), 1).otherwise(-1).alias("way"))
    out = e.groupBy("surface", "lo", "hi").agg(F.count("*").alias("faces"), F.sum("way").alias("way"))
    return out.withColumn("kind", F.when(F.col("faces") == 1, "boundary").when(F.col("faces") == 2, "interior").otherwise("non_manifold")).withColumn("consistent", F.when(F.col("faces") == 2, F.col("way") == 0))


def euler(cells: DataFrame, keys: list[str], value: str, thresholds: list[float]) -> DataFrame:
    """V - E + F of the cells at or above each threshold, cells meeting at corners."""
    kept = cells.select(*keys, "row", "col", F.col(value).alias("v"), F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("t")).where(F.col("v") >= F.col("t"))
    corner = F.array(*[F.struct((F.col("row") + a).alias("r"), (F.col("col") + b).alias("c")) for a in (0, 1) for b in (0, 1)])
    side = F.array(*[F.struct((F.col("row") + a).alias("r"), (F.col("col") + b).alias("c"), F.lit(k).alias("k")) for a, b, k in ((0, 0, 0), (1, 0, 0), (0, 0, 1), (0, 1, 1))])
    by = [*keys, "t"]
    f = kept.groupBy(*by).agg(F.count("*").alias("faces"))
    v = kept.select(*by, F.explode(corner).alias("x")).distinct().groupBy(*by).agg(F.count("*").alias("vertices"))
    e = kept.select(*by, F.explode(side).alias("x")).distinct().groupBy(*by).agg(F.count("*").alias("edges"))
    return f.join(v, by).join(e, by).withColumn("euler", F.col("vertices") - F.col("edges") + F.col("faces"))


def cell_edges(cells: DataFrame, keys: list[str], width: int, diagonal: bool = False) -> tuple[DataFrame, DataFrame]:
    """4-neighbour edges (8 with ``diagonal``) between cells as node numbers (row * width + col): rows are collapsed first, each cell pointing to its run's first, then runs touch downwards."""
    runs = cells.withColumn("__g", F.col("col") - F.row_number().over(Window.partitionBy(*keys, "row").orderBy("col")))
    runs = runs.withColumn("run", F.col("row") * width + F.min("col").over(Window.partitionBy(*keys, "row", "__g")))
    below = runs.select(*keys, (F.col("row") - 1).alias("row"), "col", F.col("run").alias("under"))
    if diagonal:
        below = below.withColumn("col", F.explode(F.sequence(F.col("col") - 1, F.col("col") + 1)))
    return runs.select(*keys, "row", "col", "run").join(below, [*keys, "row", "col"]).select(*keys, "run", "under").distinct(), runs.select(*keys, "row", "col", "run")


def component_geometry(labelled: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Area, centroid, elongation (root ratio of the covariance's eigenvalues, each cell adding 1/12), share of the bounding box, and the peak (value, then the smaller place)."""
    g = labelled.groupBy(*keys).agg(F.count("*").alias("area"), F.avg("row").alias("cy"), F.avg("col").alias("cx"), (F.var_pop("row") + 1 / 12).alias("a"), (F.var_pop("col") + 1 / 12).alias("c"), F.covar_pop("row", "col").alias("b"), F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"), F.max_by(F.struct("row", "col"), F.struct(F.col(value), -F.col("row"), -F.col("col"))).alias("peak"))
    mid, dev = (F.col("a") + F.col("c")) / 2, F.sqrt(F.pow((F.col("a") - F.col("c")) / 2, 2) + F.col("b") * F.col("b"))
    return g.select(*keys, "area", "cy", "cx", F.sqrt((mid + dev) / (mid - dev)).alias("elongation"), (F.col("area") / ((F.col("r1") - F.col("r0") + 1) * (F.col("c1") - F.col("c0") + 1))).alias("fill"), F.col("peak.row").alias("peak_row"), F.col("peak.col").alias("peak_col"))


def overlap_matrix(cells: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Best match of each label of ``a`` among labels of ``b`` by intersection over union (ties: the smaller label); NULL labels are background."""
    pairs = cells.groupBy(*keys, a, b).agg(F.count("*").alias("n"))
    na, nb = Window.partitionBy(*keys, a), Window.partitionBy(*keys, b)
    pairs = pairs.withColumn("na", F.sum("n").over(na)).withColumn("nb", F.sum("n").over(nb)).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    pairs = pairs.withColumn("iou", F.round(F.col("n") / (F.col("na") + F.col("nb") - F.col("n")), 9))
    return pairs.groupBy(*keys, a).agg(F.max_by(F.struct(b, "iou", "n"), F.struct("iou", -F.col(b))).alias("m")).select(*keys, a, F.col(f"m.{b}").alias("match"), F.col("m.iou").alias("iou"), F.col("m.n").alias("common"))


def tile_orientation(grid: DataFrame, value: str, tile: int) -> DataFrame:
    """Structure tensor by central differences, averaged over tiles: angle in degrees, coherence, energy."""
    wr, wc = Window.partitionBy("surface", "row").orderBy("col"), Window.partitionBy("surface", "col").orderBy("row")
    # a hole in the grid gives no derivative across it
    central = lambda w, at: F.when((F.lead(at).over(w) == F.col(at) + 1) & (F.lag(at).over(w) == F.col(at) - 1), (F.lead(value).over(w) - F.lag(value).over(w)) / 2)
    g = grid.select("surface", "row", "col", central(wr, "col").alias("gx"), central(wc, "row").alias("gy")).dropna()
    t = lambda c: F.floor(F.col(c) / tile).cast("int")
    j = g.groupBy("surface", t("row").alias("tr"), t("col").alias("tc")).agg(F.avg(F.col("gx") * F.col("gx")).alias("jxx"), F.avg(F.col("gy") * F.col("gy")).alias("jyy"), F.avg(F.col("gx") * F.col("gy")).alias("jxy"))
    d = F.sqrt(F.pow(F.col("jxx") - F.col("jyy"), 2) + 4 * F.col("jxy") * F.col("jxy"))
    return j.select("surface", "tr", "tc", (0.5 * F.degrees(F.atan2(2 * F.col("jxy"), F.col("jxx") - F.col("jyy")))).alias("angle"), ratio(d, F.col("jxx") + F.col("jyy")).alias("coherence"), (F.col("jxx") + F.col("jyy")).alias("energy"))


def _segment(p: list[Column], a: list[Column], b: list[Column]) -> Column:
    """Squared distance of p to the segment from a to b."""
    d = _minus(b, a)
    t = clamp(F.coalesce(ratio(dot(_minus(p, a), d), dot(d, d)), F.lit(0.0)), 0.0, 1.0)
    r = [pc - ac - t * dc for pc, ac, dc in zip(p, a, d, strict=True)]
    return dot(r, r)


def triangle_distance(p: list[Column], a: list[Column], b: list[Column], c: list[Column]) -> Column:
    """Distance of a point to a triangle: to its plane if the foot lies inside, else to the nearest edge."""
    n = cross(_minus(b, a), _minus(c, a))
    inside = F.lit(True)
    for u, v in ((a, b), (b, c), (c, a)):
        inside = inside & (dot(cross(_minus(v, u), _minus(p, u)), n) >= 0)
    plane = F.abs(dot(_minus(p, a), n)) / norm(n)
    return F.when(inside & (norm(n) > 0), plane).otherwise(F.sqrt(F.least(_segment(p, a, b), _segment(p, b, c), _segment(p, c, a))))


def point_to_mesh(points: DataFrame, corners: DataFrame, key: str, cell: float) -> DataFrame:
    """(key, fid, d): the nearest triangle within ``cell`` (ties: the smaller fid), NULL beyond. corners: fid, ax .. cz.

    A triangle is shown to the cells, of three times that size in x and y, that its box comes within
    ``cell`` of, and a point to its own, so that the two meet once. A point's nearest corner says how far
    its triangle is at most; only triangles whose box is as near as that are measured.
    """
    size, pad, names = 3 * cell, cell * (1 + 1e-9), [k + a for k in "abc" for a in AXES]
    ends = lambda f, a: f(*[F.col(k + a) for k in "abc"])
    t = corners.dropna(subset=names).select("fid", *names)
    p = points.select(key, *AXES)
    for a in "xy":
        t = t.withColumn(f"__{a}", F.explode(F.sequence(F.floor((ends(F.least, a) - pad) / size), F.floor((ends(F.greatest, a) + pad) / size))))
        p = p.withColumn(f"__{a}", F.floor(F.col(a) / size))
    here = ["__x", "__y"]
    near = norm([F.greatest(ends(F.least, a) - F.col(a), F.lit(0.0), F.col(a) - ends(F.greatest, a)) for a in AXES])
    corner = F.least(*[norm([F.col(k + a) - F.col(a) for a in AXES]) for k in "abc"])
    # the fid is asked for in both so that the cells are dealt once
    most = p.join(t, here).where(near <= pad).groupBy(*here, key, *AXES).agg(F.min(F.struct(corner.alias("d"), "fid")).alias("__most"))
    most = most.select(*here, key, *AXES, (F.least(F.lit(pad), F.col("__most.d")) * (1 + 1e-12) + 1e-8).alias("__most"))
    d = triangle_distance(_p(), *[[F.col(k + a) for a in AXES] for k in "abc"])
    best = most.join(t, here).where(near <= F.col("__most")).groupBy(key).agg(F.min(F.when(d <= cell, F.struct(F.round(d, 9).alias("d"), "fid"))).alias("b"))
    return points.select(key).join(best, key, "left").select(key, F.col("b.fid").alias("fid"), F.col("b.d").alias("d"))


def two_axes(rows: DataFrame, keys: list[str], order: list[str], angle: str, weight: str, rounds: int = 24) -> DataFrame:
    """(keys, a, b, wa, wb): two axes of each group by weighted 2-means on axial angles, a < b, and the weight of each.

    Seeds are the heaviest row and that with the greatest distance times weight to it (ties: first by
    ``order``). A group ends when its axes stand still, ``rounds`` at most. Groups that have not two
    different directions, or lose a cluster, abstain with NULL axes.
    """
    from plumbline.operators.graphs import settled

    r = rows.select(*keys, *order, F.pmod(F.col(angle), F.lit(180.0)).alias("t"), F.col(weight).alias("w"))
    first = Window.partitionBy(*keys).orderBy(F.desc("w"), *order)
    r = r.withColumn("a", F.first("t").over(first)).withColumn("s", angle_distance(F.col("t"), F.col("a"), 180.0))
    far = r.groupBy(*keys).agg(F.first("a").alias("a"), F.max_by("t", F.struct(F.col("s") * F.col("w"), *[-F.col(c) for c in order])).alias("b"), F.max("s").alias("apart"))
    now = settled(far.select(*keys, F.when(F.col("apart") > 0, F.col("a")).alias("a"), F.when(F.col("apart") > 0, F.col("b")).alias("b"), (F.col("apart") <= 0).alias("still")))
    r = settled(r.select(*keys, "t", "w"))
    two, near = F.radians(2 * F.col("t")), lambda c: angle_distance(F.col("t"), F.col(c), 180.0)

    def mean(own: Column) -> Column:
        x, y = F.sum(F.when(own, F.col("w") * F.cos(two))), F.sum(F.when(own, F.col("w") * F.sin(two)))
        return F.when(F.sqrt(x * x + y * y) > 1e-15, F.pmod(F.degrees(F.atan2(y, x)) / 2, F.lit(180.0)))

    for _ in range(rounds):
        live = r.join(now.where(~F.col("still")), keys)
        own = near("a") <= near("b")
        new = live.groupBy(*keys).agg(mean(own).alias("na"), mean(~own).alias("nb"), F.first("a").alias("a"), F.first("b").alias("b"))
        lost = F.col("na").isNull() | F.col("nb").isNull()
        moved = F.greatest(angle_distance(F.col("a"), F.col("na"), 180.0), angle_distance(F.col("b"), F.col("nb"), 180.0))
        new = new.select(*keys, F.when(~lost, F.col("na")).alias("a"), F.when(~lost, F.col("nb")).alias("b"), (lost | (moved < 1e-7)).alias("still"))
        now = settled(now.where("still").unionByName(new))
        if now.where(~F.col("still")).isEmpty():
            break
    own = near("a") <= near("b")
    shares = r.join(now, keys).groupBy(*keys).agg(F.first("a").alias("x"), F.first("b").alias("y"), F.sum(F.when(own, F.col("w"))).alias("wx"), F.sum(F.when(~own, F.col("w"))).alias("wy"))
    swap = F.col("x") > F.col("y")
    pick = lambda p, q, c: F.when(F.col("x").isNotNull(), F.when(swap, F.col(q)).otherwise(F.col(p))).alias(c)
    return shares.select(*keys, pick("x", "y", "a"), pick("y", "x", "b"), pick("wx", "wy", "wa"), pick("wy", "wx", "wb"))


def frame_turns(axes: DataFrame, limit: float) -> DataFrame:
    """``axes`` (surface, tr, tc, a, b, ...) with the turn to the next tile to the right and downwards, the better of the two ways to pair their axes, and whether one is over ``limit``; NULL where a tile is missing or abstains."""
    for name, fixed, moving in (("right", "tr", "tc"), ("down", "tc", "tr")):
        w = Window.partitionBy("surface", fixed).orderBy(moving)
        na, nb = F.lead("a").over(w), F.lead("b").over(w)
        d = lambda x, y: angle_distance(x, y, 180.0)
        turn = F.least(F.greatest(d(F.col("a"), na), d(F.col("b"), nb)), F.greatest(d(F.col("a"), nb), d(F.col("b"), na)))
        axes = axes.withColumn(f"turn_{name}", F.when(na.isNotNull() & F.col("a").isNotNull() & (F.lead(moving).over(w) == F.col(moving) + 1), turn))
    worst = F.greatest("turn_right", "turn_down")
    return axes.withColumn("discontinuity", worst > limit)


def centred_normals(cells: DataFrame, key: str) -> DataFrame:
    """(key, row, col, x, y, z, nx, ny, nz): valid vertices whose four neighbours are there and valid, with the unit normal of the centred differences; degenerate ones are left out."""
    ok, along = F.col("valid"), []
    for line, place in (("row", "col"), ("col", "row")):
        w = Window.partitionBy(key, line).orderBy(place)
        ok = ok & F.lag("valid").over(w) & F.lead("valid").over(w) & (F.lead(place).over(w) - F.lag(place).over(w) == 2)
        along.append([F.lead(a).over(w) - F.lag(a).over(w) for a in AXES])
    g = cells.select(key, "row", "col", *AXES, ok.alias("ok"), *[v.alias(f"__{n}{a}") for n, d in enumerate(along) for a, v in zip(AXES, d, strict=True)]).where("ok")
    n = cross(*[[F.col(f"__{k}{a}") for a in AXES] for k in (0, 1)])
    g = g.select(key, "row", "col", *AXES, *[v.alias(f"n{a}") for a, v in zip(AXES, n, strict=True)])
    g = g.withColumn("__l", norm([F.col(f"n{a}") for a in AXES])).where("__l > 1e-8 AND NOT isnan(__l) AND __l < double('Infinity')")
    return g.select(key, "row", "col", *AXES, *[(F.col(f"n{a}") / F.col("__l")).alias(f"n{a}") for a in AXES])
