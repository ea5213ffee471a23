"""Rays through chunked volumes: steps are dealt to the chunks that they cross, read there, and put together again by ray."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("z", "y", "x")
#: Most legs (the steps of one ray in one chunk) that one row holds.
LEGS = 4096


def _value(chunks: DataFrame, column: str, place: Column) -> Column:
    """The value at a place of a chunk's content, an array or bytes."""
    if dict(chunks.dtypes)[column] == "binary":
        byte = F.hex(F.substring(F.col(column), place + 1, F.lit(1)))
        return F.conv(byte, 16, 10).cast("int")
    return F.get(F.col(column), place)


def steps_read(
    rays: DataFrame,
    chunks: DataFrame,
    volume: list[str],
    ray: list[str],
    size: tuple[int, int, int],
    shape: tuple[str, str, str],
    values: list[str],
    most: int,
) -> DataFrame:
    """(volume, ray, sign, steps): for both signs the nearest voxels of pz + sign * d * nz (and y, x) at d = 1 to ``most``.

    rays: volume, ray, pz, py, px, nz, ny, nx (the direction, as it is) and the columns ``shape`` names, the
    volume's extent (a ray without numbers is outside); a ray is unique by (volume, ray). chunks: volume, cz, cy,
    cx and ``values``, contents in z-y-x order of chunks of ``size``. steps is sorted by d: d, inside, and each
    value: NULL outside the extent, 0 where a chunk is absent or its content is NULL, as for arrays whose fill is
    zero, NULL where a content is cut short. Halves round up.

    A ray's steps are cut by chunk within its row; contents move once, and meet rows of at most about LEGS legs, so
    a chunk that very many rays cross is many rows, which an adaptive plan may spread.
    """
    own = {"sign", "steps", "d", "inside", "place", "own", "legs", "got", "best", "hits", *[f"{k}{a}" for k in ("", "p", "n", "s", "c") for a in AXES], *values}
    if own & {*volume, *ray}:
        raise ValueError(f"keys may not be called {sorted(own & {*volume, *ray})}")
    at = lambda a: F.floor(F.col(f"p{a}") + F.col("sign") * F.col("d") * F.col(f"n{a}") + 0.5)
    number = lambda c: F.nullif(F.col(c).cast("double"), F.lit(float("nan"))).alias(c)
    start = rays.select(*volume, *ray, *[number(f"{k}{a}") for k in "pn" for a in AXES], *[F.col(s).alias(f"s{a}") for s, a in zip(shape, AXES, strict=True)])
    walk = start.select("*", F.explode(F.array(F.lit(-1), F.lit(1))).alias("sign")).withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(most))))
    walk = walk.select(*volume, *ray, "sign", "d", *[at(a).alias(a) for a in AXES], *[f"s{a}" for a in AXES])
    inside = F.lit(True)
    for a in AXES:
        inside = inside & F.col(a).isNotNull() & (F.col(a) >= 0) & (F.col(a) < F.col(f"s{a}"))
    place = F.lit(0)
    for a, s in zip(AXES, size, strict=True):
        place = place * s + F.pmod(F.col(a), F.lit(s))
    walk = walk.select(*volume, *ray, "sign", "d", F.coalesce(inside, F.lit(False)).alias("inside"), place.cast("int").alias("place"), *[F.floor(F.col(a) / s).alias(f"c{a}") for a, s in zip(AXES, size, strict=True)])
    cube = ["cz", "cy", "cx"]
    # steps of one ray are neighbours in one task, so the partial aggregate leaves a leg for a ray and chunk
    legs = walk.where("inside").groupBy(*volume, *cube, *ray, "sign").agg(F.collect_list(F.struct("d", "place")).alias("own"))
    crossed = legs.groupBy(*volume, *cube).agg(F.count("*").alias("__n"))
    part = F.pmod(F.xxhash64(*ray, "sign"), F.greatest(F.lit(1), F.ceil(F.col("__n") / LEGS)))
    rows = legs.join(crossed, [*volume, *cube]).groupBy(*volume, *cube, part.alias("__part")).agg(F.collect_list(F.struct(*ray, "sign", "own")).alias("legs"))
    kept = chunks.select(*volume, *cube, *values)
    read = F.transform("legs", lambda leg: F.struct(*[leg[k].alias(k) for k in (*ray, "sign")], F.transform(leg["own"], lambda s: F.struct(s["d"].alias("d"), *[F.when(F.col(v).isNull(), 0.0).otherwise(_value(kept, v, s["place"]).cast("double")).alias(v) for v in values])).alias("own")))
    met = rows.join(kept, [*volume, *cube], "left").select(*volume, read.alias("legs")).select(*volume, F.inline("legs")).select(*volume, *ray, "sign", F.inline("own"))
    found = met.groupBy(*volume, *ray, "sign").agg(F.map_from_entries(F.collect_list(F.struct("d", F.struct(*values)))).alias("got"))
    signs = rays.select(*volume, *ray, F.explode(F.array(F.lit(-1), F.lit(1))).alias("sign"))
    step = F.transform(F.sequence(F.lit(1), F.lit(most)), lambda d: F.struct(d.alias("d"), F.coalesce(F.map_contains_key("got", d), F.lit(False)).alias("inside"), *[F.col("got")[d][v].alias(v) for v in values]))
    return signs.join(found, [*volume, *ray, "sign"], "left").select(*volume, *ray, "sign", step.alias("steps"))


def first_separated_run(marks: Column, nearest: int, gap: int, run: int) -> Column:
    """(start, end, middle) of the first run of at least ``run`` hits that starts at distance ``nearest`` or later, straight after ``gap`` clear steps; NULL if there is none. marks: one character a step, H a hit, C clear, anything else neither."""
    if not (nearest > gap >= 1 and run >= 1):
        raise ValueError("the nearest distance must exceed the gap, gap and run be at least one")
    found = f"^(.{{{nearest - 1 - gap},}}?C{{{gap}}})(H{{{run},}})"
    start = F.length(F.regexp_extract(marks, found, 1)) + 1
    end = start + F.length(F.regexp_extract(marks, found, 2)) - 1
    return F.when(marks.rlike(found), F.struct(start.alias("start"), end.alias("end"), ((start + end) / 2).alias("middle")))


def ray_march(
    rays: DataFrame,
    chunks: DataFrame,
    volume: list[str],
    ray: list[str],
    size: tuple[int, int, int],
    shape: tuple[str, str, str],
    prediction: str,
    support: str,
    threshold: float,
    nearest: int,
    most: int,
    gap: int,
    run: int,
) -> DataFrame:
    """A row a ray: the nearest separated run of predicted and supported voxels along its direction, either way.

    A hit has a prediction above the threshold and support above zero; a step is clear only where the prediction,
    inside the volume, is at most the threshold: missing support never makes a gap. Of both signs the run whose
    middle is nearer is chosen, the negative one in a tie. Columns: volume, ray, status (found or
    no_separated_run), sign, start, end, distance (signed, of the middle), z, y, x (there), vz, vy, vx (its
    voxel), and for each way steps inside and hits (inside_below, hits_below, inside_above, hits_above).
    """
    if most < nearest + run - 1:
        raise ValueError("the run does not fit into the distance")
    sampled = steps_read(rays, chunks, volume, ray, size, shape, [prediction, support], most)
    mark = F.transform("steps", lambda s: F.when(~s["inside"], "O").when(s[prediction] <= threshold, "C").when((s[prediction] > threshold) & (s[support] > 0), "H").otherwise("O"))
    marks = sampled.select(*volume, *ray, "sign", F.size(F.filter("steps", lambda s: s["inside"])).alias("inside"), F.array_join(mark, "").alias("marks"))
    marks = marks.withColumn("hits", F.length(F.translate("marks", "CO", ""))).withColumn("run", first_separated_run(F.col("marks"), nearest, gap, run))
    side = lambda c, sign: F.max(F.when(F.col("sign") == sign, F.col(c)))
    best = F.min(F.when(F.col("run").isNotNull(), F.struct(F.col("run.middle").alias("middle"), "sign", F.col("run.start").alias("start"), F.col("run.end").alias("end"))))
    each = marks.groupBy(*volume, *ray).agg(best.alias("best"), *[side(c, s).alias(f"{c}_{n}") for s, n in ((-1, "below"), (1, "above")) for c in ("inside", "hits")])
    out = rays.select(*volume, *ray, *[F.col(f"{k}{a}").cast("double").alias(f"{k}{a}") for k in "pn" for a in AXES]).join(each, [*volume, *ray])
    out = out.withColumn("distance", F.col("best.sign") * F.col("best.middle"))
    there = {a: F.col(f"p{a}") + F.col("distance") * F.col(f"n{a}") for a in AXES}
    return out.select(
        *volume,
        *ray,
        F.when(F.col("best").isNull(), "no_separated_run").otherwise("found").alias("status"),
        F.col("best.sign").alias("sign"),
        F.col("best.start").alias("start"),
        F.col("best.end").alias("end"),
        "distance",
        *[v.alias(a) for a, v in there.items()],
        *[F.floor(v + 0.5).alias(f"v{a}") for a, v in there.items()],
        "inside_below",
        "hits_below",
        "inside_above",
        "hits_above",
    )


def probe_plan(vertices: DataFrame, keys: list[str], order: list[str], offsets: list[float], halo: int, shape: tuple[int, int, int], probes: int) -> DataFrame:
    """Probes from geometry alone: of the eligible vertices those at midpoint ranks, their points along the normal, and the box that holds these.

    vertices: keys, order, x, y, z, nx, ny, nz, as ``surfaces.centred_normals`` gives them. A vertex is eligible if
    the box of its points (and of itself), grown by ``halo`` and one voxel for the upper neighbour, lies in the
    volume. Columns: keys, order, eligible (of the surface), enough (at least ``probes``), points (offset, z, y, x),
    z0, z1, y0, y1, x0, x1 (half-open).
    """
    from plumbline.operators.sampling import midpoint_ranks

    along = F.array(F.lit(0.0), *[F.lit(float(o)) for o in offsets])
    out = vertices.withColumn("points", F.transform(along, lambda o: F.struct(o.alias("offset"), *[(F.col(a) + o * F.col(f"n{a}")).alias(a) for a in AXES])))
    fits = F.lit(True)
    for a, s in zip(AXES, shape, strict=True):
        where = F.col(f"points.{a}")
        out = out.withColumn(f"{a}0", F.floor(F.array_min(where)) - halo).withColumn(f"{a}1", F.ceil(F.array_max(where)) + halo + 1)
        fits = fits & (F.col(f"{a}0") >= 0) & (F.col(f"{a}1") <= s)
    box = [f"{a}{k}" for a in AXES for k in (0, 1)]
    eligible = out.where(fits).select(*keys, *order, "points", *box)
    counts = eligible.groupBy(*keys).agg(F.count("*").alias("eligible"))
    chosen = midpoint_ranks(eligible, keys, order, probes).join(counts, keys)
    return chosen.select(*keys, *order, "eligible", (F.col("eligible") >= probes).alias("enough"), "points", *box)
