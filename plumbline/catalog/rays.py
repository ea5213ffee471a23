"""Rays along normals, both ways, and probes along them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.catalog.fixtures import GRID, VOXELS, grid, table, voxels
from plumbline.catalog.registry import query
from plumbline.catalog.voxels import _rounded
from plumbline.operators import rays as op
from plumbline.operators.surfaces import centred_normals

_MARCH = f"""WITH {VOXELS}, a AS (SELECT max(vec_id) // 16 + 1 AS layers FROM embeddings),
vox AS (SELECT (chunk // 16) * 4 + z AS z, ((chunk // 4) % 4) * 4 + y AS y, (chunk % 4) * 4 + x AS x, v, ct FROM voxels),
d AS (SELECT vec_id, embedding[1]::DOUBLE AS ez, embedding[2]::DOUBLE AS ey, embedding[3]::DOUBLE AS ex FROM embeddings),
r AS (SELECT vec_id AS ray, (vec_id // 16) * 4 + 1.5::DOUBLE AS pz, ((vec_id // 4) % 4) * 4 + 1.5::DOUBLE AS py, (vec_id % 4) * 4 + 1.5::DOUBLE AS px, ez / l AS nz, ey / l AS ny, ex / l AS nx FROM (SELECT *, sqrt(ez * ez + ey * ey + ex * ex) AS l FROM d)),
w AS (SELECT r.*, s.s AS sign, k.d, floor(pz + s.s * k.d * nz + 0.5)::BIGINT AS z, floor(py + s.s * k.d * ny + 0.5)::BIGINT AS y, floor(px + s.s * k.d * nx + 0.5)::BIGINT AS x FROM r, (SELECT unnest([-1, 1]) AS s) s, range(1, 25) k(d)),
m AS (SELECT ray, sign, d, z >= 0 AND z < 4 * layers AND y >= 0 AND y < 16 AND x >= 0 AND x < 16 AS inside, coalesce(v, 0) AS v, coalesce(ct, 0) AS ct FROM w CROSS JOIN a LEFT JOIN vox USING (z, y, x)),
t AS (SELECT ray, sign, count(*) FILTER (inside) AS inside, count(*) FILTER (inside AND v > 140 AND ct > 0) AS hits, string_agg(CASE WHEN NOT inside THEN 'O' WHEN v <= 140 THEN 'C' WHEN ct > 0 THEN 'H' ELSE 'O' END, '' ORDER BY d) AS marks FROM m GROUP BY ALL),
f AS (SELECT *, length(regexp_extract(marks, '^(.{{2,}}?C{{2}})(H{{2,}})', 1)) + 1 AS first, length(regexp_extract(marks, '^(.{{2,}}?C{{2}})(H{{2,}})', 2)) AS n FROM t),
b AS (SELECT ray, sign, first, first + n - 1 AS last, (2 * first + n - 1) / 2 AS middle, row_number() OVER (PARTITION BY ray ORDER BY 2 * first + n, sign) AS k FROM f WHERE n > 0),
o AS (SELECT ray, max(inside) FILTER (sign = -1) AS inside_below, max(hits) FILTER (sign = -1) AS hits_below, max(inside) FILTER (sign = 1) AS inside_above, max(hits) FILTER (sign = 1) AS hits_above FROM t GROUP BY ray)
SELECT 0 AS volume, ray, CASE WHEN sign IS NULL THEN 'no_separated_run' ELSE 'found' END AS status, sign, first AS start, last AS "end", sign * middle AS distance, round(pz + sign * middle * nz, 6) AS z, round(py + sign * middle * ny, 6) AS y, round(px + sign * middle * nx, 6) AS x, floor(pz + sign * middle * nz + 0.5)::BIGINT AS vz, floor(py + sign * middle * ny + 0.5)::BIGINT AS vy, floor(px + sign * middle * nx + 0.5)::BIGINT AS vx, inside_below, hits_below, inside_above, hits_above
FROM r JOIN o USING (ray) LEFT JOIN (SELECT * FROM b WHERE k = 1) USING (ray)"""


def _volume(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Embeddings as the chunks of one volume, four by four in a layer, with two contents; and a ray from the middle of each, along its first three numbers."""
    each = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("z", "y", "x", c))), lambda s: s[c])
    cube = {"cz": F.expr("chunk div 16"), "cy": F.expr("chunk div 4 % 4"), "cx": F.col("chunk") % 4}
    chunks = voxels(spark, sf_dir).groupBy("chunk").agg(each("v").alias("v"), each("ct").alias("ct")).select(F.lit(0).alias("volume"), *[c.alias(k) for k, c in cube.items()], "v", "ct")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk"), *[F.col("embedding")[k].cast("double").alias(f"e{a}") for k, a in enumerate(op.AXES)])
    length = F.sqrt(F.col("ez") * F.col("ez") + F.col("ey") * F.col("ey") + F.col("ex") * F.col("ex"))
    layers = e.agg(F.max("chunk")).first()[0] // 16 + 1
    rays = e.select(F.lit(0).alias("volume"), F.col("chunk").alias("ray"), *[(4 * c + 1.5).alias(f"p{k[1]}") for k, c in cube.items()], *[(F.col(f"e{a}") / length).alias(f"n{a}") for a in op.AXES])
    return chunks, rays.withColumns({"tall": F.lit(4 * layers), "wide": F.lit(16)})


@query(_MARCH)
def v05_normal_march(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the middle of every chunk, both ways along its direction: the nearest run of prediction and support that a gap of the prediction parts from the start."""
    chunks, rays = _volume(spark, sf_dir)
    return _rounded(op.ray_march(rays, chunks, ["volume"], ["ray"], (4, 4, 4), ("tall", "wide", "wide"), "v", "ct", 140, nearest=5, most=24, gap=2, run=2))


_NORMALS = f"""{GRID}, q AS (SELECT *, lead(col) OVER r - lag(col) OVER r = 2 AND lead(row) OVER c - lag(row) OVER c = 2 AND valid AND lag(valid) OVER r AND lead(valid) OVER r AND lag(valid) OVER c AND lead(valid) OVER c AS ok, lead(x) OVER r - lag(x) OVER r AS ax, lead(y) OVER r - lag(y) OVER r AS ay, lead(z) OVER r - lag(z) OVER r AS az, lead(x) OVER c - lag(x) OVER c AS bx, lead(y) OVER c - lag(y) OVER c AS cy, lead(z) OVER c - lag(z) OVER c AS bz FROM grid WINDOW r AS (PARTITION BY surface, row ORDER BY col), c AS (PARTITION BY surface, col ORDER BY row)),
nn AS (SELECT surface, row, col, x, y, z, ay * bz - az * cy AS nx, az * bx - ax * bz AS ny, ax * cy - ay * bx AS nz FROM q WHERE ok), normals AS (SELECT surface, row, col, x, y, z, nx / l AS nx, ny / l AS ny, nz / l AS nz FROM (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS l FROM nn) WHERE l > 1e-8)"""


@query(f"""WITH {_NORMALS}, p AS (SELECT surface, row, col, x + o * nx AS x, y + o * ny AS y, z + o * nz AS z FROM normals, (SELECT unnest([0.0, -6.0, -3.0, 3.0, 6.0])::DOUBLE AS o)),
b AS (SELECT surface, row, col, floor(min(z))::BIGINT - 2 AS z0, ceil(max(z))::BIGINT + 3 AS z1, floor(min(y))::BIGINT - 2 AS y0, ceil(max(y))::BIGINT + 3 AS y1, floor(min(x))::BIGINT - 2 AS x0, ceil(max(x))::BIGINT + 3 AS x1 FROM p GROUP BY ALL),
e AS (SELECT *, row_number() OVER (PARTITION BY surface ORDER BY row, col) - 1 AS place, count(*) OVER (PARTITION BY surface) AS eligible FROM b WHERE z0 >= 0 AND y0 >= 0 AND x0 >= 0 AND z1 <= 400 AND y1 <= 1000000000 AND x1 <= 980)
SELECT surface, row, col, eligible, eligible >= 200 AS enough, 5::INTEGER AS points, z0, z1, y0, y1, x0, x1 FROM e WHERE eligible <= 200 OR place IN (SELECT unnest(list_transform(range(0, 200), lambda i: ((2 * i + 1) * eligible) // 400)))""")
def v06_normal_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hundred probes a surface at midpoint ranks of the vertices whose points along the normal, with their halo, lie in the volume."""
    plan = op.probe_plan(centred_normals(grid(spark, sf_dir), "surface"), ["surface"], ["row", "col"], [-6, -3, 3, 6], 2, (400, 1000000000, 980), 200)
    return plan.withColumn("points", F.size("points"))
