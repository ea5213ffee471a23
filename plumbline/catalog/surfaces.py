"""Surface grids and meshes: edges, quads, half-edges, curvature, Euler counts, component geometry."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.catalog.fixtures import GRID, grid
from plumbline.catalog.registry import query
from plumbline.catalog.voxels import _rounded
from plumbline.operators import surfaces as op

_EDGES = f"""{GRID}, ge AS (SELECT surface, row, col, 'right' AS dir, sqrt((lx - x) ^ 2 + (ly - y) ^ 2 + (lz - z) ^ 2) AS length FROM (SELECT *, lead(x) OVER w AS lx, lead(y) OVER w AS ly, lead(z) OVER w AS lz, lead(valid) OVER w AS lv, lead(col) OVER w AS lc FROM grid WINDOW w AS (PARTITION BY surface, row ORDER BY col)) WHERE valid AND lv AND lc = col + 1
UNION ALL SELECT surface, row, col, 'down', sqrt((lx - x) ^ 2 + (ly - y) ^ 2 + (lz - z) ^ 2) FROM (SELECT *, lead(x) OVER w AS lx, lead(y) OVER w AS ly, lead(z) OVER w AS lz, lead(valid) OVER w AS lv, lead(row) OVER w AS lc FROM grid WINDOW w AS (PARTITION BY surface, col ORDER BY row)) WHERE valid AND lv AND lc = row + 1)"""


@query(f"WITH {_EDGES} SELECT surface, row, col, dir, round(length, 6) AS length FROM ge")
def j12_grid_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(op.grid_edges(grid(spark, sf_dir)))


@query(f"""WITH {_EDGES}, q AS (SELECT surface, dir, quantile_cont(length, 0.05) AS p05, median(length) AS p50, quantile_cont(length, 0.95) AS p95, avg(length / 10) AS stretch FROM ge GROUP BY ALL)
SELECT surface, dir, count(*) AS edges, round(any_value(p05), 6) AS p05, round(any_value(p50), 6) AS p50, round(any_value(p95), 6) AS p95, round(any_value(stretch), 6) AS stretch, count(*) FILTER (length > 3 * p50) AS jumps FROM ge JOIN q USING (surface, dir) GROUP BY surface, dir""")
def a08_edge_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(op.edge_metrics(op.grid_edges(grid(spark, sf_dir)), 10.0, 3.0))


_QUADS = f"""{GRID}, qq AS (SELECT a.surface, a.row, a.col, e.x - a.x AS px, e.y - a.y AS py, e.z - a.z AS pz, d.x - r.x AS qx, d.y - r.y AS qy, d.z - r.z AS qz, (r.x - a.x) / 10 AS ux, (r.y - a.y) / 10 AS uy, (r.z - a.z) / 10 AS uz, (d.x - a.x) / 10 AS vx, (d.y - a.y) / 10 AS vy, (d.z - a.z) / 10 AS vz
  FROM grid a JOIN grid r ON r.surface = a.surface AND r.row = a.row AND r.col = a.col + 1 JOIN grid d ON d.surface = a.surface AND d.row = a.row + 1 AND d.col = a.col JOIN grid e ON e.surface = a.surface AND e.row = a.row + 1 AND e.col = a.col + 1 WHERE a.valid AND r.valid AND d.valid AND e.valid),
qn AS (SELECT *, py * qz - pz * qy AS nx, pz * qx - px * qz AS ny, px * qy - py * qx AS nz, ux * ux + uy * uy + uz * uz AS e, ux * vx + uy * vy + uz * vz AS f, vx * vx + vy * vy + vz * vz AS g FROM qq),
quads AS (SELECT surface, row, col, sqrt(nx ^ 2 + ny ^ 2 + nz ^ 2) / 2 AS area, nx / nullif(sqrt(nx ^ 2 + ny ^ 2 + nz ^ 2), 0) AS nx, ny / nullif(sqrt(nx ^ 2 + ny ^ 2 + nz ^ 2), 0) AS ny, nz / nullif(sqrt(nx ^ 2 + ny ^ 2 + nz ^ 2), 0) AS nz,
  sqrt((e + g) / 2 + sqrt(((e - g) / 2) ^ 2 + f * f)) AS s1, sqrt(greatest(0, (e + g) / 2 - sqrt(((e - g) / 2) ^ 2 + f * f))) AS s2 FROM qn)"""


@query(f"WITH {_QUADS} SELECT surface, count(*) AS quads, round(sum(area), 3) AS area, round(median(s1), 4) AS s1, round(median(s2), 4) AS s2, round(median(s1 / nullif(s2, 0)), 4) AS anisotropy, round(median(s1 ^ 2 + s2 ^ 2 + 1 / nullif(s1 ^ 2, 0) + 1 / nullif(s2 ^ 2, 0)), 4) AS dirichlet FROM quads GROUP BY surface")
def a09_quad_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = op.quads(grid(spark, sf_dir), 10.0).groupBy("surface")
    return q.agg(F.count("*").alias("quads"), F.round(F.sum("area"), 3).alias("area"), *[F.round(F.median(c), 4).alias(c) for c in ("s1", "s2", "anisotropy", "dirichlet")])


_REV = f"{_QUADS}, rev AS (SELECT surface, row, col, area, CASE WHEN lc = col + 1 THEN greatest(-1, least(1, nx * lx + ny * ly + nz * lz)) END AS dot FROM (SELECT *, lead(nx) OVER w AS lx, lead(ny) OVER w AS ly, lead(nz) OVER w AS lz, lead(col) OVER w AS lc FROM quads WINDOW w AS (PARTITION BY surface, row ORDER BY col)))"


@query(f"WITH {_REV} SELECT surface, (row // 10)::INTEGER AS tr, (col // 10)::INTEGER AS tc, count(*) AS units, round(sum(area * 2 * sin(acos(dot) / 2) / sqrt(area)) / sum(area), 5) AS curvature, count(*) FILTER (dot < 0) AS reversals FROM rev WHERE dot IS NOT NULL GROUP BY ALL")
def a10_tile_curvature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.tile_curvature(op.reversals(op.quads(grid(spark, sf_dir), 10.0)), 10).withColumn("curvature", F.round("curvature", 5))


_TRI = f"""{_QUADS}, tri AS (SELECT surface, 2 * (row * 100 + col) AS fid, row * 100 + col AS v0, row * 100 + col + 1 AS v1, row * 100 + col + 100 AS v2 FROM quads UNION ALL SELECT surface, 2 * (row * 100 + col) + 1, row * 100 + col + 1, row * 100 + col + 101, row * 100 + col + 100 FROM quads),
h AS (SELECT surface, least(v0, v1) AS lo, greatest(v0, v1) AS hi, CASE WHEN v0 < v1 THEN 1 ELSE -1 END AS way FROM tri UNION ALL SELECT surface, least(v1, v2), greatest(v1, v2), CASE WHEN v1 < v2 THEN 1 ELSE -1 END FROM tri UNION ALL SELECT surface, least(v2, v0), greatest(v2, v0), CASE WHEN v2 < v0 THEN 1 ELSE -1 END FROM tri),
he AS (SELECT surface, lo, hi, count(*) AS faces, sum(way)::BIGINT AS way FROM h GROUP BY ALL)"""


@query(f"WITH {_TRI} SELECT surface, lo, hi, faces, CASE faces WHEN 1 THEN 'boundary' WHEN 2 THEN 'interior' ELSE 'non_manifold' END AS kind, CASE WHEN faces = 2 THEN way = 0 END AS consistent FROM he")
def j14_half_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.half_edges(op.triangles(grid(spark, sf_dir), 100)).drop("way")


@query(f"WITH {_TRI}, v AS (SELECT surface, count(DISTINCT v) AS vertices FROM (SELECT surface, unnest([lo, hi]) AS v FROM he) GROUP BY ALL), f AS (SELECT surface, count(*) AS faces FROM tri GROUP BY ALL) SELECT surface, f.faces, count(*) AS edges, v.vertices, count(*) FILTER (he.faces = 1) AS boundary, count(*) FILTER (he.faces > 2) AS non_manifold, count(*) FILTER (he.faces = 2 AND way <> 0) AS inconsistent, v.vertices - count(*) + f.faces AS euler FROM he JOIN v USING (surface) JOIN f USING (surface) GROUP BY surface, f.faces, v.vertices")
def a11_mesh_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = op.triangles(grid(spark, sf_dir), 100)
    h = op.half_edges(t)
    v = h.select("surface", F.explode(F.array("lo", "hi")).alias("v")).distinct().groupBy("surface").agg(F.count("*").alias("vertices"))
    e = h.groupBy("surface").agg(F.count("*").alias("edges"), F.count_if(F.col("faces") == 1).alias("boundary"), F.count_if(F.col("faces") > 2).alias("non_manifold"), F.count_if((F.col("faces") == 2) & ~F.col("consistent")).alias("inconsistent"))
    return t.groupBy("surface").agg(F.count("*").alias("faces")).join(e, "surface").join(v, "surface").withColumn("euler", F.col("vertices") - F.col("edges") + F.col("faces"))


@query(f"WITH {_TRI}, u AS (SELECT lo, hi, count(DISTINCT (lo % 9, hi % 7 // 6)) + (lo % 13 = 0)::INTEGER AS pairs FROM h GROUP BY lo, hi) SELECT lo, hi FROM u WHERE pairs > 1")
def a12_uv_seams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that carry more than one UV pair; a recipe gives every thirteenth vertex a second chart."""
    t = op.triangles(grid(spark, sf_dir), 100)
    h = op.half_edges(t).select("lo", "hi").distinct()
    uv = h.withColumn("uv", F.explode(F.when(F.col("lo") % 13 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return uv.groupBy("lo", "hi").agg(F.count_distinct("uv").alias("n")).where("n > 1").drop("n")


@query(f"""WITH {GRID}, k AS (SELECT surface, row, col, t FROM grid, (VALUES (0.3::DOUBLE), (0.6), (0.9)) v(t) WHERE p >= t), f AS (SELECT surface, t, count(*) AS faces FROM k GROUP BY ALL),
v AS (SELECT surface, t, count(DISTINCT (r, c)) AS vertices FROM (SELECT surface, t, row + a AS r, col + b AS c FROM k, range(0, 2) x(a), range(0, 2) y(b)) GROUP BY ALL),
e AS (SELECT surface, t, count(DISTINCT (r, c, o)) AS edges FROM (SELECT surface, t, row + a AS r, col AS c, 0 AS o FROM k, range(0, 2) x(a) UNION ALL SELECT surface, t, row, col + b, 1 FROM k, range(0, 2) y(b)) GROUP BY ALL)
SELECT surface, t, faces, vertices, edges, vertices - edges + faces AS euler FROM f JOIN v USING (surface, t) JOIN e USING (surface, t)""")
def a48_euler_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.euler(grid(spark, sf_dir), ["surface"], "p", [0.3, 0.6, 0.9])


@query(f"""WITH {GRID}, l AS (SELECT surface, row // 20 AS label, row, col, p FROM grid WHERE p >= 0.5), g AS (SELECT surface, label, count(*) AS area, avg(row) AS cy, avg(col) AS cx, var_pop(row) + 1 / 12.0::DOUBLE AS a, var_pop(col) + 1 / 12.0::DOUBLE AS c, covar_pop(row, col) AS b, min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM l GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY surface, label ORDER BY p DESC, row, col) AS k FROM l)
SELECT g.surface, g.label, area, round(cy, 6) AS cy, round(cx, 6) AS cx, round(sqrt(((a + c) / 2 + sqrt(((a - c) / 2) ^ 2 + b * b)) / ((a + c) / 2 - sqrt(((a - c) / 2) ^ 2 + b * b))), 6) AS elongation, round(area / ((r1 - r0 + 1) * (c1 - c0 + 1)), 6) AS fill, k.row AS peak_row, k.col AS peak_col FROM g JOIN k ON k.surface = g.surface AND k.label = g.label AND k = 1""")
def a47_component_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = grid(spark, sf_dir).where("p >= 0.5").withColumn("label", F.expr("row div 20"))
    return _rounded(op.component_geometry(lab, ["surface", "label"], "p"))


@query(f"""WITH {GRID}, c AS (SELECT surface, CASE WHEN p > 0.4 THEN row // 7 END AS a, CASE WHEN p > 0.6 THEN row // 5 END AS b FROM grid), n AS (SELECT surface, a, b, count(*) AS n FROM c GROUP BY ALL), w AS (SELECT *, sum(n) OVER (PARTITION BY surface, a) AS na, sum(n) OVER (PARTITION BY surface, b) AS nb FROM n),
i AS (SELECT *, round(n / (na + nb - n), 9) AS iou FROM w WHERE a IS NOT NULL AND b IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY surface, a ORDER BY iou DESC, b) AS k FROM i) SELECT surface, a, b AS match, iou, n AS common FROM k WHERE k = 1""")
def j29_overlap_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = grid(spark, sf_dir).select("surface", F.when(F.col("p") > 0.4, F.expr("row div 7")).alias("a"), F.when(F.col("p") > 0.6, F.expr("row div 5")).alias("b"))
    return op.overlap_matrix(c, ["surface"], "a", "b")


@query(f"""WITH {GRID}, d AS (SELECT surface, row, col, (lead(z) OVER r - lag(z) OVER r) / 2 AS gx, (lead(z) OVER c - lag(z) OVER c) / 2 AS gy FROM grid WINDOW r AS (PARTITION BY surface, row ORDER BY col), c AS (PARTITION BY surface, col ORDER BY row)),
j AS (SELECT surface, (row // 10)::INTEGER AS tr, (col // 10)::INTEGER AS tc, avg(gx * gx) AS jxx, avg(gy * gy) AS jyy, avg(gx * gy) AS jxy FROM d WHERE gx IS NOT NULL AND gy IS NOT NULL GROUP BY ALL)
SELECT surface, tr, tc, round(0.5 * degrees(atan2(2 * jxy, jxx - jyy)), 5)::DOUBLE AS angle, round(sqrt((jxx - jyy) ^ 2 + 4 * jxy * jxy) / nullif(jxx + jyy, 0), 5) AS coherence, round(jxx + jyy, 5) AS energy FROM j""")
def a69_tile_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = op.tile_orientation(grid(spark, sf_dir), "z", 10)
    return t.select("surface", "tr", "tc", *[F.round(c, 5).alias(c) for c in ("angle", "coherence", "energy")])


@query(f"""WITH {GRID}, n AS (SELECT surface, row, col, valid, lag(valid) OVER r AS vl, lead(valid) OVER r AS vr, lag(valid) OVER c AS vu, lead(valid) OVER c AS vd, lead(x) OVER r - lag(x) OVER r AS ax, lead(y) OVER r - lag(y) OVER r AS ay, lead(z) OVER r - lag(z) OVER r AS az, lead(x) OVER c - lag(x) OVER c AS bx, lead(y) OVER c - lag(y) OVER c AS by_, lead(z) OVER c - lag(z) OVER c AS bz FROM grid WINDOW r AS (PARTITION BY surface, row ORDER BY col), c AS (PARTITION BY surface, col ORDER BY row)),
x AS (SELECT surface, row, col, ay * bz - az * by_ AS nx, az * bx - ax * bz AS ny, ax * by_ - ay * bx AS nz FROM n WHERE valid AND vl AND vr AND vu AND vd), m AS (SELECT *, sqrt(nx ^ 2 + ny ^ 2 + nz ^ 2) AS l FROM x)
SELECT surface, row, col, round(nx / l, 6) AS nx, round(ny / l, 6) AS ny, round(nz / l, 6) AS nz FROM m WHERE l > 0""")
def p27_centred_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices with four valid neighbours and a normal that is not degenerate (also the eligibility of the grid)."""
    from plumbline.functions.numeric import cross, norm

    r, c = Window.partitionBy("surface", "row").orderBy("col"), Window.partitionBy("surface", "col").orderBy("row")
    a = [F.lead(x).over(r) - F.lag(x).over(r) for x in op.AXES]
    b = [F.lead(x).over(c) - F.lag(x).over(c) for x in op.AXES]
    ok = F.col("valid") & F.lag("valid").over(r) & F.lead("valid").over(r) & F.lag("valid").over(c) & F.lead("valid").over(c)
    g = grid(spark, sf_dir).select("surface", "row", "col", ok.alias("ok"), *[v.alias(f"a{k}") for k, v in enumerate(a)], *[v.alias(f"b{k}") for k, v in enumerate(b)]).where("ok")
    n = cross([F.col(f"a{k}") for k in range(3)], [F.col(f"b{k}") for k in range(3)])
    g = g.select("surface", "row", "col", *[v.alias(f"n{x}") for x, v in zip(op.AXES, n, strict=True)], norm(n).alias("l")).where("l > 0")
    return g.select("surface", "row", "col", *[F.round(F.col(f"n{x}") / F.col("l"), 6).alias(f"n{x}") for x in op.AXES])


@query(f"WITH {GRID}, a AS (SELECT * FROM grid WHERE valid), b AS (SELECT surface, row, col, x + 0.5::DOUBLE AS x, y, z + (col % 3)::DOUBLE AS z FROM grid WHERE p > 0.1) SELECT a.surface, a.row, a.col, round(sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2 + (a.z - b.z) ^ 2), 6) AS d FROM a JOIN b USING (surface, row, col) WHERE (a.x - b.x) ^ 2 + (a.y - b.y) ^ 2 + (a.z - b.z) ^ 2 <= 2.0")
def j34_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells where two candidate surfaces agree in position."""
    g = grid(spark, sf_dir)
    b = g.where("p > 0.1").select("surface", "row", "col", (F.col("x") + 0.5).alias("bx"), F.col("y").alias("by"), (F.col("z") + F.col("col") % 3).alias("bz"))
    j = g.where("valid").join(b, ["surface", "row", "col"])
    d2 = F.pow(F.col("x") - F.col("bx"), 2) + F.pow(F.col("y") - F.col("by"), 2) + F.pow(F.col("z") - F.col("bz"), 2)
    return j.where(d2 <= 2.0).select("surface", "row", "col", F.round(F.sqrt(d2), 6).alias("d"))


@query(f"WITH {GRID}, r AS (SELECT surface, row, col, CASE WHEN row % 30 BETWEEN 10 AND 19 AND col BETWEEN 40 AND 59 THEN 'hidden' WHEN row % 30 BETWEEN 8 AND 21 AND col BETWEEN 38 AND 61 THEN 'collar' ELSE 'open' END AS zone FROM grid) SELECT surface, zone, count(*) AS cells FROM r GROUP BY ALL")
def p25_rectangle_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = lambda r0, r1, c0, c1: F.expr(f"row % 30 BETWEEN {r0} AND {r1} AND col BETWEEN {c0} AND {c1}")
    z = F.when(inside(10, 19, 40, 59), "hidden").when(inside(8, 21, 38, 61), "collar").otherwise("open")
    return grid(spark, sf_dir).groupBy("surface", z.alias("zone")).agg(F.count("*").alias("cells"))


@query(f"""WITH {GRID}, t AS (SELECT surface, row, col, z, row % 3 = 0 AS hidden, z + (col % 7 - 3) * 0.5::DOUBLE AS found, col % 11 = 0 AS missing FROM grid), e AS (SELECT surface, t.hidden, CASE WHEN missing THEN NULL ELSE abs(found - z) END AS err FROM t WHERE hidden)
SELECT surface, tol, count(*) AS cells, round(avg(coalesce(err <= tol, false)::INTEGER), 6) AS within, round(median(err), 6) AS median_error FROM e, (VALUES (0.5::DOUBLE), (1.0), (1.5)) v(tol) GROUP BY ALL""")
def a79_hidden_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing cells stay in the denominator; the median is of those that are there."""
    err = F.when(F.col("col") % 11 != 0, F.abs((F.col("z") + (F.col("col") % 7 - 3) * 0.5) - F.col("z")))
    g = grid(spark, sf_dir).where("row % 3 = 0").select("surface", err.alias("err"), F.explode(F.array(F.lit(0.5), F.lit(1.0), F.lit(1.5))).alias("tol"))
    return _rounded(g.groupBy("surface", "tol").agg(F.count("*").alias("cells"), F.avg(F.coalesce(F.col("err") <= F.col("tol"), F.lit(False)).cast("double")).alias("within"), F.median("err").alias("median_error")))


@query(f"""WITH {GRID}, n AS (SELECT surface, row, col, abs(lead(z) OVER r - lag(z) OVER r) / 2 AS gx, abs(lag(z) OVER r + lead(z) OVER r + lag(z) OVER c + lead(z) OVER c - 4 * z) AS lap FROM grid WINDOW r AS (PARTITION BY surface, row ORDER BY col), c AS (PARTITION BY surface, col ORDER BY row)), k AS (SELECT * FROM n WHERE gx IS NOT NULL AND lap IS NOT NULL)
SELECT surface, row, col, round((rank() OVER (PARTITION BY surface ORDER BY round(gx, 9)) - 1 + (count(*) OVER (PARTITION BY surface, round(gx, 9)) - 1) / 2.0) / (count(*) OVER (PARTITION BY surface) - 1), 6)::DOUBLE AS gradient, round((rank() OVER (PARTITION BY surface ORDER BY round(lap, 9)) - 1 + (count(*) OVER (PARTITION BY surface, round(lap, 9)) - 1) / 2.0) / (count(*) OVER (PARTITION BY surface) - 1), 6)::DOUBLE AS laplacian FROM k""")
def a56_grid_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.operators.graphs import settled
    from plumbline.operators.sampling import average_rank

    r, c = Window.partitionBy("surface", "row").orderBy("col"), Window.partitionBy("surface", "col").orderBy("row")
    z = F.col("z")
    k = grid(spark, sf_dir).select("surface", "row", "col", F.round(F.abs(F.lead(z).over(r) - F.lag(z).over(r)) / 2, 9).alias("gx"), F.round(F.abs(F.lag(z).over(r) + F.lead(z).over(r) + F.lag(z).over(c) + F.lead(z).over(c) - 4 * z), 9).alias("lap")).dropna()
    k = average_rank(average_rank(settled(k), ["surface"], "gx", "a"), ["surface"], "lap", "b")
    n = F.count("*").over(Window.partitionBy("surface")) - 1
    return k.select("surface", "row", "col", F.round((F.col("a") - 1) / n, 6).alias("gradient"), F.round((F.col("b") - 1) / n, 6).alias("laplacian"))


@query(f"WITH {GRID}, u AS (SELECT surface, row, col, row % 30 BETWEEN 12 AND 15 AND col BETWEEN 30 AND 40 AS unit, row % 30 BETWEEN 10 AND 17 AND col BETWEEN 28 AND 42 AS dilated, p FROM grid) SELECT surface, row // 30 AS piece, round((avg(p) FILTER (unit) - avg(p) FILTER (dilated AND NOT unit)) / sqrt((var_pop(p) FILTER (unit) + var_pop(p) FILTER (dilated AND NOT unit)) / 2), 6) AS contrast FROM u GROUP BY ALL")
def a52_ring_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir)
    unit = g.where("row % 30 BETWEEN 12 AND 15 AND col BETWEEN 30 AND 40").select("surface", "row", "col")
    off = F.sequence(F.lit(-2), F.lit(2))
    around = unit.withColumn("a", F.explode(off)).withColumn("b", F.explode(off)).select("surface", (F.col("row") + F.col("a")).alias("row"), (F.col("col") + F.col("b")).alias("col")).distinct()
    zone = around.join(unit.withColumn("unit", F.lit(True)), ["surface", "row", "col"], "left").select("surface", "row", "col", F.coalesce("unit", F.lit(False)).alias("unit"))
    j = g.join(zone, ["surface", "row", "col"])
    at = lambda f, u: f(F.when(F.col("unit") == u, F.col("p")))
    return _rounded(j.groupBy("surface", F.expr("row div 30").alias("piece")).agg(((at(F.avg, True) - at(F.avg, False)) / F.sqrt((at(F.var_pop, True) + at(F.var_pop, False)) / 2)).alias("contrast")))
