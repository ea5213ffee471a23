"""Pairs, boxes, nearest neighbours, interpolation, traces, skylines."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.catalog.fixtures import BOXES, POINTS, TRACE, boxes, points, table, trace
from plumbline.catalog.registry import query
from plumbline.catalog.voxels import _rounded
from plumbline.functions.numeric import angle_distance
from plumbline.operators import spatial as op


@query(f"""WITH {POINTS}, p AS (SELECT a.frame, CASE WHEN a.w < b.w THEN a.id ELSE b.id END AS "inner", CASE WHEN a.w < b.w THEN b.id ELSE a.id END AS "outer", CASE WHEN a.w < b.w THEN a.r ELSE b.r END AS r_in, CASE WHEN a.w < b.w THEN b.r ELSE a.r END AS r_out
FROM points a JOIN points b ON a.frame = b.frame AND a.id < b.id AND b.z - a.z <= 3 AND abs(a.w - b.w) >= 2 AND least(abs(a.theta - b.theta), 360 - abs(a.theta - b.theta)) <= 40) SELECT *, r_in - r_out > 5 AS inverted FROM p""")
def j04_banded_ray_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.ray_order(points(spark, sf_dir), 3.0, 2, 40.0, 5.0)


@query(f"WITH {POINTS} SELECT a.frame AS frame1, a.id AS id1, b.frame AS frame2, b.id AS id2, round(sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2 + (a.z - b.z) ^ 2), 6) AS d FROM points a JOIN points b ON a.id < b.id AND a.frame <> b.frame AND (a.x - b.x) ^ 2 + (a.y - b.y) ^ 2 + (a.z - b.z) ^ 2 <= 16 AND b.z - a.z <= 4")
def j05_radius_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(op.within_radius(points(spark, sf_dir), "frame", "id", ["x", "y", "z"], 4.0))


@query(f"WITH {BOXES}, {POINTS} SELECT points.id AS point, boxes.id AS box FROM points JOIN boxes ON x >= x0 - 0.5 AND x <= x1 + 0.5 AND y >= y0 - 0.5 AND y <= y1 + 0.5")
def j06_points_in_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir).withColumnRenamed("id", "box")
    p = points(spark, sf_dir).select(F.col("id").alias("point"), "x", "y")
    return op.points_in_boxes(p, b, ["x", "y"], "point", "box", 0.5, 5.0)


@query(f"WITH {BOXES} SELECT a.volume, a.id AS id_a, b.id AS id_b, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS overlap FROM boxes a JOIN boxes b ON a.volume = b.volume AND a.part = 0 AND b.part = 1 AND greatest(a.x0, b.x0) < least(a.x1, b.x1) AND greatest(a.y0, b.y0) < least(a.y1, b.y1)")
def j07_box_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    return op.box_overlaps(b.where("part = 0"), b.where("part = 1"), "volume", ["y", "x"], "id", 8)


@query(f"""WITH {BOXES}, v AS (SELECT volume, part, min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1 FROM boxes GROUP BY ALL)
SELECT a.volume AS fit, b.volume AS held, round(sqrt(greatest(0, a.x0 - b.x1, b.x0 - a.x1) ^ 2 + greatest(0, a.y0 - b.y1 + 40, b.y0 - a.y1 + 40) ^ 2), 6) AS d FROM v a JOIN v b ON a.part = 0 AND b.part = 1""")
def j08_box_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower bounds of distances between the hulls of each volume's halves; a row for each volume, so the pairs are few."""
    v = boxes(spark, sf_dir).groupBy("volume", "part").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    a, b = v.where("part = 0").alias("a"), v.where("part = 1").alias("b")
    dx = F.greatest(F.lit(0), F.col("a.x0") - F.col("b.x1"), F.col("b.x0") - F.col("a.x1"))
    dy = F.greatest(F.lit(0), F.col("a.y0") - F.col("b.y1") + 40, F.col("b.y0") - F.col("a.y1") + 40)
    return a.join(b).select(F.col("a.volume").alias("fit"), F.col("b.volume").alias("held"), F.round(F.sqrt(dx * dx + dy * dy), 6).alias("d"))


_NEAR = f"""{POINTS}, q AS (SELECT * FROM points WHERE id % 2 = 0), t AS (SELECT * FROM points WHERE id % 2 = 1),
c AS (SELECT q.frame, q.id, t.id AS other, round(sqrt((q.x - t.x) ^ 2 + (q.y - t.y) ^ 2), 9) AS d FROM q JOIN t ON q.frame = t.frame AND abs(q.x - t.x) <= 5 AND abs(q.y - t.y) <= 5),
n AS (SELECT q.frame, q.id, b.other, b.d FROM q LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY frame, id ORDER BY d, other) AS k FROM c WHERE d <= 5) b ON q.frame = b.frame AND q.id = b.id AND k = 1)"""


@query(f"WITH {_NEAR} SELECT frame, id, other, round(d, 6) AS d FROM n")
def j09_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return _rounded(op.nearest(p.where("id % 2 = 0"), p.where("id % 2 = 1").withColumnRenamed("id", "other"), ["frame"], ["x", "y"], "id", "other", 5.0, 5.0))


@query(f"""WITH {TRACE}, c AS (SELECT trace_id, ord AS control, x + 0.5 AS x, y FROM trace WHERE ord % 10 = 1), d AS (SELECT c.trace_id, control, ord, round(sqrt((c.x - t.x) ^ 2 + (c.y - t.y) ^ 2), 9) AS d FROM c JOIN trace t USING (trace_id)),
n AS (SELECT *, row_number() OVER (PARTITION BY trace_id, control ORDER BY d, ord) AS k FROM d) SELECT trace_id, control, ord AS nearest, round(d, 6) AS d, coalesce(ord < lag(ord) OVER (PARTITION BY trace_id ORDER BY control), false) AS inverted FROM n WHERE k = 1""")
def j10_control_to_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trace(spark, sf_dir)
    c = t.where("ord % 10 = 1").select("trace_id", F.col("ord").alias("control"), (F.col("x") + 0.5).alias("cx"), F.col("y").alias("cy"))
    d = F.round(F.sqrt(F.pow(F.col("cx") - F.col("x"), 2) + F.pow(F.col("cy") - F.col("y"), 2)), 9)
    best = c.join(t.select("trace_id", "ord", "x", "y"), "trace_id").groupBy("trace_id", "control").agg(F.min(F.struct(d.alias("d"), "ord")).alias("b"))
    out = best.select("trace_id", "control", F.col("b.ord").alias("nearest"), F.round("b.d", 6).alias("d"))
    return out.withColumn("inverted", F.coalesce(F.col("nearest") < F.lag("nearest").over(Window.partitionBy("trace_id").orderBy("control")), F.lit(False)))


@query(f"""WITH {POINTS}, c AS (SELECT 1000.0 * r_regionkey / 4 AS z, 500 + 0.1 * 1000 * r_regionkey / 4 AS y, 600 - 0.05 * 1000 * r_regionkey AS x FROM region), s AS (SELECT z AS z0, lead(z) OVER o AS z1, y AS y0, lead(y) OVER o AS y1, x AS x0, lead(x) OVER o AS x1 FROM c WINDOW o AS (ORDER BY z)),
p AS (SELECT id, z * 1.2::DOUBLE - 50 AS z FROM points) SELECT id, round(z, 6) AS z, round(y0 + (z - z0) / (z1 - z0) * (y1 - y0), 6)::DOUBLE AS cy, round(x0 + (z - z0) / (z1 - z0) * (x1 - x0), 6)::DOUBLE AS cx, z < z0 OR z > z1 AS extrapolated
FROM p JOIN s ON z1 IS NOT NULL AND (z >= z0 OR z0 = (SELECT min(z) FROM c)) AND (z < z1 OR z1 = (SELECT max(z) FROM c))""")
def j18_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("r_regionkey")
    c = table(spark, sf_dir, "region").select((1000.0 * k / 4).alias("z"), (500 + 100.0 * k / 4).alias("y"), (600 - 50.0 * k).alias("x"))
    p = points(spark, sf_dir).select("id", (F.col("z") * 1.2 - 50).alias("z"))
    return _rounded(op.interpolated(p, c, "z", ["y", "x"]))


@query(f"WITH {TRACE}, s AS (SELECT trace_id, ord AS lo, lead(ord) OVER (PARTITION BY trace_id ORDER BY ord) AS hi FROM trace WHERE ord % 9 = 4) SELECT t.trace_id, t.ord, s.lo AS span FROM trace t LEFT JOIN s ON t.trace_id = s.trace_id AND t.ord >= s.lo AND t.ord < s.hi")
def j19_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps to half-open control spans; steps outside all spans stay."""
    t = trace(spark, sf_dir).select("trace_id", "ord")
    s = t.where("ord % 9 = 4").select("trace_id", F.col("ord").alias("lo"), F.lead("ord").over(Window.partitionBy("trace_id").orderBy("ord")).alias("hi"))
    a, b = t.alias("a"), s.alias("b")
    return a.join(b, (F.col("a.trace_id") == F.col("b.trace_id")) & (F.col("a.ord") >= F.col("lo")) & (F.col("a.ord") < F.col("hi")), "left").select("a.trace_id", "a.ord", F.col("lo").alias("span"))


@query(f"WITH {POINTS} SELECT id, round(0.9 * x - 0.1 * y + 5, 6)::DOUBLE AS fx, round(0.2 * x + 1.1 * y - 3, 6)::DOUBLE AS fy FROM points")
def j25_affine_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    return _rounded(points(spark, sf_dir).select("id", (0.9 * x - 0.1 * y + 5).alias("fx"), (0.2 * x + 1.1 * y - 3).alias("fy")))


_STEPS = f"""{TRACE}, d AS (SELECT trace_id, ord, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, z - lag(z) OVER w AS dz FROM trace WINDOW w AS (PARTITION BY trace_id ORDER BY ord)),
s AS (SELECT *, sqrt(dx ^ 2 + dy ^ 2 + dz ^ 2) AS step FROM d), n AS (SELECT *, lead(dx) OVER w AS ex, lead(dy) OVER w AS ey, lead(dz) OVER w AS ez, lead(step) OVER w AS nstep FROM s WINDOW w AS (PARTITION BY trace_id ORDER BY ord)),
m AS (SELECT trace_id, median(step) FILTER (step > 0) AS mid FROM s GROUP BY trace_id),
steps AS (SELECT trace_id, ord, step, CASE WHEN step IS NOT NULL AND nstep IS NOT NULL THEN coalesce(degrees(acos(greatest(-1, least(1, (dx * ex + dy * ey + dz * ez) / nullif(step * nstep, 0))))), 0) END AS turn, coalesce(step > 2 * mid, false) AS is_gap FROM n JOIN m USING (trace_id)),
audit AS (SELECT trace_id, count(*) AS points, sum(step) AS length, count(*) FILTER (is_gap) AS gaps, count(*) FILTER (turn > 90) AS turns FROM steps GROUP BY trace_id)"""


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.trace_steps(trace(spark, sf_dir), "trace_id", "ord", ["x", "y", "z"], 2.0, 90.0)


@query(f"WITH {_STEPS} SELECT trace_id, ord, round(step, 6) AS step, round(turn, 5) AS turn, is_gap, coalesce(turn > 90, false) AS is_turn FROM steps")
def w03_trace_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_steps(spark, sf_dir).withColumn("turn", F.round("turn", 5)))


@query(f"WITH {_STEPS} SELECT trace_id, points, round(length, 6) AS length, gaps, turns, CASE WHEN points < 3 THEN 'short' WHEN gaps + turns > 0 THEN 'findings' ELSE 'clean' END AS status FROM audit")
def a13_trace_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(op.trace_audit(_steps(spark, sf_dir), "trace_id"))


@query(f"WITH {_STEPS}, k AS (SELECT CASE WHEN points < 3 THEN 'short' WHEN gaps + turns > 0 THEN 'findings' ELSE 'clean' END AS status, * FROM audit) SELECT status, count(*) AS traces, sum(points)::BIGINT AS points, sum(gaps)::BIGINT AS gaps, sum(turns)::BIGINT AS turns FROM k GROUP BY ROLLUP (status)")
def a14_corpus_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = op.trace_audit(_steps(spark, sf_dir), "trace_id")
    return a.rollup("status").agg(F.count("*").alias("traces"), F.sum("points").alias("points"), F.sum("gaps").alias("gaps"), F.sum("turns").alias("turns"))


@query(f"WITH {TRACE}, g AS (SELECT trace_id, ord, ord - row_number() OVER (PARTITION BY trace_id ORDER BY ord) AS g FROM trace WHERE x > 20) SELECT trace_id, min(ord) AS first, max(ord) AS last, count(*) AS length FROM g GROUP BY trace_id, g HAVING count(*) >= 3")
def w04_runs_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.islands(trace(spark, sf_dir).withColumn("flag", F.col("x") > 20), ["trace_id"], "ord", "flag", 3)


@query("WITH n AS (SELECT event_type, value, lead(value) OVER (PARTITION BY event_type ORDER BY value) AS nxt FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY nxt - value DESC, value) AS k FROM n WHERE nxt IS NOT NULL) SELECT event_type, round(nxt - value, 6) AS gap, value AS \"from\", nxt AS \"to\" FROM r WHERE k = 1")
def w05_largest_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(op.largest_gap(table(spark, sf_dir, "events"), ["event_type"], "value"))


@query(f"WITH {TRACE}, d AS (SELECT trace_id, y * 3.5::DOUBLE - lag(y * 3.5::DOUBLE) OVER (PARTITION BY trace_id ORDER BY ord) AS d FROM trace), u AS (SELECT trace_id, ((d + 180) % 360 + 360) % 360 - 180 AS d FROM d) SELECT trace_id, round(sum(d) / 360, 6) AS turns, count(*) FILTER (abs(d) > 90) AS wide_steps FROM u GROUP BY trace_id")
def w06_angle_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trace(spark, sf_dir).withColumn("angle", F.col("y") * 3.5)
    return _rounded(op.unwrapped(t, ["trace_id"], "ord", "angle", 360.0))


@query("WITH r AS (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS place, count(*) OVER (PARTITION BY event_type) AS total FROM events) SELECT event_type, event_id, value, place::INTEGER AS place, total, least(25, total) AS emitted FROM r WHERE place <= 25")
def w07_top_per_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.top_per_kind(table(spark, sf_dir, "events").select("event_type", "event_id", "value"), "event_type", [F.desc("value"), "event_id"], 25)


@query("WITH b AS (SELECT s_suppkey, s_acctbal, ntile(8) OVER (ORDER BY s_acctbal, s_suppkey)::INTEGER AS band FROM supplier), m AS (SELECT *, round(abs(s_acctbal - avg(s_acctbal) OVER (PARTITION BY band)), 9) AS f FROM b) SELECT s_suppkey, s_acctbal, band, row_number() OVER (PARTITION BY band ORDER BY f, s_acctbal, s_suppkey) = 1 AS held FROM m")
def w09_band_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.band_holdout(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal", "s_suppkey", 8)


@query("WITH r AS (SELECT p_brand, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM part), q AS (SELECT p_brand, p_retailprice AS q75 FROM r WHERE k = floor(0.75 * n) + 1) SELECT p_brand, p_partkey, p_retailprice >= q75 AS upper FROM r JOIN q USING (p_brand)")
def w10_upper_quartile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice")
    w = Window.partitionBy("p_brand")
    r = p.withColumn("k", F.row_number().over(w.orderBy("p_retailprice", "p_partkey"))).withColumn("n", F.count("*").over(w))
    q = r.where(F.col("k") == F.floor(0.75 * F.col("n")) + 1).select("p_brand", F.col("p_retailprice").alias("q75"))
    return r.join(q, "p_brand").select("p_brand", "p_partkey", (F.col("p_retailprice") >= F.col("q75")).alias("upper"))


_CELLS = f"{POINTS}, cells AS (SELECT frame, floor(z / 100)::INTEGER AS zb, floor(theta / 30)::INTEGER AS tb, w, median(r) AS r, count(*) AS n FROM points GROUP BY ALL)"


@query(f"WITH {_CELLS} SELECT frame, zb, tb, w, round(r, 6) AS r, n FROM cells")
def a16_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(op.crossings(points(spark, sf_dir), 100.0, 12))


@query(f"WITH {_CELLS} SELECT frame, zb, tb, w, round(r, 6) AS r, n, round(r - lag(r) OVER o, 6) AS pitch, w - lag(w) OVER o AS step, w - lag(w) OVER o > 0 AS in_order FROM cells WINDOW o AS (PARTITION BY frame, zb, tb ORDER BY r, w)")
def w12_pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(op.pitch(op.crossings(points(spark, sf_dir), 100.0, 12)))


@query(f"""WITH {_CELLS}, p AS (SELECT *, r - lag(r) OVER o AS pitch, w - lag(w) OVER o AS step FROM cells WINDOW o AS (PARTITION BY frame, zb, tb ORDER BY r, w)), m AS (SELECT frame, median(pitch) AS mid FROM p GROUP BY frame)
SELECT frame, count(*) AS cells, count(*) FILTER (step < 0) AS disorder, count(*) FILTER (pitch > 2 * mid) AS wide, count(*) FILTER (n < 2) AS thin, count(*) FILTER (abs(q.r - p.r) > 30) AS jumps FROM p JOIN m USING (frame) LEFT JOIN (SELECT frame AS f2, zb AS z2, tb AS t2, w AS w2, r FROM cells) q ON f2 = frame AND z2 = zb AND t2 = (tb + 1) % 12 AND w2 = w + CASE WHEN tb = 11 THEN 1 ELSE 0 END GROUP BY frame""")
def a17_conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags by family: order of labels, wide pitch, thin support, jumps to the next sector (over the branch cut the label is one more)."""
    c = op.crossings(points(spark, sf_dir), 100.0, 12)
    p = op.pitch(c)
    p = p.join(p.groupBy("frame").agg(F.median("pitch").alias("mid")), "frame")
    side = c.select("frame", "zb", F.pmod(F.col("tb") - 1, F.lit(12)).alias("tb"), (F.col("w") - F.when(F.col("tb") == 0, 1).otherwise(0)).alias("w"), F.col("r").alias("side"))
    got = p.join(side, ["frame", "zb", "tb", "w"], "left")
    return got.groupBy("frame").agg(F.count("*").alias("cells"), F.count_if(F.col("step") < 0).alias("disorder"), F.count_if(F.col("pitch") > 2 * F.col("mid")).alias("wide"), F.count_if(F.col("n") < 2).alias("thin"), F.count_if(F.abs(F.col("side") - F.col("r")) > 30).alias("jumps"))


@query(f"WITH {POINTS}, m AS (SELECT frame, w, median(z) AS z FROM points GROUP BY ALL), b AS (SELECT frame, CASE WHEN z = 1000 THEN 9 ELSE floor(z / 100)::INTEGER END AS bin, count(*) AS n FROM m WHERE z BETWEEN 0 AND 1000 GROUP BY ALL) SELECT f.frame, r.bin::INTEGER AS bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT frame FROM m) f CROSS JOIN range(0, 10) r(bin) LEFT JOIN b ON b.frame = f.frame AND b.bin = r.bin")
def a15_axial_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = points(spark, sf_dir).groupBy("frame", "w").agg(F.median("z").alias("z"))
    return op.axial_coverage(m, ["frame"], "z", 0.0, 1000.0, 10)


def _way(source: str, name: str, share: str) -> str:
    q = ", ".join(f"round(quantile_cont(d, {p}), 6) AS {name}_{c}" for p, c in ((0.5, "p50"), (0.95, "p95"), (1.0, "max")))
    return f"SELECT frame, avg(coalesce(d <= 2, false)::INTEGER) AS {share}, {q}, count(*) FILTER (d IS NULL) AS {name}_beyond FROM {source} GROUP BY frame"


@query(f"""WITH {_NEAR}, m AS (SELECT t.frame, t.id, min(sqrt((q.x - t.x) ^ 2 + (q.y - t.y) ^ 2)) AS d FROM t LEFT JOIN q ON q.frame = t.frame AND (q.x - t.x) ^ 2 + (q.y - t.y) ^ 2 <= 25 AND abs(q.x - t.x) <= 5 AND abs(q.y - t.y) <= 5 GROUP BY ALL),
a AS ({_way("n", "truth", "recall")}), b AS ({_way("m", "found", "precision")}), k AS (SELECT n.frame, w, avg(coalesce(d <= 2, false)::INTEGER) AS covered FROM n JOIN q USING (id) GROUP BY ALL), z AS (SELECT frame, round(avg((covered > 0)::INTEGER), 6) AS component_recall, round(min(covered), 6) AS worst_component FROM k GROUP BY frame)
SELECT * REPLACE (round(recall, 6) AS recall, round(precision, 6) AS precision), round(least(recall, precision), 6) AS worst FROM a JOIN b USING (frame) JOIN z USING (frame)""")
def a46_surface_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even points against odd ones; a truth component is a winding."""
    p = points(spark, sf_dir)
    return _rounded(op.surface_recovery(p.where("id % 2 = 0"), p.where("id % 2 = 1"), ["frame"], ["x", "y"], 2.0, 5.0, "w"))


@query("WITH n AS (SELECT s_suppkey, s_acctbal, n FROM supplier JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL) ON l_suppkey = s_suppkey) SELECT s_suppkey, s_acctbal, n::DOUBLE AS n FROM n a WHERE NOT EXISTS (SELECT 1 FROM n b WHERE b.s_acctbal >= a.s_acctbal AND b.n <= a.n AND (b.s_acctbal > a.s_acctbal OR b.n < a.n))")
def t05_pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    return op.pareto(table(spark, sf_dir, "supplier").join(n, "s_suppkey"), "s_suppkey", ["s_acctbal"], ["n"])


@query("WITH n AS (SELECT l_suppkey, avg(l_quantity) AS q, round(sum(l_discount) * 100) AS d, count(*) AS c FROM lineitem GROUP BY ALL), p AS (SELECT a.l_suppkey, b.l_suppkey AS other FROM n a JOIN n b ON b.q >= a.q AND b.c >= a.c AND b.d <= a.d AND (b.q > a.q OR b.c > a.c OR b.d < a.d)), k AS (SELECT l_suppkey, count(*) AS dominators, min(other) AS first, max(other) AS last FROM p GROUP BY l_suppkey) SELECT l_suppkey, coalesce(dominators, 0) AS dominators, first, last FROM n LEFT JOIN k USING (l_suppkey)")
def t05_dominated_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who dominates each supplier in mean quantity and number of items (more is better) and total discount (less is): how many, the first and the last."""
    n = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("q"), F.round(F.sum("l_discount") * 100).alias("d"), F.count("*").alias("c"))
    k = op.dominated(n, "l_suppkey", ["q", "c"], ["d"])
    return n.select("l_suppkey").join(k, "l_suppkey", "left").select("l_suppkey", F.coalesce("dominators", F.lit(0)).alias("dominators"), "first", "last")


@query("SELECT event_type, event_id, value FROM events ORDER BY value DESC, event_type, event_id LIMIT 500")
def t01_ordering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The review queue: a full order, cut as a top-k report."""
    return table(spark, sf_dir, "events").select("event_type", "event_id", "value").orderBy(F.desc("value"), "event_type", "event_id").limit(500)


@query(f"WITH {POINTS}, d AS (SELECT id, o, round(least((theta + 120 * o) % 360, 360 - (theta + 120 * o) % 360), 9) AS far FROM points, range(0, 3) r(o)), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY far, abs(o), o) AS k FROM d) SELECT id, o::INTEGER AS option, far FROM k WHERE k = 1")
def t03_best_option(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = points(spark, sf_dir).select("id", "theta", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("o"))
    far = F.round(angle_distance(F.col("theta") + 120 * F.col("o"), F.lit(0.0)), 9)
    best = o.groupBy("id").agg(F.min(F.struct(far.alias("far"), F.abs("o").alias("a"), "o")).alias("b"))
    return best.select("id", F.col("b.o").alias("option"), F.col("b.far").alias("far"))


@query("SELECT user_id, event_id, round(value - median(value) OVER (PARTITION BY user_id), 6) AS over FROM events")
def w13_group_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") - F.median("value").over(Window.partitionBy("user_id"))).alias("over")))


@query(f"""WITH {POINTS}, o AS (SELECT id, 2 * i AS a, 2 * j AS b, 2 * k AS c, i, j, k, theta FROM points, range(-1, 2) r(i), range(-1, 2) s(j), range(-1, 2) t(k))
SELECT o.id, i::INTEGER AS i, j::INTEGER AS j, k::INTEGER AS k, round(x + cos(radians(o.theta)) * a - sin(radians(o.theta)) * b, 6) AS gx, round(y + sin(radians(o.theta)) * a + cos(radians(o.theta)) * b, 6) AS gy, round(z + c, 6) AS gz FROM o JOIN points USING (id)""")
def p26_sampling_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 3 x 3 x 3 lattice of step 2 around every point, turned so that its first axis points outwards."""
    p = points(spark, sf_dir).select("id", "x", "y", "z", F.radians("theta").alias("t"))
    out, up, zero = F.array(F.cos("t"), F.sin("t"), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)), F.array(-F.sin("t"), F.cos("t"), F.lit(0.0))
    return _rounded(op.lattice(p, ["id"], ["x", "y", "z"], 3, 2.0, [out, zero, up]))


@query(f"WITH {_STEPS} SELECT trace_id, ord // 9 AS span, count(*) FILTER (step > 0) AS steps, round(sum(step), 6) AS length, count(*) FILTER (step > 0) >= 4 AND count(*) >= 3 AS eligible FROM steps GROUP BY ALL")
def p21_span_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _steps(spark, sf_dir).groupBy("trace_id", F.expr("ord div 9").cast("int").alias("span")).agg(F.count_if(F.col("step") > 0).alias("steps"), F.sum("step").alias("length"), F.count("*").alias("n"))
    return _rounded(g.withColumn("eligible", (F.col("steps") >= 4) & (F.col("n") >= 3)).drop("n"))


@query(f"WITH {TRACE}, b AS (SELECT trace_id, min(x) AS lo, max(x) AS hi FROM trace GROUP BY ALL), v AS (SELECT n_nationkey AS volume, 40.0::DOUBLE * n_nationkey AS extent FROM nation), f AS (SELECT trace_id, volume FROM b JOIN v ON lo >= 0 AND hi <= extent) SELECT trace_id, min(volume) AS volume, count(*) AS fits, count(*) = 1 AS binding FROM f GROUP BY trace_id")
def p23_box_fits_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces bound to a volume only if it is the one that holds them. Volumes are a small catalogue."""
    b = trace(spark, sf_dir).groupBy("trace_id").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    v = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("volume"), (40.0 * F.col("n_nationkey")).alias("extent"))
    f = b.join(v, (F.col("lo") >= 0) & (F.col("hi") <= F.col("extent"))).groupBy("trace_id").agg(F.min("volume").alias("volume"), F.count("*").alias("fits"))
    return f.withColumn("binding", F.col("fits") == 1)


@query(f"WITH {TRACE}, a AS (SELECT trace_id, ord FROM trace WHERE ord % 20 = 0) SELECT t.trace_id, t.ord, CASE WHEN count(a.ord) > 0 THEN 'near_anchor' ELSE 'scored' END AS status FROM trace t LEFT JOIN a ON t.trace_id = a.trace_id AND abs(t.ord - a.ord) <= 2 GROUP BY ALL")
def p19_anchor_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trace(spark, sf_dir).select("trace_id", "ord")
    near = t.where("ord % 20 = 0").select("trace_id", F.explode(F.sequence(F.col("ord") - 2, F.col("ord") + 2)).alias("ord")).distinct().withColumn("near", F.lit(True))
    return t.join(near, ["trace_id", "ord"], "left").select("trace_id", "ord", F.when(F.col("near"), "near_anchor").otherwise("scored").alias("status"))


@query(f"""WITH {_STEPS}, u AS (SELECT trace_id % 5 AS stratum, trace_id % 2 AS flagged, is_gap FROM steps), c AS (SELECT stratum, count(*) FILTER (flagged = 1 AND is_gap) AS a, count(*) FILTER (flagged = 1 AND NOT is_gap) AS b, count(*) FILTER (flagged = 0 AND is_gap) AS c, count(*) FILTER (flagged = 0 AND NOT is_gap) AS d FROM u GROUP BY stratum)
SELECT round(sum(a) / sum(a + b) - sum(c) / sum(c + d), 6) AS risk_difference, round(sum(a * d / (a + b + c + d)) / sum(b * c / (a + b + c + d)), 6) AS odds FROM c""")
def a34_mantel_haenszel(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _steps(spark, sf_dir).select((F.col("trace_id") % 5).alias("stratum"), (F.col("trace_id") % 2 == 1).alias("f"), "is_gap")
    g, f = F.col("is_gap"), F.col("f")
    c = s.groupBy("stratum").agg(F.count_if(f & g).alias("a"), F.count_if(f & ~g).alias("b"), F.count_if(~f & g).alias("c"), F.count_if(~f & ~g).alias("d"))
    n = F.col("a") + F.col("b") + F.col("c") + F.col("d")
    share = lambda x, y: F.try_divide(F.sum(x), F.sum(F.col(x) + F.col(y)))
    return _rounded(c.agg((share("a", "b") - share("c", "d")).alias("risk_difference"), F.try_divide(F.sum(F.col("a") * F.col("d") / n), F.sum(F.col("b") * F.col("c") / n)).alias("odds")))


@query(f"""WITH {_STEPS}, r AS (SELECT s.trace_id, step, coalesce(step > 2 * mid, false) AS old, coalesce(step > 3 * avg(step) OVER (PARTITION BY s.trace_id, ord // 20), false) AS new FROM steps s JOIN m USING (trace_id)) SELECT count(*) AS steps, count(*) FILTER (old) AS old_flags, count(*) FILTER (new) AS new_flags, count(*) FILTER (old AND new) AS both, CASE WHEN count(*) FILTER (new) = 0 THEN 'INSUFFICIENT' WHEN count(*) FILTER (new) < count(*) FILTER (old) THEN 'ADOPT' ELSE 'KEEP' END AS verdict FROM r""")
def a74_span_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _steps(spark, sf_dir).withColumn("new", F.coalesce(F.col("step") > 3 * F.avg("step").over(Window.partitionBy("trace_id", F.expr("ord div 20"))), F.lit(False)))
    out = s.agg(F.count("*").alias("steps"), F.count_if("is_gap").alias("old_flags"), F.count_if("new").alias("new_flags"), F.count_if(F.col("is_gap") & F.col("new")).alias("both"))
    return out.withColumn("verdict", F.when(F.col("new_flags") == 0, "INSUFFICIENT").when(F.col("new_flags") < F.col("old_flags"), "ADOPT").otherwise("KEEP"))
