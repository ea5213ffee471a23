"""Chunked arrays: metrics, scores, censuses, supports, neighbourhoods."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.catalog.fixtures import VOXELS, table, voxels
from plumbline.catalog.registry import query
from plumbline.operators import voxels as op

_K = ["volume", "chunk"]
_METRICS = f"""{VOXELS},
steps AS (SELECT *, abs(v - lag(v) OVER (PARTITION BY volume, chunk, y, x ORDER BY z)) AS dz, abs(v - lag(v) OVER (PARTITION BY volume, chunk, z, x ORDER BY y)) AS dy,
  abs(v - lag(v) OVER (PARTITION BY volume, chunk, z, y ORDER BY x)) AS dx FROM voxels),
plane AS (SELECT volume, chunk, z, avg((v <> 0)::INTEGER) AS fill FROM voxels GROUP BY ALL),
dead AS (SELECT volume, chunk, count(*) FILTER (fill = 0 AND a > 0 AND b > 0) AS dead_slices FROM (SELECT *, lag(fill) OVER w AS a, lead(fill) OVER w AS b FROM plane WINDOW w AS (PARTITION BY volume, chunk ORDER BY z)) GROUP BY ALL),
metrics AS (SELECT volume, chunk, avg((v <> 0)::INTEGER) AS nonzero_frac, avg(v) AS mean, stddev_pop(v) AS std, quantile_cont(v::DOUBLE, 0.01) AS p1, quantile_cont(v::DOUBLE, 0.5) AS p50, quantile_cont(v::DOUBLE, 0.99) AS p99,
  quantile_cont(v::DOUBLE, 0.99) - quantile_cont(v::DOUBLE, 0.01) AS dyn_range, avg((v = 255)::INTEGER) AS sat_frac, (avg(dz) + avg(dy) + avg(dx)) / 3 AS grad_energy FROM steps GROUP BY ALL),
m AS (SELECT metrics.*, dead_slices FROM metrics JOIN dead USING (volume, chunk))"""


def _score(prefix: str = "") -> str:
    return f"greatest(0, least(100, 40 * least(1, {prefix}nonzero_frac / 0.9) + 30 * least(1, {prefix}grad_energy / 12.0) + 20 * least(1, {prefix}dyn_range / 200.0) - 25 * least(1, {prefix}sat_frac / 0.05) - least(30, 15.0 * {prefix}dead_slices)))::DOUBLE"


_SCORES = f"""{_METRICS}, s AS (SELECT *, {_score()} AS s FROM m),
roll AS (SELECT volume, avg(nonzero_frac) AS nonzero_frac, avg(grad_energy) AS grad_energy, avg(dyn_range) AS dyn_range, avg(sat_frac) AS sat_frac, sum(dead_slices) AS dead_slices, count(*) AS chunks, stddev_pop(s) AS score_std, min(s) AS score_min, max(s) AS score_max FROM s GROUP BY volume),
scores AS (SELECT *, {_score()} AS score FROM roll)"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes])


@query(f"WITH {_METRICS} SELECT volume, chunk, round(nonzero_frac, 6) AS nonzero_frac, round(mean, 6) AS mean, round(std, 6) AS std, round(p1, 6) AS p1, round(p50, 6) AS p50, round(p99, 6) AS p99, round(dyn_range, 6) AS dyn_range, round(sat_frac, 6) AS sat_frac, round(grad_energy, 6) AS grad_energy, dead_slices FROM m")
def a01_chunk_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(op.chunk_metrics(voxels(spark, sf_dir), _K))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.volume_scores(op.chunk_metrics(voxels(spark, sf_dir), _K), "volume")


@query(f"WITH {_SCORES} SELECT volume, chunks, dead_slices::BIGINT AS dead_slices, round(score, 6) AS score, round(score_std, 6) AS score_std, round(score_min, 6) AS score_min, round(score_max, 6) AS score_max FROM scores")
def a02_volume_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_scores(spark, sf_dir).select("volume", "chunks", "dead_slices", "score", "score_std", "score_min", "score_max"))


@query(f"WITH {_SCORES}, r AS (SELECT volume, round(score, 6) AS score FROM scores) SELECT volume, score, row_number() OVER (ORDER BY score DESC, volume)::INTEGER AS rank, CASE WHEN score >= 70 THEN 'S' WHEN score >= 60 THEN 'A' WHEN score >= 45 THEN 'B' ELSE 'C' END AS tier, CASE WHEN score = 80 THEN 75 WHEN score >= 25 AND score < 80 THEN (floor(score / 5) * 5)::INTEGER END AS bin FROM r")
def a02_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.leaderboard(_rounded(_scores(spark, sf_dir).select("volume", "score")), "volume")


@query("SELECT lang, count(*) FILTER (source = 'src0') AS src0, count(*) FILTER (source = 'src1') AS src1, count(*) FILTER (source IS NULL OR source NOT IN ('src0', 'src1')) AS other FROM documents GROUP BY lang")
def a03_status_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.status_counts(table(spark, sf_dir, "documents"), ["lang"], "source", ["src0", "src1"])


@query("SELECT event_type, count(*) AS n, min(value) AS lo, round(quantile_cont(value, 0.1), 6) AS p10, round(median(value), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, max(value) AS hi FROM events GROUP BY event_type")
def a04_metric_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(op.distribution(table(spark, sf_dir, "events"), ["event_type"], "value", {"lo": 0.0, "p10": 0.1, "p50": 0.5, "p90": 0.9, "hi": 1.0}))


_SUPPORT = f"""{VOXELS}, a AS (SELECT volume, chunk, count(*) AS voxels, count(*) FILTER (v > 0) AS positives, count(*) FILTER (v > 0 AND ct <> 0) AS supported, count(*) FILTER (v > 0 AND ct = 0) AS phantom FROM voxels GROUP BY ALL)"""


@query(f"WITH {_SUPPORT} SELECT *, round(supported / nullif(positives, 0), 6) AS support, CASE WHEN voxels = 0 THEN 'unverified' WHEN phantom = 0 THEN 'seed_safe' ELSE 'requires_filter' END AS status FROM a")
def a44_support_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(op.support_audit(voxels(spark, sf_dir), _K, "v", "ct"))


@query(f"WITH {_SUPPORT} SELECT sum(positives)::BIGINT AS positives, sum(phantom)::BIGINT AS phantom, bool_and(voxels > 0) AS complete, round(1 - sum(phantom) / sum(positives), 6) AS support FROM a")
def a05_pooled_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(op.pooled_support(op.support_audit(voxels(spark, sf_dir), _K, "v", "ct")))


@query("""WITH l AS (SELECT page_id % 4 AS level, page_id || '/' || url AS key, length(html) // 500 AS size FROM pages),
x(level, expected) AS (VALUES (0::BIGINT, 2::BIGINT), (1, 4), (2, NULL), (3, 999), (5, 1)),
b AS (SELECT l.level, l.key, row_number() OVER (PARTITION BY l.level ORDER BY l.key) AS k FROM l JOIN x USING (level) WHERE size <> expected),
s AS (SELECT level, count(*) AS objects FROM l GROUP BY level), e AS (SELECT level, count(*) AS bad, string_agg(key, ',' ORDER BY k) FILTER (k <= 5) AS examples FROM b GROUP BY level)
SELECT x.level, expected, coalesce(objects, 0) AS objects, coalesce(bad, 0) AS bad, examples, CASE WHEN expected IS NULL THEN 'not_applicable' WHEN coalesce(objects, 0) = 0 THEN 'unverified' WHEN coalesce(bad, 0) > 0 THEN 'mismatch' ELSE 'ok' END AS status FROM x LEFT JOIN s USING (level) LEFT JOIN e USING (level)""")
def a06_size_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page sizes against declared ones: level 3 declares a size that none of its objects has, level 2 is compressed, level 5 has no object."""
    listing = table(spark, sf_dir, "pages").select((F.col("page_id") % 4).alias("level"), F.concat_ws("/", F.col("page_id").cast("string"), "url").alias("key"), F.expr("length(html) div 500").alias("size"))
    rows = [(0, [1, 2], 1, True), (1, [2, 2], 1, True), (2, [2, 2], 1, False), (3, [9, 111], 1, True), (5, [1], 1, True)]
    return op.size_census(listing, spark.createDataFrame(rows, "level long, chunks array<long>, itemsize int, plain boolean"), "level", "key", "size")


@query(f"WITH {VOXELS}, h AS (SELECT volume, ct, count(*) AS n FROM voxels GROUP BY ALL) SELECT volume, count(*) AS values, sum(CASE WHEN ct <> 0 THEN n ELSE 0 END)::BIGINT AS nonzero, CASE WHEN sum(CASE WHEN ct <> 0 THEN n ELSE 0 END) = 0 THEN 'unverified' WHEN count(*) <= 2 THEN 'binary' ELSE 'graded' END AS kind FROM h GROUP BY volume")
def a42_value_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.value_census(voxels(spark, sf_dir), ["volume"], "ct")


@query(f"""WITH {VOXELS}, h AS (SELECT volume, v AS t, count(*) AS n FROM voxels GROUP BY ALL),
r AS (SELECT volume, t, sum(n) OVER o / sum(n) OVER p AS w, sum(n * t) OVER o / sum(n) OVER p AS m, sum(n * t) OVER p / sum(n) OVER p AS mt, sum(n * t * t) OVER p / sum(n) OVER p AS s FROM h
  WINDOW o AS (PARTITION BY volume ORDER BY t), p AS (PARTITION BY volume)),
f AS (SELECT volume, t, round((mt * w - m) ^ 2 / nullif(w * (1 - w) * (s - mt * mt), 0), 9) AS eta FROM r WHERE w < 1)
SELECT volume, max(eta) AS eta, arg_max(t, eta * 1000000000 - t / 1000.0) AS threshold FROM f GROUP BY volume""")
def a43_otsu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.otsu(voxels(spark, sf_dir), ["volume"], "v")


@query(f"""WITH {VOXELS}, g AS (SELECT * FROM voxels WHERE v > 0 AND ct = 0), f AS (SELECT * FROM voxels WHERE v > 0 AND ct <> 0),
d AS (SELECT g.volume, g.chunk, g.z, g.y, g.x, sqrt(min((g.z - f.z) ^ 2 + (g.y - f.y) ^ 2 + (g.x - f.x) ^ 2)) AS d FROM g LEFT JOIN f USING (volume, chunk) GROUP BY ALL)
SELECT volume, CASE WHEN d IS NULL THEN -1 ELSE (d > 1)::INTEGER + (d > 1.5)::INTEGER + (d > 2)::INTEGER END AS bin, count(*) AS n FROM d GROUP BY ALL""")
def a45_support_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.support_distance(voxels(spark, sf_dir), _K, "v", "ct", [1.0, 1.5, 2.0]).groupBy("volume", "bin").agg(F.sum("n").alias("n"))


@query(f"""WITH RECURSIVE b(budget) AS (SELECT 0 UNION ALL SELECT budget + 1 FROM b WHERE budget < 4), {_SCORES}
SELECT volume, budget, round(greatest(0, least(100, 40 * least(1, nonzero_frac / 0.9) + 30 * least(1, grad_energy / 12.0) + 20 * least(1, dyn_range / 200.0) - 25 * least(1, sat_frac / 0.05) - least(30, 15.0 * budget)))::DOUBLE, 6) AS score FROM scores, b""")
def a73_dead_slice_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scores(spark, sf_dir).withColumn("budget", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return _rounded(s.select("volume", "budget", op.quality_score(F.col("nonzero_frac"), F.col("grad_energy"), F.col("dyn_range"), F.col("sat_frac"), F.col("budget")).alias("score")))


@query(f"""WITH {VOXELS}, c AS (SELECT volume, chunk // 100 AS cz, (chunk // 10) % 10 AS cy, chunk % 10 AS cx, bool_or(v = 255) AS has FROM voxels GROUP BY ALL)
SELECT c.volume, c.cz, c.cy, c.cx, any_value(c.has) AS has, CASE WHEN any_value(c.has) THEN 'supported' WHEN bool_or(coalesce(n.has, false)) THEN 'halo' WHEN count(n.cz) < 26 THEN 'unresolved' ELSE 'beyond' END AS class
FROM c LEFT JOIN c n ON c.volume = n.volume AND abs(c.cz - n.cz) <= 1 AND abs(c.cy - n.cy) <= 1 AND abs(c.cx - n.cx) <= 1 AND NOT (c.cz = n.cz AND c.cy = n.cy AND c.cx = n.cx) GROUP BY c.volume, c.cz, c.cy, c.cx""")
def j13_neighbour_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = voxels(spark, sf_dir).groupBy("volume", F.expr("chunk div 100").alias("cz"), F.expr("(chunk div 10) % 10").alias("cy"), (F.col("chunk") % 10).alias("cx")).agg(F.bool_or(F.col("v") == 255).alias("has"))
    return op.neighbour_classes(c, "volume", "has").select("volume", "cz", "cy", "cx", "has", "class")


@query(f"""WITH {VOXELS}, p AS (SELECT volume, chunk, z + 0.25::DOUBLE AS pz, y + 0.5::DOUBLE AS py, x + 0.75::DOUBLE AS px, z * 16 + y * 4 + x AS pid FROM voxels),
c AS (SELECT p.*, k, floor(pz)::INTEGER + (k & 1) AS z, floor(py)::INTEGER + ((k >> 1) & 1) AS y, floor(px)::INTEGER + (k >> 2) AS x,
  (CASE WHEN k & 1 = 1 THEN 0.25 ELSE 0.75 END * 0.5 * CASE WHEN k >> 2 = 1 THEN 0.75 ELSE 0.25 END)::DOUBLE AS wt FROM p, range(0, 8) r(k))
SELECT c.volume, c.chunk, pid, round(CASE WHEN count(v) = 8 THEN sum(wt * v) END, 6) AS sampled FROM c LEFT JOIN voxels USING (volume, chunk, z, y, x) GROUP BY ALL""")
def j15_trilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = voxels(spark, sf_dir)
    p = v.select("volume", "chunk", (F.col("z") * 16 + F.col("y") * 4 + F.col("x")).alias("pid"), (F.col("z") + 0.25).alias("pz"), (F.col("y") + 0.5).alias("py"), (F.col("x") + 0.75).alias("px"))
    return _rounded(op.trilinear(p, v, _K))


@query(f"""WITH {VOXELS}, p AS (SELECT volume, chunk, z, y, x, floor(z * 1.3 + 0.5)::INTEGER AS nz, floor(y * 1.3 + 0.5)::INTEGER AS ny, x AS nx FROM voxels)
SELECT p.volume, p.chunk, p.z, p.y, p.x, q.v AS sampled FROM p LEFT JOIN voxels q ON p.volume = q.volume AND p.chunk = q.chunk AND nz = q.z AND ny = q.y AND nx = q.x""")
def j16_nearest_voxel(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = voxels(spark, sf_dir)
    near = lambda c: F.floor(F.col(c) * 1.3 + 0.5).cast("int")
    p = v.select(*_K, "z", "y", "x", near("z").alias("nz"), near("y").alias("ny"), F.col("x").alias("nx"))
    return p.join(v.select(*_K, F.col("z").alias("nz"), F.col("y").alias("ny"), F.col("x").alias("nx"), F.col("v").alias("sampled")), [*_K, "nz", "ny", "nx"], "left").select(*_K, "z", "y", "x", "sampled")


@query(f"""WITH {VOXELS}, c AS (SELECT volume, chunk, wy, wx, sum((v > 128)::INTEGER) AS mass FROM voxels, range(0, 3) a(wy), range(0, 3) b(wx) WHERE y BETWEEN wy AND wy + 1 AND x BETWEEN wx AND wx + 1 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY volume, chunk ORDER BY mass DESC, wy, wx) AS k FROM c) SELECT volume, chunk, wy::INTEGER AS y0, wx::INTEGER AS x0, mass::BIGINT AS mass FROM r WHERE k = 1""")
def p22_max_mass_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.max_window(voxels(spark, sf_dir).withColumn("set", (F.col("v") > 128).cast("int")), _K, 2, 1, 4)


@query(f"WITH {VOXELS} SELECT volume, chunk, z, y, x, CASE WHEN ct <> 0 THEN v ELSE 0 END AS pred FROM voxels")
def p12_mask_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxels(spark, sf_dir).select(*_K, "z", "y", "x", F.when(F.col("ct") != 0, F.col("v")).otherwise(0).alias("pred"))


@query(f"""WITH {VOXELS}, s AS (SELECT vec_id AS chunk, vec_id % 6 AS z, vec_id % 4 AS y, vec_id % 5 AS x FROM embeddings)
SELECT CASE WHEN v IS NULL THEN 'unverified' WHEN ct <> 0 THEN 'accepted' ELSE 'rejected_ct_zero' END AS status, count(*) AS n FROM s LEFT JOIN voxels USING (chunk, z, y, x) GROUP BY ALL""")
def p13_seed_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk"), (F.col("vec_id") % 6).alias("z"), (F.col("vec_id") % 4).alias("y"), (F.col("vec_id") % 5).alias("x"))
    got = s.join(voxels(spark, sf_dir), ["chunk", "z", "y", "x"], "left")
    return got.groupBy(F.when(F.col("v").isNull(), "unverified").when(F.col("ct") != 0, "accepted").otherwise("rejected_ct_zero").alias("status")).agg(F.count("*").alias("n"))


@query(f"WITH {VOXELS} SELECT volume, chunk, z, y, x, v FROM voxels WHERE z >= 1 AND z < 3 AND y >= 0 AND y < 2 AND x >= 2 AND x < 4")
def p11_box_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxels(spark, sf_dir).where("z >= 1 AND z < 3 AND y >= 0 AND y < 2 AND x >= 2 AND x < 4").select(*_K, "z", "y", "x", "v")


@query(f"""WITH {VOXELS}, q AS (SELECT volume, quantile_cont(v::DOUBLE, 0.05) AS lo, quantile_cont(v::DOUBLE, 0.95) AS hi FROM voxels GROUP BY volume)
SELECT volume, chunk, z, y, x, round(least(1, greatest(0, (v - lo) / nullif(hi - lo, 0))), 6) AS norm FROM voxels JOIN q USING (volume)""")
def p15_percentile_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = voxels(spark, sf_dir)
    q = v.groupBy("volume").agg(F.percentile("v", F.array(F.lit(0.05), F.lit(0.95))).alias("q"))
    span = F.col("q")[1] - F.col("q")[0]
    return _rounded(v.join(q, "volume").select(*_K, "z", "y", "x", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(F.col("v") - F.col("q")[0], span))).alias("norm")))


@query(f"""WITH {VOXELS}, c AS (SELECT volume, chunk, z // 2 AS bz, count(*) AS n, count(*) FILTER (v > 127) AS pos FROM voxels GROUP BY ALL), t AS (SELECT volume, chunk, z // 2 AS bz, count(*) FILTER (ct > 0) AS ct FROM voxels WHERE chunk % 7 <> 0 GROUP BY ALL)
SELECT volume, chunk, bz, pos, CASE WHEN ct IS NULL THEN pos ELSE greatest(pos - ct, 0) END AS phantom FROM c LEFT JOIN t USING (volume, chunk, bz)""")
def j02_chunk_nested_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-chunks of the prediction against the scan's; where the scan has no chunk all positives are phantom."""
    v = voxels(spark, sf_dir).withColumn("bz", F.expr("z div 2").cast("int"))
    pred = v.groupBy(*_K, "bz").agg(F.count_if(F.col("v") > 127).alias("pos"))
    ct = v.where(F.col("chunk") % 7 != 0).groupBy(*_K, "bz").agg(F.count_if(F.col("ct") > 0).alias("ct"))
    return pred.join(ct, [*_K, "bz"], "left").select(*_K, "bz", "pos", F.when(F.col("ct").isNull(), F.col("pos")).otherwise(F.greatest(F.col("pos") - F.col("ct"), F.lit(0))).alias("phantom"))


_R = "CASE WHEN {c} < 0 THEN -1 - {c} WHEN {c} > 3 THEN 7 - {c} ELSE {c} END"


def _pass(name: str, source: str, axis: str, value: str) -> str:
    axes = ", ".join(f"d.{a}" for a in ("z", "y", "x"))
    on = " AND ".join(f"s.{a} = {_R.format(c='(d.' + a + ' + k)') if a == axis else 'd.' + a}" for a in ("z", "y", "x"))
    return f"{name} AS (SELECT d.volume, d.chunk, {axes}, sum(s.{value} * CASE k WHEN 0 THEN 0.5 ELSE 0.25 END) AS s FROM voxels d CROSS JOIN range(-1, 2) r(k) JOIN {source} s ON s.volume = d.volume AND s.chunk = d.chunk AND {on} GROUP BY ALL)"


@query(f"WITH {VOXELS}, {_pass('s1', 'voxels', 'z', 'v')}, {_pass('s2', 's1', 'y', 's')}, {_pass('s3', 's2', 'x', 's')} SELECT volume, chunk, z, y, x, round(s, 6)::DOUBLE AS s FROM s3")
def v02_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(op.smoothed(voxels(spark, sf_dir), _K, "v", [0.25, 0.5, 0.25], 4))


@query()
def v03_plate_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of two smoothing scales; eigenvalues have no form in SQL, tested against numpy's."""
    v = voxels(spark, sf_dir).withColumn("u", F.col("v") / 255.0)
    return op.multiscale_plates(v, _K, "u", [0.6, 1.0], 4)
