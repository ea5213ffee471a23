"""Registrations by landmarks and model releases, bound to orders and to customers."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.catalog.fixtures import table
from plumbline.catalog.registry import query
from plumbline.catalog.voxels import _rounded
from plumbline.operators import records as op

_MATRIX = [2.0, 0.0, 0.5, 10.0, 0.0, 1.5, 0.0, -4.0, 0.25, 0.0, 3.0, 7.0]
_MAPPED = "2.0::DOUBLE * {0} + 0.5::DOUBLE * {2} + 10", "1.5::DOUBLE * {1} - 4", "0.25::DOUBLE * {0} + 3.0::DOUBLE * {2} + 7"
_HYP = " UNION ALL ".join(
    f"SELECT id, {n} AS n, '{d}' AS direction, '{o}' AS axes, " + " + ".join(f"({e.format(*[s + a for a in o])} * k - {t}{o[r]}) ^ 2" for r, e in enumerate(_MAPPED)) + " AS g FROM l"
    for n, (d, o, s, t) in enumerate((d, o, *p) for d, p in (("moving_to_fixed", "mf"), ("fixed_to_moving", "fm")) for o in ("xyz", "zyx"))
)


@query(f"""WITH b AS (SELECT o_custkey AS id, o_custkey % 4 AS kind, CASE WHEN o_custkey % 17 = 0 THEN 0 ELSE 1 END AS k, (o_orderkey % 97)::DOUBLE AS x, (o_orderkey % 89)::DOUBLE AS y, o_totalprice / 10000 AS z FROM orders),
w AS (SELECT *, {_MAPPED[0].format('x', 'y', 'z')} AS ax, {_MAPPED[1].format('x', 'y', 'z')} AS ay, {_MAPPED[2].format('x', 'y', 'z')} + CASE WHEN kind = 3 THEN 30 * (x % 3) ELSE 0 END AS az FROM b),
l AS (SELECT id, k, CASE kind WHEN 2 THEN x WHEN 1 THEN az ELSE ax END AS fx, CASE kind WHEN 2 THEN y ELSE ay END AS fy, CASE kind WHEN 2 THEN z WHEN 1 THEN ax ELSE az END AS fz, CASE kind WHEN 2 THEN ax WHEN 1 THEN z ELSE x END AS mx, CASE kind WHEN 2 THEN ay ELSE y END AS my, CASE kind WHEN 2 THEN az WHEN 1 THEN x ELSE z END AS mz FROM w),
h AS (SELECT id, n, direction, axes, avg(sqrt(g)) AS mean, max(sqrt(g)) AS worst, count(*) AS landmarks FROM ({_HYP}) GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY mean, n) AS k, lead(mean) OVER (PARTITION BY id ORDER BY mean, n) AS runner FROM h),
s AS (SELECT *, CASE WHEN landmarks < 4 THEN 'few_landmarks' WHEN id % 17 = 0 THEN 'singular' WHEN mean < 0.2 * runner THEN 'accepted' ELSE 'ambiguous' END AS status FROM k WHERE k = 1)
SELECT id, status, CASE WHEN status IN ('accepted', 'ambiguous') THEN direction END AS direction, CASE WHEN status IN ('accepted', 'ambiguous') THEN axes END AS axes, CASE WHEN status IN ('accepted', 'ambiguous') THEN round(mean, 6) END AS mean, CASE WHEN status IN ('accepted', 'ambiguous') THEN round(worst, 6) END AS worst, CASE WHEN status IN ('accepted', 'ambiguous') THEN round(runner, 6) END AS runner_up, landmarks FROM s""")
def j24_registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as landmarks: mapped forth, with turned axes, or back, some with noise, some with a matrix of zeros."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_custkey")
    b = o.select(k.alias("id"), (k % 4).alias("kind"), (F.col("o_orderkey") % 97).cast("double").alias("x"), (F.col("o_orderkey") % 89).cast("double").alias("y"), (F.col("o_totalprice") / 10000).alias("z"))
    x, y, z, kind = (F.col(c) for c in ("x", "y", "z", "kind"))
    at = [2.0 * x + 0.5 * z + 10, 1.5 * y - 4, 0.25 * x + 3.0 * z + 7 + F.when(kind == 3, 30 * (x % 3)).otherwise(0)]
    fixed = [F.when(kind == 2, own).when(kind == 1, turned).otherwise(there) for own, turned, there in zip((x, y, z), at[::-1], at, strict=True)]
    moving = [F.when(kind == 2, there).when(kind == 1, turned).otherwise(own) for own, turned, there in zip((x, y, z), (z, y, x), at, strict=True)]
    marks = b.select("id", *[v.alias(f"{s}{a}") for s, side in (("f", fixed), ("m", moving)) for a, v in zip("xyz", side, strict=True)])
    flat = [0.0] * 12
    t = b.select("id").distinct().select("id", F.when(F.col("id") % 17 == 0, F.array(*[F.lit(v) for v in flat])).otherwise(F.array(*[F.lit(v) for v in _MATRIX])).alias("matrix"))
    return _rounded(op.registrations(t, marks, ["id"], "matrix"))


_RELEASE = """WITH ck AS (SELECT c_nationkey AS release, c_custkey AS id, CASE WHEN c_custkey % 30 = c_nationkey % 30 THEN 'final' ELSE 'producer' END AS role, CASE WHEN c_custkey % 9 = 0 THEN [c_custkey] WHEN c_custkey % 4 = 0 THEN [c_custkey - 1, c_custkey - 25] ELSE [] END AS parents, [c_custkey % 50] AS data, CASE WHEN c_custkey % 23 = 0 THEN '' WHEN c_custkey % 10 = 0 THEN 'by' ELSE 'open' END AS license, CASE WHEN c_custkey % 41 = 0 THEN 'none' ELSE sha256(c_name) END AS sha256 FROM customer),
rel AS (SELECT n_nationkey AS release, (SELECT min(id) FROM ck WHERE role = 'final' AND ck.release = n_nationkey AND n_nationkey % 5 > 0) AS final, n_nationkey % 2 = 0 AS pseudo, 'open' AS data_license FROM nation),
ds AS (SELECT s_nationkey AS release, s_suppkey % 50 AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'pseudo-label' ELSE 'source' END AS role, CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 2 = 0 THEN (SELECT min(id) FROM ck WHERE ck.release = s_nationkey) WHEN s_suppkey % 7 = 0 THEN 0 END AS producer, 'open' AS license FROM supplier),
rn AS (SELECT c_nationkey AS release, o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'training' ELSE 'inference' END AS kind, CASE WHEN o_orderkey % 101 = 0 THEN 0 ELSE o_custkey END AS checkpoint, o_orderkey % 5 > 0 AS stochastic, CASE WHEN o_orderkey % 31 > 0 THEN o_orderkey END AS seed, o_orderkey % 37 > 0 AS public FROM orders JOIN customer ON c_custkey = o_custkey),
held AS (SELECT release, id, CASE WHEN id % 19 = 0 THEN 'x' ELSE sha256 END AS sha256 FROM ck WHERE id % 13 > 0),
pa AS (SELECT release, id, unnest(parents) AS ref FROM ck), da AS (SELECT release, id, unnest(data) AS ref FROM ck), us AS (SELECT release, id FROM ck WHERE role = 'final' UNION SELECT release, producer FROM ds WHERE (release, producer) IN (SELECT release, id FROM ck)),
f AS (SELECT release, 'duplicate_id' AS code, 'dataset ' || id AS subject FROM ds GROUP BY release, id HAVING count(*) > 1
UNION ALL SELECT rel.release, 'final_count', count(ck.id)::VARCHAR FROM rel LEFT JOIN ck ON ck.release = rel.release AND ck.role = 'final' GROUP BY rel.release, final HAVING NOT coalesce(count(ck.id) = 1 AND min(ck.id) = final, false)
UNION ALL SELECT release, 'unknown_parent', id || '>' || ref FROM pa WHERE (release, ref) NOT IN (SELECT release, id FROM ck)
UNION ALL SELECT release, 'self_parent', id::VARCHAR FROM ck WHERE list_contains(parents, id)
UNION ALL SELECT release, 'unknown_data', id || '>' || ref FROM da WHERE (release, ref) NOT IN (SELECT release, id FROM ds)
UNION ALL SELECT release, 'unknown_producer', id || '>' || producer FROM ds WHERE producer IS NOT NULL AND (release, producer) NOT IN (SELECT release, id FROM ck)
UNION ALL SELECT release, 'unknown_checkpoint', id || '>' || checkpoint FROM rn WHERE (release, checkpoint) NOT IN (SELECT release, id FROM ck)
UNION ALL SELECT release, 'no_producer', id::VARCHAR FROM ds WHERE role = 'pseudo-label' AND producer IS NULL
UNION ALL SELECT release, 'producer_not_allowed', id::VARCHAR FROM ds WHERE role = 'source' AND producer IS NOT NULL
UNION ALL SELECT release, 'pseudo_missing', NULL FROM rel WHERE pseudo AND release NOT IN (SELECT release FROM ds WHERE role = 'pseudo-label')
UNION ALL SELECT release, 'pseudo_undeclared', NULL FROM rel WHERE NOT pseudo AND release IN (SELECT release FROM ds WHERE role = 'pseudo-label')
UNION ALL SELECT release, 'no_training', id::VARCHAR FROM ck WHERE (release, id) NOT IN (SELECT release, checkpoint FROM rn WHERE kind = 'training')
UNION ALL SELECT release, 'no_inference', id::VARCHAR FROM us WHERE (release, id) NOT IN (SELECT release, checkpoint FROM rn WHERE kind = 'inference')
UNION ALL SELECT release, 'no_seed', id::VARCHAR FROM rn WHERE stochastic AND seed IS NULL
UNION ALL SELECT release, 'not_public', id::VARCHAR FROM rn WHERE NOT public
UNION ALL SELECT ck.release, 'license', id::VARCHAR FROM ck JOIN rel USING (release) WHERE license = '' OR (pseudo AND license <> data_license)
UNION ALL SELECT release, 'digest', id::VARCHAR FROM ck WHERE sha256 = 'none'
UNION ALL SELECT release, 'not_held', id::VARCHAR FROM ck WHERE sha256 <> 'none' AND id % 13 = 0
UNION ALL SELECT release, 'held_differs', id::VARCHAR FROM ck JOIN held USING (release, id) WHERE ck.sha256 <> 'none' AND held.sha256 <> ck.sha256)
SELECT DISTINCT release, code, subject FROM f"""


@query(_RELEASE)
def r07_release_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as releases, customers as checkpoints, suppliers as datasets, orders as runs: all that is wrong with each."""
    c, s, k, q = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier"), F.col("c_custkey"), F.col("s_suppkey")
    role = F.when(k % 30 == F.col("c_nationkey") % 30, "final").otherwise("producer")
    parents = F.when(k % 9 == 0, F.array(k)).when(k % 4 == 0, F.array(k - 1, k - 25)).otherwise(F.array().cast("array<bigint>"))
    licence = F.when(k % 23 == 0, "").when(k % 10 == 0, "by").otherwise("open")
    ck = c.select(F.col("c_nationkey").alias("release"), k.alias("id"), role.alias("role"), parents.alias("parents"), F.array(k % 50).alias("data"), licence.alias("license"), F.when(k % 41 == 0, "none").otherwise(F.sha2("c_name", 256)).alias("sha256"))
    finals = ck.where("role = 'final' AND release % 5 > 0").groupBy("release").agg(F.min("id").alias("final"))
    rel = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("release")).join(finals, "release", "left").withColumn("pseudo", F.col("release") % 2 == 0).withColumn("data_license", F.lit("open"))
    least = ck.groupBy("release").agg(F.min("id").alias("low"))
    ds = s.withColumnRenamed("s_nationkey", "release").join(least, "release", "left").select("release", (q % 50).alias("id"), F.when(q % 3 == 0, "pseudo-label").otherwise("source").alias("role"), F.when((q % 3 == 0) & (q % 2 == 0), F.col("low")).when(q % 7 == 0, 0).alias("producer"), F.lit("open").alias("license"))
    n = F.col("o_orderkey")
    rn = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == k).select(F.col("c_nationkey").alias("release"), n.alias("id"), F.when(n % 2 == 0, "training").otherwise("inference").alias("kind"), F.when(n % 101 == 0, 0).otherwise(k).alias("checkpoint"), (n % 5 > 0).alias("stochastic"), F.when(n % 31 > 0, n).alias("seed"), (n % 37 > 0).alias("public"))
    held = ck.where("id % 13 > 0").select("release", "id", F.when(F.col("id") % 19 == 0, "x").otherwise(F.col("sha256")).alias("sha256"))
    return op.release_findings(rel, ck, ds, rn, held)
