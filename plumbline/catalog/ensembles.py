"""Ensembles of members with ancestry, bound to suppliers as members and the parts they deliver as training units."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.catalog.fixtures import table
from plumbline.catalog.registry import query
from plumbline.catalog.voxels import _rounded
from plumbline.operators import ensembles as op

_UNITS = "WITH RECURSIVE u AS (SELECT DISTINCT s_nationkey AS g, l_suppkey AS m, l_partkey AS u, l_partkey % 3 + 1 AS w FROM lineitem JOIN supplier ON s_suppkey = l_suppkey UNION SELECT s_nationkey, s_suppkey, 0, 1 FROM supplier)"


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts that each supplier delivers, and one unit that all have: g (nation), m, u, w."""
    s = table(spark, sf_dir, "supplier")
    got = table(spark, sf_dir, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_nationkey").alias("g"), F.col("l_suppkey").alias("m"), F.col("l_partkey").alias("u"), (F.col("l_partkey") % 3 + 1).alias("w"))
    whole = s.select(F.col("s_nationkey").alias("g"), F.col("s_suppkey").alias("m"), F.lit(0).cast("long").alias("u"), F.lit(1).cast("long").alias("w"))
    return got.unionByName(whole)


def ancestry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as members: every fifth has unknown parents, some have the checkpoint ten numbers below for a parent, some one of three bases."""
    k = F.col("s_suppkey")
    name = lambda c: F.concat(F.lit("c"), c.cast("string"))
    base = F.concat(F.lit("base"), (k % 7).cast("string"))
    parents = F.when(k % 5 == 0, None).when(k % 5 == 1, F.array(name(k - 1))).when(k % 5 == 2, F.array(name(k - 1), base)).when(k % 5 == 3, F.array(base)).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("g"), k.alias("m"), name(k).alias("checkpoint"), parents.alias("parents"), F.when(k % 4 != 0, k % 11).alias("init_seed"), F.when(k % 6 != 0, k % 13).alias("order_seed"), F.when(k % 3 != 0, k % 2).alias("config"))


@query(f"{_UNITS} SELECT a.g, a.m AS a, b.m AS b, count(*) AS shared, sum(a.w)::DOUBLE AS weight FROM u a JOIN u b ON a.g = b.g AND a.u = b.u AND a.m < b.m GROUP BY ALL")
def a57_shared_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many units every two members of an ensemble share, and their weight; one unit is in all of them."""
    return op.shared_units(units(spark, sf_dir), ["g"], "m", "u", "w", block=4)


@query(f"""{_UNITS}, m AS (SELECT s_nationkey AS g, s_suppkey AS m, 'c' || s_suppkey AS c, CASE s_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN ['c' || (s_suppkey - 1)] WHEN 2 THEN ['c' || (s_suppkey - 1), 'base' || (s_suppkey % 7)] WHEN 3 THEN ['base' || (s_suppkey % 7)] ELSE [] END AS parents, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 11 END AS seed, CASE WHEN s_suppkey % 6 <> 0 THEN s_suppkey % 13 END AS data, CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey % 2 END AS config FROM supplier),
e AS (SELECT g, c, unnest(parents) AS p FROM m), l(g, m, c) AS (SELECT g, m, c FROM m UNION SELECT l.g, l.m, e.p FROM l JOIN e ON e.g = l.g AND e.c = l.c), met AS (SELECT DISTINCT x.g, x.m AS a, y.m AS b FROM l x JOIN l y ON x.g = y.g AND x.c = y.c AND x.m < y.m),
z AS (SELECT g, m, sum(w)::DOUBLE AS z FROM u GROUP BY ALL), s AS (SELECT a.g, a.m AS a, b.m AS b, count(*) AS shared, sum(a.w)::DOUBLE AS w FROM u a JOIN u b ON a.g = b.g AND a.u = b.u AND a.m < b.m GROUP BY ALL),
p AS (SELECT x.g, x.m AS a, y.m AS b, coalesce(s.shared, 0) AS shared, coalesce(s.w, 0) / least(zx.z, zy.z) AS overlap, coalesce(s.w, 0) / (zx.z + zy.z - coalesce(s.w, 0)) AS jaccard, CASE WHEN met.a IS NOT NULL THEN 'shared' WHEN x.parents IS NULL OR y.parents IS NULL THEN 'unknown' ELSE 'distinct' END AS lineage,
  CASE WHEN x.config <> y.config THEN 'distinct' WHEN x.seed IS NULL OR y.seed IS NULL THEN 'unknown' WHEN x.seed = y.seed THEN 'shared' ELSE 'distinct' END AS init, CASE WHEN x.data IS NULL OR y.data IS NULL THEN 'unknown' WHEN x.data = y.data THEN 'shared' ELSE 'distinct' END AS "order"
  FROM m x JOIN m y ON x.g = y.g AND x.m < y.m JOIN z zx ON zx.g = x.g AND zx.m = x.m JOIN z zy ON zy.g = x.g AND zy.m = y.m LEFT JOIN s ON s.g = x.g AND s.a = x.m AND s.b = y.m LEFT JOIN met ON met.g = x.g AND met.a = x.m AND met.b = y.m)
SELECT g, a, b, shared, round(overlap, 6) AS overlap, round(jaccard, 6) AS jaccard, lineage, init, "order", false AS identical, CASE WHEN 'shared' IN (lineage, init, "order") OR overlap > 0.05 THEN 'dependent' WHEN 'unknown' IN (lineage, init, "order") THEN 'unverified' ELSE 'independent' END AS witness, CASE WHEN 'shared' IN (lineage, init, "order") THEN 'dependent' WHEN 'unknown' IN (lineage, init, "order") THEN 'unverified' ELSE 'independent' END AS deep FROM p""")
def a57_independence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supervision, lineage and seeds of every two suppliers of a nation, as members of its ensemble."""
    return _rounded(op.independence(ancestry(spark, sf_dir), units(spark, sf_dir), ["g"], "m", "u", "w", 0.05))
