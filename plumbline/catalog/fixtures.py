"""Recipes that give the driver's tables the shapes that the operators work on, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as a chunk of 4 x 4 x 4 voxels: volume, chunk, z, y, x, v (0 to 255), and a second array ct."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("volume"), F.col("vec_id").alias("chunk"), F.posexplode("embedding").alias("i", "e"))
    v = F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), 127.5 + 255 * F.col("e").cast("double")))).cast("int")
    return e.select("volume", "chunk", F.expr("i div 16").cast("int").alias("z"), F.expr("(i div 4) % 4").cast("int").alias("y"), (F.col("i") % 4).alias("x"), v.alias("v")).withColumn("ct", F.when(F.col("v") % 5 == 0, 0).otherwise(F.col("v")))


VOXELS = """e AS (SELECT label AS volume, vec_id AS chunk, unnest(embedding)::DOUBLE AS e, unnest(range(0, 64))::INTEGER AS i FROM embeddings),
voxels AS (SELECT volume, chunk, i // 16 AS z, (i // 4) % 4 AS y, i % 4 AS x, v, CASE WHEN v % 5 = 0 THEN 0 ELSE v END AS ct
  FROM (SELECT *, floor(least(255, greatest(0, 127.5 + 255 * e)))::INTEGER AS v FROM e))"""


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a surface grid: surface, row, col, x, y, z, valid, p (0 to 1), label."""
    o = table(spark, sf_dir, "orders")
    row, col, price = F.expr("o_orderkey div 100"), F.col("o_orderkey") % 100, F.col("o_totalprice")
    return o.select(F.expr("o_orderkey div 3000").alias("surface"), row.alias("row"), col.alias("col"), (10.0 * col).alias("x"), (10.0 * row + price % 7).alias("y"), (price / 1000).alias("z"), (F.col("o_orderstatus") != "P").alias("valid"), (price / 500000).alias("p"), F.col("o_orderpriority").like("1%").alias("label"))


GRID = """grid AS (SELECT o_orderkey // 3000 AS surface, o_orderkey // 100 AS row, o_orderkey % 100 AS col, 10.0::DOUBLE * (o_orderkey % 100) AS x,
  10.0::DOUBLE * (o_orderkey // 100) + o_totalprice % 7 AS y, o_totalprice / 1000 AS z, o_orderstatus <> 'P' AS valid, o_totalprice / 500000 AS p, o_orderpriority LIKE '1%' AS label FROM orders)"""


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ordered traces: trace_id, ord, x, y, z, event_id."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    out = e.select(F.col("user_id").alias("trace_id"), F.row_number().over(w).alias("ord"), F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"), "event_id", "event_type")
    return out.withColumn("z", F.col("ord").cast("double"))


TRACE = """trace AS (SELECT user_id AS trace_id, ord, value AS x, (props->>'$.k')::DOUBLE AS y, event_id, event_type, ord::DOUBLE AS z
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INTEGER AS ord FROM events))"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as annotation points: frame, id, x, y, z, theta (degrees), r, w."""
    e = table(spark, sf_dir, "events")
    theta = (F.col("event_id") * 37) % 360
    return e.select(F.col("event_type").alias("frame"), F.col("event_id").alias("id"), (F.col("event_id") / 10.0).alias("z"), theta.cast("double").alias("theta"), F.col("value").alias("r"), (F.col("event_id") % 7).cast("int").alias("w"), (F.col("value") * F.cos(F.radians(theta))).alias("x"), (F.col("value") * F.sin(F.radians(theta))).alias("y"))


POINTS = """points AS (SELECT event_type AS frame, event_id AS id, event_id / 10.0::DOUBLE AS z, ((event_id * 37) % 360)::DOUBLE AS theta, value AS r, (event_id % 7)::INTEGER AS w,
  value * cos(radians((event_id * 37) % 360)) AS x, value * sin(radians((event_id * 37) % 360)) AS y FROM events)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as half-open boxes: id, volume, part (0 or 1), x0, x1, y0, y1."""
    p = table(spark, sf_dir, "part")
    x0, y0 = F.col("p_size") % 10, F.floor("p_retailprice").cast("int") % 50
    return p.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("volume"), (F.col("p_partkey") % 2).cast("int").alias("part"), x0.alias("x0"), (x0 + 3).alias("x1"), y0.alias("y0"), (y0 + 4).alias("y1"))


BOXES = """boxes AS (SELECT p_partkey AS id, p_type AS volume, (p_partkey % 2)::INTEGER AS part, p_size % 10 AS x0, p_size % 10 + 3 AS x1,
  floor(p_retailprice)::INTEGER % 50 AS y0, floor(p_retailprice)::INTEGER % 50 + 4 AS y1 FROM part)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as binary predictions: id, score, y, grp, domain."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.select(F.col("doc_id").alias("id"), ((F.col("n_chars") % 1000) / 1000.0).alias("score"), (F.col("quality") == 1).alias("y"), F.col("lang").alias("grp"), F.col("source").alias("domain"))


SCORED = """scored AS (SELECT doc_id AS id, ((n_chars % 1000) / 1000.0)::DOUBLE AS score, quality = 1 AS y, lang AS grp, source AS domain FROM documents JOIN labels USING (doc_id))"""


def ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five members' predictions for each embedding: unit, member, p, truth, stratum, block."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode(F.slice("embedding", 1, 5)).alias("member", "e"))
    return e.select(F.col("vec_id").alias("unit"), "member", (1 / (1 + F.exp(-5 * F.col("e").cast("double")))).alias("p"), (F.col("label") % 2 == 1).alias("truth"), F.col("label").alias("stratum"), (F.col("vec_id") % 20).cast("int").alias("block"))


ENSEMBLE = """ensemble AS (SELECT vec_id AS unit, m AS member, 1 / (1 + exp(-5 * e)) AS p, label % 2 = 1 AS truth, label AS stratum, (vec_id % 20)::INTEGER AS block
  FROM (SELECT vec_id, label, unnest(embedding[1:5])::DOUBLE AS e, unnest(range(0, 5))::INTEGER AS m FROM embeddings))"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier-part pairs as a constraint graph: i, j, d, w."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("w"), F.sum("l_quantity").alias("q"))
    d = F.col("l_suppkey") % 12 - F.col("l_partkey") % 12 + F.when(F.col("q") > 95, 3).otherwise(0)
    return g.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("i"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("j"), d.cast("long").alias("d"), "w")


EDGES = """edges AS (SELECT 's' || l_suppkey AS i, 'p' || l_partkey AS j, (l_suppkey % 12 - l_partkey % 12 + CASE WHEN sum(l_quantity) > 95 THEN 3 ELSE 0 END)::BIGINT AS d, count(*) AS w
  FROM lineitem GROUP BY l_suppkey, l_partkey)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by supplier as scored runs: root, run, score, decoded."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("root"), F.col("l_returnflag").alias("run")).agg(F.avg("l_quantity").alias("score"), F.count("*").alias("decoded"))


RUNS = """runs AS (SELECT l_suppkey AS root, l_returnflag AS run, avg(l_quantity) AS score, count(*) AS decoded FROM lineitem GROUP BY ALL)"""


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as expected targets with what line items predict: id, region, truth, predicted, failed."""
    seen = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("predicted"))
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("region"), F.col("p_retailprice").alias("truth"), (F.col("p_size") % 11 == 0).alias("failed")).join(seen, "id", "left")


EVALUATED = """evaluated AS (SELECT p_partkey AS id, p_brand AS region, p_retailprice AS truth, p_size % 11 = 0 AS failed, predicted
  FROM part LEFT JOIN (SELECT l_partkey AS id, sum(l_extendedprice) / sum(l_quantity) AS predicted FROM lineitem GROUP BY ALL) ON id = p_partkey)"""
