"""Landed arrays: multiscale metadata, box reads, components of chunked volumes."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.catalog.fixtures import VOXELS, table, voxels
from plumbline.catalog.registry import query
from plumbline.catalog.streams import _scratch
from plumbline.catalog.voxels import _rounded
from plumbline.operators.volumes import volume_components
from plumbline.sources import arrays


def _chunks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Embeddings as the chunks of one array, ten by ten in a layer, and the number of layers."""
    value = F.transform(F.array_sort(F.collect_list(F.struct("z", "y", "x", "v"))), lambda s: F.lpad(F.hex(s["v"].cast("long")), 2, "0"))
    raw = voxels(spark, sf_dir).groupBy("chunk").agg(F.unhex(F.array_join(value, "")).alias("content"))
    at = {"cz": F.expr("chunk div 100"), "cy": F.expr("chunk div 10 % 10"), "cx": F.col("chunk") % 10}
    layers = table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0] // 100 + 1
    return raw.select("chunk", F.lit(0).alias("level"), *[c.cast("int").alias(k) for k, c in at.items()], "content"), layers


_PLACED = f"{VOXELS}, placed AS (SELECT chunk, (chunk // 100) * 4 + z AS z, ((chunk // 10) % 10) * 4 + y AS y, (chunk % 10) * 4 + x AS x, v FROM voxels)"


@query(f"WITH {_PLACED}, n AS (SELECT max(vec_id) // 100 + 1 AS layers FROM embeddings), c AS (SELECT z * 100 + y * 10 + x AS chunk FROM n, range(0, layers) a(z), range(1, 9) b(y), range(0, 8) c(x)), s AS (SELECT chunk, CASE WHEN vec_id IS NULL OR chunk % 7 = 3 THEN 'fill' WHEN chunk % 53 = 9 THEN 'decode_failure' ELSE 'decoded' END AS status FROM c LEFT JOIN embeddings ON vec_id = chunk), k AS (SELECT p.chunk, count(*) AS voxels, sum(v) AS total FROM placed p, n WHERE z >= 1 AND z < layers * 4 - 1 AND y >= 5 AND y < 33 AND x >= 3 AND x < 29 GROUP BY p.chunk) SELECT status, count(*) AS chunks, coalesce(sum(CASE WHEN status = 'decoded' THEN voxels END), 0)::BIGINT AS voxels, coalesce(sum(CASE WHEN status = 'decoded' THEN total END), 0)::BIGINT AS total FROM s LEFT JOIN k USING (chunk) GROUP BY status")
def s01_box_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An array of files, some absent and some cut short, and what a box of it holds: only the chunks that the box touches are opened."""
    path = _scratch(spark)
    chunks, layers = _chunks(spark, sf_dir)
    landed = chunks.where("chunk % 7 <> 3").withColumn("content", F.when(F.col("chunk") % 53 == 9, F.substring("content", 1, 10)).otherwise(F.col("content")))
    arrays.write_array([{"name": "0", "scale": [1.0, 1.0, 1.0], "shape": [4 * layers, 40, 40], "chunks": [4, 4, 4]}], path, landed)
    lo, hi = (1, 5, 3), (4 * layers - 1, 33, 29)
    box = arrays.box_chunks(spark, path, 0, lo, hi)
    none = F.lit(0).cast("long")
    rows = box.select("status", F.lit(1).cast("long").alias("chunks"), none.alias("voxels"), none.alias("total"))
    held = arrays.box_voxels(box, (4, 4, 4), lo, hi).select(F.lit("decoded").alias("status"), none.alias("chunks"), F.lit(1).cast("long").alias("voxels"), F.col("v").cast("long").alias("total"))
    return rows.unionByName(held).groupBy("status").agg(*[F.sum(c).alias(c) for c in ("chunks", "voxels", "total")])


@query("WITH l AS (SELECT DISTINCT label FROM embeddings), k AS (SELECT label, unnest([0, 1]) AS level FROM l WHERE label % 3 <> 0 AND label % 5 <> 1) SELECT label, level, 'usable' AS status, NULL AS reason, [64 >> level, 32, 32 >> level] AS shape, [2.0 ** level, 1.0, 2.0 ** level]::DOUBLE[] AS scale FROM k UNION ALL SELECT label, NULL, 'refused', CASE WHEN label % 3 = 0 THEN 'type <f4 is not a byte' ELSE 'chunks are compressed or filtered' END, NULL, NULL FROM l WHERE label % 3 = 0 OR label % 5 = 1")
def s02_array_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiscale arrays, one for each label, landed by the tasks and read back: levels with shape and scale, or why an array is refused."""
    path = _scratch(spark)

    def land(rows) -> None:
        for r in rows:
            kind = {"dtype": "<f4"} if r.label % 3 == 0 else {"compressor": {"id": "zlib"}} if r.label % 5 == 1 else {}
            levels = [{"name": f"s{k}", "scale": [2.0**k, 1.0, 2.0**k], "shape": [64 >> k, 32, 32 >> k], "chunks": [4, 4, 4], **kind} for k in (0, 1)]
            arrays.write_metadata(levels, f"{path}/{r.label}")

    labels = table(spark, sf_dir, "embeddings").select("label").distinct()
    labels.foreachPartition(land)
    got = arrays.array_levels(labels.select(F.concat(F.lit(path + "/"), F.col("label").cast("string")).alias("path")), "path")
    return got.select(F.substring_index("path", "/", -1).cast("int").alias("label"), "level", "status", "reason", "shape", "scale")


@query(f"WITH RECURSIVE {_PLACED}, m AS (SELECT (z * 40 + y) * 40 + x AS n, z, y, x FROM placed WHERE v >= 185), o AS (SELECT a.i AS dz, b.i AS dy, c.i AS dx FROM range(-1, 2) a(i), range(-1, 2) b(i), range(-1, 2) c(i)), near AS (SELECT m.n AS s, k.n AS t FROM m, o JOIN m k ON k.z = m.z + dz AND k.y = m.y + dy AND k.x = m.x + dx WHERE k.n <> m.n), r(n, l) AS (SELECT n, n FROM m UNION SELECT e.t, r.l FROM r JOIN near e ON e.s = r.n WHERE r.l < e.t), k AS (SELECT n, min(l) AS component FROM r GROUP BY n), h AS (SELECT max(vec_id) // 100 * 4 + 3 AS deepest FROM embeddings) SELECT component, count(*) AS size, round(count(*) / (SELECT count(*) FROM m), 6) AS share, bool_or(z IN (0, deepest) OR y IN (0, 39) OR x IN (0, 39)) AS border FROM k JOIN m USING (n), h GROUP BY component")
def g01_volume_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """26-connected components of a chunked volume: sizes, shares, and whether they touch its outside."""
    chunks, layers = _chunks(spark, sf_dir)
    found = volume_components(chunks.withColumn("volume", F.lit(0)), "volume", (4, 4, 4), (4 * layers, 40, 40), 185)
    return _rounded(found["components"].drop("volume"))
