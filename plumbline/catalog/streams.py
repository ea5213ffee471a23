"""Streams run to their end, file scans over files that Spark writes from the tables, callables, and probes of volumes."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.catalog.fixtures import GRID, VOXELS, grid, table, trace, voxels
from plumbline.catalog.registry import query
from plumbline.catalog.voxels import _rounded
from plumbline.operators import callables, surfaces
from plumbline.operators import voxels as voxel_op
from plumbline.sources import files
from plumbline.streaming import trackers


def _scratch(spark: SparkSession) -> str:
    """A new folder in the shared one that the session or its context names; one of our own only where neither does."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or tempfile.gettempdir()
    return f"{base.rstrip('/')}/plumbline-{uuid.uuid4().hex}"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as files that have landed in a folder, as a stream."""
    path = _scratch(spark)
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(path)
    return trackers.stream(spark, path, e)


@query("SELECT event_type, count(*) AS evaluations, count(*) FILTER (NOT isnan(value)) AS finite, count(*) FILTER (value <> 0) AS nonzero, round(sum(value), 4) AS total, max(value) AS peak FROM events GROUP BY event_type")
def k01_activation_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = trackers.drained(trackers.activation(_events(spark, sf_dir), "event_type", "value", "ts"), _scratch(spark), "complete", f"k01_{uuid.uuid4().hex}")
    return got.withColumn("total", F.round("total", 4))


@query()
def k02_capped_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequential by nature; tested against a loop."""
    s = trackers.capped_ledger(_events(spark, sf_dir), "user_id", "ts", "event_id", "value", 1500.0)
    return trackers.drained(s, _scratch(spark), "append", "k02")


@query()
def k02_ordered_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events land in several files, latest first, and are taken into their ledgers in the order of their times; tested against a loop."""
    path = _scratch(spark)
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")
    e.repartitionByRange(4, F.desc("ts")).write.parquet(path)
    # the last file closes the books
    e.agg(F.max("ts").alias("ts")).select(F.lit(None).cast(dict(e.dtypes)["user_id"]).alias("user_id"), (F.col("ts") + F.expr("INTERVAL 400 DAYS")).alias("ts"), F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("double").alias("value")).write.mode("append").parquet(path)
    s = trackers.ordered_ledger(trackers.stream(trackers.with_state_store(spark), path, e), "user_id", "ts", "event_id", "value", 1500.0, "365 days")
    return trackers.drained(s, _scratch(spark), "append", "k02o")


@query("""WITH x(level, expected) AS (VALUES (0::BIGINT, 2::BIGINT), (1, 4), (2, NULL)) SELECT page_id % 4 AS level, CASE WHEN x.level IS NULL THEN 'unverified' WHEN expected IS NULL THEN 'not_applicable' WHEN length(html) // 500 = expected THEN 'ok' ELSE 'mismatch' END AS status, count(*) AS n, count(DISTINCT page_id % 3) AS files
FROM pages LEFT JOIN x ON x.level = page_id % 4 GROUP BY ALL""")
def k03_landed_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page objects that land in files, one file a batch, audited into a ledger that a restart neither shortens nor doubles."""
    path = _scratch(spark)
    p = table(spark, sf_dir, "pages").select((F.col("page_id") % 4).alias("level"), F.col("url").alias("key"), F.expr("length(html) div 500").alias("size"), F.concat(F.lit("f"), (F.col("page_id") % 3).cast("string")).alias("file"))
    p.repartition(3, "file").write.parquet(path)
    declared = spark.createDataFrame([(0, 2), (1, 4), (2, None)], "level long, expected long")
    ledger = _scratch(spark)
    trackers.land_census(spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(path), declared, "level", "size", ledger)
    return trackers.census_counts(spark, ledger, "level")


@query("""WITH x(level, expected) AS (VALUES (0::BIGINT, 2::BIGINT), (1, 4), (2, NULL)) SELECT page_id % 4 AS level, CASE WHEN x.level IS NULL THEN 'unverified' WHEN expected IS NULL THEN 'not_applicable' WHEN length(html) // 500 = expected THEN 'ok' ELSE 'mismatch' END AS status, count(*) AS n
FROM pages LEFT JOIN x ON x.level = page_id % 4 GROUP BY ALL""")
def k03_progressive_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page objects that land in a folder, audited against the sizes that their levels declare."""
    path = _scratch(spark)
    p = table(spark, sf_dir, "pages").select((F.col("page_id") % 4).alias("level"), F.col("url").alias("key"), F.expr("length(html) div 500").alias("size"))
    p.write.parquet(path)
    declared = spark.createDataFrame([(0, 2), (1, 4), (2, None)], "level long, expected long")
    got = trackers.progressive_census(trackers.stream(spark, path, p), declared, "level", "size")
    return trackers.drained(got, _scratch(spark), "complete", f"k03_{uuid.uuid4().hex}")


@query(f"WITH {VOXELS} SELECT volume, chunk, round(avg(v) + 0.5 * max(ct), 6)::DOUBLE AS score FROM voxels GROUP BY ALL")
def x01_pluggable_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(callables.scored_by(voxels(spark, sf_dir), ["volume", "chunk"], lambda pdf: pdf["v"].mean() + 0.5 * pdf["ct"].max()))


@query("SELECT event_id, round(value * 2 + 1, 6) AS prediction FROM events")
def x02_pluggable_predictor(spark: SparkSession, sf_dir: str) -> DataFrame:
    import pandas as pd

    def predict(x: pd.Series) -> pd.Series:
        return x * 2 + 1

    return _rounded(callables.predicted(table(spark, sf_dir, "events").select("event_id", "value"), "value", predict).select("event_id", "prediction"))


@query()
def x04_solver_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The solvers by name on the same graph: the share of edges that each leaves without residual."""
    from plumbline.catalog.graphs import _start
    from plumbline.operators.graphs import numbered, residuals, stored

    # nodes are numbers in the nodes' order, given once for both solvers; the eids stay those of the names
    e = stored(numbered(_start(spark, sf_dir)[0].withColumn("eid", F.xxhash64("i", "j")), ["i", "j"])[0])
    v = e.select(F.explode(F.array("i", "j")).alias("node")).distinct().select("node", F.lit(0).cast("long").alias("val"))
    solved = {"bfs": callables.SOLVERS["bfs"](e), "mode": callables.SOLVERS["mode"](e, v)}
    out = [residuals(e, s).agg(F.lit(n).alias("solver"), F.avg((F.col("residual") == 0).cast("double")).alias("exact")) for n, s in solved.items()]
    return out[0].unionByName(out[1])


@query("SELECT user_id::VARCHAR AS trace_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INTEGER AS ord, value AS x, (props->>'$.k')::DOUBLE AS y FROM events")
def s06_trace_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark)
    trace(spark, sf_dir).select("trace_id", "ord", "x", "y", "z").write.csv(path, header=True)
    return files.trace_csv(spark, path)[0].select("trace_id", "ord", "x", "y")


@query("SELECT l_suppkey AS i, l_partkey AS j, count(*) AS n FROM lineitem GROUP BY ALL")
def s11_edge_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark)
    li = table(spark, sf_dir, "lineitem")
    li.select(F.col("l_suppkey").cast("double").cast("string").alias("a"), F.col("l_partkey").cast("double").cast("string").alias("b")).write.csv(path, header=True)
    return files.edge_csv(spark, path)[0].groupBy("i", "j").agg(F.count("*").alias("n"))


@query("SELECT 'trace' AS role, 'relative:' || event_type AS frame, event_type AS cid, event_id::VARCHAR AS pid, value AS x, event_id / 10.0::DOUBLE AS z, (event_id % 7)::INTEGER AS w FROM events")
def s05_point_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events nested into point collections, one document per day and kind so that none grows with the table, and read back."""
    path = _scratch(spark)
    e = table(spark, sf_dir, "events")
    point = F.struct(F.array(F.col("value"), F.lit(0.0), F.col("event_id") / 10.0).alias("p"), (F.col("event_id") % 7).cast("double").alias("wind_a"))
    docs = e.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("event_id").cast("string"), point))).alias("m"))
    docs.select(F.to_json(F.struct(F.create_map("event_type", F.struct(F.lit(False).alias("absolute"), F.col("m").alias("points"))).alias("collections"))).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return files.point_collections(spark, path, "trace").select("role", "frame", "cid", "pid", "x", "z", "w")


@query("SELECT vec_id, label, CASE WHEN label % 3 = 0 THEN 'refused' ELSE 'usable' END AS status FROM embeddings")
def s02_array_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Array descriptions, one line each, parsed with the given schema; other types are refused by status."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.to_json(F.struct(F.array(F.lit(4), F.lit(4), F.lit(4)).alias("shape"), F.when(F.col("label") % 3 == 0, "<f4").otherwise("|u1").alias("dtype"), F.lit("C").alias("order"))).alias("doc"))
    d = e.withColumn("d", F.from_json("doc", "shape array<int>, dtype string, order string"))
    return d.select("vec_id", "label", F.when((F.col("d.dtype") == "|u1") & (F.col("d.order") == "C"), "usable").otherwise("refused").alias("status"))


@query("SELECT o_orderkey // 3000 AS surface, count(*) AS cells, count(*) FILTER (o_orderstatus <> 'P') AS valid FROM orders GROUP BY ALL")
def s08_surface_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, sf_dir).groupBy("surface").agg(F.count("*").alias("cells"), F.count_if("valid").alias("valid"))


@query()
def s14_geometry_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.geometry_digest(grid(spark, sf_dir), "surface")


@query()
def s13_tree_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the landed customer table's files."""
    path = _scratch(spark)
    table(spark, sf_dir, "customer").repartition(4, "c_custkey").sortWithinPartitions("c_custkey").select(F.concat_ws(",", "c_custkey", "c_name").alias("value")).write.text(path)
    f = files.tree_digest(spark, path)
    return f.select("files", "sha")


@query("SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey")
def s15_write_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark)
    files.write_once(table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")), path)
    return spark.read.parquet(path)


@query("SELECT split_part(p_name, ' ', 1) AS grp, count(*) AS roots, count(*) FILTER (p_name LIKE '%widget%') AS widgets FROM part GROUP BY ALL")
def s10_root_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark)
    table(spark, sf_dir, "part").select(F.regexp_replace("p_name", " ", "/").alias("root")).write.json(path)
    r = spark.read.schema("root string").json(path)
    return r.groupBy(F.split("root", "/")[0].alias("grp")).agg(F.count("*").alias("roots"), F.count_if(F.col("root").contains("widget")).alias("widgets"))


@query(f"WITH {GRID}, c AS (SELECT g.surface, g.row, g.col, u.a, u.b FROM grid g, (VALUES (0.25::DOUBLE, 0.5::DOUBLE)) u(a, b)), s AS (SELECT c.surface, c.row, c.col, count(*) FILTER (valid) AS n, sum((CASE WHEN g.row = c.row THEN 1 - a ELSE a END) * (CASE WHEN g.col = c.col THEN 1 - b ELSE b END) * z) AS z FROM c JOIN grid g ON g.surface = c.surface AND g.row - c.row BETWEEN 0 AND 1 AND g.col - c.col BETWEEN 0 AND 1 GROUP BY ALL) SELECT surface, row, col, round(CASE WHEN n = 4 THEN z END, 8) AS z FROM s")
def j17_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surface at a quarter down and half across each cell; NULL unless all four corners are valid."""
    g = grid(spark, sf_dir).select("surface", "row", "col", "z", "valid")
    corner = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit((0.25 if i else 0.75) * 0.5).alias("w")) for i in (0, 1) for j in (0, 1)])
    moved = g.select("surface", "row", "col", "z", "valid", F.explode(corner).alias("c")).select("surface", (F.col("row") - F.col("c.i")).alias("row"), (F.col("col") - F.col("c.j")).alias("col"), (F.col("z") * F.col("c.w")).alias("wz"), "valid")
    s = moved.groupBy("surface", "row", "col").agg(F.count_if("valid").alias("n"), F.sum("wz").alias("s"))
    return g.select("surface", "row", "col").join(s, ["surface", "row", "col"]).select("surface", "row", "col", F.round(F.when(F.col("n") == 4, F.col("s")), 8).alias("z"))


@query(f"""WITH {VOXELS}, r AS (SELECT volume, chunk, y, x, z, v > 100 AS pred, ct > 0 AS ct FROM voxels), g AS (SELECT *, z - row_number() OVER (PARTITION BY volume, chunk, y, x ORDER BY z) AS g FROM r WHERE pred AND ct), k AS (SELECT volume, chunk, y, x, min(z) AS first, count(*) AS length FROM g GROUP BY volume, chunk, y, x, g) SELECT volume, chunk, y, x, min(first) AS first, arg_min(length, first) AS length FROM k GROUP BY ALL""")
def v05_ray_march(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Along each ray, the first run where prediction and scan agree."""
    from plumbline.operators.spatial import islands

    v = voxels(spark, sf_dir).select("volume", "chunk", "y", "x", "z", ((F.col("v") > 100) & (F.col("ct") > 0)).alias("on"))
    k = islands(v, ["volume", "chunk", "y", "x"], "z", "on", 1)
    return k.groupBy("volume", "chunk", "y", "x").agg(F.min("first").alias("first"), F.min_by("length", "first").alias("length"))


@query(f"WITH {VOXELS}, p AS (SELECT volume, chunk, max(v) FILTER (z = 1) AS surface, max(v) FILTER (z <> 1) AS control FROM voxels GROUP BY ALL) SELECT volume, count(*) AS probes, count(*) FILTER (surface > control) AS wins, median(surface - control)::DOUBLE AS margin FROM p GROUP BY volume")
def v04_probe_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = voxels(spark, sf_dir).groupBy("volume", "chunk").agg(F.max(F.when(F.col("z") == 1, F.col("v"))).alias("s"), F.max(F.when(F.col("z") != 1, F.col("v"))).alias("c"))
    return p.groupBy("volume").agg(F.count("*").alias("probes"), F.count_if(F.col("s") > F.col("c")).alias("wins"), F.median(F.col("s") - F.col("c")).alias("margin"))


@query(f"""WITH {VOXELS}, k AS (SELECT volume, y AS component, z AS off, round(avg(v), 9) AS v, avg((ct > 0)::INTEGER) AS truth FROM voxels GROUP BY ALL), m AS (SELECT *, max(v) OVER (PARTITION BY volume, component) AS top FROM k)
SELECT volume, component, arg_max(off, v * 1000 - off / 1000.0) AS peak, round(max(v), 6) AS value, round(max(v) FILTER (off = 1), 6) AS nominal, max(v) FILTER (off = 1) = max(v) AND count(*) FILTER (v = top) = 1 AS strict, max(off) FILTER (v >= top / 2) - min(off) FILTER (v >= top / 2) AS half_span, CASE WHEN max(truth) FILTER (off = 1) >= 0.8 THEN 'true' WHEN max(truth) FILTER (off = 1) <= 0.2 THEN 'false' ELSE 'mixed' END AS grp FROM m GROUP BY ALL""")
def a50_depth_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean response of each component by offset: its peak (ties: the first), the nominal one and whether that alone is the peak, the span of offsets at half the peak or more, and the group by how much of the nominal support is true."""
    own = ["volume", "component"]
    d = voxels(spark, sf_dir).groupBy("volume", F.col("y").alias("component"), F.col("z").alias("off")).agg(F.round(F.avg("v"), 9).alias("v"), F.avg((F.col("ct") > 0).cast("double")).alias("truth"))
    d = d.withColumn("top", F.max("v").over(Window.partitionBy(*own)))
    half, at = F.when(F.col("v") >= F.col("top") / 2, F.col("off")), lambda c: F.max(F.when(F.col("off") == 1, F.col(c)))
    g = d.groupBy(*own).agg(F.max_by("off", F.struct("v", -F.col("off"))).alias("peak"), F.max("v").alias("value"), at("v").alias("nominal"), F.count_if(F.col("v") == F.col("top")).alias("tops"), (F.max(half) - F.min(half)).alias("half_span"), at("truth").alias("truth"))
    g = g.withColumn("strict", (F.col("nominal") == F.col("value")) & (F.col("tops") == 1)).withColumn("grp", F.when(F.col("truth") >= 0.8, "true").when(F.col("truth") <= 0.2, "false").otherwise("mixed"))
    return _rounded(g.select(*own, "peak", "value", "nominal", "strict", "half_span", "grp"))


@query(f"WITH {VOXELS}, l AS (SELECT volume, z AS width, round(avg((ct > 127)::INTEGER) FILTER (x < 2) - avg((v > 127)::INTEGER) FILTER (x < 2), 6) AS inside, round(avg((ct > 127)::INTEGER) FILTER (x >= 2) - avg((v > 127)::INTEGER) FILTER (x >= 2), 6) AS outside FROM voxels GROUP BY ALL) SELECT *, round(inside - outside, 6) AS lift FROM l")
def a51_mask_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of the thresholded response inside and outside a mask."""
    d = (F.col("ct") > 127).cast("double") - (F.col("v") > 127).cast("double")
    g = voxels(spark, sf_dir).groupBy("volume", F.col("z").alias("width")).agg(F.round(F.avg(F.when(F.col("x") < 2, d)), 6).alias("inside"), F.round(F.avg(F.when(F.col("x") >= 2, d)), 6).alias("outside"))
    return g.withColumn("lift", F.round(F.col("inside") - F.col("outside"), 6))


_CHUNKS = f"{VOXELS}, w AS (SELECT volume, chunk // 100 AS cz, (chunk // 10) % 10 AS cy, chunk % 10 AS cx, z, y, x, v FROM voxels)"
_SENDS = " AND ".join(f"(d{a} = 0 OR d{a} = -1 AND {a} = 0 OR d{a} = 1 AND {a} = 3)" for a in "zyx")


@query(f"""WITH {_CHUNKS}, s AS (SELECT volume, cz + dz AS cz, cy + dy AS cy, cx + dx AS cx, z - 4 * dz AS z, y - 4 * dy AS y, x - 4 * dx AS x, v FROM w, range(-1, 2) i(dz), range(-1, 2) j(dy), range(-1, 2) k(dx) WHERE (dz <> 0 OR dy <> 0 OR dx <> 0) AND {_SENDS})
SELECT volume, cz, cy, cx, count(*) AS halo, sum(v)::BIGINT AS total, sum(v * (z + 7 * y + 49 * x))::BIGINT AS placed FROM s JOIN (SELECT DISTINCT volume, cz, cy, cx FROM w) USING (volume, cz, cy, cx) GROUP BY ALL""")
def v01_halo_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk's border voxels sent to its 26 neighbours of the same volume, with their places there."""
    v = voxels(spark, sf_dir).select("volume", F.expr("chunk div 100").alias("cz"), F.expr("(chunk div 10) % 10").alias("cy"), (F.col("chunk") % 10).alias("cx"), "z", "y", "x", "v")
    h = voxel_op.halo(v, ["volume"], 4)
    return h.groupBy("volume", "cz", "cy", "cx").agg(F.count("*").alias("halo"), F.sum("v").alias("total"), F.sum(F.col("v") * (F.col("z") + 7 * F.col("y") + 49 * F.col("x"))).alias("placed"))


@query()
def a70_axial_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two axes for each block of tiles and where they turn to the next block; tested against a loop."""
    t = surfaces.tile_orientation(grid(spark, sf_dir), "z", 5).select("surface", F.floor(F.col("tr") / 2).alias("tr"), F.floor(F.col("tc") / 2).alias("tc"), F.col("tr").alias("r"), F.col("tc").alias("c"), "angle", "energy").where("angle IS NOT NULL AND energy > 0")
    return surfaces.frame_turns(surfaces.two_axes(t, ["surface", "tr", "tc"], ["r", "c"], "angle", "energy"), 30.0)


@query(f"WITH {VOXELS}, a AS (SELECT volume, chunk, v > 120 AS a, ct > 120 AS b, abs(v - ct) AS d FROM voxels), g AS (SELECT volume, chunk, count(*) FILTER (a AND b) / nullif(count(*) FILTER (a OR b), 0) AS iou, quantile_cont(d::DOUBLE, 0.95) AS p95 FROM a GROUP BY ALL) SELECT volume, chunk, round(iou, 6) AS iou, round(p95, 6) AS p95, CASE WHEN iou IS NULL THEN 'unverified' WHEN iou >= 0.8 THEN 'stable' ELSE 'sensitive' END AS status FROM g")
def a53_variant_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("v") > 120, F.col("ct") > 120
    g = voxels(spark, sf_dir).groupBy("volume", "chunk").agg(F.try_divide(F.count_if(a & b), F.count_if(a | b)).alias("iou"), F.percentile(F.abs(F.col("v") - F.col("ct")), F.lit(0.95)).alias("p95"))
    return _rounded(g.withColumn("status", F.when(F.col("iou").isNull(), "unverified").when(F.col("iou") >= 0.8, "stable").otherwise("sensitive")))


@query(f"WITH {GRID}, e AS (SELECT surface, row, col, row_number() OVER (PARTITION BY surface ORDER BY row, col) - 1 AS place, count(*) OVER (PARTITION BY surface) AS n, x, y, z FROM grid WHERE valid), s AS (SELECT * FROM e WHERE n <= 40 OR place IN (SELECT unnest(list_transform(range(0, 40), lambda i: ((2 * i + 1) * n) // 80)))) SELECT surface, row, col, round(min(z + o), 6) AS z0, round(max(z + o), 6) AS z1, count(*) AS offsets FROM s, range(-3, 4) r(o) GROUP BY ALL")
def v06_probe_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices at midpoint ranks, their offset points, and the boxes that hold these."""
    from plumbline.operators.sampling import midpoint_ranks

    s = midpoint_ranks(grid(spark, sf_dir).where("valid").select("surface", "row", "col", "z"), ["surface"], ["row", "col"], 40)
    p = s.withColumn("o", F.explode(F.sequence(F.lit(-3), F.lit(3))))
    return _rounded(p.groupBy("surface", "row", "col").agg(F.min(F.col("z") + F.col("o")).alias("z0"), F.max(F.col("z") + F.col("o")).alias("z1"), F.count("*").alias("offsets")))


@query()
def a65_leave_one_domain_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2 logistic regression with quadratic terms, one fit for each held-out language and arm (length alone, with the signs), its scores' FPR at 0.9 recall. Fits are few (two for each language); their rows stay distributed. Tested against Newton's method."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import PolynomialExpansion, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from plumbline.operators.evaluation import fpr_at_recall

    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("lang", F.col("quality").cast("double").alias("label"), F.log1p("n_chars").alias("a"), (F.length(F.regexp_replace("text", "[^!*#$%&|]", "")) / F.greatest(F.lit(1), F.length("text"))).alias("b"))
    held = [r.lang for r in d.select("lang").distinct().orderBy("lang").collect()]
    out = None
    for arm, inputs in (("length", ["a"]), ("length and signs", ["a", "b"])):
        x = PolynomialExpansion(degree=2, inputCol="raw", outputCol="features").transform(VectorAssembler(inputCols=inputs, outputCol="raw").transform(d)).select("lang", "label", "features")
        for lang in held:
            m = LogisticRegression(regParam=0.01, elasticNetParam=0.0, maxIter=100, tol=1e-9).fit(x.where(F.col("lang") != lang))
            s = m.transform(x.where(F.col("lang") == lang)).select(F.lit(arm).alias("arm"), F.lit(lang).alias("held"), vector_to_array("probability")[1].alias("score"), (F.col("label") == 1).alias("y"))
            f = fpr_at_recall(s, ["arm", "held"], "score", "y", 0.9)
            out = f if out is None else out.unionByName(f)
    return out


@query(f"WITH {VOXELS}, w AS (SELECT volume, chunk, sum(v) AS s, avg(v) AS m FROM voxels GROUP BY ALL) SELECT volume, round(avg(m), 6) AS mean, sum(s)::BIGINT AS total FROM w GROUP BY volume")
def s01_chunk_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks as raw bytes in a column, written, read and decoded to voxels again."""
    path = _scratch(spark)
    v = voxels(spark, sf_dir)
    raw = v.groupBy("volume", "chunk").agg(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("z", "y", "x", "v"))), lambda s: F.lpad(F.hex(s["v"].cast("long")), 2, "0")), "")).alias("content"))
    raw.select(F.col("volume").alias("level"), F.col("chunk").cast("int").alias("cz"), F.lit(0).alias("cy"), F.lit(0).alias("cx"), F.when(F.length("content") == 64, "decoded").otherwise("decode_failure").alias("status"), "content").write.parquet(path)
    vx = files.chunk_voxels(spark.read.parquet(path), (4, 4, 4)).withColumn("chunk", F.floor(F.col("z") / 4))
    w = vx.groupBy(F.col("level").alias("volume"), "chunk").agg(F.sum("v").alias("s"), F.avg("v").alias("m"))
    return _rounded(w.groupBy("volume").agg(F.avg("m").alias("mean"), F.sum("s").alias("total")))


