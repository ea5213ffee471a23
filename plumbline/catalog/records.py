"""Composite records, cumulative counts, histograms, and scans of nested documents."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.catalog import graphs, surfaces, voxels
from plumbline.catalog.fixtures import GRID, grid, scored, table
from plumbline.catalog.registry import ENTRIES, query
from plumbline.catalog.streams import _scratch
from plumbline.catalog.voxels import _rounded
from plumbline.operators import evaluation as eval_op
from plumbline.operators import surfaces as op
from plumbline.operators import voxels as vox_op
from plumbline.sources import files


@query("WITH h AS (SELECT event_type, floor(value)::BIGINT AS v, count(*) AS n FROM events GROUP BY ALL) SELECT event_type, v, n, sum(n) OVER (PARTITION BY event_type ORDER BY v)::BIGINT AS upto FROM h")
def w08_cumulative_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative over distinct values, after aggregation."""
    h = table(spark, sf_dir, "events").groupBy("event_type", F.floor("value").alias("v")).agg(F.count("*").alias("n"))
    return h.withColumn("upto", F.sum("n").over(Window.partitionBy("event_type").orderBy("v")))


@query(f"WITH {voxels._SCORES}, b AS (SELECT CASE WHEN score = 80 THEN 75 WHEN score >= 25 AND score < 80 THEN (floor(score / 5) * 5)::INTEGER END AS bin FROM (SELECT round(score, 6) AS score FROM scores)) SELECT r.bin::INTEGER AS bin, count(b.bin) AS volumes FROM range(25, 80, 5) r(bin) LEFT JOIN b ON b.bin = r.bin GROUP BY r.bin")
def w11_score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes by bins of five from 25 to 80, the last closed, empty bins kept."""
    b = vox_op.leaderboard(_rounded(voxels._scores(spark, sf_dir).select("volume", "score")), "volume")
    bins = spark.range(25, 80, 5).select(F.col("id").cast("int").alias("bin"))
    return bins.join(b.select("bin", "volume"), "bin", "left").groupBy("bin").agg(F.count("volume").alias("volumes"))


@query(ENTRIES["a26_bootstrap_ratio"][1])
def x03_pluggable_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statistic that the caller gives as a function of the replicate table."""

    def share(rep: DataFrame) -> DataFrame:
        s = F.col("weight") * F.col("score")
        return rep.groupBy("grp", "replicate").agg((F.sum(F.when(F.col("y"), s)) / F.sum(s)).alias("stat"))

    return _rounded(eval_op.bootstrap(scored(spark, sf_dir), ["grp"], "id", "ratio", 100, share))


@query("SELECT url AS key, length(html) AS size FROM pages")
def s04_object_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing pages of a hundred objects each, landed as JSON."""
    path = _scratch(spark)
    p = table(spark, sf_dir, "pages").select(F.expr("page_id div 100").alias("g"), F.struct(F.col("url").alias("key"), F.length("html").cast("long").alias("size")).alias("o"))
    p.groupBy("g").agg(F.collect_list("o").alias("contents")).select("contents").write.json(path)
    return files.listing_pages(spark, path)


@query("SELECT r_name AS sample, n_name AS volume, 'origin-' || n_nationkey AS origin FROM nation JOIN region ON n_regionkey = r_regionkey")
def s03_nested_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark)
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    v = F.struct("n_name", F.struct(F.array(F.struct(F.concat(F.lit("origin-"), F.col("n_nationkey").cast("string")).alias("origin"))).alias("data")))
    d = n.groupBy("r_name").agg(F.map_from_entries(F.collect_list(v)).alias("m")).select(F.create_map("r_name", F.struct(F.col("m").alias("volumes"))).alias("samples"))
    d.write.option("maxRecordsPerFile", 1).json(path)
    return files.catalogue(spark, path)


@query("SELECT user_id || ':' || dayofmonth(ts) AS id, (row_number() OVER (PARTITION BY user_id, dayofmonth(ts) ORDER BY ts, event_id) - 1)::INTEGER AS ord, value AS x FROM events")
def s07_annotated_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each user and day, points in order, read back with their places."""
    path = _scratch(spark)
    e = table(spark, sf_dir, "events").select(F.concat_ws(":", F.col("user_id").cast("string"), F.dayofmonth("ts").cast("string")).alias("id"), F.struct("ts", "event_id", F.array(F.col("value"), F.lit(0.0), F.lit(0.0)).alias("p")).alias("s"))
    d = e.groupBy("id").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["p"]).alias("line_points"))
    d.withColumn("control_points", F.slice("line_points", 1, 1)).withColumn("segments", F.array(F.struct(F.lit("auto").alias("mode")))).write.json(path)
    return files.trace_json(spark, path, lines=True)["points"].select("id", "ord", "x")


@query("SELECT o_orderkey % 4 AS mesh, 1::BIGINT AS a, 2::BIGINT AS b, 1::BIGINT AS ta, NULL::BIGINT AS tb, count(*) AS n, round(sum(o_totalprice), 2) AS z FROM orders GROUP BY ALL UNION ALL SELECT o_orderkey % 4, 2, 3, NULL, 2, count(*), round(sum(o_totalprice), 2) FROM orders GROUP BY ALL")
def s09_polygon_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a quad of one of four meshes, its corners and their texture vertices counted back from the face; the fans' offsets, and the heights of the first corners that they name."""
    path = _scratch(spark)
    z = F.col("o_totalprice").cast("string")
    v = [F.concat_ws(" ", F.lit("v"), F.lit(x), F.lit(y), z) for x, y in (("0", "0"), ("1", "0"), ("1", "1"), ("0", "1"))]
    vt = [F.concat_ws(" ", F.lit("vt"), F.lit(x), F.lit(y)) for x, y in (("0", "0"), ("1", "0"), ("0", "1"))]
    orders = table(spark, sf_dir, "orders")
    text = orders.select((F.col("o_orderkey") % 4).alias("mesh"), F.concat_ws("\n", *v, *vt, F.lit("f -4/-3 -3/-2 -2 -1/-1")).alias("value"))
    text.write.partitionBy("mesh").text(path)
    m = files.polygon_mesh(spark, path)
    of = F.regexp_extract("mesh", "mesh=([0-9]+)", 1).cast("long")
    t = m["triangles"].join(m["vertices"].select("mesh", F.col("vid").alias("v0"), "z"), ["mesh", "v0"])
    offset = [(F.col(c) - F.col(b)).alias(n) for c, b, n in (("v1", "v0", "a"), ("v2", "v0", "b"), ("t1", "t0", "ta"), ("t2", "t0", "tb"))]
    return t.groupBy(of.alias("mesh"), *offset).agg(F.count("*").alias("n"), F.round(F.sum("z"), 2).alias("z"))


@query("SELECT l_suppkey::VARCHAR AS root, l_returnflag AS run, round(avg(l_quantity), 6) AS score, count(DISTINCT l_orderkey) AS decoded FROM lineitem GROUP BY ALL")
def s12_score_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark)
    r = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("root"), F.col("l_returnflag").alias("run")).agg(F.avg("l_quantity").alias("score"), F.collect_set("l_orderkey").alias("identities"))
    r.withColumn("ok", F.lit(True)).write.json(path)
    return files.score_tables(spark, path).select("root", "run", F.round("score", 6).alias("score"), F.size("identities").cast("long").alias("decoded"))


@query(ENTRIES["p27_centred_normals"][1].replace("SELECT surface, row, col, round(nx / l, 6) AS nx, round(ny / l, 6) AS ny, round(nz / l, 6) AS nz FROM m WHERE l > 0", "SELECT surface, count(*) AS eligible FROM m WHERE l > 0 AND row % 30 BETWEEN 2 AND 27 AND col BETWEEN 2 AND 97 GROUP BY surface"))
def p20_grid_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices with a normal and room for the halo on all sides."""
    n = surfaces.p27_centred_normals(spark, sf_dir)
    return n.where("row % 30 BETWEEN 2 AND 27 AND col BETWEEN 2 AND 97").groupBy("surface").agg(F.count("*").alias("eligible"))


def _corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir).select((F.col("row") * 100 + F.col("col")).alias("v"), "x", "y", "z")
    t = op.triangles(grid(spark, sf_dir), 100)
    for k, name in enumerate("abc"):
        t = t.join(g.select(F.col("v").alias(f"v{k}"), *[F.col(a).alias(name + a) for a in op.AXES]), f"v{k}")
    return t


@query()
def j11_point_to_triangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vertex, moved off its surface, against the mesh; tested against a loop."""
    p = grid(spark, sf_dir).select((F.col("row") * 100 + F.col("col")).alias("id"), (F.col("x") + 3).alias("x"), (F.col("y") + 2).alias("y"), (F.col("z") + 5).alias("z"))
    return op.point_to_mesh(p, _corners(spark, sf_dir), "id", 20.0)


@query()
def a77_patch_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid share, components of the valid part, holes (pieces of the rest, corners joined, that do not reach the border), edge lengths, support; tested against loops."""
    g = grid(spark, sf_dir)
    e = op.grid_edges(g).groupBy("surface").agg(F.percentile("length", F.array(F.lit(0.5), F.lit(0.99))).alias("q"))
    c = graphs._grid_components(g.where("valid").select("surface", "row", "col")).groupBy("surface").agg(F.count_distinct("label").alias("components"))
    own = lambda x: F.when(F.col("valid"), x)
    s = g.groupBy("surface").agg(F.avg(F.col("valid").cast("double")).alias("valid"), F.avg(own(F.col("p"))).alias("support"), F.avg(own((F.col("p") < 0.1).cast("double"))).alias("low_support"), F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    rest = graphs._grid_components(g.where(~F.col("valid")).select("surface", "row", "col"), diagonal=True).join(s.select("surface", "r0", "r1", "c0", "c1"), "surface")
    edge = F.col("row").isin(F.col("r0"), F.col("r1")) | F.col("col").isin(F.col("c0"), F.col("c1"))
    h = rest.groupBy("surface", "label").agg(F.bool_or(edge).alias("open")).groupBy("surface").agg(F.count_if(~F.col("open")).alias("holes"))
    s = s.join(h, "surface", "left").withColumn("holes", F.coalesce("holes", F.lit(0)))
    return s.join(c, "surface", "left").join(e, "surface", "left").select("surface", "valid", F.coalesce("components", F.lit(0)).alias("components"), "holes", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p99"), "support", "low_support")


@query(f"""WITH {surfaces._QUADS}, {surfaces._EDGES[len(GRID) + 2:]}, c AS (SELECT surface, count(*) AS cells, count(*) FILTER (valid) AS valid FROM grid GROUP BY surface), e AS (SELECT surface, count(*) AS edges, round(median(length), 6) AS spacing FROM ge GROUP BY surface), q AS (SELECT surface, count(*) AS quads, round(median(s1 / nullif(s2, 0)), 4) AS anisotropy FROM quads GROUP BY surface)
SELECT surface, cells, valid, edges, spacing, quads, anisotropy, concat_ws(',', CASE WHEN spacing > 20 THEN 'spacing' END, CASE WHEN valid < 0.9 * cells THEN 'holes' END, CASE WHEN anisotropy > 2 THEN 'distortion' END) AS findings FROM c LEFT JOIN e USING (surface) LEFT JOIN q USING (surface)""")
def a78_surface_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir)
    c = g.groupBy("surface").agg(F.count("*").alias("cells"), F.count_if("valid").alias("valid"))
    e = op.grid_edges(g).groupBy("surface").agg(F.count("*").alias("edges"), F.round(F.median("length"), 6).alias("spacing"))
    q = op.quads(g, 10.0).groupBy("surface").agg(F.count("*").alias("quads"), F.round(F.median("anisotropy"), 4).alias("anisotropy"))
    found = F.concat_ws(",", F.when(F.col("spacing") > 20, "spacing"), F.when(F.col("valid") < 0.9 * F.col("cells"), "holes"), F.when(F.col("anisotropy") > 2, "distortion"))
    return c.join(e, "surface", "left").join(q, "surface", "left").withColumn("findings", found)


@query(ENTRIES["a76_region_components"][1].replace("SELECT surface, label, count(*) AS area FROM k JOIN c USING (n) GROUP BY ALL", "SELECT surface, label, count(*) AS area, min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1, round(avg(p), 6) AS score, concat_ws(',', CASE WHEN count(*) < 3 THEN 'too_small' END, CASE WHEN min(col) = 0 OR max(col) = 99 THEN 'at_border' END) AS gaps FROM k JOIN c USING (n) GROUP BY ALL").replace("SELECT row * 100 + col AS n, row, col, surface FROM grid", "SELECT row * 100 + col AS n, row, col, surface, p FROM grid"))
def r09_component_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record of each component: box, score, and what is missing for it to count."""
    g = grid(spark, sf_dir).where("p >= 0.75")
    c = graphs._grid_components(g.select("surface", "row", "col")).join(g.select("surface", "row", "col", "p"), ["surface", "row", "col"])
    r = c.groupBy("surface", "label").agg(F.count("*").alias("area"), F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"), F.round(F.avg("p"), 6).alias("score"))
    return r.withColumn("gaps", F.concat_ws(",", F.when(F.col("area") < 3, "too_small"), F.when((F.col("c0") == 0) | (F.col("c1") == 99), "at_border")))
