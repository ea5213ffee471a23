"""Scans of landed files, and sinks that never overwrite. Schemas are given, never inferred; what does not fit becomes a row that says so."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def chunk_objects(spark: SparkSession, path: str, size: int) -> DataFrame:
    """(level, cz, cy, cx, status, content): one row per stored raw chunk named level/cz/cy/cx; a wrong length is a decode failure. Chunks that are absent are fill value, not rows."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    part = lambda k: F.regexp_extract("path", r"(\d+)/(\d+)/(\d+)/(\d+)$", k).cast("int")
    ok = F.length("content") == size
    return raw.where(F.col("path").rlike(r"\d+/\d+/\d+/\d+$")).select(part(1).alias("level"), part(2).alias("cz"), part(3).alias("cy"), part(4).alias("cx"), F.when(ok, "decoded").otherwise("decode_failure").alias("status"), F.when(ok, F.col("content")).alias("content"))


def chunk_voxels(chunks: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """The bytes of decoded chunks as voxel rows in global coordinates, z-y-x order."""
    nz, ny, nx = shape
    at = F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(nz * ny * nx)), lambda i: F.conv(F.hex(F.substring("content", i, F.lit(1))), 16, 10).cast("int")))
    v = chunks.where("status = 'decoded'").select("level", "cz", "cy", "cx", at.alias("i", "v"))
    return v.select("level", (F.col("cz") * nz + F.floor(F.col("i") / (ny * nx))).cast("int").alias("z"), (F.col("cy") * ny + F.floor(F.col("i") / nx) % ny).cast("int").alias("y"), (F.col("cx") * nx + F.col("i") % nx).cast("int").alias("x"), "v")


def array_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(path, shape, chunks, dtype, fill_value, status): array descriptions; other types and orders than plain bytes in C order are refused by status."""
    schema = "shape array<int>, chunks array<int>, dtype string, order string, fill_value int, compressor string"
    doc = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", schema).alias("d")).select("path", "d.*")
    good = (F.col("dtype") == "|u1") & (F.col("order") == "C") & F.col("compressor").isNull() & F.col("shape").isNotNull()
    return doc.withColumn("status", F.when(F.coalesce(good, F.lit(False)), "usable").otherwise("refused"))


def catalogue(spark: SparkSession, path: str, only: list[str] | None = None) -> DataFrame:
    """(sample, volume, origin): samples, their volumes and data origins, one row per volume root."""
    schema = "samples map<string, struct<volumes: map<string, struct<data: array<struct<origin: string>>>>>>"
    doc = spark.read.schema(schema).json(path, multiLine=True)
    s = doc.select(F.explode("samples").alias("sample", "s")).select("sample", F.explode("s.volumes").alias("volume", "v")).select("sample", "volume", F.explode("v.data").alias("d")).select("sample", "volume", F.col("d.origin").alias("origin"))
    return s.where(F.col("sample").isin(only)) if only else s


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(key, size): names and sizes alone; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("key"), F.col("length").alias("size"))


def point_collections(spark: SparkSession, path: str, role: str) -> DataFrame:
    """(role, frame, cid, pid, x, y, z, w): points with whole labels; a collection without absolute labels is a frame of its own."""
    schema = "collections map<string, struct<absolute: boolean, points: map<string, struct<p: array<double>, wind_a: double>>>>"
    c = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("collections").alias("cid", "c"))
    p = c.select("cid", "c.absolute", F.explode("c.points").alias("pid", "q"))
    frame = F.when(F.col("absolute"), "absolute").otherwise(F.concat_ws(":", F.lit("relative"), "cid"))
    out = p.select(F.lit(role).alias("role"), frame.alias("frame"), "cid", "pid", *[F.col("q.p")[k].alias(a) for k, a in enumerate("xyz")], F.col("q.wind_a").alias("w"))
    return out.where(F.col("w") == F.rint("w")).withColumn("w", F.col("w").cast("int"))


def trace_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(points, bad rows) of a file with trace_id, ord, x, y, z."""
    schema = "trace_id string, ord int, x double, y double, z double, bad string"
    rows = spark.read.schema(schema).csv(path, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="bad").withColumn("bad", F.coalesce("bad", F.when(F.col("x").isNull() | F.col("y").isNull() | F.col("z").isNull() | F.col("ord").isNull(), "missing value")))
    return rows.where("bad IS NULL").drop("bad"), rows.where("bad IS NOT NULL").select("trace_id", "bad")


def trace_json(spark: SparkSession, path: str, lines: bool = False) -> dict[str, DataFrame]:
    """Points, control points and segments of annotated traces, each with its place; a document a file, or a line."""
    point = "array<array<double>>"
    doc = spark.read.schema(f"id string, line_points {point}, control_points {point}, segments array<struct<mode: string>>").json(path, multiLine=not lines)
    xyz = lambda c: doc.select("id", F.posexplode(c).alias("ord", "p")).select("id", "ord", *[F.col("p")[k].alias(a) for k, a in enumerate("xyz")])
    return {"points": xyz("line_points"), "controls": xyz("control_points"), "segments": doc.select("id", F.posexplode("segments").alias("ord", "s")).select("id", "ord", "s.mode")}


#: A task numbers so many lines of a mesh at a time.
LINES = 65_536


def polygon_mesh(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Text meshes, one a file: vertices (mesh, vid, x, y, z), uvs (mesh, tid, u, v), triangles (mesh, line, k, v0, v1, v2, t0, t1, t2) and bad lines (mesh, line, value, reason).

    Polygons of any number of corners are fanned, negative numbers count back from the line, corners
    without a texture vertex have NULL. Lines are numbered within their file by stretches of its blocks,
    LINES of them at most: one pass counts each stretch's lines, vertices and texture vertices, and a
    task sorts one stretch at a time, of lines alone.
    """
    block = ["mesh", "block", "stretch"]
    row = spark.read.text(path, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("mesh"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.trim("value").alias("value"))
    row = row.withColumn("stretch", F.floor(F.col("id") / LINES))
    tag = F.split("value", r"\s+", 2)[0]
    is_ = {"v": (tag == "v").cast("long"), "t": (tag == "vt").cast("long"), "l": F.lit(1).cast("long")}
    before = Window.partitionBy("mesh").orderBy("block", "stretch").rowsBetween(Window.unboundedPreceding, -1)
    base = row.groupBy(*block).agg(*[F.sum(c).alias(n) for n, c in is_.items()]).select(*block, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"base_{n}") for n in is_])
    upto = Window.partitionBy(*block).orderBy("id")
    cut = row.join(base, block).select("mesh", "value", *[(F.col(f"base_{n}") + F.sum(c).over(upto)).alias(f"seen_{n}") for n, c in is_.items()]).withColumnRenamed("seen_l", "line")
    cut = cut.withColumn("f", F.split("value", r"\s+")).withColumn("tag", F.col("f")[0])
    number = lambda k: F.get("f", F.lit(k)).try_cast("double")
    vertices = cut.where("tag = 'v'").select("mesh", "line", "value", F.col("seen_v").alias("vid"), *[number(k + 1).alias(a) for k, a in enumerate("xyz")])
    uvs = cut.where("tag = 'vt'").select("mesh", "line", "value", F.col("seen_t").alias("tid"), number(1).alias("u"), number(2).alias("v"))
    absolute = lambda i, seen: F.when(i < 0, F.col(seen) + 1 + i).otherwise(i)
    part = lambda t, k: F.get(F.split(t, "/"), F.lit(k)).try_cast("long")
    corner = F.transform(F.expr("slice(f, 2, greatest(size(f) - 1, 0))"), lambda t: F.struct(absolute(part(t, 0), "seen_v").alias("v"), absolute(part(t, 1), "seen_t").alias("t")))
    face = cut.where("tag = 'f'").select("mesh", "line", "value", corner.alias("c"))
    good = (F.size("c") >= 3) & F.forall("c", lambda x: x["v"].isNotNull() & (x["v"] > 0))
    fan = F.transform(F.sequence(F.lit(1), F.size("c") - 2), lambda i: F.array(F.get("c", F.lit(0)), F.get("c", i), F.get("c", i + 1)))
    tri = face.where(good).select("mesh", "line", F.posexplode(fan).alias("k", "t"))
    bad = lambda df, why, ok: df.where(~F.coalesce(ok, F.lit(False))).select("mesh", "line", "value", F.lit(why).alias("reason"))
    xyz, uv = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull(), F.col("u").isNotNull() & F.col("v").isNotNull()
    wrong = bad(vertices, "vertex", xyz).unionByName(bad(uvs, "texture vertex", uv)).unionByName(bad(face, "face", good))
    ends = [F.col("t")[k][a].alias(f"{a}{k}") for a in "vt" for k in range(3)]
    return {"vertices": vertices.drop("line", "value"), "uvs": uvs.drop("line", "value"), "triangles": tri.select("mesh", "line", "k", *ends), "bad": wrong}


def edge_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(edges, bad rows): ids written as numbers are cut to whole ones."""
    rows = spark.read.csv(path, header=True, schema="a string, b string")
    to = lambda c: F.col(c).try_cast("double").cast("long")
    out = rows.select("a", "b", to("a").alias("i"), to("b").alias("j"))
    return out.where("i IS NOT NULL AND j IS NOT NULL").select("i", "j"), out.where("i IS NULL OR j IS NULL").select("a", "b")


def tree_digest(spark: SparkSession, path: str, depth: int = 1) -> DataFrame:
    """(package, files, sha): SHA-256 of every file, then one over the sorted entries of each folder at the given depth above the file."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.sha2("content", 256).alias("sha"))
    f = f.withColumn("package", F.element_at(F.split("path", "/"), -1 - depth)).withColumn("name", F.substring_index("path", "/", -depth))
    entry = F.concat_ws(" ", "name", F.lit("file"), F.col("length").cast("string"), "sha")
    return f.groupBy("package").agg(F.count("*").alias("files"), F.sha2(F.array_join(F.array_sort(F.collect_list(entry)), "\n"), 256).alias("sha"))


def geometry_digest(grid: DataFrame, key: str, block: int = 64) -> DataFrame:
    """(key, sha): the digest of validity and coordinates of valid vertices, by blocks of rows, so that no surface is gathered whole."""
    cell = F.concat_ws(",", F.col("row").cast("string"), F.col("col").cast("string"), F.col("valid").cast("string"), *[F.when(F.col("valid"), F.format_number(a, 6)) for a in "xyz"])
    b = grid.groupBy(key, F.floor(F.col("row") / block).alias("b")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "col", cell.alias("c")))), lambda s: s["c"]), ";"), 256).alias("h"))
    return b.groupBy(key).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda s: s["h"]), ""), 256).alias("sha"))


def write_once(df: DataFrame, path: str) -> None:
    """A result that is there already is refused."""
    df.write.mode("errorifexists").parquet(path)


def listing_pages(spark: SparkSession, path: str) -> DataFrame:
    """(key, size) from landed listing pages."""
    return spark.read.schema("contents array<struct<key: string, size: long>>").json(path).select(F.explode("contents").alias("c")).select("c.key", "c.size")


def score_tables(spark: SparkSession, path: str) -> DataFrame:
    """(run, root, ok, score, identities) of prior runs."""
    return spark.read.schema("run string, root string, ok boolean, score double, identities array<long>").json(path)
