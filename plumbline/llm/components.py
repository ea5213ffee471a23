"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import skew_join, written


def _state(edges: DataFrame) -> tuple[int, bool]:
    """How many edges there are, and whether they are stars: no node points to two, and none that is pointed to points on."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
    each = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    row = each.agg(F.coalesce(F.sum("out"), F.lit(0)), F.coalesce(F.max(F.col("out") + F.col("into")), F.lit(0))).first()
    return int(row[0]), row[1] <= 1


def _star(edges: DataFrame, n: int, large: bool) -> DataFrame:
    """edges: (u, v) with u > v. One round; every node's minimum comes from a map-side aggregate, and hub nodes are met by ``skew_join``."""
    if large:
        pairs = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        pairs = edges
    low = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("w"))
    met = skew_join(pairs, low, "u", "w", 2 * n, "v", "inner")
    if large:
        out = met.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") > F.col("v")).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): for each node of an edge, the smallest node that it reaches. Nodes without an edge have no row.

    Each round is written to the shared folder, so neither lineage nor driver memory grows with the
    rounds; the driver sees a count and whether all is stars by now. Hubs are spread, components of any size are never
    gathered in one task. Null ends and loops are left out; repeated edges count once.
    """
    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct(), "edges")
    n, stars = _state(now)
    while not stars:
        now = written(_star(written(_star(now, n, True), "large-star"), n, False), "small-star")
        n, stars = _state(now)
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
