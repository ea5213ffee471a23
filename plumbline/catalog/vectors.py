"""Vectors in two views: nearest neighbours, agreement, separation of classes."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.catalog.fixtures import table
from plumbline.catalog.registry import query
from plumbline.catalog.voxels import _rounded
from plumbline.operators import vectors as op

VIEWS = """v AS (SELECT view, vec_id AS item, label, list_transform(embedding, lambda x, i: x::DOUBLE * (1.0::DOUBLE + view * ((i - 1 + vec_id) % 3 - 1) * 0.1::DOUBLE)) AS x FROM embeddings, (SELECT unnest([0, 1])::INTEGER AS view)),
views AS (SELECT view, item, label, list_transform(x, lambda e: e / sqrt(list_dot_product(x, x))) AS u FROM v)"""


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings in two views, the second with every number shrunk, kept or stretched by a tenth: view, item, label, x."""
    e = table(spark, sf_dir, "embeddings").withColumn("view", F.explode(F.array(F.lit(0), F.lit(1))))
    x = F.transform("embedding", lambda v, i: v.cast("double") * (1.0 + F.col("view") * ((i + F.col("vec_id")) % 3 - 1) * 0.1))
    return e.select("view", F.col("vec_id").alias("item"), "label", x.alias("x"))


_NEAREST = f"WITH {VIEWS}, s AS (SELECT a.view, a.item, b.item AS other, round(list_dot_product(a.u, b.u), 12) AS c FROM views a JOIN views b ON a.view = b.view AND a.item <> b.item), n AS (SELECT view, item, other AS nearest, c AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY view, item ORDER BY c DESC, other) AS k FROM s) WHERE k = 1)"


@query(f"{_NEAREST} SELECT view, item, nearest, round(cosine, 6) AS cosine FROM n")
def a66_nearest_in_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest other vector of each, exact, from the blocks that can hold it."""
    return _rounded(op.nearest_vectors(views(spark, sf_dir), ["view"], "item", "x").drop("blocks", "opened"))


@query(f"{_NEAREST} SELECT a.view AS view_a, b.view AS view_b, count(*) AS items, round(avg(list_dot_product(a.u, b.u)), 6) AS mean_cosine, round(avg((p.nearest = q.nearest)::INTEGER), 6) AS stability FROM views a JOIN views b ON a.item = b.item AND a.view < b.view JOIN n p ON p.view = a.view AND p.item = a.item JOIN n q ON q.view = b.view AND q.item = b.item GROUP BY ALL")
def a66_neighbour_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of an item with itself across views, and whether its nearest neighbour stays the same."""
    return _rounded(op.view_agreement(views(spark, sf_dir), "view", "item", "x"))


@query(f"""WITH {VIEWS}, t AS (SELECT unnest([0, 1, 2]) AS a, unnest([1, 2, 99]) AS b), p AS (SELECT x.view, a, b, true AS alike, round(10000 * list_dot_product(x.u, y.u)) AS score FROM t JOIN views x ON x.label = a JOIN views y ON y.label = a AND y.view = x.view AND x.item < y.item UNION ALL SELECT x.view, a, b, false, round(10000 * list_dot_product(x.u, y.u)) FROM t JOIN views x ON x.label = a JOIN views y ON y.label = b AND y.view = x.view),
s AS (SELECT view, a, b, score, count(*) FILTER (alike) AS s, count(*) FILTER (NOT alike) AS c FROM p GROUP BY ALL), c AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY view, a, b ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s)
SELECT view, a AS class_a, b AS class_b, sum(s)::BIGINT AS same, sum(c)::BIGINT AS cross, round((sum(s * (below + c / 2.0)) / nullif(sum(s)::DOUBLE * sum(c), 0))::DOUBLE, 6) AS auc FROM c GROUP BY ALL""")
def a66_class_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two vectors of a class are nearer than one of it and one of another, in each view."""
    return _rounded(op.class_separation(views(spark, sf_dir), "view", "item", "label", "x", [(0, 1), (1, 2), (2, 99)]))
