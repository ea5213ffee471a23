"""Reviews, reruns, gauges and preflights between two of the given tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.catalog.fixtures import table
from plumbline.catalog.registry import query
from plumbline.catalog.voxels import _rounded
from plumbline.operators import reviews as op

_LINES = "SELECT l_orderkey AS k, max(l_linenumber) AS lines, min(l_linenumber) AS low, round(sum(l_quantity)) AS q FROM lineitem WHERE l_orderkey % 50 <> 7 GROUP BY l_orderkey"


def _orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as the original targets, their line items as what the reviewers sent back."""
    left = table(spark, sf_dir, "orders").where("o_orderkey % 40 <> 3").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 12).alias("v"), (F.col("o_orderkey") / 2).alias("x"))
    g = table(spark, sf_dir, "lineitem").where("l_orderkey % 50 <> 7").groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_linenumber").alias("lines"), F.min("l_linenumber").alias("low"), F.round(F.sum("l_quantity")).alias("q"))
    decision = F.when(F.col("lines") >= 6, "annotation_corrected").when(F.col("lines") == 5, "patch_issue").when(F.col("lines") == 4, "uncertain").when(F.col("lines") == 3, "odd").otherwise("no_issue")
    changed = ((F.col("lines") >= 6) & (F.col("q") % 9 != 0)) | (F.col("q") % 31 == 0)
    right = g.select("k", (F.col("k") % 12 + changed.cast("int")).alias("v"), (F.col("k") / 2 + (F.col("q") % 23 == 0).cast("int")).alias("x"), decision.alias("decision"))
    return left, right


@query(f"""WITH a AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 40 <> 3), b AS (SELECT *, (lines >= 6 AND q % 9 <> 0) OR q % 31 = 0 AS changed, q % 23 = 0 AS moved, CASE WHEN lines >= 6 THEN 'annotation_corrected' WHEN lines = 5 THEN 'patch_issue' WHEN lines = 4 THEN 'uncertain' WHEN lines = 3 THEN 'odd' ELSE 'no_issue' END AS status FROM ({_LINES})),
r AS (SELECT coalesce(a.k, b.k) AS k, status, list_filter([CASE WHEN b.k IS NULL THEN 'not_reviewed' END, CASE WHEN a.k IS NULL THEN 'not_in_original' END, CASE WHEN status = 'odd' THEN 'no_decision' END, CASE WHEN a.k IS NOT NULL AND status = 'annotation_corrected' AND NOT changed THEN 'not_changed' END, CASE WHEN a.k IS NOT NULL AND status <> 'annotation_corrected' AND changed THEN 'changed' END, CASE WHEN a.k IS NOT NULL AND moved THEN 'moved' END], lambda x: x IS NOT NULL) AS reasons FROM a FULL JOIN b ON a.k = b.k)
SELECT status, array_to_string(reasons, ',') AS reasons, count(*) AS n FROM r GROUP BY ALL""")
def j28_review_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a batch of reviews says of its targets, and all that is wrong with it."""
    found = op.review_ingest(*_orders(spark, sf_dir), ["k"], "v", ["x"], "decision")
    return found["ledger"].groupBy("status", F.array_join("reasons", ",").alias("reasons")).agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT s_suppkey AS k, s_nationkey AS v FROM supplier WHERE s_suppkey % 11 <> 4), a AS (SELECT l_suppkey AS k, any_value(s_nationkey) + (l_suppkey % 5 = 1)::INTEGER AS v FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_suppkey), c AS (SELECT l_suppkey AS k, any_value(s_nationkey) + 1 AS declared FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_suppkey % 5 = 1 AND l_suppkey % 2 = 0 OR l_suppkey % 13 = 2 GROUP BY l_suppkey),
j AS (SELECT coalesce(b.k, a.k, c.k) AS k, b.v AS before, a.v AS after, a.v - b.v AS delta, declared, b.k IS NOT NULL AS hb, a.k IS NOT NULL AS ha, c.k IS NOT NULL AS hc FROM b FULL JOIN a ON a.k = b.k FULL JOIN c ON c.k = coalesce(b.k, a.k))
SELECT k, before, after, delta, declared, array_to_string(list_filter([CASE WHEN hb AND NOT ha THEN 'only_before' END, CASE WHEN ha AND NOT hb THEN 'only_after' END, CASE WHEN hc AND NOT hb THEN 'correction_of_nothing' END, CASE WHEN NOT hc AND ha AND hb AND before <> after THEN 'undeclared_change' END, CASE WHEN hc AND ha AND declared <> after THEN 'not_applied' END, CASE WHEN hc AND hb AND before = declared THEN 'no_correction' END], lambda x: x IS NOT NULL), ',') AS reasons FROM j""")
def j27_rerun_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' nations before, those of line items' suppliers after, and a table of declared corrections."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"))
    seen = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k")).distinct().join(s, "k")
    after = seen.select("k", (F.col("n") + (F.col("k") % 5 == 1).cast("int")).alias("v"))
    said = seen.where("k % 5 = 1 AND k % 2 = 0 OR k % 13 = 2").select("k", (F.col("n") + 1).alias("v"))
    got = op.rerun_comparison(s.where("k % 11 <> 4").select("k", F.col("n").alias("v")), after, said, ["k"], "v")
    return got.withColumn("reasons", F.array_join("reasons", ","))


@query("WITH s AS (SELECT p_partkey AS sample, p_size % 20 AS expected FROM part), d AS (SELECT l_partkey AS sample, l_quantity::INTEGER % 20 AS winding, min(l_discount * 100 + l_tax) AS distance FROM lineitem GROUP BY ALL), m AS (SELECT sample, expected, winding - expected AS delta, distance FROM s JOIN d USING (sample) WHERE abs(winding - expected) <= 2), b AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY distance, abs(delta), delta) AS k FROM m) SELECT delta, count(*) AS n, round(avg(distance), 6) AS mean FROM s LEFT JOIN (SELECT sample, delta, distance FROM b WHERE k = 1) USING (sample) GROUP BY delta")
def j32_nearest_windings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as samples with an expected winding, line items as their distances to the windings: how far off the nearest one is."""
    s = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sample"), (F.col("p_size") % 20).alias("expected"))
    d = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("sample"), (F.col("l_quantity").cast("int") % 20).alias("winding")).agg(F.min(F.col("l_discount") * 100 + F.col("l_tax")).alias("distance"))
    got = op.winding_neighbours(s, d, "sample", "expected", "winding", "distance")
    return _rounded(got.groupBy("delta").agg(F.count("*").alias("n"), F.avg("d").alias("mean")))


@query("""WITH t AS (SELECT s_suppkey AS a, s_suppkey + 1000000 + s_nationkey AS b, s_nationkey AS d FROM supplier), g AS (SELECT l_returnflag || l_linestatus AS producer, s_suppkey + 1000000 + s_nationkey AS b, s_suppkey AS a, max(CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END) AS off, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_linenumber > 4 GROUP BY ALL)
SELECT producer, count(*) AS answered, 0::BIGINT AS unknown, sum(n - 1)::BIGINT AS repeated, round(count(*) / (SELECT count(*) FROM t), 6) AS coverage, round(avg((off = 0)::INTEGER), 6) AS exact, 1.0::DOUBLE AS within_one, round(avg(off), 6) AS mean, median(off)::DOUBLE AS median, count(*) / (SELECT count(*) FROM t) >= 0.5 AND avg((off = 0)::INTEGER) >= 0.5 AS admissible FROM g GROUP BY producer""")
def a39_producer_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items' flags as producers who answer for pairs that suppliers know the truth of, the other way round and some of them one off."""
    s = table(spark, sf_dir, "supplier")
    other = F.col("s_suppkey") + 1000000 + F.col("s_nationkey")
    truth = s.select(F.col("s_suppkey").alias("a"), other.alias("b"), F.col("s_nationkey").alias("d"))
    item = table(spark, sf_dir, "lineitem").where("l_linenumber > 4").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    off = (F.col("l_linenumber") == 7).cast("int")
    given = item.select(F.concat("l_returnflag", "l_linestatus").alias("producer"), other.alias("a"), F.col("s_suppkey").alias("b"), (-F.col("s_nationkey") - off).alias("d"))
    # the pair is turned, so that the largest difference is the smallest of those given
    given = given.groupBy("producer", "a", "b").agg(F.min("d").alias("d"), F.count("*").alias("n")).select("producer", "a", "b", "d", F.explode(F.array_repeat(F.lit(1), F.col("n").cast("int"))).alias("one"))
    return _rounded(op.producer_gauge(truth, given, "producer", "a", "b", "d", 0.5, 0.5))


@query("""WITH e AS (SELECT c_custkey AS region, 's' || c_nationkey % 3 AS split, 'c' || c_custkey % 2 AS checkpoint FROM customer WHERE c_custkey % 9 <> 5), r AS (SELECT o_custkey AS region, count(*) AS n, max(o_orderkey) AS k, any_value(c_nationkey) AS nation FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey), j AS (SELECT coalesce(e.region, r.region) AS region, e.region IS NOT NULL AS he, r.region IS NOT NULL AS hr, n, k, nation, split, checkpoint FROM e FULL JOIN r ON r.region = e.region),
w AS (SELECT region, list_filter([CASE WHEN NOT he THEN 'not_expected' END, CASE WHEN NOT hr THEN 'no_report' END, CASE WHEN he AND hr AND split <> 's' || (nation + (k % 10 = 0)::INTEGER) % 3 THEN 'wrong_split' END, CASE WHEN he AND hr AND k % 7 = 0 THEN 'not_held_out' END, CASE WHEN he AND hr AND n > 14 THEN 'overlap' END, CASE WHEN he AND hr AND k % 11 = 0 THEN 'wrong_checkpoint' END, CASE WHEN he AND hr AND n < 3 THEN 'not_ready' END, CASE WHEN he AND hr AND k % 13 = 0 THEN 'no_digest' END], lambda x: x IS NOT NULL) AS reasons FROM j)
SELECT region, CASE WHEN len(reasons) = 0 THEN 'ready' ELSE 'failed' END AS status, array_to_string(reasons, ',') AS reasons FROM w""")
def r08_region_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as expected regions, their orders as what was reported."""
    c = table(spark, sf_dir, "customer")
    want = c.where("c_custkey % 9 <> 5").select(F.col("c_custkey").alias("region"), F.concat(F.lit("s"), F.col("c_nationkey") % 3).alias("split"), F.concat(F.lit("c"), F.col("c_custkey") % 2).alias("checkpoint"))
    r = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("region")).agg(F.count("*").alias("n"), F.max("o_orderkey").alias("k")).join(c.select(F.col("c_custkey").alias("region"), "c_nationkey"), "region")
    k = F.col("k")
    report = r.select("region", F.concat(F.lit("s"), (F.col("c_nationkey") + (k % 10 == 0).cast("int")) % 3).alias("split"), (k % 7 != 0).alias("held_out"), F.when(F.col("n") > 14, "some").otherwise("none").alias("overlap"), F.concat(F.lit("c"), F.when(k % 11 == 0, 9).otherwise(F.col("region") % 2)).alias("checkpoint"), (F.col("n") >= 3).alias("ready"), F.when(k % 13 != 0, F.sha2(k.cast("string"), 256)).alias("digest"))
    return op.region_preflight(want, report, "region").withColumn("reasons", F.array_join("reasons", ","))


@query("""WITH a AS (SELECT p_partkey AS k, p_retailprice AS price, p_brand AS brand FROM part WHERE p_partkey % 10 <> 1), b AS (SELECT l_partkey AS k, max(p_retailprice) + CASE WHEN l_partkey % 6 = 0 THEN 0.5 WHEN l_partkey % 6 = 1 THEN 0.0000001 ELSE 0 END AS price, CASE WHEN l_partkey % 8 = 0 THEN 'x' ELSE any_value(p_brand) END AS brand FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_partkey), j AS (SELECT coalesce(a.k, b.k) AS k, a.k IS NOT NULL AS ha, b.k IS NOT NULL AS hb, abs(a.price - b.price) > 0.000001 AS p, a.brand <> b.brand AS q FROM a FULL JOIN b ON a.k = b.k)
SELECT k, 'only_left' AS field FROM j WHERE NOT hb UNION ALL SELECT k, 'only_right' FROM j WHERE NOT ha UNION ALL SELECT k, 'price' FROM j WHERE ha AND hb AND p UNION ALL SELECT k, 'brand' FROM j WHERE ha AND hb AND q""")
def j22_drift_with_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts against what line items say of them: targets of one side, prices beyond the tolerance, other brands."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("price"), F.col("p_brand").alias("brand"))
    seen = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k")).distinct().join(p, "k")
    right = seen.select("k", (F.col("price") + F.when(F.col("k") % 6 == 0, 0.5).when(F.col("k") % 6 == 1, 1e-7).otherwise(0.0)).alias("price"), F.when(F.col("k") % 8 == 0, "x").otherwise(F.col("brand")).alias("brand"))
    return op.manifest_drift(p.where("k % 10 <> 1"), right, "k", ["price"], ["brand"]).select("k", "field")
