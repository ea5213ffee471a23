"""Rules, gates, manifests, ledgers, string and digest functions."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.catalog.fixtures import POINTS, RUNS, TRACE, VOXELS, points, runs, table, trace, voxels
from plumbline.catalog.registry import query
from plumbline.catalog.samples import _draw
from plumbline.catalog.voxels import _rounded
from plumbline.functions import numeric as fn
from plumbline.operators import rules as op
from plumbline.operators import spatial

_RULES = """f AS (SELECT p_partkey, unnest(list_filter([CASE WHEN p_size > 40 THEN {'severity': 'error', 'code': 'size', 'path': '/size'} END, CASE WHEN p_name LIKE 'small%' THEN {'severity': 'warning', 'code': 'name', 'path': '/name'} END, CASE WHEN p_retailprice < 950 THEN {'severity': 'warning', 'code': 'price', 'path': '/price'} END], lambda x: x IS NOT NULL), recursive := true) FROM part)"""


def _found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf_dir, "part")
    return p, op.findings(p, "p_partkey", [("error", "size", F.col("p_size") > 40, "/size"), ("warning", "name", F.col("p_name").like("small%"), "/name"), ("warning", "price", F.col("p_retailprice") < 950, "/price")])


@query(f"WITH {_RULES} SELECT * FROM f")
def r01_rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir)[1]


@query(f"WITH {_RULES}, n AS (SELECT p_partkey, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM f GROUP BY ALL) SELECT p_partkey, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, CASE WHEN errors > 0 THEN 'fail' WHEN warnings > 0 THEN 'caution' ELSE 'pass' END AS status FROM part LEFT JOIN n USING (p_partkey)")
def r01_document_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, f = _found(spark, sf_dir)
    return op.worst(p, f, "p_partkey")


@query(f"WITH {_RULES} SELECT p_partkey, count(DISTINCT code) AS kinds, CASE WHEN count(DISTINCT code) >= 3 THEN '3+' WHEN count(DISTINCT code) >= 1 THEN '1-2' ELSE 'clean' END AS tier FROM part LEFT JOIN f USING (p_partkey) GROUP BY ALL")
def r10_finding_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, f = _found(spark, sf_dir)
    n = p.select("p_partkey").join(f, "p_partkey", "left").groupBy("p_partkey").agg(F.count_distinct("code").alias("kinds"))
    return n.withColumn("tier", F.when(F.col("kinds") >= 3, "3+").when(F.col("kinds") >= 1, "1-2").otherwise("clean"))


@query("SELECT 'duplicate' AS kind, (SELECT count(*) FROM (SELECT c_custkey FROM customer GROUP BY ALL HAVING count(*) > 1)) AS n UNION ALL SELECT 'unknown', (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) UNION ALL SELECT 'unused', (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders))")
def r02_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.integrity(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), "o_custkey", "c_custkey")


_GATE = """r AS (SELECT s_suppkey AS item, stage FROM supplier, (VALUES ('A'), ('N'), ('R')) v(stage)), e AS (SELECT item, stage, CASE WHEN m > 0.09 AND item % 3 = 0 THEN 'fail' WHEN item % 5 = 0 THEN NULL ELSE 'pass' END AS status FROM (SELECT l_suppkey AS item, l_returnflag AS stage, max(l_discount) AS m FROM lineitem GROUP BY ALL))"""


def _gate(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    r = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("item"), F.explode(F.array(*[F.lit(x) for x in "ANR"])).alias("stage"))
    k = F.col("l_suppkey")
    e = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.max("l_discount").alias("m"))
    s = F.when((F.col("m") > 0.09) & (k % 3 == 0), "fail").when(k % 5 == 0, None).otherwise("pass")
    return r, e.select(k.alias("item"), F.col("l_returnflag").alias("stage"), s.alias("status"))


@query(f"WITH {_GATE}, j AS (SELECT item, coalesce(status, 'unknown') AS s FROM r LEFT JOIN e USING (item, stage)) SELECT item, count(*) AS stages, count(*) FILTER (s = 'pass') AS passed, CASE WHEN bool_or(s = 'fail') THEN 'blocked' WHEN bool_or(s = 'unknown') THEN 'provisional' ELSE 'ready-to-freeze' END AS verdict FROM j GROUP BY item")
def r03_stage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.stage_gate(*_gate(spark, sf_dir), ["item", "stage"], "status")


@query(f"WITH {_GATE}, w AS (SELECT item, coalesce(any_value(status) FILTER (stage = 'A'), 'unknown') AS a, coalesce(any_value(status) FILTER (stage = 'N'), 'unknown') AS n, coalesce(any_value(status) FILTER (stage = 'R'), 'unknown') AS r FROM e GROUP BY item) SELECT s_suppkey AS item, coalesce(a, 'unknown') AS A, coalesce(n, 'unknown') AS N, coalesce(r, 'unknown') AS R, CASE WHEN coalesce(a, 'unknown') <> 'pass' THEN 'A' WHEN coalesce(n, 'unknown') <> 'pass' THEN 'N' WHEN coalesce(r, 'unknown') <> 'pass' THEN 'R' END AS next FROM supplier LEFT JOIN w ON item = s_suppkey")
def r04_passport(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, e = _gate(spark, sf_dir)
    return op.passport(r, e, "item", "stage", "status", ["A", "N", "R"])


@query("SELECT l_suppkey, CASE WHEN count(*) < 550 THEN 'UNKNOWN' WHEN max(l_tax) > 1 OR round(avg(l_discount), 9) > 0.0505 THEN 'DO NOT TRAIN' WHEN round(avg(l_quantity), 9) < 25.3 THEN 'CAUTION' ELSE 'TRAIN' END AS verdict FROM lineitem GROUP BY l_suppkey")
def r05_health_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means count at nine decimals, so that one that is equal to its limit does not depend on the order of summing."""
    g, mean = table(spark, sf_dir, "lineitem").groupBy("l_suppkey"), lambda c: F.round(F.avg(c), 9)
    v = F.when(F.count("*") < 550, "UNKNOWN").when((F.max("l_tax") > 1) | (mean("l_discount") > 0.0505), "DO NOT TRAIN").when(mean("l_quantity") < 25.3, "CAUTION").otherwise("TRAIN")
    return g.agg(v.alias("verdict"))


@query("""WITH e AS (SELECT user_id, CASE event_type WHEN 'click' THEN 'commit' WHEN 'purchase' THEN 'reveal' END AS kind, ts, (props->>'$.k')::BIGINT // 60 AS digest FROM events), g AS (SELECT user_id, min(ts) FILTER (kind = 'commit') AS c, min(ts) FILTER (kind = 'reveal') AS r, arg_min(digest, ts) FILTER (kind = 'commit') AS cd, arg_min(digest, ts) FILTER (kind = 'reveal') AS rd FROM e GROUP BY user_id),
k AS (SELECT user_id, concat_ws(',', CASE WHEN c IS NULL THEN 'no_commitment' END, CASE WHEN r IS NULL THEN 'no_reveal' END, CASE WHEN r <= c THEN 'reveal_before_commitment' END, CASE WHEN cd <> rd THEN 'digest_differs' END) AS reasons FROM g) SELECT user_id, reasons, CASE WHEN reasons = '' THEN 'intact' WHEN reasons = 'no_reveal' THEN 'open' ELSE 'broken' END AS verdict FROM k""")
def r06_custody(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_type") == "click", "commit").when(F.col("event_type") == "purchase", "reveal").alias("kind"), "ts", F.expr("cast(get_json_object(props, '$.k') as bigint) div 60").alias("digest"))
    return op.custody(e, "user_id")


@query("WITH e AS (SELECT p_partkey AS id, p_size % 6 AS kind, p_type FROM part), r AS (SELECT id, concat_ws(',', CASE WHEN kind = 0 THEN 'wrong_split' END, CASE WHEN kind IN (1, 3) THEN 'not_held_out' END, CASE WHEN kind = 3 THEN 'overlap' END, CASE WHEN p_type = 'PROMO' THEN 'missing_digest' END) AS reasons FROM e) SELECT id, reasons, CASE WHEN reasons = '' THEN 'ready' ELSE 'failed' END AS status FROM r")
def r08_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size") % 6
    reasons = F.concat_ws(",", F.when(k == 0, "wrong_split"), F.when(k.isin(1, 3), "not_held_out"), F.when(k == 3, "overlap"), F.when(F.col("p_type") == "PROMO", "missing_digest"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), reasons.alias("reasons"), F.when(reasons == "", "ready").otherwise("failed").alias("status"))


@query("WITH m AS (SELECT n_nationkey AS id, n_regionkey AS parent, n_nationkey % 4 = 0 AS final FROM nation), f AS (SELECT id, concat_ws(',', CASE WHEN parent NOT IN (SELECT r_regionkey FROM region) THEN 'unknown_parent' END, CASE WHEN id = parent THEN 'self_parent' END, CASE WHEN final AND id % 8 = 0 THEN 'no_run' END) AS problems FROM m) SELECT id, problems, problems = '' AS ok FROM f")
def r07_release_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.lit(True).alias("known")), "n_regionkey", "left")
    k = F.col("n_nationkey")
    p = F.concat_ws(",", F.when(F.col("known").isNull(), "unknown_parent"), F.when(k == F.col("n_regionkey"), "self_parent"), F.when((k % 4 == 0) & (k % 8 == 0), "no_run"))
    return n.select(k.alias("id"), p.alias("problems"), (p == "").alias("ok"))


@query(f"WITH {POINTS}, c AS (SELECT id, frame, z, r, abs(r - 50) > 80 AS flagged FROM points), n AS (SELECT a.id, max(1 / (1 + abs(a.r - b.r))) FILTER (NOT b.flagged) AS calm, max(1 / (1 + abs(a.r - b.r))) FILTER (b.flagged) AS loud FROM c a LEFT JOIN c b ON a.frame = b.frame AND a.id <> b.id AND floor(a.z / 20) = floor(b.z / 20) WHERE a.flagged GROUP BY a.id) SELECT id, CASE WHEN calm IS NULL AND loud IS NULL THEN 'none' WHEN loud IS NULL OR calm >= loud THEN 'disagree' ELSE 'agree' END AS context FROM n")
def r11_flag_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = points(spark, sf_dir).select("id", "frame", F.floor(F.col("z") / 20).alias("zb"), "r", (F.abs(F.col("r") - 50) > 80).alias("flagged"))
    b = c.select("frame", "zb", F.col("id").alias("oid"), F.col("r").alias("orr"), F.col("flagged").alias("of"))
    j = c.where("flagged").join(b, ["frame", "zb"], "left").withColumn("near", F.when(F.col("id") != F.col("oid"), 1 / (1 + F.abs(F.col("r") - F.col("orr")))))
    g = j.groupBy("id").agg(F.max(F.when(~F.col("of"), F.col("near"))).alias("calm"), F.max(F.when(F.col("of"), F.col("near"))).alias("loud"))
    return g.select("id", F.when(F.col("calm").isNull() & F.col("loud").isNull(), "none").when(F.col("loud").isNull() | (F.col("calm") >= F.col("loud")), "disagree").otherwise("agree").alias("context"))


@query("WITH l AS (SELECT n_nationkey AS id, n_name, n_regionkey FROM nation), r AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 7 = 0 THEN n_name || 'X' ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_nationkey <> 3), j AS (SELECT coalesce(l.id, r.id) AS id, CASE WHEN r.id IS NULL THEN 'only_left' WHEN l.id IS NULL THEN 'only_right' ELSE 'changed' END AS change, unnest(['n_name', 'n_regionkey']) AS field, unnest([l.n_name, l.n_regionkey::VARCHAR]) AS old, unnest([r.n_name, r.n_regionkey::VARCHAR]) AS new FROM l FULL JOIN r ON l.id = r.id) SELECT * FROM j WHERE old IS DISTINCT FROM new")
def j22_manifest_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), "n_name", "n_regionkey")
    r = n.where("id <> 3").withColumn("n_name", F.when(F.col("id") % 7 == 0, F.concat("n_name", F.lit("X"))).otherwise(F.col("n_name")))
    return op.drift(n, r, "id", ["n_name", "n_regionkey"])


@query("WITH a AS (SELECT c_nationkey AS id, count(*) AS n, max(c_custkey) AS latest FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY ALL) SELECT n_nationkey AS id, n, latest, CASE WHEN n IS NULL THEN 'missing' WHEN n < 10 THEN 'thin' ELSE 'eligible' END AS status FROM nation LEFT JOIN a ON id = n_nationkey")
def j21_manifest_derivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").groupBy(F.col("c_nationkey").alias("id")).agg(F.count("*").alias("n"), F.max("c_custkey").alias("latest"))
    j = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id")).join(a, "id", "left")
    return j.withColumn("status", F.when(F.col("n").isNull(), "missing").when(F.col("n") < 10, "thin").otherwise("eligible"))


@query("WITH l AS (SELECT p_partkey AS id, sha256(p_name) AS coord, CASE WHEN p_size % 3 > 0 THEN p_size END AS mask, CASE WHEN p_size % 5 > 0 THEN p_brand END AS meta FROM part), e AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN 'x' WHEN p_partkey % 13 = 0 THEN NULL ELSE sha256(p_name) END AS coord, CASE WHEN p_size % 3 > 0 THEN p_size END AS mask, CASE WHEN p_size % 7 > 0 THEN p_brand END AS meta FROM part WHERE p_partkey % 4 > 0) SELECT l.id, CASE WHEN e.id IS NULL OR e.coord IS NULL THEN 'unbound' WHEN l.coord <> e.coord OR l.mask IS DISTINCT FROM e.mask THEN 'mismatch' WHEN l.meta IS NULL OR e.meta IS NULL THEN 'coordinate-exact' WHEN l.meta <> e.meta THEN 'mismatch' ELSE 'semantic-exact' END AS level FROM l LEFT JOIN e USING (id)")
def j20_content_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k, s = table(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_size")
    sha, mask = F.sha2("p_name", 256), F.when(s % 3 > 0, s)
    local = p.select(k.alias("id"), sha.alias("coord"), mask.alias("mask"), F.when(s % 5 > 0, F.col("p_brand")).alias("meta"))
    ext = p.where(k % 4 > 0).select(k.alias("id"), F.when(k % 11 == 0, "x").when(k % 13 == 0, None).otherwise(sha).alias("coord"), mask.alias("mask"), F.when(s % 7 > 0, F.col("p_brand")).alias("meta"))
    return op.binding_level(local, ext, "id")


@query("WITH p AS (SELECT a.p_partkey AS fixed, b.p_partkey AS moving FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey <> b.p_partkey AND abs(a.p_retailprice - b.p_retailprice) < 0.45) SELECT moving, min(fixed) AS fixed, count(*) AS candidates, count(*) = 1 AS accepted FROM p GROUP BY moving")
def j23_pair_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_brand", "p_type", "p_partkey", "p_retailprice", F.floor(F.col("p_retailprice") / 0.45).alias("b"))
    a = p.withColumn("b", F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1))).alias("a")
    j = a.join(p.alias("m"), ["p_brand", "p_type", "b"]).where("a.p_partkey <> m.p_partkey AND abs(a.p_retailprice - m.p_retailprice) < 0.45")
    return j.groupBy(F.col("m.p_partkey").alias("moving")).agg(F.min("a.p_partkey").alias("fixed"), F.count("*").alias("candidates")).withColumn("accepted", F.col("candidates") == 1)


@query("WITH r AS (SELECT o_custkey AS reg, o_totalprice AS x, o_totalprice * CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE -1 END + o_orderkey % 100 AS y FROM orders), h AS (SELECT reg, h, avg(abs(y - s * x)) AS mean, max(abs(y - s * x)) AS worst FROM r, (VALUES ('same', 1), ('mirrored', -1), ('half', 0.5), ('flat', 0)) v(h, s) GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY reg ORDER BY round(mean, 6), h) AS k, lead(round(mean, 6)) OVER (PARTITION BY reg ORDER BY round(mean, 6), h) AS runner FROM h) SELECT reg, h AS hypothesis, round(mean, 4) AS mean, mean < 0.2 * runner AS accepted FROM k WHERE k = 1")
def j24_hypothesis_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, x = F.col("o_custkey"), F.col("o_totalprice")
    r = table(spark, sf_dir, "orders").select(k.alias("reg"), x.alias("x"), (x * F.when(k % 2 == 0, 1).otherwise(-1) + F.col("o_orderkey") % 100).alias("y"))
    hyp = F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.lit(float(s)).alias("s")) for h, s in (("same", 1), ("mirrored", -1), ("half", 0.5), ("flat", 0))]))
    h = r.withColumn("t", hyp).groupBy("reg", F.col("t.h").alias("hypothesis")).agg(F.avg(F.abs(F.col("y") - F.col("t.s") * F.col("x"))).alias("mean"))
    w = Window.partitionBy("reg").orderBy(F.round("mean", 6), "hypothesis")
    h = h.withColumn("k", F.row_number().over(w)).withColumn("runner", F.lead(F.round("mean", 6)).over(w)).where("k = 1")
    return h.select("reg", "hypothesis", F.round("mean", 4).alias("mean"), (F.col("mean") < 0.2 * F.col("runner")).alias("accepted"))


@query("SELECT batch, s_suppkey, CASE WHEN batch = 'checked' AND s_suppkey % 10 = 0 THEN s_acctbal + 1 ELSE s_acctbal END AS s_acctbal, batch = 'checked' AND s_suppkey % 10 = 0 AS changed, batch = 'moved' AS refused FROM supplier, (VALUES ('checked'), ('moved')) b(batch)")
def j26_review_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of corrections that fits, and one with a single place that has moved, which is refused whole."""
    s = table(spark, sf_dir, "supplier").withColumn("x", F.col("s_nationkey") * 2.0)
    led = s.where("s_suppkey % 10 = 0").select("s_suppkey", F.col("s_acctbal").alias("before"), (F.col("s_acctbal") + 1).alias("after"), "x")
    moved = led.withColumn("x", F.when(F.col("s_suppkey") == 0, F.col("x") + 0.5).otherwise(F.col("x")))
    out = [op.reviewed(s, b, "s_suppkey", "s_acctbal", ["x"]).withColumn("batch", F.lit(n)) for n, b in (("checked", led), ("moved", moved))]
    return out[0].unionByName(out[1])


@query(f"WITH {RUNS}, a AS (SELECT root, sum(score) AS s FROM runs GROUP BY root), b AS (SELECT root, sum(CASE WHEN root % 9 = 0 THEN score + 1 ELSE score END) AS s FROM runs GROUP BY root) SELECT root, round(b.s - a.s, 6) AS delta FROM a FULL JOIN b USING (root)")
def j27_rerun_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir)
    a = r.groupBy("root").agg(F.sum("score").alias("a"))
    b = r.groupBy("root").agg(F.sum(F.when(F.col("root") % 9 == 0, F.col("score") + 1).otherwise(F.col("score"))).alias("b"))
    return a.join(b, "root", "full").select("root", F.round(F.col("b") - F.col("a"), 6).alias("delta"))


@query("WITH r AS (SELECT s_suppkey AS id, s_acctbal AS v, CASE s_suppkey % 4 WHEN 0 THEN 'annotation_corrected' WHEN 1 THEN 'patch_issue' WHEN 2 THEN 'no_issue' ELSE 'uncertain' END AS status, s_acctbal + (s_suppkey % 4 = 0 OR s_suppkey % 31 = 1)::INTEGER AS w FROM supplier) SELECT status, count(*) AS n, count(*) FILTER ((w <> v) <> (status = 'annotation_corrected')) AS violations FROM r GROUP BY status")
def j28_review_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value must change exactly where the decision says that it was corrected."""
    k = F.col("s_suppkey")
    status = F.when(k % 4 == 0, "annotation_corrected").when(k % 4 == 1, "patch_issue").when(k % 4 == 2, "no_issue").otherwise("uncertain")
    changed = (k % 4 == 0) | (k % 31 == 1)
    return table(spark, sf_dir, "supplier").groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.count_if(changed != (status == "annotation_corrected")).alias("violations"))


@query("WITH t AS (SELECT l_suppkey AS a, l_partkey AS b, count(*) % 5 AS d FROM lineitem GROUP BY ALL), c AS (SELECT b AS a, a AS b, d + (a % 2) AS d FROM t), s AS (SELECT a, b, d FROM t UNION ALL SELECT b, a, -d FROM t) SELECT c.d - s.d AS residual, count(*) AS n FROM c JOIN s ON c.a = s.a AND c.b = s.b GROUP BY ALL")
def j30_symmetric_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")).agg((F.count("*") % 5).alias("d"))
    c = t.select(F.col("b").alias("a"), F.col("a").alias("b"), (F.col("d") + F.col("a") % 2).alias("claimed"))
    s = t.unionByName(t.select(F.col("b").alias("a"), F.col("a").alias("b"), (-F.col("d")).alias("d")))
    return c.join(s, ["a", "b"]).groupBy((F.col("claimed") - F.col("d")).alias("residual")).agg(F.count("*").alias("n"))


@query("WITH s AS (SELECT c_custkey AS id, md5(c_name) AS h1, c_nationkey AS h2 FROM customer), r AS (SELECT o_custkey AS id, md5('Customer#' || lpad(o_custkey::VARCHAR, 9, '0')) AS h1, (o_custkey % 25)::INTEGER AS h2, o_totalprice AS v FROM orders) SELECT r.id, count(*) AS results, bool_and(s.id IS NOT NULL) AS rank_eligible FROM r LEFT JOIN s ON r.id = s.id AND r.h1 = s.h1 AND r.h2 = s.h2 GROUP BY r.id")
def j31_spec_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.md5("c_name").alias("h1"), F.col("c_nationkey").alias("h2"), F.lit(True).alias("ok"))
    k = F.col("o_custkey")
    r = table(spark, sf_dir, "orders").select(k.alias("id"), F.md5(F.concat(F.lit("Customer#"), F.lpad(k.cast("string"), 9, "0"))).alias("h1"), (k % 25).cast("int").alias("h2"))
    return r.join(s, ["id", "h1", "h2"], "left").groupBy("id").agg(F.count("*").alias("results"), F.bool_and(F.col("ok").isNotNull()).alias("rank_eligible"))


@query("SELECT d, count(*) AS n FROM (SELECT o_orderkey, arg_min(d, round(abs((o_totalprice % 1000) - 500 - 200 * d), 6) * 1000 + abs(d) * 10 + d) AS d FROM orders, (SELECT unnest(range(-2, 3))::INTEGER AS d) GROUP BY o_orderkey) GROUP BY d")
def j32_winding_neighbour(spark: SparkSession, sf_dir: str) -> DataFrame:
    far = lambda d: F.round(F.abs((F.col("o_totalprice") % 1000) - 500 - 200 * d), 6)
    best = F.array_min(F.array(*[F.struct(far(d).alias("f"), F.lit(abs(d)).alias("a"), F.lit(d).alias("d")) for d in range(-2, 3)]))
    return table(spark, sf_dir, "orders").select(best["d"].alias("d")).groupBy("d").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def j33_leave_group_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.join(o.where("o_orderpriority = '1-URGENT'").select("o_custkey"), "o_custkey", "left_anti").select("o_orderkey", "o_custkey")


@query(f"WITH {VOXELS}, a AS (SELECT volume, chunk, y, x FROM voxels WHERE z = 1), o AS (SELECT a.volume, a.chunk, a.y, a.x, v.z - 1 AS off FROM a JOIN voxels v USING (volume, chunk, y, x) WHERE v.v > 150 AND v.ct > 0) SELECT a.volume, a.chunk, a.y, a.x, arg_min(off, abs(off) * 10 + off) AS nearest FROM a LEFT JOIN o USING (volume, chunk, y, x) GROUP BY ALL")
def j35_nearest_supported_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, k = voxels(spark, sf_dir), ["volume", "chunk", "y", "x"]
    o = v.where("v > 150 AND ct > 0").select(*k, (F.col("z") - 1).alias("off"))
    g = v.where("z = 1").select(*k).join(o, k, "left").groupBy(*k).agg(F.min(F.when(F.col("off").isNotNull(), F.struct(F.abs("off").alias("a"), "off"))).alias("b"))
    return g.select(*k, F.col("b.off").alias("nearest"))


@query("WITH n AS (SELECT l_suppkey AS s, count(*) AS n FROM lineitem GROUP BY ALL) SELECT s_suppkey, s_acctbal, coalesce(n, 0) AS items FROM supplier LEFT JOIN n ON s = s_suppkey")
def j01_coverage_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts join the scores; an empty right side would be an error, not zeros."""
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    if n.isEmpty():
        raise ValueError("no counts to join")
    return table(spark, sf_dir, "supplier").join(n, "s_suppkey", "left").select("s_suppkey", "s_acctbal", F.coalesce("n", F.lit(0)).alias("items"))


@query("WITH m AS (SELECT DISTINCT l_suppkey AS m, l_partkey AS u FROM lineitem), z AS (SELECT m, count(*) AS n FROM m GROUP BY m), c AS (SELECT a.m AS a, b.m AS b, count(*) AS common FROM m a JOIN m b ON a.u = b.u AND a.m < b.m GROUP BY ALL) SELECT a, b, common, round(common / least(za.n, zb.n), 6) AS overlap, round(common / (za.n + zb.n - common), 6) AS jaccard FROM c JOIN z za ON za.m = a JOIN z zb ON zb.m = b")
def a57_training_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(op.overlap_audit(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey"))


@query("""WITH m AS (SELECT DISTINCT p_size % 5 AS g, l_suppkey % 9 AS m, l_partkey AS u FROM lineitem JOIN part ON p_partkey = l_partkey WHERE NOT (p_size % 5 = 1 AND l_partkey % 9 = l_suppkey % 9) AND NOT (p_size % 5 = 2 AND l_partkey % 9 <> l_suppkey % 9)),
k AS (SELECT g, u, count(*) AS k FROM m GROUP BY ALL), z AS (SELECT g, max(n) AS size FROM (SELECT g, m, count(*) AS n FROM m GROUP BY ALL) GROUP BY g), n AS (SELECT g, count(DISTINCT m) AS members FROM m GROUP BY g), u AS (SELECT g, count(*) AS units, min(k) AS least, max(k) AS most FROM k GROUP BY g)
SELECT g, members, units, CASE WHEN least = members THEN 'identical_full_set' WHEN most = 1 THEN 'disjoint_subsets' WHEN least >= members - 1 AND size < units THEN 'cv_partition' ELSE 'partial_overlap' END AS regime FROM n JOIN u USING (g) JOIN z USING (g)""")
def a57_overlap_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ensembles of nine members by the size class of parts; in class 1 a member lacks the parts of its own number, in class 2 it has only these."""
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select((F.col("p_size") % 5).alias("g"), (F.col("l_suppkey") % 9).alias("m"), F.col("l_partkey").alias("u"))
    own = F.col("u") % 9 == F.col("m")
    return op.overlap_regime(li.where(~((F.col("g") == 1) & own) & ~((F.col("g") == 2) & ~own)), ["g"], "m", "u")


_CHARS = "ch AS (SELECT conv_id, turn, CASE WHEN regexp_matches(c, '[A-Za-z]') THEN 'legible' WHEN regexp_matches(c, '[0-9]') THEN 'illegible' ELSE 'lost' END AS status FROM (SELECT conv_id, turn, unnest(string_split(text, '')) AS c FROM conversations))"


def _chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.split("text", "")).alias("c")).where("c <> ''")
    return c.select("conv_id", "turn", F.when(F.col("c").rlike("[A-Za-z]"), "legible").when(F.col("c").rlike("[0-9]"), "illegible").otherwise("lost").alias("status"))


@query(f"WITH {_CHARS} SELECT conv_id, turn, count(*) FILTER (status = 'legible') AS legible, count(*) FILTER (status = 'illegible') AS illegible, count(*) FILTER (status = 'lost') AS lost, grouping_id(conv_id, turn)::BIGINT AS level, round(count(*) FILTER (status = 'legible') / nullif(count(*) FILTER (status IN ('legible', 'illegible')), 0), 6) AS share FROM ch GROUP BY ROLLUP (conv_id, turn)")
def a58_legibility_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(op.legibility(_chars(spark, sf_dir), "conv_id", "turn", "status"))


@query(f"WITH {_CHARS}, c AS (SELECT conv_id, count(*) FILTER (status = 'legible') AS legible, count(*) AS preserved FROM ch GROUP BY conv_id), n AS (SELECT *, ceil(0.8::DOUBLE * preserved - 1e-9)::BIGINT AS needed FROM c) SELECT *, legible - needed AS margin, CASE WHEN legible < needed THEN 'rescue' WHEN legible - needed <= 1 THEN 'fragile' ELSE 'secure' END AS queue FROM n")
def t02_threshold_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _chars(spark, sf_dir).groupBy("conv_id").agg(F.count_if(F.col("status") == "legible").alias("legible"), F.count("*").alias("preserved"))
    return op.threshold_queues(c, "conv_id", "legible", "preserved", 0.8)


@query("SELECT c_nationkey, round(sum(abs(c_acctbal)), 4) AS declared, round(sum(CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 0 END), 4) AS unrolled, round(sum(CASE WHEN c_acctbal <= 0 THEN -c_acctbal ELSE 0 END), 4) AS excluded, abs(sum(abs(c_acctbal)) - sum(CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 0 END) - sum(CASE WHEN c_acctbal <= 0 THEN -c_acctbal ELSE 0 END)) < 0.01 AS balanced FROM customer GROUP BY c_nationkey")
def a59_area_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("c_acctbal")
    g = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.sum(F.abs(b)).alias("declared"), F.sum(F.when(b > 0, b).otherwise(0.0)).alias("unrolled"), F.sum(F.when(b <= 0, -b).otherwise(0.0)).alias("excluded"))
    g = g.withColumn("balanced", F.abs(F.col("declared") - F.col("unrolled") - F.col("excluded")) < 0.01)
    return g.select("c_nationkey", *[F.round(c, 4).alias(c) for c in ("declared", "unrolled", "excluded")], "balanced")


@query("WITH e AS (SELECT user_id, (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts)) / 3.6e9 AS h FROM events) SELECT user_id, round(sum(h), 5) AS total, round(600 - sum(h), 5) AS remaining, sum(h) <= 600 AS within FROM e GROUP BY user_id")
def a60_hours_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    nxt = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = table(spark, sf_dir, "events").select("user_id", "ts", nxt.alias("te")).select("user_id", fn.hours_between(F.col("ts"), F.col("te")).alias("h"))
    return e.groupBy("user_id").agg(F.round(F.sum("h"), 5).alias("total"), F.round(600 - F.sum("h"), 5).alias("remaining"), (F.sum("h") <= 600).alias("within"))


@query("WITH c AS (SELECT DISTINCT event_type AS term FROM events WHERE event_type <> 'view'), e AS (SELECT event_type AS term, count(*) AS evaluations, avg((value > 1)::INTEGER) AS active FROM events WHERE event_type <> 'error' GROUP BY ALL) SELECT coalesce(c.term, e.term) AS term, evaluations, round(active, 6) AS active, concat_ws(',', CASE WHEN c.term IS NULL THEN 'undeclared' END, CASE WHEN e.term IS NULL THEN 'never_evaluated' END, CASE WHEN active < 0.5 THEN 'mostly_zero' END) AS failures FROM c FULL JOIN e ON c.term = e.term")
def a61_activation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").withColumnRenamed("event_type", "term")
    c = ev.where("term <> 'view'").select("term").distinct().withColumn("c", F.lit(True))
    e = ev.where("term <> 'error'").groupBy("term").agg(F.count("*").alias("evaluations"), F.avg((F.col("value") > 1).cast("double")).alias("active"))
    j = c.join(e, "term", "full")
    return j.select("term", "evaluations", F.round("active", 6).alias("active"), F.concat_ws(",", F.when(F.col("c").isNull(), "undeclared"), F.when(F.col("evaluations").isNull(), "never_evaluated"), F.when(F.col("active") < 0.5, "mostly_zero")).alias("failures"))


@query("WITH o AS (SELECT l_partkey AS id, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY ALL) SELECT p_partkey AS id, lo, hi, CASE WHEN lo IS NULL THEN 'unverified' WHEN lo < 1 OR hi > p_size + 30 THEN 'exceeds' WHEN hi < p_size THEN 'stale' ELSE 'ok' END AS status, greatest(hi - (p_size + 30), 0) AS excess FROM part LEFT JOIN o ON id = p_partkey")
def a07_declared_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))
    j = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size").join(o, "id", "left")
    status = F.when(F.col("lo").isNull(), "unverified").when((F.col("lo") < 1) | (F.col("hi") > F.col("p_size") + 30), "exceeds").when(F.col("hi") < F.col("p_size"), "stale").otherwise("ok")
    return j.select("id", "lo", "hi", status.alias("status"), F.when(F.col("hi").isNull(), 0.0).otherwise(F.greatest(F.col("hi") - (F.col("p_size") + 30), F.lit(0.0))).alias("excess"))


@query("WITH t AS (SELECT l_suppkey % 7 AS producer, l_quantity - 25 - (l_linenumber - 4) AS r FROM lineitem) SELECT producer, count(*) AS n, round(avg((r = 0)::INTEGER), 6) AS exact, round(avg((abs(r) <= 1)::INTEGER), 6) AS within_one, round(avg(abs(r)), 6) AS mean_abs, median(abs(r)) AS median_abs FROM t GROUP BY producer")
def a39_producer_gauge(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.abs(F.col("l_quantity") - 25 - (F.col("l_linenumber") - 4))
    g = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 7).alias("producer"))
    return _rounded(g.agg(F.count("*").alias("n"), F.avg((r == 0).cast("double")).alias("exact"), F.avg((r <= 1).cast("double")).alias("within_one"), F.avg(r).alias("mean_abs"), F.median(r).alias("median_abs")))


@query(f"""WITH {TRACE}, n AS (SELECT trace_id, count(*) AS n FROM trace GROUP BY ALL), p AS (SELECT t.trace_id, ord, x + CASE WHEN ord = n // 2 THEN 1000 ELSE 0 END AS x, y, z, ord = n // 2 + 1 OR ord = n // 2 AS hit FROM trace t JOIN n USING (trace_id)), s AS (SELECT *, sqrt((x - lag(x) OVER w) ^ 2 + (y - lag(y) OVER w) ^ 2 + (z - lag(z) OVER w) ^ 2) AS step FROM p WINDOW w AS (PARTITION BY trace_id ORDER BY ord)), m AS (SELECT trace_id, median(step) FILTER (step > 0) AS mid FROM s GROUP BY ALL)
SELECT trace_id, bool_or(step > 5 * mid) AS detected, bool_or(step > 5 * mid AND hit) AS localised FROM s JOIN m USING (trace_id) GROUP BY trace_id""")
def n01_planted_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One displaced point per trace, all traces as trials of one audit."""
    t = trace(spark, sf_dir).select("trace_id", F.col("ord").alias("id"), "ord", "x", "y", "z")
    trials = t.groupBy("trace_id").agg(F.floor(F.count("*") / 2).cast("int").alias("hit"), F.lit(1000.0).alias("delta"))
    steps = spatial.trace_steps(op.planted(t, trials, "trace_id", "x"), "trace_id", "ord", ["x", "y", "z"], 5.0, 90.0).join(trials, "trace_id")
    near = (F.col("ord") == F.col("hit")) | (F.col("ord") == F.col("hit") + 1)
    return steps.groupBy("trace_id").agg(F.bool_or("is_gap").alias("detected"), F.bool_or(F.col("is_gap") & near).alias("localised"))


@query("SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, string_split(regexp_replace(url, '^[a-z]+://', ''), '/')[1] AS host, lower(regexp_replace(regexp_extract(url, '[^/]*$'), '[^A-Za-z0-9]', '', 'g')) AS stem FROM pages")
def f01_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(u, "^([a-z]+)://", 1).alias("scheme"), F.split(F.regexp_replace(u, "^[a-z]+://", ""), "/")[0].alias("host"), F.lower(F.regexp_replace(F.regexp_extract(u, "[^/]*$", 0), "[^A-Za-z0-9]", "")).alias("stem"))


@query("SELECT page_id, regexp_matches(sha256(url), '^[0-9a-f]{64}$') AS digest, regexp_matches(url, '^https?://[^\\s/]+') AS public, length(url) > 0 AND NOT starts_with(url, '/') AND NOT contains(url, '..') AND NOT contains(url, chr(92)) AS relative FROM pages")
def f02_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", fn.is_sha256(F.sha2(u, 256)).alias("digest"), fn.is_public_url(u).alias("public"), fn.is_relative_path(u).alias("relative"))


@query("SELECT event_id, NOT isnan(v) AND NOT isinf(v) AS finite FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 7 = 0 THEN 'Infinity'::DOUBLE ELSE value END AS v FROM events)")
def f03_finite(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("event_id") % 5 == 0, float("nan")).when(F.col("event_id") % 7 == 0, float("inf")).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", fn.finite(v).alias("finite"))


@query(f"SELECT p_partkey, sha256('{{\"brand\":\"' || p_brand || '\",\"size\":' || p_size || '}}') AS sha, {_draw(chr(39) + 'seed' + chr(39), 'p_partkey', 'p_brand')} AS draw FROM part")
def f04_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 of canonical JSON (keys sorted), and a draw from the digest of parts."""
    doc = F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")))
    return table(spark, sf_dir, "part").select("p_partkey", F.sha2(doc, 256).alias("sha"), fn.hash_draw("seed", F.col("p_partkey"), F.col("p_brand")).alias("draw"))


@query("SELECT event_id, epoch_us(ts) AS us, strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' AS iso, true AS strict FROM events")
def f05_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return table(spark, sf_dir, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), iso.alias("iso"), fn.strict_utc(iso).isNotNull().alias("strict"))


@query(f"WITH {POINTS} SELECT id, least(theta % 360, 360 - theta % 360) AS from_zero, least((theta + 90) % 180, 180 - (theta + 90) % 180) AS axial, round(x / nullif(r, 0), 6) AS c FROM points")
def f06_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("theta")
    return points(spark, sf_dir).select("id", fn.angle_distance(t, F.lit(0.0)).alias("from_zero"), fn.angle_distance(t, F.lit(90.0), 180.0).alias("axial"), F.round(fn.ratio(F.col("x"), F.col("r")), 6).alias("c"))


@query(f"WITH {POINTS} SELECT id, round(sqrt(x * x + y * y), 6) AS rho, round(y * 2 - z * 1, 6) AS cx, round(z * 3 - x * 2, 6) AS cy, round(x * 1 - y * 3, 6) AS cz FROM points")
def f07_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    c = fn.cross([x, y, z], [F.lit(3.0), F.lit(1.0), F.lit(2.0)])
    return points(spark, sf_dir).select("id", F.round(fn.norm([x, y]), 6).alias("rho"), *[F.round(v, 6).alias(n) for n, v in zip(("cx", "cy", "cz"), c, strict=True)])


@query("SELECT event_id, least(50, greatest(5, value)) AS clamped, round(value / nullif(event_id % 4, 0), 6) AS safe, round_even(value, 1) AS half_even, round(log10(CASE WHEN value > 0 THEN value END), 6) AS lg FROM events")
def f08_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", fn.clamp(v, 5.0, 50.0).alias("clamped"), F.round(fn.ratio(v, (F.col("event_id") % 4).cast("double")), 6).alias("safe"), F.bround(v, 1).alias("half_even"), F.round(F.log10(v), 6).alias("lg"))


@query("SELECT vec_id, len(list_filter(embedding, lambda x: x > 0)) AS positive, list_max(embedding) > list_min(embedding) AS increasing, true AS all_finite FROM embeddings")
def f09_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(F.filter(e, lambda x: x > 0)).cast("long").alias("positive"), (F.array_max(e) > F.array_min(e)).alias("increasing"), F.forall(e, lambda x: fn.finite(x)).alias("all_finite"))


@query("SELECT o_custkey, count(*) AS queued, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_totalprice DESC, o_orderkey) AS items, sha256(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_totalprice DESC, o_orderkey)) AS digest FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey")
def s16_review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings nested by target in a full order, with the digest of what was queued."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.count("*").alias("queued"), F.sort_array(F.collect_list(F.struct((-F.col("o_totalprice")).alias("p"), "o_orderkey"))).alias("x"))
    items = F.array_join(F.transform("x", lambda r: r["o_orderkey"].cast("string")), ",")
    return o.select("o_custkey", "queued", items.alias("items"), F.sha2(items, 256).alias("digest"))
