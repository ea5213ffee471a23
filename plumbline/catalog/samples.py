"""Samples, splits, quotas, sets, ranks and agreement of runs."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.catalog.fixtures import RUNS, runs, table
from plumbline.catalog.registry import query
from plumbline.catalog.voxels import _rounded
from plumbline.functions import numeric as fn
from plumbline.operators import sampling as op


def _draw(*parts: str) -> str:
    return f"('0x' || substr(sha256({' || \'|\' || '.join(parts)}), 1, 8))::BIGINT"


@query("""WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), i AS (SELECT user_id, n, CASE WHEN n <= 7 THEN range(0, n) ELSE list_distinct(list_transform(range(0, 7), lambda i: round_even(i * (n - 1) / 6.0::DOUBLE, 0)::BIGINT)) END AS l FROM n)
SELECT user_id, n, unnest(l)::INTEGER AS place FROM i""")
def p01_even_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return n.select("user_id", "n", F.explode(op.even_spread(F.col("n"), 7)).alias("place"))


_INV = "(" + " + ".join("(floor({c} / {b} ** %d)::BIGINT %% {b}) / ({b}::DOUBLE ** %d)" % (k, k + 1) for k in range(12)) + ")"


@query(f"WITH r AS (SELECT p_partkey, round({_INV.format(c='p_partkey', b=2)}, 9) AS i2, round({_INV.format(c='p_partkey', b=3)}, 9) AS i3, round({_INV.format(c='p_partkey', b=5)}, 9) AS i5 FROM part) SELECT *, row_number() OVER (ORDER BY i2, i3, i5, p_partkey) AS place FROM r")
def p02_low_discrepancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    df = table(spark, sf_dir, "part").select("p_partkey", *[F.round(fn.radical_inverse(k, b), 9).alias(f"i{b}") for b in (2, 3, 5)])
    return op.global_rank(df, ["i2", "i3", "i5", "p_partkey"], "place")


@query("SELECT o_orderkey, o_custkey, ((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 - 3 + 30 * count(*) OVER (PARTITION BY o_custkey)) % count(*) OVER (PARTITION BY o_custkey))::BIGINT AS rotated FROM orders")
def p03_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.rotated(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"], "o_orderkey", 3)


@query(f"WITH o AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k FROM orders) SELECT o_orderkey, o_custkey, k // 4 AS block, (k + {_draw(chr(39) + 'part' + chr(39), 'o_custkey', '(k // 4)')}) % 4 AS part FROM o")
def p04_split_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.split_parts(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"], "o_orderkey", 4)


@query("""WITH e AS (SELECT o_orderkey, o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS e FROM orders), t AS (SELECT o_orderkey, o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INTEGER AS taken FROM e WHERE e <= 2)
SELECT *, count(*) OVER (PARTITION BY o_custkey) = 5 AS complete FROM t WHERE taken <= 5""")
def p05_budgeted_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.budgeted(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_custkey"], "o_orderstatus", ["o_orderkey"], 5, 2)


@query(f"SELECT p_partkey, p_brand FROM part ORDER BY {_draw(chr(39) + 'seed1' + chr(39), 'p_partkey')}, p_partkey LIMIT 100")
def p06_seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.seeded_sample(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey", "seed1", 100)


_ALLOC = """c AS (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY ALL), x AS (SELECT *, n * 101.0::DOUBLE / sum(n) OVER () AS exact FROM c), f AS (SELECT *, floor(exact) AS fl FROM x),
q AS (SELECT c_mktsegment, n, least(n, greatest(1, fl + (row_number() OVER (ORDER BY round(fl - exact, 9), c_mktsegment) <= 101 - sum(fl) OVER ())::INTEGER))::BIGINT AS quota FROM f)"""


def _quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.allocation(table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n")), "c_mktsegment", "n", 101)


@query(f"WITH {_ALLOC} SELECT * FROM q")
def p07_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quotas(spark, sf_dir)


@query(f"WITH {_ALLOC}, d AS (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_draw(chr(39) + 's' + chr(39), 'c_custkey')}, c_custkey)::INTEGER AS draw FROM customer) SELECT d.*, quota FROM d JOIN q USING (c_mktsegment) WHERE draw <= quota")
def p07_stratified_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.stratified(table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey"), _quotas(spark, sf_dir), "c_mktsegment", "c_custkey", "s")


@query("""WITH o AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, event_id, place FROM o WHERE n <= 9 OR place IN (SELECT unnest(list_transform(range(0, 9), lambda i: ((2 * i + 1) * n) // 18)))""")
def p08_midpoint_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.midpoint_ranks(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"], 9).select("user_id", "event_id", F.col("place").cast("long").alias("place"))


@query("""WITH o AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, event_id, place FROM o WHERE n <= 11 OR list_contains(list_transform(range(0, 11), lambda i: round_even(i * (n - 1) / 10.0::DOUBLE, 0)::BIGINT), place)""")
def p09_linspace_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = op.ordinal(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"])
    n = e.groupBy("user_id").agg(F.count("*").alias("n"))
    at = n.select("user_id", F.explode(op.even_spread(F.col("n"), 11)).alias("place"))
    return e.withColumn("place", F.col("ord") - 1).join(at, ["user_id", "place"]).select("user_id", "event_id", F.col("place").cast("long").alias("place"))


@query("SELECT o_orderkey // 100 AS row, o_orderkey % 100 AS col FROM orders WHERE (o_orderkey // 100) >= 2 AND (o_orderkey % 100) >= 2 AND (o_orderkey // 100 - 2) % 7 = 0 AND (o_orderkey % 100 - 2) % 7 = 0")
def p10_strided_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    row, col = F.expr("o_orderkey div 100"), F.col("o_orderkey") % 100
    o = table(spark, sf_dir, "orders").select(row.alias("row"), col.alias("col"))
    return o.where((F.col("row") >= 2) & (F.col("col") >= 2) & ((F.col("row") - 2) % 7 == 0) & ((F.col("col") - 2) % 7 == 0))


@query("""WITH l AS (SELECT l_partkey, l_suppkey, l_returnflag <> 'R' AS ok, max(l_extendedprice) AS score FROM lineitem GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY ok DESC, score DESC NULLS LAST) AS k FROM l),
w AS (SELECT p_partkey AS l_partkey, p_partkey % 100 AS l_suppkey FROM part) SELECT w.l_partkey, w.l_suppkey, ok, CASE WHEN ok THEN score END AS score, CASE WHEN ok IS NULL THEN 'no row of this identity' WHEN NOT ok THEN 'not usable' ELSE 'matched' END AS reason
FROM w LEFT JOIN (SELECT * FROM b WHERE k = 1) USING (l_partkey, l_suppkey)""")
def p14_exact_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey", (F.col("l_returnflag") != "R").alias("ok")).agg(F.max("l_extendedprice").alias("score"))
    wanted = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_partkey") % 100).alias("l_suppkey"))
    return op.best_match(wanted, rows, ["l_partkey", "l_suppkey"], "ok", "score")


@query("""SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 3 = 0 THEN p_size / 255.0::DOUBLE WHEN p_size % 3 = 1 THEN p_size / 65535.0::DOUBLE ELSE p_size::DOUBLE END AS p, CASE p_size % 4 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN true END AS label FROM part""")
def p16_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared scale decides the divisor; values out of the domain have none. Labels 0, 1 and 255 only."""
    s = F.col("p_size")
    code = F.element_at(F.array(F.lit(0), F.lit(1), F.lit(255), F.lit(9)), (s % 4 + 1).cast("int"))
    p = F.when(s % 7 == 0, None).when(s % 3 == 0, s / 255.0).when(s % 3 == 1, s / 65535.0).otherwise(s.cast("double"))
    return table(spark, sf_dir, "part").select("p_partkey", p.alias("p"), F.when(code == 0, False).when(code.isin(1, 255), True).alias("label"))


@query("""WITH p AS (SELECT a.s_suppkey AS a, b.s_suppkey AS b, least(abs(a.s_acctbal), abs(b.s_acctbal)) / nullif(greatest(abs(a.s_acctbal), abs(b.s_acctbal)), 0) AS r FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey)
SELECT a, b, round(r, 6) AS ratio, coalesce(r >= 0.5, false) AS included, CASE WHEN r IS NULL THEN 'unknown' WHEN r < 0.5 THEN 'ratio' ELSE 'ok' END AS code FROM p""")
def p17_pair_inclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", F.abs("s_acctbal").alias("v"))
    p = op.pairs_within(s, "s_nationkey", "s_suppkey")
    r = fn.ratio(F.least("v1", "v2"), F.greatest("v1", "v2"))
    return p.select(F.col("s_suppkey1").alias("a"), F.col("s_suppkey2").alias("b"), F.round(r, 6).alias("ratio"), F.coalesce(r >= 0.5, F.lit(False)).alias("included"), F.when(r.isNull(), "unknown").when(r < 0.5, "ratio").otherwise("ok").alias("code"))


@query("SELECT p_type, arg_min(p_size, round(abs(ln(p_size / 12.0::DOUBLE)), 9) * 1000 + p_size / 1000.0) AS level FROM part GROUP BY p_type")
def p18_nearest_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    far = F.round(F.abs(F.ln(F.col("p_size") / 12.0)), 9)
    return table(spark, sf_dir, "part").groupBy("p_type").agg(F.min_by("p_size", F.struct(far, F.col("p_size"))).alias("level"))


@query(f"""WITH s AS (SELECT user_id, {_draw("'shift'", 'user_id')} % 5 AS dy, {_draw("'shift2'", 'user_id')} % 7 AS dx FROM (SELECT DISTINCT user_id FROM events)),
c AS (SELECT user_id, event_id % 5 AS row, event_id % 7 AS col, count(*) AS label FROM events GROUP BY ALL) SELECT user_id, (row + dy) % 5 AS row, (col + dx) % 7 AS col, label FROM c JOIN s USING (user_id)""")
def p24_label_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "events").groupBy("user_id", (F.col("event_id") % 5).alias("r"), (F.col("event_id") % 7).alias("c")).agg(F.count("*").alias("label"))
    return c.select("user_id", F.pmod(F.col("r") + fn.hash_draw("shift", F.col("user_id")) % 5, F.lit(5)).alias("row"), F.pmod(F.col("c") + fn.hash_draw("shift2", F.col("user_id")) % 7, F.lit(7)).alias("col"), "label")


@query("WITH a AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS i FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS i FROM lineitem WHERE l_returnflag = 'N'), f AS (SELECT coalesce(a.k, b.k) AS l_suppkey, a.i AS ai, b.i AS bi FROM a FULL JOIN b ON a.k = b.k AND a.i = b.i) SELECT l_suppkey, count(ai) AS n_a, count(bi) AS n_b, count(*) FILTER (ai = bi) AS common, round(count(*) FILTER (ai = bi) / count(*), 6) AS jaccard, count(*) FILTER (ai = bi) = 0 AS disjoint FROM f GROUP BY l_suppkey")
def u01_jaccard_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return _rounded(op.jaccard(li.where("l_returnflag = 'A'"), li.where("l_returnflag = 'N'"), "l_suppkey", "l_partkey"))


@query("SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'A' AND (l_suppkey, l_partkey) NOT IN (SELECT (l_suppkey, l_partkey) FROM lineitem WHERE l_returnflag = 'R')")
def u02_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    k = ["l_suppkey", "l_partkey"]
    return li.where("l_returnflag = 'A'").select(*k).distinct().join(li.where("l_returnflag = 'R'").select(*k), k, "left_anti")


@query("WITH s AS (SELECT l_partkey, count(DISTINCT l_returnflag || l_linestatus) AS \"in\" FROM lineitem GROUP BY ALL) SELECT l_partkey, \"in\", CASE WHEN \"in\" = (SELECT count(DISTINCT l_returnflag || l_linestatus) FROM lineitem) THEN 'robust' ELSE 'unstable' END AS status FROM s")
def u03_robust_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.robust_members(table(spark, sf_dir, "lineitem").withColumn("view", F.concat("l_returnflag", "l_linestatus")), "view", "l_partkey")


@query("WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT c_custkey AS k FROM customer), f AS (SELECT a.k AS a, b.k AS b FROM a FULL JOIN b ON a.k = b.k), c AS (SELECT count(*) FILTER (b IS NULL) AS only_a, count(*) FILTER (a IS NULL) AS only_b, count(*) FILTER (a = b) AS common FROM f) SELECT *, only_a = 0 AND only_b = 0 AS equal, common = 0 AS disjoint, only_a = 0 AS contained FROM c")
def u04_set_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.set_checks(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), "k")


@query("SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_linestatus = 'O' EXCEPT SELECT l_suppkey, l_partkey FROM lineitem WHERE l_linestatus = 'F'")
def u05_new_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.where("l_linestatus = 'O'").select("l_suppkey", "l_partkey").subtract(li.where("l_linestatus = 'F'").select("l_suppkey", "l_partkey"))


@query("SELECT c_custkey AS id, c_acctbal AS balance, 'customer' AS role, NULL::VARCHAR AS brand FROM customer UNION ALL SELECT s_suppkey, s_acctbal, 'supplier', NULL FROM supplier UNION ALL SELECT p_partkey, NULL, 'part', p_brand FROM part")
def u06_multi_source_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.lit("customer").alias("role"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"), F.lit("supplier").alias("role"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit("part").alias("role"), F.col("p_brand").alias("brand"))
    return c.unionByName(s).unionByName(p, allowMissingColumns=True)


@query("SELECT id, y, score, rank() OVER (PARTITION BY grp ORDER BY score) + (count(*) OVER (PARTITION BY grp, score) - 1) / 2.0::DOUBLE AS rank FROM (SELECT doc_id AS id, quality AS y, ((n_chars % 1000) / 1000.0)::DOUBLE AS score, lang AS grp FROM documents JOIN labels USING (doc_id))")
def w01_average_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("doc_id").alias("id"), F.col("quality").alias("y"), ((F.col("n_chars") % 1000) / 1000.0).alias("score"), F.col("lang").alias("grp"))
    return op.average_rank(d, ["grp"], "score").drop("grp")


@query("WITH t AS (SELECT p_partkey, 'a' AS m, p_retailprice AS v FROM part UNION ALL SELECT p_partkey, 'b', p_size FROM part UNION ALL SELECT p_partkey, 'c', (p_partkey * 7919) % 1000 FROM part), r AS (SELECT p_partkey, row_number() OVER (PARTITION BY m ORDER BY v DESC, p_partkey) AS k FROM t) SELECT p_partkey, min(k)::INTEGER AS best, max(k)::INTEGER AS worst FROM r GROUP BY ALL")
def w02_rank_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("a"), F.col("p_size").alias("b"), ((F.col("p_partkey") * 7919) % 1000).alias("c"))
    return op.rank_bands(p, "p_partkey", ["a", "b", "c"])


@query("""WITH r AS (SELECT l_returnflag, l_quantity AS a, l_extendedprice AS b, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 AS rb FROM lineitem)
SELECT l_returnflag, count(*) AS n, round(corr(ra, rb), 6) AS spearman, round(corr(a, b), 6) AS pearson FROM r GROUP BY l_returnflag""")
def a35_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(op.correlations(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice"), ["l_returnflag"], "l_quantity", "l_extendedprice"))


@query(f"""WITH {RUNS}, b AS (SELECT a.root, a.score AS a, b.score AS b FROM runs a JOIN runs b ON a.root = b.root AND a.run = 'A' AND b.run = 'N'), t AS (SELECT *, row_number() OVER (ORDER BY a DESC, root) <= 10 AS ta, row_number() OVER (ORDER BY b DESC, root) <= 10 AS tb FROM b)
SELECT count(*) AS n, round(avg(abs(b - a)), 6) AS mean_abs, round(avg(b - a), 6) AS shift, round(stddev_samp(b - a), 6) AS shift_sd, count(*) FILTER (ta AND tb) AS top_common, round(corr(a, b), 6) AS pearson, CASE WHEN count(*) < 3 THEN 'INSUFFICIENT' WHEN avg(abs(b - a)) <= 2 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM t""")
def a36_stability_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(op.stability(runs(spark, sf_dir), "root", "run", "score", "A", "N"))


@query(f"WITH {RUNS} SELECT root, round(avg(score), 6) AS score, sum(decoded)::BIGINT AS decoded FROM runs WHERE run IN ('A', 'R') GROUP BY root HAVING count(*) = 2")
def a37_pooled_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir).where(F.col("run").isin("A", "R")).groupBy("root").agg(F.avg("score").alias("score"), F.sum("decoded").alias("decoded"), F.count("*").alias("n"))
    return _rounded(r.where("n = 2").drop("n"))


@query("""WITH v AS (SELECT l_suppkey, avg(l_quantity) AS score, stddev_pop(l_quantity) AS spread, count(*) AS n FROM lineitem GROUP BY l_suppkey), p AS (SELECT greatest(0, var_samp(score) - avg(spread ^ 2 / n)) AS between, avg(spread ^ 2) AS within FROM v)
SELECT round(between, 6) AS between, round(within, 6) AS within, n::INTEGER AS n, round(between / nullif(between + within / n, 0), 6) AS reliability FROM p, range(1, 13) r(n)""")
def a75_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("score"), F.stddev_pop("l_quantity").alias("spread"), F.count("*").alias("n"))
    return _rounded(op.reliability(r, "l_suppkey", "score", "spread", "n", 12))


@query("SELECT count(*) AS common FROM (SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 200) SEMI JOIN (SELECT p_partkey FROM part ORDER BY p_size DESC, p_partkey LIMIT 200) USING (p_partkey)")
def t04_top_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    top = lambda c: p.orderBy(F.desc(c), "p_partkey").limit(200).select("p_partkey")
    return top("p_retailprice").join(top("p_size"), "p_partkey", "left_semi").agg(F.count("*").alias("common"))
