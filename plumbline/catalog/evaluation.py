"""Scores against truth, intervals, resampling, probes."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.catalog.fixtures import ENSEMBLE, EVALUATED, SCORED, ensemble, evaluated, scored, table
from plumbline.catalog.registry import query
from plumbline.catalog.samples import _draw
from plumbline.catalog.voxels import _rounded
from plumbline.functions.numeric import correlation
from plumbline.operators import evaluation as op


@query(f"""WITH {SCORED}, c AS (SELECT grp, count(*) FILTER (y AND score >= 0.5) AS tp, count(*) FILTER (NOT y AND score >= 0.5) AS fp, count(*) FILTER (y AND score < 0.5) AS fn, count(*) FILTER (NOT y AND score < 0.5) AS tn, avg((score - y::INTEGER) ^ 2) AS brier, avg(score) FILTER (y) - avg(score) FILTER (NOT y) AS margin FROM scored GROUP BY grp)
SELECT grp, tp, fp, fn, tn, round(brier, 6) AS brier, round(margin, 6) AS margin, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(tn / nullif(tn + fp, 0), 6) AS specificity, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round(tp / nullif(tp + fp + fn, 0), 6) AS iou, round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) AS balanced FROM c""")
def a18_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(op.confusion(scored(spark, sf_dir), ["grp"], "score", "y", 0.5))


_AUC = "SELECT {k}, sum(y::INTEGER)::BIGINT AS positives, count(*) AS rows, round((sum(CASE WHEN y THEN r END) - sum(y::INTEGER) * (sum(y::INTEGER) + 1) / 2.0) / nullif(sum(y::INTEGER) * (count(*) - sum(y::INTEGER)), 0), 6)::DOUBLE AS auc FROM (SELECT *, rank() OVER (PARTITION BY {k} ORDER BY score) + (count(*) OVER (PARTITION BY {k}, score) - 1) / 2.0::DOUBLE AS r FROM {t}) GROUP BY {k}"


@query(f"WITH {SCORED} " + _AUC.format(k="grp", t="scored"))
def a19_roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(op.roc_auc(scored(spark, sf_dir), ["grp"], "score", "y"))


@query(f"""WITH {SCORED}, s AS (SELECT grp, score, count(*) AS n, count(*) FILTER (NOT y) AS e FROM scored GROUP BY ALL), c AS (SELECT *, sum(n) OVER w AS cn, sum(e) OVER w AS ce FROM s WINDOW w AS (PARTITION BY grp ORDER BY score DESC))
SELECT grp, round(sum(n * ce / cn) / sum(n), 6) AS aurc, round(sum(e) / sum(n), 6) AS error_rate FROM c GROUP BY grp""")
def a20_risk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(op.risk_coverage(scored(spark, sf_dir).withColumn("error", ~F.col("y")), ["grp"], "score", "error"))


@query(f"""WITH {SCORED}, p AS (SELECT grp, score AS cut, row_number() OVER (PARTITION BY grp ORDER BY score DESC) AS k, count(*) OVER (PARTITION BY grp) AS n FROM scored WHERE y), c AS (SELECT grp, cut FROM p WHERE k = ceil(n * 0.9::DOUBLE))
SELECT grp, any_value(cut) AS cut, round(avg((score >= cut)::INTEGER) FILTER (NOT y), 6) AS fpr FROM scored JOIN c USING (grp) GROUP BY grp""")
def a21_fpr_at_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(op.fpr_at_recall(scored(spark, sf_dir), ["grp"], "score", "y", 0.9))


_H = "(CASE WHEN {p} > 0 THEN -{p} * log2({p}) ELSE 0 END + CASE WHEN {p} < 1 THEN -(1 - {p}) * log2(1 - {p}) ELSE 0 END)"
_DIS = f"{ENSEMBLE}, dis AS (SELECT unit, stratum, truth, m AS mean, e AS expected, {_H.format(p='m')} AS predictive, greatest(0, {_H.format(p='m')} - e) AS mutual FROM (SELECT unit, any_value(stratum) AS stratum, any_value(truth) AS truth, avg(p) AS m, avg({_H.format(p='p')}) AS e FROM ensemble GROUP BY unit))"


@query(f"WITH {_DIS} SELECT unit, round(mean, 6) AS mean, round(expected, 6) AS expected, round(predictive, 6) AS predictive, round(mutual, 6) AS mutual FROM dis")
def a22_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(op.disagreement(ensemble(spark, sf_dir), ["unit"], "p"))


@query(f"WITH {_DIS}, f AS (SELECT stratum, round(mutual, 9) AS score, (mean >= 0.5) <> truth AS y FROM dis UNION ALL SELECT -1, round(mutual, 9), (mean >= 0.5) <> truth FROM dis) " + _AUC.format(k="stratum", t="f"))
def a23_failure_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well mutual information ranks the ensemble's failures, per stratum and pooled (-1)."""
    d = op.disagreement(ensemble(spark, sf_dir), ["unit", "stratum", "truth"], "p")
    d = d.select(F.explode(F.array(F.col("stratum"), F.lit(-1))).alias("stratum"), F.round("mutual", 9).alias("s"), ((F.col("mean") >= 0.5) != F.col("truth")).alias("y"))
    return _rounded(op.roc_auc(d, ["stratum"], "s", "y"))


@query(f"""WITH {SCORED}, r AS (SELECT grp, score, row_number() OVER (PARTITION BY grp ORDER BY score) AS k, count(*) OVER (PARTITION BY grp) AS n FROM scored), b AS (SELECT grp, any_value(n) AS n, max(CASE WHEN k = ceil((n + 1) * (1 - 0.1::DOUBLE)) THEN score END) AS bound FROM r GROUP BY grp)
SELECT grp, any_value(n) AS n, any_value(bound) AS bound, round(avg((score <= bound)::INTEGER), 6) AS covered FROM scored JOIN b USING (grp) GROUP BY grp""")
def a24_conformal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(op.conformal(scored(spark, sf_dir), ["grp"], "score", 0.1))


@query(f"""WITH {SCORED}, b AS (SELECT grp, (score >= 0.25)::INTEGER + (score >= 0.5)::INTEGER + (score >= 0.75)::INTEGER AS bin, count(*) AS n, avg(y::INTEGER) AS rate FROM scored GROUP BY ALL), f AS (SELECT *, coalesce(rate < lag(rate) OVER (PARTITION BY grp ORDER BY bin), false) AS fall FROM b)
SELECT grp, bin, n, round(rate, 6) AS rate, fall, NOT bool_or(fall) OVER (PARTITION BY grp) AS monotone FROM f""")
def a38_reliability_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(op.reliability_bins(scored(spark, sf_dir), ["grp"], "score", "y", [0.0, 0.25, 0.5, 0.75, 1.0]))


@query(f"""WITH {EVALUATED}, s AS (SELECT region, CASE WHEN failed THEN 'failed' WHEN predicted IS NULL THEN 'missing' WHEN abs(predicted - truth) <= 0.5 * truth THEN 'ok' ELSE 'off' END AS status FROM evaluated),
g AS (SELECT region, count(*) AS targets, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'off') AS off, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'missing') AS missing FROM s GROUP BY region) SELECT *, round(ok / nullif(ok + off, 0), 6) AS scored_rate, round(ok / targets, 6) AS target_rate FROM g""")
def j03_targets_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(op.evaluate(evaluated(spark, sf_dir), ["region"], "truth", "predicted", "failed", 0.5))


@query(f"""WITH {EVALUATED}, e AS (SELECT region, abs(predicted - truth) AS err FROM evaluated WHERE predicted IS NOT NULL), r AS (SELECT region, err, row_number() OVER (PARTITION BY region ORDER BY err) AS k, count(*) OVER (PARTITION BY region) AS n FROM e)
SELECT region, any_value(n) AS n, round(max(CASE WHEN k = greatest(1, ceil(n * 0.5::DOUBLE)) THEN err END), 6) AS q50, round(max(CASE WHEN k = greatest(1, ceil(n * 0.95::DOUBLE)) THEN err END), 6) AS q95 FROM r GROUP BY region""")
def a40_nearest_rank_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = evaluated(spark, sf_dir).withColumn("err", F.abs(F.col("predicted") - F.col("truth")))
    return _rounded(op.nearest_rank(e, ["region"], "err", [0.5, 0.95]))


@query(f"WITH {EVALUATED}, e AS (SELECT region, floor((predicted - truth) / truth)::BIGINT AS step FROM evaluated WHERE predicted IS NOT NULL) SELECT region, step, count(*) AS n, CASE WHEN step = 0 THEN 'exact' WHEN abs(step) = 1 THEN 'one_off' ELSE 'multi' END AS class FROM e GROUP BY ALL")
def a40_error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.floor((F.col("predicted") - F.col("truth")) / F.col("truth"))
    g = evaluated(spark, sf_dir).where("predicted IS NOT NULL").groupBy("region", s.alias("step")).agg(F.count("*").alias("n"))
    return g.withColumn("class", F.when(F.col("step") == 0, "exact").when(F.abs("step") == 1, "one_off").otherwise("multi"))


_POISSON = []
_mass, _term = 0.0, 0.36787944117144233
for _k in range(9):
    _mass += _term
    _POISSON.append(int(_mass * 2**32))
    _term /= _k + 1


def _reps(rows: str, key: str, seed: str, n: int) -> str:
    return f"(SELECT *, {' + '.join(f'(dr >= {e})::INTEGER' for e in _POISSON)} AS weight FROM (SELECT t.*, replicate, {_draw(repr(seed), 'replicate', key)} AS dr FROM {rows} t, range(1, {n + 1}) r(replicate)))"


@query(f"""WITH {SCORED}, b AS (SELECT grp, replicate, sum(weight * score) / sum(weight) AS stat FROM {_reps('scored', 'id', 'boot', 100)} WHERE weight > 0 GROUP BY ALL), c AS (SELECT grp, quantile_cont(stat, 0.025) AS low, quantile_cont(stat, 0.975) AS high FROM b GROUP BY grp)
SELECT grp, round(low, 6) AS low, round(high, 6) AS high FROM c""")
def a25_bootstrap_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(op.bootstrap(scored(spark, sf_dir), ["grp"], "id", "boot", 100, F.sum(F.col("weight") * F.col("score")) / F.sum("weight")))


@query(f"""WITH {SCORED}, b AS (SELECT grp, replicate, sum(weight * score) FILTER (y) / sum(weight * score) AS stat FROM {_reps('scored', 'id', 'ratio', 100)} WHERE weight > 0 GROUP BY ALL), c AS (SELECT grp, quantile_cont(stat, 0.025) AS low, quantile_cont(stat, 0.975) AS high FROM b GROUP BY grp)
SELECT grp, round(low, 6) AS low, round(high, 6) AS high FROM c""")
def a26_bootstrap_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("weight") * F.col("score")
    return _rounded(op.bootstrap(scored(spark, sf_dir), ["grp"], "id", "ratio", 100, F.sum(F.when(F.col("y"), s)) / F.sum(s)))


@query(f"""WITH {ENSEMBLE}, u AS (SELECT stratum, block, unit, avg(p) AS p FROM ensemble GROUP BY ALL), b AS (SELECT stratum, replicate, sum(weight * p) / sum(weight) AS stat FROM {_reps('u', 'block', 'blocks', 100)} WHERE weight > 0 GROUP BY ALL), c AS (SELECT stratum, quantile_cont(stat, 0.025) AS low, quantile_cont(stat, 0.975) AS high FROM b GROUP BY ALL)
SELECT stratum, round(low, 6) AS low, round(high, 6) AS high FROM c""")
def a27_cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster is what is drawn: all its rows share one weight. The statistic is a callable over the replicate table."""
    u = ensemble(spark, sf_dir).groupBy("stratum", "block", "unit").agg(F.avg("p").alias("p"))

    def mean(rep: DataFrame) -> DataFrame:
        return rep.groupBy("stratum", "replicate").agg((F.sum(F.col("weight") * F.col("p")) / F.sum("weight")).alias("stat"))

    return _rounded(op.bootstrap(u, ["stratum"], "block", "blocks", 100, mean))


@query("""WITH m AS (SELECT c_mktsegment, avg(o_totalprice) AS m FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'BUILDING' GROUP BY ALL), w AS (SELECT c_mktsegment, sum(abs(c_acctbal)) AS w FROM customer GROUP BY ALL)
SELECT round(sum(w * m) / sum(w) FILTER (m IS NOT NULL), 6) AS estimate, count(*) FILTER (m IS NULL) AS uncovered, round(sum(w) FILTER (m IS NOT NULL) / sum(w), 6) AS share FROM w LEFT JOIN m USING (c_mktsegment)""")
def a28_poststratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    o = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).where("c_mktsegment <> 'BUILDING'")
    w = c.groupBy("c_mktsegment").agg(F.sum(F.abs("c_acctbal")).alias("w"))
    return _rounded(op.poststratified(o, "c_mktsegment", "o_totalprice", w, "w"))


@query("""WITH f AS (SELECT c_custkey, (c_acctbal >= -500)::INTEGER + (c_acctbal >= 0)::INTEGER + (c_acctbal >= 3000)::INTEGER + (c_acctbal >= 9990)::INTEGER AS bin FROM customer), e AS (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 350000),
g AS (SELECT bin, count(*) AS target, count(o_custkey) AS evaluated FROM f LEFT JOIN e ON o_custkey = c_custkey GROUP BY bin), b AS (SELECT r.bin::INTEGER AS bin, coalesce(target, 0) AS target, coalesce(evaluated, 0) AS evaluated FROM range(0, 5) r(bin) LEFT JOIN g USING (bin)),
s AS (SELECT *, target / sum(target) OVER () AS share, evaluated / sum(evaluated) OVER () / nullif(target / sum(target) OVER (), 0) AS representation FROM b)
SELECT bin, target, evaluated, round(share, 6) AS share, round(representation, 6) AS representation, CASE WHEN target = 0 THEN 'empty' WHEN share < 0.02 THEN 'negligible' WHEN evaluated < 30 OR representation < 0.5 THEN 'under_evaluated' ELSE 'evaluated' END AS status, concat_ws(',', CASE WHEN evaluated < 30 THEN 'too_few' END, CASE WHEN representation < 0.5 THEN 'under_represented' END) AS reasons FROM s""")
def a29_covariate_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "orders").where("o_totalprice > 350000").select(F.col("o_custkey").alias("c_custkey"))
    return _rounded(op.covariate_strata(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), e, "c_custkey", "c_acctbal", [-500.0, 0.0, 3000.0, 9990.0], 30))


@query(f"""WITH {SCORED}, r AS (SELECT grp, id, score, y, replicate FROM scored, range(0, 51) x(replicate)), a AS (SELECT replicate, grp, score, row_number() OVER (PARTITION BY replicate, grp ORDER BY CASE WHEN replicate = 0 THEN 0 ELSE {_draw("'perm'", 'replicate', 'id')} END, id) AS k FROM r),
b AS (SELECT replicate, grp, y, row_number() OVER (PARTITION BY replicate, grp ORDER BY id) AS k FROM r), d AS (SELECT replicate, avg(score) FILTER (y) - avg(score) FILTER (NOT y) AS d FROM a JOIN b USING (replicate, grp, k) GROUP BY replicate)
SELECT round(any_value(s.d), 6) AS difference, round((1 + count(*) FILTER (abs(d.d) >= abs(s.d))) / 51, 6) AS p FROM d, (SELECT d FROM d WHERE replicate = 0) s WHERE replicate > 0""")
def a30_permutation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(op.permutation_test(scored(spark, sf_dir), "grp", "id", "score", "y", "perm", 50))


@query("""WITH d AS (SELECT l_returnflag, l_suppkey % 10 AS s, round(avg(l_quantity), 1) - 25.5::DOUBLE AS delta FROM lineitem GROUP BY l_returnflag, l_suppkey), g AS (SELECT l_returnflag, count(*) FILTER (delta > 0) AS pos, count(*) FILTER (delta <> 0) AS n FROM d GROUP BY ALL)
SELECT l_returnflag, pos, n, round(least(1, list_sum(list_transform(range(pos, n + 1), lambda k: exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2))))), 6)::DOUBLE AS p FROM g""")
def a31_sign_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_suppkey").agg((F.round(F.avg("l_quantity"), 1) - 25.5).alias("delta"))
    return _rounded(op.sign_test(d, ["l_returnflag"], "delta"))


@query("""WITH a AS (SELECT l_suppkey, l_returnflag, avg(l_quantity) AS q, avg(l_discount) * 100 AS dis, avg(l_tax) * 100 AS tax FROM lineitem GROUP BY ALL), p AS (SELECT m, (x.v - y.v) AS d FROM (SELECT l_suppkey, l_returnflag, unnest(['q', 'dis', 'tax']) AS m, unnest([q, dis, tax]) AS v FROM a) x JOIN (SELECT l_suppkey, l_returnflag, unnest(['q', 'dis', 'tax']) AS m, unnest([q, dis, tax]) AS v FROM a) y USING (l_suppkey, m) WHERE x.l_returnflag = 'A' AND y.l_returnflag = 'N')
SELECT m AS metric, count(*) AS pairs, round(median(d), 6) AS median, round(avg((d > 0)::INTEGER), 6) AS positive, CASE WHEN avg((d > 0)::INTEGER) > 0.6 THEN 'concordant' WHEN avg((d > 0)::INTEGER) < 0.4 THEN 'discordant' ELSE 'inconclusive' END AS verdict FROM p GROUP BY m""")
def a32_paired_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.avg("l_quantity").alias("q"), (F.avg("l_discount") * 100).alias("dis"), (F.avg("l_tax") * 100).alias("tax"))
    tall = a.unpivot(["l_suppkey", "l_returnflag"], ["q", "dis", "tax"], "metric", "v")
    x, y = tall.where("l_returnflag = 'A'"), tall.where("l_returnflag = 'N'").select("l_suppkey", "metric", F.col("v").alias("w"))
    up = F.avg((F.col("v") > F.col("w")).cast("double"))
    g = x.join(y, ["l_suppkey", "metric"]).groupBy("metric").agg(F.count("*").alias("pairs"), F.median(F.col("v") - F.col("w")).alias("median"), up.alias("positive"))
    return _rounded(g.withColumn("verdict", F.when(F.col("positive") > 0.6, "concordant").when(F.col("positive") < 0.4, "discordant").otherwise("inconclusive")))


@query(f"""WITH {SCORED}, g AS (SELECT domain, count(*) FILTER (score >= 0.1) AS n, count(*) FILTER (y AND score >= 0.1) AS k, count(*) FILTER (score < 0.1) AS unclear FROM scored GROUP BY domain), c AS (SELECT *, 1.959963984540054::DOUBLE AS z, k / nullif(n, 0) AS p FROM g)
SELECT domain, n, k, unclear, round(p, 6) AS rate, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS low, round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS high, round(k / nullif(n + unclear, 0), 6) AS least, round((k + unclear) / nullif(n + unclear, 0), 6) AS most FROM c""")
def a33_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(op.wilson(scored(spark, sf_dir).withColumn("unclear", F.col("score") < 0.1), ["domain"], "y", "unclear"))


@query("WITH g AS (SELECT l_suppkey, l_returnflag, sum(l_quantity) AS v FROM lineitem GROUP BY ALL) SELECT l_suppkey, count(*) AS repeats, round((max(v) - min(v)) / nullif(abs(avg(v)), 0), 6) AS floor, count(DISTINCT v) = 1 AS identical, round(3 * (max(v) - min(v)) / nullif(abs(avg(v)), 0), 6) AS smallest_claim FROM g GROUP BY l_suppkey")
def a41_noise_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.sum("l_quantity").alias("v"))
    return _rounded(op.noise_floor(g, ["l_suppkey"], "v", 3.0))


@query("""WITH h AS (SELECT l_suppkey, l_linestatus, avg(l_quantity) AS v FROM lineitem GROUP BY ALL), f AS (SELECT l_suppkey, max(v) - min(v) > 1 AS fails, l_suppkey % 3 = 0 AS other FROM h GROUP BY l_suppkey) SELECT count(*) FILTER (fails AND other) AS both, count(*) FILTER (fails AND NOT other) AS only_first, count(*) FILTER (NOT fails AND other) AS only_second, count(*) FILTER (NOT fails AND NOT other) AS blind, CASE WHEN count(*) FILTER (fails AND NOT other) > count(*) FILTER (NOT fails AND other) THEN 'PROMOTE' ELSE 'REJECT' END AS verdict FROM f""")
def a54_decision_contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linestatus").agg(F.avg("l_quantity").alias("v"))
    f = h.groupBy("l_suppkey").agg((F.max("v") - F.min("v") > 1).alias("a")).withColumn("b", F.col("l_suppkey") % 3 == 0)
    a, b = F.col("a"), F.col("b")
    g = f.agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("only_first"), F.count_if(~a & b).alias("only_second"), F.count_if(~a & ~b).alias("blind"))
    return g.withColumn("verdict", F.when(F.col("only_first") > F.col("only_second"), "PROMOTE").otherwise("REJECT"))


@query(f"WITH {SCORED}, f AS (SELECT h.domain AS held, r.grp, r.score, r.y FROM (SELECT DISTINCT domain FROM scored) h JOIN scored r ON r.domain <> h.domain), m AS (SELECT held, median(score) FILTER (y) - median(score) FILTER (NOT y) AS d FROM f GROUP BY held), s AS (SELECT s.domain, s.y, s.score * sign(d) AS score FROM scored s JOIN m ON held = s.domain) " + _AUC.format(k="domain", t="s"))
def a55_leave_one_group_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other domains' medians set the direction; AUC on the held-out one."""
    s = scored(spark, sf_dir)
    m = op.leave_one_out_medians(s, "domain", "y", "score").groupBy("domain").agg((F.max(F.when(F.col("y"), F.col("median"))) - F.max(F.when(~F.col("y"), F.col("median")))).alias("d"))
    j = s.join(m, "domain").select("domain", "y", (F.col("score") * F.signum("d")).alias("s"))
    return _rounded(op.roc_auc(j, ["domain"], "s", "y"))


@query(f"WITH {SCORED}, t AS (SELECT grp, quantile_cont(score, 0.95) FILTER (y) AS thr FROM scored GROUP BY grp) SELECT grp, round(any_value(thr), 6) AS threshold, round(avg((score > thr)::INTEGER) FILTER (NOT y), 6) AS rejected, round(median(score) FILTER (y) / nullif(median(score) FILTER (NOT y), 0), 6) AS median_ratio FROM scored JOIN t USING (grp) GROUP BY grp")
def a68_development_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    t = s.where("y").groupBy("grp").agg(F.percentile("score", F.lit(0.95)).alias("threshold"))
    y = F.col("y")
    g = s.join(t, "grp").groupBy("grp").agg(F.first("threshold").alias("threshold"), F.avg(F.when(~y, (F.col("score") > F.col("threshold")).cast("double"))).alias("rejected"), F.try_divide(F.median(F.when(y, F.col("score"))), F.median(F.when(~y, F.col("score")))).alias("median_ratio"))
    return _rounded(g)


@query("WITH c AS (SELECT event_type, floor(value / 10)::INTEGER AS v, count(*) AS n FROM events GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, abs(v), v) AS k FROM c) SELECT event_type, v AS mode, n FROM k WHERE k = 1")
def a72_modal_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "events").groupBy("event_type", F.floor(F.col("value") / 10).cast("int").alias("v")).agg(F.count("*").alias("n"))
    k = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("n"), F.abs("v"), "v"))
    return c.withColumn("k", k).where("k = 1").select("event_type", F.col("v").alias("mode"), "n")


@query("""WITH h AS (SELECT label, quality, toxic, lang FROM documents d JOIN (SELECT doc_id, quality, toxic, quality * 2 + toxic AS label FROM labels) USING (doc_id)) SELECT lang, count(*) AS n, round(avg(toxic), 6) AS rate, CASE WHEN count(*) >= 4 AND stddev_pop(quality) > 0 AND stddev_pop(toxic) > 0 THEN round(corr(quality, toxic), 6) END AS corr FROM h GROUP BY lang""")
def a63_error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return _rounded(h.groupBy("lang").agg(F.count("*").alias("n"), F.avg("toxic").alias("rate"), F.when(F.count("*") >= 4, correlation("quality", "toxic")).alias("corr")))


@query(f"""WITH d AS (SELECT doc_id, lang, quality, {_draw("'bal'", 'doc_id')} AS h FROM documents JOIN labels USING (doc_id)), m AS (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM d GROUP BY lang, quality)), k AS (SELECT *, row_number() OVER (PARTITION BY lang, quality ORDER BY h, doc_id) AS k FROM d) SELECT doc_id, lang, quality FROM k, m WHERE k <= m""")
def a63_balanced_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.functions.numeric import hash_draw

    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", "quality", hash_draw("bal", F.col("doc_id")).alias("h"))
    m = d.groupBy("lang", "quality").count().agg(F.min("count").alias("m"))
    k = d.withColumn("k", F.row_number().over(Window.partitionBy("lang", "quality").orderBy("h", "doc_id")))
    return k.join(F.broadcast(m)).where("k <= m").select("doc_id", "lang", "quality")


@query()
def a64_ridge_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A linear solve has no form in SQL; tested against numpy's."""
    return op.ridge_probe(table(spark, sf_dir, "embeddings"), "embedding", 64, "label", "vec_id % 2 = 0", 10.0)


@query("""WITH n AS (SELECT vec_id, label, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))) AS l FROM embeddings), p AS (SELECT a.label, (list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i])) / (a.l * b.l)) AS c FROM n a JOIN n b ON b.vec_id = a.vec_id + 1) SELECT label, count(*) AS pairs, round(avg(c), 6) AS mean_cosine, round(median(c), 6) AS median_cosine FROM p GROUP BY label""")
def a66_view_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of neighbouring views, on vectors normalised once."""
    e = table(spark, sf_dir, "embeddings")
    x = F.transform("embedding", lambda v: v.cast("double"))
    unit = e.select("vec_id", "label", x.alias("x")).withColumn("l", F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))).select("vec_id", "label", F.transform("x", lambda v: v / F.col("l")).alias("x"))
    b = unit.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    c = F.aggregate(F.zip_with("x", "y", lambda p, q: p * q), F.lit(0.0), lambda a, v: a + v)
    return _rounded(unit.join(b, "vec_id").withColumn("c", c).groupBy("label").agg(F.count("*").alias("pairs"), F.avg("c").alias("mean_cosine"), F.median("c").alias("median_cosine")))


@query("""WITH e AS (SELECT label, (vec_id % 16)::DOUBLE AS t, embedding[1]::DOUBLE AS v FROM embeddings) SELECT label, round(regr_r2(v, t), 6) AS r2, round(regr_slope(v, t), 6) AS slope FROM e GROUP BY label""")
def a67_position_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") % 16).cast("double").alias("t"), F.col("embedding")[0].cast("double").alias("v"))
    return _rounded(e.groupBy("label").agg(F.regr_r2("v", "t").alias("r2"), F.regr_slope("v", "t").alias("slope")))


@query("""WITH g AS (SELECT o_custkey, max(o_totalprice) FILTER (o_orderpriority LIKE '1%') AS surface, max(o_totalprice) FILTER (o_orderpriority NOT LIKE '1%') AS control FROM orders GROUP BY o_custkey) SELECT count(*) AS planned, count(*) FILTER (surface IS NOT NULL AND control IS NOT NULL) AS complete, round(median(surface - control), 6) AS margin, round(count(*) FILTER (surface > control) / count(*), 6) AS win_share FROM g""")
def a71_plan_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_orderpriority").like("1%")
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.when(p, F.col("o_totalprice"))).alias("s"), F.max(F.when(~p, F.col("o_totalprice"))).alias("c"))
    return _rounded(g.agg(F.count("*").alias("planned"), F.count_if(F.col("s").isNotNull() & F.col("c").isNotNull()).alias("complete"), F.median(F.col("s") - F.col("c")).alias("margin"), (F.count_if(F.col("s") > F.col("c")) / F.count("*")).alias("win_share")))
