"""Scores against truth: confusion, ranks, risk and coverage, intervals, resampling, probes."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.numeric import entropy_bits, hash_draw, log_gamma, ratio


def confusion(df: DataFrame, keys: list[str], score: str, label: str, threshold: float) -> DataFrame:
    """Counts and rates at a closed threshold; a rate without a denominator is NULL."""
    y, p = F.col(label), F.col(score) >= threshold
    out = df.groupBy(*keys).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"), F.avg(F.pow(F.col(score) - y.cast("double"), F.lit(2))).alias("brier"), (F.avg(F.when(y, F.col(score))) - F.avg(F.when(~y, F.col(score)))).alias("margin"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    rec, spec = ratio(tp, tp + fn), ratio(tn, tn + fp)
    return out.select("*", ratio(tp, tp + fp).alias("precision"), rec.alias("recall"), spec.alias("specificity"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp, tp + fp + fn).alias("iou"), ((rec + spec) / 2).alias("balanced"))


def _steps(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Counts at each distinct score: what all windows below run over, never the rows themselves."""
    return df.groupBy(*keys, F.col(score).alias("s")).agg(F.count("*").alias("n"), F.count_if(F.col(label)).alias("pos"))


def _ranked(df: DataFrame, keys: list[str], score: str, descending: bool = False, weight: Column | None = None) -> DataFrame:
    """(keys, s, n, upto, total): distinct scores with how many rows have them and how many come up to them. Picks of a rank need no more."""
    n = df.groupBy(*keys, F.col(score).alias("s")).agg((F.count("*") if weight is None else F.sum(weight)).alias("n"))
    w = Window.partitionBy(*keys)
    return n.withColumn("upto", F.sum("n").over(w.orderBy(F.desc("s") if descending else "s"))).withColumn("total", F.sum("n").over(w))


def leave_one_out_medians(df: DataFrame, fold: str, flag: str, value: str) -> DataFrame:
    """(fold, flag, median): the median over all other folds. Rows are counted by distinct value first; only these counts are shown to the other folds, which are few."""
    counts = df.groupBy(fold, flag, value).agg(F.count("*").alias("n"))
    folds = df.select(F.col(fold).alias("held")).distinct()
    r = _ranked(counts.join(folds, F.col(fold) != F.col("held")), ["held", flag], value, weight=F.col("n"))
    at = lambda k: F.min(F.when(F.col("upto") >= k, F.col("s")))
    g = r.groupBy("held", flag).agg(at(F.floor((F.col("total") + 1) / 2)).alias("a"), at(F.floor(F.col("total") / 2) + 1).alias("b"))
    return g.select(F.col("held").alias(fold), flag, ((F.col("a") + F.col("b")) / 2).alias("median"))


def roc_auc(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Area under the ROC curve, ties sharing ranks; NULL with one class only."""
    w = Window.partitionBy(*keys).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    s = _steps(df, keys, score, label).withColumn("below", F.coalesce(F.sum("n").over(w), F.lit(0)))
    g = s.groupBy(*keys).agg(F.sum(F.col("pos") * (F.col("below") + (F.col("n") + 1) / 2.0)).alias("ranks"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    return g.select(*keys, F.col("p").alias("positives"), F.col("n").alias("rows"), ratio(F.col("ranks") - F.col("p") * (F.col("p") + 1) / 2.0, (F.col("p") * (F.col("n") - F.col("p"))).cast("double")).alias("auc"))


def risk_coverage(df: DataFrame, keys: list[str], confidence: str, error: str) -> DataFrame:
    """Area under the risk-coverage curve, the most confident first, ties resolved at the end of their block."""
    w = Window.partitionBy(*keys).orderBy(F.desc("s"))
    s = _steps(df, keys, confidence, error).withColumn("cn", F.sum("n").over(w)).withColumn("ce", F.sum("pos").over(w))
    return s.groupBy(*keys).agg((F.sum(F.col("n") * F.col("ce") / F.col("cn")) / F.sum("n")).alias("aurc"), (F.sum("pos") / F.sum("n")).alias("error_rate"))


def fpr_at_recall(df: DataFrame, keys: list[str], score: str, label: str, recall: float) -> DataFrame:
    """Share of negatives at or above the cut that keeps the wanted share of positives."""
    pos = _ranked(df.where(F.col(label)), keys, score, descending=True)
    cut = pos.groupBy(*keys).agg(F.max(F.when(F.col("upto") >= F.ceil(F.col("total") * recall), F.col("s"))).alias("cut"))
    return df.join(cut, keys).groupBy(*keys).agg(F.first("cut").alias("cut"), F.avg(F.when(~F.col(label), (F.col(score) >= F.col("cut")).cast("double"))).alias("fpr"))


def disagreement(df: DataFrame, unit: list[str], p: str) -> DataFrame:
    """Per unit over members: entropy of the mean, mean entropy, mutual information, in bits."""
    out = df.groupBy(*unit).agg(F.avg(p).alias("mean"), F.avg(entropy_bits(F.col(p))).alias("expected"))
    out = out.withColumn("predictive", entropy_bits(F.col("mean")))
    return out.withColumn("mutual", F.greatest(F.lit(0.0), F.col("predictive") - F.col("expected")))


def conformal(df: DataFrame, keys: list[str], score: str, alpha: float) -> DataFrame:
    """Split-conformal upper bound: the score of rank ceil((n + 1)(1 - alpha)), NULL beyond n; the share at or below it."""
    r = _ranked(df, keys, score)
    rank = F.ceil((F.col("total") + 1) * (1 - alpha))
    g = r.groupBy(*keys).agg(F.first("total").alias("n"), F.min(F.when(F.col("upto") >= rank, F.col("s"))).alias("bound"))
    return df.join(g, keys).groupBy(*keys).agg(F.first("n").alias("n"), F.first("bound").alias("bound"), F.avg((F.col(score) <= F.col("bound")).cast("double")).alias("covered"))


def reliability_bins(df: DataFrame, keys: list[str], score: str, label: str, edges: list[float]) -> DataFrame:
    """Rate per confidence bin, bins half-open but the last, and whether rates never fall."""
    b = sum(((F.col(score) >= e).cast("int") for e in edges[2:-1]), (F.col(score) >= edges[1]).cast("int"))
    g = df.where((F.col(score) >= edges[0]) & (F.col(score) <= edges[-1])).groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col(label).cast("double")).alias("rate"))
    fall = F.col("rate") < F.lag("rate").over(Window.partitionBy(*keys).orderBy("bin"))
    return g.withColumn("fall", F.coalesce(fall, F.lit(False))).withColumn("monotone", ~F.bool_or("fall").over(Window.partitionBy(*keys)))


def evaluate(expected: DataFrame, keys: list[str], truth: str, predicted: str, failed: str, tolerance: float) -> DataFrame:
    """Every expected target counts: ok within tolerance, off outside it, failed, missing; rates over scored and over all."""
    status = F.when(F.col(failed), "failed").when(F.col(predicted).isNull(), "missing").when(F.abs(F.col(predicted) - F.col(truth)) <= tolerance * F.col(truth), "ok").otherwise("off")
    g = expected.withColumn("status", status).groupBy(*keys).agg(F.count("*").alias("targets"), *[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "off", "failed", "missing")])
    return g.withColumn("scored_rate", ratio(F.col("ok"), F.col("ok") + F.col("off"))).withColumn("target_rate", ratio(F.col("ok"), F.col("targets")))


def nearest_rank(df: DataFrame, keys: list[str], value: str, qs: list[float]) -> DataFrame:
    """Values of rank max(1, ceil(q n)): picks, not interpolations."""
    r = _ranked(df.where(F.col(value).isNotNull()), keys, value)
    at = lambda q: F.min(F.when(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.col("total") * q)), F.col("s")))
    return r.groupBy(*keys).agg(F.first("total").alias("n"), *[at(q).alias(f"q{round(q * 100)}") for q in qs])


def replicates(df: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """Each row in each of n bootstrap replicates with a Poisson(1) weight from its digest; rows of weight 0 are left out.

    The weight is the number of Poisson thresholds that the draw exceeds, so nothing is gathered and any
    weighted statistic with the replicate as a key gives its bootstrap distribution.
    """
    mass, edges, term = 0.0, [], 0.36787944117144233
    for k in range(9):
        mass += term
        edges.append(int(mass * 2**32))
        term /= k + 1
    out = df.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("__d", hash_draw(seed, F.col("replicate"), F.col(key)))
    weight = sum(((F.col("__d") >= e).cast("int") for e in edges[1:]), (F.col("__d") >= edges[0]).cast("int"))
    return out.withColumn("weight", weight).drop("__d").where(F.col("weight") > 0)


def bootstrap(df: DataFrame, keys: list[str], key: str, seed: str, n: int, statistic: Column | Callable[[DataFrame], DataFrame], alpha: float = 0.05) -> DataFrame:
    """Percentile interval of a statistic: an aggregate expression over ``weight``, or a function of the replicate table that returns (keys, replicate, stat)."""
    rep = replicates(df, key, seed, n)
    each = statistic(rep) if callable(statistic) else rep.groupBy(*keys, "replicate").agg(statistic.alias("stat"))
    return each.groupBy(*keys).agg(F.percentile("stat", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("q")).select(*keys, F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def permutation_test(df: DataFrame, group: str, key: str, value: str, flag: str, seed: str, n: int) -> DataFrame:
    """Difference of group-wise means between flagged and other rows against n shuffles of the flags within each group: p = (1 + exceed) / (1 + n)."""
    by = ["replicate", group]
    rows = df.select(group, key, value, flag).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n))))
    w = Window.partitionBy(*by)
    order = F.when(F.col("replicate") == 0, F.lit(0)).otherwise(hash_draw(seed, F.col("replicate"), F.col(key)))
    places = rows.withColumn("k", F.row_number().over(w.orderBy(order, key))).select(*by, "k", value)
    flags = rows.withColumn("k", F.row_number().over(w.orderBy(key))).select(*by, "k", flag)
    m = places.join(flags, [*by, "k"]).groupBy("replicate").agg((F.avg(F.when(F.col(flag), F.col(value))) - F.avg(F.when(~F.col(flag), F.col(value)))).alias("d"))
    seen = m.where("replicate = 0").select(F.col("d").alias("seen"))
    return m.where("replicate > 0").join(F.broadcast(seen)).agg(F.first("seen").alias("difference"), ((1 + F.count_if(F.abs("d") >= F.abs("seen"))) / (1.0 + n)).alias("p"))


def sign_test(df: DataFrame, keys: list[str], delta: str) -> DataFrame:
    """One-sided exact P(X >= positives) of a fair coin, ties dropped; 1 with nothing left.

    The smaller tail is summed, from its largest term outwards, each term from the one before: terms
    beyond 20 root n are below double precision, so the work grows with the root of the pairs.
    """
    g = df.groupBy(*keys).agg(F.count_if(F.col(delta) > 0).alias("pos"), F.count_if(F.col(delta) != 0).alias("n"))
    n, pos = F.col("n").cast("double"), F.col("pos").cast("double")
    upper = 2 * pos > n
    q = F.when(upper, pos).otherwise(n - pos + 1)
    first = log_gamma(n + 1) - log_gamma(q + 1) - log_gamma(F.greatest(n - q, F.lit(0.0)) + 1) - n * math.log(2)
    terms = F.least(n - q, F.ceil(20 * F.sqrt(n)) + 50).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(at: Column, k: Column) -> Column:
        term = at["term"] * (n - q - k) / (q + k + 1)
        return F.struct(term.alias("term"), (at["sum"] + term).alias("sum"))

    total = F.when(terms > 0, F.aggregate(F.sequence(F.lit(0), F.greatest(terms, F.lit(1)) - 1), start, step)["sum"]).otherwise(1.0)
    tail = F.when(q > n, 0.0).otherwise(F.exp(first) * total)
    return g.withColumn("p", F.when(F.col("n") == 0, 1.0).otherwise(F.least(F.lit(1.0), F.when(upper, tail).otherwise(1.0 - tail))))


def wilson(df: DataFrame, keys: list[str], label: str, unclear: str, z: float = 1.959963984540054) -> DataFrame:
    """Rate with its Wilson interval over clear rows, and its bounds if all unclear rows were one or the other."""
    g = df.groupBy(*keys).agg(F.count_if(~F.col(unclear)).alias("n"), F.count_if(F.col(label) & ~F.col(unclear)).alias("k"), F.count_if(unclear).alias("unclear"))
    p, n = ratio(F.col("k"), F.col("n")), F.col("n")
    mid, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return g.select("*", p.alias("rate"), F.when(n > 0, mid - half).alias("low"), F.when(n > 0, mid + half).alias("high"), ratio(F.col("k"), n + F.col("unclear")).alias("least"), ratio(F.col("k") + F.col("unclear"), n + F.col("unclear")).alias("most"))


def poststratified(df: DataFrame, stratum: str, value: str, weights: DataFrame, weight: str) -> DataFrame:
    """Stratum means under target weights; strata that are not covered are counted and keep their weight in the share covered."""
    m = df.groupBy(stratum).agg(F.avg(value).alias("m"))
    j = weights.join(m, stratum, "left")
    return j.agg(ratio(F.sum(F.col(weight) * F.col("m")), F.sum(F.when(F.col("m").isNotNull(), F.col(weight)))).alias("estimate"), F.count_if(F.col("m").isNull()).alias("uncovered"), ratio(F.sum(F.when(F.col("m").isNotNull(), F.col(weight))), F.sum(weight)).alias("share"))


def covariate_strata(frame: DataFrame, evaluated: DataFrame, key: str, covariate: str, edges: list[float], least: int) -> DataFrame:
    """Bins of the full frame and how well evaluated rows represent them: status and reasons."""
    b = sum(((F.col(covariate) >= e).cast("int") for e in edges[1:]), (F.col(covariate) >= edges[0]).cast("int"))
    rows = frame.withColumn("bin", b).join(evaluated.select(key).distinct().withColumn("ev", F.lit(1)), key, "left")
    g = rows.groupBy("bin").agg(F.count("*").alias("target"), F.count("ev").alias("evaluated"))
    bins = frame.sparkSession.range(len(edges) + 1).select(F.col("id").cast("int").alias("bin"))
    g = bins.join(g, "bin", "left").na.fill(0, ["target", "evaluated"])
    w = Window.partitionBy(F.lit(0))
    share, got = ratio(F.col("target"), F.sum("target").over(w)), ratio(F.col("evaluated"), F.sum("evaluated").over(w))
    g = g.withColumn("share", share).withColumn("representation", ratio(got, share))
    status = F.when(F.col("target") == 0, "empty").when(F.col("share") < 0.02, "negligible").when((F.col("evaluated") < least) | (F.col("representation") < 0.5), "under_evaluated").otherwise("evaluated")
    reasons = F.array_compact(F.array(F.when(F.col("evaluated") < least, "too_few"), F.when(F.col("representation") < 0.5, "under_represented")))
    return g.withColumn("status", status).withColumn("reasons", F.array_join(reasons, ","))


def noise_floor(df: DataFrame, keys: list[str], value: str, factor: float) -> DataFrame:
    """Range of repeats over their mean, and whether a claimed effect exceeds it ``factor`` times."""
    g = df.groupBy(*keys).agg(F.count("*").alias("repeats"), ratio(F.max(value) - F.min(value), F.abs(F.avg(value))).alias("floor"), (F.count_distinct(value) == 1).alias("identical"))
    return g.withColumn("smallest_claim", factor * F.col("floor"))


def ridge_probe(df: DataFrame, vector: str, dims: int, label: str, train: str, penalty: float) -> DataFrame:
    """One-vs-rest ridge regression on standardised embeddings; balanced accuracy on rows not in training.

    The Gram matrix and class sums are summed in the tasks, dims x dims numbers each; the solve is of
    that size on the driver.
    """
    import numpy as np

    classes = [r[0] for r in df.select(label).distinct().orderBy(label).collect()]

    def sums(batches):
        import pandas as pd

        for pdf in batches:
            x = np.c_[np.stack(pdf["v"]).astype(float), np.ones(len(pdf))]
            y = (pdf["y"].to_numpy()[:, None] == np.array(classes)[None]).astype(float)
            yield pd.DataFrame({"k": range(dims + 1), "row": list(np.c_[x.T @ x, x.T @ y])})

    parts = df.where(train).select(F.col(vector).alias("v"), F.col(label).alias("y")).mapInPandas(sums, "k int, row array<double>")
    total = parts.select("k", F.posexplode("row").alias("c", "x")).groupBy("k", "c").agg(F.sum("x").alias("x")).collect()
    m = np.zeros((dims + 1, dims + 1 + len(classes)))
    for r in total:
        m[r.k, r.c] = r.x
    n = m[dims, dims]
    mean, var = m[:dims, dims] / n, m[range(dims), range(dims)] / n - (m[:dims, dims] / n) ** 2
    sd = np.sqrt(np.maximum(var, 1e-12))
    gram = (m[:dims, :dims] - n * np.outer(mean, mean)) / np.outer(sd, sd)
    right = (m[:dims, dims + 1 :] - np.outer(mean, m[dims, dims + 1 :])) / sd[:, None]
    w = np.linalg.solve(gram + penalty * np.eye(dims), right) / sd[:, None]
    base = m[dims, dims + 1 :] / n - mean @ w
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    scores = [F.lit(float(base[k])) + F.aggregate(F.zip_with(x, F.array(*[F.lit(float(c)) for c in w[:, k]]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b) for k in range(len(classes))]
    best = F.array_position(F.array(*scores), F.array_max(F.array(*scores)))
    held = df.where(f"NOT ({train})").select(label, F.element_at(F.array(*[F.lit(c) for c in classes]), best.cast("int")).alias("guess"))
    each = held.groupBy(label).agg(F.count("*").alias("n"), F.avg((F.col("guess") == F.col(label)).cast("double")).alias("recall"))
    return each.select(label, "n", "recall", F.avg("recall").over(Window.partitionBy(F.lit(0))).alias("balanced_accuracy"))
