"""Deterministic samples, splits and quotas; sets and overlaps between runs. Draws come from digests, so every engine repeats them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.numeric import correlation, hash_draw, ratio
from plumbline.operators.graphs import settled


def even_spread(n: Column, k: int) -> Column:
    """Indices spread evenly over n: all when n <= k, [0] for k = 1, else round-half-even of i (n-1) / (k-1)."""
    some = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (n - 1) / F.lit(float(max(1, k - 1)))).cast("int"))
    return F.when(n <= k, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array(F.lit(0)) if k == 1 else F.array_distinct(some))


def ordinal(df: DataFrame, keys: list[str], order: list[str | Column], name: str = "ord") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def global_rank(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """1-based rank over the whole table without gathering it: ranges of the order, ranks inside each, and the counts of the ranges before. The offsets have a row for each partition."""
    ranged = settled(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    counts = ranged.groupBy("__p").agg(F.count("*").alias("n"))
    ahead = counts.select("__p", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__ahead"))
    inside = ranged.withColumn("__k", F.row_number().over(Window.partitionBy("__p").orderBy(*order)))
    return inside.join(F.broadcast(ahead), "__p").withColumn(name, F.col("__ahead") + F.col("__k")).drop("__p", "__k", "__ahead")


def rotated(df: DataFrame, keys: list[str], order: str, by: int) -> DataFrame:
    """The cyclic shift of an order by ``by`` places, as a new order from 0."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return ordinal(df, keys, [order], "__o").withColumn("rotated", F.pmod(F.col("__o") - 1 - by, n)).drop("__o")


def split_parts(df: DataFrame, keys: list[str], order: str, k: int) -> DataFrame:
    """k disjoint interleaved parts: each block of k rows in order is dealt out, shifted by its digest."""
    out = ordinal(df, keys, [order], "__o").withColumn("block", F.floor((F.col("__o") - 1) / k))
    return out.withColumn("part", F.pmod(F.col("__o") - 1 + hash_draw("part", *[F.col(c) for c in keys], F.col("block")), F.lit(k))).drop("__o")


def budgeted(df: DataFrame, group: list[str], sub: str, order: list[str | Column], most: int, each: int) -> DataFrame:
    """The first ``most`` rows of each group with ``each`` of a sub-group at most, and whether the budget was met."""
    got = ordinal(df, [*group, sub], order, "__e").where(F.col("__e") <= each)
    got = ordinal(got, group, order, "taken").where(F.col("taken") <= most).drop("__e")
    return got.withColumn("complete", F.count("*").over(Window.partitionBy(*group)) == most)


def seeded_sample(df: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """n rows in the order of their digests."""
    return df.orderBy(hash_draw(seed, F.col(key)), key).limit(n)


def allocation(strata: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Quotas in proportion to counts by largest remainder, at least one and at most all of each stratum. The table has a row for each stratum."""
    w = Window.partitionBy(F.lit(0))
    out = strata.withColumn("exact", F.col(count) * float(total) / F.sum(count).over(w)).withColumn("floor", F.floor("exact"))
    spare = F.lit(total) - F.sum("floor").over(w)
    rank = F.row_number().over(w.orderBy(F.round(F.col("floor") - F.col("exact"), 9), key))
    return out.withColumn("quota", F.least(F.col(count), F.greatest(F.lit(1), F.col("floor") + (rank <= spare).cast("int"))).cast("long")).drop("exact", "floor")


def stratified(df: DataFrame, quotas: DataFrame, stratum: str, key: str, seed: str) -> DataFrame:
    """Each stratum's quota of rows by digest."""
    drawn = ordinal(df.withColumn("__h", hash_draw(seed, F.col(key))), [stratum], ["__h", key], "draw").drop("__h")
    return drawn.join(quotas.select(stratum, "quota"), stratum).where(F.col("draw") <= F.col("quota"))


def midpoint_ranks(df: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """Rows at floor((i + 1/2) n / k) of an ordered set; all when there are no more than k."""
    n = F.count("*").over(Window.partitionBy(*keys))
    rows = ordinal(df.withColumn("__n", n), keys, order, "__o").withColumn("place", F.col("__o") - 1)
    # place p is taken if some i has floor((2i + 1) n / 2k) = p
    i = F.floor((2 * k * (F.col("place") + 1) - 1 - F.col("__n")) / (2 * F.col("__n")))
    hit = (i >= 0) & (i < k) & (F.floor((2 * i + 1) * F.col("__n") / (2 * k)) == F.col("place"))
    return rows.where((F.col("__n") <= k) | hit).drop("__n", "__o")


def best_match(wanted: DataFrame, rows: DataFrame, keys: list[str], ok: str, score: str) -> DataFrame:
    """The best usable row with exactly the wanted identity: ok rows first, then the higher score. What is not found says why, and has no value."""
    best = ordinal(rows, keys, [F.desc(ok), F.desc_nulls_last(score)], "__k").where(F.col("__k") == 1).drop("__k")
    out = wanted.join(best.withColumn("__found", F.lit(True)), keys, "left")
    reason = F.when(F.col("__found").isNull(), "no row of this identity").when(~F.col(ok), "not usable").otherwise("matched")
    return out.withColumn("reason", reason).withColumn(score, F.when(F.col("reason") == "matched", F.col(score))).drop("__found")


def rank_bands(df: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """Best and worst rank of each key over orderings by several metrics, descending, ties by key."""
    tall = df.select(key, F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("t")).select(key, "t.m", "t.v")
    ranked = ordinal(tall, ["m"], [F.desc("v"), key], "rank")
    return ranked.groupBy(key).agg(F.min("rank").alias("best"), F.max("rank").alias("worst"))


def jaccard(a: DataFrame, b: DataFrame, key: str, item: str) -> DataFrame:
    """Common items of two tables for each key: how many, the Jaccard index, and whether the sets are disjoint."""
    both = a.select(key, item).distinct().withColumn("a", F.lit(1)).join(b.select(key, item).distinct().withColumn("b", F.lit(1)), [key, item], "full")
    out = both.groupBy(key).agg(F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("common"))
    return out.withColumn("jaccard", ratio(F.col("common"), F.col("n_a") + F.col("n_b") - F.col("common"))).withColumn("disjoint", F.col("common") == 0)


def robust_members(views: DataFrame, view: str, item: str) -> DataFrame:
    """Each item of any view: robust if in all, else unstable."""
    n = views.select(view).distinct().agg(F.count("*").alias("views"))
    seen = views.select(view, item).distinct().groupBy(item).agg(F.count("*").alias("in"))
    return seen.crossJoin(F.broadcast(n)).select(item, "in", F.when(F.col("in") == F.col("views"), "robust").otherwise("unstable").alias("status"))


def set_checks(a: DataFrame, b: DataFrame, item: str) -> DataFrame:
    """Equal, disjoint, contained: over the distinct items of both."""
    both = a.select(item).distinct().withColumn("a", F.lit(True)).join(b.select(item).distinct().withColumn("b", F.lit(True)), item, "full")
    both = both.agg(F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"), F.count_if(F.col("a") & F.col("b")).alias("common"))
    return both.select("*", ((F.col("only_a") == 0) & (F.col("only_b") == 0)).alias("equal"), (F.col("common") == 0).alias("disjoint"), (F.col("only_a") == 0).alias("contained"))


def _value_ranks(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """(__k0, ..., __v, name): the mean rank of each different value of the keys, NULL before others. Values are counted, and the counts summed up by ranges, so that no task holds a group; the sums ahead have a row for each range and keys."""
    ks = [f"__k{i}" for i in range(len(keys))]
    each = df.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, ks, strict=True)], F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    ranged = settled(each.repartitionByRange(*ks, "__v").withColumn("__p", F.spark_partition_id()))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    ahead = ranged.groupBy(*ks, "__p").agg(F.sum("__n").alias("__s"))
    ahead = ahead.select(*[F.col(k).alias(f"{k}a") for k in ks], F.col("__p").alias("__pa"), F.coalesce(F.sum("__s").over(upto(Window.partitionBy(*ks).orderBy("__p"))), F.lit(0)).alias("__ahead"))
    inside = ranged.withColumn("__in", F.coalesce(F.sum("__n").over(upto(Window.partitionBy(*ks, "__p").orderBy("__v"))), F.lit(0)))
    on = F.col("__p") == F.col("__pa")
    for k in ks:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}a"))
    return inside.join(ahead, on).select(*ks, "__v", (F.col("__ahead") + F.col("__in") + (F.col("__n") + 1) / 2.0).alias(name))


def _with_rank(df: DataFrame, ranks: DataFrame, keys: list[str], value: str) -> DataFrame:
    on = F.col(value).eqNullSafe(F.col("__v"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return df.join(ranks, on).drop("__v", *[f"__k{i}" for i in range(len(keys))])


def average_rank(df: DataFrame, keys: list[str], value: str, name: str = "rank") -> DataFrame:
    """1-based ranks, ties sharing their mean."""
    return _with_rank(df, _value_ranks(df, keys, value, name), keys, value)


def correlations(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Spearman (average ranks) and Pearson by group; NULL for fewer than three rows or no variance."""
    r = _with_rank(_with_rank(df, _value_ranks(df, keys, a, "__ra"), keys, a), _value_ranks(df, keys, b, "__rb"), keys, b)
    fine = lambda x, y, c: F.when((F.count("*") >= 3) & (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0), c)
    return r.groupBy(*keys).agg(F.count("*").alias("n"), fine(a, b, correlation("__ra", "__rb")).alias("spearman"), fine(a, b, correlation(a, b)).alias("pearson"))


#: A task makes about so many pairs.
TASK_PAIRS = 8_000_000


def pairs_within(rows: DataFrame, group: str, key: str) -> DataFrame:
    """Every two rows of a group with key1 < key2, columns suffixed 1 and 2. A group's first rows are dealt into as many parts as it has pairs for, and its others shown to each, so that no task makes all pairs of a large group."""
    n = F.count("*")
    parts = settled(rows.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("__g")).agg(F.ceil(n * n / TASK_PAIRS).alias("__parts")))
    tasks = max(1, min(10_000, int(parts.agg(F.sum("__parts")).first()[0] or 0)))
    side = lambda s: rows.select(*[F.col(c).alias(c + s) for c in rows.columns]).join(parts, F.col(group + s) == F.col("__g"))
    a = side("1").withColumn("__part", F.pmod(F.xxhash64(key + "1"), F.col("__parts"))).drop("__parts")
    b = side("2").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__parts") - 1))).drop("__parts")
    met = a.repartition(tasks, "__g", "__part").hint("merge").join(b.repartition(tasks, "__g", "__part"), ["__g", "__part"])
    return met.where(F.col(key + "1") < F.col(key + "2")).drop("__g", "__part")


def stability(runs: DataFrame, root: str, run: str, score: str, first: str, second: str, least: int = 3, top: int = 10) -> DataFrame:
    """Two runs on the roots that both have: shifts, rank agreement, overlap of the best, and a verdict."""
    a = runs.where(F.col(run) == first).select(root, F.col(score).alias("a"))
    b = runs.where(F.col(run) == second).select(root, F.col(score).alias("b"))
    both = a.join(b, root)
    best = lambda c: both.orderBy(F.desc(c), root).limit(top).select(root)
    common = best("a").join(best("b"), root).agg(F.count("*").alias("top_common"))
    d = F.col("b") - F.col("a")
    out = both.agg(F.count("*").alias("n"), F.avg(F.abs(d)).alias("mean_abs"), F.avg(d).alias("shift"), F.stddev_samp(d).alias("shift_sd"), correlation("a", "b").alias("pearson")).crossJoin(F.broadcast(common))
    return out.withColumn("verdict", F.when(F.col("n") < least, "INSUFFICIENT").when(F.col("mean_abs") <= 2, "PASS").otherwise("FAIL"))


def reliability(runs: DataFrame, root: str, score: str, spread: str, count: str, upto: int) -> DataFrame:
    """Variance between roots less what sampling explains, and the reliability predicted for each number of samples."""
    v = runs.groupBy(root).agg(F.avg(score).alias("m"), F.avg(F.pow(F.col(spread), F.lit(2)) / F.col(count)).alias("e"), F.avg(F.pow(F.col(spread), F.lit(2))).alias("within"))
    parts = v.agg(F.greatest(F.lit(0.0), F.var_samp("m") - F.avg("e")).alias("between"), F.avg("within").alias("within"))
    return parts.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(upto)))).withColumn("reliability", ratio(F.col("between"), F.col("between") + F.col("within") / F.col("n")))
