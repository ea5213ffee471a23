"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations alone.

Weights go down a tree of domains, their languages and their sources. A child that cannot fill its
share gives the rest to its siblings; only what a whole family cannot take goes up to the family's
own siblings. Each leaf then draws its budget as a prefix of its documents in a seeded order, epoch
after epoch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import written

LEVELS = ("domain", "lang", "source")
#: Documents of a leaf that one prefix sum covers; longer leaves are summed in parts of about this many.
PART = 2_000


def word_count(text: Column) -> Column:
    """Words: runs of characters other than ASCII white space. Null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \t\n\r\f\x0b]+")), F.lit(0)).cast("long")


def poured(nodes: DataFrame, parents: list[str], budget: str, cap: str, weight: str, out: str) -> DataFrame:
    """Share the budget of each parent among its children by weight, no child above its cap.

    In the order of cap/weight, the children that fill up come first: child k fills up if its cap is
    within its weight's share of what all before it leave. The rest share what is left by weight.
    Children without weight get nothing. The table has one row for each node, never one for each document.
    """
    by = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    order = by.orderBy(F.when(F.col(weight) > 0, F.col(cap) / F.col(weight)).asc_nulls_last(), *LEVELS)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.col(budget) - F.coalesce(F.sum(F.when(F.col(weight) > 0, F.col(cap)).otherwise(0.0)).over(before), F.lit(0.0))
    share = F.sum(weight).over(by) - F.coalesce(F.sum(weight).over(before), F.lit(0.0))
    got = nodes.withColumn("__left", left).withColumn("__share", share)
    full = (F.col(weight) > 0) & (F.col(cap) * F.col("__share") <= F.col("__left") * F.col(weight))
    got = got.withColumn("__full", full)
    # what is left after the last child that fills up, and the weight that shares it
    spent = F.coalesce(F.sum(F.when(F.col("__full"), F.col(cap))).over(by), F.lit(0.0))
    sharing = F.sum(F.when(F.col("__full"), 0.0).otherwise(F.col(weight))).over(by)
    rest = F.when((F.col(weight) > 0) & (sharing > 0), (F.col(budget) - spent) * F.col(weight) / sharing).otherwise(0.0)
    return got.withColumn(out, F.when(F.col("__full"), F.col(cap)).otherwise(F.greatest(rest, F.lit(0.0)))).drop("__left", "__share", "__full")


def budgets(leaves: DataFrame, total: Column, weights: dict[str, Column], epochs: int) -> DataFrame:
    """(domain, lang, source, tokens, docs, grant): whole tokens granted to each leaf. leaves: tokens and docs of each leaf.

    ``weights[level]`` is the weight of a node among its siblings, an expression over the names of the
    node and its ancestors. A leaf's cap is ``epochs`` times its tokens.
    """
    node = leaves.withColumn("cap", F.col("tokens").cast("double") * epochs)
    for k in (2, 1):
        fam = Window.partitionBy(*LEVELS[:k])
        node = node.withColumn(f"cap_{LEVELS[k - 1]}", F.sum("cap").over(fam))
    domains = node.select("domain", F.col("cap_domain").alias("cap"), F.lit("").alias("lang"), F.lit("").alias("source")).distinct()
    domains = domains.withColumn("weight", weights["domain"].cast("double")).withColumn("budget", total.cast("double"))
    domains = poured(domains, [], "budget", "cap", "weight", "got").select("domain", F.col("got").alias("budget"))
    langs = node.select("domain", "lang", F.col("cap_lang").alias("cap"), F.lit("").alias("source")).distinct().withColumn("weight", weights["lang"].cast("double"))
    langs = poured(langs.join(domains, "domain"), ["domain"], "budget", "cap", "weight", "got").select("domain", "lang", F.col("got").alias("budget"))
    sources = node.withColumn("weight", weights["source"].cast("double")).join(langs, ["domain", "lang"])
    sources = poured(sources, ["domain", "lang"], "budget", "cap", "weight", "got")
    return sources.select(*LEVELS, "tokens", "docs", F.floor(F.col("got") + 1e-6).alias("grant"))


def mix(docs: DataFrame, domain: Column, weights: dict[str, Column], share: float, epochs: int, seed: int, id_col: str = "doc_id", text_col: str = "text", lang: Column | None = None, source: Column | None = None, part: int = PART) -> DataFrame:
    """(id, domain, lang, source, tokens, copies): how often each document is taken, 0 included.

    The budget is ``share`` of all tokens (words). A leaf whose grant is g of t tokens passes
    whole g // t times and then takes, in the order of md5(seed:epoch:id), the longest prefix of
    documents whose tokens fit in the rest; the epoch's number makes another order. A document without
    words costs nothing and goes with those before it. Null names of a level are the name ''; rows
    without an id are ordered by '' and taken alike with rows of the same tokens; ties and repeated ids
    are ordered by tokens and then share one place, so all of them fit or none. An empty table gives no rows.
    """
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), name(domain).alias("domain"), name(F.col("lang") if lang is None else lang).alias("lang"), name(F.col("source") if source is None else source).alias("source"), word_count(F.col(text_col)).alias("tokens"))
    rows = written(rows, "tokens")
    leaves = rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))
    all_tokens = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    grants = written(budgets(leaves, F.lit(float(share * all_tokens)), weights, epochs), "grants")
    grants = grants.select(*LEVELS, F.when(F.col("tokens") > 0, F.floor(F.col("grant") / F.col("tokens"))).otherwise(F.when(F.col("grant") >= 0, 0)).alias("whole"), F.when(F.col("tokens") > 0, F.col("grant") % F.col("tokens")).otherwise(0).alias("rest"), F.greatest(F.lit(1), F.ceil(F.col("docs") / part)).cast("int").alias("parts"))
    # the table of grants has a row for each leaf; Spark broadcasts it only below its own size threshold
    rows = rows.join(grants, list(LEVELS))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    rows = rows.withColumn("key", key).withColumn("part", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / (1 << 32) * F.col("parts")).cast("int"))
    sums = rows.groupBy(*LEVELS, "part").agg(F.sum("tokens").alias("sum"))
    ahead = sums.withColumn("ahead", F.coalesce(F.sum("sum").over(Window.partitionBy(*LEVELS).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("sum")
    upto = F.sum("tokens").over(Window.partitionBy(*LEVELS, "part", "ahead").orderBy("key", "tokens"))
    placed = rows.join(ahead, [*LEVELS, "part"]).withColumn("upto", F.col("ahead") + upto)
    return placed.select("id", *LEVELS, "tokens", (F.col("whole") + (F.col("upto") <= F.col("rest")).cast("int")).cast("int").alias("copies"))


def taken(docs: DataFrame, copies: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` as often as ``mix`` takes them. Rows that repeat an id are taken as often as the most taken of them."""
    most = copies.groupBy("id").agg(F.max("copies").alias("copies")).where("copies > 0")
    # rows go as one column, so that their names cannot clash with others
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("key"))
    met = rows.join(most, rows["key"].eqNullSafe(most["id"]))
    return met.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def oracle(domain_weight: str, lang_weight: str, source_weight: str, share: float, epochs: int, seed: int) -> str:
    """The same in DuckDB's SQL over ``documents``, a source's number mod 4 being its domain; prefix sums run over whole leaves."""

    def pour(name: str, rows: str, parents: str, weight: str) -> str:
        return f"""
{name}_w AS (SELECT *, CAST({weight} AS DOUBLE) AS w FROM ({rows})),
{name}_o AS (SELECT *, budget - coalesce(sum(CASE WHEN w > 0 THEN cap ELSE 0 END) OVER o, 0) AS lft, sum(w) OVER ({parents}) - coalesce(sum(w) OVER o, 0) AS shr FROM {name}_w
  WINDOW o AS ({parents} ORDER BY CASE WHEN w > 0 THEN cap / w END NULLS LAST, domain, lang, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name}_f AS (SELECT *, w > 0 AND cap * shr <= lft * w AS full_ FROM {name}_o),
{name} AS (SELECT *, CASE WHEN full_ THEN cap WHEN w > 0 THEN greatest((budget - coalesce(sum(CASE WHEN full_ THEN cap END) OVER ({parents}), 0)) * w / nullif(sum(CASE WHEN full_ THEN 0 ELSE w END) OVER ({parents}), 0), 0) ELSE 0 END AS got FROM {name}_f)"""

    return rf"""
WITH r AS (SELECT doc_id, coalesce('d' || (try_cast(regexp_extract(source, '([0-9]+)', 1) AS INTEGER) % 4), '') AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  coalesce(len(regexp_extract_all(text, '[^ \t\n\r\f\x0b]+')), 0) AS tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(tokens) AS tokens, CAST(sum(tokens) AS DOUBLE) * {epochs} AS cap FROM r GROUP BY ALL),
{pour("pd", f"SELECT domain, '' AS lang, '' AS source, sum(cap) AS cap, {share} * (SELECT sum(tokens) FROM r) AS budget FROM leaf GROUP BY domain", "PARTITION BY 1", domain_weight)},
{pour("pl", "SELECT leaf.domain, leaf.lang, '' AS source, sum(leaf.cap) AS cap, any_value(pd.got) AS budget FROM leaf JOIN pd ON leaf.domain = pd.domain GROUP BY leaf.domain, leaf.lang", "PARTITION BY domain", lang_weight)},
{pour("ps", "SELECT leaf.*, pl.got AS budget FROM leaf JOIN pl ON leaf.domain = pl.domain AND leaf.lang = pl.lang", "PARTITION BY domain, lang", source_weight)},
g AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN CAST(floor(got + 1e-6) AS BIGINT) // CAST(tokens AS BIGINT) ELSE 0 END AS whole, CASE WHEN tokens > 0 THEN CAST(floor(got + 1e-6) AS BIGINT) % CAST(tokens AS BIGINT) ELSE 0 END AS rest FROM ps),
k AS (SELECT r.*, whole, rest, md5('{seed}:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM r JOIN g ON r.domain = g.domain AND r.lang = g.lang AND r.source = g.source)
SELECT doc_id, domain, lang, source, tokens, CAST(whole + CASE WHEN sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, tokens) <= rest THEN 1 ELSE 0 END AS INTEGER) AS copies FROM k
"""
