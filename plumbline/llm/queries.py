"""Thin queries over the operators of this folder, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import ann, linededup, mixing, parsing, phrases, quality, sitetree, suffixes, toxicity, warc, whitening
from plumbline.llm.common import documents
from plumbline.llm.pieces import encode_decode
from plumbline.llm.simhash import near_duplicates


def piece_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _held_out(mod: int, rest: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % mod == rest, F.lit(False))


def _judged(scores: DataFrame, mod: int, rest: int) -> DataFrame:
    got = scores.withColumnRenamed("id", "doc_id")
    return got.select("doc_id", _held_out(mod, rest).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _judged(toxicity.score(docs, toxicity.train(docs, labels, ~_held_out(4, 2))), 4, 2)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _judged(quality.score(docs, quality.train(docs, labels, ~_held_out(5, 0))), 5, 0)


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir), shingle=4, radius=4)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = encode_decode(documents(spark, sf_dir), piece_model_path())
    return got.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_locally_consistent_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.compared(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.remove_repeated_lines(documents(spark, sf_dir)).select("doc_id", "text", "lines_before", "lines_removed")


MIX_SHARE, MIX_EPOCHS, MIX_SEED = 1.0, 2, 7


def mixed(docs: DataFrame) -> DataFrame:
    """The mix: a source's number mod 4 is its domain; weights of domains, of languages in each, of sources in each of those."""
    name, lang = F.col("domain"), F.col("lang")
    domain = F.concat(F.lit("d"), F.regexp_extract("source", "([0-9]+)", 1).try_cast("int") % 4)
    weights = {"domain": F.when(name == "d0", 4).when(name == "d1", 3).when(name == "d2", 2).otherwise(1), "lang": F.when(lang == "en", 3).when(lang.isin("de", "fr"), 2).otherwise(1), "source": F.lit(1)}
    return mixing.mix(docs, domain, weights, MIX_SHARE, MIX_EPOCHS, MIX_SEED)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.deduplicated(spark.read.parquet(f"{sf_dir}/pages.parquet"), least=0)
    return back.select(F.col("id").alias("page_id"), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.col("refers_to_id").alias("refers_to"))


#: base32 digits of 40 bits at a time are not at hand in SQL: the digest is spelt from its hex digits, five bits by five.
OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex FROM p),
b AS (SELECT page_id, payload_bytes, hex, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 +
  ((('0x' || substr(hex || '00', 1 + (5 * i) // 4, 3))::BIGINT >> (12 - 5 - (5 * i) % 4)) & 31)::INTEGER, 1)), '') AS payload_digest FROM d),
r AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS top FROM b)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM r
"""


def op2_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5).withColumnRenamed("id", "vec_id")


def op4_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sitetree.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return got.select(F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir), top=2000, least=10)


def op12_feast_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=8).withColumnRenamed("id", "vec_id")


def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = suffixes.without_repeats(documents(spark, sf_dir), size=200)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return got.select("doc_id", n_bytes.alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The contract's queries, by name."""
    made = (op1_warc_revisits, op2_permutation_index, op3_line_dedup, op4_site_style_tree, op5_toxicity, op6_quality, op7_simhash_near_dedup, op8_sentencepiece, op9_mixing, op10_locally_consistent_fingerprints, op11_phrase_collocations, op12_feast_whitening, op13_suffix_array_dedup)
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_revisits": OP1_SQL, "op3_line_dedup": linededup.ORACLE, "op11_phrase_collocations": phrases.ORACLE, "op9_mixing": mixing.oracle("CASE domain WHEN 'd0' THEN 4 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END", "CASE WHEN lang = 'en' THEN 3 WHEN lang IN ('de', 'fr') THEN 2 ELSE 1 END", "1", MIX_SHARE, MIX_EPOCHS, MIX_SEED)}
