"""The corpus pipeline: toxicity, line dedup, near-duplicates, mixing, tokens. Each stage works on all that the one before it kept."""

from __future__ import annotations

from plumbline.llm import linededup, mixing, shared, simhash, toxicity
from plumbline.llm.common import documents, forget, scratch, written
from plumbline.llm.pieces import encode_decode
from plumbline.llm.queries import _held_out, mixed, piece_model_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more go; the network is trained on the labelled ones among them."""
    net = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~_held_out(4, 2))
    return toxicity.kept(docs, net, 0.3)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go from the texts, and n_chars follows; every document stays, if empty."""
    got = linededup.remove_repeated_lines(docs)
    return got.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest id: candidates come from the Gray-order index of SimHash fingerprints, and are linked if they share 0.8 of their distinct five-word shingles, counted exactly."""
    return simhash.standing(docs, shared.near_duplicates(docs.where(F.col("doc_id").isNotNull()), shingle=5, likeness=0.8))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights take them."""
    return mixing.taken(docs, mixed(docs))


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each whole text, how many, and the text that they decode to."""
    got = encode_decode(docs, piece_model_path())
    return got.select(F.col("id").alias("doc_id"), F.col("decoded").alias("text"), F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("toxicity", without_toxic), ("line dedup", without_repeated_lines), ("simhash near-dedup", without_near_duplicates), ("mixing", mixed_sources), ("sentencepiece", as_tokens)]
#: The toxicity network has no form in SQL; the pipeline is tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each on what the one before it kept; a stage's own tables and its input go when its result is written."""
    docs, before = documents(spark, sf_dir), []
    for name, stage in STAGES:
        with scratch(spark) as made:
            docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            result = made.pop()
        forget(spark, *before)
        before = [result]
    return docs
