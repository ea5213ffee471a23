"""What the training-data operators share: written tables, joins that stand hot keys, text columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is heavy if it holds more than 1/HEAVY_KEYS of the rows, so at most HEAVY_KEYS keys are heavy.
HEAVY_KEYS = 512


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; one of our own only where none is set, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        at = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(at)
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


#: Paths given out inside the innermost open ``scratch``; threads have their own.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/plumbline-{name}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


def forget(spark: SparkSession, *paths: str) -> None:
    """Remove tables that nothing reads any more, wherever the shared folder is."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """The paths of all tables that this thread writes inside; what is left in the list at the end is removed."""
    made: list[str] = []
    outer = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(outer)
        forget(spark, *made)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage ends here, and a lost executor costs a reread."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def skew_join(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, spread: str, how: str = "left") -> DataFrame:
    """Equi-join on ``key`` where one key may hold a third of the rows of ``left``.

    ``right`` has one row for each key, and ``weight`` says how many rows of ``left`` have it, of
    ``total``. At most HEAVY_KEYS keys weigh more than ``total / HEAVY_KEYS``: only these are broadcast,
    a bound that does not depend on the data. All others meet in a shuffle, where the rows that have
    already met their heavy key are dealt out by ``spread``. ``weight`` is not returned.
    """
    cut = total // HEAVY_KEYS
    names = [c for c in right.columns if c not in (key, weight)]
    heavy = right.where(F.col(weight) > cut).select(F.col(key).alias("__k"), F.struct(*[F.col(c) for c in names], F.lit(1).alias("__one")).alias("__heavy"))
    light = right.where(F.col(weight) <= cut).select(F.col(key).alias("__k"), F.struct(*[F.col(c) for c in names], F.lit(1).alias("__one")).alias("__light"), F.lit(0).alias("__s"))
    met = left.join(F.broadcast(heavy), left[key] == heavy["__k"], "left").drop("__k")
    met = met.withColumn("__salt", F.when(F.col("__heavy").isNull() & F.col(key).isNotNull(), 0).otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(9973))))
    out = met.join(light, (met[key] == light["__k"]) & (met["__salt"] == light["__s"]), "left")
    got = F.coalesce("__heavy", "__light")
    if how == "inner":
        out = out.where(got.isNotNull())
    return out.select(*[left[c] for c in left.columns], *[got[c].alias(c) for c in names])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def doc_frame(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Two columns (id, text), whatever else the table has; null texts read as empty."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def slices(texts: list[str], chars: int):
    """Index ranges of consecutive texts with about ``chars`` characters each; a longer text stands alone."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > chars:
            yield start, i
            start, size = i, 0
        size += len(t)
    if texts:
        yield start, len(texts)
