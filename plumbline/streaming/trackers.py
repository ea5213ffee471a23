"""The toolkit's incremental counters as Structured Streaming queries; on the same rows they end where the batch operators do."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def stream(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.readStream.schema(like.schema).parquet(path)


def activation(df: DataFrame, term: str, value: str, time: str) -> DataFrame:
    """Per term: evaluations, finite and non-zero values, sum, maximum. Late rows are governed by the watermark; state is a row for each term."""
    v = F.col(value)
    return df.withWatermark(time, "10 minutes").groupBy(term).agg(F.count("*").alias("evaluations"), F.count_if(~F.isnan(v)).alias("finite"), F.count_if(v != 0).alias("nonzero"), F.sum(v).alias("total"), F.max(v).alias("peak"))


def capped_ledger(df: DataFrame, key: str, order: str, entry: str, amount: str, cap: float) -> DataFrame:
    """(key, entry, amount, total, accepted): an entry that would take its ledger beyond the cap is refused and not counted. State is one total for each ledger."""

    def update(k: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        total = state.get[0] if state.exists else 0.0
        rows = pd.concat(list(parts)).sort_values([order, entry])
        accepted, totals = [], []
        for a in rows[amount]:
            ok = total + a <= cap
            total += a if ok else 0.0
            accepted.append(ok)
            totals.append(total)
        state.update((total,))
        yield pd.DataFrame({key: k[0], entry: rows[entry].to_numpy(), amount: rows[amount].to_numpy(), "total": totals, "accepted": accepted})

    kind = dict(df.dtypes)
    return df.select(key, order, entry, amount).groupBy(key).applyInPandasWithState(update, f"{key} {kind[key]}, {entry} {kind[entry]}, {amount} double, total double, accepted boolean", "total double", "append", "NoTimeout")


class OrderedLedger(StatefulProcessor):
    """One ledger in the order of its entries' times: rows wait until the watermark has passed them, and only then are accepted or refused."""

    def __init__(self, key: str, entry: str, amount: str, cap: float, kind: str):
        self.names, self.cap, self.kind = (key, entry, amount), cap, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.total = handle.getValueState("total", "total double")
        self.waiting = handle.getListState("waiting", f"at long, entry {self.kind}, amount double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        _, entry, amount = self.names
        for part in rows:  # a chunk at a time, whatever the batch holds
            part = part[part[amount].notna()]
            if len(part):
                self.waiting.appendList(list(zip(part["micros_of_time"].tolist(), part[entry].tolist(), part[amount].tolist(), strict=True)))
                self.handle.registerTimer(int(part["micros_of_time"].min()) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [tuple(r) for r in self.waiting.get()]
        due, rest = sorted(r for r in rows if r[0] <= passed), [r for r in rows if r[0] > passed]
        if not due:
            return
        total = self.total.get()[0] if self.total.exists() else 0.0
        out = []
        for _, entry, amount in due:
            ok = total + amount <= self.cap
            total += amount if ok else 0.0
            out.append((None if key[1] else key[0], entry, amount, total, ok))
        self.total.update((total,))
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(min(r[0] for r in rest) // 1000 + 1)
        else:
            self.waiting.clear()
        got = pd.DataFrame(out, columns=[*self.names, "total", "accepted"])
        yield got.astype({self.names[0]: object}) if key[1] else got

    def close(self) -> None:
        pass


def ordered_ledger(df: DataFrame, key: str, time: str, entry: str, amount: str, cap: float, delay: str) -> DataFrame:
    """(key, entry, amount, total, accepted) in the order of (time, entry) within each ledger, whatever order and files the rows land in, as long as none is later than ``delay``; later ones are dropped by the watermark.

    An entry that would take its ledger beyond the cap is refused and not counted. Rows without an amount
    or an entry only move the watermark: one that is far in the future closes the books. State is a total and the rows that the
    watermark has not passed; it needs the RocksDB state store (``with_state_store``).
    """
    kind = dict(df.dtypes)
    # rows without a key are a ledger too, told apart by a flag: grouping keys are not null
    rows = df.withWatermark(time, delay).select(F.coalesce(key, F.lit(0).cast(kind[key])).alias(key), F.col(key).isNull().alias("keyless"), time, F.unix_micros(time).alias("micros_of_time"), F.coalesce(entry, F.lit(0).cast(kind[entry])).alias(entry), F.when(F.col(entry).isNotNull(), F.col(amount).cast("double")).alias(amount))
    schema = f"{key} {kind[key]}, {entry} {kind[entry]}, {amount} double, total double, accepted boolean"
    return rows.groupBy(key, "keyless").transformWithStateInPandas(OrderedLedger(key, entry, amount, cap, kind[entry]), schema, "append", "EventTime")


def with_state_store(spark: SparkSession) -> SparkSession:
    """The session with the state store that timers and lists need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def census_status(objects: DataFrame, declared: DataFrame, level: str, size: str) -> DataFrame:
    """``objects`` with status: ok or mismatch against what their level declares (level, expected), not_applicable where it declares no size, unverified where it is unknown."""
    known = declared.select(level, "expected", F.lit(True).alias("__known"))
    status = F.when(F.col("__known").isNull(), "unverified").when(F.col("expected").isNull(), "not_applicable").when(F.col(size) == F.col("expected"), "ok").otherwise("mismatch")
    return objects.join(known, level, "left").withColumn("status", status).drop("expected", "__known")


def land_census(objects: DataFrame, declared: DataFrame, level: str, size: str, path: str) -> None:
    """Audit all objects that have landed since the last run, in a ledger of a folder for each micro-batch (batch, file, level, key..., status).

    A batch that is run again, after a stop anywhere, writes its own folder again, so that no file is lost or counted twice. objects: a stream with a column ``file``.
    """

    def write(batch: DataFrame, number: int) -> None:
        census_status(batch, declared, level, size).write.mode("overwrite").parquet(f"{path}/ledger/batch={number}")

    objects.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def census_counts(spark: SparkSession, path: str, level: str) -> DataFrame:
    """(level, status, n, files) of a ledger so far."""
    return spark.read.parquet(f"{path}/ledger").groupBy(level, "status").agg(F.count("*").alias("n"), F.count_distinct("file").alias("files"))


def progressive_census(objects: DataFrame, declared: DataFrame, level: str, size: str) -> DataFrame:
    """Objects as they land, audited one by one against what their level declares, counted by level and status so far. declared: level, expected (NULL: compressed or of unknown type); it is static and joined to each batch. State is a row for each level and status."""
    known = declared.select(level, "expected", F.lit(True).alias("declared"))
    status = F.when(F.col("declared").isNull(), "unverified").when(F.col("expected").isNull(), "not_applicable").when(F.col(size) == F.col("expected"), "ok").otherwise("mismatch")
    return objects.join(known, level, "left").groupBy(level, status.alias("status")).agg(F.count("*").alias("n"))


def drained(df: DataFrame, path: str, mode: str, name: str) -> DataFrame:
    """All that is there now, run to its end: small complete results through a table in memory, appended rows through Parquet files."""
    spark = df.sparkSession
    w = df.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).outputMode(mode)
    if mode == "complete":
        w.format("memory").queryName(name).start().awaitTermination()
        return spark.table(name)
    w.format("parquet").option("path", f"{path}/rows").start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/rows")
