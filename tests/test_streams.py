"""Ledgers in event order and censuses that are stopped and taken up again."""

import random
import tempfile
from collections import Counter
from datetime import datetime, timedelta

import pytest
from plumbline import catalog
from plumbline.streaming import trackers
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
SCHEMA = "k string, ts timestamp, e long, a double"
START = datetime(2024, 1, 1)


def loop(rows, cap):
    total, out = Counter(), {}
    for k, ts, e, a in sorted((r for r in rows if r[3] is not None), key=lambda r: (r[1], r[2])):
        ok = total[k] + a <= cap
        total[k] += a if ok else 0.0
        out[k, e] = (ok, round(total[k], 6))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_any_landing_order_and_split_gives_one_ledger(spark, seed):
    rng = random.Random(0)
    rows = [(rng.choice(["x", "y", "z", None]), START + timedelta(seconds=rng.randrange(3000), microseconds=rng.randrange(10**6)), e, float(rng.randint(1, 9))) for e in range(200)] + [("x", START, 900, 1.0), ("x", START, 901, 1.0)]
    land, rest = random.Random(seed), list(rows)
    land.shuffle(rest)
    path = tempfile.mkdtemp(prefix="spark-")
    while rest:
        n = land.randint(1, 80)
        spark.createDataFrame(rest[:n], SCHEMA).coalesce(1).write.mode("append").parquet(path)
        rest = rest[n:]
    spark.createDataFrame([(None, START + timedelta(days=9), None, None)], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    df = trackers.with_state_store(spark).readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    out = trackers.drained(trackers.ordered_ledger(df, "k", "ts", "e", "a", 150.0, "2 hours"), tempfile.mkdtemp(prefix="spark-"), "append", "x")
    got = {(r.k, r.e): (r.accepted, round(r.total, 6)) for r in out.collect()}
    assert got == loop(rows, 150.0) and {ok for ok, _ in got.values()} == {True, False}


def test_ordered_ledger_query_is_the_loop(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/events.parquet").select("user_id", F.col("ts").cast("timestamp"), "event_id", "value").collect()]
    got = {(r.user_id, r.event_id): r.accepted for r in catalog.queries()["k02_ordered_ledger"](spark, DATA).collect()}
    assert got == {k: ok for k, (ok, _) in loop(rows, 1500.0).items()}


def test_a_stopped_census_is_taken_up_again(spark, monkeypatch):
    """The second batch fails after it has written; the next run writes it again and goes on."""
    path, ledger = tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-")
    rows = [(k % 4, f"o{k}", k % 5, f"f{k % 6}") for k in range(120)]
    schema = "level long, key string, size long, file string"
    for f in range(6):
        spark.createDataFrame([r for r in rows if r[3] == f"f{f}"], schema).coalesce(1).write.mode("append").parquet(path)
    declared = spark.createDataFrame([(0, 2), (1, 4), (2, None)], "level long, expected long")
    objects = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    real, calls = trackers.census_status, []

    class Late:
        """What is written, and then an end of the process."""

        def __init__(self, df):
            self.df, self.write = df, self

        def mode(self, _):
            return self

        def parquet(self, to):
            self.df.write.mode("overwrite").parquet(to)
            raise RuntimeError("stopped")

    def failing(*a):
        calls.append(1)
        return Late(real(*a)) if len(calls) == 2 else real(*a)

    monkeypatch.setattr(trackers, "census_status", failing)
    with pytest.raises(Exception, match="stopped"):
        trackers.land_census(objects, declared, "level", "size", ledger)
    trackers.land_census(objects, declared, "level", "size", ledger)
    status = lambda r: "unverified" if r[0] == 3 else "not_applicable" if r[0] == 2 else "ok" if r[2] == {0: 2, 1: 4}[r[0]] else "mismatch"
    want = Counter((r[0], status(r)) for r in rows)
    assert {(r.level, r.status): r.n for r in trackers.census_counts(spark, ledger, "level").collect()} == want
    assert spark.read.parquet(f"{ledger}/ledger").select("file", "key").distinct().count() == 120 and len(calls) == 7
