"""Reviews, reruns, gauges and preflights: two tables held against each other, with a reason for all that does not fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a reviewer may say of a target; only the first changes its value.
DECISIONS = ("annotation_corrected", "patch_issue", "no_issue", "uncertain")


def _sides(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Both tables by key, as the structs __a and __b (NULL where a side has no row), with __a_n and __b_n, how many rows each side has of the key. Of rows that repeat a key the smallest is taken."""
    one = lambda df, name: df.groupBy(*keys).agg(F.min(F.struct(*[c for c in df.columns if c not in keys])).alias(name), F.count("*").alias(f"{name}_n"))
    return one(left, "__a").join(one(right, "__b"), keys, "full_outer").fillna(0, ["__a_n", "__b_n"])


def _reasons(*tests: tuple[str, Column]) -> Column:
    """The names of the tests that hold, in the order given."""
    return F.filter(F.array(*[F.when(F.coalesce(test, F.lit(False)), name) for name, test in tests]), lambda x: x.isNotNull())


def review_ingest(original: DataFrame, reviewed: DataFrame, keys: list[str], value: str, position: list[str], decision: str, tolerance: float = 1e-6) -> dict[str, DataFrame]:
    """A reviewed bundle against the original: ``ledger`` (keys, status, before, after, reasons) and ``verdict``, one row.

    Both have keys, value and position, the reviewed one a decision. Both must have the same targets, once
    each, with one of DECISIONS; the value changes if and only if it is annotation_corrected, and the
    position comes back within ``tolerance``. Any violation refuses the whole batch.
    """
    s = _sides(original.select(*keys, F.col(value).alias("value"), *position), reviewed.select(*keys, F.col(value).alias("value"), *position, F.col(decision).alias("decision")), keys)
    both, same = (F.col("__a_n") > 0) & (F.col("__b_n") > 0), F.col("__a.value").eqNullSafe(F.col("__b.value"))
    moved = F.exists(F.array(*[~F.coalesce((F.abs(F.col(f"__a.{p}") - F.col(f"__b.{p}")) <= tolerance) | (F.col(f"__a.{p}").isNull() & F.col(f"__b.{p}").isNull()), F.lit(False)) for p in position]), lambda x: x)
    why = _reasons(
        ("repeated", (F.col("__a_n") > 1) | (F.col("__b_n") > 1)),
        ("not_reviewed", F.col("__b_n") == 0),
        ("not_in_original", F.col("__a_n") == 0),
        ("no_decision", (F.col("__b_n") > 0) & ~F.coalesce(F.col("__b.decision").isin(*DECISIONS), F.lit(False))),
        ("not_changed", both & (F.col("__b.decision") == DECISIONS[0]) & same),
        ("changed", both & (F.col("__b.decision") != DECISIONS[0]) & ~same),
        ("moved", both & moved),
    )
    ledger = s.select(*keys, F.col("__b.decision").alias("status"), F.col("__a.value").alias("before"), F.col("__b.value").alias("after"), why.alias("reasons"))
    wrong = F.size("reasons") > 0
    counts = [F.count_if(F.col("status") == d).alias(d) for d in DECISIONS]
    verdict = ledger.agg(F.count("*").alias("targets"), *counts, F.count_if(wrong).alias("violations"))
    return {"ledger": ledger, "verdict": verdict.withColumn("accepted", (F.col("violations") == 0) & (F.col("targets") > 0))}


def rerun_comparison(before: DataFrame, after: DataFrame, correction: DataFrame, keys: list[str], value: str, tolerance: float = 0.0) -> DataFrame:
    """(keys, before, after, delta, declared, reasons): the inputs of two runs, which must be equal but for what ``correction`` (keys, value) declares; a correction must be there in the later run, and change something."""
    s = _sides(before.select(*keys, F.col(value).alias("v")), after.select(*keys, F.col(value).alias("v")), keys)
    told = correction.groupBy(*keys).agg(F.min(value).alias("declared"), F.lit(True).alias("__told"))
    s = s.join(told, keys, "full_outer").fillna(0, ["__a_n", "__b_n"])
    b, a, said = F.col("__a.v"), F.col("__b.v"), F.coalesce("__told", F.lit(False))
    same = lambda x, y: x.eqNullSafe(y) | F.coalesce(F.abs(x - y) <= tolerance, F.lit(False))
    why = _reasons(
        ("repeated", (F.col("__a_n") > 1) | (F.col("__b_n") > 1)),
        ("only_before", (F.col("__a_n") > 0) & (F.col("__b_n") == 0)),
        ("only_after", (F.col("__a_n") == 0) & (F.col("__b_n") > 0)),
        ("correction_of_nothing", said & (F.col("__a_n") == 0)),
        ("undeclared_change", ~said & (F.col("__a_n") > 0) & (F.col("__b_n") > 0) & ~same(b, a)),
        ("not_applied", said & (F.col("__b_n") > 0) & ~same(F.col("declared"), a)),
        ("no_correction", said & (F.col("__a_n") > 0) & same(b, F.col("declared"))),
    )
    return s.select(*keys, b.alias("before"), a.alias("after"), (a - b).alias("delta"), "declared", why.alias("reasons"))


def target_deltas(before: DataFrame, after: DataFrame, key: str, measures: list[str]) -> DataFrame:
    """(key, side, measure_delta...): targets of two runs side by side: both, before or after only."""
    s = _sides(before.select(key, *measures), after.select(key, *measures), [key])
    side = F.when(F.col("__b_n") == 0, "before").when(F.col("__a_n") == 0, "after").otherwise("both")
    return s.select(key, side.alias("side"), *[(F.col(f"__b.{m}") - F.col(f"__a.{m}")).alias(f"{m}_delta") for m in measures])


def winding_neighbours(samples: DataFrame, surfaces: DataFrame, sample: str, expected: str, winding: str, distance: str, reach: int = 2) -> DataFrame:
    """(sample, expected, delta, d): which of the surfaces expected - ``reach`` to expected + ``reach`` is nearest to each sample; ties go to the smaller |delta|, then the smaller delta. NULL where none of them has a distance. surfaces: sample, winding, distance."""
    near = surfaces.where(F.col(distance).isNotNull()).select(sample, winding, distance)
    met = samples.select(sample, expected).join(near, sample).withColumn("delta", F.col(winding) - F.col(expected)).where(F.abs("delta") <= reach)
    best = met.groupBy(sample, expected).agg(F.min(F.struct(F.col(distance).alias("d"), F.abs("delta").alias("far"), "delta")).alias("x"))
    return samples.select(sample, expected).distinct().join(best, [sample, expected], "left").select(sample, expected, "x.delta", "x.d")


def producer_gauge(truth: DataFrame, answers: DataFrame, producer: str, a: str, b: str, d: str, coverage: float, exact: float) -> DataFrame:
    """(producer, answered, unknown, repeated, coverage, exact, within_one, mean, median, admissible): each producer's answers for pairs against the truth, which is looked up either way round with the sign turned.

    Answers for pairs without a truth are unknown, further answers of a producer for one pair repeated;
    neither counts. admissible: at least the given coverage of all true pairs and share of exact answers.
    """
    turned = F.col(a) > F.col(b)
    pair = [F.least(a, b).alias("__p"), F.greatest(a, b).alias("__q"), F.when(turned, -F.col(d)).otherwise(F.col(d)).alias("__v")]
    true = truth.select(*pair).groupBy("__p", "__q").agg(F.min("__v").alias("__t"))
    given = answers.select(producer, *pair).groupBy(producer, "__p", "__q").agg(F.min("__v").alias("__v"), F.count("*").alias("__n"))
    met = given.join(true, ["__p", "__q"], "left").withColumn("__r", F.abs(F.col("__v") - F.col("__t")))
    known = F.col("__t").isNotNull()
    g = met.groupBy(producer).agg(F.count_if(known).alias("answered"), F.count_if(~known).alias("unknown"), F.coalesce(F.sum(F.when(known, F.col("__n") - 1)), F.lit(0)).alias("repeated"), F.avg(F.when(known, (F.col("__r") == 0).cast("double"))).alias("exact"), F.avg(F.when(known, (F.col("__r") <= 1).cast("double"))).alias("within_one"), F.avg("__r").alias("mean"), F.median("__r").alias("median"))
    g = g.join(true.agg(F.count("*").alias("all"))).withColumn("coverage", F.when(F.col("all") > 0, F.col("answered") / F.col("all"))).drop("all")
    return g.withColumn("admissible", F.coalesce((F.col("coverage") >= coverage) & (F.col("exact") >= exact), F.lit(False)))


def region_preflight(expected: DataFrame, reports: DataFrame, region: str) -> DataFrame:
    """(region, status, reasons): one row for each expected region (region, split, checkpoint), ready or failed with its reasons, and a failed one for each region that was reported but not expected. reports: region, split, held_out, overlap, checkpoint, ready, digest."""
    s = _sides(expected.select(region, "split", "checkpoint"), reports.select(region, "split", "held_out", "overlap", "checkpoint", "ready", "digest"), [region])
    there = (F.col("__a_n") > 0) & (F.col("__b_n") > 0)
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    why = _reasons(
        ("not_expected", F.col("__a_n") == 0),
        ("no_report", F.col("__b_n") == 0),
        ("repeated", (F.col("__a_n") > 1) | (F.col("__b_n") > 1)),
        ("wrong_split", there & ~F.col("__a.split").eqNullSafe(F.col("__b.split"))),
        ("not_held_out", there & ~yes("__b.held_out")),
        ("overlap", there & ~F.col("__b.overlap").eqNullSafe(F.lit("none"))),
        ("wrong_checkpoint", there & ~F.col("__a.checkpoint").eqNullSafe(F.col("__b.checkpoint"))),
        ("not_ready", there & ~yes("__b.ready")),
        ("no_digest", there & ~F.coalesce(F.col("__b.digest").rlike("^[0-9a-f]{64}$"), F.lit(False))),
    )
    return s.select(region, why.alias("reasons")).withColumn("status", F.when(F.size("reasons") == 0, "ready").otherwise("failed"))


def manifest_drift(reference: DataFrame, derived: DataFrame, key: str, numbers: list[str], texts: list[str], tolerance: float = 1e-6) -> DataFrame:
    """(key, field, left, right): targets that one manifest alone has (field only_left or only_right), and fields that differ, numbers by more than ``tolerance``."""
    s = _sides(reference.select(key, *numbers, *texts), derived.select(key, *numbers, *texts), [key])
    both = (F.col("__a_n") > 0) & (F.col("__b_n") > 0)
    apart = lambda c: ~(F.coalesce(F.abs(F.col(f"__a.{c}") - F.col(f"__b.{c}")) <= tolerance, F.lit(False)) | (F.col(f"__a.{c}").isNull() & F.col(f"__b.{c}").isNull()))
    row = lambda test, name, left, right: F.when(test, F.struct(F.lit(name).alias("field"), left.cast("string").alias("left"), right.cast("string").alias("right")))
    none = F.lit(None)
    rows = [row(F.col("__b_n") == 0, "only_left", none, none), row(F.col("__a_n") == 0, "only_right", none, none)]
    rows += [row(both & apart(c), c, F.col(f"__a.{c}"), F.col(f"__b.{c}")) for c in numbers]
    rows += [row(both & ~F.col(f"__a.{c}").eqNullSafe(F.col(f"__b.{c}")), c, F.col(f"__a.{c}"), F.col(f"__b.{c}")) for c in texts]
    return s.select(key, F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("x")).select(key, "x.*")
