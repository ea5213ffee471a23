"""Records that are accepted or refused whole: landmark registrations, model releases."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.numeric import finite, is_sha256, norm

SIDES = ("fixed", "moving")


def registrations(transforms: DataFrame, landmarks: DataFrame, keys: list[str], matrix: str, least: int = 4, ambiguity: float = 0.2) -> DataFrame:
    """A row a registration: which way its 3 x 4 matrix maps the landmarks, in which order of axes, and whether that is sure.

    transforms: keys, matrix (twelve numbers by rows). landmarks: keys, fx, fy, fz (fixed), mx, my, mz (moving).
    Both directions are tried, each with axes xyz and zyx; the residual of a landmark is the distance between the
    mapped point and its partner. Columns: keys, status, direction, axes, mean, worst (residuals of the best),
    runner_up (mean of the next), landmarks. status: accepted if the best mean is below ``ambiguity`` times the
    runner-up's, else ambiguous; malformed, few_landmarks, not_finite and singular say why nothing was tried, and
    then there is no direction. Ties go to moving_to_fixed, then xyz.
    """
    m = lambda r, c: F.get(F.col("__m"), F.lit(4 * r + c))
    x = transforms.select(*keys, F.transform(matrix, lambda v: v.cast("double")).alias("__m"))
    point = F.struct(*[F.array(*[F.col(f"{s[0]}{a}").cast("double") for a in "xyz"]).alias(s) for s in SIDES])
    both = x.join(landmarks.select(*keys, point.alias("__p")), keys, "left")
    ways = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(d).alias("direction"), F.lit(o).alias("axes")) for n, (d, o) in enumerate(product(("moving_to_fixed", "fixed_to_moving"), ("xyz", "zyx")))])
    tried = both.select(*keys, "__m", "__p", F.explode(ways).alias("w"))
    turned = lambda side: F.when(F.col("w.axes") == "xyz", F.col(f"__p.{side}")).otherwise(F.reverse(F.col(f"__p.{side}")))
    forth = F.col("w.direction") == "moving_to_fixed"
    tried = tried.withColumn("s", F.when(forth, turned("moving")).otherwise(turned("fixed"))).withColumn("d", F.when(forth, turned("fixed")).otherwise(turned("moving")))
    gap = norm([m(r, 0) * F.get("s", F.lit(0)) + m(r, 1) * F.get("s", F.lit(1)) + m(r, 2) * F.get("s", F.lit(2)) + m(r, 3) - F.get("d", F.lit(r)) for r in range(3)])
    flat = F.forall(F.concat("s", "d"), lambda v: F.coalesce(finite(v), F.lit(False)))
    each = tried.groupBy(*keys, "w").agg(F.avg(gap).alias("mean"), F.max(gap).alias("worst"), F.count("__p").alias("landmarks"), F.bool_and(F.col("__p").isNull() | flat).alias("fine"))
    best = each.groupBy(*keys).agg(F.min(F.struct("mean", "w.n", "w.direction", "w.axes", "worst")).alias("b"), F.sort_array(F.collect_list("mean")).alias("means"), F.max("landmarks").alias("landmarks"), F.bool_and("fine").alias("fine"))
    det = m(0, 0) * (m(1, 1) * m(2, 2) - m(1, 2) * m(2, 1)) - m(0, 1) * (m(1, 0) * m(2, 2) - m(1, 2) * m(2, 0)) + m(0, 2) * (m(1, 0) * m(2, 1) - m(1, 1) * m(2, 0))
    whole = F.forall("__m", lambda v: F.coalesce(finite(v), F.lit(False)))
    runner = F.get("means", F.lit(1))
    status = (
        F.when(F.col("__m").isNull() | (F.size("__m") != 12), "malformed")
        .when(F.col("landmarks") < least, "few_landmarks")
        .when(~whole | ~F.col("fine"), "not_finite")
        .when(F.abs(det) < 1e-12, "singular")
        .when(F.col("b.mean") < ambiguity * runner, "accepted")
        .otherwise("ambiguous")
    )
    out = x.join(best, keys).withColumn("status", status).withColumn("runner_up", runner)
    shown = F.col("status").isin("accepted", "ambiguous")
    told = {"direction": F.col("b.direction"), "axes": F.col("b.axes"), "mean": F.col("b.mean"), "worst": F.col("b.worst"), "runner_up": F.col("runner_up")}
    return out.select(*keys, "status", *[F.when(shown, v).alias(k) for k, v in told.items()], "landmarks")


def release_findings(releases: DataFrame, checkpoints: DataFrame, datasets: DataFrame, runs: DataFrame, held: DataFrame) -> DataFrame:
    """(release, code, subject): everything that is wrong with each release; a release without rows here is whole.

    releases: release, final (id of the final checkpoint), pseudo (pseudo-labels are declared), data_license (which
    weights must carry then). checkpoints: release, id, role, parents, data (arrays of ids), license, sha256.
    datasets: release, id, role (pseudo-label and iterative-label are made by a producer), producer (a checkpoint),
    license. runs: release, id, kind (training or inference), checkpoint, stochastic, seed, public. held: release,
    id, sha256 of what is there. NULL arrays are empty.

    Codes: duplicate_id; final_count (not one checkpoint of the role final, or not the declared one);
    unknown_parent, self_parent, unknown_data, unknown_producer, unknown_checkpoint (of a run); no_producer and
    producer_not_allowed (a pseudo-labelled dataset without, another with one); pseudo_missing and
    pseudo_undeclared (the release's word against its datasets); no_training (a checkpoint without a training run)
    and no_inference (a final or producing one without an inference run); no_seed (stochastic, without a seed);
    not_public; license; digest (no SHA-256), not_held and held_differs (what is there has another). All are
    lookups by (release, id): joins on both, so no release is brought together in a task.
    """
    made = F.col("role").isin("pseudo-label", "iterative-label")
    named = checkpoints.select("release", F.col("id").alias("ref")).where("ref IS NOT NULL").distinct().withColumn("there", F.lit(True))
    stocked = datasets.select("release", F.col("id").alias("ref")).where("ref IS NOT NULL").distinct().withColumn("there", F.lit(True))

    def out(df: DataFrame, code: str, subject: Column) -> DataFrame:
        return df.select("release", F.lit(code).alias("code"), subject.cast("string").alias("subject"))

    def lost(df: DataFrame, ref: Column, known: DataFrame, code: str) -> DataFrame:
        asked = df.select("release", F.col("id").alias("subject"), ref.alias("ref")).where("ref IS NOT NULL")
        return out(asked.join(known, ["release", "ref"], "left_anti"), code, F.concat_ws(">", F.col("subject").cast("string"), F.col("ref").cast("string")))

    def missing(wanted: DataFrame, kind: str, code: str) -> DataFrame:
        done = runs.where(F.col("kind") == kind).select("release", F.col("checkpoint").alias("id"))
        return out(wanted.select("release", "id").distinct().join(done, ["release", "id"], "left_anti"), code, F.col("id"))

    found = []
    for table, name in ((checkpoints, "checkpoint"), (datasets, "dataset"), (runs, "run")):
        found.append(out(table.groupBy("release", "id").count().where("count > 1 OR id IS NULL"), "duplicate_id", F.concat(F.lit(name + " "), F.coalesce(F.col("id").cast("string"), F.lit("")))))
    finals = checkpoints.where("role = 'final'").groupBy("release").agg(F.count("*").alias("n"), F.min("id").alias("only"))
    sure = F.coalesce((F.col("n") == 1) & (F.col("only") == F.col("final")), F.lit(False))
    found.append(out(releases.join(finals, "release", "left").where(~sure), "final_count", F.coalesce("n", F.lit(0))))
    found.append(lost(checkpoints, F.explode("parents"), named, "unknown_parent"))
    found.append(out(checkpoints.where(F.array_contains("parents", F.col("id"))), "self_parent", F.col("id")))
    found.append(lost(checkpoints, F.explode("data"), stocked, "unknown_data"))
    found.append(lost(datasets, F.col("producer"), named, "unknown_producer"))
    found.append(lost(runs, F.col("checkpoint"), named, "unknown_checkpoint"))
    found.append(out(datasets.where(made & F.col("producer").isNull()), "no_producer", F.col("id")))
    found.append(out(datasets.where(~F.coalesce(made, F.lit(False)) & F.col("producer").isNotNull()), "producer_not_allowed", F.col("id")))
    pseudo = releases.join(datasets.where(made).select("release").distinct().withColumn("has", F.lit(True)), "release", "left")
    found.append(out(pseudo.where("pseudo AND has IS NULL"), "pseudo_missing", F.lit(None)))
    found.append(out(pseudo.where("NOT coalesce(pseudo, false) AND has"), "pseudo_undeclared", F.lit(None)))
    found.append(missing(checkpoints.where("id IS NOT NULL"), "training", "no_training"))
    using = checkpoints.where("role = 'final' AND id IS NOT NULL").select("release", "id").unionByName(datasets.where("producer IS NOT NULL").select("release", F.col("producer").alias("id")).join(named.select("release", F.col("ref").alias("id")), ["release", "id"], "left_semi"))
    found.append(missing(using, "inference", "no_inference"))
    found.append(out(runs.where("coalesce(stochastic, true) AND seed IS NULL"), "no_seed", F.col("id")))
    found.append(out(runs.where("NOT coalesce(public, false)"), "not_public", F.col("id")))
    licensed = checkpoints.select("release", "id", "license").unionByName(datasets.select("release", "id", "license")).join(releases.select("release", "pseudo", "data_license"), "release", "left")
    free = F.coalesce(F.col("license") != "", F.lit(False)) & (~F.coalesce(F.col("pseudo"), F.lit(False)) | F.coalesce(F.col("license") == F.col("data_license"), F.lit(False)))
    found.append(out(licensed.where(~free), "license", F.col("id")))
    found.append(out(checkpoints.where(~is_sha256(F.col("sha256"))), "digest", F.col("id")))
    local = checkpoints.where(is_sha256(F.col("sha256"))).join(held.select("release", "id", F.col("sha256").alias("found"), F.lit(True).alias("there")), ["release", "id"], "left")
    found.append(out(local.where("there IS NULL"), "not_held", F.col("id")))
    found.append(out(local.where("there AND NOT (found <=> sha256)"), "held_differs", F.col("id")))
    whole = found[0]
    for f in found[1:]:
        whole = whole.unionByName(f)
    return whole.distinct()

