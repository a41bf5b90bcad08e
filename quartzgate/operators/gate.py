"""Release gate: spreads of repeated runs, thresholds from them, drops, blocking reasons, pins and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import session

MULTIPLIER = 3.0


def spreads(runs: DataFrame) -> DataFrame:
    """runs: (task, split, metric, run, value). Rows (task, split, metric, runs, mean, spread, stdev): spread is the
    range; stdev, of the sample, is null below three runs."""
    return runs.groupBy("task", "split", "metric").agg(
        F.count("value").alias("runs"), F.avg("value").alias("mean"), (F.max("value") - F.min("value")).alias("spread"),
        F.when(F.count("value") >= 3, F.stddev_samp("value")).alias("stdev"),
    )


def thresholds(inference: DataFrame, training: DataFrame, multiplier: float = MULTIPLIER) -> DataFrame:
    """Both: (task, split, spread). Rows (task, split, floor, bound_by, threshold, provisional): the larger spread times
    the multiplier; null where no spread above zero is known; provisional where training was not measured."""
    i = inference.select("task", "split", F.col("spread").alias("inference_spread"))
    t = training.select("task", "split", F.col("spread").alias("training_spread"))
    both = i.join(t, ["task", "split"], "full")
    floor = F.greatest("inference_spread", "training_spread")
    known = floor > 0
    by = F.when(F.col("training_spread") >= F.coalesce("inference_spread", F.lit(0.0)), "training").otherwise("inference")
    return both.select(
        "task", "split", "inference_spread", "training_spread", floor.alias("floor"), F.when(known, by).alias("bound_by"),
        F.when(known, floor * multiplier).alias("threshold"), F.when(known, F.col("training_spread").isNull()).alias("provisional"),
    )


def enforced(derived: DataFrame) -> DataFrame:
    """Thresholds that gate: of the random split, and not provisional."""
    return derived.where("split = 'random' and threshold is not null and not provisional").select("task", "threshold")


def drops(candidate: DataFrame, baseline: DataFrame) -> DataFrame:
    """Both: (task, split, metric, value). Rows with `drop` = baseline - candidate, null where either is unmeasured."""
    b = baseline.withColumnRenamed("value", "baseline")
    c = candidate.withColumnRenamed("value", "candidate")
    return b.join(c, ["task", "split", "metric"], "full").withColumn("drop", F.col("baseline") - F.col("candidate"))


def blocking_reasons(dropped: DataFrame, gate: DataFrame, floors: DataFrame | None = None) -> DataFrame:
    """Rows (task, reason): drops of the random split beyond the task's threshold, and candidates below a floor
    (task, floor). An unmeasured drop blocks nothing."""
    random = dropped.where("split = 'random'")
    over = random.join(gate, "task").where(F.col("drop") > F.col("threshold")).select("task", F.lit("drop beyond threshold").alias("reason"))
    if floors is None:
        return over
    under = random.join(floors, "task").where("candidate < floor").select("task", F.lit("below prompted floor").alias("reason"))
    return over.unionByName(under)


def promotion_reasons(
    old: DataFrame, new: DataFrame, evidence: list[str], reports: DataFrame, regression: DataFrame | None = None, refreeze: str | None = None,
    limits: DataFrame | None = None, floors: DataFrame | None = None,
) -> DataFrame:
    """Rows (subject, reason): why a manifest can't replace the old one; none where there is no old one.

    old, new: (key, digest) with keys `components.<name>...` and `eval_splits.<name>`. A component that is new has moved from
    nothing and counts for nothing. Components named in `evidence` need a report of their own, of reports (component,
    found), all others a regression run, dropped as drops() gives it. Splits move only with a `refreeze`, and then no
    component may. limits (task, threshold): of an enforcing gate; without one no drop blocks.
    """
    if not old.limit(1).count():
        return old.sparkSession.createDataFrame([], "subject string, reason string")
    moved = session.materialize(manifest_diff(old, new), "manifest-diff")
    say = lambda df, subject, reason: df.select(F.col(subject).alias("subject"), F.lit(reason).alias("reason"))
    name = F.split("key", r"\.")[1]
    models = moved.where(F.col("key").startswith("components.") & F.col("old").isNotNull()).withColumn("component", name)
    splits = moved.where(F.col("key").startswith("eval_splits."))
    own = F.col("component").isin(evidence) if evidence else F.lit(False)
    told = models.where(own).select("component").distinct().join(reports, "component", "left")
    out = say(told.where("found is null"), "component", "moved without a report")
    out = out.unionByName(say(told.where("not found"), "component", "its report does not exist"))
    if regression is None:
        out = out.unionByName(say(models.where(~own), "key", "moved without a regression run"))
    if refreeze is None:
        out = out.unionByName(say(splits, "key", "split moved without a refreeze"))
    elif not splits.limit(1).count():
        out = out.unionByName(say(old.sparkSession.createDataFrame([(refreeze,)], "r string"), "r", "refreeze without a moved split"))
    else:
        out = out.unionByName(say(models, "key", "moved in a refreeze"))
    if regression is not None:
        if limits is not None:
            out = out.unionByName(blocking_reasons(regression, limits).select(F.col("task").alias("subject"), "reason"))
        if floors is not None:
            none = regression.select("task", F.lit(None).cast("double").alias("threshold")).limit(0)
            out = out.unionByName(blocking_reasons(regression, none, floors).select(F.col("task").alias("subject"), "reason"))
    return out


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both: (key, digest). Rows (key, old, new) that differ, absent ones as null."""
    a, b = old.select("key", F.col("digest").alias("old")), new.select("key", F.col("digest").alias("new"))
    return a.join(b, "key", "full").where(~F.col("old").eqNullSafe(F.col("new")))


def verify_pins(pins: DataFrame, observed: DataFrame) -> DataFrame:
    """pins: (repo, revision, digest); observed: (repo, revision, digest, main). Rows (repo, status)."""
    o = observed.select("repo", F.col("revision").alias("_rev"), F.col("digest").alias("_digest"), "main")
    status = (
        F.when(F.col("_rev").isNull(), "revision_gone")
        .when(F.col("_digest") != F.col("digest"), "weights_rewritten")
        .when(F.col("main") != F.col("revision"), "main_moved")
        .otherwise("ok")
    )
    return pins.join(o, (pins.repo == o.repo) & (pins.revision == o._rev), "left").select(pins.repo, status.alias("status"))


def next_version(history: DataFrame) -> DataFrame:
    """One row: the version after the largest one, 1 without any."""
    return history.agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("version"))


def combine_candidates(candidates: DataFrame) -> DataFrame:
    """candidates: (candidate, task, base, adapter). Rows (task, n, bases, conflict): a task given twice or different
    bases can't be combined."""
    bases = candidates.agg(F.countDistinct("base").alias("bases"))
    per = candidates.groupBy("task").agg(F.count("*").alias("n"))
    return per.crossJoin(F.broadcast(bases)).withColumn("conflict", (F.col("n") > 1) | (F.col("bases") > 1))
