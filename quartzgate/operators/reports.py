"""Report rows: variant verdicts, reproduction checks, rescored populations, promotion, seed evidence, live blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import quantiles

TOLERANCE, BAND = 1e-4, 0.05


def verdict(low: Column, high: Column) -> Column:
    """better, worse or undecided, by where an interval lies."""
    return F.when(low > 0, "better").when(high < 0, "worse").otherwise("undecided")


def combined(verdicts: DataFrame) -> DataFrame:
    """Rows (variant, verdict): the verdict of all seeds where they agree, else mixed."""
    v = verdicts.groupBy("variant").agg(F.min("verdict").alias("a"), F.max("verdict").alias("b"))
    return v.select("variant", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise("mixed").alias("verdict"))


def not_reproduced(curve: DataFrame, published: DataFrame) -> DataFrame:
    """The points (policy, budget) whose quality differs from the published one by more than TOLERANCE, or is missing."""
    p = published.select("policy", "budget", F.col("quality").alias("published"))
    joined = p.join(curve.select("policy", "budget", "quality"), ["policy", "budget"], "left")
    return joined.where(F.coalesce(F.abs(F.col("quality") - F.col("published")) > TOLERANCE, F.lit(True)))


def curve_point(curve: DataFrame, policy: str, budget: float) -> DataFrame:
    """One row: the point of a policy at a budget; an error where there isn't exactly one."""
    point = curve.where((F.col("policy") == policy) & (F.abs(F.col("budget") - budget) < 1e-9))
    n = point.count()
    if n != 1:
        raise ValueError(f"{n} points of {policy} at {budget}")
    return point


def rescored(rows: DataFrame, threshold: float) -> DataFrame:
    """rows: (task, old_score, new_score, old_success, new_success). Per task how many decisions change at a threshold, how many
    stand near it, and what success does."""
    up = lambda c: F.col(c) >= threshold
    near = F.abs(F.col("old_score") - threshold) <= BAND
    return rows.groupBy("task").agg(
        F.count("*").alias("n"), F.count_if(up("old_score") != up("new_score")).alias("changed"), F.count_if(near).alias("near"),
        F.count_if(near & (up("old_score") != up("new_score"))).alias("changed_near"),
        (F.avg(F.col("new_success").cast("int")) - F.avg(F.col("old_success").cast("int"))).alias("success_change"),
    )


def seed_evidence(runs: DataFrame, candidate: float) -> DataFrame:
    """runs: (task, value). Per task mean, sample deviation and how many deviations the candidate lies above the mean."""
    s = runs.groupBy("task").agg(F.count("value").alias("runs"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("stdev"))
    return s.withColumn("z", F.try_divide(F.lit(candidate) - F.col("mean"), F.col("stdev")))


def promoted(history: DataFrame, candidate: DataFrame) -> DataFrame:
    """history: (version, component, digest); candidate: (component, digest). History with the candidate as next version;
    components that it doesn't name stay as in the latest one."""
    last = history.groupBy("component").agg(F.max_by("digest", "version").alias("old"))
    new = last.join(candidate, "component", "full").select("component", F.coalesce("digest", "old").alias("digest"))
    at = history.agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("version"))
    return history.unionByName(new.crossJoin(F.broadcast(at)).select(*history.columns))  # one row


def rolled_back(history: DataFrame, to: int) -> DataFrame:
    """History with version `to` again as the next one, so that no version is rewritten."""
    at = history.agg((F.max("version") + 1).alias("_v"))
    again = history.where(F.col("version") == to).crossJoin(F.broadcast(at)).withColumn("version", F.col("_v"))
    return history.unionByName(again.select(*history.columns))


def paired_systems(rows: DataFrame) -> DataFrame:
    """rows: (source, gold, a, b), b null where it gave nothing. Per source: accuracy of both where gold fits, and wins."""
    right = lambda c: F.coalesce(F.col(c) == F.col("gold"), F.lit(False))
    return rows.groupBy("source").agg(
        F.count("*").alias("n"), F.avg(right("a").cast("int")).alias("accuracy_a"), F.avg(right("b").cast("int")).alias("accuracy_b"),
        F.count_if(right("a") & ~right("b")).alias("wins_a"), F.count_if(right("b") & ~right("a")).alias("wins_b"),
    )


def shift_sides(rows: DataFrame, k: int, share: float = 0.1) -> DataFrame:
    """rows: (pair_id, task, cluster, chars). Adds in_held_cluster (per task the cluster whose size is nearest n / k, the lowest
    number of several), in_short_decile, in_long_decile, and side: shift where any holds, else in."""
    sizes = rows.groupBy("task", "cluster").agg(F.count("*").alias("_n"))
    total = quantiles.exact(rows, "chars", [share, 1 - share], ["task"]).select("task", F.col("n").alias("_all"), F.col("q").alias("_q"))
    w = Window.partitionBy("task").orderBy(F.abs(F.col("_n") - F.col("_all") / k), "cluster")
    held = sizes.join(total, "task").withColumn("_r", F.row_number().over(w)).where("_r = 1")
    joined = rows.join(held.select("task", F.col("cluster").alias("_held"), "_q"), "task")
    short, long = F.col("chars") <= F.col("_q")[0], F.col("chars") >= F.col("_q")[1]
    flags = joined.withColumn("in_held_cluster", F.col("cluster") == F.col("_held")).withColumn("in_short_decile", short).withColumn("in_long_decile", long)
    side = F.when(F.col("in_held_cluster") | F.col("in_short_decile") | F.col("in_long_decile"), "shift").otherwise("in")
    return flags.withColumn("side", side).drop("_held", "_q")


def request_splits(rows: DataFrame, group: Column, key: str, shares: tuple[float, float] = (0.1, 0.1)) -> DataFrame:
    """`rows` with `split` by the hash of the group, so that a request is on one side whatever generators answered it."""
    unit = F.conv(F.substring(F.md5(F.concat(group, F.lit("|20260909"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    split = F.when(unit < shares[0], "holdout_a").when(unit < sum(shares), "holdout_b").otherwise("train")
    return rows.withColumn("split", split)
