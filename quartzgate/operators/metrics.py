"""Classification, ranking and agreement statistics as composed aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import quantiles, ranking


def label_counts(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Rows (label, tp, fp, fn, support) over the labels of gold and prediction, in one pass over the table."""
    hit = F.col(gold) == F.col(predicted)
    each = F.explode(
        F.array(
            F.struct(F.col(gold).alias("label"), F.lit(1).alias("g"), hit.cast("int").alias("t"), F.lit(0).alias("p")),
            F.struct(F.col(predicted).alias("label"), F.lit(0).alias("g"), F.lit(0).alias("t"), F.lit(1).alias("p")),
        )
    )
    sums = df.select(each.alias("e")).groupBy("e.label").agg(*[F.sum(f"e.{c}").alias(c) for c in "gtp"])
    return sums.select("label", F.col("t").alias("tp"), (F.col("p") - F.col("t")).alias("fp"), (F.col("g") - F.col("t")).alias("fn"), F.col("g").alias("support"))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """0 where nothing was found or sought."""
    return F.coalesce(F.try_divide(2.0 * tp, 2 * tp + fp + fn), F.lit(0.0))


def classification_report(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """One row: n, accuracy, macro_f1 over all labels seen, weighted_f1 by gold support."""
    each = label_counts(df, gold, predicted).withColumn("f1", f1(F.col("tp"), F.col("fp"), F.col("fn")))
    return each.agg(
        F.sum("support").alias("n"), (F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
    )


def ranking_report(df: DataFrame, score: str, positive: str, group: list[str] | None = None) -> DataFrame:
    """Rows (group..., n, base_rate, roc_auc, average_precision); both null where only one class occurs.

    Works on the distinct scores of each group, so ties count by the definitions: half for the area, one step
    for precision.
    """
    group = group or []
    p = F.col(positive).cast("int")
    each = df.groupBy(*group, score).agg(F.count("*").alias("c"), F.sum(p).alias("pos"))
    upto = ranking.running(each, score, group, {"cum": F.col("c"), "cum_pos": F.col("pos")})
    neg, cum_neg = F.col("c") - F.col("pos"), F.col("cum") - F.col("cum_pos")
    # pairs in which the positive stands above the negative: negatives of this score below earlier positives
    above = neg * (F.col("cum_pos") - F.col("pos")) + 0.5 * neg * F.col("pos")
    step = F.col("pos") * F.col("cum_pos") / F.col("cum")
    out = upto.withColumn("_cn", cum_neg).groupBy(*group).agg(
        F.sum("c").alias("n"), F.sum("pos").alias("_p"), F.sum(above).alias("_above"), F.sum(step).alias("_step")
    )
    both = F.col("_p") * (F.col("n") - F.col("_p"))
    return out.select(
        *group, "n", (F.col("_p") / F.col("n")).alias("base_rate"),
        F.when(both > 0, F.col("_above") / both).alias("roc_auc"),
        F.when(both > 0, F.col("_step") / F.col("_p")).alias("average_precision"),
    )


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, agreement, kappa of two boolean columns; kappa is null unless both vary."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    s = df.agg(F.count("*").alias("n"), F.avg((F.col(a) == F.col(b)).cast("int")).alias("agreement"), F.avg(x).alias("p"), F.avg(y).alias("q"))
    chance = F.col("p") * F.col("q") + (1 - F.col("p")) * (1 - F.col("q"))
    varies = (F.col("p") > 0) & (F.col("p") < 1) & (F.col("q") > 0) & (F.col("q") < 1)
    return s.select("n", "agreement", F.when(varies, (F.col("agreement") - chance) / (1 - chance)).alias("kappa"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, spearman, pearson; null for a constant column."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    r = ranking.average_rank(ranking.average_rank(both, a, "_ra"), b, "_rb")
    corr = lambda x, y: F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return r.agg(F.count("*").alias("n"), corr("_ra", "_rb").alias("spearman"), corr(a, b).alias("pearson"))


def grade_agreement(df: DataFrame, teacher: str, student: str, low: int = 1, high: int = 5) -> DataFrame:
    """One row: n, exact and within_one agreement of the rounded and clipped student, mae, bias."""
    t, s = F.col(teacher).cast("double"), F.col(student).cast("double")
    r = F.greatest(F.lit(low), F.least(F.lit(high), F.rint(s)))
    return df.agg(
        F.count("*").alias("n"), F.avg((r == t).cast("int")).alias("exact"), F.avg((F.abs(r - t) <= 1).cast("int")).alias("within_one"),
        F.avg(F.abs(s - t)).alias("mae"), F.avg(s - t).alias("bias"),
    )


def paired_comparison(df: DataFrame, a: str, b: str, least: int = 10, detail: bool = False) -> DataFrame:
    """One row: n, mean_diff, higher, lower, tied, and the signed-rank statistic w_plus with its normal
    approximation z (ties corrected); both null with fewer than `least` differences other than zero."""
    d = df.select((F.col(a) - F.col(b)).cast("double").alias("d")).where("d is not null")
    shares = d.agg(
        F.count("*").alias("n"), F.avg("d").alias("mean_diff"), F.avg((F.col("d") > 0).cast("int")).alias("higher"),
        F.avg((F.col("d") < 0).cast("int")).alias("lower"), F.avg((F.col("d") == 0).cast("int")).alias("tied"),
    )
    r = ranking.average_rank(d.where("d <> 0").withColumn("m", F.abs("d")), "m", "r")
    per = r.groupBy("m").agg(F.count("*").alias("c"), F.sum(F.when(F.col("d") > 0, F.col("r"))).alias("w"))
    c = F.col("c").cast("double")
    t = per.agg(F.sum("c").alias("k"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("w_plus"), F.sum(c * c * c - c).alias("ties"))
    k = F.col("k").cast("double")
    var = k * (k + 1) * (2 * k + 1) / 24 - F.col("ties") / 48
    z = F.try_divide(F.col("w_plus") - k * (k + 1) / 4, F.sqrt(var))
    enough = F.col("k") >= least
    return shares.crossJoin(t).select(
        "n", "mean_diff", "higher", "lower", "tied", F.when(enough, F.col("w_plus")).alias("w_plus"), F.when(enough, z).alias("z"),
        *([F.coalesce("k", F.lit(0)).alias("nonzero"), F.coalesce("ties", F.lit(0.0)).alias("ties")] if detail else []),
    )


#: The most differences for which rank sums are counted one by one.
EXACT = 50


def rank_sum_counts(n: int) -> list[int]:
    """How many of the 2 ** n choices of signs give each sum of positive ranks 1..n, from 0 on."""
    ways = [1]
    for rank in range(1, n + 1):
        longer = ways + [0] * rank
        for total, count in enumerate(ways):
            longer[total + rank] += count
        ways = longer
    return ways


def signed_rank_p(n: int, w_plus: float, ties: float, z: float | None) -> float | None:
    """The two-sided p-value of a sum of positive ranks: exact without ties up to EXACT differences, else from the normal
    approximation z with its correction for ties."""
    if n <= EXACT and not ties:
        ways = rank_sum_counts(n)
        least = int(min(w_plus, n * (n + 1) // 2 - w_plus))
        return min(1.0, 2 * sum(ways[: least + 1]) / 2**n)
    return None if z is None else math.erfc(abs(z) / math.sqrt(2))


def signed_rank(df: DataFrame, a: str, b: str, least: int = 10) -> DataFrame:
    """paired_comparison with nonzero, how many differences aren't zero, and p; p is null where w_plus is. One row, which the
    driver sees."""
    row = paired_comparison(df, a, b, least, detail=True).first()
    p = None if row["w_plus"] is None else signed_rank_p(row["nonzero"], row["w_plus"], row["ties"], row["z"])
    kept = [c for c in row.asDict() if c != "ties"]
    kinds = ", ".join(f"{c} {'long' if c in ('n', 'nonzero') else 'double'}" for c in kept)
    return df.sparkSession.createDataFrame([(*[row[c] for c in kept], p)], f"{kinds}, p double")


def lower_index_quantile(df: DataFrame, column: str, q: float, group: list[str], name: str) -> DataFrame:
    """Rows (group..., name): the value at index floor(q * (n - 1)) of the sorted values of each group."""
    return quantiles.exact(df, column, [q], group, "lower").select(*group, F.col("q")[0].alias(name))


def usefulness(df: DataFrame, flagged: str, wrong: str) -> DataFrame:
    """One row: n, flag_rate_wrong, flag_rate_right; rows without a verdict don't count."""
    f, w = F.col(flagged).cast("int"), F.col(wrong)
    return df.where(w.isNotNull()).agg(F.count("*").alias("n"), F.avg(F.when(w, f)).alias("flag_rate_wrong"), F.avg(F.when(~w, f)).alias("flag_rate_right"))
