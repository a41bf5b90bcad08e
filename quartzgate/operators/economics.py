"""Token costs, break-even rates and running ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Dollars for a million tokens in and out, and for an hour of a GPU.
FRONTIER_IN, FRONTIER_OUT, GPU_HOUR = 0.15, 0.60, 0.75


def frontier_usd(tokens_in: Column, tokens_out: Column) -> Column:
    return (tokens_in * FRONTIER_IN + tokens_out * FRONTIER_OUT) / 1e6


def local_usd_per_1k(rate: Column) -> Column:
    """Dollars for a thousand requests at `rate` requests a second; null without a rate."""
    return F.try_divide(F.lit(GPU_HOUR * 1000 / 3600), rate)


def break_even_rps(frontier_per_1k: Column) -> Column:
    return F.try_divide(F.lit(GPU_HOUR * 1000 / 3600), frontier_per_1k)


def costs(calls: DataFrame) -> DataFrame:
    """calls: (key, seq, group, tokens_in, tokens_out, error). Rows (group, calls, usd, usd_per_1k) and one with a null
    group for all: the last call of each key is priced, failed ones aren't."""
    w = Window.partitionBy("key").orderBy(F.desc("seq"))
    last = calls.withColumn("_r", F.row_number().over(w)).where("_r = 1 and error is null")
    priced = last.withColumn("usd", frontier_usd(F.col("tokens_in"), F.col("tokens_out")))
    return priced.rollup("group").agg(F.count("*").alias("calls"), F.sum("usd").alias("usd"), (F.avg("usd") * 1000).alias("usd_per_1k"))


def ledger(calls: DataFrame, account: str, seq: str, cost: Column, cap: float) -> DataFrame:
    """`calls` with `spent` so far in the account and `allowed`: before the first call that would exceed the cap."""
    w = Window.partitionBy(account).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    spent = calls.withColumn("_c", cost).withColumn("spent", F.sum("_c").over(w))
    return spent.withColumn("allowed", F.max((F.col("spent") > cap).cast("int")).over(w) == 0).drop("_c")
