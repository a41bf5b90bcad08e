"""What a served run comes to: rates and latencies, error kinds, graded success beside the recorded one, and agreement of its
decisions. A run's rows hold what each request met and what was recorded for it before, so a summary can be made anew from
stored rows; nothing is sent again.

rows: (request_id, task, http_error, route, served_by, frontier_error, server_ms, client_ms, cost_usd, score, served_success,
recorded_logprob, recorded_escalated, recorded_at_threshold, recorded_local, recorded_frontier).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metrics, quantiles

ANSWERED = "http_error is null"


def _share(condition: Column) -> Column:
    """The share of answered requests."""
    return F.avg(F.when(F.col("http_error").isNull(), F.coalesce(condition, F.lit(False)).cast("int")))


def totals(rows: DataFrame) -> DataFrame:
    """One row: requests, errors, rates over answered requests, unanswered ones, quantiles of times, and cost."""
    base = rows.agg(
        F.count("*").alias("requests"), F.count("http_error").alias("http_errors"), _share(F.col("route") == "escalated").alias("escalation_rate"),
        _share(F.col("route") == "fallback").alias("fallback_rate"), F.count_if(F.col("http_error").isNull() & (F.col("served_by") == "none")).alias("unanswered"),
        F.count_if(F.col("http_error").isNull() & F.col("frontier_error").isNotNull()).alias("frontier_errors"),
        _share(F.col("served_by") == "frontier").alias("frontier_served_rate"), F.sum("cost_usd").alias("cost_usd"),
        (F.sum("cost_usd") / F.count("*") * 1000).alias("cost_per_1k_usd"),
    )
    client = quantiles.exact(rows, "client_ms", [0.5, 0.95]).select(F.col("q")[0].alias("client_p50_ms"), F.col("q")[1].alias("client_p95_ms"))
    frontier = rows.where(f"{ANSWERED} and served_by = 'frontier'")
    slow = quantiles.exact(frontier, "server_ms", [0.95]).select(F.col("q")[0].alias("frontier_p95_ms"))
    return base.crossJoin(client).crossJoin(slow)  # one row each


def error_kinds(rows: DataFrame, column: str = "frontier_error", most: int = 5, chars: int = 60) -> DataFrame:
    """Rows (kind, n): the commonest errors of answered requests by their first characters, ties by name."""
    counts = rows.where(ANSWERED).where(F.col(column).isNotNull()).groupBy(F.substring(column, 1, chars).alias("kind")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "kind").limit(most)


def graded(rows: DataFrame, tasks: list[str]) -> DataFrame:
    """One row over the graded tasks: pairs, what was served rightly, what the recorded answers of the sides that served would
    score, the curve's point, the same at the live threshold, and the local side alone."""
    pick = lambda up: F.avg(F.when(up, F.col("recorded_frontier")).otherwise(F.col("recorded_local")).cast("int"))
    return rows.where(F.col("task").isin(tasks)).agg(
        F.count("*").alias("pairs"), F.avg(F.col("served_success").cast("int")).alias("served_success"),
        pick(F.coalesce(F.col("served_by") == "frontier", F.lit(False))).alias("recorded_success_as_served"),
        pick(F.col("recorded_escalated")).alias("curve_success"), pick(F.col("recorded_at_threshold")).alias("recorded_success_at_threshold"),
        F.avg(F.col("recorded_local").cast("int")).alias("local_only_success"),
    )


def decisions(rows: DataFrame) -> DataFrame:
    """One row over answered requests with a score: how often the live decision is the recorded one, both ways of differing, and
    how the scores agree in order and in size."""
    scored = rows.where(f"{ANSWERED} and score is not null").withColumn("_recorded", -F.col("recorded_logprob"))
    live = F.col("route") == "escalated"
    recorded = F.col("recorded_at_threshold")
    base = scored.agg(
        F.count("*").alias("pairs_compared"), F.avg((live == recorded).cast("int")).alias("same_decision"), F.count_if(live & ~recorded).alias("live_not_recorded"),
        F.count_if(~live & recorded).alias("recorded_not_live"),
    )
    order = metrics.spearman(scored, "score", "_recorded").select("spearman")
    far = quantiles.exact(scored.withColumn("_d", F.abs(F.col("score") - F.col("_recorded"))), "_d", [0.5]).select(F.col("q")[0].alias("median_difference"))
    return base.crossJoin(order).crossJoin(far)  # one row each


def by_task(rows: DataFrame) -> DataFrame:
    """Rows (task, pairs, escalation_rate, curve_escalation_rate, threshold_escalation_rate, fallback_rate, client_p95_ms,
    served_success, local_only_success)."""
    base = rows.groupBy("task").agg(
        F.count("*").alias("pairs"), _share(F.col("route") == "escalated").alias("escalation_rate"), F.avg(F.col("recorded_escalated").cast("int")).alias("curve_escalation_rate"),
        F.avg(F.col("recorded_at_threshold").cast("int")).alias("threshold_escalation_rate"), _share(F.col("route") == "fallback").alias("fallback_rate"),
        F.avg(F.col("served_success").cast("int")).alias("served_success"), F.avg(F.col("recorded_local").cast("int")).alias("local_only_success"),
    )
    return base.join(quantiles.exact(rows, "client_ms", [0.95], ["task"]).select("task", F.col("q")[0].alias("client_p95_ms")), "task")
