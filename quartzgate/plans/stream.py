"""Recorded requests, in batch and as streams run to the end of their input."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import session
from ..operators import metrics, online, served
from ..sources.tables import table
from ..streaming import live
from .base import REQUESTS
from .registry import query


def requests(spark, d):
    return online.from_events(table(spark, d, "events"))


RATES = """count(*) AS requests, avg((route = 'escalated')::INT) AS escalated, avg((route = 'fallback')::INT) AS fallback,
avg((route = 'out_of_domain')::INT) AS out_of_domain, avg(latency_ms) AS mean_ms"""


@query(f"WITH {REQUESTS} SELECT task, {RATES} FROM requests GROUP BY ROLLUP (task)")
def route_rates(spark, d):
    return online.route_rates(requests(spark, d))


@query(f"""WITH {REQUESTS} SELECT task, count(*) AS n, quantile_cont(latency_ms, 0.5) AS p50, quantile_cont(latency_ms, 0.95) AS p95,
avg((latency_ms <= 50)::INT) AS within_target, avg(CASE WHEN tokens > 1 THEN latency_ms / (tokens - 1) END) AS ms_per_token FROM requests GROUP BY task""")
def latency_p50_p95(spark, d):
    return online.latency(requests(spark, d))


@query(f"""WITH {REQUESTS}, l AS (SELECT user_id, list_sort(list(latency_ms)) AS v FROM requests GROUP BY user_id) SELECT user_id, v[1 + floor(0.95e0 * (len(v) - 1))::INT] AS p95 FROM l""")
def latency_p95_lower(spark, d):
    return metrics.lower_index_quantile(requests(spark, d), "latency_ms", 0.95, ["user_id"], "p95")


@query(f"""WITH {REQUESTS}, s AS (SELECT least(floor(greatest(0, least(epoch(ts - TIMESTAMP '2024-01-01'), 2592000e0)) / 100000), 25)::BIGINT AS w FROM requests)
SELECT w AS "window", count(*) AS requests, least(100000e0, 2592000e0 - w * 100000e0) AS span_s, count(*) / least(100000e0, 2592000e0 - w * 100000e0) AS per_s FROM s GROUP BY w""")
def request_windows(spark, d):
    start = F.col("ts").cast("double") - F.lit("2024-01-01 00:00:00").cast("timestamp").cast("double")
    return online.windows(requests(spark, d), start, 2592000.0, 100000.0)


@query(f"""WITH {REQUESTS}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM requests WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS requests FROM s GROUP BY user_id, k""")
def sessions(spark, d):
    s = online.sessions(requests(spark, d), "6 hours")
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "requests")


LIVE = f"""{REQUESTS}, live AS (
  SELECT request_id, task, CASE WHEN request_id % 19 = 0 THEN 'timeout' END AS http_error, route FROM requests),
recorded AS (SELECT request_id, task, latency_ms > 50 AS escalated FROM requests)"""


@query(f"""WITH {LIVE} SELECT live.task, count(*) AS requests, count(*) FILTER (WHERE http_error IS NOT NULL) AS errors,
avg((route = 'escalated')::INT) FILTER (WHERE http_error IS NULL) AS escalation_rate,
avg(((route = 'escalated') = escalated)::INT) FILTER (WHERE http_error IS NULL) AS same_decision FROM live JOIN recorded USING (request_id, task) GROUP BY live.task""")
def agreement_with_recorded(spark, d):
    r = requests(spark, d).withColumnRenamed("request_id", "pair_id")
    lived = r.select("pair_id", "task", "route", F.when(F.col("pair_id") % 19 == 0, "timeout").alias("http_error"))
    return online.agreement(lived, r.select("pair_id", "task", (F.col("latency_ms") > 50).alias("escalated")))


ROUTES = f"""{REQUESTS}, d AS (SELECT request_id, request_id % 23 = 0 AS ood, CASE WHEN request_id % 11 = 0 THEN 'failed' END AS local_error,
CASE WHEN request_id % 13 = 0 THEN 'label' END AS malformed, CASE WHEN request_id % 29 <> 0 THEN latency_ms END AS score, request_id % 5 <> 0 AS ok FROM requests),
r AS (SELECT *, CASE WHEN ood THEN 'out_of_domain' WHEN local_error IS NOT NULL OR malformed IS NOT NULL THEN 'fallback' WHEN score >= 60 THEN 'escalated' ELSE 'local' END AS route FROM d)"""


@query(f"""WITH {ROUTES} SELECT request_id, route, CASE WHEN route <> 'local' AND ok THEN 'frontier' WHEN local_error IS NULL THEN 'local' ELSE 'none' END AS served_by FROM r""")
def routing_decisions(spark, d):
    k = F.col("request_id")
    r = requests(spark, d).select(
        "request_id", (k % 23 == 0).alias("ood"), F.when(k % 11 == 0, "failed").alias("local_error"), F.when(k % 13 == 0, "label").alias("malformed"),
        F.when(k % 29 != 0, F.col("latency_ms")).alias("score"), (k % 5 != 0).alias("ok"),
    )
    r = r.withColumn("route", online.route(F.col("ood"), F.col("local_error"), F.col("malformed"), F.col("score"), F.lit(60.0)))
    return r.select("request_id", "route", online.served_by(F.col("route"), F.col("ok"), F.col("local_error")).alias("served_by"))


@query(f"WITH {REQUESTS} SELECT task, {RATES} FROM requests GROUP BY task")
def stream_rates(spark, d):
    return live.drained(live.rates(live.read(spark, d)), "complete", f"rates_{uuid.uuid4().hex}")


@query(f"WITH {REQUESTS} SELECT task, date_trunc('day', ts) AS start, count(*) AS requests, avg(latency_ms) AS mean_ms FROM requests GROUP BY ALL")
def stream_tumbling(spark, d):
    out = live.stored(live.tumbling(live.read(spark, d)), "tumbling")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


DESK = (2, 3, 21600.0)


@query(f"""WITH {REQUESTS}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM requests WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, epoch(min(ts)) AS start, epoch(max(ts)) + 21600 AS "end", count(*) AS requests FROM s GROUP BY user_id, k""")
def stream_sessions(spark, d):
    """The sessions that the stream's state closes, as `sessions` has them."""
    rows = live.stored(live.desk(live.ended(live.raw(spark, d)), *DESK), "desk")
    return rows.where("kind = 'session'").select("user_id", "start", "end", "requests")


def desk_decisions(spark, d):
    return online.desk(requests(spark, d), *DESK[:2])


def stream_desk(spark, d):
    """desk_decisions from the stream, in event-time order with a budget kept as state."""
    rows = live.stored(live.desk(live.ended(live.raw(spark, d)), *DESK), "desk")
    return rows.where("kind = 'request'").select("user_id", "request_id", "route", "decision", "served")


query()(desk_decisions)
query()(stream_desk)


@query()
def rate_budget(spark, d):
    return online.rate_budget(requests(spark, d), "user_id", 2, 3)


@query()
def stream_budget(spark, d):
    return live.stored(live.budget(live.read(spark, d), 2, 3), "budget")


RUN = f"""{REQUESTS}, run AS (
  SELECT request_id, task, CASE WHEN request_id % 19 = 0 THEN 'timeout' END AS http_error, route, CASE request_id % 7 WHEN 0 THEN 'none' WHEN 1 THEN 'frontier' WHEN 2 THEN 'frontier' ELSE 'local' END AS served_by,
    CASE WHEN request_id % 17 = 0 THEN 'status 5' || (request_id % 3) || repeat('x', 70) || request_id END AS frontier_error, latency_ms AS server_ms, latency_ms + request_id % 5 AS client_ms,
    (request_id % 13) / 1e6 AS cost_usd, CASE WHEN request_id % 23 <> 0 THEN latency_ms / 10 END AS score, request_id % 3 <> 0 AS served_success, -(request_id % 11) / 2e0 AS recorded_logprob,
    latency_ms > 50 AS recorded_escalated, latency_ms > 40 AS recorded_at_threshold, request_id % 4 <> 0 AS recorded_local, request_id % 5 <> 0 AS recorded_frontier FROM requests)"""


def _run(spark, d):
    k = F.col("request_id")
    long_name = F.concat(F.lit("status 5"), (k % 3).cast("string"), F.repeat(F.lit("x"), F.lit(70)), k.cast("string"))
    return requests(spark, d).select(
        k, "task", F.when(k % 19 == 0, "timeout").alias("http_error"), "route",
        F.when(k % 7 == 0, "none").when((k % 7).isin(1, 2), "frontier").otherwise("local").alias("served_by"), F.when(k % 17 == 0, long_name).alias("frontier_error"),
        F.col("latency_ms").alias("server_ms"), (F.col("latency_ms") + k % 5).alias("client_ms"), ((k % 13) / 1e6).alias("cost_usd"),
        F.when(k % 23 != 0, F.col("latency_ms") / 10).alias("score"), (k % 3 != 0).alias("served_success"), (-(k % 11) / 2.0).alias("recorded_logprob"),
        (F.col("latency_ms") > 50).alias("recorded_escalated"), (F.col("latency_ms") > 40).alias("recorded_at_threshold"), (k % 4 != 0).alias("recorded_local"),
        (k % 5 != 0).alias("recorded_frontier"),
    )


OK = "http_error IS NULL"


@query(f"""WITH {RUN} SELECT count(*) AS requests, count(http_error) AS http_errors, avg((route = 'escalated')::INT) FILTER (WHERE {OK}) AS escalation_rate,
avg((route = 'fallback')::INT) FILTER (WHERE {OK}) AS fallback_rate, count(*) FILTER (WHERE {OK} AND served_by = 'none') AS unanswered, count(frontier_error) FILTER (WHERE {OK}) AS frontier_errors,
avg((served_by = 'frontier')::INT) FILTER (WHERE {OK}) AS frontier_served_rate, sum(cost_usd) AS cost_usd, sum(cost_usd) / count(*) * 1000 AS cost_per_1k_usd,
quantile_cont(client_ms, 0.5) AS client_p50_ms, quantile_cont(client_ms, 0.95) AS client_p95_ms, quantile_cont(server_ms, 0.95) FILTER (WHERE {OK} AND served_by = 'frontier') AS frontier_p95_ms FROM run""")
def run_totals(spark, d):
    return served.totals(_run(spark, d))


@query(f"""WITH {RUN} SELECT substr(frontier_error, 1, 60) AS kind, count(*) AS n FROM run WHERE {OK} AND frontier_error IS NOT NULL GROUP BY 1 ORDER BY n DESC, kind LIMIT 5""")
def run_error_kinds(spark, d):
    return served.error_kinds(_run(spark, d))


@query(f"""WITH {RUN} SELECT count(*) AS pairs, avg(served_success::INT) AS served_success, avg(CASE WHEN served_by = 'frontier' THEN recorded_frontier ELSE recorded_local END::INT) AS recorded_success_as_served,
avg(CASE WHEN recorded_escalated THEN recorded_frontier ELSE recorded_local END::INT) AS curve_success, avg(CASE WHEN recorded_at_threshold THEN recorded_frontier ELSE recorded_local END::INT) AS recorded_success_at_threshold,
avg(recorded_local::INT) AS local_only_success FROM run WHERE task IN ('t0', 't2')""")
def run_graded(spark, d):
    return served.graded(_run(spark, d), ["t0", "t2"])


@query(f"""WITH {RUN}, s AS (SELECT *, route = 'escalated' AS live, -recorded_logprob AS r FROM run WHERE {OK} AND score IS NOT NULL),
k AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2e0 AS a, rank() OVER (ORDER BY r) + (count(*) OVER (PARTITION BY r) - 1) / 2e0 AS b FROM s)
SELECT count(*) AS pairs_compared, avg((live = recorded_at_threshold)::INT) AS same_decision, count(*) FILTER (WHERE live AND NOT recorded_at_threshold) AS live_not_recorded,
count(*) FILTER (WHERE NOT live AND recorded_at_threshold) AS recorded_not_live, corr(a, b) AS spearman, median(abs(score - r)) AS median_difference FROM k""")
def run_decisions(spark, d):
    return served.decisions(_run(spark, d))


@query(f"""WITH {RUN} SELECT task, count(*) AS pairs, avg((route = 'escalated')::INT) FILTER (WHERE {OK}) AS escalation_rate, avg(recorded_escalated::INT) AS curve_escalation_rate,
avg(recorded_at_threshold::INT) AS threshold_escalation_rate, avg((route = 'fallback')::INT) FILTER (WHERE {OK}) AS fallback_rate, avg(served_success::INT) AS served_success,
avg(recorded_local::INT) AS local_only_success, quantile_cont(client_ms, 0.95) AS client_p95_ms FROM run GROUP BY task""")
def run_by_task(spark, d):
    """From the run's stored rows, read again: a summary made anew, with nothing sent."""
    return served.by_task(session.materialize(_run(spark, d), "run"))
