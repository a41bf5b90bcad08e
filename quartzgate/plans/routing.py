"""Routing, gate and cost queries over the scored pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import economics, gate, routing
from ..sources.tables import table
from .base import PAIRS, PREDICTIONS, pairs, predictions
from .registry import query

POLICY_ROWS = """scored AS (
  SELECT *, 'confidence' AS policy, -mean_logprob AS score FROM pairs
  UNION ALL SELECT *, 'random', ('0x' || substr(md5(pair_id || '|20260909'), 1, 8))::BIGINT::DOUBLE / 4294967296e0 FROM pairs
  UNION ALL SELECT *, 'oracle', (frontier_success::INT - success::INT)::DOUBLE FROM pairs
  UNION ALL SELECT *, 'longest', n_chars::DOUBLE FROM pairs),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY policy ORDER BY score DESC NULLS LAST, pair_id) AS rnk,
         count(*) OVER (PARTITION BY policy) AS total FROM scored),
budgets AS (SELECT unnest([0e0, 0.05e0, 0.1e0, 0.2e0, 0.3e0, 0.5e0, 0.75e0, 1e0]) AS budget)"""
CURVE = f"""WITH {PAIRS}, {POLICY_ROWS},
curve AS (
  SELECT policy, budget, count(*) AS n, count(*) FILTER (WHERE rnk <= round_even(budget * total, 0)) AS escalated,
         count(*) FILTER (WHERE rnk <= round_even(budget * total, 0))::DOUBLE / count(*) AS escalation_rate,
         sum(CASE WHEN rnk <= round_even(budget * total, 0) THEN frontier_success ELSE success END::INT)::DOUBLE / count(*) AS quality,
         min(CASE WHEN rnk <= round_even(budget * total, 0) THEN score END) AS threshold
  FROM ranked CROSS JOIN budgets GROUP BY policy, budget)"""


@query(f"{CURVE} SELECT * FROM curve")
def operating_curve(spark, d):
    return routing.operating_curve(pairs(spark, d))


@query(f"""WITH {PAIRS}, {POLICY_ROWS}
SELECT policy, budget, task, count(*) AS n, count(*) FILTER (WHERE rnk <= round_even(budget * total, 0)) AS escalated,
       count(*) FILTER (WHERE rnk <= round_even(budget * total, 0))::DOUBLE / count(*) AS escalation_rate,
       sum(CASE WHEN rnk <= round_even(budget * total, 0) THEN frontier_success ELSE success END::INT)::DOUBLE / count(*) AS quality,
       min(CASE WHEN rnk <= round_even(budget * total, 0) THEN score END) AS threshold
FROM ranked CROSS JOIN budgets GROUP BY policy, budget, task""")
def operating_curve_by_task(spark, d):
    return routing.operating_curve(pairs(spark, d), by_task=True)


@query(f"""{CURVE}
SELECT c.policy, c.budget, CASE WHEN o.quality - f.quality > 0 THEN (c.quality - f.quality) / (o.quality - f.quality) END AS captured
FROM curve c JOIN curve f ON f.policy = c.policy AND f.budget = 0 JOIN curve o ON o.policy = 'oracle' AND o.budget = c.budget""")
def headroom(spark, d):
    return routing.headroom(routing.operating_curve(pairs(spark, d)))


@query(f"""{CURVE} SELECT budget, max(quality) FILTER (WHERE policy = 'confidence') AS confidence, max(quality) FILTER (WHERE policy = 'oracle') AS oracle,
max(quality) FILTER (WHERE policy = 'random') AS random, max(quality) FILTER (WHERE policy = 'longest') AS longest FROM curve GROUP BY budget""")
def curve_pivot(spark, d):
    curve = routing.operating_curve(pairs(spark, d))
    return curve.groupBy("budget").pivot("policy", ["confidence", "oracle", "random", "longest"]).agg(F.max("quality"))


RANKED = f"""WITH {PAIRS}, ranked AS (
  SELECT *, -mean_logprob AS score, row_number() OVER (ORDER BY -mean_logprob DESC NULLS LAST, pair_id) AS rank, count(*) OVER () AS total FROM pairs),
tagged AS (
  SELECT *, rank <= round_even(0.2e0 * total, 0) AS escalated, frontier_success::INT - success::INT AS gain,
         CASE WHEN rank <= round_even(0.2e0 * total, 0) AND frontier_success::INT < success::INT THEN 'harmful'
              WHEN rank <= round_even(0.2e0 * total, 0) AND frontier_success = success THEN 'wasted'
              WHEN rank > round_even(0.2e0 * total, 0) AND frontier_success::INT > success::INT THEN 'missed' END AS misroute
  FROM ranked)"""


@query(f"{RANKED} SELECT pair_id, score, rank FROM ranked")
def escalation_order(spark, d):
    from ..operators import ranking

    scored = pairs(spark, d).withColumn("score", -F.col("mean_logprob"))
    return ranking.ranked(scored, "score", "pair_id").select("pair_id", "score", "rank")


@query(f"{RANKED} SELECT pair_id, task, gain, escalated, misroute FROM tagged WHERE misroute IS NOT NULL")
def misroute_rows(spark, d):
    tagged = routing.misroutes(pairs(spark, d))
    return tagged.where("misroute is not null").select("pair_id", "task", "gain", "escalated", "misroute")


@query(f"""{RANKED}
SELECT count(*) AS n, count(*) FILTER (WHERE escalated) AS escalated, count(*) FILTER (WHERE escalated AND gain > 0) AS rescued,
       count(*) FILTER (WHERE misroute = 'harmful') AS harmful, count(*) FILTER (WHERE misroute = 'wasted') AS wasted,
       count(*) FILTER (WHERE misroute = 'missed') AS missed,
       avg(CASE WHEN escalated THEN frontier_success ELSE success END::INT) AS quality,
       avg(success::INT) + (count(*) FILTER (WHERE escalated AND gain > 0) - count(*) FILTER (WHERE misroute = 'harmful'))::DOUBLE / count(*) AS quality_from_tags
FROM tagged""")
def misroute_summary(spark, d):
    return routing.misroute_summary(routing.misroutes(pairs(spark, d)))


@query(f"""WITH {PAIRS}
SELECT task, row_number() OVER w AS rank, sum(frontier_success::INT - success::INT) OVER w::BIGINT AS cumulative
FROM pairs WINDOW w AS (PARTITION BY task ORDER BY -mean_logprob DESC, pair_id ROWS UNBOUNDED PRECEDING)
UNION ALL SELECT DISTINCT task, 0, 0 FROM pairs""")
def cumulative_gain(spark, d):
    return routing.cumulative_gains(pairs(spark, d))


PICKS = {"en": 10, "fr": 5, "de": 3, "es": 0}


@query(f"""WITH {PAIRS}, k AS (SELECT * FROM (VALUES ('en', 10), ('fr', 5), ('de', 3), ('es', 0)) t(task, k)),
ranked AS (SELECT *, -mean_logprob AS score, row_number() OVER (PARTITION BY task ORDER BY -mean_logprob DESC, pair_id) AS r FROM pairs)
SELECT task, coalesce(min(CASE WHEN r <= k THEN score END), 'inf'::DOUBLE) AS threshold FROM ranked JOIN k USING (task) GROUP BY task""")
def per_task_thresholds(spark, d):
    return routing.task_thresholds(pairs(spark, d), PICKS)


@query(f"""WITH {PAIRS}, k AS (SELECT * FROM (VALUES ('en', 10), ('fr', 5), ('de', 3), ('es', 0)) t(task, k)),
ranked AS (SELECT *, -mean_logprob AS score, row_number() OVER (PARTITION BY task ORDER BY -mean_logprob DESC, pair_id) AS r FROM pairs),
cuts AS (SELECT task, coalesce(min(CASE WHEN r <= k THEN score END), 'inf'::DOUBLE) AS threshold FROM ranked JOIN k USING (task) GROUP BY task)
SELECT task, count(*) AS n, count(*) FILTER (WHERE score >= threshold) AS escalated,
       avg(CASE WHEN score >= threshold THEN frontier_success ELSE success END::INT) AS quality
FROM ranked JOIN cuts USING (task) GROUP BY task""")
def per_task_decisions(spark, d):
    p = pairs(spark, d)
    return routing.apply_thresholds(p, routing.task_thresholds(p, PICKS))


def allocation(spark, d):
    """The exact allocation of a fifth of all pairs over the tasks."""
    p = pairs(spark, d)
    picks = routing.best_allocation(routing.cumulative_gains(p), round(0.2 * p.count()))
    return spark.createDataFrame([(t, *pick) for t, pick in picks.items()], "task string, escalated long, gain long")


query()(allocation)


@query(f"""WITH {PAIRS}, s AS (SELECT task, avg(-mean_logprob) AS m, stddev_samp(-mean_logprob) AS sd FROM pairs WHERE pair_id % 2 = 0 GROUP BY task)
SELECT pair_id, (-mean_logprob - m) / sd AS z FROM pairs JOIN s USING (task)""")
def confidence_zscore(spark, d):
    p = pairs(spark, d)
    return routing.task_z_scores(p, p.where("pair_id % 2 = 0")).select("pair_id", "z")


@query(f"""WITH {PAIRS}, g AS (SELECT task, rank() OVER (ORDER BY avg(frontier_success::INT - success::INT)) AS place FROM pairs GROUP BY task)
SELECT pair_id, place * 1e6 + n_chars AS rules_score FROM pairs JOIN g USING (task)""")
def rules_baseline(spark, d):
    p = pairs(spark, d)
    return routing.task_order(p, p).select("pair_id", "rules_score")


@query(f"""WITH {PAIRS}
SELECT task, count(*) AS n, avg(success::INT) AS success_rate, avg(frontier_success::INT) AS frontier_rate,
       count(*) FILTER (WHERE frontier_success AND NOT success) AS rescues FROM pairs GROUP BY task""")
def success_rates(spark, d):
    s, f = F.col("success"), F.col("frontier_success")
    return pairs(spark, d).groupBy("task").agg(
        F.count("*").alias("n"), F.avg(s.cast("int")).alias("success_rate"), F.avg(f.cast("int")).alias("frontier_rate"), F.count_if(f & ~s).alias("rescues")
    )


ANSWERS = f"""WITH {PAIRS}, answers AS (
  SELECT pair_id, task, CASE WHEN success THEN 'good' ELSE 'bad' END AS gold, CASE WHEN n_chars % 5 = 0 THEN 'bad' ELSE 'good' END AS local,
         CASE WHEN n_chars % 13 = 0 THEN NULL WHEN frontier_success THEN 'good' ELSE 'bad' END AS frontier FROM pairs),
judged AS (
  SELECT *, frontier IS NOT NULL AS has_frontier_answer, coalesce(frontier <> gold, FALSE) AS frontier_rejects_gold,
         coalesce(frontier <> gold AND frontier = local AND local <> gold, FALSE) AS quarantine FROM answers)"""


def _answers(spark, d):
    p = pairs(spark, d)
    word = lambda c: F.when(c, "good").otherwise("bad")
    return p.select(
        "pair_id", "task", word(F.col("success")).alias("gold"), word(F.col("n_chars") % 5 != 0).alias("local"),
        F.when(F.col("n_chars") % 13 != 0, word(F.col("frontier_success"))).alias("frontier"),
    )


@query(f"{ANSWERS} SELECT pair_id, frontier_rejects_gold, quarantine AS independent_agreement_against_gold, quarantine, has_frontier_answer FROM judged")
def adjudication(spark, d):
    return routing.adjudicate(_answers(spark, d)).select("pair_id", "frontier_rejects_gold", "independent_agreement_against_gold", "quarantine", "has_frontier_answer")


@query(f"""{ANSWERS} SELECT task, count(*) AS n, avg(frontier_rejects_gold::INT) AS rejects, avg(quarantine::INT) AS agreement,
count(*) FILTER (WHERE quarantine)::DOUBLE / nullif(count(*) FILTER (WHERE frontier_rejects_gold AND local <> gold), 0) AS given_both_wrong, 1e0 AS chance
FROM judged GROUP BY task""")
def adjudication_rates(spark, d):
    return routing.adjudication_rates(routing.adjudicate(_answers(spark, d)), labels=2)


RUNS = f"""WITH {PAIRS}, {PREDICTIONS}, runs AS (
  SELECT task, split, 'accuracy' AS metric, source AS run, avg((gold = prediction)::INT) AS value FROM predictions GROUP BY task, split, source),
spread AS (SELECT task, split, metric, count(value) AS runs, avg(value) AS mean, max(value) - min(value) AS spread,
  CASE WHEN count(value) >= 3 THEN stddev_samp(value) END AS stdev FROM runs GROUP BY ALL),
inference AS (SELECT task, split, abs(max(value) FILTER (WHERE run = 'src0') - max(value) FILTER (WHERE run = 'src1')) AS spread FROM runs GROUP BY ALL),
derived AS (
  SELECT task, split, i.spread AS inference_spread, t.spread AS training_spread, greatest(i.spread, t.spread) AS floor,
         CASE WHEN greatest(i.spread, t.spread) > 0 THEN CASE WHEN t.spread >= coalesce(i.spread, 0) THEN 'training' ELSE 'inference' END END AS bound_by,
         CASE WHEN greatest(i.spread, t.spread) > 0 THEN greatest(i.spread, t.spread) * 3 END AS threshold,
         CASE WHEN greatest(i.spread, t.spread) > 0 THEN t.spread IS NULL END AS provisional
  FROM inference i FULL JOIN (SELECT * FROM spread WHERE task <> 'es') t USING (task, split))"""


def _runs(spark, d):
    p = predictions(spark, d)
    hit = F.avg((F.col("gold") == F.col("prediction")).cast("int"))
    return p.groupBy("task", "split", F.col("source").alias("run")).agg(hit.alias("value")).withColumn("metric", F.lit("accuracy"))


def _derived(spark, d):
    runs = _runs(spark, d)
    of = lambda r: F.max(F.when(F.col("run") == r, F.col("value")))
    inference = runs.groupBy("task", "split").agg(F.abs(of("src0") - of("src1")).alias("spread"))
    return gate.thresholds(inference, gate.spreads(runs).where("task <> 'es'"))


@query(f"{RUNS} SELECT * FROM spread")
def training_spreads(spark, d):
    return gate.spreads(_runs(spark, d))


@query(f"{RUNS} SELECT * FROM derived")
def gate_thresholds(spark, d):
    return _derived(spark, d)


DROPS = """, drops AS (
  SELECT task, split, metric, b.value AS baseline, c.value AS candidate, b.value - c.value AS drop
  FROM (SELECT task, split, metric, value FROM runs WHERE run = 'src2') b FULL JOIN (SELECT task, split, metric, value FROM runs WHERE run = 'src3') c
  USING (task, split, metric))"""


def _drops(spark, d):
    runs = _runs(spark, d)
    one = lambda r: runs.where(F.col("run") == r).select("task", "split", "metric", "value")
    return gate.drops(one("src3"), one("src2"))


@query(f"{RUNS}{DROPS} SELECT * FROM drops")
def regression_drop(spark, d):
    return _drops(spark, d)


@query(f"""{RUNS}{DROPS} SELECT task, 'drop beyond threshold' AS reason FROM drops JOIN (SELECT task, threshold * 0.05 AS threshold FROM derived
WHERE split = 'random' AND threshold IS NOT NULL AND NOT provisional) USING (task) WHERE split = 'random' AND drop > threshold
UNION ALL SELECT task, 'below prompted floor' FROM drops WHERE split = 'random' AND candidate < 0.95""")
def promotion_reasons(spark, d):
    limits = gate.enforced(_derived(spark, d)).withColumn("threshold", F.col("threshold") * 0.05)
    floors = _drops(spark, d).select("task").distinct().withColumn("floor", F.lit(0.95))
    return gate.blocking_reasons(_drops(spark, d), limits, floors)


@query("""WITH old AS (SELECT 's' || s_suppkey AS key, md5(s_name) AS digest FROM supplier WHERE s_suppkey % 5 <> 0),
new AS (SELECT 's' || s_suppkey AS key, CASE WHEN s_suppkey % 3 = 0 THEN md5(s_name || 'x') ELSE md5(s_name) END AS digest FROM supplier WHERE s_suppkey % 7 <> 0)
SELECT key, old.digest AS old, new.digest AS new FROM old FULL JOIN new USING (key) WHERE old.digest IS DISTINCT FROM new.digest""")
def manifest_diff(spark, d):
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("key"), "s_suppkey", "s_name")
    changed = F.when(F.col("s_suppkey") % 3 == 0, F.md5(F.concat("s_name", F.lit("x")))).otherwise(F.md5("s_name"))
    old = s.where("s_suppkey % 5 <> 0").select("key", F.md5("s_name").alias("digest"))
    return gate.manifest_diff(old, s.where("s_suppkey % 7 <> 0").select("key", changed.alias("digest")))


PARTS = """WITH parts AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN 'eval_splits.e' ELSE 'components.c' END || s_suppkey AS key, md5(s_name) AS d FROM supplier),
old AS (SELECT key, d AS digest FROM parts WHERE k % 5 <> 0), new AS (SELECT key, CASE WHEN k % 4 = 0 THEN md5(d) ELSE d END AS digest FROM parts WHERE k % 7 <> 0),
moved AS (SELECT key, old.digest AS was, split_part(key, '.', 2) AS component FROM old FULL JOIN new USING (key) WHERE old.digest IS DISTINCT FROM new.digest),
models AS (SELECT * FROM moved WHERE key LIKE 'components.%' AND was IS NOT NULL), splits AS (SELECT * FROM moved WHERE key LIKE 'eval_splits.%'),
own AS (SELECT 'c' || k AS component FROM parts WHERE k < 100 AND k % 2 = 0), reports AS (SELECT 'c' || k AS component, k % 3 <> 1 AS found FROM parts WHERE k % 8 = 4 AND k < 100),
told AS (SELECT DISTINCT m.component, r.found FROM models m JOIN own USING (component) LEFT JOIN reports r USING (component)),
reported AS (SELECT component AS subject, CASE WHEN found IS NULL THEN 'moved without a report' ELSE 'its report does not exist' END AS reason FROM told WHERE found IS NULL OR NOT found)"""


def _promotion(spark, d, **more):
    k = F.col("s_suppkey")
    parts = table(spark, d, "supplier").select(
        k.alias("k"), F.concat(F.when(k % 3 == 0, "eval_splits.e").otherwise("components.c"), k.cast("string")).alias("key"), F.md5("s_name").alias("digest")
    )
    new = parts.where("k % 7 <> 0").select("key", F.when(F.col("k") % 4 == 0, F.md5("digest")).otherwise(F.col("digest")).alias("digest"))
    reports = parts.where("k % 8 = 4 and k < 100").select(F.concat(F.lit("c"), F.col("k").cast("string")).alias("component"), (F.col("k") % 3 != 1).alias("found"))
    return gate.promotion_reasons(parts.where("k % 5 <> 0").select("key", "digest"), new, [f"c{i}" for i in range(2, 100, 2)], reports, **more)


@query(f"""{PARTS} SELECT * FROM reported UNION ALL SELECT key, 'moved without a regression run' FROM models WHERE component NOT IN (SELECT component FROM own)
UNION ALL SELECT key, 'split moved without a refreeze' FROM splits""")
def moved_manifest_reasons(spark, d):
    return _promotion(spark, d)


@query(f"""{PARTS} SELECT * FROM reported UNION ALL SELECT key, 'moved without a regression run' FROM models WHERE component NOT IN (SELECT component FROM own)
UNION ALL SELECT key, 'moved in a refreeze' FROM models WHERE EXISTS (FROM splits) UNION ALL SELECT 'D1', 'refreeze without a moved split' WHERE NOT EXISTS (FROM splits)""")
def refreeze_reasons(spark, d):
    return _promotion(spark, d, refreeze="D1")


@query("""WITH p AS (SELECT s_suppkey AS repo, 'r1' AS revision, md5(s_name) AS digest FROM supplier),
o AS (SELECT s_suppkey AS repo, 'r1' AS revision, CASE WHEN s_suppkey % 4 = 0 THEN 'x' ELSE md5(s_name) END AS digest,
  CASE WHEN s_suppkey % 3 = 0 THEN 'r2' ELSE 'r1' END AS main FROM supplier WHERE s_suppkey % 5 <> 0)
SELECT p.repo, CASE WHEN o.repo IS NULL THEN 'revision_gone' WHEN o.digest <> p.digest THEN 'weights_rewritten' WHEN o.main <> p.revision THEN 'main_moved' ELSE 'ok' END AS status
FROM p LEFT JOIN o ON p.repo = o.repo AND p.revision = o.revision""")
def pin_status(spark, d):
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    pins = s.select(k.alias("repo"), F.lit("r1").alias("revision"), F.md5("s_name").alias("digest"))
    seen = s.where("s_suppkey % 5 <> 0").select(
        k.alias("repo"), F.lit("r1").alias("revision"), F.when(k % 4 == 0, "x").otherwise(F.md5("s_name")).alias("digest"),
        F.when(k % 3 == 0, "r2").otherwise("r1").alias("main"),
    )
    return gate.verify_pins(pins, seen)


CALLS = """calls AS (
  SELECT conv_id AS key, turn AS seq, role AS grp, length(text) / 4e0 AS tokens_in, length(text) / 8e0 AS tokens_out,
         CASE WHEN length(text) % 17 = 0 THEN 'timeout' END AS error FROM conversations)"""


def _calls(spark, d):
    c = table(spark, d, "conversations")
    n = F.length("text")
    return c.select(
        F.col("conv_id").alias("key"), F.col("turn").alias("seq"), F.col("role").alias("group"), (n / 4.0).alias("tokens_in"),
        (n / 8.0).alias("tokens_out"), F.when(n % 17 == 0, "timeout").alias("error"),
    )


@query(f"""WITH {CALLS}, last AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM calls)
SELECT grp AS "group", count(*) AS calls, sum((tokens_in * 0.15e0 + tokens_out * 0.6e0) / 1e6) AS usd,
       avg((tokens_in * 0.15e0 + tokens_out * 0.6e0) / 1e6) * 1000 AS usd_per_1k
FROM last WHERE r = 1 AND error IS NULL GROUP BY ROLLUP (grp)""")
def cost_per_1k(spark, d):
    return economics.costs(_calls(spark, d))


@query(f"""WITH {CALLS}, s AS (SELECT *, sum(tokens_in) OVER (PARTITION BY key ORDER BY seq ROWS UNBOUNDED PRECEDING) AS spent FROM calls)
SELECT key, seq, spent, max((spent > 300)::INT) OVER (PARTITION BY key ORDER BY seq ROWS UNBOUNDED PRECEDING) = 0 AS allowed FROM s""")
def ledger_stop(spark, d):
    return economics.ledger(_calls(spark, d), "key", "seq", F.col("tokens_in"), 300.0).select("key", "seq", "spent", "allowed")


@query(f"""WITH {CALLS}, f AS (SELECT grp, avg((tokens_in * 0.15e0 + tokens_out * 0.6e0) / 1e6) * 1000 AS per_1k FROM calls GROUP BY grp)
SELECT grp AS "group", per_1k, 0.75e0 * 1000 / 3600 / nullif(per_1k, 0) AS break_even_rps, 0.75e0 * 1000 / 3600 / 23.6e0 AS local_per_1k FROM f""")
def break_even(spark, d):
    usd = economics.frontier_usd(F.col("tokens_in"), F.col("tokens_out"))
    per = _calls(spark, d).groupBy("group").agg((F.avg(usd) * 1000).alias("per_1k"))
    return per.select("group", "per_1k", economics.break_even_rps(F.col("per_1k")).alias("break_even_rps"), economics.local_usd_per_1k(F.lit(23.6)).alias("local_per_1k"))
