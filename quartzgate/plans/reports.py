"""Queries over report operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import reports, routing
from .base import PAIRS, PREDICTIONS, TURNS, pairs, predictions, turns
from .registry import query
from .routing import CURVE

P = f"WITH {PAIRS}"


@query(f"""{P} SELECT task, count(*) AS n, count(*) FILTER (WHERE (-mean_logprob >= 0.5) <> (n_chars % 1000 / 1000e0 >= 0.5)) AS changed,
count(*) FILTER (WHERE abs(-mean_logprob - 0.5) <= 0.05) AS near,
count(*) FILTER (WHERE abs(-mean_logprob - 0.5) <= 0.05 AND (-mean_logprob >= 0.5) <> (n_chars % 1000 / 1000e0 >= 0.5)) AS changed_near,
avg(frontier_success::INT) - avg(success::INT) AS success_change FROM pairs GROUP BY task""")
def rescored_decisions(spark, d):
    p = pairs(spark, d).select(
        "task", (-F.col("mean_logprob")).alias("old_score"), ((F.col("n_chars") % 1000).cast("double") / 1000.0).alias("new_score"),
        F.col("success").alias("old_success"), F.col("frontier_success").alias("new_success"),
    )
    return reports.rescored(p, 0.5)


@query(f"""{P}, {PREDICTIONS}, r AS (SELECT task, avg((gold = prediction)::INT) AS value FROM predictions GROUP BY task, source)
SELECT task, count(value) AS runs, avg(value) AS mean, stddev_samp(value) AS stdev, (0.9 - avg(value)) / nullif(stddev_samp(value), 0) AS z FROM r GROUP BY task""")
def seed_evidence(spark, d):
    r = predictions(spark, d).groupBy("task", "source").agg(F.avg((F.col("gold") == F.col("prediction")).cast("int")).alias("value"))
    return reports.seed_evidence(r, 0.9)


@query(f"""{CURVE} SELECT policy, budget, quality, published FROM (SELECT *, quality + CASE WHEN budget > 0.4 THEN 0.01 ELSE 0 END AS published FROM curve) WHERE budget > 0.4""")
def unreproduced_points(spark, d):
    curve = routing.operating_curve(pairs(spark, d))
    published = curve.withColumn("quality", F.col("quality") + F.when(F.col("budget") > 0.4, 0.01).otherwise(0.0))
    return reports.not_reproduced(curve, published).select("policy", "budget", "quality", "published")


@query(f"""{CURVE} SELECT policy, budget, threshold FROM curve WHERE policy = 'confidence' AND budget = 0.2""")
def operating_threshold(spark, d):
    return reports.curve_point(routing.operating_curve(pairs(spark, d)), "confidence", 0.2).select("policy", "budget", "threshold")


@query(f"""{P}, r AS (SELECT source, success AS gold, n_chars % 5 <> 0 AS a, CASE WHEN n_chars % 13 <> 0 THEN frontier_success END AS b FROM pairs)
SELECT source, count(*) AS n, avg((a = gold)::INT) AS accuracy_a, avg(coalesce(b = gold, FALSE)::INT) AS accuracy_b,
count(*) FILTER (WHERE a = gold AND NOT coalesce(b = gold, FALSE)) AS wins_a, count(*) FILTER (WHERE a <> gold AND coalesce(b = gold, FALSE)) AS wins_b FROM r GROUP BY source""")
def paired_systems(spark, d):
    n = F.col("n_chars")
    r = pairs(spark, d).select("source", F.col("success").alias("gold"), (n % 5 != 0).alias("a"), F.when(n % 13 != 0, F.col("frontier_success")).alias("b"))
    return reports.paired_systems(r)


@query(f"""{P}, c AS (SELECT pair_id, task, n_chars % 5 AS cluster, n_chars::DOUBLE AS chars FROM pairs),
s AS (SELECT task, cluster, count(*) AS n FROM c GROUP BY ALL), t AS (SELECT task, count(*) AS a, quantile_cont(chars, 0.1) AS lo, quantile_cont(chars, 0.9) AS hi FROM c GROUP BY task),
h AS (SELECT task, cluster AS held FROM (SELECT s.task, cluster, row_number() OVER (PARTITION BY s.task ORDER BY abs(n - a / 5e0), cluster) AS r FROM s JOIN t USING (task)) WHERE r = 1)
SELECT pair_id, cluster = held AS in_held_cluster, chars <= lo AS in_short_decile, chars >= hi AS in_long_decile,
CASE WHEN cluster = held OR chars <= lo OR chars >= hi THEN 'shift' ELSE 'in' END AS side FROM c JOIN t USING (task) JOIN h USING (task)""")
def shift_sides(spark, d):
    c = pairs(spark, d).select("pair_id", "task", (F.col("n_chars") % 5).alias("cluster"), F.col("n_chars").cast("double").alias("chars"))
    return reports.shift_sides(c, 5).select("pair_id", "in_held_cluster", "in_short_decile", "in_long_decile", "side")


@query(f"""WITH {TURNS}, g AS (SELECT conv_id, turn, substr(sha256(lower(regexp_replace(trim(request), '\\s+', ' ', 'g'))), 1, 16) AS h FROM turns),
u AS (SELECT *, ('0x' || substr(md5(h || '|20260909'), 1, 8))::BIGINT / 4294967296e0 AS u FROM g)
SELECT conv_id, turn, CASE WHEN u < 0.1 THEN 'holdout_a' WHEN u < 0.2 THEN 'holdout_b' ELSE 'train' END AS split FROM u""")
def request_splits(spark, d):
    return reports.request_splits(turns(spark, d), T.group_hash(F.col("request")), "conv_id").select("conv_id", "turn", "split")


@query("""WITH h AS (SELECT s_suppkey % 3 + 1 AS version, 'c' || (s_suppkey % 7) AS component, min(md5(s_name)) AS digest FROM supplier GROUP BY ALL),
c AS (SELECT 'c' || s_suppkey AS component, 'new' AS digest FROM supplier WHERE s_suppkey < 9 AND s_suppkey % 2 = 0),
l AS (SELECT component, arg_max(digest, version) AS old FROM h GROUP BY component)
SELECT version, component, digest FROM h UNION ALL SELECT (SELECT max(version) + 1 FROM h), component, coalesce(c.digest, old) FROM l FULL JOIN c USING (component)""")
def promotion_history(spark, d):
    from ..sources.tables import table

    s = table(spark, d, "supplier")
    name = lambda c: F.concat(F.lit("c"), c.cast("string"))
    k = F.col("s_suppkey")
    h = s.groupBy((k % 3 + 1).alias("version"), name(k % 7).alias("component")).agg(F.min(F.md5("s_name")).alias("digest"))
    c = s.where((k < 9) & (k % 2 == 0)).select(name(k).alias("component"), F.lit("new").alias("digest"))
    return reports.promoted(h, c)
