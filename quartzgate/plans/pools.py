"""Queries over the operators that build sets of rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pools
from ..sources.tables import table
from .base import PAIRS, PREDICTIONS, pairs, predictions
from .registry import query

P = f"WITH {PAIRS}"
KEY = "md5(pair_id::VARCHAR || '|20260909'), pair_id"


@query("""SELECT conv_id, turn FROM conversations WHERE text IS NOT NULL AND regexp_matches(text, '\\S') AND role IS NOT NULL AND regexp_matches(role, '\\S')""")
def present_turns(spark, d):
    return pools.present(table(spark, d, "conversations"), ["text", "role"]).select("conv_id", "turn")


@query("""SELECT conv_id, turn, length(text) >= 15 AS long_enough, ceil(length(text) / 4e0) <= 512 AS within FROM conversations""")
def turn_screens(spark, d):
    t = F.col("text")
    return table(spark, d, "conversations").select("conv_id", "turn", pools.long_enough(t).alias("long_enough"), pools.within_cap(t).alias("within"))


@query(f"{P} SELECT pair_id, task FROM pairs ORDER BY {KEY} LIMIT 40")
def capped_pairs(spark, d):
    return pools.capped(pairs(spark, d), "pair_id", 40).select("pair_id", "task")


@query(f"""{P}, f AS (SELECT d.doc_id AS pair_id, row_number() OVER (PARTITION BY md5(text) ORDER BY d.doc_id) AS r FROM documents d
  WHERE d.doc_id NOT IN (SELECT pair_id FROM pairs WHERE task = 'en')),
o AS (SELECT pair_id, row_number() OVER (ORDER BY substr(md5(pair_id::VARCHAR || '|20260909'), 1, 13), pair_id) AS p FROM f WHERE r = 1)
SELECT pair_id, CASE WHEN p <= 50 THEN 'router' ELSE 'mining' END AS part FROM o WHERE p <= 90""")
def pool_draw(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("pair_id"), "text")
    taken = pairs(spark, d).where("task = 'en'")
    return pools.pool(docs, "pair_id", "text", taken, {"router": 50, "mining": 40}).select("pair_id", "part")


@query(f"""{P}, o AS (SELECT *, row_number() OVER (PARTITION BY success ORDER BY substr(md5(pair_id::VARCHAR || '|20260909'), 1, 13), pair_id) AS p FROM pairs)
SELECT pair_id, success FROM o WHERE p <= (SELECT min(n) FROM (SELECT count(*) AS n FROM pairs GROUP BY success))""")
def balanced_classes(spark, d):
    return pools.balanced(pairs(spark, d), "success", "pair_id").select("pair_id", "success")


@query(f"""{P}, o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pair_id) AS r FROM pairs)
SELECT pair_id, source FROM o WHERE r <= 3 ORDER BY pair_id LIMIT 20""")
def few_of_each_source(spark, d):
    return pools.few_of_each(pairs(spark, d), "pair_id", "source", 3, 20).select("pair_id", "source")


@query(f"""{P}, e AS (SELECT pair_id, 'router' AS origin FROM pairs WHERE task = 'en' UNION ALL
  SELECT * FROM (SELECT pair_id, 'mining' AS origin FROM pairs WHERE task <> 'en' ORDER BY {KEY} LIMIT 25)),
c AS (SELECT pair_id FROM e ORDER BY md5(pair_id::VARCHAR || '|20260910'), pair_id LIMIT 15)
SELECT pair_id, origin, pair_id IN (SELECT pair_id FROM c) AS calibration FROM e""")
def labelling_plan(spark, d):
    p = pairs(spark, d).select("pair_id", "task")
    return pools.labelling_plan(p.where("task = 'en'").select("pair_id"), p.where("task <> 'en'").select("pair_id"), "pair_id", 25, 15)


@query(f"""WITH {PAIRS}, {PREDICTIONS}, f AS (SELECT *, row_number() OVER (PARTITION BY gold ORDER BY {KEY}) AS r FROM predictions WHERE split <> 'hard')
SELECT pair_id, gold FROM f WHERE r <= 4""")
def few_shot_demonstrations(spark, d):
    p = predictions(spark, d)
    return pools.demonstrations(p, p.where("split = 'hard'"), "pair_id", "gold", per_class=4).select("pair_id", "gold")


@query(f"""WITH {PAIRS}, {PREDICTIONS} SELECT pair_id, gold, coalesce(prediction, 'none') AS prediction FROM (
SELECT pair_id, gold, prediction FROM predictions WHERE split = 'random' UNION ALL SELECT pair_id, gold, NULL FROM predictions WHERE split = 'hard')""")
def filled_union(spark, d):
    p = predictions(spark, d)
    a = p.where("split = 'random'").select("pair_id", "gold", "prediction")
    return pools.union_filled(a, p.where("split = 'hard'").select("pair_id", "gold"), {"prediction": "none"})


@query(f"WITH {PAIRS}, {PREDICTIONS} SELECT pair_id, gold, prediction, n_chars % 3 = 0 AS other FROM predictions JOIN pairs USING (pair_id)")
def same_rows(spark, d):
    p = predictions(spark, d).select("pair_id", "gold", "prediction")
    b = pairs(spark, d).select("pair_id", F.when(F.col("success"), "good").otherwise("bad").alias("gold"), (F.col("n_chars") % 3 == 0).alias("other"))
    return pools.same_rows(p, b, "pair_id", ["gold"])


@query("""WITH t AS (SELECT text, task FROM benchmark CROSS JOIN (SELECT unnest(['intent', 'urgency']) AS task))
SELECT substr(sha256(task || chr(1) || text), 1, 16) AS request, task, length(min(text)) AS chars, count(*) AS n FROM t GROUP BY 1, 2""")
def requests_for_each_task(spark, d):
    out = pools.for_each_task(table(spark, d, "benchmark").select("text"), "text", ["intent", "urgency"])
    return out.select("request", "task", F.length("text").cast("long").alias("chars"), "n")


@query(f"{P} SELECT pair_id, dense_rank() OVER (ORDER BY pair_id) AS place FROM pairs")
def dense_places(spark, d):
    return pools.dense_place(pairs(spark, d).select("pair_id"), "pair_id")


@query(f"{P} SELECT pair_id, task FROM pairs ORDER BY right(pair_id::VARCHAR, 4), pair_id")
def interleaved_pairs(spark, d):
    return pools.interleaved(pairs(spark, d), "pair_id").select("pair_id", "task")


@query(f"WITH {PAIRS}, {PREDICTIONS} SELECT prediction, count(*) AS n FROM predictions GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1")
def majority_class(spark, d):
    return pools.majority(predictions(spark, d), "prediction")


@query(f"{P}, t AS (SELECT task, avg(success::INT) AS rate, count(*) AS n FROM pairs GROUP BY task) SELECT sum(rate * n) / sum(n) AS rate FROM t")
def weighted_success(spark, d):
    t = pairs(spark, d).groupBy("task").agg(F.avg(F.col("success").cast("int")).alias("rate"), F.count("*").alias("n"))
    return pools.weighted_rate(t, "rate", "n")


@query("""WITH s AS (SELECT value, row_number() OVER (ORDER BY value) AS r, count(*) OVER () AS n FROM events WHERE value IS NOT NULL),
a AS (SELECT max(n) AS n, greatest(1, least(max(n) - 1, 95 * (max(n) + 1) // 100)) AS j FROM s)
SELECT n, (SELECT value FROM s WHERE r = j) * (1 - (95 * (n + 1) - j * 100) / 100e0) + (SELECT value FROM s WHERE r = j + 1) * ((95 * (n + 1) - j * 100) / 100e0) AS value FROM a""")
def latency_p95_exclusive(spark, d):
    return pools.exclusive_quantile(table(spark, d, "events"), "value", 95)
