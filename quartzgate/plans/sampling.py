"""Splits, samples and leak checks over the scored pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling
from ..sources import logs
from ..sources.tables import table
from .base import PAIRS, pairs
from .registry import query

KEY = "md5(pair_id || '|20260909')"
P = f"WITH {PAIRS}"


@query(f"""{P}, r AS (SELECT pair_id, task, success, row_number() OVER (PARTITION BY task, success ORDER BY {KEY}, pair_id) AS r,
count(*) OVER (PARTITION BY task, success) AS n FROM pairs)
SELECT pair_id, CASE WHEN r <= round_even(n * 0.2e0, 0) THEN 'eval' ELSE 'train' END AS split FROM r""")
def stratified_split(spark, d):
    return sampling.stratified_holdout(pairs(spark, d), "pair_id", ["task", "success"]).select("pair_id", "split")


@query(f"""{P}, r AS (SELECT pair_id, task, row_number() OVER (PARTITION BY task ORDER BY {KEY}, pair_id) AS r FROM pairs) SELECT pair_id, task FROM r WHERE r <= 15""")
def head_per_task(spark, d):
    return sampling.head_per_group(pairs(spark, d), "pair_id", ["task"], 15).select("pair_id", "task")


@query(f"""{P}, r AS (SELECT pair_id, source, row_number() OVER (PARTITION BY source ORDER BY {KEY}, pair_id) AS r, dense_rank() OVER (ORDER BY source) AS g,
(SELECT count(DISTINCT source) FROM pairs) AS n FROM pairs) SELECT pair_id, source FROM r WHERE r <= 50 // n + CASE WHEN g <= 50 % n THEN 1 ELSE 0 END""")
def quota_per_source(spark, d):
    return sampling.quota_per_group(pairs(spark, d), "pair_id", "source", 50).select("pair_id", "source")


@query(f"""{P}, g AS (SELECT pair_id, row_number() OVER (PARTITION BY success ORDER BY {KEY}, pair_id) AS r, {KEY} AS k FROM pairs),
v AS (SELECT *, row_number() OVER (PARTITION BY r > 4 ORDER BY k) AS o, count(*) OVER (PARTITION BY r > 4) AS n FROM g)
SELECT pair_id, CASE WHEN r <= 4 THEN 'golden' WHEN o <= floor(n * 0.15e0) THEN 'val' ELSE 'train' END AS split FROM v""")
def three_way_split(spark, d):
    return sampling.three_way(pairs(spark, d), "pair_id", 8, "success").select("pair_id", "split")


@query(f"""{P}, one AS (SELECT pair_id, source, row_number() OVER (PARTITION BY source ORDER BY {KEY}, pair_id) AS r FROM pairs),
gold AS (SELECT pair_id, source FROM one WHERE r = 1 ORDER BY md5(source || '|20260909'), source LIMIT 5)
SELECT p.pair_id, CASE WHEN g.pair_id IS NOT NULL THEN 'golden' WHEN b.source IS NOT NULL THEN 'dropped' ELSE 'train' END AS split
FROM pairs p LEFT JOIN gold g USING (pair_id) LEFT JOIN gold b ON b.source = p.source""")
def group_split(spark, d):
    return sampling.grouped_split(pairs(spark, d), "source", "pair_id", 5).select("pair_id", "split")


@query(f"""{P}, f AS (SELECT pair_id, task, source, row_number() OVER (PARTITION BY task, source ORDER BY {KEY}, pair_id) AS i,
{KEY} AS k FROM pairs WHERE NOT success), n AS (SELECT task, count(DISTINCT source) AS b FROM f GROUP BY task),
r AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY (i > floor(20 / b))::INT, k, pair_id) AS r FROM f JOIN n USING (task))
SELECT pair_id, task, source FROM r WHERE r <= 20""")
def capped_mining(spark, d):
    failures = pairs(spark, d).where("not success")
    return sampling.capped_mining(failures, "pair_id", "task", "source", 20).select("pair_id", "task", "source")


@query(f"""{P}, neg AS (SELECT n_chars::DOUBLE AS l FROM pairs WHERE NOT success),
e AS (SELECT quantile_cont(l, [0.0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1.0]) AS e FROM neg),
b AS (SELECT greatest(0, least(19, len(list_filter(e, lambda x: x <= l)) - 1)) AS bin, count(*) AS n FROM neg, e GROUP BY 1),
p AS (SELECT pair_id, greatest(0, least(19, len(list_filter(e, lambda x: x <= n_chars)) - 1)) AS bin FROM pairs, e WHERE success),
r AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY {KEY}, pair_id) AS r FROM p)
SELECT pair_id, bin::INT AS bin FROM r JOIN b USING (bin) WHERE r <= n""")
def length_matched(spark, d):
    p = pairs(spark, d).withColumn("l", F.col("n_chars").cast("double"))
    return sampling.length_matched(p.where("not success"), p.where("success"), "pair_id", "l").select("pair_id", "bin")


def permuted_labels(spark, d):
    p = pairs(spark, d).select("pair_id", "success", "frontier_success")
    return sampling.permuted_labels(p, "pair_id", ["success", "frontier_success"])


query()(permuted_labels)


@query(f"""{P}, s AS (SELECT source AS k, CASE WHEN pair_id % 3 = 0 THEN 'a' WHEN pair_id % 3 = 1 THEN 'b' ELSE 'c' END AS s FROM pairs GROUP BY ALL)
SELECT x.s AS a, y.s AS b, count(*) AS n FROM s x JOIN s y ON x.k = y.k AND x.s < y.s GROUP BY ALL""")
def leak_checks(spark, d):
    side = F.when(F.col("pair_id") % 3 == 0, "a").when(F.col("pair_id") % 3 == 1, "b").otherwise("c")
    return sampling.leaks(pairs(spark, d).withColumn("s", side), "source", "s")


LOG = "SELECT user_id AS key, event_id AS seq, event_type, value FROM events"


@query(f"WITH l AS ({LOG}), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM l) SELECT key, seq, event_type, value FROM r WHERE r = 1")
def last_write_wins(spark, d):
    return logs.last_write(_log(spark, d), "key", "seq")


@query(f"WITH l AS ({LOG}), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS r FROM l) SELECT key, seq, event_type, value FROM r WHERE r = 1")
def first_write_wins(spark, d):
    return logs.first_write(_log(spark, d), "key", "seq")


@query(f"WITH l AS ({LOG}) SELECT count(DISTINCT key) AS kept, count(*) - count(DISTINCT key) AS removed FROM l")
def cache_compaction(spark, d):
    return logs.removed_by_compaction(_log(spark, d), "key")


@query(f"WITH l AS ({LOG}) SELECT seq, key FROM l WHERE key NOT IN (SELECT key FROM l WHERE event_type = 'error' AND value > 50)")
def resume_unfinished(spark, d):
    log = _log(spark, d)
    return logs.unfinished(log.select("seq", "key"), log.where("event_type = 'error' and value > 50"), "key")


def _log(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), "event_type", "value")


@query(f"""{P}, r AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY {KEY}, pair_id) AS r FROM pairs)
SELECT printf('%s-%s%04d', 'router', substr(task, 1, 1), r - 1) AS pair_id, pair_id AS doc_id FROM r""")
def numbered_pairs(spark, d):
    p = pairs(spark, d).withColumn("_k", sampling.order_key("pair_id")).withColumn("doc_id", F.col("pair_id"))
    return logs.numbered(p, "router", ["_k", "doc_id"], "task").select("pair_id", "doc_id")
