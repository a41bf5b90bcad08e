"""Queries over scored records: success rules, failure buckets, prompts, live grading and report rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import economics, features, online, ranking, records, routing
from ..sources.tables import table
from .base import PAIRS, PREDICTIONS, TURNS, pairs, predictions, turns
from .registry import query

KINDS = ("intent", "urgency", "pii", "drafting")
SCORED = f"""WITH {PAIRS}, scored AS (
  SELECT pair_id, ['intent', 'urgency', 'pii', 'drafting'][1 + pair_id % 4] AS task,
         CASE WHEN pair_id % 4 < 2 THEN success::INT END AS exact, CASE WHEN pair_id % 4 = 2 THEN n_chars % 3 END AS tp,
         CASE WHEN pair_id % 4 = 2 THEN n_chars % 3 + n_chars % 2 END AS gold_spans, CASE WHEN pair_id % 4 = 2 THEN (n_chars % 3 + n_chars % 5 // 3) * (n_chars % 7)::BOOLEAN::INT END AS pred_spans,
         CASE WHEN pair_id % 4 = 2 THEN n_chars % 3 + n_chars % 11 // 10 END AS relaxed, CASE WHEN pair_id % 4 = 3 THEN (n_chars % 10) / 10e0 END AS proxy FROM pairs),
cut AS (SELECT median(proxy) AS cut FROM scored WHERE task = 'drafting'),
labelled AS (SELECT *, CASE task WHEN 'pii' THEN tp > 0 AND tp = gold_spans AND tp = pred_spans WHEN 'drafting' THEN proxy > 0 AND proxy >= cut ELSE exact = 1 END AS success,
  CASE task WHEN 'pii' THEN 'span_f1' WHEN 'drafting' THEN 'proxy_median' ELSE 'exact' END AS label_rule, task = 'drafting' AS label_is_proxy FROM scored, cut)"""


def _scored(spark, d):
    p = pairs(spark, d)
    n, k = F.col("n_chars"), F.col("pair_id") % 4
    only = lambda i, c: F.when(k == i, c)
    return p.select(
        "pair_id", F.element_at(F.array(*map(F.lit, KINDS)), (k + 1).cast("int")).alias("task"), F.when(k < 2, F.col("success").cast("int")).alias("exact"),
        only(2, n % 3).alias("tp"), only(2, n % 3 + n % 2).alias("gold_spans"),
        only(2, (n % 3 + F.floor(n % 5 / 3)) * F.when(n % 7 == 0, 0).otherwise(1)).alias("pred_spans"), only(2, n % 3 + F.floor(n % 11 / 10)).alias("relaxed"),
        only(3, (n % 10) / 10.0).cast("double").alias("proxy"),
    )


@query(f"{SCORED} SELECT pair_id, task, success, label_rule, label_is_proxy FROM labelled")
def success_labels(spark, d):
    return records.labelled(_scored(spark, d)).select("pair_id", "task", "success", "label_rule", "label_is_proxy")


@query(f"""{SCORED}, f AS (SELECT *, coalesce(2e0 * tp / nullif(gold_spans + pred_spans, 0), 0) AS s, coalesce(2e0 * relaxed / nullif(gold_spans + pred_spans, 0), 0) AS r FROM labelled)
SELECT task, CASE WHEN success THEN NULL WHEN task IN ('intent', 'urgency') THEN 'wrong_label' WHEN task = 'drafting' THEN 'off_reference'
  WHEN coalesce(pred_spans, 0) = 0 THEN 'no_output' WHEN r > s + 0.01 THEN 'boundary' WHEN tp < gold_spans AND NOT tp < pred_spans THEN 'missed'
  WHEN tp < pred_spans AND NOT tp < gold_spans THEN 'invented' ELSE 'mixed' END AS bucket, count(*) AS n FROM f GROUP BY ALL""")
def failure_buckets(spark, d):
    out = records.labelled(_scored(spark, d)).withColumn("bucket", records.failure_type())
    return out.groupBy("task", "bucket").agg(F.count("*").alias("n"))


@query(f"""{SCORED}, g AS (SELECT l.pair_id, l.task, l.success, CASE WHEN task = 'drafting' THEN l.pair_id % 5 + 1 END AS grade FROM labelled l)
SELECT pair_id, CASE WHEN task = 'drafting' THEN grade >= 4 ELSE success END AS success, CASE WHEN task = 'drafting' THEN success END AS proxy_success FROM g""")
def judged_labels(spark, d):
    r = records.labelled(_scored(spark, d))
    grades = r.where("task = 'drafting'").select("pair_id", (F.col("pair_id") % 5 + 1).alias("grade"))
    return records.relabelled(r, grades).select("pair_id", "success", "proxy_success")


@query(f"""WITH {TURNS} SELECT conv_id, turn, 'REQUEST:' || chr(10) || request || chr(10) || chr(10) || 'REPLY:' || chr(10) || reply AS judge, 'task: drafting | ' || request AS router FROM turns""")
def model_texts(spark, d):
    t = turns(spark, d)
    return t.select("conv_id", "turn", records.judge_text(F.col("request"), F.col("reply")).alias("judge"), records.router_text(F.lit("drafting"), F.col("request")).alias("router"))


@query(f"""WITH {PAIRS} SELECT pair_id, frontier_success AND NOT success AS rescue FROM pairs""")
def rescues(spark, d):
    p = pairs(spark, d)
    return records.rescue(p.select("pair_id", "success"), p.select("pair_id", "success", "frontier_success"))


@query(f"""WITH {PAIRS} SELECT row FROM (SELECT pair_id // 10 AS row, bool_or(success AND frontier_success) AS ok FROM pairs GROUP BY 1) WHERE NOT ok""")
def shared_failures(spark, d):
    rows = pairs(spark, d).select(F.floor(F.col("pair_id") / 10).alias("row"), F.lit("a").alias("source"), (F.col("success") & F.col("frontier_success")).alias("ok"))
    return records.every_source_fails(rows)


@query("""SELECT DISTINCT a.role AS a, b.role AS b FROM conversations a JOIN conversations b ON a.role < b.role
WHERE NOT EXISTS (SELECT 1 FROM conversations x JOIN conversations y ON x.conv_id % 3 = y.conv_id % 3 AND x.role = a.role AND y.role = b.role AND (length(x.text) > 20) <> (length(y.text) > 20))""")
def identical_answers(spark, d):
    c = table(spark, d, "conversations").select(F.col("role").alias("adapter"), (F.col("conv_id") % 3).alias("probe"), (F.length("text") > 20).cast("string").alias("text"))
    return records.identical_adapters(c.distinct())


@query(f"""WITH {PAIRS}, {PREDICTIONS}, v AS (SELECT task, list_sort(list(DISTINCT prediction)) AS labels FROM predictions GROUP BY task) SELECT task, len(labels) AS n, array_to_string(labels, ',') AS vocabulary FROM v""")
def label_vocabulary(spark, d):
    p = predictions(spark, d).groupBy("task").agg(F.sort_array(F.collect_set("prediction")).alias("v"))
    return p.select("task", F.size("v").cast("long").alias("n"), F.array_join("v", ",").alias("vocabulary"))


@query(r"""SELECT conv_id, turn, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) > 60 AS out_of_domain FROM conversations""")
def domain_flags(spark, d):
    c = table(spark, d, "conversations")
    words = T.word_count(F.col("text"))
    return c.select("conv_id", "turn", features.out_of_domain(F.lit(1.0), words, F.lit(0.0), F.lit(60)).alias("out_of_domain"))


@query("""WITH w AS (SELECT len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS words, length(text) % 100 / 100e0 AS similarity FROM conversations)
SELECT quantile_cont(similarity, 0.05) AS similarity, quantile_cont(words, 0.95) AS words FROM w""")
def domain_thresholds(spark, d):
    c = table(spark, d, "conversations").select(T.word_count(F.col("text")).alias("words"), (F.length("text") % 100 / 100.0).cast("double").alias("similarity"))
    return features.domain_thresholds(c)


@query("""SELECT role, count(*) AS calls, sum(length(text) / 4e0 * 1.15e0) AS tokens, sum(length(text) / 4e0 * 1.15e0) * 0.15e0 / 1e6 AS usd FROM conversations GROUP BY role""")
def projected_cost(spark, d):
    tokens = F.length("text") / 4.0 * 1.15
    c = table(spark, d, "conversations").withColumn("t", tokens)
    return c.groupBy("role").agg(F.count("*").alias("calls"), F.sum("t").alias("tokens"), economics.frontier_usd(F.sum("t"), F.lit(0.0)).alias("usd"))


@query("""SELECT event_id AS trace, user_id, ts AS start, ts + to_microseconds((value * 1000)::BIGINT) AS stop FROM events""")
def trace_spans(spark, d):
    e = table(spark, d, "events")
    start = F.col("ts").cast("timestamp")
    stop = F.timestamp_micros(F.unix_micros(start) + F.round(F.col("value") * 1000).cast("long"))
    return e.select(F.col("event_id").alias("trace"), "user_id", "ts", stop.cast("timestamp_ntz").alias("stop")).withColumnRenamed("ts", "start")


@query(f"""WITH {PAIRS}, c AS (SELECT task, row_number() OVER (PARTITION BY task ORDER BY pair_id) AS i, pair_id FROM pairs), n AS (SELECT min(k) AS k FROM (SELECT count(*) AS k FROM pairs GROUP BY task))
SELECT i AS ticket, list(pair_id ORDER BY task) AS pairs FROM c, n WHERE i <= k GROUP BY i""")
def ticket_batches(spark, d):
    p = pairs(spark, d).withColumn("_k", -F.col("pair_id").cast("double"))
    least = p.groupBy("task").count().agg(F.min("count")).first()[0]
    n = ranking.ranked(p, "_k", "pair_id", ["task"], "ticket").where(F.col("ticket") <= least)
    sets = n.groupBy("ticket").agg(F.sort_array(F.collect_list(F.struct("task", "pair_id"))).alias("p"))
    return sets.select("ticket", F.transform("p", lambda x: x["pair_id"]).alias("pairs"))


def false_positive_rates(spark, d):
    """Texts that the screen passes, with an output that names their first word or a word they lack."""
    c = table(spark, d, "conversations").where(T.pii_free(F.col("text")) & (F.length("text") > 0))
    word = F.get(T.words(F.col("text")), F.lit(0))
    n = F.col("conv_id") % 3
    out = F.when(n == 0, F.concat(F.lit("CITY: "), word)).when(n == 1, "CITY: Nowhere").otherwise("")
    return records.false_positives(c.select(F.col("role").alias("source"), "text", out.alias("output")))


query()(false_positive_rates)


@query(f"""WITH {PAIRS}, {PREDICTIONS}, r AS (SELECT task, split, avg((gold = prediction)::INT) AS a FROM predictions GROUP BY ALL)
SELECT task, max(a) FILTER (WHERE split = 'random') AS random, max(a) FILTER (WHERE split = 'hard') AS hard,
CASE WHEN max(a) FILTER (WHERE split = 'random') >= 0.85 THEN 'met' ELSE 'missed' END AS target FROM r GROUP BY task""")
def dashboard_rows(spark, d):
    p = predictions(spark, d).groupBy("task").pivot("split", ["random", "hard"]).agg(F.avg((F.col("gold") == F.col("prediction")).cast("int")))
    return p.withColumn("target", F.when(F.col("random") >= 0.85, "met").otherwise("missed"))


@query(f"""WITH {PAIRS} SELECT pair_id, n_chars, CASE WHEN n_chars % 4 = 0 THEN 'local' ELSE 'frontier' END AS source FROM pairs WHERE n_chars BETWEEN 200 AND 2000""")
def length_filter(spark, d):
    p = pairs(spark, d).where(F.col("n_chars").between(200, 2000))
    return p.select("pair_id", "n_chars", F.when(F.col("n_chars") % 4 == 0, "local").otherwise("frontier").alias("source"))


@query(f"""WITH {PAIRS}, q AS (SELECT avg(success::INT) AS floor, avg(frontier_success::INT) AS frontier, avg((success OR frontier_success)::INT) AS best FROM pairs)
SELECT floor, frontier, best, (frontier - floor) / nullif(best - floor, 0) AS captured FROM q""")
def gain_captured(spark, d):
    s, f = F.col("success"), F.col("frontier_success")
    q = pairs(spark, d).agg(F.avg(s.cast("int")).alias("floor"), F.avg(f.cast("int")).alias("frontier"), F.avg((s | f).cast("int")).alias("best"))
    return q.withColumn("captured", F.try_divide(F.col("frontier") - F.col("floor"), F.col("best") - F.col("floor")))


def served_quality(spark, d):
    """Recorded decisions served as they were, beside the routed ones: per task the success of what answered."""
    tagged = routing.misroutes(pairs(spark, d))
    ok = F.col("pair_id") % 7 != 0
    by = online.served_by(F.when(F.col("escalated"), "escalated").otherwise("local"), ok, F.lit(None).cast("string"))
    served = F.when(by == "frontier", F.col("frontier_success")).otherwise(F.col("success")).cast("int")
    routed = F.when(F.col("escalated"), F.col("frontier_success")).otherwise(F.col("success")).cast("int")
    return tagged.groupBy("task").agg(F.avg(served).alias("as_served"), F.avg(routed).alias("routed"))


query(f"""WITH {PAIRS}, r AS (SELECT *, row_number() OVER (ORDER BY -mean_logprob DESC, pair_id) <= round_even(0.2e0 * count(*) OVER (), 0) AS up FROM pairs)
SELECT task, avg(CASE WHEN up AND pair_id % 7 <> 0 THEN frontier_success ELSE success END::INT) AS as_served, avg(CASE WHEN up THEN frontier_success ELSE success END::INT) AS routed FROM r GROUP BY task""")(served_quality)
