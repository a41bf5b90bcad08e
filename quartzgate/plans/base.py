"""Relations derived from the driver's tables, alike in Spark and in DuckDB.

Scored pairs stand for (request, task) rows: a document is a pair, its language the task, its quality label the
local outcome, its toxicity label (inverted) the frontier's, and a number from its length the mean log-probability.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table


def pairs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, d, "labels")
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("pair_id"), F.col("lang").alias("task"), "source", "n_chars", (F.col("quality") == 1).alias("success"),
        (F.col("toxic") == 0).alias("frontier_success"), (-(F.col("n_chars") % 997).cast("double") / F.lit(997.0)).alias("mean_logprob"),
    )


PAIRS = """pairs AS (
  SELECT d.doc_id AS pair_id, d.lang AS task, d.source, d.n_chars, l.quality = 1 AS success, l.toxic = 0 AS frontier_success,
         -(d.n_chars % 997)::DOUBLE / 997e0 AS mean_logprob
  FROM documents d JOIN labels l USING (doc_id))"""


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Gold and predicted classes of documents, with a split by hash and the source as the run."""
    p = pairs(spark, d)
    gold = F.when(F.col("success"), "good").otherwise("bad")
    guess = F.when(F.col("n_chars") % 7 == 0, "bad").when(F.col("n_chars") % 11 == 0, "unsure").otherwise("good")
    split = F.when(F.substring(F.md5(F.col("pair_id").cast("string")), 1, 1) < "8", "random").otherwise("hard")
    return p.select("pair_id", "task", "source", gold.alias("gold"), guess.alias("prediction"), split.alias("split"))


PREDICTIONS = """predictions AS (
  SELECT pair_id, task, source, CASE WHEN success THEN 'good' ELSE 'bad' END AS gold,
         CASE WHEN n_chars % 7 = 0 THEN 'bad' WHEN n_chars % 11 = 0 THEN 'unsure' ELSE 'good' END AS prediction,
         CASE WHEN substr(md5(pair_id::VARCHAR), 1, 1) < '8' THEN 'random' ELSE 'hard' END AS split
  FROM pairs)"""


def turns(spark: SparkSession, d: str) -> DataFrame:
    """A user's turn beside the assistant's next one."""
    c = table(spark, d, "conversations")
    u = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("request"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return u.join(a, ["conv_id", "turn"])


TURNS = """turns AS (
  SELECT u.conv_id, u.turn, u.text AS request, a.text AS reply
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""


def grades(spark: SparkSession, d: str) -> DataFrame:
    """Two graders' scores of the same replies, from their lengths."""
    t = turns(spark, d)
    return t.select(
        "conv_id", "turn", (F.length("request") % 5 + 1).cast("double").alias("teacher"),
        ((F.length("request") * 3 + F.length("reply")) % 41 / 10.0 + 0.9).cast("double").alias("student"),
    )


GRADES = """grades AS (
  SELECT conv_id, turn, (length(request) % 5 + 1)::DOUBLE AS teacher,
         ((length(request) * 3 + length(reply)) % 41)::DOUBLE / 10e0 + 0.9e0 AS student
  FROM turns)"""

REQUESTS = """requests AS (
  SELECT event_id AS request_id, user_id, 't' || (user_id % 4) AS task, ts, value AS latency_ms,
         CASE event_type WHEN 'error' THEN 'fallback' WHEN 'purchase' THEN 'escalated' WHEN 'signup' THEN 'out_of_domain'
              ELSE 'local' END AS route,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens
  FROM events)"""
