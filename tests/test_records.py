"""Literal fixtures of the record, report and document operators."""

from __future__ import annotations

import gzip
import json

import pytest
from pyspark.sql import functions as F

from quartzgate.operators import records, reports
from quartzgate.sources import documents

SCORED = "pair_id string, task string, exact int, tp int, gold_spans int, pred_spans int, relaxed int, proxy double"


def scored(spark, rows):
    return spark.createDataFrame(rows, SCORED)


def test_success_rules_and_buckets(spark):
    rows = [
        ("d1", "drafting", None, None, None, None, None, 0.1), ("d2", "drafting", None, None, None, None, None, 0.3), ("d3", "drafting", None, None, None, None, None, 0.5),
        ("d4", "drafting", None, None, None, None, None, 0.7), ("i1", "intent", 1, None, None, None, None, None), ("u1", "urgency", 0, None, None, None, None, None),
        ("p1", "pii", None, 2, 2, 2, 2, None), ("p2", "pii", None, 0, 0, 0, 0, None), ("p3", "pii", None, 1, 2, 2, 2, None), ("p4", "pii", None, 1, 2, 1, 1, None),
        ("p5", "pii", None, 1, 1, 2, 1, None), ("p6", "pii", None, 1, 2, 2, 1, None),
    ]
    out = records.labelled(scored(spark, rows)).withColumn("bucket", records.failure_type())
    got = {r["pair_id"]: (r["success"], r["bucket"]) for r in out.collect()}
    assert [got[f"d{i}"][0] for i in range(1, 5)] == [False, False, True, True]
    assert got["i1"] == (True, None) and got["u1"] == (False, "wrong_label") and got["p1"] == (True, None)
    assert [got[f"p{i}"][1] for i in range(2, 7)] == ["no_output", "boundary", "missed", "invented", "mixed"]


def test_relabelling_refuses_ungraded_drafts(spark):
    df = records.labelled(scored(spark, [("d1", "drafting", None, None, None, None, None, 0.5), ("i1", "intent", 1, None, None, None, None, None)]))
    grades = spark.createDataFrame([("d1", 3)], "pair_id string, grade int")
    got = {r["pair_id"]: (r["success"], r["proxy_success"]) for r in records.relabelled(df, grades).collect()}
    assert got == {"d1": (False, True), "i1": (True, None)}
    with pytest.raises(ValueError, match="no grade"):
        records.relabelled(df, grades.where("grade > 9"))


def test_components_and_malformed(spark):
    rows = [("intent", "t", "refund", " refund \nmore"), ("pii", "Ann lives", "NAME: Ann", "NAME: Ann"), ("drafting", "t", "a b", "a c"), ("pii", "t", "", "just words"), ("drafting", "t", "", " ")]
    df = spark.createDataFrame(rows, "task string, text string, gold string, p string")
    c = [F.col(x) for x in ("task", "text", "gold", "p")]
    out = df.select("task", records.components(*c).alias("c"), records.malformed(F.col("task"), F.col("p"), ["refund"]).alias("m")).collect()
    assert out[0]["c"]["exact"] == 1 and (out[1]["c"]["tp"], out[1]["c"]["gold_spans"]) == (1, 1) and out[2]["c"]["proxy"] == 0.5
    assert [r["m"] for r in out] == [None, None, None, "pii", "reply"]


def test_templates_and_event_streams():
    assert records.spans_of_template("Hi Ann from Rome.", "Hi [NAME_1] from [CITY].") == ([(3, 6, "NAME"), (12, 16, "CITY")], True)
    assert records.spans_of_template("Hello", "Hi [NAME]")[1] is False
    lines = [(0.1, 'data: {"choices": [{"text": ""}]}'), (0.2, 'data: {"choices": [{"text": "a"}]}'), (0.6, 'data: {"choices": [], "usage": {"completion_tokens": 3}}'), (0.7, "data: [DONE]")]
    got = records.event_times(lines)
    assert got["ttft_ms"] == pytest.approx(200) and got["tokens"] == 3 and got["tpot_ms"] == pytest.approx(200)


def test_design_refuses_nulls(spark):
    df = spark.createDataFrame([("a", -1.0, -2.0, 0, "length"), ("b", -0.5, -1.0, 3, "stop")], "task string, mean_logprob double, min_logprob double, n_tokens int, finish_reason string")
    rows = records.design(df, ["a", "b"]).collect()
    assert rows[0]["features"][:5] == [1.0, -1.0, -2.0, 0.0, 1.0] and rows[0]["features"][5:] == [0.0] * 5
    with pytest.raises(ValueError, match="null"):
        records.design(df.withColumn("n_tokens", F.lit(None).cast("int")), ["a"])


def test_false_positive_rates(spark):
    rows = [("s", "say hello", "CITY: hello"), ("s", "say hello", "SEX: h"), ("s", "say hello", "")]
    r = records.false_positives(spark.createDataFrame(rows, "source string, text string, output string")).where("source is null").first()
    assert (r["texts"], r["any_rate"], r["grounded_rate"], r["invented_rate"]) == (3, pytest.approx(2 / 3), pytest.approx(1 / 3), pytest.approx(1 / 3))


def test_verdicts_versions_and_points(spark):
    v = spark.createDataFrame([("a", "better"), ("a", "better"), ("b", "better"), ("b", "worse")], "variant string, verdict string")
    assert {r["variant"]: r["verdict"] for r in reports.combined(v).collect()} == {"a": "better", "b": "mixed"}
    h = spark.createDataFrame([(1, "x", "d1"), (2, "x", "d2")], "version int, component string, digest string")
    again = reports.rolled_back(h, 1).where("version = 3").first()
    assert again["digest"] == "d1"
    c = spark.createDataFrame([("p", 0.2, 0.9)], "policy string, budget double, quality double")
    assert reports.not_reproduced(c, c).isEmpty()
    with pytest.raises(ValueError, match="0 points"):
        reports.curve_point(c, "p", 0.3)


def test_documents(spark, tmp_path):
    record = {"per_split": {"intent": {"random": {"accuracy": 0.9}, "hard": {"accuracy": 0.5}}}, "name": "r1"}
    with gzip.open(tmp_path / "run.json.gz", "wt") as f:
        json.dump(record, f, indent=1)
    df = documents.read_json(spark, f"file://{tmp_path}/run.json.gz")
    assert {(r["task"], r["split"], r["value"]) for r in documents.run_record(df).collect()} == {("intent", "random", 0.9), ("intent", "hard", 0.5)}
    assert {r["key"] for r in documents.flattened(df.drop("file")).collect()} == {"name", "per_split.intent.random.accuracy", "per_split.intent.hard.accuracy"}
    at = f"file://{tmp_path}/table"
    documents.publish(spark.range(2), at, 1)
    documents.publish(spark.range(5), at, 2)
    assert documents.as_of(spark, at).count() == 5 and documents.as_of(spark, at, 1).count() == 2
    documents.write_csv(spark.range(2), f"file://{tmp_path}/c")
    documents.append_log(spark.range(2), f"file://{tmp_path}/l")
    documents.append_log(spark.range(3), f"file://{tmp_path}/l")
    assert spark.read.json(f"file://{tmp_path}/l").count() == 5
