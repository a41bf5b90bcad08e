"""Pools, plans, judging reports and text models on literal fixtures."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from quartzgate.functions import spans as S
from quartzgate.operators import features, judging, pools


def test_screens(spark):
    df = spark.createDataFrame([("a", "x"), ("b", None), ("c", "  "), (None, "y"), ("d", " ")], "k string, t string")
    assert [r["k"] for r in pools.present(df, ["k", "t"]).collect()] == ["a"]
    texts = spark.createDataFrame([("x" * 14, None), ("x" * 15, None), ("x" * 2048, None), ("x" * 2049, None), ("x" * 2049, 512)], "t string, n int")
    got = texts.select(pools.long_enough(F.col("t")), pools.within_cap(F.col("t")), pools.within_cap(F.col("t"), F.col("n"))).collect()
    assert [tuple(r) for r in got] == [(False, True, True), (True, True, True), (True, True, True), (True, False, False), (True, False, True)]


def test_pool_excludes_and_counts(spark):
    rows = [(i, f"t{i // 2}" if i < 20 else f"t{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, text string")
    excluded = spark.createDataFrame([(i,) for i in range(50, 60)], "id long")
    got = pools.pool(df, "id", "text", excluded, {"router": 25, "mining": 10}).collect()
    ids = [r["id"] for r in got]
    assert sorted(r["part"] for r in got) == ["mining"] * 10 + ["router"] * 25
    assert len(set(ids)) == 35 and max(ids) < 50 and all(i % 2 == 0 for i in ids if i < 20)
    with pytest.raises(ValueError):
        pools.pool(df, "id", "text", excluded, {"router": 41})


def test_balanced_plans_and_demonstrations(spark):
    df = spark.createDataFrame([(i, "a" if i % 4 else "b") for i in range(40)], "id long, label string")
    assert {r["label"]: r["count"] for r in pools.balanced(df, "label", "id").groupBy("label").count().collect()} == {"a": 10, "b": 10}
    plan = pools.labelling_plan(df.where("id < 10"), df.where("id >= 10"), "id", 12, 5).collect()
    assert len(plan) == 22 and sum(r["calibration"] for r in plan) == 5 and sum(r["origin"] == "mining" for r in plan) == 12
    shown = pools.demonstrations(df, df.where("id < 30"), "id", "label", per_class=2).collect()
    assert sorted(r["label"] for r in shown) == ["a", "a", "b", "b"] and min(r["id"] for r in shown) >= 30
    with pytest.raises(ValueError):
        pools.demonstrations(df, df, "id", "label")


def test_same_rows_are_asserted(spark):
    a = spark.createDataFrame([(0, "x", 1), (1, "y", 2)], "n int, text string, a int")
    b = spark.createDataFrame([(1, "y", 5), (0, "x", 4)], "n int, text string, b int")
    assert sorted(tuple(r) for r in pools.same_rows(a, b, "n", ["text"]).collect()) == [(0, "x", 1, 4), (1, "y", 2, 5)]
    for other in (b.where("n = 0"), b.withColumn("text", F.lit("x"))):
        with pytest.raises(ValueError):
            pools.same_rows(a, other, "n", ["text"])


def test_exclusive_quantile_equals_the_library(spark):
    r = random.Random(3)
    for n in (2, 7, 99, 150):
        values = [r.gauss(0, 1) for _ in range(n)]
        df = spark.createDataFrame([(v,) for v in values], "v double")
        for q in (5, 50, 95):
            assert abs(pools.exclusive_quantile(df, "v", q).first()["value"] - statistics.quantiles(values, n=100)[q - 1]) < 1e-9


def test_pins_and_decisions(spark):
    pins = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double")
    assert judging.pinned(pins, pins.withColumn("v", F.col("v") + 1e-12), "k", "v").count() == 2
    for again in (pins.withColumn("v", F.col("v") + 1e-6), pins.where("k = 'a'")):
        with pytest.raises(ValueError):
            judging.pinned(pins, again, "k", "v")
    held = spark.createDataFrame([("m", "1"), ("n", "2")], "component string, digest string")
    swapped = judging.pins_with(held, spark.createDataFrame([("n", "3")], held.schema)).collect()
    assert sorted(tuple(r) for r in swapped) == [("m", "1", False), ("n", "3", True)]
    with pytest.raises(ValueError):
        judging.pins_with(held, spark.createDataFrame([("x", "3")], held.schema))
    taken = judging.decision(spark.createDataFrame([("a", 0.1), ("b", 0.0), ("c", None)], "variant string, low double"), 0.0).collect()
    assert {r["variant"]: r["taken"] for r in taken} == {"a": True, "b": False, "c": False}


def test_served_errors_and_outside_block(spark):
    rows = [("label", "a", "a", 5, 0, False), ("label", "a", "z", 5, 0, True), ("label", "a", None, 5, 0, True), ("label", "z", "z", 5, 0, True),
            ("grade", None, None, 3, 0, True), ("grade", None, None, 4, 0, False), ("spans", None, None, 5, 1, True), ("spans", None, None, 5, 0, False)]
    df = spark.createDataFrame(rows, "kind string, gold string, prediction string, grade int, partly int, want boolean")
    assert all(r["served_error"] == r["want"] for r in judging.served_errors(df, "kind", ["a", "b"]).collect())
    out = spark.createDataFrame([("t", "a", "a", True), ("t", "a", "b", False), ("t", None, "a", True), ("t", None, "q", True), ("t", "b", None, True)],
                                "task string, gold string, prediction string, e boolean")
    got = judging.outside_block(out, "task", ["a", "b"], F.col("e")).first()
    assert tuple(got) == ("t", 5, 2, 1, pytest.approx(1 / 3), 1.0, 0.5)


def test_occurrences_are_all_and_free(spark):
    row = spark.createDataFrame([("Ann Lee met ann at annex, LEE (a.b)", [("N", "Ann Lee"), ("G", "ann"), ("S", "lee"), ("X", "a"), ("Y", "a.b")])],
                                "text string, v array<struct<label:string,value:string>>")
    got = row.select(S.occurrences(F.col("text"), F.col("v")).alias("s")).first()["s"]
    text = "Ann Lee met ann at annex, LEE (a.b)"
    assert [(text[s["start"] : s["end"]], s["label"]) for s in got] == [("Ann Lee", "N"), ("ann", "G"), ("ann", "G"), ("LEE", "S"), ("a.b", "Y")]


def test_word_runs(spark):
    row = spark.createDataFrame([("The old Cat a sat",), ("x",), (None,)], "t string").select(features.word_runs(F.col("t")).alias("r")).collect()
    assert row[0]["r"] == ["the", "old", "cat", "sat", "the old", "old cat", "cat sat"] and row[1]["r"] == []


def test_text_probe_tells_words_from_lengths(spark):
    r = random.Random(2)
    rows = []
    for i in range(120):
        words = [r.choice(["red", "blue", "green", "stone", "river"]) for _ in range(r.randint(4, 9))]
        rows.append((i, i % 3 == 0, " ".join(["please" if i % 3 == 0 else "thanks", *words])))
    df = spark.createDataFrame(rows, "id long, label boolean, text string")
    terms = {"words": features.word_runs(F.col("text")), "length": F.array(F.length("text").cast("string"))}
    got = {x["probe"]: x for x in features.probe(df, terms, "label", folds=2).collect()}
    assert got["words"]["n"] == 120 and got["words"]["accuracy"] > 0.95 and got["words"]["majority"] == pytest.approx(2 / 3)
    assert got["length"]["accuracy"] < 0.85
    sides = features.extremes(features.text_model(df.select("id", "label", terms["words"].alias("terms")), df.select("id", terms["words"].alias("terms")), "label")[1], 2)
    assert {(x["side"], x["term"].split()[0]) for x in sides.collect()} >= {("for", "please"), ("against", "thanks")}


def test_golden_plan_numbers_every_row(spark):
    numbers = spark.range(10_050).select((F.col("id") * 7 % 10_050).alias("k"), F.concat(F.lit("t"), F.col("id") * 7 % 10_050).alias("text"))
    names = spark.createDataFrame([("b", "y"), ("a", "x"), ("c", "z")], "k string, text string")
    got = {r["item_id"]: r["text"] for r in judging.golden_plan({"n": numbers, "s": names}, "text", "k").collect()}
    assert got == {f"golden-n-{i:04d}": f"t{i}" for i in range(10_050)} | {"golden-s-0000": "x", "golden-s-0001": "y", "golden-s-0002": "z"}


def test_evaluated_router_finds_what_a_score_separates(spark):
    rows = [(i, "ab"[i // 2 % 2], i % 10 >= 3, True, (i % 10) / 10.0 - 1.0, 50 + i * 37 % 91) for i in range(200)]
    df = spark.createDataFrame(rows, "pair_id long, task string, success boolean, frontier_success boolean, mean_logprob double, n_chars long")
    curve, ranking = judging.evaluated(df.where("pair_id < 100"), df.where("pair_id >= 100"), ["mean_logprob"], [0.0, 0.1, 0.3, 1.0])
    got = {(r["policy"], r["budget"]): (r["quality"], r["captured"]) for r in curve.collect()}
    assert {k: v[0] for k, v in got.items()} == {(p, b): pytest.approx(q) for p in ("model", "oracle") for b, q in ((0.0, 0.7), (0.1, 0.8), (0.3, 1.0), (1.0, 1.0))}
    assert got["model", 0.3][1] == pytest.approx(1.0) and got["model", 0.0][1] is None
    one = ranking.first()
    assert one["n"] == 100 and one["roc_auc"] == pytest.approx(1.0) and one["base_rate"] == pytest.approx(0.3)
