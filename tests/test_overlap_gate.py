"""Overlap joins, signed ranks and promotion reasons against plain computations."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quartzgate.functions import spans as S
from quartzgate.operators import gate, judging, metrics, overlap


def test_overlaps_equal_all_pairs(spark):
    rnd = random.Random(9)
    def side(n, seed):  # noqa: E306
        out = [(rnd.choice("ab"), i, s, s + int(2 ** (rnd.random() * 22)) - 1) for i, s in ((seed + k, rnd.randrange(-1000, 4_000_000)) for k in range(n))]
        return out + [(None, seed + n, 0, 10), ("a", seed + n + 1, 5, 5), ("a", seed + n + 2, None, 9)]
    a, b = side(150, 0), side(150, 1000)
    left = spark.createDataFrame(a, "k string, i int, s long, e long").repartition(3)
    right = spark.createDataFrame(b, "k string, j int, s2 long, e2 long").repartition(3)
    want = sorted(
        (x[1], y[1]) for x in a for y in b
        if x[0] is not None and x[0] == y[0] and None not in (x[2], y[2]) and max(x[2], y[2]) < min(x[3], y[3])
    )
    assert len(want) > 500
    for width in (1, 10, 5000):
        got = overlap.overlapping(left, right, ["k"], ("s", "e"), ("s2", "e2"), width)
        assert sorted((r["i"], r["j"]) for r in got.collect()) == want
    with pytest.raises(ValueError, match="both sides"):
        overlap.overlapping(left, left, ["k"], ("s", "e"), ("s", "e"), 10)


def test_spans_of_texts_meet_paragraphs(spark):
    df = spark.createDataFrame([(1, "ab cd\nef gh\n\nij", [(0, 2, "X"), (4, 8, "Y"), (13, 15, "Z")])], f"doc int, text string, gold {S.SPANS}")
    parts = df.select("doc", F.explode(S.paragraphs(F.col("text"), F.col("gold"))).alias("p")).select("doc", F.col("p.start").alias("ps"), (F.col("p.start") + F.length("p.text")).alias("pe"))
    got = overlap.overlapping(overlap.spans_of(df, "doc", "gold", "g_"), parts, ["doc"], ("g_start", "g_end"), ("ps", "pe"), 4)
    assert sorted((r["g_label"], r["ps"]) for r in got.collect()) == [("X", 0), ("Y", 0), ("Y", 6), ("Z", 13)]


def test_signed_rank_p_equals_enumeration(spark):
    rnd = random.Random(4)
    for n in (10, 12, 15):
        values = [rnd.choice([-1, 1]) * (k + 1) for k in range(n)]
        w = sum(abs(v) for v in values if v > 0)
        sums = [sum(k + 1 for k, up in enumerate(signs) if up) for signs in itertools.product([0, 1], repeat=n)]
        low = min(w, n * (n + 1) // 2 - w)
        want = min(1.0, 2 * sum(s <= low for s in sums) / 2**n)
        df = spark.createDataFrame([(float(v), 0.0) for v in values] + [(1.0, 1.0)], "a double, b double")
        row = metrics.signed_rank(df, "a", "b").first()
        assert row["p"] == pytest.approx(want) and row["nonzero"] == n and row["n"] == n + 1 and row["w_plus"] == w
    few = spark.createDataFrame([(float(i), 0.0) for i in range(1, 10)], "a double, b double")
    assert metrics.signed_rank(few, "a", "b").first()["p"] is None
    tied = spark.createDataFrame([(1.0 if i % 3 else -1.0, 0.0) for i in range(60)], "a double, b double")
    row = metrics.signed_rank(tied, "a", "b").first()
    assert row["p"] == pytest.approx(0.0098, abs=5e-4)  # 40 of 60 signs, tied: z = 20 / sqrt(60)
    assert sum(metrics.rank_sum_counts(20)) == 2**20


KEYED = "key string, digest string"


def reasons(spark, old, new, **more):
    frame = lambda rows: spark.createDataFrame(rows, KEYED)
    reports = spark.createDataFrame(more.pop("reports", []), "component string, found boolean")
    out = gate.promotion_reasons(frame(old), frame(new), ["router", "judge"], reports, **more)
    return sorted(map(tuple, out.collect()))


def test_promotion_reasons(spark):
    old = [("components.pii.weights", "1"), ("components.router.weights", "1"), ("eval_splits.pii", "1")]
    moved = [("components.pii.weights", "2"), ("components.router.weights", "2"), ("components.judge.weights", "1"), ("eval_splits.pii", "2")]
    assert reasons(spark, [], moved) == []  # the first manifest
    assert reasons(spark, old, old) == []
    assert reasons(spark, old, moved) == [
        ("components.pii.weights", "moved without a regression run"), ("eval_splits.pii", "split moved without a refreeze"), ("router", "moved without a report"),
    ]
    drops = spark.createDataFrame([("pii", "random", "f1", 0.9, 0.7, 0.2), ("urgency", "random", "f1", 0.9, 0.89, 0.01)], "task string, split string, metric string, baseline double, candidate double, drop double")
    limits = spark.createDataFrame([("pii", 0.1), ("urgency", 0.1)], "task string, threshold double")
    floors = spark.createDataFrame([("urgency", 0.895)], "task string, floor double")
    only = [("components.pii.weights", "2"), ("components.router.weights", "2"), ("eval_splits.pii", "1")]
    assert reasons(spark, old, only, reports=[("router", False)], regression=drops, limits=limits, floors=floors) == [
        ("pii", "drop beyond threshold"), ("router", "its report does not exist"), ("urgency", "below prompted floor"),
    ]
    assert reasons(spark, old, only, reports=[("router", True)], regression=drops) == []  # the gate isn't enforcing
    assert reasons(spark, old, only, reports=[("router", True)], regression=drops, refreeze="D9") == [("D9", "refreeze without a moved split")]
    split = [*old[:2], ("eval_splits.pii", "2")]
    assert reasons(spark, old, split, refreeze="D9") == []
    assert ("components.pii.weights", "moved in a refreeze") in reasons(spark, old, moved, refreeze="D9")


def test_pins_that_moved_are_refused(spark):
    pins = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "task string, threshold double")
    assert judging.pinned(pins, pins, "task", "threshold").count() == 2
    for other in ([("a", 1.0), ("b", 2.1)], [("a", 1.0)], [("a", 1.0), ("b", 2.0), ("c", 1.0)]):
        with pytest.raises(ValueError, match="not reproduced"):
            judging.pinned(pins, spark.createDataFrame(other, "task string, threshold double"), "task", "threshold")
