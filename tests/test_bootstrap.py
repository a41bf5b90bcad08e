"""Intervals by weights against the resamples of the other way, and against plain sums of the same weights."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quartzgate.operators import bootstrap


def frame(spark, n=600):
    rnd = np.random.default_rng(1)
    rows = [(i, "ab"[i % 2], float(rnd.normal()), float(rnd.gamma(2)), bool(rnd.random() < 0.6), bool(rnd.random() < 0.8), float(rnd.random()), i % 7 / 7.0) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k long, task string, d double, base double, success boolean, frontier_success boolean, s double, t double").repartition(6)


def test_weights_are_poisson_and_independent_of_blocks():
    keys = np.arange(3000, dtype=np.int64) * 7919
    w = bootstrap.weights(keys, 0, 200, 5)
    assert w.shape == (3000, 200) and abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert np.array_equal(bootstrap.weights(keys, 100, 50, 5), w[:, 100:150]) and not np.array_equal(bootstrap.weights(keys, 0, 200, 6), w)
    share = np.bincount(w.ravel(), minlength=5)[:5] / w.size
    assert np.allclose(share, [0.3679, 0.3679, 0.1839, 0.0613, 0.0153], atol=0.003)
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.06 and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.25


def hashes(df):
    return {r["k"]: r["h"] for r in df.select("k", F.xxhash64(F.col("k").cast("string")).alias("h")).collect()}


def test_sums_equal_plain_ones(spark):
    rows, df = frame(spark)
    known = hashes(df)
    w = bootstrap.weights(np.array([known[r[0]] for r in rows]), 0, 50, 3).astype(float)
    got = bootstrap.sums_by_weights(df, "k", {"d": F.col("d"), "n": F.lit(1)}, 50, 3)
    assert np.allclose(got, w.T @ np.array([[r[2], 1.0] for r in rows]))


def test_intervals_agree_with_resamples_and_theory(spark):
    rows, df = frame(spark)
    d = np.array([r[2] for r in rows])
    row = bootstrap.mean_difference_by_weights(df, "k", "d", 4000).first()
    half = 1.96 * d.std() / len(d) ** 0.5
    assert row["replicates"] == 4000 and row["low"] == pytest.approx(d.mean() - half, abs=half * 0.15) and row["high"] == pytest.approx(d.mean() + half, abs=half * 0.15)
    other = bootstrap.mean_difference(df, "k", "d", 200).first()
    assert row["low"] == pytest.approx(other["low"], abs=half * 0.4) and row["high"] == pytest.approx(other["high"], abs=half * 0.4)
    ratio = bootstrap.ratio_difference_by_weights(df.withColumn("zero", F.lit(0.0)), "k", "d", "zero", "base", 2000).first()
    b = np.array([r[3] for r in rows])
    point = d.sum() / b.sum()
    half = 1.96 * (d - point * b).std() / b.mean() / len(b) ** 0.5
    assert ratio["low"] == pytest.approx(point - half, abs=half * 0.2) and ratio["high"] == pytest.approx(point + half, abs=half * 0.2)


@pytest.mark.parametrize("column,reverse", [("s", 6), ("t", 7)])
def test_qualities_equal_plain_replicates(spark, column, reverse):
    rows, df = frame(spark, 300)
    known = hashes(df)
    order = sorted(rows, key=lambda r: (-r[reverse], r[0]))
    w = bootstrap.weights(np.array([known[r[0]] for r in order]), 0, 40, 0)
    want = []
    for r in range(40):
        copies = [row for row, n in zip(order, w[:, r]) for _ in range(n)]
        cut = round(0.2 * len(copies))
        want.append(np.mean([row[5] for row in copies[:cut]] + [row[4] for row in copies[cut:]]))
    assert np.allclose(bootstrap.qualities_by_weights(df, "k", column, 0.2, 40), want)
    for budget in (0.0, 1.0):
        got = bootstrap.qualities_by_weights(df, "k", column, budget, 8)
        each = np.array([[r[5] if budget else r[4]] for r in order], float)
        assert np.allclose(got, (w[:, :8].T @ each)[:, 0] / w[:, :8].sum(0))


def test_empty_tables_have_no_interval(spark):
    _, df = frame(spark, 10)
    assert bootstrap.mean_difference_by_weights(df.limit(0), "k", "d", 20).first()["replicates"] == 0
    assert bootstrap.paired_quality_by_weights(df.limit(0), "k", ("s", "t"), 0.2, 20).first()["low"] is None


def _plain_draws(keys, replicates, prefix=""):
    import hashlib

    n = len(keys)
    draw = lambda r, d: int(hashlib.md5(f"{prefix}{r}|{d}|0".encode()).hexdigest()[:8], 16) % n
    return [[sorted(keys)[draw(r, d)] for d in range(n)] for r in range(replicates)]


def _broadcast_sides(df):
    """The plan below each broadcast, by lines."""
    import re

    lines = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines()
    depth = lambda x: len(re.match(r"[\s:+\-]*", x)[0])
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = lines[i + 1 :]
            end = next((j for j, x in enumerate(below) if depth(x) <= depth(line)), len(below))
            yield "\n".join(below[:end])


def test_draws_are_neither_broadcast_nor_made_in_one_task(spark):
    rows, df = frame(spark)
    drawn = bootstrap.resamples(df, "k", 5, 0)
    drawn.collect()
    assert not any("Generate explode" in x for x in _broadcast_sides(drawn))
    got = {}
    for r in drawn.collect():
        got.setdefault(r["replicate"], []).append(r["k"])
    want = _plain_draws([r[0] for r in rows], 5)
    assert {r: sorted(v) for r, v in got.items()} == {r: sorted(v) for r, v in enumerate(want)}
    made = bootstrap._draws(df, "k", 5, 0, [])[1]
    assert sum(n > 0 for n in made.rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect()) > 1


def test_paired_quality_equals_a_plain_loop_for_any_run(spark, monkeypatch):
    rows, _ = frame(spark, 200)
    rows = [(*r[:4], None if r[0] % 17 == 0 else r[4], None if r[0] % 23 == 0 else r[5], *r[6:]) for r in rows]
    df = spark.createDataFrame(rows, "k long, task string, d double, base double, success boolean, frontier_success boolean, s double, t double").repartition(6)
    by = {r[0]: r for r in rows}
    parts = [_plain_draws([k for k in by if by[k][1] == x], 20, f"{x}:") for x in "ab"]
    d = []
    for one in map(sum, zip(*parts), [[]] * 20):
        q = []
        for score in (6, 7):
            order = sorted(one, key=lambda k: (-by[k][score], k))
            out = [by[k][5 if i < round(len(order) * 0.2) else 4] for i, k in enumerate(order)]
            q.append(np.mean([x for x in out if x is not None]))
        d.append(q[0] - q[1])
    for run in (7, 50_000):
        monkeypatch.setattr(bootstrap, "RUN", run)
        row = bootstrap.paired_quality(df, "k", ("s", "t"), 0.2, 20).first()
        assert row["replicates"] == 20 and [row["low"], row["high"]] == pytest.approx(np.percentile(d, [2.5, 97.5]).tolist(), abs=1e-12)
