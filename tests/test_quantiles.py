"""Exact quantiles, ranks in many buckets and allocations against plain computations."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from quartzgate.operators import pools, quantiles, ranking, routing

PROBS = [0.0, 0.05, 0.25, 0.5, 0.73, 0.95, 1.0]


def groups(rnd):
    """Groups of many shapes: spread out, heavily tied, of few values, with extremes, single, empty."""
    return {
        "wide": [rnd.gauss(0, 1) * 10 ** rnd.randint(-9, 9) for _ in range(700)],
        "tied": [5.0] * 500 + [rnd.random() * 10 for _ in range(200)],
        "two": [1.0] * 300 + [2.0] * 301,
        "ends": [0.0] * 250 + [float(i) for i in range(100)] + [99.0] * 250,
        "one": [3.5],
        "none": [None, None],
        None: [float(i % 17) for i in range(90)],
    }


@pytest.mark.parametrize("limit", [10, 10**6])
@pytest.mark.parametrize("kind", ["interpolated", "lower"])
def test_quantiles_equal_numpy(spark, limit, kind):
    rows = [(g, v) for g, values in groups(random.Random(1)).items() for v in values]
    df = spark.createDataFrame(rows, "task string, v double").repartition(6)
    got = {r["task"]: (r["n"], r["q"]) for r in quantiles.exact(df, "v", PROBS, ["task"], kind, limit).collect()}
    method = "linear" if kind == "interpolated" else "lower"
    for g in {r[0] for r in rows}:
        values = [v for t, v in rows if t == g and v is not None]
        assert got[g][0] == len(values)
        want = [None] * len(PROBS) if not values else np.quantile(values, PROBS, method=method).tolist()
        assert got[g][1] == (want if not values else pytest.approx(want, rel=1e-12, abs=1e-12))


def test_quantiles_of_a_whole_table(spark):
    values = [float(x * x % 1009) for x in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    for limit in (50, 10**6):
        row = quantiles.exact(df, "v", PROBS, limit=limit).first()
        assert row["q"] == pytest.approx(np.quantile(values, PROBS).tolist()) and row["n"] == 3000
    assert quantiles.exact(df.limit(0), "v", [0.5]).first()["q"] == [None]
    assert quantiles.exact(df.limit(0), "v", [0.5], limit=-1).first()["q"] == [None]


def test_no_aggregate_holds_a_group(spark):
    df = spark.range(1000).selectExpr("id % 3 as g", "cast(id as double) as v")
    plan = quantiles.exact(df, "v", [0.5], ["g"])._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan for x in (" percentile(", "median(", "collect_list(v"))


def test_ranks_in_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(ranking, "ROWS", 20)
    monkeypatch.setattr(ranking, "SAMPLED", 8)
    rnd = random.Random(2)
    rows = [(i, rnd.choice([None, float("nan"), 1.0, 2.0, rnd.random(), float("inf")]), rnd.choice("ab")) for i in range(4000)]
    df = spark.createDataFrame(rows, "k long, v double, g string").repartition(5)
    assert ranking.bucketed(df.where("v is not null and not isnan(v)"), "v", "k").select("_bucket").distinct().count() > 50
    got = {r["k"]: r["rank"] for r in ranking.ranked(df, "v", "k", ["g"]).collect()}
    for g in "ab":
        order = sorted((r for r in rows if r[2] == g), key=lambda r: (r[1] is None or r[1] != r[1], -(r[1] or 0) if r[1] == r[1] else 0, r[0]))
        assert [got[r[0]] for r in order] == list(range(1, len(order) + 1))
    assert ranking.ranked(df, "v", "k", ["g"], rows=4000).count() == 4000


def plain_allocation(curves, total):
    """The largest gain; of equal ones the fewest escalations, then the fewest before the last task, and so on."""
    best = None
    names = sorted(curves)
    for picks in itertools.product(*[range(len(curves[n])) for n in names]):
        if sum(picks) <= total:
            gain = sum(curves[n][k] for n, k in zip(names, picks))
            key = (-gain, *[sum(picks[:i]) for i in range(len(picks), 0, -1)])
            if best is None or key < best[0]:
                best = (key, {n: (k, curves[n][k]) for n, k in zip(names, picks)})
    return best[1]


def test_allocation_equals_all_choices(spark, monkeypatch):
    monkeypatch.setattr(routing, "STRETCH", 3)
    rnd = random.Random(6)
    for _ in range(6):
        curves = {}
        for task in "abcd"[: rnd.randint(1, 4)]:
            curve = [0]
            for _ in range(rnd.randint(0, 9)):
                curve.append(curve[-1] + rnd.choice([-1, 0, 1, 1]))
            curves[task] = curve
        total = rnd.randint(0, 14)
        rows = [(t, k, g) for t, c in curves.items() for k, g in enumerate(c)]
        gains = spark.createDataFrame(rows, "task string, rank long, cumulative long")
        assert routing.best_allocation(gains, total) == plain_allocation(curves, total)


def test_exclusive_quantile_of_ties(spark):
    df = spark.createDataFrame([(float(x % 3),) for x in range(30)], "v double")
    assert pools.exclusive_quantile(df, "v", 50).first()["value"] == 1.0
