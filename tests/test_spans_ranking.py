"""Spans and ranking against plain loops."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from quartzgate.functions import spans as S
from quartzgate.operators import pii, ranking

SPAN = "array<struct<start:int,end:int,label:string>>"


def test_locate_equals_a_plain_search(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(300):
        text = "".join(rnd.choice("aab ") for _ in range(rnd.randint(0, 30)))
        pairs = [("L", "".join(rnd.choice("aab ") for _ in range(rnd.randint(0, 4)))) for _ in range(rnd.randint(0, 6))]
        rows.append((i, text, pairs))
    df = spark.createDataFrame(rows, "i int, text string, pairs array<struct<label:string,value:string>>")
    got = {r["i"]: r["x"] for r in df.select("i", S.locate(F.col("text"), F.col("pairs")).alias("x")).collect()}
    for i, text, pairs in rows:
        placed, lost = [], []
        for label, value in pairs:
            if value:
                fits = [k for k in range(len(text)) if text.startswith(value, k) and all(k >= e or k + len(value) <= s for s, e, _ in placed)]
                if fits:
                    placed.append((fits[0], fits[0] + len(value), label))
                else:
                    lost.append((label, value, "repeated_value" if value in text else "invented"))
        assert [tuple(s) for s in got[i]["placed"]] == placed and [tuple(u) for u in got[i]["unplaced"]] == lost


def test_locate_is_fast_on_long_texts(spark):
    df = spark.createDataFrame([("x " * 50_000 + "end", [("A", "end"), ("B", "x x"), ("C", "no")])], "text string, pairs array<struct<label:string,value:string>>")
    place = df.select(S.locate(F.col("text"), F.col("pairs")).alias("x"))
    place.collect()
    began = time.time()
    got = place.collect()[0]["x"]
    assert [s["start"] for s in got["placed"]] == [100_000, 0] and time.time() - began < 5


def test_errors_take_the_best_free_pair(spark):
    rnd = random.Random(2)

    def spans(n):
        out = set()
        while len(out) < n:
            a = rnd.randrange(18)
            out.add((a, a + rnd.randint(1, 5), rnd.choice("XY")))
        return sorted(out, key=lambda _: rnd.random())

    def kind(g, p):
        over = g[0] < p[1] and p[0] < g[1]
        same = g[:2] == p[:2]
        return 0 if g == p else 1 if same else 2 if over and g[2] == p[2] else 3 if over else None

    rows = [(i, "abcdefghijklmnopqrstuvwxyz", spans(rnd.randint(0, 6)), spans(rnd.randint(0, 6)), [("Z", "q", "invented")] * (i % 2)) for i in range(200)]
    df = spark.createDataFrame(rows, f"doc long, text string, gold {SPAN}, predicted {SPAN}, unplaced array<struct<label:string,value:string,why:string>>")
    got: dict[int, list] = {}
    for r in pii.errors(df).collect():
        got.setdefault(r["doc"], []).append(tuple(r)[1:])
    for i, text, gold, predicted, unplaced in rows:
        pairs = sorted((kind(g, p), j, k) for j, p in enumerate(predicted) for k, g in enumerate(gold) if kind(g, p) is not None)
        want, ps, gs = [], set(), set()
        cut = lambda s: (s[2], text[s[0] : s[1]])
        for c, j, k in pairs:
            if j not in ps and k not in gs:
                ps.add(j)
                gs.add(k)
                want.append((pii.PAIR_KINDS[c], *cut(gold[k]), *cut(predicted[j])))
        want += [("spurious", None, None, *cut(p)) for j, p in enumerate(predicted) if j not in ps]
        want += [(why, None, None, label, value) for label, value, why in unplaced]
        want += [("missed", *cut(g), None, None) for k, g in enumerate(gold) if k not in gs]
        assert sorted(got.get(i, []), key=repr) == sorted(want, key=repr)


def test_ranks_and_buckets_with_a_value_that_most_rows_share(spark, monkeypatch):
    monkeypatch.setattr(ranking, "ROWS", 400)
    rnd = random.Random(3)
    values = [1.0 if rnd.random() < 0.8 else rnd.choice([0.0, 2.0, None, rnd.random()]) for _ in range(20_000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k long, v double")
    sizes = [r["count"] for r in ranking.bucketed(df, "v", "k").groupBy("_bucket").count().collect()]
    assert len(sizes) >= 40 and max(sizes) <= 2.5 * len(values) / 50
    order = sorted(range(len(values)), key=lambda i: (values[i] is None, -(values[i] or 0), i))
    want = {k: n + 1 for n, k in enumerate(order)}
    assert {r["k"]: r["rank"] for r in ranking.ranked(df, "v", "k").collect()} == want
    few = spark.createDataFrame([(1, 0.5), (2, None), (3, 0.5)], "k long, v double")
    assert {r["k"]: r["rank"] for r in ranking.ranked(few, "v", "k").collect()} == {1: 1, 3: 2, 2: 3}
    assert ranking.ranked(few.where("k < 0"), "v", "k").count() == 0
