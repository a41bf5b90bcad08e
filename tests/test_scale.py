"""Steps that work in blocks, sweeps or runs, against plain loops and the expressions for short texts."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quartzgate.functions import spans as S
from quartzgate.functions import text as T
from quartzgate.operators import features, models, pii, sweep
from quartzgate.plans import registry

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("block", [50, 8192])
def test_vectors_by_slices_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(features, "SLICE", 7)
    r = np.random.default_rng(3)
    x = np.round(r.normal(size=(170, 6)), 1)
    x[40:60] = x[40]  # ties
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit @ unit.T
    np.fill_diagonal(s, -np.inf)
    want = dict(enumerate(np.sort(s, 1)[:, -5:].mean(1)))
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 6)], "id long, v array<double>")
    got = {r["id"]: r["similarity"] for r in features.nearest_vectors(e, e, block=block).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want)
    few = features.nearest_vectors(e.where("id = 0"), e.where("id < 3"), block=block).first()
    assert few["similarity"] == pytest.approx(s[0, 1:3].mean())
    assert features.nearest_vectors(e.where("id < 0"), e).count() == 0


def test_guard_by_sweep_equals_the_expression(spark):
    r = random.Random(11)
    words = ["a@b.co", "x.y@z.org", "12 34", "aa", "é", " ", "\n", "\r\n", "  ", ":", "\x1f", "male", "m", "2020"]
    labels = ["EMAIL", "DATE", "SEX", "TAXNUM", "lower", "A B"]
    rows = []
    for i in range(300):
        text = "".join(r.choice(words) + r.choice(["", " "]) for _ in range(r.randint(0, 25)))

        def some(n, text=text):
            out = []
            for _ in range(r.randint(0, n) if text else 0):
                a = r.randrange(len(text))
                out.append((a, min(len(text), a + r.randint(0, 7)), r.choice(labels)))
            return out

        rows.append((i, text, some(9), some(9)))
    rows.append((300, None, None, None))
    df = spark.createDataFrame(rows, f"doc long, text string, predicted {S.SPANS}, gold {S.SPANS}").repartition(3)
    want = df.select("doc", pii.guard(F.col("text"), S.to_lines(F.col("text"), F.col("predicted")), F.col("gold")).alias("g"))
    got = {x["doc"]: x["guarded"] for x in pii.guarded(df, "text", "predicted", "gold").collect()}
    assert got == {x["doc"]: x["g"] for x in want.collect()} and got[300] is None and len(set(got.values())) > 100


def test_guard_searches_on_from_a_values_last_place():
    class Text(str):
        read = 0

        def find(self, value, start=0):
            at = super().find(value, start)
            Text.read += (at if at >= 0 else len(self)) - start
            return at

    text = Text("m " * 3000)
    assert len(sweep.placed(text, [("SEX", "m")] * 4000)) == 3000
    assert Text.read <= 4 * len(text)


def test_runs_of_words_find_the_words_once(spark):
    runs = features.word_runs(F.col("text"))
    assert str(runs).count("regexp_extract_all") == 1
    df = spark.createDataFrame([("One two  three",), ("x",), ("ab",), ("",), (None,)], "text string")
    assert [r[0] for r in df.select(runs).collect()] == [["one", "two", "three", "one two", "two three"], [], ["ab"], [], []]


def test_scaled_steps_need_few_rounds_whatever_the_curvature():
    curve = np.array([[1e6, 3e4, 1.0, 2.0], [1.0, 1e5, 10.0, 1e3]])
    goal = np.array([[1.0, -2.0, 3.0, 4.0], [0.5, 1.0, -1.0, 2.0]])
    rounds = []

    def evaluate(x):
        rounds.append(1)
        return (curve * (x - goal) ** 2).sum(1) / 2, curve * (x - goal)

    assert np.allclose(models.scaled_quasi_newton(evaluate, np.sqrt(curve), 200, 8), goal) and len(rounds) < 8
    rounds.clear()
    assert np.allclose(models.quasi_newton(evaluate, np.zeros((2, 4)), 200, 8), goal) and len(rounds) > 8


def test_sums_of_long_arrays_reach_the_driver_once(spark, monkeypatch):
    monkeypatch.setattr(models, "CHUNK", 10)
    rows = spark.range(40).repartition(5)

    def part(batches):
        out = np.zeros(95)
        for b in batches:
            np.add.at(out, b.column("id").to_numpy(), 1.0)
        return out

    assert models.summed(rows, part, 95).tolist() == [1.0] * 40 + [0.0] * 55


def test_clusters_look_stop_words_up(spark, monkeypatch):
    monkeypatch.setattr(features.F, "array_contains", None)  # a scan of the list for each word
    df = spark.createDataFrame([(i, "the and of " + ("red apple" if i % 2 else "blue river")) for i in range(8)] + [(8, "the and")], "k long, text string")
    got = {r["k"]: r["cluster"] for r in features.clusters(df, "text", ["k"], k=2).collect()}
    assert len({got[i] for i in (0, 2, 4, 6)}) == len({got[i] for i in (1, 3, 5, 7)}) == 1 and got[0] != got[1] and got[8] == 0


def test_texts_of_queries_meet_rows_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(features, "COLUMNS", 5)
    monkeypatch.setattr(features, "SLICE", 4)
    r = random.Random(7)
    words = [f"w{i}" for i in range(30)]
    draw = lambda n: " ".join(r.choice(words) for _ in range(n))
    train = [(i, draw(r.randint(1, 12))) for i in range(23)] + [(23, None), (24, "")]
    asked = [(i, draw(r.randint(1, 15))) for i in range(40)] + [(None, draw(6)) for _ in range(9)] + [(3, draw(4)), (3, None)]  # an id's texts count as one
    asked += [(50, None), (51, ""), (52, "unknown words"), *[(53, draw(3)) for _ in range(4)], *[(54, "unknown") for _ in range(6)]]
    n, df, idf = len(train), {}, {}
    for _, t in train:
        for w in set((t or "").split()):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log((1 + n) / (1 + c)) + 1 for w, c in df.items() if c >= 2}

    def vector(text):
        raw = {w: (1 + math.log(text.split().count(w))) * idf[w] for w in set(text.split()) if w in idf}
        return {w: x / math.sqrt(sum(y * y for y in raw.values())) for w, x in raw.items()}

    held, want = [vector(t or "") for _, t in train], {}
    for i in {i for i, _ in asked}:
        v = vector(" ".join(t or "" for j, t in asked if j == i))
        s = sorted((sum(x * h.get(w, 0.0) for w, x in v.items()) for h in held), reverse=True)[:5]
        if s[0] > 0:
            want[i] = sum(s) / 5
    t, q = (spark.createDataFrame(x, "id long, text string") for x in (train, asked))
    for at in ({}, {"block": 9, "asked": 16, "crowd": 3}, {"asked": 100, "crowd": 1}):
        got = {x["id"]: x["similarity"] for x in features.nearest_texts(q, T.words, t, **at).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want)
    named = features.nearest_texts(q.select(F.struct("id", F.lit("x").alias("turn")).alias("id"), "text"), T.words, t, block=9, asked=16).collect()
    assert {x["id"]["id"]: x["similarity"] for x in named} == pytest.approx(want, abs=1e-12)
    assert features.nearest_texts(q.where("id < 0"), T.words, t).count() == features.nearest_texts(q, T.words, t.where("id < 0")).count() == 0


@pytest.mark.parametrize("name", ["char_gram_similarity", "knn_similarity"])
def test_similarity_to_training_has_bounded_tasks(spark, monkeypatch, name):
    """No row for each term of a turn, and as many tasks as the characters ask for, whatever the number of shuffle partitions."""
    parts = []
    for chars in (8000, 2000):
        monkeypatch.setattr(features, "CHARS", chars, raising=False)
        plan = registry.QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert "term#" not in plan
        parts.append(int(re.search(r"RepartitionByExpression \[_i#\w+, _j#\w+\], (\d+)", plan)[1]))
    assert parts[0] > 4 and parts[1] >= 3.9 * parts[0] - 4
