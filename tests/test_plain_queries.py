"""Registered queries that SQL can't express, against plain loops over the smallest tables."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from quartzgate.operators import online
from quartzgate.plans import base, registry
from tests.test_quantiles import plain_allocation

SMALL = "/root/testdata/sf0.001"


def got(spark, name):
    return registry.QUERIES[name](spark, SMALL).collect()


@pytest.fixture(scope="module")
def pairs(spark):
    return base.pairs(spark, SMALL).collect()


def test_allocation(spark, pairs):
    curves = {}
    for task in sorted({p["task"] for p in pairs}):
        mine = sorted((p for p in pairs if p["task"] == task), key=lambda p: (p["mean_logprob"], p["pair_id"]))
        curve = [0]
        for p in mine:
            curve.append(curve[-1] + int(p["frontier_success"]) - int(p["success"]))
        curves[task] = curve[: round(0.2 * len(pairs)) + 1]
    want = plain_allocation(curves, round(0.2 * len(pairs)))
    assert {r["task"]: (r["escalated"], r["gain"]) for r in got(spark, "allocation")} == want


def test_permuted_labels(spark, pairs):
    def order(seed):
        return sorted((int(hashlib.md5(f"{p['pair_id']}|{seed}".encode()).hexdigest()[:13], 16), p["pair_id"]) for p in pairs)

    labels = {p["pair_id"]: (p["success"], p["frontier_success"]) for p in pairs}
    want = {a: labels[b] for (_, a), (_, b) in zip(order(20260909), order(20260910))}
    assert {r["pair_id"]: (r["success"], r["frontier_success"]) for r in got(spark, "permuted_labels")} == want


def test_budgets(spark):
    rows = online.from_events(spark.read.parquet(f"{SMALL}/events.parquet")).selectExpr("user_id", "request_id", "cast(ts as double) t").collect()
    want = {}
    for user in {r["user_id"] for r in rows}:
        mine = sorted((r["t"], r["request_id"]) for r in rows if r["user_id"] == user)
        want |= dict(zip([i for _, i in mine], online.admissions([t for t, _ in mine], 2, 3)))
    assert len(set(want.values())) > 1
    for name in ("rate_budget", "stream_budget"):
        assert {r["request_id"]: r["decision"] for r in got(spark, name)} == want


def test_embedding_similarity_all(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    ids = [r["vec_id"] for r in rows]
    v = np.array([r["embedding"] for r in rows], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    s = v @ v.T
    np.fill_diagonal(s, -np.inf)
    want = dict(zip(ids, np.sort(s, 1)[:, -5:].mean(1)))
    assert {r["id"]: r["similarity"] for r in got(spark, "embedding_similarity_all")} == pytest.approx(want)


def grams(text):
    out = []
    for w in text.lower().split():
        w = f" {w} "
        out += [w[i : i + n] for n in (3, 4, 5) for i in range(len(w) - n + 1)] or [w]
    return out


def weighed(terms, idf):
    counts = {t: terms.count(t) for t in set(terms) if t in idf}
    raw = {t: (1 + math.log(c)) * idf[t] for t, c in counts.items()}
    norm = math.sqrt(sum(x * x for x in raw.values()))
    return {t: x / norm for t, x in raw.items()}


def test_char_gram_similarity(spark):
    train = [grams(r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    df: dict = {}
    for terms in train:
        for t in set(terms):
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log((1 + len(train)) / (1 + n)) + 1 for t, n in df.items() if n >= 2}
    held = [weighed(t, idf) for t in train]
    told = {(r["conv_id"], r["turn"]): r["similarity"] for r in got(spark, "char_gram_similarity")}
    asked = spark.read.parquet(f"{SMALL}/conversations.parquet").collect()
    assert len(told) == len(asked)
    for r in asked[::7]:
        w = weighed(grams(r["text"]), idf)
        near = sorted((sum(x * h.get(t, 0) for t, x in w.items()) for h in held), reverse=True)[:5]
        assert told[r["conv_id"], r["turn"]] == pytest.approx(sum(near) / 5, abs=1e-9)
