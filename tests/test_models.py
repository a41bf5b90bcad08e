"""Models fitted by sums over blocks against dense computations in one place."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quartzgate.operators import features, models


def dense_fit(x, y, w, c, steps=200):
    """Newton's method on the whole matrix; the last entry is the intercept."""
    z = np.concatenate([x, np.ones((len(x), 1))], 1)
    ridge = np.diag([1.0] * x.shape[1] + [0.0])
    theta = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-z @ theta))
        g = c * z.T @ ((p - y) * w) + ridge @ theta
        h = c * (z * (p * (1 - p) * w)[:, None]).T @ z + ridge
        move = np.linalg.lstsq(h, g, rcond=None)[0]
        theta -= move
        if np.abs(move).max() < 1e-13:
            break
    return theta


def test_sums_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(models, "CHUNK", 7)
    rows = spark.range(1000).repartition(70)

    def part(batches):
        out = np.zeros(20)
        for b in batches:
            x = b.column("id").to_numpy()
            out += np.bincount(x % 20, x, 20)
        return out

    want = np.bincount(np.arange(1000) % 20, np.arange(1000), 20)
    assert np.array_equal(models.summed(rows, part, 20), want)
    monkeypatch.setattr(models, "DIRECT", 100)
    assert np.array_equal(models.summed(rows, part, 20), want)


def test_grid_equals_a_plain_loop(spark):
    rnd = np.random.default_rng(3)
    n, folds, penalties = 400, 4, [0.01, 0.3, 5.0]
    x = rnd.normal(size=(n, 3)) * [1, 50, 0.01] + [0, 300, 1]
    y = (rnd.random(n) < 1 / (1 + np.exp(-(x[:, 0] + (x[:, 1] - 300) / 40)))).astype(int)
    rows = [(i, "ab"[i % 2], *map(float, x[i]), 2.0, int(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "k long, task string, a double, b double, c double, flat double, y int").repartition(5)
    parts = models.folded(df, "k", ["task", "y"], folds)
    fold = np.zeros(n, int)
    for r in parts.select("k", "fold").collect():
        fold[r["k"]] = r["fold"]
    for task in (0, 1):
        for label in (0, 1):
            sizes = np.bincount(fold[(np.arange(n) % 2 == task) & (y == label)], minlength=folds)
            assert sizes.max() - sizes.min() <= 1
    search = models.grid(parts, ["a", "b", "c", "flat"], "y", penalties, folds)
    full = np.concatenate([x, np.full((n, 1), 2.0)], 1)
    losses = {}
    for c in penalties:
        each = []
        for f in [*range(folds), None]:
            own = np.ones(n, bool) if f is None else fold != f
            mean, spread = full[own].mean(0), full[own].std(0)
            spread[spread < 1e-9] = 1
            theta = dense_fit((full[own] - mean) / spread, y[own], np.ones(own.sum()), c)
            weights = theta[:-1] / spread
            fit = search.fits[c] if f is None else search.fold_fits[f, c]
            assert np.allclose(fit.weights, weights, atol=1e-6) and fit.intercept == pytest.approx(theta[-1] - weights @ mean, abs=1e-6)
            if f is not None:
                p = 1 / (1 + np.exp(-(full[~own] @ weights + theta[-1] - weights @ mean)))
                each.append(-np.mean(np.log(np.where(y[~own] == 1, p, 1 - p))))
        losses[c] = np.mean(each)
    assert search.log_loss == pytest.approx(losses, rel=1e-7) and search.best == min(losses, key=losses.get)
    got = {r["k"]: r["p"] for r in df.select("k", search.fits[0.3].probability().alias("p")).collect()}
    assert got[7] == pytest.approx(1 / (1 + math.exp(-(full[7] @ search.fits[0.3].weights + search.fits[0.3].intercept))))
    with pytest.raises(ValueError, match="null"):
        models.grid(parts.withColumn("a", F.when(F.col("k") != 3, F.col("a"))), ["a"], "y", [1.0], folds)


def texts(n=150):
    r = random.Random(2)
    stock = [f"word{i}" for i in range(40)]
    return [(i, [r.choice(stock) for _ in range(r.randint(0, 12))] + (["yes"] if i % 4 == 0 and i % 5 else []), int(i % 4 == 0)) for i in range(n)]


def dense_texts(rows, own):
    """(terms, TF-IDF of all rows by the document frequencies of `own`)."""
    terms = sorted({t for _, ts, _ in rows for t in ts})
    counts = np.array([[ts.count(t) for t in terms] for _, ts, _ in rows], float)
    df = (counts[own] > 0).sum(0)
    idf = np.where(df >= 2, np.log((1 + own.sum()) / (1 + df)) + 1, 0)
    x = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return terms, x / np.where(norm > 0, norm, 1)


def test_text_models_of_all_folds_equal_dense_fits(spark):
    rows, folds = texts(), 3
    df = spark.createDataFrame(rows, "id long, terms array<string>, y int").repartition(4).withColumn("fold", (F.col("id") * 7 % folds).cast("int"))
    fit, encoded = models.fit_texts(df, "y", folds)
    y = np.array([r[2] for r in rows])
    fold = np.arange(len(rows)) * 7 % folds
    told = {r["id"]: r["probability"] for r in fit.probabilities(encoded, F.col("fold")).collect()}
    for f in [*range(folds), None]:
        own = fold != f if f is not None else np.ones(len(rows), bool)
        terms, x = dense_texts(rows, own)
        share = own.sum() / (2.0 * np.bincount(y[own]))
        theta = dense_fit(x[own], y[own], share[y[own]], 1.0)
        got = {r["term"]: r["coefficient"] for r in fit.coefficients(-1 if f is None else f).collect()}
        for t, w in zip(terms, theta[:-1]):
            assert got.get(t, 0.0) == pytest.approx(w, abs=1e-6)  # each word by itself
        assert fit.intercepts[-1 if f is None else f] == pytest.approx(theta[-1], abs=1e-6)
        for i in np.flatnonzero(~own):
            assert told[i] == pytest.approx(1 / (1 + math.exp(-(x[i] @ theta[:-1] + theta[-1]))), abs=1e-6)
    with pytest.raises(ValueError, match="both labels"):
        models.fit_texts(df.where("y = 1"), "y")


@pytest.mark.parametrize("folds,single", [(3, 0), (0, 1_000_000)])
def test_fits_of_many_words_equal_dense_fits(spark, monkeypatch, folds, single):
    """In many blocks and parts, and in one block. No frame of a fit reaches the driver but a row of sums for each block."""
    from quartzgate.operators import dual

    for name, value in {"ENTRIES": 200, "SINGLE": single, "WORDS": 7, "PARTS": 2}.items():
        monkeypatch.setattr(dual, name, value)
    monkeypatch.setattr(models.DataFrame, "toPandas", None)
    rows = texts()
    df = spark.createDataFrame(rows, "id long, terms array<string>, y int").repartition(4).withColumn("fold", (F.col("id") * 7 % max(folds, 1)).cast("int"))
    fit, encoded = models.fit_texts(df if folds else df.drop("fold"), "y", folds)
    y, fold = np.array([r[2] for r in rows]), np.arange(len(rows)) * 7 % max(folds, 1)
    others = {r["id"]: (r["y"], r["fold"], r["probability"]) for r in models.told_by_others(df, "y", folds).collect()} if folds else {}
    told = {r["id"]: r["probability"] for r in fit.probabilities(encoded, F.col("fold") if folds else F.lit(0)).collect()}
    for f in [*range(folds), None]:
        own = fold != f if f is not None else np.ones(len(rows), bool)
        terms, x = dense_texts(rows, own)
        share = own.sum() / (2.0 * np.bincount(y[own]))
        theta = dense_fit(x[own], y[own], share[y[own]], 1.0)
        got = {r["term"]: r["coefficient"] for r in fit.coefficients(-1 if f is None else f).collect()}
        assert max(abs(got.get(t, 0.0) - w) for t, w in zip(terms, theta)) < 1e-6 and fit.intercepts[-1 if f is None else f] == pytest.approx(theta[-1], abs=1e-6)
        for i in np.flatnonzero(~own) if folds else range(len(rows)):
            want = 1 / (1 + math.exp(-(x[i] @ theta[:-1] + theta[-1])))
            assert told[i] == pytest.approx(want, abs=1e-6) and (not folds or others[i] == (y[i], fold[i], pytest.approx(want, abs=1e-6)))


def test_texts_without_known_words_get_the_share_of_labels(spark):
    df = spark.createDataFrame([(i, [f"w{i}"], int(i < 4), i % 2) for i in range(16)] + [(16, [], 0, 0)], "id long, terms array<string>, y int, fold int")
    assert [r["probability"] for r in models.told_by_others(df, "y", 2).collect()] == pytest.approx([0.5] * 17)


def test_vocabulary_keeps_the_commonest(spark):
    df = spark.createDataFrame(texts(), "id long, terms array<string>, y int")
    words = models.vocabulary(df, min_df=2, most=5)
    counts: dict = {}
    for _, ts, _ in texts():
        for t in ts:
            counts[t] = counts.get(t, 0) + 1
    best = sorted(counts, key=lambda t: (-counts[t], t))[:5]
    assert {r["term"]: r["slot"] for r in words.table.collect()} == {t: i for i, t in enumerate(best)}
    assert models.encoded(df, words).count() == 150


def test_clusters_equal_a_plain_loop_from_the_same_seeds(spark):
    r = random.Random(8)
    topics = [[f"{t}{i}" for i in range(12)] for t in ("sea", "tax", "oak")]
    rows = [(i, " ".join(r.choice(topics[i % 3]) for _ in range(9)) + " the and") for i in range(90)] + [(90, ""), (91, None)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    terms = df.select(F.col("id").cast("string").alias("id"), features.word_grams(F.coalesce("text", F.lit(""))).alias("terms"))
    words = models.vocabulary(terms)
    encoded = models.encoded(terms, words)
    start = models.seeds(encoded, F.col("id"), words.idf[-1], 3)
    assert start.shape[0] == 3 and np.allclose(np.linalg.norm(start, axis=1), 1)
    got = {int(x["id"]): x["cluster"] for x in models.nearest_center(encoded, models.lloyd(encoded, start, words.idf[-1]), words.idf[-1]).collect()}
    x = np.zeros((92, start.shape[1]))
    for e in encoded.collect():
        x[int(e["id"]), e["slots"]] = np.array(e["tf"]) * words.idf[-1][e["slots"]]
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = x / np.where(norm > 0, norm, 1)
    centers, before = start.copy(), -np.inf
    for _ in range(20):
        cosine = x @ centers.T
        best = cosine.argmax(1)
        if cosine.max(1).sum() <= before + 1e-9:
            break
        before = cosine.max(1).sum()
        for j in range(3):
            total = x[best == j].sum(0)
            centers[j] = total / np.linalg.norm(total) if total.any() else centers[j]
    assert [got[i] for i in range(92)] == (x @ centers.T).argmax(1).tolist()
    out = features.clusters(df, "text", ["id"], 3)
    assert set(out.columns) == {"id", "text", "cluster"} and out.count() == 92
    assert len({tuple(sorted(r["id"] % 3 for r in out.where(f"id < 90 and cluster = {c}").select("id").distinct().collect())) for c in range(3)}) == 3
    purity = out.where("id < 90").groupBy("cluster").agg(F.countDistinct(F.col("id") % 3).alias("n")).collect()
    assert all(p["n"] == 1 for p in purity)
    assert features.clusters(df.where("id >= 90"), "text", ["id"], 3).select("cluster").distinct().count() == 1
