"""Text features: TF-IDF with smoothed idf, nearest neighbours by cosine, clustering and linear models."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import session
from . import models, quantiles

if TYPE_CHECKING:
    import numpy as np
    import pandas as pd

#: Terms of a block that are held as a matrix at a time, and queries whose cosines with a block are.
COLUMNS, SLICE = 8192, 512
#: Characters of a block of texts, and most partitions in which blocks meet.
CHARS, MEETINGS = 1 << 20, 20_000


def word_grams(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\b\w\w+\b)"), 1)


def char_grams(text: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams inside words, each word with a space on both sides; a shorter word gives itself once."""
    padded = F.transform(F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def grams(w: Column) -> Column:
        each = [
            F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(n))))
            .when(F.lit(n == low), F.array(w))
            .otherwise(F.array().cast("array<string>"))
            for n in range(low, high + 1)
        ]
        return F.concat(*each)

    return F.flatten(F.transform(padded, grams))


def tf_idf(terms: DataFrame, idf: DataFrame | None = None, min_df: int = 2) -> tuple[DataFrame, DataFrame]:
    """terms: (id, terms). (weights (id, term, w), idf (term, idf)): sublinear tf, idf = ln((1 + n) / (1 + df)) + 1, rows of
    length 1. With `idf` given, terms it lacks are dropped before the norm."""
    tf = terms.select("id", F.explode("terms").alias("term")).groupBy("id", "term").agg(F.count("*").alias("c"))
    if idf is None:
        n = terms.agg(F.count("*").alias("n"))
        df = tf.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)
        idf = df.crossJoin(F.broadcast(n)).select("term", (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    raw = tf.join(idf, "term").select("id", "term", ((1.0 + F.log(F.col("c").cast("double"))) * F.col("idf")).alias("r"))
    norm = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("r") * F.col("r"))).alias("norm"))
    return raw.join(norm, "id").select("id", "term", (F.col("r") / F.col("norm")).alias("w")), idf


def _key() -> Column:
    """An id of any type as text, never null."""
    return F.to_json(F.struct("id"))


def _flat(values: Iterable[np.ndarray], kind: type) -> np.ndarray:
    import numpy as np

    return np.concatenate([np.zeros(0, kind), *values]).astype(kind)


def _meet(mine: pd.DataFrame, others: pd.DataFrame, k: int, counted: bool, columns: int, queries: int) -> pd.DataFrame:
    """mine: (key, qh, qw), others: (t, th, tw). Rows (key, s, sq): the k largest sums of a key with the rows that have a t. With
    `counted` qw says how often a term occurs (null: once each), rows of one key are added up, and a row with a null sum has in sq
    what the terms in the row without a t add to the square of the key's length. Matrices have `queries` rows and `columns`."""
    import numpy as np
    import pandas as pd

    out = [pd.DataFrame({"key": pd.Series(dtype=str), "s": pd.Series(dtype=float), "sq": pd.Series(dtype=float)})]
    if not len(mine) or not len(others):
        return out[0]
    own, keys = pd.factorize(mine["key"])
    is_row = others["t"].notna().to_numpy()
    held, idf = others[is_row], others[~is_row]
    th, tw, vh, vw = _flat(held["th"], np.int64), _flat(held["tw"], float), _flat(idf["th"], np.int64), _flat(idf["tw"], float)
    known = np.unique(np.concatenate([th, vh]))
    if not len(known):
        return out[0]
    h = _flat(mine["qh"], np.int64)
    column = np.minimum(np.searchsorted(known, h), len(known) - 1)
    both = known[column] == h
    w = _flat([np.ones(len(x)) if y is None else y for x, y in zip(mine["qh"], mine["qw"])], float)[both]
    row = np.repeat(own, mine["qh"].map(len))[both]
    cells, at = np.unique(row * len(known) + column[both], return_inverse=True)
    w, (row, column) = np.bincount(at, w, len(cells)), np.divmod(cells, len(known))
    if counted:
        w = 1.0 + np.log(w)
        weight = np.zeros(len(known))
        weight[np.searchsorted(known, vh)] = vw
        sq = np.bincount(row, (w * weight[column]) ** 2, len(keys))
        out.append(pd.DataFrame({"key": keys[sq > 0], "s": np.nan, "sq": sq[sq > 0]}))
    if len(held):
        tr, tc = np.repeat(np.arange(len(held)), held["th"].map(len)), np.searchsorted(known, th)
        s = np.zeros((len(keys), len(held)))
        for low in range(0, len(known), columns):
            n = min(columns, len(known) - low)
            inside = (tc >= low) & (tc < low + n)
            right = np.zeros((n, len(held)))
            right[tc[inside] - low, tr[inside]] = tw[inside]
            inside = (column >= low) & (column < low + n)
            qr, qc, qw = row[inside], column[inside] - low, w[inside]  # ascending by row
            for first in range(0, len(keys), queries):
                a, b = np.searchsorted(qr, [first, first + queries])
                left = np.zeros((min(queries, len(keys) - first), n))
                left[qr[a:b] - first, qc[a:b]] = qw[a:b]
                s[first : first + queries] += left @ right
        m = min(k, len(held))
        best = np.partition(s, len(held) - m, axis=1)[:, len(held) - m :]
        i, j = np.nonzero(best > 0)
        out.append(pd.DataFrame({"key": keys[i], "s": best[i, j], "sq": 0.0}))
    return pd.concat(out)


def _meetings(asked: DataFrame, held: DataFrame, nq: int, nt: int, k: int, vectors: tuple[Column, Column], counted: bool) -> DataFrame:
    """asked: (key, ...) with `vectors`, the hashes and weights of its terms; held: (t, th, tw, _l), _l below nt the block. Rows (key, s, sq)
    of the `k` largest sums and of the squares. Every pair of blocks is a group, and there are as many partitions as pairs, so what a task holds
    does not grow with the rows. Rows are dealt out before their terms are found: texts are shuffled, not terms."""
    n = min(nq * nt, MEETINGS)
    block, every = F.pmod(F.xxhash64("key"), F.lit(nq)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(nt - 1)))
    left = asked.withColumns({"_i": block, "_j": every}).repartition(n, "_i", "_j")
    left = left.select("_i", "_j", "key", *[v.alias(name) for v, name in zip(vectors, ("qh", "qw"))])
    # each block is sent once for each block of the other side; copies are made in two steps, as a shuffle holds what its task writes
    some = math.isqrt(nq - 1) + 1
    runs, first = -(-nq // some), F.col("_run") * some
    right = held.withColumn("_l", F.col("_l").cast("int")).repartition(nt, "_l").withColumn("_run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    right = right.repartition(runs, "_run", "t").withColumn("_k", F.explode(F.sequence(first, F.least(first + some, F.lit(nq)) - 1)))
    right = right.select("_k", "_l", "t", "th", "tw").repartition(n, "_k", "_l")
    held_at_once = COLUMNS, SLICE
    met = left.groupBy("_i", "_j").cogroup(right.groupBy("_k", "_l"))
    near = met.applyInPandas(lambda mine, others: _meet(mine, others, k, counted, *held_at_once), "key string, s double, sq double")
    near = near.withColumn("s", F.nanvl("s", F.lit(None).cast("double")))
    return near.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc_nulls_last("s"))))


def _arrays(weights: DataFrame, key: str, w: Column) -> DataFrame:
    """weights: (id, term, ...). Rows (`key`, v): the terms of an id by 64-bit hashes, with their weights."""
    v = F.collect_list(F.struct(F.xxhash64("term").alias("h"), w.cast("double").alias("w")))
    return weights.groupBy("id").agg(v.alias("v")).select(_key().alias(key), "v")


def _of_key(out: DataFrame, kind: str) -> DataFrame:
    return out.select(F.from_json("key", f"id {kind}")["id"].alias("id"), "similarity")


def nearest_mean(queries: DataFrame, train: DataFrame, k: int = 5, block: int = 512, asked: int | None = None) -> DataFrame:
    """queries, train: weights (id, term, w), all positive. Rows (id, similarity): the mean cosine of the k nearest;
    neighbours that share no term count as 0, and an id that shares none with any has no row. Blocks of queries meet blocks
    of rows as matrices, some columns at a time, so a term in every row makes no pairs to shuffle. Terms go by 64-bit hashes. asked: how many ids `queries` holds at
    most, which saves a pass that counts them."""
    blocks = lambda n: max(1, -(-n // block))
    nq = blocks(queries.select("id").distinct().count() if asked is None else asked)
    nt = blocks(train.select("id").distinct().count())
    held = _arrays(train, "t", F.col("w")).select("t", F.col("v.h").alias("th"), F.col("v.w").alias("tw"), F.pmod(F.xxhash64("t"), F.lit(nt)).alias("_l"))
    near = _meetings(_arrays(queries, "key", F.col("w")), held, nq, nt, k, (F.col("v.h"), F.col("v.w")), False)
    mean = near.where(F.col("r") <= k).groupBy("key").agg((F.sum("s") / k).alias("similarity"))
    return _of_key(mean, queries.schema["id"].dataType.simpleString())


def nearest_texts(queries: DataFrame, terms: Callable[[Column], Column], train: DataFrame, k: int = 5, block: int = 512, asked: int = 2048, crowd: int = 64) -> DataFrame:
    """queries, train: (id, text). Rows (id, similarity): as `nearest_mean` of the `tf_idf` of both with the idf of `train`, but no rows of
    (id, term) are made of the queries. The terms of a text are counted where its block meets a block of rows; weights and
    lengths follow there, as each block of rows brings its share of the idf. The texts of an id with more than `crowd` rows are
    counted before. Blocks have about `asked` queries, fewer where texts are long, and `block` rows."""
    empty = F.array().cast("array<string>")
    named = queries.select(_key().alias("key"), F.col("text").alias("text"))
    rows = train.select("id", terms(F.col("text")).alias("terms"))
    weights, idf = tf_idf(rows)
    # sums of tf times this are the cosines times the length of the query
    weighed = _arrays(weights.join(idf, "term"), "t", F.col("w") * F.col("idf"))
    nt = max(1, -(-rows.select("id").distinct().count() // block))
    held = weighed.select("t", F.col("v.h").alias("th"), F.col("v.w").alias("tw"), F.pmod(F.xxhash64("t"), F.lit(nt)).alias("_l"))
    words = idf.select(F.xxhash64("term").alias("h"), "idf").groupBy(F.pmod("h", F.lit(nt)).alias("_l")).agg(F.collect_list(F.struct("h", "idf")).alias("v"))
    words = words.select(F.lit(None).cast("string").alias("t"), F.col("v.h").alias("th"), F.col("v.idf").alias("tw"), "_l")
    held = session.materialize(held.unionByName(words), "nearest-texts")
    n, chars = named.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    nq = max(1, -(-n // asked), -(-chars // CHARS))

    counts = named.withColumns({"qh": F.lit(None).cast("array<bigint>"), "qw": F.lit(None).cast("array<double>")})
    crowded = named.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("key")
    if not crowded.isEmpty():
        each = named.join(crowded, "key").select("key", F.explode(terms(F.col("text"))).alias("term")).join(idf.select("term"), "term", "semi")
        c = each.groupBy("key", F.xxhash64("term").alias("h")).agg(F.count("*").cast("double").alias("w"))
        c = c.groupBy("key").agg(F.collect_list(F.struct("h", "w")).alias("v"))
        c = c.select("key", F.lit(None).cast("string").alias("text"), F.col("v.h").alias("qh"), F.col("v.w").alias("qw"))
        counts = counts.join(crowded, "key", "anti").unionByName(c)
    hashes = F.coalesce("qh", F.transform(F.coalesce(terms(F.col("text")), empty), lambda x: F.xxhash64(x)))
    near = _meetings(counts, held, nq, nt, k, (hashes, F.col("qw")), True)
    top = F.sum(F.when(F.col("r") <= k, F.col("s")))
    mean = near.groupBy("key").agg((top / k / F.sqrt(F.sum("sq"))).alias("similarity")).where("similarity is not null")
    return _of_key(mean, queries.schema["id"].dataType.simpleString())


def nearest_vectors(queries: DataFrame, rows: DataFrame, k: int = 5, block: int = 8192) -> DataFrame:
    """queries, rows: (id, v). Rows (id, similarity): the mean cosine of the k nearest among all other ids. Blocks of queries
    meet blocks of rows as matrices, SLICE queries at a time, and each meeting gives at most k cosines for a query. Null vectors and
    ids, and vectors that are zero or not finite, take no part; a query with fewer neighbours has the mean of those."""
    import numpy as np
    import pandas as pd

    def blocks(df: DataFrame, name: str) -> DataFrame:
        held = df.where("id is not null and v is not null").select("id", "v")
        n = max(1, -(-held.count() // block))
        return held.withColumn(name, F.pmod(F.xxhash64("id"), F.lit(n)))

    def unit(ids: pd.Series, vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        v = np.stack([np.asarray(x, float) for x in vectors])
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            v = v / np.sqrt((v * v).sum(1, keepdims=True))
        good = np.isfinite(v).all(1)
        return ids.to_numpy(np.int64)[good], v[good]

    def meet(key, mine: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"id": pd.Series(dtype="int64"), "s": pd.Series(dtype=float)})]
        if len(mine) and len(others):
            (ids, q), (ts, v) = unit(mine["id"], mine["v"]), unit(others["t"], others["u"])
            m = min(k, len(ts))
            for at in range(0, len(ids) if m else 0, SLICE):
                own, s = ids[at : at + SLICE], q[at : at + SLICE] @ v.T
                for i in np.flatnonzero(np.isin(own, ts)):
                    s[i, ts == own[i]] = -np.inf
                s.partition(len(ts) - m, axis=1)
                i, j = np.nonzero(s[:, len(ts) - m :] > -np.inf)
                out.append(pd.DataFrame({"id": own[i], "s": s[i, j + len(ts) - m]}))
        return pd.concat(out)

    asked, held = blocks(queries, "_q"), blocks(rows, "_r")
    own = lambda df, *names: df.select(*[F.col(a).alias(b) for a, b in names])
    q, r = (own(df, (c, "_b")).distinct() for df, c in ((asked, "_q"), (held, "_r")))
    # each block is sent once for each block of the other side
    left = own(asked.crossJoin(F.broadcast(r)), ("id", "id"), ("v", "v"), ("_q", "_i"), ("_b", "_j")).groupBy("_i", "_j")
    right = own(held.crossJoin(F.broadcast(q)), ("id", "t"), ("v", "u"), ("_b", "_k"), ("_r", "_l")).groupBy("_k", "_l")
    near = left.cogroup(right).applyInPandas(meet, "id long, s double")
    w = Window.partitionBy("id").orderBy(F.desc("s"))
    return near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).groupBy("id").agg(F.avg("s").alias("similarity"))


def domain_thresholds(scores: DataFrame, share: float = 0.05) -> DataFrame:
    """One row: similarity (the lower quantile) and words (the upper one)."""
    low = quantiles.exact(scores, "similarity", [share]).select(F.col("q")[0].alias("similarity"))
    return low.crossJoin(quantiles.exact(scores, "words", [1 - share]).select(F.col("q")[0].alias("words")))  # one row each


def out_of_domain(similarity: Column, words: Column, low: Column, high: Column) -> Column:
    return (similarity < low) | (words > high)


def vocabulary_novelty(train: DataFrame, shifted: DataFrame, text: str = "text") -> DataFrame:
    """One row: words, novel, rate: how many of the shifted side's distinct words the other side lacks."""
    words = lambda df: df.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z][a-z']+)"), 1)).alias("w")).distinct()
    known = words(train).withColumn("_k", F.lit(1))
    both = words(shifted).join(known, "w", "left")
    n, novel = F.count("*"), F.count_if(F.col("_k").isNull())
    return both.agg(n.alias("words"), novel.alias("novel"), F.try_divide(novel.cast("double"), n).alias("rate"))


def clusters(df: DataFrame, text: str, key: list[str], k: int = 5, most_terms: int = 5000, min_df: int = 2, seed: int = 20260909) -> DataFrame:
    """`df` with `cluster`: spherical k-means over TF-IDF of words in `min_df` rows or more, stop words aside, the `most_terms`
    commonest of them. `key` names a row. A text without such words is in cluster 0."""
    from pyspark.ml.feature import StopWordsRemover

    stop = StopWordsRemover.loadDefaultStopWords("english")  # isin looks a word up in a hash set
    named = df.withColumn("_id", F.struct(*key).cast("string"))
    terms = named.select(F.col("_id").alias("id"), F.filter(word_grams(F.coalesce(text, F.lit(""))), lambda w: ~w.isin(stop)).alias("terms"))
    words = models.vocabulary(terms, min_df=min_df, most=most_terms)
    rows = session.materialize(models.encoded(terms, words), "cluster-rows")
    idf = words.idf[-1]
    start = models.seeds(rows, F.col("id"), idf, k, seed=seed)
    if not len(start):
        return df.withColumn("cluster", F.lit(0))
    told = models.nearest_center(rows, models.lloyd(rows, start, idf), idf).select(F.col("id").alias("_id"), "cluster").dropDuplicates(["_id"])
    return named.join(told, "_id").drop("_id")


def logistic(train: DataFrame, test: DataFrame, columns: list[str], label: str, reg: float = 0.1, balanced: bool = False) -> DataFrame:
    """`test` with `probability` of label 1 by a standardised logistic regression; balanced: classes weigh alike."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    weighted = train.withColumn("_weight", F.lit(1.0))
    if balanced:
        n, ones = train.agg(F.count("*"), F.sum(F.col(label).cast("int"))).first()
        w = F.when(F.col(label).cast("int") == 1, n / (2.0 * max(ones, 1))).otherwise(n / (2.0 * max(n - ones, 1)))
        weighted = train.withColumn("_weight", w)
    steps = [
        VectorAssembler(inputCols=columns, outputCol="_x"), StandardScaler(inputCol="_x", outputCol="_z", withMean=True),
        LogisticRegression(featuresCol="_z", labelCol=label, weightCol="_weight", regParam=reg, probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_hit"),
    ]
    out = Pipeline(stages=steps).fit(weighted).transform(test.withColumn("_weight", F.lit(1.0)))
    return out.withColumn("probability", vector_to_array("_p")[1]).drop("_x", "_z", "_p", "_raw", "_hit", "_weight")


def word_runs(text: Column, most: int = 2) -> Column:
    """The words of a text and all runs of up to `most` of them."""

    def runs(words: Column) -> Column:
        each = [
            F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " ")))
            .otherwise(F.array().cast("array<string>"))
            for n in range(1, most + 1)
        ]
        return F.concat(*each)

    # bound by a lambda, the words of a text are found once, not anew for each run
    return F.transform(F.array(word_grams(text)), runs)[0]


def text_model(train: DataFrame, test: DataFrame, label: str, steps: int = 200) -> tuple[DataFrame, DataFrame]:
    """train, test: (id, terms, ...). (`test` with the probability of label 1, (term, coefficient) of each term of training):
    TF-IDF of the training rows and a logistic regression on it whose classes weigh alike."""
    fit, _ = models.fit_texts(train.select("id", "terms", label), label, most=steps)
    told = fit.probabilities(models.encoded(test, fit.words), F.lit(0))
    return told, fit.coefficients()


def extremes(coefficients: DataFrame, n: int = 12) -> DataFrame:
    """Rows (side, term, coefficient): the `n` terms that speak most for the label and the `n` that speak most against it."""
    c = F.col("coefficient")
    ends = [coefficients.orderBy(order, "term").limit(n).withColumn("side", F.lit(name)) for name, order in (("for", c.desc()), ("against", c.asc()))]
    return ends[0].unionByName(ends[1]).select("side", "term", "coefficient")


def fold_of(key: Column, folds: int, seed: int = 0) -> Column:
    return F.pmod(F.xxhash64(key.cast("string"), F.lit(seed)), F.lit(folds)).cast("int")


def cross_validated(df: DataFrame, label: str, folds: int = 5, steps: int = 200) -> DataFrame:
    """df: (id, terms, label). Rows (id, label, fold, probability): what the model of all other folds says. The folds' models are
    fitted together."""
    parts = df.select("id", "terms", label).withColumn("fold", fold_of(F.col("id"), folds))
    return models.told_by_others(parts, label, folds, most=steps)


def probe(df: DataFrame, texts: dict[str, Column], label: str, folds: int = 5, steps: int = 200) -> DataFrame:
    """df: (id, label, ...). Per named array of terms: n, accuracy, and the share of the larger class, cross-validated. What a
    model learns from the lengths alone shows how much the labels are confounded."""
    out = None
    for name, terms in texts.items():
        told = cross_validated(df.select("id", F.col(label).cast("int").alias("_l"), terms.alias("terms")), "_l", folds, steps)
        hit = (F.col("probability") >= 0.5).cast("int") == F.col("_l")
        one = told.agg(F.count("*").alias("n"), F.avg(hit.cast("int")).alias("accuracy"), F.greatest(F.avg("_l"), 1 - F.avg("_l")).alias("majority"))
        one = one.withColumn("probe", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out
