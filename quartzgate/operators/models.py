"""Linear models and clusters fitted by sums over Arrow blocks.

What a step needs of all rows is one flat array: the losses, gradients and curvatures of every model at once, or the sums of
every cluster. Each task adds up its own rows' array, tasks' arrays are added in groups, and the driver gets a bounded
number of them, so a pass over the rows serves all folds and penalties. Logistic regressions minimise
C * (sum of weighted losses) + |w|^2 / 2 with a free intercept; a row counts in a model unless it is in the model's fold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import session
from . import dual, ranking, sampling

#: Numbers of an array that travel as one row, tasks whose single rows the driver adds by itself, and groups whose sums it
#: gets otherwise, if the array is one row; of more rows it gets fewer.
CHUNK, DIRECT, GROUPS = 65_536, 64, 8
#: A Newton step or gradient below this ends a fit.
STEP, SLOPE = 1e-9, 1e-7


def summed(rows: DataFrame, part: Callable[[Iterator[pa.RecordBatch]], np.ndarray], size: int) -> np.ndarray:
    """The sum of the flat arrays of `size` numbers that `part` makes of each task's batches."""
    fields = "task int, chunk int, part binary"
    groups = max(1, GROUPS // -(-size // CHUNK))

    def batch(arrays: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
        tasks, chunks = zip(*arrays) if arrays else ((), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(tasks, pa.int32()), pa.array(chunks, pa.int32()), pa.array([a.tobytes() for a in arrays.values()], pa.binary())],
            names=["task", "chunk", "part"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, task = part(batches), TaskContext.get().partitionId()
        for at in range(0, size, CHUNK):
            piece = total[at : at + CHUNK]
            if piece.any():
                yield batch({(task, at // CHUNK): piece})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for task, chunk, raw in zip(*(b.column(c).to_pylist() for c in ("task", "chunk", "part"))):
                piece = np.frombuffer(raw)
                key = (task % groups, chunk)
                totals[key] = totals[key] + piece if key in totals else piece
        for key, total in totals.items():
            yield batch({key: total})

    parts = rows.mapInArrow(run, fields)
    if size > CHUNK or rows.rdd.getNumPartitions() > DIRECT:
        parts = parts.repartition(F.pmod("task", F.lit(groups)), "chunk").mapInArrow(add, fields)
    out = np.zeros(size)
    for row in parts.collect():  # DIRECT rows, or as many arrays as groups
        piece = np.frombuffer(row["part"])
        out[row["chunk"] * CHUNK :][: len(piece)] += piece
    return out


def folded(df: DataFrame, key: str, strata: list[str], folds: int, seed: int = sampling.SEED) -> DataFrame:
    """`df` with `fold`: each stratum is dealt out evenly, in the order of the hash of `key`."""
    placed = sampling.hash_place(df, key, strata, seed, "_place")
    return placed.withColumn("fold", F.pmod(F.col("_place") - 1, F.lit(folds)).cast("int")).drop("_place")


# ---------------------------------------------------------------- a few dense columns


@dataclass
class Fit:
    """A logistic regression over named columns, in their own units."""

    columns: list[str]
    weights: np.ndarray
    intercept: float

    def probability(self) -> Column:
        eta = F.lit(float(self.intercept))
        for c, w in zip(self.columns, self.weights):
            eta = eta + F.col(c).cast("double") * F.lit(float(w))
        return 1.0 / (1.0 + F.exp(-eta))


@dataclass
class Search:
    """A grid of penalties: log_loss per C, the mean over folds of their rows' mean; the best C (the first of equal ones); the
    models of all rows by C, and of each fold's other rows by (fold, C)."""

    log_loss: dict[float, float]
    best: float
    fits: dict[float, Fit]
    fold_fits: dict[tuple[int, float], Fit]


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(x, y, weight, fold) of each batch of rows with numeric x."""
    for b in batches:
        if len(b):
            flat = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            yield flat, *(b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("y", "weight", "fold"))


def _log1p_exp(z: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))


def grid(df: DataFrame, columns: Sequence[str], label: str, penalties: Sequence[float], folds: int = 5, weight: str | None = None, most: int = 50) -> Search:
    """Fit every (fold, C), and every C on all rows, with columns standardised by each model's own rows (a constant one stays
    as it is). df: the columns, a 0/1 label and `fold` from 0. All models take their Newton steps in one pass over the
    rows. Null columns are an error."""
    d, k = len(columns), folds + 1
    x = F.array(*[F.col(c).cast("double") for c in columns])
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = session.materialize(df.select(x.alias("x"), F.col(label).cast("double").alias("y"), w.alias("weight"), F.col("fold").cast("double").alias("fold")), "grid-rows")

    def moments(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((k, 2 * d + 2))
        for x, y, _, fold in _blocks(batches, d):
            for f in range(folds):
                mine = x[fold == f]
                out[f] += np.concatenate([[len(mine), y[fold == f].sum()], mine.sum(0), (mine * mine).sum(0)])
        return out.ravel()

    parts = summed(rows, moments, k * (2 * d + 2)).reshape(k, -1)
    if not np.isfinite(parts).all():
        raise ValueError("a column holds a null or non-finite value")
    held = parts[:folds, 0]
    seen = parts.sum(0) - parts  # what each model is fitted on: the rows outside of its fold; the last on all
    n = seen[:, :1]
    mean = seen[:, 2 : 2 + d] / n
    spread = np.sqrt(np.maximum(seen[:, 2 + d :] / n - mean * mean, 0))
    spread[spread <= 1e-12 * np.maximum(1, np.abs(mean))] = 1
    c = np.array(penalties, float)
    m = len(c)
    theta = np.zeros((k, d + 1, m))
    size = k * m * (2 + (d + 1) + (d + 1) ** 2)

    def evaluate(theta: np.ndarray) -> tuple[np.ndarray, ...]:
        def sums(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            loss, apart = np.zeros((k, m)), np.zeros((k, m))
            slope, curve = np.zeros((k, d + 1, m)), np.zeros((k, m, d + 1, d + 1))
            for x, y, weight, fold in _blocks(batches, d):
                for f in range(k):
                    z = np.concatenate([(x - mean[f]) / spread[f], np.ones((len(x), 1))], 1)
                    eta = z @ theta[f]
                    each = _log1p_exp(eta) - y[:, None] * eta
                    own = (weight * (fold != f))[:, None]
                    p = 1 / (1 + np.exp(-eta))
                    loss[f] += (each * own).sum(0)
                    apart[f] += each[fold == f].sum(0)
                    slope[f] += z.T @ ((p - y[:, None]) * own)
                    bent = p * (1 - p) * own
                    for j in range(m):
                        curve[f, j] += (z * bent[:, j : j + 1]).T @ z
            return np.concatenate([a.ravel() for a in (loss, apart, slope, curve)])

        flat = summed(rows, sums, size)
        cuts = np.cumsum([k * m, k * m, k * (d + 1) * m])
        loss, apart, slope, curve = np.split(flat, cuts)
        return loss.reshape(k, m), apart.reshape(k, m), slope.reshape(k, d + 1, m), curve.reshape(k, m, d + 1, d + 1)

    def penalised(loss: np.ndarray, theta: np.ndarray) -> np.ndarray:
        return c * loss + (theta[:, :d] ** 2).sum(1) / 2

    loss, apart, slope, curve = evaluate(theta)
    value = penalised(loss, theta)
    for _ in range(most):
        shift = np.zeros_like(theta)
        for f in range(k):
            for j in range(m):
                ridge = np.diag([1.0] * d + [0.0])
                g = c[j] * slope[f, :, j] + ridge @ theta[f, :, j]
                shift[f, :, j] = np.linalg.lstsq(c[j] * curve[f, j] + ridge, g, rcond=None)[0]
        scale = np.ones((k, 1, m))
        while True:  # models whose step went too far take half of it
            tried = theta - scale * shift
            loss, apart, slope, curve = evaluate(tried)
            worse = penalised(loss, tried) > value + 1e-9 * np.abs(value)
            if not worse.any() or scale.min() < 1e-6:
                break
            scale = np.where(worse[:, None, :], scale / 2, scale)
        theta, value = tried, penalised(loss, tried)
        if np.abs(scale * shift).max() < STEP:
            break
    session.release(rows)
    means = (apart[:folds] / held[:, None]).mean(0)
    raw = theta[:, :d] / spread[:, :, None]
    free = theta[:, d] - (raw * mean[:, :, None]).sum(1)
    made = lambda f, j: Fit(list(columns), raw[f, :, j], float(free[f, j]))
    return Search(
        {float(p): float(x) for p, x in zip(c, means)}, float(c[int(np.argmin(means))]), {float(p): made(folds, j) for j, p in enumerate(c)},
        {(f, float(p)): made(f, j) for f in range(folds) for j, p in enumerate(c)},
    )


# ---------------------------------------------------------------- words


@dataclass
class Vocabulary:
    """Numbered terms: a table (term, slot), and for each model the idf of each slot, 0 where the model's rows lack the term.

    counts: (slot, df, _f0 ...), the rows with a term, and those of them in each fold; sizes: all rows and each fold's."""

    table: DataFrame
    counts: DataFrame
    sizes: list[int]
    min_df: int

    @property
    def folds(self) -> int:
        return len(self.sizes) - 1

    @cached_property
    def size(self) -> int:
        return self.table.count()

    @cached_property
    def idf(self) -> np.ndarray:
        """(model, slot), on the driver: for vocabularies of a bounded size."""
        held = self.counts.toPandas().sort_values("slot")
        out = np.zeros((self.folds + 1, len(held)))
        for f in range(self.folds + 1):
            inside = held[f"_f{f}"].to_numpy() if f < self.folds else 0
            seen = held["df"].to_numpy() - inside
            out[f] = np.where(seen >= self.min_df, np.log((1.0 + self._rows(f)) / (1.0 + seen)) + 1.0, 0)
        return out

    def idf_rows(self, models: Sequence[int]) -> DataFrame:
        """(slot, idf by model), in Spark."""
        seen = [F.col("df") - (F.col(f"_f{f}") if f < self.folds else F.lit(0)) for f in models]
        each = [F.when(s >= self.min_df, F.log((1.0 + self._rows(f)) / (1.0 + s)) + 1.0).otherwise(0.0) for f, s in zip(models, seen)]
        return self.counts.select("slot", F.array(*each).alias("idf"))

    def _rows(self, f: int) -> int:
        return self.sizes[-1] - (self.sizes[f] if f < self.folds else 0)


def _counted(df: DataFrame, extra: list[str]) -> DataFrame:
    """(id, extra..., term, c) of df (id, terms, extra...)."""
    return df.select("id", *extra, F.explode("terms").alias("term")).groupBy("id", *extra, "term").agg(F.count("*").alias("c"))


def vocabulary(df: DataFrame, folds: int = 0, min_df: int = 2, most: int | None = None) -> Vocabulary:
    """The terms of df (id, terms and, with folds, fold) in at least `min_df` rows, of these the `most` commonest, numbered by how
    many rows hold them, then by name. idf = ln((1 + n) / (1 + df)) + 1 over each model's rows: those outside of its fold,
    the last all."""
    extra = ["fold"] if folds else []
    in_fold = [F.count_if(F.col("fold") == f) if folds else F.lit(0) for f in range(folds)]
    counts = _counted(df, extra).groupBy("term").agg(F.count("*").alias("df"), F.sum("c").alias("_times"), *[x.alias(f"_f{i}") for i, x in enumerate(in_fold)])
    kept = session.materialize(counts.where(F.col("df") >= min_df), "terms")
    order = "_times" if most else "df"
    placed = ranking.ranked(kept.withColumn("_o", F.col(order).cast("double")), "_o", "term", [], "slot").withColumn("slot", (F.col("slot") - 1).cast("int"))
    if most:
        placed = placed.where(F.col("slot") < most)
    table = session.materialize(placed.drop("_o"), "vocabulary")
    session.release(kept)
    sizes = df.agg(F.count("*").alias("n"), *[(F.count_if(F.col("fold") == f) if folds else F.lit(0)).alias(f"f{f}") for f in range(folds)]).first()
    counts = table.select("slot", "df", *[f"_f{f}" for f in range(folds)])
    return Vocabulary(table.select("term", "slot"), counts, [*[sizes[f"f{f}"] for f in range(folds)], sizes["n"]], min_df)


def encoded(df: DataFrame, words: Vocabulary) -> DataFrame:
    """df (id, terms, ...) with `slots` and `tf` (1 + ln count) of its known terms, by slot, in place of terms."""
    each = _counted(df, []).join(words.table, "term").select("id", F.struct("slot", (1.0 + F.log(F.col("c").cast("double"))).alias("tf")).alias("_e"))
    found = each.groupBy("id").agg(F.array_sort(F.collect_list("_e")).alias("_e"))  # the words of one text
    empty = F.array().cast("array<struct<slot:int,tf:double>>")
    out = df.drop("terms").join(found, "id", "left").withColumn("_e", F.coalesce("_e", empty))
    return out.withColumns({"slots": F.col("_e.slot"), "tf": F.col("_e.tf")}).drop("_e")


class Rows:
    """A batch of encoded texts: the row and slot of each entry, and tf."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        slots = batch.column("slots")
        self.n = len(batch)
        self.row = np.repeat(np.arange(self.n), slots.value_lengths().to_numpy(zero_copy_only=False))
        self.slot = slots.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.tf = batch.column("tf").flatten().to_numpy(zero_copy_only=False).astype(float)

    def weights(self, idf: np.ndarray) -> np.ndarray:
        """TF-IDF of each entry, rows of length 1."""
        v = self.tf * idf[self.slot]
        norm = np.sqrt(np.bincount(self.row, v * v, self.n))
        return v / np.where(norm > 0, norm, 1)[self.row]

    def dot(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, v * w[self.slot], self.n)


@dataclass
class TextFit:
    """Logistic regressions over words: weights (slot, weights and idf by model), intercepts by model."""

    words: Vocabulary
    weights: DataFrame
    intercepts: np.ndarray

    def probabilities(self, rows: DataFrame, model: Column, name: str = "probability") -> DataFrame:
        """Encoded rows with the probability of label 1 by the model whose number `model` gives, without their words."""
        asked = session.materialize(rows.withColumns({"_model": model.cast("int"), "_r": F.monotonically_increasing_id()}), "asked-rows")
        each = asked.select("_r", "_model", F.explode(F.arrays_zip("slots", "tf")).alias("_e")).select("_r", "_model", "_e.slots", "_e.tf")
        of = F.col("_model") + 1
        tf = F.col("tf") * F.element_at("idf", of)
        found = each.withColumnRenamed("slots", "slot").join(self.weights, "slot").select("_r", tf.alias("_v"), (tf * F.element_at("weights", of)).alias("_w"))
        sums = found.groupBy("_r").agg(F.sum("_w").alias("_w"), F.sqrt(F.sum(F.col("_v") * F.col("_v"))).alias("_v"))
        free = F.element_at(F.array(*[F.lit(float(x)) for x in self.intercepts]), of)
        eta = F.when(F.col("_v") > 0, F.col("_w") / F.col("_v")).otherwise(0.0) + free
        told = asked.join(sums, "_r", "left").withColumn(name, 1.0 / (1.0 + F.exp(-eta)))
        return told.drop("slots", "tf", "_model", "_r", "_v", "_w")

    def coefficients(self, model: int = -1) -> DataFrame:
        """(term, coefficient) of a model."""
        at = range(len(self.intercepts))[model]
        return self.words.table.join(self.weights.select("slot", F.col("weights")[at].alias("coefficient")), "slot").select("term", "coefficient")


def _dealt(df: DataFrame, label: str, folds: int, min_df: int) -> tuple[Vocabulary, DataFrame, np.ndarray]:
    """(vocabulary, encoded rows, what a row of each label weighs in each model, so that labels weigh alike)."""
    words = vocabulary(df, folds, min_df)
    plain = df.withColumn("fold", F.lit(-1)) if not folds else df
    rows = session.materialize(encoded(plain, words).withColumn("_y", F.col(label).cast("double")), "text-rows")
    tallies = rows.groupBy("fold", "_y").agg(F.count("*").alias("n")).collect()  # two for each fold
    totals = np.zeros((folds + 1, 2))
    for f in range(folds + 1):
        for r in tallies:
            if r["fold"] != f or f == folds:
                totals[f, int(r["_y"])] += r["n"]
    if (totals == 0).any():
        raise ValueError("training needs both labels")
    return words, rows, totals.sum(1, keepdims=True) / (2 * totals)


def fit_texts(df: DataFrame, label: str, folds: int = 0, c: float = 1.0, min_df: int = 2, most: int = 200) -> tuple[TextFit, DataFrame]:
    """(the fit, the encoded rows): a logistic regression on TF-IDF for each fold's other rows and, last, for all, classes
    weighing alike in each. df: (id, terms, label and, with folds, fold).

    Words that a model's rows hold in fewer than `min_df` have no part in it. Up to dual.WORDS words, each pass over the rows gives
    all models' losses and gradients, and the driver takes limited-memory quasi-Newton steps, `most` at most; of a larger vocabulary the
    driver holds no number for a word or row (see `dual`; most: turns in the search for a Newton step)."""
    words, rows, share = _dealt(df, label, folds, min_df)
    if words.size <= dual.WORDS:
        return _few_words(words, rows, share, c, most), rows
    fits = dual.Fits(rows, words.idf_rows(range(folds + 1)), words.size, c * share, list(range(folds + 1))).run(most)
    weights = session.materialize(fits.weights(), "text-weights")
    fits.release()
    return TextFit(words, weights, fits.intercepts), rows


def told_by_others(df: DataFrame, label: str, folds: int, c: float = 1.0, min_df: int = 2, most: int = 200) -> DataFrame:
    """(id, label, fold, probability): what the model of all other folds says of each row of df (id, terms, label, fold)."""
    words, rows, share = _dealt(df, label, folds, min_df)
    if words.size <= dual.WORDS:
        return _few_words(words, rows, share, c, most).probabilities(rows.select("id", label, "fold", "slots", "tf"), F.col("fold"))
    fits = dual.Fits(rows, words.idf_rows(range(folds)), words.size, c * share[:folds], list(range(folds))).run(most)
    out = session.materialize(fits.held_out(label, df.schema[label].dataType.simpleString()), "text-told")
    fits.release()
    session.release(rows)
    return out


def _few_words(words: Vocabulary, rows: DataFrame, share: np.ndarray, c: float, most: int, memory: int = 8) -> TextFit:
    """The fit where a number for each word and model fits the driver and every task; it holds 2 * memory + 4 of them."""
    idf = words.idf
    k, v = idf.shape
    sc = rows.sparkSession.sparkContext

    def evaluate(theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sent = sc.broadcast((idf, theta, share))

        def sums(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            idf, theta, share = sent.value
            out = np.zeros((k, v + 2))
            for b in batches:
                if not len(b):
                    continue
                held, y = Rows(b), b.column("_y").to_numpy(zero_copy_only=False)
                fold = b.column("fold").to_numpy(zero_copy_only=False)
                for f in range(k):
                    own = np.where(fold != f, share[f][y.astype(int)], 0)
                    values = held.weights(idf[f])
                    eta = held.dot(values, theta[f]) + theta[f, v]
                    rest = (1 / (1 + np.exp(-eta)) - y) * own
                    out[f, 0] += ((_log1p_exp(eta) - y * eta) * own).sum()
                    out[f, 1 : v + 1] += np.bincount(held.slot, values * rest[held.row], v)
                    out[f, v + 1] += rest.sum()
            return out.ravel()

        flat = summed(rows, sums, k * (v + 2)).reshape(k, v + 2)
        sent.destroy()
        loss, slope = c * flat[:, 0] + (theta[:, :v] ** 2).sum(1) / 2, c * flat[:, 1:]
        slope[:, :v] += theta[:, :v]
        return loss, slope

    def bent(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((k, v + 1))
        for b in batches:
            if not len(b):
                continue
            held, y = Rows(b), b.column("_y").to_numpy(zero_copy_only=False)
            fold = b.column("fold").to_numpy(zero_copy_only=False)
            for f in range(k):
                own = np.where(fold != f, share[f][y.astype(int)], 0)
                values = held.weights(idf[f])
                out[f, :v] += np.bincount(held.slot, values * values * own[held.row], v)
                out[f, v] += own.sum()
        return out.ravel()

    # the loss is nowhere more curved along a number than at 0
    unit = np.sqrt(c * summed(rows, bent, k * (v + 1)).reshape(k, v + 1) / 4 + np.array([1.0] * v + [0.0]))
    theta = scaled_quasi_newton(evaluate, unit, most, memory)
    each = [(i, theta[:, i].tolist(), idf[:, i].tolist()) for i in range(v)]
    weights = rows.sparkSession.createDataFrame(each, "slot int, weights array<double>, idf array<double>")
    return TextFit(words, weights, theta[:, v])


def scaled_quasi_newton(evaluate: Callable, unit: np.ndarray, most: int, memory: int) -> np.ndarray:
    """quasi_newton from 0 over the points times `unit`, the roots of each number's curvature: without that a frequent word or the
    intercept, whose curvature grows with the rows, would ask for ever more rounds."""
    unit = np.where(unit > 0, unit, 1.0)

    def at(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        value, slope = evaluate(points / unit)
        return value, slope / unit

    return quasi_newton(at, np.zeros_like(unit), most, memory) / unit


def quasi_newton(evaluate: Callable, theta: np.ndarray, most: int, memory: int) -> np.ndarray:
    """Minimise many smooth functions at once: evaluate(points) gives each one's value and slope at its own point. Every round is
    one evaluation; functions that don't fall enough take a shorter step in the next."""
    k = len(theta)
    value, slope = evaluate(theta)
    past: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(k)]

    def direction(i: int) -> np.ndarray:
        q, used = slope[i].copy(), []
        for s, y in reversed(past[i]):
            a = s @ q / (y @ s)
            q -= a * y
            used.append(a)
        if past[i]:
            s, y = past[i][-1]
            q *= s @ y / (y @ y)
        for (s, y), a in zip(past[i], reversed(used)):
            q += (a - y @ q / (y @ s)) * s
        return -q

    step = np.array([1 / max(1.0, np.abs(g).max()) for g in slope])
    way = np.stack([direction(i) for i in range(k)])
    done = np.abs(slope).max(1) < SLOPE
    for _ in range(most):
        if done.all():
            break
        tried = np.where(done[:, None], theta, theta + step[:, None] * way)
        new_value, new_slope = evaluate(tried)
        for i in np.flatnonzero(~done):
            fall = way[i] @ slope[i]
            if new_value[i] > value[i] + 1e-4 * step[i] * fall and step[i] > 1e-12 and abs(new_value[i] - value[i]) > 1e-13 * abs(value[i]):
                step[i] /= 2
                continue
            s, y = tried[i] - theta[i], new_slope[i] - slope[i]
            if s @ y > 1e-14 * (s @ s):
                past[i] = [*past[i], (s, y)][-memory:]
            theta[i], value[i], slope[i] = tried[i], new_value[i], new_slope[i]
            done[i] = np.abs(slope[i]).max() < SLOPE or not s.any()
            way[i], step[i] = direction(i), 1.0
    return theta


# ---------------------------------------------------------------- clusters


def seeds(rows: DataFrame, key: Column, idf: np.ndarray, k: int, rounds: int = 4, seed: int = sampling.SEED) -> np.ndarray:
    """k unit vectors to start from: encoded rows drawn by the hash of `key` with a chance that grows with their distance from
    those drawn before, 2 k in a round, then the k of them that stand for most rows far apart. Fewer where there are fewer
    different rows."""
    v = idf.shape[0]
    unit = lambda salt: F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1 << 40)).cast("double") / float(1 << 40)
    some = rows.where(F.size("slots") > 0)
    first = some.orderBy(unit(seed), key.cast("string")).limit(1).toPandas()
    if not len(first):
        return np.zeros((0, v))

    def dense(pdf) -> np.ndarray:
        out = np.zeros((len(pdf), v))
        for i, (slots, tf) in enumerate(zip(pdf["slots"], pdf["tf"])):
            out[i, slots] = np.asarray(tf) * idf[slots]
        return out / np.linalg.norm(out, axis=1, keepdims=True)

    drawn = dense(first)
    for r in range(rounds):
        told = session.materialize(nearest_center(some, drawn, idf), "cluster-seeds")
        total = told.agg(F.sum("distance")).first()[0] or 0.0
        if total > 1e-12:
            more = told.where(unit(seed + r + 1) < F.col("distance") * (2.0 * k / total)).orderBy(key.cast("string")).toPandas()
            drawn = np.concatenate([drawn, dense(more)]) if len(more) else drawn
        session.release(told)
    near = nearest_center(some, drawn, idf).groupBy("cluster").agg(F.count("*").alias("n")).toPandas()  # one for each drawn
    weight = np.zeros(len(drawn))
    weight[near["cluster"]] = near["n"]
    rnd = np.random.default_rng(seed)
    chosen = [int(weight.argmax())]
    while len(chosen) < min(k, len(drawn)):
        far = weight * np.maximum(1 - (drawn @ drawn[chosen].T).max(1), 0)
        if far.sum() <= 1e-12:
            break
        chosen.append(int(np.searchsorted(np.cumsum(far), rnd.random() * far.sum(), "right")))
    return drawn[chosen]


def nearest_center(rows: DataFrame, centers: np.ndarray, idf: np.ndarray) -> DataFrame:
    """Encoded rows with `cluster`, the number of the center with the largest cosine (the first of equal ones), and `distance`, 1
    less that cosine."""
    from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

    sent = rows.sparkSession.sparkContext.broadcast((centers, idf))  # a few vectors of the vocabulary
    schema = StructType([*rows.schema.fields, StructField("cluster", IntegerType()), StructField("distance", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers, idf = sent.value
        for b in batches:
            if len(b):
                best, cosine = _closest(Rows(b), centers, idf)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best.astype(np.int32)), pa.array(np.maximum(1 - cosine, 0))], names=[*b.schema.names, "cluster", "distance"])

    return rows.mapInArrow(run, schema)


def _closest(held: Rows, centers: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values = held.weights(idf)
    cosine = np.stack([held.dot(values, c) for c in centers], 1)
    best = cosine.argmax(1)
    return best, cosine[np.arange(held.n), best]


def lloyd(rows: DataFrame, centers: np.ndarray, idf: np.ndarray, most: int = 20) -> np.ndarray:
    """Spherical k-means from the given centers: each row goes to the nearest, each center becomes its rows' mean direction, until
    no row's cosine grows. A center without rows stays."""
    k, v = centers.shape
    before = -np.inf
    for _ in range(most):
        sent = rows.sparkSession.sparkContext.broadcast((centers, idf))

        def sums(batches: Iterator[pa.RecordBatch], sent=sent) -> np.ndarray:
            centers, idf = sent.value
            out = np.zeros(k * v + 1)
            for b in batches:
                if len(b):
                    held = Rows(b)
                    best, cosine = _closest(held, centers, idf)
                    out[:-1] += np.bincount(best[held.row] * v + held.slot, held.weights(idf), k * v)
                    out[-1] += cosine.sum()
            return out

        flat = summed(rows, sums, k * v + 1)
        sent.destroy()
        if flat[-1] <= before + 1e-9:
            break
        before, sums_of = flat[-1], flat[:-1].reshape(k, v)
        norm = np.linalg.norm(sums_of, axis=1, keepdims=True)
        centers = np.where(norm > 0, sums_of / np.where(norm > 0, norm, 1), centers)
    return centers
