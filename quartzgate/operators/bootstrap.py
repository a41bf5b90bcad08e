"""Bootstrap intervals, in two ways.

resamples draws rows from a hash that every engine computes alike: draw d of replicate r picks the row whose index is a
hash of (r, d, seed) modulo n. Draws are generated beside the rows and joined, R * n small rows, so it suits few replicates.

The functions that end in _by_weights give each row a Poisson weight for each replicate, from a hash of its key, next to
the row: nothing is joined or indexed, tasks add up one array for all replicates, and any number of rows will do. A
replicate's size varies about n, as usual with such weights; intervals agree with those of resamples.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import session
from ..sources.tables import spread
from . import models, ranking

#: Rows and replicates whose weights are a matrix at a time.
ROWS, REPLICATES = 4096, 1024
#: Ranks of a run that a replicate's budget may cut.
RUN = 50_000


def drawn(n: Column, replicate: Column, draw: Column, seed: int) -> Column:
    """An index below n."""
    digest = F.substring(F.md5(F.concat_ws("|", replicate.cast("string"), draw.cast("string"), F.lit(str(seed)))), 1, 8)
    return F.pmod(F.conv(digest, 16, 10).cast("long"), n.cast("long"))


def _draws(df: DataFrame, key: str, replicates: int, seed: int, group: list[str]) -> tuple[DataFrame, DataFrame]:
    """(`df` with each row's index `_i` in its group, (group, replicate, _i) of each draw). Draws are made beside the indexed
    rows, one for each row and replicate, so tasks share them; both sides are far larger than Spark takes the draws to be."""
    ordered = df.withColumn("_k", -F.col(key).cast("double"))
    indexed = ranking.ranked(ordered, "_k", key, group, "_i").withColumn("_i", F.col("_i").cast("long") - 1).drop("_k")
    indexed = session.materialize(indexed, "bootstrap-rows")
    sizes = indexed.groupBy(*group).agg(F.count("*").alias("_n"))
    places = spread(indexed.select(*group, F.col("_i").alias("_d")))
    sized = places.join(sizes, group) if group else places.crossJoin(F.broadcast(sizes))  # one row
    draws = sized.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    draws = draws.withColumn("_i", drawn(F.col("_n"), F.concat_ws(":", *group, F.col("replicate").cast("string")), F.col("_d"), seed))
    return indexed, draws.select(*group, "replicate", "_i")


def resamples(df: DataFrame, key: str, replicates: int, seed: int, group: list[str] | None = None) -> DataFrame:
    """`df` rows with `replicate`: each replicate holds as many rows of each group as `df` has.

    Rows are indexed by a numeric key, with or without groups in no single task.
    """
    group = group or []
    indexed, draws = _draws(df, key, replicates, seed, group)
    return draws.join(indexed.hint("shuffle_hash"), [*group, "_i"]).drop("_i")


def interval(per_replicate: DataFrame, value: str, level: float = 0.95) -> DataFrame:
    """One row: replicates, low, high; interpolated percentiles."""
    a = (1 - level) / 2
    return per_replicate.agg(F.count(value).alias("replicates"), F.percentile(value, a).alias("low"), F.percentile(value, 1 - a).alias("high"))


def ratio_difference(df: DataFrame, key: str, a: str, b: str, base: str, replicates: int = 1000, seed: int = 0) -> DataFrame:
    """One row: the interval of sum(a) / sum(base) - sum(b) / sum(base), resampling rows."""
    r = resamples(df, key, replicates, seed).groupBy("replicate").agg(F.try_divide(F.sum(a) - F.sum(b), F.sum(base)).alias("d"))
    return interval(r, "d")


def paired_quality(df: DataFrame, key: str, policies: tuple[str, str], budget: float, replicates: int = 200, seed: int = 0) -> DataFrame:
    """One row: the interval of the quality of one score column's escalations less another's, resampled within tasks,
    the budget applied anew to each replicate.

    Rows are ranked once by each score and cut into runs; a replicate's copies are counted by run, and only the run in which
    its budget ends is put in order."""
    held = df.select(key, "task", *dict.fromkeys(policies), F.col("frontier_success").cast("int").alias("_up"), F.col("success").cast("int").alias("_down"))
    for i, score in enumerate(policies):
        held = ranking.running(held, score, [], {f"_r{i}": F.lit(1)}, [key])
    indexed, draws = _draws(held.drop(*(set(policies) - {key})), key, replicates, seed, ["task"])
    counted = draws.groupBy("task", "replicate", "_i").agg(F.count("*").alias("_c"))
    copies = counted.join(indexed.hint("shuffle_hash"), ["task", "_i"])
    copies = session.materialize(copies.select("replicate", "_c", "_up", "_down", *[f"_r{i}" for i in range(len(policies))]), "bootstrap-copies")
    sides = [_quality(copies, f"_r{i}", budget).withColumnRenamed("q", f"q{i}") for i in range(len(policies))]
    both = sides[0].join(sides[1], "replicate").withColumn("d", F.col("q0") - F.col("q1"))
    return interval(both, "d")


def _quality(copies: DataFrame, rank: str, budget: float) -> DataFrame:
    """Rows (replicate, q): the mean outcome when the first bround(budget * size) copies by `rank` are escalated. copies: rows
    (replicate, _c, _up, _down, rank), each for _c equal copies; null outcomes don't count."""
    runs = F.floor((F.col(rank) - 1) / RUN).alias("_run")
    n = lambda x: F.sum(F.when(F.col(x).isNotNull(), F.col("_c")).otherwise(0))
    total = lambda x: F.coalesce(F.sum(F.col("_c") * F.col(x)), F.lit(0))
    each = copies.groupBy("replicate", runs).agg(F.sum("_c").alias("_size"), *[f(x).alias(f"{name}{x}") for x in ("_up", "_down") for name, f in (("n", n), ("s", total))])
    w = Window.partitionBy("replicate")
    placed = each.withColumn("_upto", F.sum("_size").over(w.orderBy("_run"))).withColumn("_wanted", F.bround(F.sum("_size").over(w) * budget))
    side = F.when(F.col("_upto") <= F.col("_wanted"), F.lit("_up")).when(F.col("_upto") - F.col("_size") >= F.col("_wanted"), F.lit("_down"))
    placed = placed.withColumn("_side", side)
    pick = lambda name: F.when(F.col("_side") == "_up", F.col(f"{name}_up")).otherwise(F.col(f"{name}_down"))
    sure = placed.where("_side is not null").select("replicate", pick("s").alias("_s"), pick("n").alias("_n"))
    # a run for each replicate at most
    cut = placed.where("_side is null").select("replicate", "_run", (F.col("_wanted") - F.col("_upto") + F.col("_size")).alias("_rest"))
    open_ = copies.withColumn("_run", runs).join(F.broadcast(cut), ["replicate", "_run"])
    before = F.sum("_c").over(Window.partitionBy("replicate").orderBy(rank)) - F.col("_c")
    gone = F.greatest(F.lit(0), F.least(F.col("_c"), F.col("_rest") - before))
    split = open_.withColumn("_gone", gone.cast("long")).withColumn("_stay", F.col("_c") - F.col("_gone"))
    known = lambda c, x: F.when(F.col(x).isNotNull(), F.col(c)).otherwise(0)
    value = lambda c, x: F.col(c) * F.coalesce(F.col(x), F.lit(0))
    rest = split.select("replicate", (value("_gone", "_up") + value("_stay", "_down")).alias("_s"), (known("_gone", "_up") + known("_stay", "_down")).alias("_n"))
    sums = sure.unionByName(rest).groupBy("replicate").agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
    return sums.select("replicate", F.try_divide(F.col("_s").cast("double"), F.col("_n")).alias("q"))


def mean_difference(df: DataFrame, key: str, difference: str, replicates: int = 1000, seed: int = 0) -> DataFrame:
    """One row: the interval of the mean of a difference that each row has."""
    r = resamples(df, key, replicates, seed).groupBy("replicate").agg(F.avg(difference).alias("d"))
    return interval(r, "d")


def rank_correlation_difference(df: DataFrame, key: str, truth: str, a: str, b: str, replicates: int = 1000, seed: int = 0) -> DataFrame:
    """One row: the interval of Spearman's correlation of `a` with the truth less that of `b`; a replicate in which one of
    them is constant counts for nothing."""
    drawn_rows = resamples(df, key, replicates, seed)

    def rank(c: str) -> Column:
        w = Window.partitionBy("replicate")
        return F.rank().over(w.orderBy(c)) + (F.count("*").over(Window.partitionBy("replicate", c)) - 1) / 2

    ranks = drawn_rows.select("replicate", *[rank(c).alias(c) for c in (truth, a, b)])
    pair = lambda c: F.corr(truth, c)
    each = ranks.groupBy("replicate").agg((pair(a) - pair(b)).alias("d"))
    return interval(each.select(F.when(~F.isnan("d"), F.col("d")).alias("d")), "d")


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters close ones."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _poisson_table() -> np.ndarray:
    """The Poisson count of mean 1 for each of 65,536 equal shares of probability."""
    upto = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])
    return np.searchsorted(upto, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


POISSON = _poisson_table()


def weights(keys: np.ndarray, first: int, count: int, seed: int) -> np.ndarray:
    """The weight of each key (64-bit hashes) in the replicates from `first`, a multiple of 4, on: four from one hash."""
    blocks = np.arange(first // 4, -(-(first + count) // 4), dtype=np.uint64)
    salt = _mixed(blocks * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed % (1 << 62) * 2 + 1))
    h = _mixed(keys.astype(np.int64).view(np.uint64)[:, None] ^ salt[None, :])
    return POISSON[h.view(np.uint16).reshape(len(keys), -1)[:, :count]]


def _keyed(df: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    return df.select(F.xxhash64(F.col(key).cast("string")).alias("_h"), *[F.coalesce(v.cast("double"), F.lit(0.0)).alias(n) for n, v in values.items()])


def sums_by_weights(df: DataFrame, key: str, values: dict[str, Column], replicates: int, seed: int = 0) -> np.ndarray:
    """(replicates, values): each value's weighted sum in each replicate; null counts as 0. The driver gets that array."""
    names = list(values)

    def sums(batches: Iterator) -> np.ndarray:
        out = np.zeros((replicates, len(names)))
        for b in batches:
            keys = b.column("_h").to_numpy()
            x = np.stack([b.column(n).to_numpy(zero_copy_only=False) for n in names], 1) if len(b) else np.zeros((0, len(names)))
            for at in range(0, len(keys), ROWS):
                for r in range(0, replicates, REPLICATES):
                    w = weights(keys[at : at + ROWS], r, min(REPLICATES, replicates - r), seed)
                    out[r : r + w.shape[1]] += w.T.astype(float) @ x[at : at + ROWS]
        return out.ravel()

    return models.summed(_keyed(df, key, values), sums, replicates * len(names)).reshape(replicates, -1)


def interval_of(df: DataFrame, each: np.ndarray, level: float = 0.95) -> DataFrame:
    """One row: replicates, low, high, of the replicates' finite values."""
    good = each[np.isfinite(each)]
    a = 100 * (1 - level) / 2
    low, high = np.percentile(good, [a, 100 - a]).tolist() if len(good) else (None, None)
    return df.sparkSession.createDataFrame([(len(good), low, high)], "replicates long, low double, high double")


def ratio_difference_by_weights(df: DataFrame, key: str, a: str, b: str, base: str, replicates: int = 10_000, seed: int = 0) -> DataFrame:
    """One row: the interval of sum(a) / sum(base) - sum(b) / sum(base)."""
    s = sums_by_weights(df, key, {"d": F.col(a) - F.col(b), "base": F.col(base)}, replicates, seed)
    with np.errstate(invalid="ignore", divide="ignore"):
        return interval_of(df, s[:, 0] / s[:, 1])


def mean_difference_by_weights(df: DataFrame, key: str, difference: str, replicates: int = 10_000, seed: int = 0) -> DataFrame:
    """One row: the interval of the mean of a difference that each row has; rows without one don't count."""
    d = F.col(difference)
    s = sums_by_weights(df, key, {"d": d, "n": d.isNotNull().cast("int")}, replicates, seed)
    with np.errstate(invalid="ignore", divide="ignore"):
        return interval_of(df, s[:, 0] / s[:, 1])


def qualities_by_weights(df: DataFrame, key: str, score: str, budget: float, replicates: int, seed: int = 0) -> np.ndarray:
    """Each replicate's quality when the first round-half-even(budget * size) copies of its rows are escalated, by descending
    score, ties by key.

    Rows are ranked once and cut into runs of equal length. A first pass gives each run's size and outcomes in each replicate, so
    the run in which a replicate's budget ends is known; a second reads each run in order and settles those replicates.
    """
    n = df.count()
    if not n:
        return np.full(replicates, np.nan)
    length = max(1, -(-n // max(64, n // 500_000)))
    runs = -(-n // length)
    ranked = ranking.ranked(df, score, key, rows=n)
    outcome = {"run": F.floor((F.col("rank") - 1) / length), "rank": F.col("rank"), "up": F.col("frontier_success").cast("int"), "down": F.col("success").cast("int")}
    rows = session.materialize(_keyed(ranked, key, outcome), "bootstrap-runs")

    def parts(batches: Iterator) -> Iterator[tuple[np.ndarray, ...]]:
        for b in batches:
            columns = [b.column(c).to_numpy(zero_copy_only=False) for c in ("_h", "run", "up", "down")]
            for at in range(0, len(b), ROWS):
                yield tuple(c[at : at + ROWS] for c in columns)

    def totals(batches: Iterator) -> np.ndarray:
        out = np.zeros((3, runs, replicates))
        for keys, run, up, down in parts(batches):
            found, where = np.unique(run.astype(int), return_inverse=True)
            member = np.zeros((len(found), len(keys)))
            member[where, np.arange(len(keys))] = 1
            for r in range(0, replicates, REPLICATES):
                w = weights(keys, r, min(REPLICATES, replicates - r), seed).astype(float)
                for i, x in enumerate((1.0, up, down)):
                    out[i, found, r : r + w.shape[1]] += (member * x) @ w
        return out.ravel()

    size, up, down = models.summed(rows, totals, 3 * runs * replicates).reshape(3, runs, replicates)
    total = size.sum(0)
    wanted = np.rint(total * budget)
    upto = np.cumsum(size, 0)
    cut = np.argmax(upto >= wanted, 0)  # the run in which the budget ends
    every = np.arange(replicates)
    rest = wanted - (upto - size)[cut, every]
    order = np.arange(runs)[:, None]
    sure = np.where(order < cut, up, 0).sum(0) + np.where(order > cut, down, 0).sum(0)

    def settle(batches: Iterator) -> np.ndarray:
        out, seen, at = np.zeros(replicates), np.zeros(replicates), -1
        for keys, run, up, down in parts(batches):
            for number in np.unique(run.astype(int)):
                mine, own = run == number, np.flatnonzero(cut == number)
                if number != at:
                    seen, at = np.zeros(replicates), number
                for r in np.unique(own // REPLICATES) * REPLICATES:
                    here = own[(own >= r) & (own < r + REPLICATES)]
                    w = weights(keys[mine], int(r), min(REPLICATES, replicates - int(r)), seed)[:, here - r].astype(float)
                    before = seen[here] + np.cumsum(w, 0) - w
                    gone = np.clip(rest[here] - before, 0, w)
                    out[here] += up[mine] @ gone + down[mine] @ (w - gone)
                    seen[here] += w.sum(0)
        return out

    dealt = rows.repartition("run").sortWithinPartitions("run", "rank")
    settled = models.summed(dealt, settle, replicates)
    session.release(rows)
    with np.errstate(invalid="ignore", divide="ignore"):
        return (sure + settled) / total


def paired_quality_by_weights(df: DataFrame, key: str, policies: tuple[str, str], budget: float, replicates: int = 2_000, seed: int = 0) -> DataFrame:
    """One row: the interval of the quality of one score column's escalations less another's, the budget applied anew to each
    replicate. Both sides see the same replicates."""
    a, b = (qualities_by_weights(df, key, p, budget, replicates, seed) for p in policies)
    return interval_of(df, a - b)
