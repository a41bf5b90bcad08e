"""Building sets of rows to label, train on and evaluate: screens, draws, plans, demonstrations, unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import quantiles, ranking
from .sampling import SEED, hash_place, head_per_group, order_key

CONTEXT, SENTENCE = 512, 15


def present(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows in which none of the columns is null or blank."""
    keep = F.lit(True)
    for c in columns:
        keep = keep & F.col(c).isNotNull() & F.rlike(c, F.lit(r"(?U)\S"))
    return df.where(keep)


def long_enough(text: Column, least: int = SENTENCE) -> Column:
    return F.length(text) >= least


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up, where no tokenizer's count is at hand."""
    return F.ceil(F.length(text) / 4)


def within_cap(text: Column, tokens: Column | None = None, cap: int = CONTEXT) -> Column:
    return F.coalesce(tokens if tokens is not None else F.lit(None), token_estimate(text)) <= cap


def capped(df: DataFrame, key: str, cap: int, seed: int = SEED) -> DataFrame:
    """At most `cap` rows, those first by the hash of their key."""
    return df.orderBy(order_key(key, seed), key).limit(cap)


def pool(df: DataFrame, key: str, text: str, excluded: DataFrame, sizes: dict[str, int], seed: int = SEED) -> DataFrame:
    """`sizes` rows for each named part, drawn in one hash order: no row whose key is in `excluded` (key), and one of each
    text, that of the smallest key. An error where too few rows are left."""
    free = df.join(excluded.select(key).distinct(), key, "left_anti")
    first = free.groupBy(F.md5(text).alias("_t")).agg(F.min(key).alias(key)).select(key)
    placed = hash_place(free.join(first, key, "left_semi"), key, [], seed)
    total = sum(sizes.values())
    drawn = placed.where(F.col("_place") <= total)
    if (n := drawn.count()) < total:
        raise ValueError(f"{n} rows are left where {total} are asked for")
    part, upto = None, 0
    for name, size in sizes.items():
        upto += size
        part = F.when(F.col("_place") <= upto, name) if part is None else part.when(F.col("_place") <= upto, name)
    return drawn.withColumn("part", part).drop("_place")


def balanced(df: DataFrame, label: str, key: str, seed: int = SEED) -> DataFrame:
    """As many rows of each class as the smallest one has, by hash."""
    least = df.groupBy(label).count().agg(F.min("count")).first()[0] or 0
    return hash_place(df, key, [label], seed).where(F.col("_place") <= least).drop("_place")


def few_of_each(df: DataFrame, key: str, group: str, per: int, total: int) -> DataFrame:
    """Up to `per` rows of each group, first keys first, and of those the first `total`."""
    from pyspark.sql import Window

    w = Window.partitionBy(group).orderBy(key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per).drop("_r").orderBy(key).limit(total)


def labelling_plan(router: DataFrame, mining: DataFrame, key: str, sample: int, calibration: int, seed: int = SEED) -> DataFrame:
    """What is to be graded: all router rows and `sample` mining rows; `calibration` of all are marked for a second grader."""
    drawn = capped(mining, key, sample, seed).withColumn("origin", F.lit("mining"))
    every = router.withColumn("origin", F.lit("router")).unionByName(drawn)
    marked = capped(every, key, calibration, seed + 1).select(key).withColumn("calibration", F.lit(True))
    return every.join(marked, key, "left").withColumn("calibration", F.coalesce("calibration", F.lit(False)))


def demonstrations(train: DataFrame, golden: DataFrame, key: str, label: str, per_class: int | None = None, total: int | None = None) -> DataFrame:
    """Examples for a prompt: `per_class` rows of each class, or `total` rows; none whose key is in `golden`."""
    if (per_class is None) == (total is None):
        raise ValueError("give per_class or total")
    free = train.join(golden.select(key).distinct(), key, "left_anti")
    return head_per_group(free, key, [label], per_class) if per_class is not None else capped(free, key, total)


def union_filled(a: DataFrame, b: DataFrame, fill: dict[str, object]) -> DataFrame:
    """Rows of both, with null where a column is missing and then `fill`'s values."""
    both = a.unionByName(b, allowMissingColumns=True)
    return both.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fill.items()})


def same_rows(a: DataFrame, b: DataFrame, ordinal: str, same: list[str]) -> DataFrame:
    """`a` beside the other columns of `b` by ordinal; an error unless both have the same ordinals and agree in `same`."""
    differs = F.lit(False)
    for c in same:
        differs = differs | ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    joined = a.alias("a").join(b.alias("b"), F.col(f"a.{ordinal}") == F.col(f"b.{ordinal}"), "full")
    missing = F.col(f"a.{ordinal}").isNull() | F.col(f"b.{ordinal}").isNull()
    wrong = joined.where(missing | differs).count()
    if wrong:
        raise ValueError(f"{wrong} rows are not the same")
    others = [F.col(f"b.{c}") for c in b.columns if c not in a.columns]
    return joined.where(~missing).select("a.*", *others)


def for_each_task(texts: DataFrame, text: str, tasks: list[str]) -> DataFrame:
    """Each text once for each task, equal requests once: request is the hash of task and text."""
    each = texts.withColumn("task", F.explode(F.array(*[F.lit(t) for t in tasks])))
    request = F.substring(F.sha2(F.concat_ws("\u0001", "task", text), 256), 1, 16)
    return each.withColumn("request", request).groupBy("request", "task").agg(F.min(text).alias(text), F.count("*").alias("n"))


def dense_place(df: DataFrame, key: str, name: str = "place") -> DataFrame:
    """`df` with the dense rank of a numeric key, from 1."""
    keys = df.select(key).distinct()
    upto = ranking.ranked(keys.withColumn("_k", -F.col(key).cast("double")), "_k", key, [], name).drop("_k")
    return df.join(upto, key)


def interleaved(df: DataFrame, key: str, last: int = 4) -> DataFrame:
    """`df` in the order of the last characters of its key, then of the key, so that tasks mix."""
    return df.orderBy(F.right(F.col(key).cast("string"), F.lit(last)), key)


def majority(df: DataFrame, label: str) -> DataFrame:
    """One row (label, n): the commonest label, the first by name of several."""
    return df.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label).limit(1)


def weighted_rate(df: DataFrame, rate: str, weight: str) -> DataFrame:
    """One row (rate): the mean of `rate` by `weight`."""
    return df.agg((F.sum(F.col(rate) * F.col(weight)) / F.sum(weight)).alias("rate"))


def exclusive_quantile(df: DataFrame, column: str, q: int, parts: int = 100) -> DataFrame:
    """One row (n, value): the q-th of `parts` - 1 cut points at q * (n + 1) / parts, as for a sample that need not hold the extremes."""
    n = df.where(F.col(column).isNotNull()).count()
    if n < 2:
        raise ValueError("a quantile needs two values")
    at = max(1, min(n - 1, q * (n + 1) // parts))
    share = (q * (n + 1) - at * parts) / parts
    ranks = df.sparkSession.createDataFrame([(at - 1,), (at,)], "rank long")
    both = quantiles.at_ranks(df, column, ranks).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return both.select(F.lit(n).cast("long").alias("n"), (F.col("low") * (1 - share) + F.col("high") * share).alias("value"))
