"""Seeded splits and samples by hash order: the same rows in every engine and on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import quantiles, ranking

SEED = 20260909
VALIDATION, EVALUATION = 0.15, 0.20


def order_key(column: str, seed: int = SEED) -> Column:
    return F.md5(F.concat_ws("|", F.col(column).cast("string"), F.lit(str(seed))))


def hash_rank(df: DataFrame, key: str, group: list[str], seed: int = SEED, name: str = "_rank") -> DataFrame:
    """`df` with each row's place in its group by hash of `key`; equal hashes by key."""
    w = Window.partitionBy(*group).orderBy(order_key(key, seed), key)
    return df.withColumn(name, F.row_number().over(w))


def head_per_group(df: DataFrame, key: str, group: list[str], k: int, seed: int = SEED) -> DataFrame:
    """`k` rows of each group. The window group limit keeps k rows per task and group before the shuffle."""
    return hash_rank(df, key, group, seed).where(F.col("_rank") <= k).drop("_rank")


def quota_per_group(df: DataFrame, key: str, group: str, total: int, seed: int = SEED) -> DataFrame:
    """`total` rows spread evenly over the groups, the first groups by name taking one more each where it doesn't
    divide. Groups are few."""
    names = df.select(group).distinct()
    placed = names.withColumn("_g", F.dense_rank().over(Window.orderBy(group)))
    n = names.count()
    base, extra = divmod(total, max(n, 1))
    quota = placed.select(group, (F.lit(base) + F.when(F.col("_g") <= extra, 1).otherwise(0)).alias("_quota"))
    ranked = hash_place(df, key, [group], seed).join(quota, group)
    return ranked.where(F.col("_place") <= F.col("_quota")).drop("_place", "_quota")


def stratified_holdout(df: DataFrame, key: str, strata: list[str], share: float = EVALUATION, seed: int = SEED) -> DataFrame:
    """`df` with `split`: eval for round-half-even(share * n) rows of each stratum, else train."""
    n = df.groupBy(*strata).agg(F.count("*").alias("_n"))
    ranked = hash_place(df, key, strata, seed).join(n, strata)
    return ranked.withColumn("split", F.when(F.col("_place") <= F.bround(F.col("_n") * share), "eval").otherwise("train")).drop("_place", "_n")


def three_way(df: DataFrame, key: str, golden: int, label: str | None = None, seed: int = SEED) -> DataFrame:
    """`df` with `split`: golden (`golden` rows, as many of each label where one is given), val (15 % of the rest,
    rounded down), train."""
    group = [label] if label else []
    per = golden
    if label:
        classes = df.select(label).distinct().count()
        if golden % classes:
            raise ValueError(f"{golden} rows don't divide into {classes} classes")
        per = golden // classes
    base = df.withColumn("_key", order_key(key, seed))
    if label:
        w = Window.partitionBy(label).orderBy("_key", key)
        first = base.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per)
    else:
        first = base.orderBy("_key", key).limit(per)
    gold = first.select(F.col(key)).withColumn("_gold", F.lit(True))
    marked = base.join(gold, key, "left")
    rest = marked.where("_gold is null")
    n = int(rest.count() * VALIDATION)
    # 52 bits of the hash order the rest exactly without gathering it
    number = -F.conv(F.substring("_key", 1, 13), 16, 10).cast("double")
    ranked = ranking.ranked(rest.withColumn("_h", number), "_h", key)
    val = ranked.withColumn("split", F.when(F.col("rank") <= n, "val").otherwise("train")).drop("_h", "rank")
    return val.unionByName(marked.where("_gold").withColumn("split", F.lit("golden"))).drop("_key", "_gold")


def grouped_split(df: DataFrame, group: str, key: str, golden: int, seed: int = SEED) -> DataFrame:
    """`df` with `split`: golden has one row of each of `golden` groups, and none of their others is used."""
    one = head_per_group(df, key, [group], 1, seed)
    chosen = one.orderBy(order_key(group, seed), group).limit(golden)
    gold = chosen.select(key).withColumn("_gold", F.lit(True))
    blocked = chosen.select(group).withColumn("_blocked", F.lit(True))
    joined = df.join(gold, key, "left").join(blocked, group, "left")
    return joined.withColumn("split", F.when(F.col("_gold"), "golden").when(F.col("_blocked"), "dropped").otherwise("train")).drop("_gold", "_blocked")


def capped_mining(df: DataFrame, key: str, task: str, bucket: str, cap: int, seed: int = SEED) -> DataFrame:
    """Up to `cap` rows of each task, its buckets in equal parts first, the rest by hash."""
    n = df.groupBy(task).agg(F.countDistinct(bucket).alias("_b"))
    placed = hash_place(df, key, [task, bucket], seed, "_in").join(n, task)
    late = (F.col("_in") > F.floor(F.lit(cap) / F.col("_b"))).cast("double")
    # early rows before late ones, either by hash: 53 bits, exact in a double
    ordered = placed.withColumn("_o", hash_number(key, seed) - late * (1 << 52))
    return ranking.ranked(ordered, "_o", key, [task], "_r").where(F.col("_r") <= cap).drop("_r", "_o", "_in", "_b")


def length_matched(negatives: DataFrame, positives: DataFrame, key: str, length: str, bins: int = 20, seed: int = SEED) -> DataFrame:
    """As many positives in each quantile bin of the negatives' lengths as there are negatives, or all there are."""
    edges = quantiles.exact(negatives, length, [i / bins for i in range(bins + 1)]).first()["q"]
    edges = F.array(*[F.lit(float(e)) for e in edges])
    where = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.size(F.filter(edges, lambda e: e <= F.col(length))) - 1))
    want = negatives.withColumn("bin", where).groupBy("bin").agg(F.count("*").alias("_n"))
    ranked = hash_place(positives.withColumn("bin", where), key, ["bin"], seed).join(want, "bin")
    return ranked.where(F.col("_place") <= F.col("_n")).drop("_place", "_n")


def hash_number(key: str, seed: int = SEED) -> Column:
    """52 bits of the hash of `key`, the smallest hash the largest number."""
    return -F.conv(F.substring(order_key(key, seed), 1, 13), 16, 10).cast("double")


def hash_place(df: DataFrame, key: str, group: list[str], seed: int = SEED, name: str = "_place") -> DataFrame:
    """`df` with each row's place from 1 in its group by 52 bits of the hash of `key`, equal ones by key; no task holds a
    whole group."""
    return ranking.ranked(df.withColumn("_h", hash_number(key, seed)), "_h", key, group, name).drop("_h")


def permuted_labels(df: DataFrame, key: str, labels: list[str], seed: int = SEED) -> DataFrame:
    """`df` with its label columns dealt anew, together, over the whole table: the row at place i in one hash order gets
    those at place i in another."""
    a = hash_place(df, key, [], seed, "_i").drop(*labels)
    b = hash_place(df, key, [], seed + 1, "_i").select("_i", *labels)
    return a.join(b, "_i").drop("_i")


def leaks(splits: DataFrame, key: str, split: str) -> DataFrame:
    """Rows (a, b, n): keys that two splits share; none where the splits are disjoint."""
    each = splits.select(key, split).distinct().groupBy(key).agg(F.sort_array(F.collect_set(split)).alias("s")).where("size(s) > 1")
    first = each.select(key, F.posexplode("s").alias("i", "a"), "s")
    return first.select("a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))


def first_per_key(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in the order given."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
