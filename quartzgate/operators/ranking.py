"""Exact ranks and running sums over a whole table without gathering it in one task.

A sample of the ordering column and its tie-breaker gives cut points, so that a value which many rows
share is cut as well; the buckets' totals give each bucket's offset, and a window inside the bucket does the
rest. Buckets grow in number with the rows, and a row finds its own by binary search.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a bucket to aim at, the fewest buckets, and sampled rows for each of them. The driver gets rows / ROWS * SAMPLED keys.
ROWS, LEAST, SAMPLED = 200_000, 8, 64


def bucketed(df: DataFrame, column: str, tie: str | None = None, rows: int | None = None) -> DataFrame:
    """`df` with `_bucket`, ascending in the order of `column` descending, nulls last, then of `tie` ascending. Rows equal
    in both share a bucket. `rows`: how many there are, where that is known."""
    rows = df.count() if rows is None else rows
    buckets = max(LEAST, rows // ROWS)
    keys = [column, *([tie] if tie else [])]
    step = max(1, rows // (buckets * SAMPLED))
    order = [F.col(column).desc_nulls_last(), *([F.col(tie)] if tie else [])]
    drawn = df.select(*keys).where(F.pmod(F.xxhash64(*keys), F.lit(step)) == 0).orderBy(*order).collect()  # about buckets * SAMPLED rows
    cuts = [drawn[i] for i in range(SAMPLED, len(drawn), SAMPLED)] if step > 1 else [drawn[len(drawn) * i // buckets] for i in range(1, buckets) if drawn]
    cuts = list(dict.fromkeys(map(tuple, cuts)))
    if not cuts:
        return df.withColumn("_bucket", F.lit(0))
    types = [df.schema[k].dataType for k in keys]
    table = F.array(*[F.struct(*[F.lit(x).cast(t).alias(n) for n, x, t in zip(("v", "t"), cut, types)]) for cut in cuts])
    value = F.col(column)

    def reached(cut: Column) -> Column:
        """Whether a row stands at a cut or behind it."""
        after = F.when(cut["v"].isNull(), F.lit(False)).otherwise(value.isNull() | (value < cut["v"]))
        equal = value.eqNullSafe(cut["v"])
        return after | (equal if tie is None else equal & (F.col(tie) >= cut["t"]))

    steps = F.array(*[F.lit(1 << i) for i in range(len(cuts).bit_length() - 1, -1, -1)])
    found = F.aggregate(
        steps, F.lit(0),
        lambda i, step: F.when((i + step <= len(cuts)) & F.coalesce(reached(F.get(table, i + step - 1)), F.lit(False)), i + step).otherwise(i),
    )
    return df.withColumn("_bucket", found)


def running(df: DataFrame, column: str, group: list[str], totals: dict[str, Column], tie: list[str] | None = None, rows: int | None = None) -> DataFrame:
    """`df` with, for each name in `totals`, the sum of its expression over all rows of the group up to and with
    this one, in descending order of `column`; ties by `tie`, or together where it is None."""
    cut = bucketed(df, column, tie[0] if tie else None, rows)
    for name, value in totals.items():
        cut = cut.withColumn(f"_{name}", value)
    sums = cut.groupBy(*group, "_bucket").agg(*[F.sum(f"_{n}").alias(f"_sum_{n}") for n in totals])
    upto = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    for name in totals:
        sums = sums.withColumn(f"_base_{name}", F.coalesce(F.sum(f"_sum_{name}").over(upto), F.lit(0)))
    base = sums.select(*group, "_bucket", *[f"_base_{n}" for n in totals])  # a row for each bucket and group
    order = [F.col(column).desc_nulls_last(), *(tie or [])]
    w = Window.partitionBy(*group, "_bucket").orderBy(*order)
    w = w.rowsBetween(Window.unboundedPreceding, 0) if tie else w.rangeBetween(Window.unboundedPreceding, 0)
    out = cut.join(base, [*group, "_bucket"])
    for name in totals:
        out = out.withColumn(name, F.sum(f"_{name}").over(w) + F.col(f"_base_{name}"))
    return out.drop("_bucket", *[f"_{n}" for n in totals], *[f"_base_{n}" for n in totals])


def ranked(df: DataFrame, column: str, tie: str, group: list[str] | None = None, name: str = "rank", rows: int | None = None) -> DataFrame:
    """`df` with each row's place in descending order of `column`, nulls and NaN last, ties by `tie`."""
    clean = df.withColumn(column, F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double")))
    return running(clean, column, group or [], {name: F.lit(1)}, [tie], rows)


def average_rank(df: DataFrame, column: str, name: str, group: list[str] | None = None) -> DataFrame:
    """`df` with the ascending rank of `column` in which ties share their mean, as correlation of ranks needs."""
    group = group or []
    counts = df.where(F.col(column).isNotNull()).groupBy(*group, column).agg(F.count("*").alias("_n"))
    upto = running(counts, column, group, {"_upto": F.col("_n")})
    total = counts.groupBy(*group).agg(F.sum("_n").alias("_all"))
    placed = upto.join(total, group) if group else upto.crossJoin(F.broadcast(total))
    rank = F.col("_all") - F.col("_upto") + (F.col("_n") + 1) / 2
    return df.join(placed.select(*group, column, rank.alias(name)), [*group, column])
