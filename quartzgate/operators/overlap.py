"""Joins of intervals that overlap, by bins of positions.

An interval has a level, at which it covers few bins; bins of the next level are FACTOR times as wide. It is sent to its bins at
its own level and to those, two at most, at each higher one. Two intervals meet at the level of the longer one, in the bin
where the later of them starts, and nowhere else: so there is nothing to dedupe, no interval is copied more than
FACTOR + 2 * LEVELS times, and the join is an equi-join on (key, level, bin), whatever the lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FACTOR, LEVELS = 32, 6


def _width(width: int, level: Column) -> Column:
    return F.element_at(F.array(*[F.lit(width * FACTOR**i) for i in range(LEVELS)]), (level + 1).cast("int"))


def _sent(df: DataFrame, start: str, end: str, width: int, side: str) -> DataFrame:
    """`df` once for each (level, bin) that it is sent to; intervals without length or bounds meet nothing."""
    held = df.where(F.col(end) > F.col(start))
    long = (F.col(end) - F.col(start)).cast("double")
    level = sum((F.when(long > float(width * FACTOR**i), 1).otherwise(0) for i in range(1, LEVELS)), F.lit(0))
    own = held.withColumn(f"_own{side}", level)
    each = own.withColumn("_level", F.explode(F.sequence(F.col(f"_own{side}"), F.lit(LEVELS - 1))))
    w = _width(width, F.col("_level"))
    first, last = F.floor(F.col(start) / w), F.ceil(F.col(end) / w) - 1
    return each.withColumn("_bin", F.explode(F.sequence(first.cast("long"), last.cast("long"))))


def overlapping(a: DataFrame, b: DataFrame, key: list[str], bounds_a: tuple[str, str], bounds_b: tuple[str, str], width: int) -> DataFrame:
    """The columns of `a` and `b` for each pair of one key whose half-open numeric intervals share a point. Column names must
    differ but for the key's. width: about the length of a short interval; it changes the work, not the result.
    Null keys and bounds, and intervals without length, meet nothing."""
    clash = (set(a.columns) & set(b.columns)) - set(key)
    if clash:
        raise ValueError(f"both sides have {sorted(clash)}")
    left, right = _sent(a, *bounds_a, width, "a"), _sent(b, *bounds_b, width, "b")
    met = left.join(right, [*key, "_level", "_bin"])
    starts = F.greatest(F.col(bounds_a[0]), F.col(bounds_b[0]))
    once = (F.col("_level") == F.greatest("_owna", "_ownb")) & (F.col("_bin") == F.floor(starts / _width(width, F.col("_level"))))
    both = (F.col(bounds_a[0]) < F.col(bounds_b[1])) & (F.col(bounds_b[0]) < F.col(bounds_a[1]))
    return met.where(once & both).select(*key, *[c for c in a.columns if c not in key], *[c for c in b.columns if c not in key])


def spans_of(df: DataFrame, doc: str, spans: str, prefix: str) -> DataFrame:
    """A row for each span of an array column: doc, and start, end and label with the prefix."""
    each = df.select(doc, F.explode(spans).alias("_s"))
    return each.select(doc, *[F.col(f"_s.{c}").alias(f"{prefix}{c}") for c in ("start", "end", "label")])
