"""Exact quantiles of many groups at once by distributed selection.

No aggregate holds a group's values. Where a group has more than LIMIT rows, each wanted rank is closed in: a sketch of
bounded size gives GRID cut points of the rows still in question, the two around the rank become its new bounds, and a count
of the rows below, at and between them corrects the rank, so results are exact however good the sketch is. A value that
many rows share becomes a bound and answers at once or stays outside. What is left, LIMIT rows or fewer between the bounds,
is counted by value and ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import session

#: Rows between a rank's bounds that are ranked at last, cut points of a sketch, and its accuracy.
LIMIT, GRID, ACCURACY = 200_000, 128, 2048


def _needed(probs: Sequence[float], n: Column, kind: str) -> list[Column]:
    """The ranks, from 0, that each quantile is made of."""
    if kind == "lower":
        return [F.floor(F.lit(float(p)) * (n - 1)) for p in probs]
    at = [F.lit(float(p)) * (n - 1) for p in probs]
    return [f(a) for a in at for f in (F.floor, F.ceil)]


def at_ranks(df: DataFrame, column: str, ranks: DataFrame, group: Sequence[str] = (), limit: int = LIMIT) -> DataFrame:
    """Rows (group..., rank, value): of each of `ranks` (group..., rank from 0) the value that stands there when the group's
    values ascend. Nulls take no part; NaN comes last. A rank beyond the group has no row."""
    group = list(group)
    values = df.where(F.col(column).isNotNull()).select(*group, F.col(column).cast("double").alias("_v"))
    sizes = values.groupBy(*group).agg(F.count("*").alias("_in"))
    wanted = ranks.select(*group, F.col("rank").cast("long").alias("rank")).distinct()
    state = _joined(wanted, sizes, group).where("rank < _in and rank >= 0")
    # the rank among the rows strictly between _low and _high (null: no bound), and how many they are
    nothing = F.lit(None).cast("double")
    state = session.materialize(state.select(*group, "rank", F.col("rank").alias("_left"), "_in", nothing.alias("_low"), nothing.alias("_high"), nothing.alias("_answer")), "quantile-ranks")
    most = state.agg(F.max("_in")).first()[0] or 0
    while most > limit:
        closer = session.materialize(_closed_in(values, state, group, limit), "quantile-ranks")
        session.release(state)
        state, before = closer, most
        most = state.where("_answer is null").agg(F.max("_in")).first()[0] or 0
        if most >= before:
            break
    left = state.where("_answer is null")
    counts = _between(values, left, group).groupBy(*group, "rank", "_left", "_v").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*group, "rank").orderBy("_v")
    placed = counts.withColumn("_upto", F.sum("_n").over(upto)).where("_upto > _left")
    found = placed.groupBy(*group, "rank").agg(F.min("_v").alias("value"))
    return found.unionByName(state.where("_answer is not null").select(*group, "rank", F.col("_answer").alias("value")))


def _joined(a: DataFrame, b: DataFrame, group: list[str], how: str = "inner") -> DataFrame:
    """An equi-join on the group, null groups included; without a group `b` has one row at most."""
    if not group:
        return a.join(F.broadcast(b), F.lit(True), how)
    b = b.select(*[F.col(c).alias(f"_g_{c}") if c in group else F.col(c) for c in b.columns])
    on = None
    for c in group:
        same = a[c].eqNullSafe(b[f"_g_{c}"])
        on = same if on is None else on & same
    return a.join(b, on, how).drop(*[f"_g_{c}" for c in group])


def _between(values: DataFrame, state: DataFrame, group: list[str]) -> DataFrame:
    """Each value beside each of its group's ranks whose bounds it lies between. A group's ranks meet its rows as one array, so
    rows go through the join once."""
    bounds = F.collect_list(F.struct(*[c for c in state.columns if c not in group]))
    each = state.groupBy(*group).agg(bounds.alias("_each"))
    inside = lambda b: (b["_low"].isNull() | (F.col("_v") > b["_low"])) & (b["_high"].isNull() | (F.col("_v") < b["_high"]))
    met = _joined(values, each, group)
    return met.select(*group, "_v", F.inline(F.filter("_each", inside)))


def _closed_in(values: DataFrame, state: DataFrame, group: list[str], limit: int) -> DataFrame:
    """The state after one round: tighter bounds for each rank with more than `limit` rows between them."""
    big = state.where((F.col("_in") > limit) & F.col("_answer").isNull())
    rest = state.where((F.col("_in") <= limit) | F.col("_answer").isNotNull())
    keys = [*group, "rank"]
    sketch = F.percentile_approx("_v", [i / GRID for i in range(GRID + 1)], ACCURACY)
    cuts = _between(values, big, group).groupBy(*keys, "_left", "_in", "_low", "_high").agg(sketch.alias("_cuts"))
    cell = F.floor(F.col("_left") / F.col("_in") * GRID).cast("int")
    a, b = F.get("_cuts", F.greatest(cell - 1, F.lit(0))), F.get("_cuts", F.least(cell + 2, F.lit(GRID)))
    tried = session.materialize(cuts.select(*keys, "_left", "_in", "_low", "_high", a.alias("_a"), b.alias("_b")), "quantile-cuts")
    met, v = _between(values, tried, group), F.col("_v")
    counts = met.groupBy(*keys).agg(
        F.count_if(v < F.col("_a")).alias("_below"), F.count_if(v == F.col("_a")).alias("_at_a"),
        F.count_if((v > F.col("_a")) & (v < F.col("_b"))).alias("_mid"), F.count_if((v == F.col("_b")) & (F.col("_b") > F.col("_a"))).alias("_at_b"),
    )
    both = _joined(tried, counts, keys)
    left, below, mid_from = F.col("_left"), F.col("_below"), F.col("_below") + F.col("_at_a")
    mid_to = mid_from + F.col("_mid")
    # below _a, at it, between, at _b, above it
    where = F.when(left < below, 0).when(left < mid_from, 1).when(left < mid_to, 2).when(left < mid_to + F.col("_at_b"), 3).otherwise(4)
    placed = both.withColumn("_w", where)
    w = F.col("_w")
    out = placed.select(
        *keys,
        F.when(w == 0, left).when(w == 4, left - mid_to - F.col("_at_b")).otherwise(left - mid_from).cast("long").alias("_left"),
        F.when(w == 0, below).when(w == 4, F.col("_in") - mid_to - F.col("_at_b")).otherwise(F.col("_mid")).cast("long").alias("_in"),
        F.when(w == 0, F.col("_low")).when(w == 4, F.col("_b")).otherwise(F.col("_a")).alias("_low"),
        F.when(w == 0, F.col("_a")).when(w == 4, F.col("_high")).otherwise(F.col("_b")).alias("_high"),
        F.when(w == 1, F.col("_a")).when(w == 3, F.col("_b")).alias("_answer"),
    )
    return rest.select(*out.columns).unionByName(out)


def exact(df: DataFrame, column: str, probs: Sequence[float], group: Sequence[str] = (), kind: str = "interpolated", limit: int = LIMIT) -> DataFrame:
    """Rows (group..., n, q): the number of values of each group and an array with the quantile for each of `probs`, at
    p * (n - 1) from 0: interpolated between its neighbours, or (kind lower) the one below. Null without a value.
    Without a group one row."""
    group = list(group)
    counted = df.groupBy(*group).agg(F.count(column).alias("n"))
    if (counted.agg(F.max("n")).first()[0] or 0) <= limit:
        return _at_once(df, column, probs, group, kind)
    sizes = session.materialize(counted, "quantile-sizes")
    needed = F.array_distinct(F.array(*_needed(probs, F.col("n"), kind)))
    found = at_ranks(df, column, sizes.where("n > 0").select(*group, F.explode(needed).alias("rank")), group, limit)
    table = found.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_at"))  # two for each of probs
    at = lambda rank: F.element_at("_at", rank.cast("long"))
    mixed = [_mixed(p, F.col("n"), at, kind) for p in probs]
    return _joined(sizes, table, group, "left").select(*group, "n", F.array(*mixed).alias("q"))


def _mixed(p: float, n: Column, at, kind: str) -> Column:
    """The quantile from the values at its ranks."""
    place = F.lit(float(p)) * (n - 1)
    low, high = F.floor(place), F.ceil(place)
    between = F.when(low == high, at(low)).otherwise((high - place) * at(low) + (place - low) * at(high))
    return F.when(n > 0, at(low) if kind == "lower" else between)


def _at_once(df: DataFrame, column: str, probs: Sequence[float], group: list[str], kind: str) -> DataFrame:
    """exact for groups of LIMIT rows at most: values are counted and summed up in order, once for all quantiles."""
    counts = df.groupBy(*group, F.col(column).cast("double").alias("_v")).agg(F.count(column).alias("_n"))
    whole = Window.partitionBy(*group)
    upto = F.sum("_n").over(whole.orderBy(F.col("_v").asc_nulls_last()))
    placed = counts.withColumn("_upto", upto).withColumn("_all", F.sum("_n").over(whole))
    n = F.col("_all")
    ranks = _needed(probs, n, kind)
    firsts = [F.min(F.when(F.col("_upto") > r, F.col("_v"))).alias(f"_r{i}") for i, r in enumerate(ranks)]
    found = placed.groupBy(*group).agg(F.coalesce(F.max("_all"), F.lit(0)).alias("n"), *firsts)
    out = []
    for i, p in enumerate(probs):
        if kind == "lower":
            out.append(F.col(f"_r{i}"))
            continue
        low, high = F.col(f"_r{2 * i}"), F.col(f"_r{2 * i + 1}")
        place = F.lit(float(p)) * (F.col("n") - 1)
        down, up = F.floor(place), F.ceil(place)
        out.append(F.when(down == up, low).otherwise((up - place) * low + (place - down) * high))
    return found.select(*group, "n", F.array(*[F.when(F.col("n") > 0, c) for c in out]).alias("q"))
