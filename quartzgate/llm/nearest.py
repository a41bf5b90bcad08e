"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order. Each shard of the index keeps an inverted
file: for every pivot, the vectors that count it among their nearest and at which place. A query
walks the lists of its own nearest pivots, which gives the footrule distance between its order and
that of every vector in the shard (a pivot that is missing stands at the first place after the
list), takes the nearest share, and reranks it by exact inner products in double precision.

Queries and index rows meet in blocks: a shard of at most SHARD_ROWS vectors with a group of at most
QUERY_ROWS queries, so the memory of a task is bounded whatever the table's size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows from which pivots are drawn: all rows are indexed.
PIVOTS = 256
#: Pivots in a representation.
PREFIX = 64
#: Share of a shard that is reranked, and the least number of vectors.
SHARE, LEAST = 0.2, 1024
SHARD_ROWS, QUERY_ROWS = 8192, 2048
K = 20


def clean(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Rows (vec_id, v) that take part: no null id, and a vector that is neither null, empty nor zero
    and holds only finite components. Of repeated ids with different vectors all rows take part."""
    v = F.col(vector_column).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v"))
        .where("vec_id is not null and v is not null and size(v) > 0")
        .where(~bad)
        .where(F.exists("v", lambda x: x != 0.0))
    )


def draw_pivots(rows: DataFrame, pivots: int = PIVOTS) -> np.ndarray:
    """`pivots` different vectors, those with the smallest hashes of their values. Each pass takes the 2 * pivots smallest
    hashes that are left, so no pass shuffles the table; only repeated vectors ask for another one."""
    hashed = rows.select(F.xxhash64("v").alias("h"), "v")
    found: dict[tuple, None] = {}
    while len(found) < pivots:
        batch = hashed.orderBy("h").limit(2 * pivots).collect()
        found.update((tuple(r["v"]), None) for r in batch)
        if len(batch) < 2 * pivots:
            break
        hashed = hashed.where(F.col("h") > batch[-1]["h"])
    return np.array(list(found)[:pivots], float)


def scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products, each summed in the same order, so that equal vectors score alike."""
    return np.add.reduce(x * q, axis=1)


def _lifted(x: np.ndarray, top: float) -> np.ndarray:
    """Vectors with one more component, all of length `top`: the largest inner product is then nearest."""
    return np.column_stack([x, np.sqrt(np.maximum(top * top - np.einsum("ij,ij->i", x, x), 0))])


def order(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest `prefix` pivots of each row in order; ties to the earlier pivot."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :prefix]


def search_block(ids, x, q_ids, q, pivots, top, prefix=PREFIX, share=SHARE, least=LEAST, k=K):
    """(query_id, vec_id, score) of the k best candidates of one shard for each query of one group."""
    prefix = min(prefix, len(pivots))
    lifted = _lifted(pivots, top)
    mine = order(_lifted(x, top), lifted, prefix)
    theirs = order(np.column_stack([q, np.zeros(len(q))]), lifted, prefix)
    n = len(ids)
    # the inverted file: for each pivot the rows that hold it, with its place
    by = np.argsort(mine.ravel(), kind="stable")
    rows, place = by // prefix, by % prefix
    ends = np.searchsorted(mine.ravel()[by], np.arange(len(pivots) + 1))
    # a pivot that a row lacks costs |place in query - prefix|; one that it holds costs the difference,
    # and holding it also saves what the query would pay for lacking it
    base = float(prefix * (prefix + 1))
    take = min(n, max(least, k, int(np.ceil(share * n))))
    out_q, out_v, out_s = [], [], []
    for i in range(len(q)):
        lists = [slice(ends[p], ends[p + 1]) for p in theirs[i]]
        at = np.concatenate([rows[s] for s in lists])
        there = np.concatenate([place[s] for s in lists])
        here = np.repeat(np.arange(prefix), [s.stop - s.start for s in lists])
        saved = np.bincount(at, weights=np.abs(there - here) - (prefix - there) - (prefix - here), minlength=n)
        footrule = base + saved
        if take < n:
            cut = np.partition(footrule, take - 1)[take - 1]
            near = np.flatnonzero(footrule < cut)
            tied = np.flatnonzero(footrule == cut)
            near = np.concatenate([near, tied[np.argsort(ids[tied], kind="stable")[: take - len(near)]]])
        else:
            near = np.arange(n)
        near = near[ids[near] != q_ids[i]]
        rough = x[near] @ q[i]
        if len(near) > k:
            least_kept = np.partition(rough, len(near) - k)[len(near) - k] - 1e-9 * top * np.sqrt(q[i] @ q[i])
            near = near[rough >= least_kept]
        score = scores(x[near], q[i])
        best = np.lexsort((ids[near], -score))[:k]
        out_q.append(np.full(len(best), q_ids[i]))
        out_v.append(ids[near][best])
        out_s.append(score[best])
    return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)


def search(rows: DataFrame, queries: DataFrame, k: int = K, prefix: int = PREFIX, share: float = SHARE) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): each query's k nearest rows but itself, nearest first.

    `rows` and `queries` are as from clean(). Ties go to the smaller vec_id; fewer candidates than k
    give fewer rows; of several dimensions the commonest (then the largest) counts and other vectors take no
    part; rows that repeat an id are candidates each, and queries each; empty tables give an empty result.
    """
    spark = rows.sparkSession
    schema = "query_id long, vec_id long, score double"
    dims = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows, queries = (x.where(F.size("v") == dims[0]["dim"]) for x in (rows, queries))
    pivots = draw_pivots(rows)
    norm = F.aggregate("v", F.lit(0.0), lambda a, b: a + b * b)
    n, longest = rows.agg(F.count("*"), F.sqrt(F.max(norm))).first()
    shards = max(1, -(-n // SHARD_ROWS))
    groups = max(1, -(-queries.count() // QUERY_ROWS))
    sent = spark.sparkContext.broadcast((pivots, longest))  # PIVOTS vectors

    def block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": int, "vec_id": int})
        left = left.sort_values("vec_id", kind="stable")
        p, top = sent.value
        found = search_block(
            left["vec_id"].to_numpy(np.int64), np.stack(left["v"].to_numpy()), right["vec_id"].to_numpy(np.int64),
            np.stack(right["v"].to_numpy()), p, top, prefix, share, LEAST, k,
        )
        return pd.DataFrame(dict(zip(["query_id", "vec_id", "score"], found)))

    # the hash covers the vector too, so rows of one id or one vector spread over the shards
    shard = F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards))
    group = F.pmod(F.xxhash64("v", "vec_id"), F.lit(groups))
    index = rows.withColumn("shard", shard).withColumn(
        "group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))
    )
    asked = queries.withColumn("group", group).withColumn(
        "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))
    )
    near = (
        index.groupBy("shard", "group")
        .cogroup(asked.groupBy("shard", "group"))
        .applyInPandas(block, schema)
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        near.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
