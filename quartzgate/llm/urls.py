"""URL filters: rules first, then a ratio of two character language models.

URLs that a rule decides are the labels. Character n-grams up to ORDER are counted for accepted and
rejected URLs in a table with a row for each context and each (context, character), by 64-bit hashes, that
grows with the input; each model backs off through the orders, longer contexts weighted by how often
they were seen. The score is the difference of both log-likelihoods per character. The threshold is the
one that separates a fifth of the labels best, chosen by hash, by the counts of the other four fifths;
URLs without a rule are then scored by the counts of all labels.

Counts are joined to blocks of URLs, so what a task holds is bounded and nothing is sent to all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, shingles

ORDER = 5
#: URLs of a block, whose counts one task holds at once: about so many, dealt by hash.
BLOCK = 1000
#: Weight of the shorter context's estimate, in characters seen.
BACKOFF = 4.0
#: Bins of the calibration histogram, over scores from -SPAN to SPAN.
BINS, SPAN = 800, 4.0

#: The rules: verdict, host, path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null url and for one without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matched(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does. A rule fits its host and all
    subdomains where the path starts with the rule's; of equally long rules the first given wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in reversed(sorted(rules, key=lambda r: -len(r[1] + r[2]))):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _codes(urls) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all URLs end to end, each URL after ORDER filler characters, and to which URL each belongs."""
    raw = [np.frombuffer(("\0" * ORDER + (u or "")).encode("utf-32-le", "surrogatepass"), "<u4") for u in urls]
    sizes = [len(r) for r in raw]
    return np.concatenate(raw).astype(np.uint64), np.repeat(np.arange(len(raw)), sizes)


def _keys(codes: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each character the hashes of (context, character) and of the context of `order` characters."""
    h = np.full(len(codes), np.uint64(order + 1))
    for k in range(order, 0, -1):
        h = shingles.mix(h * shingles.GOLDEN + np.roll(codes, k))
    return shingles.mix(shingles.mix(h, 1) + codes).view(np.int64), shingles.mix(h, 2).view(np.int64)


def count_keys(urls, times, good, held) -> pd.DataFrame:
    """Rows (key, bad, good, all_bad, all_good): counts of one batch; the first two leave held-out URLs out."""
    codes, owner = _codes(urls)
    real = codes != 0
    keys = np.concatenate([k[real] for order in range(ORDER + 1) for k in _keys(codes, order)])
    each = np.tile(owner[real], 2 * (ORDER + 1))
    found, at = np.unique(keys, return_inverse=True)
    times, good, held = (np.asarray(x)[each] for x in (times, good, held))
    out = {"key": found}
    for name, which in (("bad", ~good & ~held), ("good", good & ~held), ("all_bad", ~good), ("all_good", good)):
        out[name] = np.bincount(at, weights=times * which, minlength=len(found)).astype(np.int64)
    return pd.DataFrame(out)


def score_urls(urls, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per URL the mean over its characters of ln P(accepted) - ln P(rejected); 0 for an empty one. keys: sorted,
    counts: for each one those of rejected and of accepted URLs."""
    codes, owner = _codes(urls)
    real = codes != 0
    keys, counts = np.append(keys, np.int64(0)), np.append(counts, np.zeros((1, 2)), 0)
    p = np.full((len(codes), 2), 1 / 256)

    def seen(wanted: np.ndarray) -> np.ndarray:
        at = np.searchsorted(keys[:-1], wanted)
        return np.where((keys[at] == wanted)[:, None], counts[at], 0)

    for order in range(ORDER + 1):
        pair, context = _keys(codes, order)
        p = (seen(pair) + BACKOFF * p) / (seen(context) + BACKOFF)
    gain = np.where(real, np.log(p[:, 1]) - np.log(p[:, 0]), 0)
    n = np.bincount(owner[real], minlength=len(urls))
    return np.bincount(owner, weights=gain, minlength=len(urls)) / np.maximum(n, 1)


def fit(judged: DataFrame) -> DataFrame:
    """The counts of both models, rows (key, bad, good, all_bad, all_good), from rows (url, verdict): the first two
    of those that the hash keeps for training, the others of all."""

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in common.small_batches(batches, "url"):
            yield count_keys(pdf["url"].tolist(), pdf["n"].to_numpy(), (pdf["verdict"] == "allow").to_numpy(), pdf["held"].to_numpy(bool))

    each = judged.groupBy("url", "verdict").agg(F.count("*").alias("n")).withColumn("held", held_out())
    found = each.mapInPandas(local, "key long, bad long, good long, all_bad long, all_good long")
    sums = [F.sum(c).alias(c) for c in ("bad", "good", "all_bad", "all_good")]
    return common.materialize(found.groupBy("key").agg(*sums), "url-counts")


def scores(urls: DataFrame, counts: DataFrame, bad: str, good: str) -> DataFrame:
    """Rows (url, score) of the distinct texts in `urls` (url) by two columns of `counts`."""
    each = common.materialize(urls.where("url is not null").select("url").distinct(), "urls")
    blocks = max(1, -(-each.count() // BLOCK))
    dealt = each.withColumn("block", F.pmod(F.xxhash64("url", F.lit(7)), F.lit(blocks)))

    def needed(key, pdf: pd.DataFrame) -> pd.DataFrame:
        codes, _ = _codes(pdf["url"].tolist())
        real = codes != 0
        keys = np.unique(np.concatenate([k[real] for order in range(ORDER + 1) for k in _keys(codes, order)]))
        return pd.DataFrame({"block": np.full(len(keys), key[0]), "key": keys})

    def score(key, pdf: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({"url": [], "score": []})
        own = own.sort_values("key")
        urls = pdf["url"].tolist()
        return pd.DataFrame({"url": urls, "score": score_urls(urls, own["key"].to_numpy(np.int64), own[["bad", "good"]].to_numpy(float))})

    wanted = dealt.groupBy("block").applyInPandas(needed, "block long, key long")
    own = wanted.join(counts.select("key", F.col(bad).alias("bad"), F.col(good).alias("good")), "key")
    return dealt.groupBy("block").cogroup(own.groupBy("block")).applyInPandas(score, "url string, score double")


def held_out() -> Column:
    """The fifth of the labelled URLs on which the threshold is chosen."""
    return F.pmod(F.xxhash64("url"), F.lit(5)) == 0


def calibrate(judged: DataFrame, counts: DataFrame) -> float:
    """The score from which on URLs are accepted: the edge of a histogram bin that makes the mean of both
    labels' error rates least, the one nearest to 0 of several; 0 where a label is missing."""
    held = judged.where(held_out()).groupBy("url", "verdict").agg(F.count("*").alias("n"))
    s = F.greatest(F.lit(-SPAN), F.least(F.col("score"), F.lit(SPAN - 1e-9)))
    rows = held.join(scores(held, counts, "bad", "good"), "url").select(
        F.floor((s + SPAN) / (2 * SPAN) * BINS).cast("int").alias("bin"), (F.col("verdict") == "allow").alias("good"), "n"
    )
    found = np.zeros((2, BINS))
    for b, good, n in rows.groupBy("bin", "good").agg(F.sum("n")).collect():  # 2 * BINS rows at most
        found[int(good), b] = n
    if not found.sum(1).all():
        return 0.0
    below = np.concatenate([np.zeros((2, 1)), found.cumsum(1)], 1) / found.sum(1, keepdims=True)
    wrong = below[1] + 1 - below[0]
    edges = np.linspace(-SPAN, SPAN, BINS + 1)
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    return float(edges[best[np.argmin(np.abs(edges[best]))]])


def judge(pages: DataFrame, rules=RULES, id_column: str = "page_id") -> DataFrame:
    """Per row: the id, host, path, rule, verdict, score (null where a rule decides).

    The verdict is the longest fitting rule's, else allow where the score reaches the threshold, else
    block. A null url has empty host and path and scores 0. Null ids stay; repeated rows give repeated
    results; other columns are not read. Without any labelled URL all scores are 0 and all are allowed.
    Empty table: empty result.
    """
    host, path = host_and_path(F.col("url"))
    cut = pages.select(F.col(id_column).cast("long").alias(id_column), "url", host.alias("host"), path.alias("path"))
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    ruled = cut.withColumn("rule", rule).withColumn("verdict", verdict)
    judged = ruled.where("verdict is not null and url is not null")
    counts = fit(judged)
    threshold = calibrate(judged, counts)
    free = ruled.where("rule is null")
    scored = free.drop("rule", "verdict").join(scores(free, counts, "all_bad", "all_good"), "url", "left").select(
        *cut.columns, F.lit(None).cast("string").alias("rule"), F.coalesce("score", F.lit(0.0)).alias("score")
    )
    decided = scored.withColumn("verdict", F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    by_rule = ruled.where("rule is not null").withColumn("score", F.lit(None).cast("double"))
    return by_rule.unionByName(decided).select(id_column, "host", "path", "rule", "verdict", "score")
