"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A document's terms are its words in lower case, weighted by how often they occur. For sample j and term
k a hash of both gives r and c, distributed as Gamma(2, 1), and b, uniform on [0, 1). With weight S,
t = floor(ln S / r + b) and ln a = ln c - r (t - b + 1); the term with the least a is the sample. Two
documents agree on a sample with a probability equal to the generalised Jaccard similarity of their
weights. a depends on k and t alone, so the least a stands for the sample itself.

Gamma variates come from interpolated tables of quantiles, so each costs two look-ups instead of three
logarithms; in the lowest cell, which holds the least values, a series takes the table's place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SAMPLES = 32
#: Cells of the quantile tables; few, as plans hold them once for each sample.
CELLS = 256
#: Neighbouring doc_ids that are dealt to one task together.
RANGE = 64
#: Buckets of ranges in which the next range is sought; each is handled by itself.
BUCKETS = 256


def gamma_quantile(u: float) -> float:
    """The x with 1 - (1 + x) exp(-x) = u, by bisection."""
    low, high = 0.0, 60.0
    for _ in range(90):
        x = (low + high) / 2
        # -expm1(-x) - x exp(-x), exact for small x too
        if -math.expm1(-x) - x * math.exp(-x) < u:
            low = x
        else:
            high = x
    return (low + high) / 2


def _table(values) -> Column:
    """A constant array: the optimizer folds it into a literal."""
    return F.split(F.lit(",".join(f"{v:.6g}" for v in values)), ",").cast("array<double>")


def sample(term: Column, log_weight: Column, j: int, r_table: Column, c_table: Column) -> Column:
    """ln a of one term for sample j."""
    h = F.xxhash64(term, F.lit(j))
    take = lambda shift, bits: F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << bits) - 1))
    part = lambda shift, bits: (take(shift, bits).cast("double") + 0.5) * (1.0 / (1 << bits))

    def inside(table: Column, cell: Column, share: Column) -> Column:
        low = F.get(table, cell)
        return low + (F.get(table, cell + 1) - low) * share

    r = inside(r_table, take(0, 8).cast("int"), part(8, 8))
    cell, share = take(16, 8).cast("int"), part(24, 20)
    # c is s + s^2/3 + 11 s^3/72 + ... with s = sqrt(2 u), where u is small
    s = F.sqrt(share * (2.0 / CELLS))
    log_c = F.when(cell == 0, F.log(s * (1.0 + s * (1.0 / 3 + s * (11.0 / 72))))).otherwise(inside(c_table, cell, share))
    b = part(44, 20)
    t = F.floor(log_weight / r + b).cast("double")
    return log_c - r * (t - b + 1.0)


def tables() -> tuple[Column, Column]:
    """r and ln c at the edges of CELLS cells of equal probability; the outermost edges stand for the cell's mean."""
    edges = [gamma_quantile(min(max(i, 0.3), CELLS - 0.3) / CELLS) for i in range(CELLS + 1)]
    return _table(edges), _table(map(math.log, edges))


def signatures(texts: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """Rows (keys..., fp): fp is an array of `samples` 32-bit numbers; texts without words have no row.

    `texts` has the key columns and `text`. Where `texts` is partitioned by some of the keys, nothing moves.
    """
    r_table, c_table = tables()
    words = texts.select(*keys, F.explode(F.split(F.lower("text"), r"\s+")).alias("w")).where("w <> ''")
    terms = words.select(*keys, F.xxhash64("w").alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("n"))
    weighed = terms.select(*keys, "term", F.log(F.col("n").cast("double")).alias("s"))
    least = [F.min(sample(F.col("term"), F.col("s"), j, r_table, c_table)).alias(f"m{j}") for j in range(samples)]
    found = weighed.groupBy(*keys).agg(*least)
    return found.select(*keys, F.array(*[F.hash(f"m{j}") for j in range(samples)]).alias("fp"))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of samples that agree; of two fingerprints without words 1, of one 0."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return (
        F.when(a.isNull() & b.isNull(), F.lit(1.0))
        .when(a.isNull() | b.isNull(), F.lit(0.0))
        .otherwise(same.cast("double") / float(samples))
    )


def as_text(fp: Column, samples: int = SAMPLES) -> Column:
    """Eight hexadecimal digits for each sample; zeros without words."""
    each = F.transform(fp, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0"))
    return F.coalesce(F.array_join(each, ""), F.lit("0" * 8 * samples))


def next_ranges(ranges: DataFrame) -> DataFrame:
    """Rows (g, after): for each range the next lower one that holds a document; the highest after the lowest.

    Ranges are bucketed at quantiles of their number; in a bucket a window looks one row ahead, and the buckets'
    ends, BUCKETS rows at most, are matched in one more window.
    """
    shares = [i / BUCKETS for i in range(1, BUCKETS)]
    high, cuts = ranges.agg(F.max("g"), F.percentile_approx("g", shares, 10 * BUCKETS)).first()
    if high is None:
        return ranges.select("g", F.col("g").alias("after"))
    cuts = F.array(*[F.lit(c) for c in sorted(set(cuts))])
    held = ranges.withColumn("bucket", F.size(F.filter(cuts, lambda c: c <= F.col("g"))))
    inner = held.withColumn("after", F.lead("g").over(Window.partitionBy("bucket").orderBy(F.desc("g"))))
    ends = held.groupBy("bucket").agg(F.max("g").alias("top"), F.min("g").alias("g"))
    step = ends.withColumn("_after", F.lead("top").over(Window.orderBy(F.desc("bucket")))).select("g", "_after")
    return inner.join(step, "g", "left").select("g", F.coalesce("after", "_after", F.lit(high)).alias("after"))


def with_next(rows: DataFrame, column: str, borders: DataFrame) -> DataFrame:
    """`rows` (g, pos, ...) with `next`: `column` of the next row of the range, or of the first row of the range
    in `borders` (g, after) after it. Only the first row of each range moves."""
    w = Window.partitionBy("g").orderBy("pos")
    ahead = rows.withColumn("next", F.lead(column).over(w)).withColumn("_last", F.lead("pos").over(w).isNull())
    heads = rows.where("pos = 1").select(F.col("g").alias("after"), F.struct(F.col(column).alias("value")).alias("_head"))
    border = heads.join(borders, "after").select("g", "_head")
    joined = ahead.join(border, "g", "left")
    value = F.when(F.col("_last"), F.col("_head.value")).otherwise(F.col("next"))
    return joined.withColumn("next", value).drop("_last", "_head")


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document has the next lower doc_id; after the last comes the first, and a single document is
    its own next. Null text counts as empty. A null doc_id comes after all others; rows of one doc_id
    follow each other by text. Other columns are not read. Empty table: empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    g = F.coalesce(F.floor(F.col("doc_id") / RANGE), F.lit(-(1 << 60)))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("g", g)
    borders = common.materialize(next_ranges(plain.select("g").distinct()), "ranges")
    dealt = plain.repartition(4 * common.parts(spark), "g")
    order = Window.partitionBy("g").orderBy(F.desc_nulls_last("doc_id"), "text")
    placed = dealt.withColumn("pos", F.row_number().over(order))
    both = with_next(placed, "text", borders).withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substr("next", F.lit(1), cut))
    pair = both.select("g", "pos", "doc_id", "n_chars", "text", edited.alias("edited"))
    each = pair.select("g", "pos", F.posexplode(F.array("text", "edited")).alias("which", "text"))
    prints = signatures(each, ["g", "pos", "which"], samples)
    wide = prints.groupBy("g", "pos").agg(
        F.first(F.when(F.col("which") == 0, F.col("fp")), ignorenulls=True).alias("fp"),
        F.first(F.when(F.col("which") == 1, F.col("fp")), ignorenulls=True).alias("efp"),
    )
    base = pair.select("g", "pos", "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    rows = common.materialize(base.join(wide, ["g", "pos"], "left"), "fingerprints")
    out = with_next(rows, "fp", borders)
    return out.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("fp"), samples).alias("fingerprint"),
        as_text(F.col("efp"), samples).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp"), samples).alias("near_edited"),
        likeness(F.col("fp"), F.col("next"), samples).alias("near_next"),
    )
