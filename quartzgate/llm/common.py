"""What the corpus operators share: materialised steps, text batches and connected components."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, release, shared_folder  # noqa: F401

#: Characters of text that a Python worker handles at once.
BATCH_CHARS = 1_000_000
#: The white space that the contracts name: space and \x09 to \x0D.
BLANKS = b" \t\n\v\f\r"


def parts(spark: SparkSession) -> int:
    """Partitions for an explicit repartition."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def id_and_text(docs: DataFrame) -> DataFrame:
    """(doc_id, no_id, text): pandas would turn a nullable id into a float, so a null one becomes 0 with a mark."""
    key = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(key, F.lit(0)).alias("doc_id"), key.isNull().alias("no_id"), "text")


def ids(pdf: pd.DataFrame) -> pd.Series:
    """The ids of a batch of id_and_text, null where they were."""
    return pdf["doc_id"].astype("Int64").mask(pdf["no_id"].astype(bool)).reset_index(drop=True)


def small_batches(batches: Iterator[pd.DataFrame], column: str = "text", most: int = BATCH_CHARS) -> Iterator[pd.DataFrame]:
    """Cut batches so that each holds at most `most` characters of `column`, or a single row."""
    for pdf in batches:
        if not len(pdf):
            continue
        total, start = 0, 0
        for i, text in enumerate(pdf[column]):
            size = 0 if text is None else len(text)
            if total and total + size > most:
                yield pdf.iloc[start:i]
                total, start = 0, i
            total += size
        yield pdf.iloc[start:]
    trim()


def text_slices(batches, most: int = BATCH_CHARS) -> Iterator:
    """Cut Arrow batches so that each slice holds at most `most` characters of the column text, or a single row."""
    import pyarrow.compute as pc

    for batch in batches:
        if not len(batch):
            continue
        total, start = 0, 0
        for i, size in enumerate(pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_pylist()):
            if i > start and total + size > most:
                yield batch.slice(start, i - start)
                total, start = 0, i
            total += size
        yield batch.slice(start)
    trim()


def trim() -> None:
    """Give free memory of a Python worker back: it stays around for the next task beside Spark's own heap."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def map_rows(docs: DataFrame, make, new: dict, gone: tuple[str, ...] = ()) -> DataFrame:
    """`docs` with columns made from batches of its rows: make(batch) gives a list for each name in `new`, whose
    values are types. Columns of those names are replaced, those in `gone` dropped, and all others pass
    through as they are, whatever their type. A batch holds BATCH_CHARS characters or a single row.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = [f for f in docs.schema.fields if f.name not in gone and f.name not in new]
    out = StructType(fields)
    for name, kind in new.items():
        out = out.add(name, kind)
    order = [f.name for f in docs.schema.fields if f.name not in gone] + [n for n in new if n not in docs.columns]
    types = {f.name: f.type for f in to_arrow_schema(out)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            made = make(part)
            columns = [pa.array(made[n], types[n]) if n in new else part.column(n) for n in order]
            yield pa.RecordBatch.from_arrays(columns, names=order)

    schema = StructType([next(f for f in out.fields if f.name == n) for n in order])
    return docs.mapInArrow(run, schema)


def with_lists(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """`docs` with the columns of lists (__id, __gone), null where there is none. Rows without a doc_id, which may be
    many, stay out of the shuffle."""
    found = docs.where("doc_id is not null").join(lists, F.col("doc_id") == F.col("__id"), "left")
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in lists.schema.fields]
    return found.unionByName(docs.where("doc_id is null").select(*[f"`{c}`" for c in docs.columns], *none))


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Rows (node, component) for every node of `edges` (a, b); component is the smallest node reachable.

    Alternates the large-star and small-star steps: every step is two shuffles keyed by a node, hot
    nodes are reduced on the map side, and nothing is gathered in one place. Loops, repeated edges
    and both directions are allowed; nulls are dropped. An empty input gives an empty result.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = both.join(least, "u")
        if large:
            out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
                least.select(F.col("u").alias("a"), F.col("m").alias("b"))
            )
        return out.where("a <> b").distinct()

    def ordered(e: DataFrame) -> DataFrame:
        return e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))

    def digest(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    nodes = edges.where("a is not null and b is not null").select("a", "b")
    current = materialize(ordered(nodes.where("a <> b")).distinct(), name)
    seen = digest(current)
    while seen[0]:
        after = materialize(star(ordered(star(current, True)), False), name)
        now = digest(after)
        release(current)
        current = after
        if now == seen:
            break
        seen = now
    loops = nodes.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component"))
    found = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.unionByName(roots).unionByName(loops).groupBy("node").agg(F.min("component").alias("component"))
