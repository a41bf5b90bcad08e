"""Keyed logs, pinned files, write-once and verified sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log of one JSON object per line, with `_file` and `_at`, its place in the order of files and lines."""
    raw = spark.read.schema(schema).json(path)
    return raw.withColumn("_file", F.col("_metadata.file_path")).withColumn("_at", F.monotonically_increasing_id())


def last_write(log: DataFrame, key: str, order: str) -> DataFrame:
    """One row of each key: the last one written. Partial maxima leave the tasks, never whole groups."""
    columns = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_v")).select(key, "_v.*")


def first_write(log: DataFrame, key: str, order: str) -> DataFrame:
    """One row of each key: the first one written."""
    columns = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("_v")).select(key, "_v.*")


def removed_by_compaction(log: DataFrame, key: str) -> DataFrame:
    """One row: kept and removed rows if only one row of each key stays."""
    return log.agg(F.countDistinct(key).alias("kept"), (F.count("*") - F.countDistinct(key)).alias("removed"))


def verified(spark: SparkSession, path: str, sha256: str) -> bytes:
    """The content of one small pinned file; an error where its digest is another."""
    row = spark.read.format("binaryFile").load(path).select("content", F.sha2("content", 256).alias("sha")).first()
    if row is None or row["sha"] != sha256:
        raise ValueError(f"{path} differs from its pin")
    return bytes(row["content"])


def digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows (path, bytes, sha256) of files."""
    files = spark.read.format("binaryFile").load(paths)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def freeze(df: DataFrame, path: str, force: bool = False) -> None:
    """Write once: an existing artifact is an error unless forced."""
    df.write.mode("overwrite" if force else "errorifexists").parquet(path)


def freeze_or_verify(df: DataFrame, path: str, key: list[str]) -> DataFrame:
    """The frozen rows at `path`: written now where there are none, else checked to have the same keys as `df`."""
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        df.write.parquet(path)
        return spark.read.parquet(path)
    frozen = spark.read.parquet(path)
    a, b = frozen.select(*key), df.select(*key)
    if not (a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()):
        raise ValueError(f"{path} is frozen and this build differs from it")
    return frozen


def write_verified(df: DataFrame, path: str, forbidden: DataFrame, key: str) -> DataFrame:
    """Write, read back, and take the artifact away again where it holds a forbidden key."""
    spark = df.sparkSession
    df.write.mode("errorifexists").parquet(path)
    back = spark.read.parquet(path)
    leaked = back.join(forbidden.select(key).distinct(), key, "left_semi").count()
    if leaked:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        raise ValueError(f"{leaked} rows of {path} must not be in it")
    return back


def unfinished(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The rows that a resumed run still has to do."""
    return todo.join(done.select(key), key, "left_anti")


def one_to_one(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join in which no key may occur twice on either side."""
    for side in (left, right):
        if not side.groupBy(*on).count().where("count > 1").isEmpty():
            raise ValueError(f"{on} is not unique")
    return left.join(right, on, how)


def complete(joined: DataFrame, column: str) -> DataFrame:
    """The rows, unless one lacks `column`."""
    missing = joined.where(F.col(column).isNull()).count()
    if missing:
        raise ValueError(f"{missing} rows have no {column}")
    return joined


def numbered(df: DataFrame, prefix: str, order: list[str], group: str) -> DataFrame:
    """`df` with `pair_id`: prefix, the group's initial and a four-digit number within the group."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1
    return df.withColumn("pair_id", F.format_string("%s-%s%04d", F.lit(prefix), F.substring(F.col(group), 1, 1), n))
