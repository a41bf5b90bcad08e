"""Documents at the edges: JSON run records, gzip archives, CSV and JSON sinks, resumable and versioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Whole-file JSON documents, plain or gzip, a row each, with the file they came from."""
    reader = spark.read.option("multiLine", True)
    df = (reader.schema(schema) if schema else reader).json(path)
    return df.withColumn("file", F.col("_metadata.file_path"))


def flattened(df: DataFrame, name: str = "key") -> DataFrame:
    """Rows (key, value): every leaf of each row's nested structs under its dotted name, as text; null leaves as null."""

    def leaves(kind: StructType, at: str) -> list[str]:
        out = []
        for f in kind.fields:
            path = f"{at}.{f.name}" if at else f.name
            out += leaves(f.dataType, path) if isinstance(f.dataType, StructType) else [path]
        return out

    each = [F.struct(F.lit(p).alias(name), F.col(p).cast("string").alias("value")) for p in leaves(df.schema, "")]
    return df.select(F.explode(F.array(*each)).alias("e")).select("e.*")


def run_record(df: DataFrame) -> DataFrame:
    """Rows (task, split, metric, value) of a run record with a struct per_split.<task>.<split>.<metric>."""
    rows = []
    for task in df.schema["per_split"].dataType.fields:
        for split in task.dataType.fields:
            for metric in split.dataType.fields:
                if isinstance(metric.dataType, DoubleType | LongType):
                    value = F.col(f"per_split.{task.name}.{split.name}.{metric.name}").cast("double")
                    rows.append(F.struct(F.lit(task.name).alias("task"), F.lit(split.name).alias("split"), F.lit(metric.name).alias("metric"), value.alias("value")))
    return df.select(F.explode(F.array(*rows)).alias("e")).select("e.*").where("value is not null")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def append_log(df: DataFrame, path: str) -> None:
    """One JSON object per line, appended; each batch is a file of its own, so writers don't meet."""
    df.write.mode("append").json(path)


def publish(df: DataFrame, path: str, version: int) -> None:
    """A version of a table beside the earlier ones; a version is written once."""
    df.write.mode("errorifexists").parquet(f"{path}/version={version}")


def as_of(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A published version, the largest by default; the scan reads that version's files only."""
    versions = spark.read.parquet(path)
    if version is None:
        version = versions.agg(F.max("version")).first()[0]
    return versions.where(F.col("version") == version).drop("version")
