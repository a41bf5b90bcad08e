"""Session builder: one place for the settings every query relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def importable() -> None:
    """Let Python workers that start from now on import this package, wherever the driver was started."""
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build(app: str = "quartzgate", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the library's settings; on a cluster `master` comes from spark-submit."""
    importable()
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local(cpus: int | None = None, memory: str = "8g", **extra: str) -> SparkSession:
    """A local session for tests and benchmarks, with as many shuffle partitions as threads."""
    n = cpus or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    settings = {"spark.sql.shuffle.partitions": str(n), "spark.driver.memory": memory, **extra}
    return build(master=f"local[{n}]", **settings)


#: Spark's setting that lets it delete a query's shuffle files when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, as in local tests, a temporary one is set."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='quartzgate-')}")
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str = "step", by: str | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage is cut and any executor may be lost. With `by` each
    value of that column has a folder of its own, so that readers of some values read no other files.

    Spark deletes the shuffle files of the write when it is done."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").partitionBy(*([by] if by else [])).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._materialized_at = path
    return out


def release(*steps: DataFrame) -> None:
    """Delete the files of materialised steps that nothing reads any more."""
    for df in steps:
        path = getattr(df, "_materialized_at", None)
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
