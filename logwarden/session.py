"""Session defaults and the shared folder used for intermediate tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int = 8, app: str = "logwarden") -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own; a cluster that
    names none is an error, because executors do not share a local disk.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = f"/tmp/logwarden-{sc.applicationId}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/logwarden/{name}-{uuid.uuid4().hex}"


def small_table(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """``df`` stored once, with a broadcast hint if it has been counted to be small."""
    kept = stored(df, "small")
    return F.broadcast(kept) if kept.count() <= most_rows else kept


def stored(df: DataFrame, name: str, file_rows: int = 0) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the stored copy.

    ``file_rows`` bounds the rows of a file where a row takes megabytes: Parquet's
    reader decodes thousands of rows of a file at once.

    Used where a result is read many times (iterations, several models). The
    copy outlives lost executors and gives the next plan a short lineage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._stored_at = path
    return kept


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more.

    For states of an iteration: once the next one is written, no plan goes back to the
    one before, also after an executor is lost. Other tables are left alone.
    """
    for table in tables:
        place = getattr(table, "_stored_at", None)
        if place:
            remove(table.sparkSession, place)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished steps.

    They go when the driver's JVM collects its garbage, which a long loop over few
    objects may not do until the disks are full.
    """
    spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, place: str) -> None:
    """Deletes a folder of our own below the shared one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
