"""The batch functions applied to logs that are still arriving."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.functions.text import not_blank, simple_tokens


def arriving_lines(spark: SparkSession, root: str) -> DataFrame:
    """``(path, log, tokens)`` of text files as they appear below ``root``."""
    return (
        spark.readStream.option("recursiveFileLookup", "true")
        .text(root)
        .select(
            F.col("_metadata.file_path").alias("path"), F.make_valid_utf8("value").alias("log")
        )
        .where(not_blank(F.col("log")))
        .withColumn("tokens", simple_tokens("log"))
    )


def score_stream(lines: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Writes ``score(batch)`` to Parquet for every micro-batch.

    Batches are kept under their number, so a batch that is repeated after a
    failure replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (
        lines.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def alerts_per_window(events: DataFrame, time: str, label: str, width: str = "1 hour", lateness: str = "10 minutes", normal: tuple[str, ...] = ()) -> DataFrame:
    """``(window_start, label, alerts)`` per tumbling window, for streams and
    batches alike; the watermark lets a stream drop closed windows."""
    kept = events.where(~F.col(label).isin(*normal)) if normal else events
    return (
        kept.withWatermark(time, lateness)
        .groupBy(F.window(time, width).alias("w"), F.col(label).alias("label"))
        .agg(F.count("*").alias("alerts"))
        .select(F.col("w.start").alias("window_start"), "label", "alerts")
    )
