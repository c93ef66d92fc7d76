"""Raw logs and label files to labelled records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.session import stored
from logwarden.sources.logs import (
    join_labels,
    label_lines,
    list_files,
    log_lines,
    match_label_files,
    text_files,
)
from logwarden.sources.records import write_records


def labelled_records(spark: SparkSession, logs_dir: str, labels_dir: str, numbering: str = "raw") -> DataFrame:
    """``(path, line_no, log, y, dataset, category)`` of all text files.

    File lists are matched first and reach the lines together with the split
    offsets; lines then meet label rows on (label file, line), a key that spreads
    even one huge file.
    """
    logs = text_files(list_files(spark, logs_dir), logs_dir)
    labels = stored(text_files(list_files(spark, labels_dir), labels_dir), "labelfiles")
    matched = match_label_files(logs, labels)
    files = logs.join(matched, logs["rel"] == matched["log_rel"]).select("path", "rel", "label_rel")
    lines = log_lines(spark, logs_dir, numbering, files)
    label_files = labels.select("path", F.col("rel").alias("label_rel"))
    rows = label_lines(spark, labels_dir).join(label_files, "path").drop("path")
    parts = F.split("rel", "/")
    depth = F.size(parts)
    return join_labels(lines, rows, ["label_rel", "line_no"]).select(
        F.col("rel").alias("path"),
        "line_no",
        "log",
        "y",
        F.when(depth > 1, parts[0]).otherwise("").alias("dataset"),
        F.when(depth > 2, F.array_join(F.slice(parts, 2, F.greatest(depth - 2, F.lit(0))), "_"))
        .otherwise("")
        .alias("category"),
    )


def preprocess(spark: SparkSession, logs_dir: str, labels_dir: str, out: str, numbering: str = "raw") -> None:
    write_records(labelled_records(spark, logs_dir, labels_dir, numbering), out)
