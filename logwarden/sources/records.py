"""Tables that steps exchange: labelled records, embeddings, reports."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.sources.hidden import opened

RECORD_SCHEMA = "path string, line_no bigint, log string, y string, dataset string, category string"
EMBEDDING_SCHEMA = "id string, features array<double>, y string, split string"


def write_records(records: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet by dataset and category. The rebalance hint lets AQE split a
    dataset that holds most rows over many writers and merge small ones."""
    (
        records.select("path", "line_no", "log", "y", "dataset", "category")
        .hint("rebalance", "dataset", "category")
        .write.mode(mode)
        .option("compression", "zstd")
        .partitionBy("dataset", "category")
        .parquet(path)
    )


def read_records(spark: SparkSession, path: str, skip_bad_files: bool = True) -> DataFrame:
    """All labelled records; a damaged file is skipped, an empty folder is an error.

    :func:`damaged_files` says which files are skipped, and why.
    """
    return (
        spark.read.schema(RECORD_SCHEMA)
        .option("ignoreCorruptFiles", str(skip_bad_files).lower())
        .parquet(path)
    )


def damaged_files(spark: SparkSession, path: str) -> DataFrame:
    """``(file, reason)`` of the Parquet files below ``path`` that readers would skip.

    A task looks at a file's last bytes only: Parquet's mark at both ends and a footer
    that lies inside the file and can be parsed.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
        .load(path).select(F.col("path").alias("file"), "length")
    )

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad = []
            for uri in batch.column("file").to_pylist():
                try:
                    with opened(uri) as source:
                        pq.ParquetFile(source).metadata  # noqa: B018
                except (pa.ArrowException, OSError) as error:
                    bad.append((uri, str(error).split("\n")[0]))
            columns = list(zip(*bad, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["file", "reason"])

    return files.select("file").mapInArrow(check, "file string, reason string")


def write_embeddings(vectors: DataFrame, path: str) -> None:
    vectors.select("id", "features", "y", "split").write.mode("overwrite").partitionBy(
        "split"
    ).parquet(path)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EMBEDDING_SCHEMA).parquet(path)


def training_rows(augmented: DataFrame, use_augmented: bool) -> DataFrame:
    """Rows of an augmented table with (``origin`` real or synthetic) or without
    the synthetic ones; the filter reaches the scan."""
    return augmented if use_augmented else augmented.where(F.col("origin") == "real")


def parse_token_list(text: Column | str) -> Column:
    """``['a', "b"]`` or JSON list text to an array; never evaluated as code."""
    text = F.col(text) if isinstance(text, str) else text
    strict = F.from_json(text, "array<string>")
    # Fixed pattern: a quoted item in either quote style, with escapes
    quoted = F.regexp_extract_all(text, F.lit(r"""'((?:[^'\\]|\\.)*)'|"((?:[^"\\]|\\.)*)\""""), F.lit(0))
    items = F.transform(
        quoted, lambda q: F.regexp_replace(F.substring(q, F.lit(2), F.length(q) - 2), r"\\(.)", "$1")
    )
    is_list = F.trim(text).rlike(r"(?s)^\[.*\]$")
    return F.coalesce(strict, F.when(is_list, items))


def read_token_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """CSV with a header whose ``tokens`` column holds a list as text.

    Cells with line breaks need ``multi_line``, which makes each file one task.
    """
    table = (
        spark.read.option("header", "true")
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", str(multi_line).lower())
        .csv(path)
    )
    if "tokens" not in table.columns:
        return table
    return table.withColumn("tokens", parse_token_list("tokens"))


def write_report(table: DataFrame, path: str) -> None:
    """A metric table as CSV with a header. Metric tables have one row per class
    or cell, so they are written as one file."""
    table.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def report_lines(title: str, metrics: DataFrame) -> DataFrame:
    """A text report: a title row, then one aligned line per metric row."""
    spark = metrics.sparkSession
    cells = [F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("")), 24, " ") for c in metrics.columns]
    head = spark.createDataFrame(
        [(0, title), (1, "".join(c.ljust(24) for c in metrics.columns))], "ord int, value string"
    )
    body = metrics.select(F.lit(2).alias("ord"), F.concat(*cells).alias("value"))
    return head.unionByName(body)


def write_text_report(title: str, metrics: DataFrame, path: str) -> None:
    report_lines(title, metrics).coalesce(1).sortWithinPartitions("ord", "value").select(
        "value"
    ).write.mode("overwrite").text(path)
