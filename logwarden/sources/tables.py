"""The given tables read in the roles of logs, labels, vectors and outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.functions.text import not_blank


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Over all cores when the scan has fewer partitions than cores, as a small
    table in one row group has; a large table is left as it was read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def text_lines(texts: DataFrame, file_id: str, text: str) -> DataFrame:
    """``(file_id, line_no, log)``: numbered lines of text cells, blanks dropped
    after numbering."""
    return (
        texts.select(file_id, F.posexplode(F.split(text, "\n")).alias("pos", "log"))
        .select(file_id, (F.col("pos") + 1).cast("bigint").alias("line_no"), "log")
        .where(not_blank(F.col("log")))
    )


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is a log file, each line of its text a log line."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return text_lines(spread(documents, "doc_id"), "doc_id", "text")


def line_id() -> "F.Column":
    return F.concat_ws(":", "doc_id", "line_no")


def label_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, labels)``: the label list of a labelled document."""
    labels = table(spark, sf_dir, "labels")
    return labels.select(
        "doc_id",
        F.array_compact(
            F.array(
                F.when(F.col("toxic") == 1, F.lit("toxic")),
                F.when(F.col("quality") == 0, F.lit("low_quality")),
            )
        ).alias("labels"),
    )


def label_text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label files as JSON text rows ``(path, pos, value)``.

    Every labelled document names its first line twice, first without labels and
    at the end with its labels, so the later row has to win; the document's own
    lines stand between the two as malformed rows.
    """
    arrays = label_arrays(spark, sf_dir)
    row = lambda labels: F.to_json(F.struct(F.lit(1).alias("line"), labels.alias("labels")))
    empty = F.array().cast("array<string>")
    path = F.col("doc_id").cast("string").alias("path")
    first = arrays.select(path, F.lit(0).cast("bigint").alias("pos"), row(empty).alias("value"))
    last = arrays.select(
        path, F.lit(10**9).cast("bigint").alias("pos"), row(F.col("labels")).alias("value")
    )
    noise = document_lines(spark, sf_dir).select(
        path, F.col("line_no").alias("pos"), F.col("log").alias("value")
    )
    return first.unionByName(noise).unionByName(last)


def labelled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, line_no, log, y)``: lines with the JSON text of their labels.

    A label row names the first line of its document.
    """
    labels = label_arrays(spark, sf_dir).select(
        "doc_id", F.lit(1).cast("bigint").alias("line_no"), F.to_json("labels").alias("y")
    )
    from logwarden.sources.logs import join_labels

    return join_labels(document_lines(spark, sf_dir), labels, ["doc_id", "line_no"])


def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, features, label)`` of the embeddings table, label as class name."""
    return spread(table(spark, sf_dir, "embeddings"), "vec_id").select(
        F.col("vec_id").alias("id"),
        F.col("embedding").cast("array<double>").alias("features"),
        F.concat(F.lit("class_"), F.col("label")).alias("label"),
    )


# Fixed rules that stand for the output of three classifiers on events.
def outcome_rules() -> dict[str, "F.Column"]:
    e, v = F.col("event_type"), F.col("value")
    return {
        "original": F.when(v < 15, "error").when(v > 200, "unknown").otherwise(e),
        "augmented": F.when(v < 5, "error").when(v > 150, "view").otherwise(e),
        "constant": F.lit("click"),
    }


def outcomes(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """``(id, model, truth, pred)`` long table of rule-based predictions."""
    rules = outcome_rules()
    names = names or ("original",)
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    preds = F.array(
        *[F.struct(F.lit(n).alias("model"), rules[n].alias("pred")) for n in names]
    )
    return events.select(
        F.col("event_id").alias("id"), F.col("event_type").alias("truth"), F.explode(preds).alias("m")
    ).select("id", "m.model", "truth", "m.pred")
