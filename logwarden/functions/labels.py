"""Label columns: JSON text to class name, class codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NORMAL = "normal"
UNKNOWN = "unknown"
STRICT = {"allowSingleQuotes": "false"}
MARK = "end of the value"


def class_label(y: Column | str) -> Column:
    """First element of a JSON array; ``[]`` is normal, anything else unknown.

    The text is parsed as the element before an end mark in an array, so single quotes,
    text after the value and a second closing bracket make it unknown.
    """
    y = F.col(y) if isinstance(y, str) else y
    parsed = F.from_json(F.concat(F.lit("["), y, F.lit(f',["{MARK}"]]')), "array<array<string>>", STRICT)
    whole = (F.size(parsed) == 2) & (F.get(F.get(parsed, F.lit(1)), F.lit(0)) == MARK)
    labels = F.when(whole, F.get(parsed, F.lit(0)))
    return (
        F.when(labels.isNull(), UNKNOWN)
        .when(F.size(labels) == 0, NORMAL)
        .otherwise(F.coalesce(F.try_element_at(labels, F.lit(1)), F.lit(UNKNOWN)))
    )


def label_codes(*labelled: DataFrame, col: str = "label") -> DataFrame:
    """``(label, code)`` over the union of the inputs, codes in label order.

    The rank runs over distinct labels, collected into one sorted array: its
    size is the number of classes, not of rows.
    """
    union = labelled[0].select(F.col(col).alias("label"))
    for df in labelled[1:]:
        union = union.unionByName(df.select(F.col(col).alias("label")))
    classes = union.agg(F.sort_array(F.collect_set("label")).alias("labels"))
    return classes.select(F.posexplode("labels").alias("code", "label")).select(
        "label", F.col("code").cast("bigint").alias("code")
    )


def distinct_labels(*labelled: DataFrame, col: str = "label") -> DataFrame:
    """Every label that occurs in any of the inputs."""
    union = labelled[0].select(F.col(col).alias("label"))
    for df in labelled[1:]:
        union = union.unionByName(df.select(F.col(col).alias("label")))
    return union.distinct()
