"""Seeded, partition-independent choices: splits and samples by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BUCKET_HEX = 5  # 16^5 = 1,048,576 buckets: bounds the histogram below


def row_hash(row_id: Column, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), row_id.cast("string")))


def _leading(h: Column, digits: int) -> Column:
    return F.conv(F.substring(h, 1, digits), 16, 10).cast("bigint")


def in_train(row_id: Column, fraction: float = 0.8, seed: int = 42) -> Column:
    """True for about ``fraction`` of the ids; needs no shuffle and no state."""
    return _leading(row_hash(row_id, seed), 8) < int(round(fraction * 2**32))


def with_split(df: DataFrame, row_id: Column, fraction: float = 0.8, seed: int = 42) -> DataFrame:
    """Adds ``split`` in ('train', 'test'); the two sides are complements."""
    return df.withColumn(
        "split", F.when(in_train(row_id, fraction, seed), "train").otherwise("test")
    )


def smallest_by_hash(df: DataFrame, row_id: Column, k: Column | int, seed: int = 42) -> DataFrame:
    """Adds ``chosen``: true for exactly ``min(k, rows)`` rows, smallest hash first.

    A histogram of leading hash digits (at most a million small rows) finds the
    one bucket the cut falls into. Only that bucket, a millionth of the rows, is
    ranked; all other rows are decided where they are. Ids must be unique.
    """
    k = F.lit(k) if isinstance(k, int) else k
    hashed = df.withColumn("_h", row_hash(row_id, seed)).withColumn(
        "_b", _leading(F.col("_h"), _BUCKET_HEX)
    )
    histogram = hashed.groupBy("_b").agg(F.count("*").alias("c")).agg(
        F.sort_array(F.collect_list(F.struct("_b", "c"))).alias("hist")
    ).withColumn("k", k)
    state = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(-1).cast("bigint").alias("cut"))
    scanned = F.aggregate(
        "hist",
        state,
        lambda s, b: F.when(s["cut"] >= 0, s)
        .when(s["seen"] + b["c"] > F.col("k"), F.struct(s["seen"].alias("seen"), b["_b"].alias("cut")))
        .otherwise(F.struct((s["seen"] + b["c"]).alias("seen"), s["cut"].alias("cut"))),
    )
    cut = histogram.select("k", scanned.alias("s"))
    bucket = cut.select(
        F.when(F.col("s.cut") < 0, 16**_BUCKET_HEX).otherwise(F.col("s.cut")).alias("b")
    ).scalar()
    marked = hashed.withColumn("_cut", bucket)
    # ranks inside the cut bucket, as a sorted array of its hashes
    edge = marked.where("_b = _cut").agg(F.sort_array(F.collect_list("_h")).alias("hs"))
    rest = cut.select((F.col("k") - F.col("s.seen")).cast("int")).scalar()
    last = edge.withColumn("rest", rest).select(
        F.when(F.col("rest") > 0, F.try_element_at("hs", F.col("rest"))).alias("h")
    ).select(F.coalesce("h", F.lit("")))
    return marked.withColumn(
        "chosen",
        (F.col("_b") < F.col("_cut")) | ((F.col("_b") == F.col("_cut")) & (F.col("_h") <= last.scalar())),
    ).drop("_h", "_b", "_cut")


def exact_split(df: DataFrame, row_id: Column, fraction: float = 0.8, seed: int = 42) -> DataFrame:
    """Like :func:`with_split`, with exactly ``round(fraction * rows)`` train rows."""
    size = df.agg(F.round(F.count("*") * F.lit(fraction)).cast("bigint").alias("n"))
    marked = smallest_by_hash(df, row_id, size.scalar(), seed)
    return marked.withColumn("split", F.when(F.col("chosen"), "train").otherwise("test")).drop("chosen")


def hash_sample(df: DataFrame, row_id: Column, size: int = 5000, seed: int = 42) -> DataFrame:
    """``min(size, rows)`` rows without replacement, the same ones on every run."""
    return smallest_by_hash(df, row_id, size, seed).where("chosen").drop("chosen")
