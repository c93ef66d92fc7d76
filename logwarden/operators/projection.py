"""Two-dimensional views of vectors for inspection."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwarden.functions.hashing import hash_sample


def pca_projection(vectors: DataFrame, *keep: str) -> DataFrame:
    """Adds ``x`` and ``y``, the first two principal components."""
    rows = vectors.withColumn("_v", array_to_vector("features"))
    model = PCA(k=2, inputCol="_v", outputCol="_p").fit(rows)
    xy = vector_to_array("_p")
    return model.transform(rows).select(*keep, xy[0].alias("x"), xy[1].alias("y"))


def compare_methods(methods: dict[str, DataFrame], size: int = 5000, seed: int = 42) -> DataFrame:
    """``(method, id, label, x, y)``: the same sampled ids under each method."""
    out = None
    for name, vectors in methods.items():
        sample = hash_sample(vectors, F.col("id"), size, seed)
        part = pca_projection(sample, "id", "label").withColumn("method", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.select("method", "id", "label", "x", "y")
