"""TF-IDF over word uni- and bigrams, and truncated SVD of the result."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwarden.functions.vectors import once
from logwarden.functions.segments import OUT_ROWS, list_blocks, named, starts_of
from logwarden.functions.text import unigrams_and_bigrams, word_tokens

#: Terms that a task counts together.
BLOCK_TERMS = 1 << 21
TERM_BUCKETS = 1 << 12


def with_terms(records: DataFrame, text: str = "log") -> DataFrame:
    """Adds ``terms``: uni- and bigrams of the text."""
    tokens = records.withColumn("tokens", word_tokens(text))
    return tokens.withColumn("terms", unigrams_and_bigrams("tokens")).drop("tokens")


STATS = "bucket int, terms array<string>, cf array<bigint>, df array<bigint>"


def _block_stats(most: int):
    """The distinct terms of each block of records with their counts, a row for each bucket of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lists in list_blocks(batches, "terms", most):
            coded = lists.flatten().dictionary_encode()
            places = coded.indices.fill_null(-1).to_numpy().astype(np.int64) + 1
            base = len(coded.dictionary) + 1
            cf = np.bincount(places, minlength=base)
            df = np.bincount(np.unique(pc.list_parent_indices(lists).to_numpy() * base + places) % base, minlength=base)
            hashed = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False)
            bucket = np.append(0, hashed % TERM_BUCKETS).astype(np.int32)
            used = np.flatnonzero(cf)
            used = used[np.argsort(bucket[used], kind="stable")]
            first, _ = starts_of(bucket[used])
            offsets = pa.array(np.append(first, len(used)).astype(np.int32))
            columns = (named(coded.dictionary, used - 1), pa.array(cf[used]), pa.array(df[used]))
            yield pa.record_batch(
                [pa.array(bucket[used[first]]), *(pa.ListArray.from_arrays(offsets, x) for x in columns)],
                ["bucket", "terms", "cf", "df"],
            )

    return run


def _merged_stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, cf, df: sums over rows sorted by bucket, a few buckets at a time."""

    def rows(terms: pa.Array, cf: np.ndarray, df: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(cf), OUT_ROWS):
            at = slice(i, i + OUT_ROWS)
            yield pa.record_batch([terms.slice(i, OUT_ROWS), pa.array(cf[at]), pa.array(df[at])], ["term", "cf", "df"])

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column("terms")
        terms, bucket = lists.flatten(), batch.column("bucket").to_numpy()[pc.list_parent_indices(lists).to_numpy()]
        cf, df = (batch.column(c).flatten().to_numpy() for c in ("cf", "df"))
        if held:
            terms = pa.concat_arrays([held[0], terms])
            bucket, cf, df = (np.concatenate(x) for x in zip(held[1:], (bucket, cf, df), strict=True))
        coded = terms.dictionary_encode()
        places = coded.indices.fill_null(-1).to_numpy().astype(np.int64) + 1
        cf, df = (np.bincount(places, x, minlength=len(coded.dictionary) + 1).astype(np.int64) for x in (cf, df))
        of = np.zeros(len(cf), np.int32)
        of[places] = bucket
        used = np.flatnonzero(cf)
        done, last = used[of[used] != bucket[-1]], used[of[used] == bucket[-1]]
        yield from rows(named(coded.dictionary, done - 1), cf[done], df[done])
        held = named(coded.dictionary, last - 1), of[last], cf[last], df[last]
    if held:
        yield from rows(held[0], *held[2:])


def term_stats(records: DataFrame) -> DataFrame:
    """``(term, cf, df)``: occurrences and records of every term.

    Terms are counted as numbers in blocks of records, and a block's terms are dealt out by
    bucket; a task holds one block, or the terms of a few buckets.
    """
    counted = records.select("terms").where("terms is not null").mapInArrow(_block_stats(BLOCK_TERMS), STATS)
    return counted.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_merged_stats, "term string, cf bigint, df bigint")


def vocabulary(
    stats: DataFrame,
    n_records,
    min_df: int = 2,
    max_df: float = 0.9,
    max_features: int = 5000,
) -> DataFrame:
    """``(term, cf, df, idf)`` of the commonest terms within the df bounds.

    Ties in corpus frequency go to the term that sorts first.
    """
    n = F.lit(n_records) if isinstance(n_records, int) else n_records
    kept = stats.withColumn("_n", n).where(
        (F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * F.col("_n"))
    )
    top = kept.orderBy(F.desc("cf"), "term").limit(max_features)
    idf = F.log((1 + F.col("_n")) / (1 + F.col("df"))) + 1
    return top.select("term", "cf", "df", idf.alias("idf"))


@dataclass
class TfidfModel:
    """At most ``max_features`` terms and weights: small whatever the corpus."""

    terms: list[str]
    idf: list[float]

    @staticmethod
    def fit(records: DataFrame, max_features: int = 5000, min_df: int = 2, max_df: float = 0.9) -> "TfidfModel":
        """``records`` carries ``terms``. The collected vocabulary is bounded by
        ``max_features``; it is put in term order, as the columns are."""
        n = records.agg(F.count("*").alias("n")).scalar()
        rows = vocabulary(term_stats(records), n, min_df, max_df, max_features).collect()
        rows.sort(key=lambda r: r["term"])
        return TfidfModel([r["term"] for r in rows], [r["idf"] for r in rows])

    def transform(self, records: DataFrame) -> DataFrame:
        """Adds ``indices`` and ``values``, an L2-normalised sparse row.

        Terms are counted in place by a dictionary lookup, so nothing is
        shuffled and unseen terms fall away.
        """
        counter = CountVectorizerModel.from_vocabulary(
            self.terms, inputCol="terms", outputCol="_tf"
        )
        tf = F.unwrap_udt("_tf")
        idf = F.from_json(F.lit(json.dumps(self.idf)), "array<double>")
        counted = counter.transform(records).select(
            *records.columns, tf["indices"].alias("indices"), tf["values"].alias("_c")
        ).withColumn("_idf", idf)
        raw = F.zip_with(
            "indices", "_c", lambda i, c: (1 + F.log(c)) * F.element_at("_idf", i + 1)
        )
        norm = lambda w: F.sqrt(F.aggregate(w, F.lit(0.0), lambda a, x: a + x * x))
        unit = once(raw, lambda w: once(norm(w), lambda n: F.transform(w, lambda x: x / n)))
        return counted.withColumn("values", unit).drop("_c", "_idf")

    def long(self, weighted: DataFrame, *keys: str) -> DataFrame:
        """``(*keys, term, weight)``, one row per non-zero cell."""
        terms = F.from_json(F.lit(json.dumps(self.terms)), "array<string>")
        return weighted.select(*keys, F.explode(F.arrays_zip("indices", "values")).alias("x")).select(
            *keys,
            F.col("x.indices").alias("i"),
            F.col("x.values").alias("weight"),
        ).withColumn("term", F.element_at(terms, F.col("i") + 1)).drop("i")


# --------------------------------------------------------------- truncated SVD
def _csr(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row starts, column ids and values of a batch of sparse rows."""
    idx, val = batch.column("indices"), batch.column("values")
    starts = np.asarray(idx.offsets)
    flat = slice(starts[0], starts[-1])
    return (
        starts - starts[0],
        idx.values.to_numpy(zero_copy_only=False)[flat],
        val.values.to_numpy(zero_copy_only=False)[flat],
    )


def _rows_as_lists(dense: np.ndarray) -> pa.Array:
    n, width = dense.shape
    offsets = pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(dense).ravel()))


def _row_products(starts, cols, vals, basis) -> np.ndarray:
    """Sparse rows times a dense matrix; empty rows give zeros."""
    out = np.zeros((len(starts) - 1, basis.shape[1]))
    used = np.flatnonzero(np.diff(starts))
    if len(used):
        out[used] = np.add.reduceat(vals[:, None] * basis[cols], starts[used], axis=0)
    return out


def _gram_times(rows: DataFrame, basis: np.ndarray, chunk: int = 256) -> np.ndarray:
    """``A'(A basis)`` in one pass over the rows of ``A``.

    Every task folds its rows into one partial per column it met; the partials
    are summed by column on the cluster. What comes back has the shape of
    ``basis``, features x components, and does not grow with the rows.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(basis)
    width = basis.shape[1]

    def fold(batches):
        basis = shared.value
        acc = np.zeros(basis.shape)
        hit = np.zeros(basis.shape[0], dtype=bool)
        for batch in batches:
            starts, cols, vals = _csr(batch)
            for lo in range(0, len(starts) - 1, chunk):
                s = starts[lo : lo + chunk + 1]
                c, v = cols[s[0] : s[-1]], vals[s[0] : s[-1]]
                # a dense block of the columns these few rows use
                used, at = np.unique(c, return_inverse=True)
                block = np.zeros((len(s) - 1, len(used)))
                block[np.repeat(np.arange(len(s) - 1), np.diff(s)), at] = v
                acc[used] += block.T @ (block @ basis[used])
                hit[used] = True
        ids = np.flatnonzero(hit)
        for lo in range(0, len(ids), 1000):
            part = ids[lo : lo + 1000]
            yield pa.record_batch(
                [
                    pa.array(part.astype(np.int32)),
                    _rows_as_lists(acc[part]),
                ],
                ["feature", "part"],
            )

    partials = rows.select("indices", "values").mapInArrow(fold, "feature int, part array<double>")
    sums = partials.groupBy("feature").agg(
        Summarizer.sum(array_to_vector("part")).alias("v")
    )
    out = np.zeros((basis.shape[0], width))
    table = sums.select("feature", vector_to_array("v").alias("v")).toArrow()
    if len(table):
        out[table.column("feature").to_numpy()] = (
            table.column("v").combine_chunks().flatten().to_numpy().reshape(-1, width)
        )
    shared.unpersist()
    return out


@dataclass
class SvdModel:
    components: np.ndarray  # features x k
    singular_values: np.ndarray

    @staticmethod
    def fit(rows: DataFrame, n_features: int, k: int = 100, passes: int = 5, oversample: int = 10, seed: int = 42) -> "SvdModel":
        """Leading right singular vectors by randomised subspace iteration.

        Halko, Martinsson and Tropp (2011): ``passes + 1`` reads of the data
        rather than hundreds of matrix-vector products, uncentred, k cut to the
        number of features. Only features x (k + oversample) numbers are held
        on the driver.
        """
        k = min(k, n_features)
        width = min(n_features, k + oversample)
        basis = np.random.default_rng(seed).standard_normal((n_features, width))
        basis, _ = np.linalg.qr(basis)
        for _ in range(passes):
            basis, _ = np.linalg.qr(_gram_times(rows, basis))
        small = basis.T @ _gram_times(rows, basis)
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(values)[::-1][:k]
        return SvdModel(basis @ vectors[:, order], np.sqrt(np.clip(values[order], 0, None)))

    def transform(self, rows: DataFrame, out: str = "features") -> DataFrame:
        """Adds the dense projection of every sparse row; no shuffle."""
        shared = rows.sparkSession.sparkContext.broadcast(self.components)
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

        def project(batches):
            v = shared.value
            for batch in batches:
                dense = _row_products(*_csr(batch), v)
                yield batch.append_column(out, _rows_as_lists(dense))

        return rows.mapInArrow(project, f"{fields}, `{out}` array<double>")

    def explained_variance(self, rows: DataFrame) -> float:
        """Variance of the projected columns over variance of the input columns."""
        n_features = self.components.shape[0]
        n = rows.count()
        cells = rows.select(F.explode(F.arrays_zip("indices", "values")).alias("x"))
        sums = cells.groupBy("x.indices").agg(
            F.sum("x.values").alias("s"), F.sum(F.col("x.values") * F.col("x.values")).alias("q")
        )
        mean, square = np.zeros(n_features), np.zeros(n_features)
        for row in sums.collect():  # one row per feature
            mean[row[0]], square[row[0]] = row["s"] / n, row["q"] / n
        total = float((square - mean**2).sum())
        projected = self.singular_values**2 / n - (mean @ self.components) ** 2
        return float(projected.sum() / total) if total > 0 else 0.0
