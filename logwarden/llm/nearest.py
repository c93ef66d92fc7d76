"""Approximate nearest neighbours by largest inner product: adaptive dimension scan.

Vectors are dealt to lists by their nearest of about sqrt(n) spherical k-means
centres, turned by a fixed random rotation, and kept by list in blocks of columns. A
query scans the lists nearest to it, until they hold ``PROBE_SHARE`` of the rows
and ``PROBE_ROWS`` rows. In a list, partial inner products over the first columns
are tested first. Under a random rotation the first d of D columns hold d/D of an
inner product s on average, with standard deviation
|q| |x| sqrt(d (D - d) (1 + s^2 / |q|^2 |x|^2) / D^3). The hypothesis that a
candidate reaches the query's threshold is rejected, and the candidate abandoned,
if its partial product is more than ``Z`` deviations below what the threshold would
give, or if even the Cauchy-Schwarz bound of the rest does not reach it. Survivors go
on to the next columns; the last ones get the exact double product of the original
vectors. The threshold is the score of the k-th best id in a small sample of the
candidates; the sample sets thresholds only, all hits come from the scan of probed lists.
Queries that find fewer than ``k`` ids there scan all lists once more without a
threshold. ``probe_share=1`` with ``z=inf`` is exact.

Centres and thresholds come from a sample of a sixteenth of the rows, ``SAMPLE_LEAST`` at
least and ``SAMPLE`` at most, chosen by hash; every row is indexed. Lists are cut into blocks of rows and queries
into chunks by hash, so a list that holds most rows, or is near to most queries, is
many small groups. A task's group is one block and one chunk.

Vectors that are null, zero, or hold a null or non-finite component take no part,
nor do vectors of another length than the most common one. Equal scores go to the
smaller id. Rows of one id are one candidate with their best score, and a query
skips all rows with its id. Null ids take no part. Extra columns are ignored. With
no more candidates than ``k``, a query gets all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logwarden.session import stored

K = 20
SAMPLE = 16_384
SAMPLE_LEAST = 512
SAMPLE_SHARE = 1 / 16
PROBE_SHARE = 0.7
PROBE_ROWS = 1_024
MAX_LISTS = 4_096
BLOCK_ROWS = 4_096
CHUNK_ROWS = 4_096
COLUMNS = 16
Z = 2.5
ROUNDS = 8


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v: the vectors that take part, as doubles."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & fine & F.exists("v", lambda x: x != 0)
    )
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("v") == (sizes[0][0] if sizes else 0))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(flat)
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(n, -1) if n else np.zeros((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True).clip(1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True).clip(1e-300)


class Index(NamedTuple):
    """The sample for starting thresholds, the rotation, and the list centres."""

    ids: np.ndarray
    sample: np.ndarray
    rotation: np.ndarray
    centres: np.ndarray

    @classmethod
    def fit(cls, ids: np.ndarray, sample: np.ndarray, total: int) -> Index:
        rng = np.random.default_rng(17)
        order = np.argsort(ids, kind="stable")
        ids, sample = ids[order], sample[order]
        unit = _unit(sample)
        n = max(1, min(MAX_LISTS, len(unit), round(total**0.5)))
        centres = unit[rng.permutation(len(unit))[:n]].copy()
        for _ in range(ROUNDS):
            nearest = np.argmax(unit @ centres.T, 1)
            sums = np.zeros_like(centres)
            np.add.at(sums, nearest, unit)
            some = np.bincount(nearest, minlength=n) > 0
            centres[some] = _unit(sums[some])
        d = sample.shape[1]
        return cls(ids, sample, np.linalg.qr(rng.standard_normal((d, d)))[0], centres)

    def lists(self, x: np.ndarray) -> np.ndarray:
        return np.argmax(_unit(x) @ self.centres.T, 1)

    def probes(self, q: np.ndarray, rows: np.ndarray, at_least: int, share: float) -> list[np.ndarray]:
        """The nearest lists of each query that hold enough of the ``rows`` in each list."""
        order = np.argsort(-(q @ self.centres.T), 1, kind="stable")
        held = np.cumsum(rows[order], 1)
        need = min(rows.sum(), max(at_least, PROBE_ROWS, int(np.ceil(share * rows.sum()))))
        return [o[: int(np.searchsorted(h, need)) + 1] for o, h in zip(order, held, strict=True)]

    def thresholds(self, ids: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
        """Each query's score of the k-th best id in the sample, -inf with fewer ids."""
        scores = q @ self.sample.T
        scores[ids[:, None] == self.ids[None, :]] = -np.inf
        first = np.flatnonzero(np.append(True, self.ids[1:] != self.ids[:-1]))  # ids are in order
        of_id = np.maximum.reduceat(scores, first, 1)
        return np.partition(of_id, -k, 1)[:, -k] if len(first) >= k else np.full(len(q), -np.inf)


def scan(
    ids: np.ndarray, x: np.ndarray, rx: np.ndarray, qids: np.ndarray, q: np.ndarray, rq: np.ndarray,
    floor: np.ndarray, k: int, z: float = Z,
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The query's place, ids and scores of its k best ids at or above its floor, each with its best row.

    ``rx`` and ``rq`` are the rotated vectors; columns are taken ``COLUMNS`` at a time.
    """
    d = rx.shape[1]
    cuts = list(range(COLUMNS, d, COLUMNS))
    blocks = [np.ascontiguousarray(rx[:, a:b].T) for a, b in zip([0, *cuts], [*cuts, d], strict=True)]
    rest_x = [np.linalg.norm(rx[:, c:], axis=1) for c in cuts]
    norm_x = np.linalg.norm(rx, axis=1)
    repeated = len(np.unique(ids)) < len(ids)
    for n in range(len(qids)):
        alive, partial, at = None, 0.0, 0
        bar, scale = floor[n], np.linalg.norm(rq[n]) * norm_x
        wide = np.sqrt(scale**2 + bar**2) if np.isfinite(bar) else scale
        for b, block in enumerate(blocks[:-1]):
            if not np.isfinite(bar):
                break
            pick = slice(None) if alive is None else alive
            partial, at = partial + rq[n, at : at + len(block)] @ block[:, pick], at + len(block)
            expected = bar * at / d - z * wide[pick] * np.sqrt(at * (d - at) / d**3)
            reach = partial + np.linalg.norm(rq[n, at:]) * rest_x[b][pick]
            keep = np.flatnonzero((partial >= expected) & (reach >= bar - 1e-9 * abs(bar)))
            alive = keep if alive is None else alive[keep]
            partial = partial[keep]
            if not len(alive):
                break
        alive = np.arange(len(ids)) if alive is None else alive
        alive = alive[ids[alive] != qids[n]]
        if not len(alive):
            continue
        scores = (x[alive] * q[n]).sum(1)
        good = np.flatnonzero(scores >= bar)
        good = good[np.lexsort((ids[alive][good], -scores[good]))]
        if repeated:
            good = good[np.sort(np.unique(ids[alive][good], return_index=True)[1])]
        good = good[:k]
        if len(good):
            yield n, ids[alive][good], scores[good]


def _cells(total: int, rows: int) -> int:
    return max(1, -(-total // rows))


def nearest(
    vectors: DataFrame, query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K,
    probe_share: float = PROBE_SHARE, z: float = Z,
) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of ``vectors`` where ``query`` holds."""
    spark = vectors.sparkSession
    flagged = vectors.withColumn("_query", F.coalesce(query, F.lit(False)))
    rows = stored(usable(flagged, id_col, vector_col), "vectors")
    asked = stored(usable(flagged.where("_query"), id_col, vector_col), "queries")
    out = "query_id long, rank int, vec_id long, score double"
    total, queries = rows.count(), asked.count()
    if not total or not queries:
        return spark.createDataFrame([], out)
    share = min(1.0, max(SAMPLE_LEAST / total, min(SAMPLE_SHARE, 0.9 * SAMPLE / total)))
    place = F.xxhash64("id", "v", F.lit(7))
    # a vector once for each id, SAMPLE rows at most, the same ones in every run
    drawn = rows.where(F.pmod(place, F.lit(1 << 30)) <= int(share * (1 << 30))).dropDuplicates(["id", "v"])
    drawn = drawn.orderBy(place, "id").limit(SAMPLE).toPandas()
    if drawn.empty:
        drawn = rows.orderBy(place, "id").limit(1).toPandas()
    fitted = Index.fit(drawn["id"].to_numpy(), np.stack(drawn["v"]), total)
    shared = spark.sparkContext.broadcast(tuple(fitted))  # SAMPLE + MAX_LISTS vectors at most

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(*shared.value)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("v"))
                lists = index.lists(x).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(lists)], ["id", "v", "list"])

    dealt = stored(rows.mapInArrow(deal, "id long, v array<double>, list int"), "listed-vectors")
    sizes = {r[0]: r[1] for r in dealt.groupBy("list").count().collect()}  # MAX_LISTS rows at most
    held = np.array([sizes.get(i, 0) for i in range(len(fitted.centres))])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(*shared.value)
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                batch = whole.slice(i, 512)
                q, ids = _matrix(batch.column("v")), batch.column("id").to_numpy()
                floor = index.thresholds(ids, q, k)
                # with too few ids in the sample, all lists are scanned
                lists = [
                    np.arange(len(held)) if f == -np.inf else p
                    for f, p in zip(floor, index.probes(q, held, k + 1, probe_share), strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id"), batch.column("v"), pa.array(floor, pa.float64()),
                        pa.array([p.astype(np.int32) for p in lists], pa.list_(pa.int32())),
                    ],
                    ["id", "v", "floor", "lists"],
                )

    probed = stored(asked.mapInArrow(probe, "id long, v array<double>, floor double, lists array<int>"), "probed-queries")
    # a list is cut by its size, and the queries by how many there are
    blocks = F.get(F.array(*(F.lit(_cells(int(n), BLOCK_ROWS)) for n in held)), F.col("list"))
    cut = lambda n: F.pmod(F.xxhash64("id", F.lit(3)), n).cast("int")
    each = lambda n: F.sequence(F.lit(0), n - 1)
    chunks = F.lit(_cells(queries, CHUNK_ROWS))
    left = dealt.withColumn("block", cut(blocks)).withColumn("chunk", F.explode(each(chunks)))

    def compare(table: pa.Table, asks: pa.Table) -> pa.Table:
        found = []
        if table.num_rows and asks.num_rows:
            x, q = _matrix(table.column("v")), _matrix(asks.column("v"))
            qids, turn = asks.column("id").to_numpy(), Index(*shared.value).rotation
            found = [
                (qids[n], i, s)
                for n, ids, scores in scan(
                    table.column("id").to_numpy(), x, x @ turn, qids, q, q @ turn, asks.column("floor").to_numpy(), k, z
                )
                for i, s in zip(ids, scores, strict=True)
            ]
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        return pa.table(
            {"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())}
        )

    keys = ["list", "block", "chunk"]

    def hits_of(asks: DataFrame) -> DataFrame:
        right = asks.withColumns({"chunk": cut(chunks), "list": F.explode("lists")}).withColumn("block", F.explode(each(blocks)))
        found = left.groupBy(*keys).cogroup(right.drop("lists").groupBy(*keys)).applyInArrow(
            compare, "query_id long, vec_id long, score double"
        )
        return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))

    hits = stored(hits_of(probed), "hits")
    counts = hits.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("n"))
    few = probed.where(F.col("floor") > float("-inf")).join(counts, "id", "left").where(F.coalesce("n", F.lit(0)) < k).drop("n")
    if not few.isEmpty():
        everywhere = F.sequence(F.lit(0), F.lit(len(held) - 1))
        more = hits_of(few.withColumns({"floor": F.lit(float("-inf")), "lists": everywhere}))
        hits = hits.unionByName(more).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op1_nearest(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, F.col("vec_id") % 20 == 0)
