"""Queries of this package against their SQL twins, mixing, neighbours, and the pipeline."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logwarden.llm import mixing, nearest
from logwarden.llm.components import connected
from logwarden.llm.registry import ORACLES, QUERIES
from oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@needs_tables
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert compare(got, duck(SF).sql(ORACLES[name]).df()) == ""


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys((90, 95, 100), 90), 200: 200, 201: 200}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


# ----------------------------------------------------------------------- mixing
def mixed_rows(spark, sizes):
    rows = [(i, " ".join(["w"] * n), s) for s, many in sizes.items() for i, n in enumerate(many)]
    return spark.createDataFrame([(k, t, s, "x", 1) for k, (_, t, s) in enumerate(rows)], "doc_id long, text string, source string, shard string, pass int")


def test_targets_stop_at_three_times_the_source(spark):
    docs = mixed_rows(spark, {"a": [10], "b": [500] * 4, "c": [100] * 5, None: [50]})
    got = {(r["_src"], r["_none"]): r["target"] for r in mixing.source_targets(mixing.with_sizes(docs)).collect()}
    total, caps, weights = 2560, [30, 6000, 1500, 150], [5, 2, 1, 5]
    free, targets = set(range(4)), [0.0] * 4
    while True:
        left = total - sum(caps[i] for i in range(4) if i not in free)
        share = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        over = {i for i in free if share[i] > caps[i]}
        if not over:
            break
        free -= over
    targets = [share[i] if i in free else caps[i] for i in range(4)]
    assert [got[k] for k in (("a", False), ("b", False), ("c", False), ("", True))] == pytest.approx(targets)


def test_mix_reaches_targets_and_fills_shards(spark):
    docs = mixed_rows(spark, {"a": [7] * 300, "b": [3, 9, 4] * 400, None: [5] * 50, "d": [0] * 20 + [11] * 30})
    mixed = mixing.mix(docs)
    assert mixed.columns == ["doc_id", "text", "source", "pass", "shard", "place"]
    rows = mixed.withColumn("size", F.size(F.split("text", " "))).collect()
    want = {(None if r["_none"] else r["_src"]): r["target"] for r in mixing.source_targets(mixing.with_sizes(docs)).collect()}
    for source, target in want.items():
        assert sum(r["size"] for r in rows if r["source"] == source) == pytest.approx(target, abs=6)
    times = {}
    for r in rows:
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert max(times.values()) <= 3 and all(r["size"] for r in rows)
    words = np.bincount([r["shard"] for r in rows], [r["size"] for r in rows], minlength=16)
    assert words.max() < 1.5 * words.mean() and words.min() > 0.5 * words.mean()
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(5)).withColumn("size", F.size(F.split("text", " "))).collect()))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_tree_gives_exact_quotas(spark):
    docs = mixed_rows(spark, {"a": [50] * 40, "b": [20] * 40})
    targets = mixing.source_targets(mixing.with_sizes(docs))
    blocks = mixing.shard_blocks(targets, levels=3, blocks=200).toPandas()
    sizes = blocks.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 3 and not blocks.duplicated(["_src", "block"]).any()
    share = blocks[blocks["_src"] == "a"].groupby("shard").size() / sizes
    assert share.std() > 0  # a draw, not a split in proportion


# ------------------------------------------------------------------- neighbours
def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")


def test_neighbours_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nearest, "PROBE_ROWS", 64)
    monkeypatch.setattr(nearest, "SAMPLE_LEAST", 150)
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 50)
    monkeypatch.setattr(nearest, "CHUNK_ROWS", 20)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 32))
    x = (centres[rng.integers(12, size=1500)] + 0.6 * rng.standard_normal((1500, 32))).astype("f4")
    x[200:260] = x[200]  # a common vector
    docs = vectors(spark, [(i, v.tolist(), 1) for i, v in enumerate(x)])
    got = nearest.nearest(docs, F.col("vec_id") % 20 == 0).toPandas()
    hits = 0
    for i in range(0, 1500, 20):
        scores = (x.astype(float) * x[i].astype(float)).sum(1)
        own = got[got.query_id == i].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21)) and i not in set(own.vec_id)
        assert own.score.tolist() == pytest.approx([scores[j] for j in own.vec_id], rel=1e-14)
        assert own.sort_values(["score", "vec_id"], ascending=[False, True]).vec_id.tolist() == own.vec_id.tolist()
        scores[i] = -np.inf
        hits += len(set(np.lexsort((np.arange(1500), -scores))[:20]) & set(own.vec_id))
    assert hits / (75 * 20) >= 0.9


def test_repeated_ids_are_one_candidate(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((90, 16)).astype("f4")
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x) for _ in range(2)]
    rows += [(7, (3 * x[20] + 0.01 * rng.standard_normal(16)).astype("f4").tolist(), 1) for _ in range(90)]  # a hot id near query 20
    exact = nearest.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0, probe_share=1.0, z=np.inf)
    got = exact.dropDuplicates(["query_id", "rank"]).toPandas()
    for i in range(0, 90, 20):
        best = {}
        for j, v, _ in rows:
            if j != i:
                best[j] = max(best.get(j, -np.inf), float(np.dot(np.array(v, "f4").astype(float), x[i].astype(float))))
        own = got[got.query_id == i].sort_values("rank")
        assert own.vec_id.tolist() == sorted(best, key=lambda j: (-best[j], j))[:20]
        assert own.score.tolist() == pytest.approx([best[j] for j in own.vec_id])


def test_odd_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [2.0, 1.0], 1), (2, None, 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [1.0, None], 1),
            (6, [inf, 1.0], 1), (7, [1.0, 2.0, 3.0], 1), (8, [2.0, 5.0], 1), (None, [1.0, 1.0], 1), (1, [2.0, 1.0], 1), (20, [1.0, 1.0], 1)]
    got = nearest.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in sorted(got)] == [
        (0, 1, 1, 2.0), (0, 2, 8, 2.0), (0, 3, 20, 1.0), (20, 1, 8, 7.0), (20, 2, 1, 3.0), (20, 3, 0, 1.0)
    ]
    assert nearest.nearest(vectors(spark, []), F.col("vec_id") % 20 == 0).count() == 0


# --------------------------------------------------------------------- pipeline
def test_pipeline_stages(spark, tmp_path):
    sentence = lambda k: " ".join(f"word{chr(97 + k // 10)}{chr(97 + k % 10)}{chr(97 + i % 26)}x{chr(97 + i // 26)}" for i in range(30))
    rows = [(i, f"MENU\n{sentence(i)}", "en", f"s{i % 2}", 0) for i in range(40)]
    rows += [(100, rows[4][1] + " tail", "en", "s0", 0), (101, rows[4][1], "en", "s1", 0), (102, "123 456", "en", "s0", 0), (103, None, None, None, None), (104, "", None, "s9", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == before.columns
    ids = {k: sorted(r["doc_id"] for r in v) for k, v in kept.items()}
    assert ids["language_id"] == [*range(40), 100, 101]
    assert all("MENU" not in r["text"] and r["n_chars"] == len(r["text"]) for r in kept["line_dedup"])
    assert ids["ngram_join"] == list(range(40))
    assert set(ids["mixing"]) <= set(range(40)) and len(ids["mixing"]) > 20
    assert set(ids["packing"]) == set(ids["mixing"])


def test_pipeline_on_an_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
