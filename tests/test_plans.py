import json

import pytest
from pyspark.sql import functions as F

from logwarden.operators import metrics as M
from logwarden.plans import embed as E
from logwarden.plans import evaluate as EV
from logwarden.plans import steps as S
from logwarden.streaming import scoring as SC


@pytest.fixture(scope="module")
def records(spark):
    attack = ["error scan probe denied", "scan exploit probe error", "exploit denied scan shell"]
    normal = ["user session opened fine", "session closed user bye", "cron daily user fine"]
    rows = []
    for i in range(120):
        bad = i % 3 == 0
        rows.append((f"f:{i}", (attack if bad else normal)[i % 3 if not bad else (i // 3) % 3], json.dumps(["attack"] if bad else [])))
    return spark.createDataFrame(rows, "id string, log string, y string")


@pytest.mark.parametrize("method,width", [("tfidf", None), ("word2vec", 6), ("subword", 6), ("graph", 9)])
def test_every_method_gives_one_vector_per_record(spark, records, method, width):
    extra = {} if method == "tfidf" else {"epochs": 1}
    got = E.embed(records, method, size=6, exact=True, **extra).toPandas()
    assert sorted(got["id"]) == sorted(r["id"] for r in records.collect())
    assert (got["split"] == "train").sum() == 96
    assert set(got["features"].map(len)) == {width or 6}


def test_train_and_evaluate(spark, records, tmp_path):
    vectors = EV.labelled_vectors(E.embed(records, "tfidf", size=4))
    ids = vectors.withColumn("id", F.xxhash64("id"))
    models = {"lr": {}, "knn": {}, "rf": {"trees": 5, "depth": 3}, "gbt": {"rounds": 3, "depth": 2}, "svm": {}}
    board = EV.train_and_evaluate(ids, "tfidf", models, str(tmp_path / "r"), str(tmp_path / "m")).collect()
    assert (tmp_path / "m/tfidf/lr").is_dir()
    assert {r["model"] for r in board} == set(models) and board[0]["accuracy"] > 0.95
    again = EV.train_and_evaluate(ids, "tfidf", models, None, str(tmp_path / "m")).collect()
    assert [tuple(r) for r in again] == [tuple(r) for r in board]  # with the seconds of the first fit
    assert all((r["seconds"] > 0) == (r["model"] != "knn") for r in board)
    assert spark.read.option("header", "true").csv(str(tmp_path / "r/tfidf/lr/class_metrics")).count() == 2


def test_augmentation_effect(spark, records):
    vectors = EV.labelled_vectors(E.embed(records, "tfidf", size=4))
    cells = EV.augmentation_effect(
        vectors.where("split = 'train'").select("id", "features", "label"),
        vectors.where("split = 'test'").select("id", "features", "label"),
        {"lr": {}},
        threshold=0.9,
    )
    overall = M.compare_overall(cells, "arm", "original", "augmented", ["model"]).collect()
    assert {r["metric"] for r in overall} == {"precision", "recall", "f1"}


def test_materialize_builds_once(spark, tmp_path):
    path, built = str(tmp_path / "t"), []

    def build():
        built.append(1)
        return spark.range(len(built))

    assert S.materialize(spark, path, build).count() == 1
    assert S.materialize(spark, path, build).count() == 1 and len(built) == 1
    assert S.materialize(spark, path, build, force=True).count() == 2
    assert S.available(spark, str(tmp_path), ["t", "u"]) == ["t"]


def test_step_errors(spark):
    def fails():
        raise ValueError("broken")

    report = S.run_steps({"a": fails, "b": lambda: None}, skip_errors=True)
    assert report == {"a": "failed: broken", "b": "done"}
    with pytest.raises(ValueError):
        S.run_steps({"a": fails})


def test_stream_scores_arriving_files(spark, tmp_path):
    logs, out = tmp_path / "in", str(tmp_path / "out")
    logs.mkdir()
    (logs / "a.log").write_text("scan denied\n\nuser fine\n")
    score = lambda batch: batch.select("log", F.array_contains("tokens", "scan").alias("alert"))
    for text in (None, "scan again\n"):
        if text:
            (logs / "b.log").write_text(text)
        lines = SC.arriving_lines(spark, str(logs))
        SC.score_stream(lines, score, out, str(tmp_path / "cp")).awaitTermination(120)
    got = {r["log"]: r["alert"] for r in spark.read.parquet(out).collect()}
    assert got == {"scan denied": True, "user fine": False, "scan again": True}


def test_windowed_alerts_in_a_stream(spark, tmp_path):
    rows = spark.createDataFrame(
        [("2024-01-01 00:10:00", "error"), ("2024-01-01 00:50:00", "error"), ("2024-01-01 03:00:00", "error"), ("2024-01-01 03:00:00", "ok")],
        "t string, kind string",
    ).select(F.to_timestamp("t").alias("ts"), "kind")
    rows.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "events"))
    counted = SC.alerts_per_window(stream, "ts", "kind", normal=("ok",))
    q = counted.writeStream.format("memory").queryName("alerts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((str(r["window_start"]), r["alerts"]) for r in spark.table("alerts").collect())
    assert got == [("2024-01-01 00:00:00", 2), ("2024-01-01 03:00:00", 1)]
