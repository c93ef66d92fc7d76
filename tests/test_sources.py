import json
import os

import pytest
from pyspark.sql import functions as F

from logwarden.plans.preprocess import labelled_records, preprocess
from logwarden.sources import hidden as H
from logwarden.sources import logs as L
from logwarden.sources import records as R


def tree(root, files):
    for rel, data in files.items():
        path = root / rel
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(root)


def label(line, *labels):
    return json.dumps({"line": line, "labels": list(labels), "rules": {l: ["r"] for l in labels}})


def by_file(lines):
    out = {}
    for r in lines.collect():
        out.setdefault(r["path"].rsplit("/", 1)[1], {})[r["line_no"]] = r["log"]
    return out


def test_lines_keep_raw_numbers_and_drop_blanks(spark, tmp_path):
    root = tree(
        tmp_path,
        {
            "a/x.log": "one\n\n \t\nfour\r\nfive\n  \nseven",
            "a/bad.log": b"ok \xff\xfe end\nnext\n",
            "a/.hidden.log": "no\n",
            "a/empty.log": "",
        },
    )
    got = by_file(L.log_lines(spark, root))
    assert got["x.log"] == {1: "one", 4: "four", 5: "five", 7: "seven"}
    assert got["bad.log"] == {1: "ok �� end", 2: "next"}
    assert set(got) == {"x.log", "bad.log"}
    compact = by_file(L.log_lines(spark, root, numbering="compact"))
    assert compact["x.log"] == {1: "one", 2: "four", 3: "five", 4: "seven"}


def test_files_that_readers_hide(spark, tmp_path, monkeypatch):
    text = "\n".join(f"line {i}" if i % 5 else "" for i in range(1, 400))
    root = tree(
        tmp_path / "a b",
        {"_app.log": text, "x/_sub/.deep.d/b.log": "one\r\ntwo\rthree", "x/.dot.log": "no", "x/_dot/.no": "no", "seen.log": "seen\n", "_e.log": "",
         "x/y/_bin.dat": b"a\x00b\nc", "x/y/_named": b"plain\n\xff\n", "k=v/_z.log": "zed\n"},
    )
    for size in (16 << 20, 64, 7, 1):
        if size == 1:
            root2 = tree(tmp_path / "small", {"_c.log": "one\r\ntwo\rthree\n\nfour", "d.log": "x"})
        monkeypatch.setattr(H, "RANGE_BYTES", size)
        got = by_file(L.log_lines(spark, root if size != 1 else root2))
        if size == 1:
            assert got["_c.log"] == {1: "one", 2: "two", 3: "three", 5: "four"}
        else:
            assert got["_app.log"] == {i: f"line {i}" for i in range(1, 400) if i % 5}
            assert got["b.log"] == {1: "one", 2: "two", 3: "three"} and got["_z.log"] == {1: "zed"}
            assert set(got) == {"_app.log", "b.log", "seen.log", "_bin.dat", "_named", "_z.log"}
        if size != 64:
            continue
        compact = by_file(L.log_lines(spark, root, numbering="compact"))
        assert compact["_app.log"] == {n: f"line {i}" for n, i in enumerate((i for i in range(1, 400) if i % 5), 1)}
    files = L.list_files(spark, root)
    assert {r["rel"] for r in files.collect()} >= {"_app.log", "x/_sub/.deep.d/b.log", "x/y/_bin.dat"}
    assert {r["rel"] for r in L.text_files(files, root).collect()} == {"_app.log", "x/_sub/.deep.d/b.log", "seen.log", "x/y/_named", "k=v/_z.log"}


def test_damaged_files_are_reported(spark, tmp_path):
    spark.range(40).repartition(3).write.parquet(str(tmp_path / "r/k=1"))
    good = sorted((tmp_path / "r/k=1").glob("*.parquet"))
    (tmp_path / "r/k=1/cut.parquet").write_bytes(good[0].read_bytes()[:-9])
    (tmp_path / "r/k=1/none.parquet").write_bytes(b"not a table")
    got = {r["file"].rsplit("/", 1)[1]: r["reason"] for r in R.damaged_files(spark, str(tmp_path / "r")).collect()}
    assert set(got) == {"cut.parquet", "none.parquet"} and all(got.values())
    assert spark.read.schema("id long").option("ignoreCorruptFiles", "true").parquet(str(tmp_path / "r")).count() == 40


@pytest.mark.parametrize("numbering", ["raw", "compact"])
def test_numbering_over_many_splits(spark, tmp_path, numbering):
    text = [("" if i % 7 == 0 else f"line {i} " + "x" * (i % 50)) for i in range(1, 3001)]
    root = tree(tmp_path, {"big.log": "\n".join(text) + "\n", "small.log": "only\n"})
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert spark.read.text(root).rdd.getNumPartitions() > 1
        got = by_file(L.log_lines(spark, root, numbering))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    kept = [(i, t) for i, t in enumerate(text, 1) if t]
    want = dict(kept) if numbering == "raw" else {n: t for n, (_, t) in enumerate(kept, 1)}
    assert got == {"big.log": want, "small.log": {1: "only"}}


def test_text_files_by_ending_and_head(spark, tmp_path):
    root = tree(
        tmp_path,
        {
            "bin.dat": b"abc\x00def",
            "late.dat": b"a" * 1024 + b"\x00",
            "named.txt": b"\x00\x01",
            "plain.log": b"caf\xe9 latin",
            "empty.log": b"",
            ".dot": b"x",
        },
    )
    got = {r["rel"] for r in L.text_files(L.list_files(spark, root), root).collect()}
    assert got == {"late.dat", "named.txt", "plain.log"}  # empty files hold no lines
    heads = spark.createDataFrame([(b"",), (b"a\x00",), (b"a" * 1024 + b"\x00",)], "h binary")
    assert [r[0] for r in heads.select(L.head_is_text(F.col("h"))).collect()] == [True, False, True]


def test_label_rows_are_skipped_one_by_one(spark, tmp_path):
    rows = [
        label(1, "a", "b"),
        "5",
        "not json",
        '{"line": 2}',
        '{"labels": ["z"]}',
        "",
        label(3, "old"),
        '{"line": 4, "labels": null}',
        '{"line": 5, "labels": "text"}',
        '{"line": 6, "labels": []}',
        label(3, "new"),
    ]
    root = tree(tmp_path, {"f.log": "\n".join(rows)})
    got = {r["line_no"]: r["y"] for r in L.label_lines(spark, root).collect()}
    assert got == {1: '["a","b"]', 3: '["new"]', 4: "null", 5: "text", 6: "[]"}


def matches(spark, logs, labels):
    frame = lambda names: spark.createDataFrame([(n,) for n in names], "rel string")
    return {
        r["log_rel"]: r["label_rel"]
        for r in L.match_label_files(frame(logs), frame(labels)).collect()
    }


def test_label_file_choice(spark):
    labels = ["d/web/x.log.1", "d/web/x.log.2", "e/web/x.log.1", "d/sys/y.log", "d/sys/y.json", "z/auth.log", "d/n.csv"]
    got = matches(
        spark,
        ["d/web/x.log.1", "e/web/x.log.1", "d/web/x.log.3", "d/sys/y.log", "q/auth", "d/none.log", "d/n.log", "d/x.txt"],
        labels,
    )
    assert got == {
        "d/web/x.log.1": "d/web/x.log.1",  # equal suffix, own directory
        "e/web/x.log.1": "e/web/x.log.1",
        "d/web/x.log.3": "d/web/x.log.1",  # numeric suffixes on both sides
        "d/sys/y.log": "d/sys/y.log",
        "q/auth": "z/auth.log",  # elsewhere, any suffix
        "d/none.log": None,
        "d/n.log": "d/n.csv",
        "d/x.txt": "d/web/x.log.1",  # stem x is a prefix; path order decides
    }


def test_records_end_to_end(spark, tmp_path):
    logs = tree(
        tmp_path / "logs",
        {
            "alpha/web/err.log.1": "l1\n\nl3\nl4\n",
            "alpha/web/err.log.2": "m1\n",
            "beta/web/err.log.1": "s1\ns2\n",
            "top.log": "t1\n",
            "alpha/web/raw.dat": b"\x00\x01",
        },
    )
    labels = tree(
        tmp_path / "labels",
        {
            "alpha/web/err.log.1": label(3, "attack", "x") + "\n" + label(99, "beyond"),
            "beta/web/err.log.1": label(2, "other"),
            "alpha/web/README.md": "not labels",
        },
    )
    got = {
        (r["path"], r["line_no"]): (r["log"], r["y"], r["dataset"], r["category"])
        for r in labelled_records(spark, logs, labels).collect()
    }
    assert got == {
        ("alpha/web/err.log.1", 1): ("l1", "[]", "alpha", "web"),
        ("alpha/web/err.log.1", 3): ("l3", '["attack","x"]', "alpha", "web"),
        ("alpha/web/err.log.1", 4): ("l4", "[]", "alpha", "web"),
        ("alpha/web/err.log.2", 1): ("m1", "[]", "alpha", "web"),
        ("beta/web/err.log.1", 1): ("s1", "[]", "beta", "web"),
        ("beta/web/err.log.1", 2): ("s2", '["other"]', "beta", "web"),
        ("top.log", 1): ("t1", "[]", "", ""),
    }
    out = str(tmp_path / "out")
    preprocess(spark, logs, labels, out)
    assert R.read_records(spark, out).where("dataset = 'alpha'").count() == 4


def test_damaged_files_and_missing_folders(spark, tmp_path):
    out = tmp_path / "records"
    rows = spark.createDataFrame([("p", 1, "log", "[]", "d", "c")], R.RECORD_SCHEMA)
    R.write_records(rows, str(out))
    (out / "dataset=d" / "category=c" / "part-bad.parquet").write_bytes(b"PAR1 garbage PAR1")
    assert R.read_records(spark, str(out)).count() == 1
    with pytest.raises(Exception):
        R.read_records(spark, str(tmp_path / "nowhere")).count()


def test_token_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text(
        "tokens,label\n"
        "\"['a', 'b c', \"\"it's\"\"]\",x\n"
        '"[""json"", ""list""]",y\n'
        "[],z\n"
        "__import__('os'),w\n"
    )
    got = {r["label"]: r["tokens"] for r in R.read_token_csv(spark, str(tmp_path / "t.csv")).collect()}
    assert got == {"x": ["a", "b c", "it's"], "y": ["json", "list"], "z": [], "w": None}


def test_reports(spark, tmp_path):
    table = spark.createDataFrame([("a", 1.0), ("b", 0.5)], "label string, f1 double")
    R.write_report(table, str(tmp_path / "csv"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).count() == 2
    R.write_text_report("title", table, str(tmp_path / "txt"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "txt")).collect()]
    assert lines[0] == "title" and lines[1].split() == ["label", "f1"] and lines[2].split() == ["a", "1.0"]


@pytest.mark.parametrize("how", ["absolute", "relative", "dotted"])
def test_odd_names_and_nested_roots(spark, tmp_path, how):
    files = {"a/logs/b/e.log": b"one\n", "b/e.log": b"two\n", "x y%20#1+.log": b"three\n", "bin.dat": b"a\x00b\n"}
    root = tree(tmp_path / "logs", files)
    if how != "absolute":
        root = os.path.relpath(root, spark._jvm.System.getProperty("user.dir"))
        root = root if how == "relative" else f"./{root}"
    listed = L.list_files(spark, root)
    assert {r["rel"] for r in listed.collect()} == set(files)
    text = L.text_files(listed, root)
    assert {r["rel"] for r in text.collect()} == set(files) - {"bin.dat"}
    lines = L.log_lines(spark, root, files=text).collect()
    assert {(r["rel"], r["line_no"], r["log"]) for r in lines} == {
        ("a/logs/b/e.log", 1, "one"), ("b/e.log", 1, "two"), ("x y%20#1+.log", 1, "three")
    }


def test_label_rows_are_strict_json(spark):
    values = ['{"line":1,"labels":["a"]}', "{'line':2,'labels':['a']}", '{"line":3,"labels":["a"]} junk', '{"line":4,"labels":["a"]},{"line":5,"labels":[]}', '[{"line":6,"labels":[]}]']
    rows = spark.createDataFrame([("p", i, v) for i, v in enumerate(values)], "path string, pos long, value string")
    assert [(r["line_no"], r["y"]) for r in L.parse_label_rows(rows).collect()] == [(1, '["a"]')]
