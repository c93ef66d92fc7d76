"""Line numbers of logs that arrive in pieces."""

import numpy as np
import pandas as pd

from logwarden.streaming import numbering
from logwarden.streaming.numbering import BucketLineNumbers, LineNumbers, numbered_pieces


class Value:
    def __init__(self):
        self.held = None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value


class Map(dict):
    def containsKey(self, key):
        return key in self

    def getValue(self, key):
        return self[key]

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        del self[key]


class Handle:
    def getValueState(self, name, schema):
        return Value()

    def getMapState(self, name, key, value):
        return Map()


def test_any_order_and_cut_gives_the_same_numbers():
    rng = np.random.default_rng(8)
    for trial in range(60):
        text = "".join(rng.choice(list("ab\n"), int(rng.integers(0, 40))))
        cuts = sorted(rng.integers(0, len(text) + 1, int(rng.integers(0, 6))).tolist())
        pieces = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
        rows = [(k, k == len(pieces) - 1, p) for k, p in enumerate(pieces)]
        order = rng.permutation(len(rows)).tolist()
        order += order[:1]  # one comes twice
        lines, processor = [], LineNumbers()
        processor.init(Handle())
        while order:
            n = int(rng.integers(1, 4))
            now, order = order[:n], order[n:]
            frame = pd.DataFrame([rows[k] for k in now], columns=["seq", "last", "text"])
            for out in processor.handleInputRows(("x",), iter([frame]), None):
                assert set(out["path"]) <= {"x"} and str(out["line_no"].dtype) == "int64"
                lines += list(zip(out["line_no"], out["log"]))
        assert lines == list(enumerate(text.split("\n"), 1)), (text, cuts)
        assert not processor.waiting and processor.place.held[3] == 0


def test_pieces_of_growing_logs_are_numbered(spark, tmp_path):
    batches = [
        [("a", 0, False, "one\ntw"), ("b", 2, True, "z\n"), ("c", 0, True, "")],
        [("a", 1, False, "o\n\n"), ("b", 0, False, "x"), ("a", 0, False, "sent again")],
        [("b", 1, False, "y\n"), ("a", 2, True, "four\nfive"), ("a", 9, False, "never its turn")],
    ]
    schema = "path string, seq bigint, last boolean, text string"
    stream = numbered_pieces(spark.readStream.schema(schema).parquet(str(tmp_path / "in")) if (tmp_path / "in").mkdir() is None else None)
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        run.trigger(availableNow=True).start().awaitTermination(120)
    got = {}
    for r in spark.read.parquet(str(tmp_path / "out")).collect():
        assert r["line_no"] not in got.setdefault(r["path"], {})
        got[r["path"]][r["line_no"]] = r["log"]
    assert got == {"a": {1: "one", 2: "two", 4: "four", 5: "five"}, "b": {1: "xy", 2: "z"}}


class Counted(Handle):
    """States that count their operations."""

    def __init__(self):
        self.calls = 0

    def counted(self, state):
        for name in ("get", "update", "containsKey", "getValue", "updateValue", "removeKey"):
            if hasattr(state, name):
                setattr(state, name, self.counting(getattr(state, name)))
        return state

    def counting(self, operation):
        def call(*arguments):
            self.calls += 1
            return operation(*arguments)

        return call

    def getValueState(self, name, schema):
        return self.counted(Value())

    def getMapState(self, name, key, value):
        return self.counted(Map())


def cut_logs(rng, n, most):
    logs, rows = {}, []
    for i in range(n):
        path = None if i == 0 else f"log {i}"
        logs[path] = text = "".join(rng.choice(list("ab\n"), int(rng.integers(0, 40))))
        cuts = sorted(rng.integers(0, len(text) + 1, int(rng.integers(0, most))).tolist())
        pieces = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
        rows += [(path, k, k == len(pieces) - 1, p) for k, p in enumerate(pieces)]
    order = rng.permutation(len(rows)).tolist()
    return logs, [rows[k] for k in order + order[: n // 4]]  # some come twice


def bucket_lines(processor, rows, frames=1):
    step, lines = -(-len(rows) // frames), []
    parts = [pd.DataFrame(rows[i : i + step], columns=["path", "seq", "last", "text"]) for i in range(0, len(rows), step)]
    for out in processor.handleInputRows((7,), iter(parts), None):
        assert len(out) and str(out["line"].dtype) == "int64"
        for path, line, text in zip(out["path"], out["line"], out["text"]):
            lines += [(path, line + i, log) for i, log in enumerate(text.split("\n"))]
    return lines


def test_a_bucket_of_logs_gives_the_same_numbers(monkeypatch):
    rng = np.random.default_rng(16)
    for trial in range(40):
        monkeypatch.setattr(numbering, "CHUNK", int(rng.integers(1, 60)))
        logs, rows = cut_logs(rng, int(rng.integers(1, 9)), 6)
        lines, processor = [], BucketLineNumbers()
        processor.init(Handle())
        while rows:
            n = int(rng.integers(1, 12))
            now, rows = rows[:n], rows[n:]
            lines += bucket_lines(processor, now, int(rng.integers(1, 4)))
            places, waits, _ = processor.bucket.held
            assert {number for *_, number in waits} == {number for (number,) in processor.chunks}
            assert sum(len(pieces) for (pieces,) in processor.chunks.values()) <= 2 * len(waits) == 2 * sum(p[4] for p in places)
        assert not processor.chunks and not processor.bucket.held[1]
        assert sorted(lines, key=str) == sorted(((p, i, log) for p, text in logs.items() for i, log in enumerate(text.split("\n"), 1)), key=str)


def test_state_calls_do_not_grow_with_the_logs():
    rng = np.random.default_rng(3)
    for n in (20, 500):
        logs, rows = cut_logs(rng, n, 4)
        handle, processor, lines = Counted(), BucketLineNumbers(), []
        processor.init(handle)
        for batch in range(3):
            lines += bucket_lines(processor, rows[batch * len(rows) // 3 : (batch + 1) * len(rows) // 3])
        assert len(lines) == sum(text.count("\n") + 1 for text in logs.values())
        assert handle.calls <= 3 * 6


def test_a_stream_of_many_logs_keeps_waiting_pieces(spark, tmp_path):
    logs, rows = cut_logs(np.random.default_rng(5), 40, 5)
    schema = "path string, seq bigint, last boolean, text string"
    (tmp_path / "in").mkdir()
    stream = numbered_pieces(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), buckets=3)
    for batch in range(3):
        now = rows[batch * len(rows) // 3 : (batch + 1) * len(rows) // 3]
        spark.createDataFrame(now, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
    run.trigger(availableNow=True).start().awaitTermination(120)
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("path", "line_no", "log").collect()]
    assert stream.columns == ["path", "line_no", "log"]
    assert sorted(got, key=str) == sorted(
        ((p, i, log) for p, text in logs.items() for i, log in enumerate(text.split("\n"), 1) if log), key=str
    )
