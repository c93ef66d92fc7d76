"""Line numbers of logs that arrive in pieces."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from logwarden.functions.text import not_blank

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NUMBERED = "path string, line_no bigint, log string"
PLACE = "seq bigint, line bigint, tail string, waiting bigint"
PIECE = "text string, last boolean"
START = (0, 1, "", 0)

# what a bucket of logs keeps and hands out
BUCKETS = 4096
CHUNK = 1 << 18  # characters
LOG = "path: string, seq: bigint, line: bigint, tail: string, waiting: bigint"
BUCKET = f"logs array<struct<{LOG}>>, waits array<struct<path: string, seq: bigint, chunk: bigint>>, chunks bigint"
PIECES = "pieces array<struct<path: string, seq: bigint, text: string, last: boolean>>"
RUNS = "path string, line bigint, text string"


class LineNumbers(StatefulProcessor):
    """Keeps, for each log, the next piece and line number, the line that the last piece
    has broken off, and pieces that came before their turn. A key is a log."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", PLACE)
        self.waiting = handle.getMapState("waiting", "seq bigint", PIECE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        here = {s: piece for part in rows for s, piece in pieces_in(part)}
        place, runs = advanced(self.place.get() or START, here, self.waiting)
        self.place.update(place)
        lines = [(key[0], first + i, log) for first, text in runs for i, log in enumerate(text.split("\n"))]
        yield frame(NUMBERED, lines)

    def close(self) -> None:
        pass


class BucketLineNumbers(StatefulProcessor):
    """The same for many logs a key: a call takes a bucket's pieces of a batch, reads and
    writes one row for all its logs, and keeps waiting pieces by the chunk."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bucket = handle.getValueState("bucket", BUCKET)
        self.chunks = handle.getMapState("chunks", "chunk bigint", PIECES)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        logs, waits, chunks = self.bucket.get() or ([], [], 0)
        places = {path: tuple(place) for path, *place in logs}
        waiting = Waiting(self.chunks, waits, chunks)
        for part in rows:
            here, out = {}, []
            for path, (s, piece) in zip(part["path"], pieces_in(part), strict=True):
                here.setdefault(path if isinstance(path, str) else None, {})[s] = piece
            for path, pieces in here.items():
                places[path], runs = advanced(places.get(path, START), pieces, waiting, (path,))
                out += [(path, *run) for run in runs]
            if out:
                yield frame(RUNS, out)
        waits, chunks = waiting.written()
        self.bucket.update(([(path, *place) for path, place in places.items()], waits, chunks))

    def close(self) -> None:
        pass


class Waiting:
    """A bucket's waiting pieces by log and number, over a state of numbered chunks.

    Pieces that begin to wait in a batch are written as chunks of about ``CHUNK``
    characters, and a chunk is read when a piece of it is due. It goes once half of its
    pieces are used; the others are written anew.
    """

    def __init__(self, state, waits: list[tuple], chunks: int) -> None:
        self.state, self.chunks = state, chunks
        self.at = {(path, s): chunk for path, s, chunk in waits}
        self.new, self.read = {}, {}

    def chunk(self, number: int) -> dict:
        if number not in self.read:
            (pieces,) = self.state.getValue((number,))
            self.read[number] = {(path, s): piece for path, s, *piece in pieces}
        return self.read[number]

    def containsKey(self, at: tuple) -> bool:
        return at in self.new or at in self.at

    def getValue(self, at: tuple) -> tuple[str, bool]:
        return self.new[at] if at in self.new else self.chunk(self.at[at])[at]

    def removeKey(self, at: tuple) -> None:
        if self.new.pop(at, None) is None:
            self.chunk(self.at.pop(at))

    def updateValue(self, at: tuple, piece: tuple[str, bool]) -> None:
        if at in self.at:
            self.removeKey(at)
        self.new[at] = piece

    def written(self) -> tuple[list[tuple], int]:
        """Brings the state up to date; where the pieces lie now, and the next chunk's number."""
        left = {number: [] for number in self.read}
        for at, number in self.at.items():
            if number in left:
                left[number].append(at)
        for number, ats in left.items():
            if 2 * len(ats) <= len(self.read[number]):
                self.new |= {at: self.read[number][at] for at in ats}
                self.state.removeKey((number,))
        pieces, size = [], 0
        for k, (at, piece) in enumerate(self.new.items(), 1):
            pieces.append((*at, *piece))
            self.at[at] = self.chunks
            size += len(piece[0])
            if size >= CHUNK or k == len(self.new):
                self.state.updateValue((self.chunks,), (pieces,))
                self.chunks, pieces, size = self.chunks + 1, [], 0
        return [(*at, number) for at, number in self.at.items()], self.chunks


def advanced(place: tuple, here: dict, waiting, log: tuple = ()) -> tuple[tuple, list]:
    """A log's place after the pieces at hand, and ``(number of the first line, text)`` of
    the whole lines that each piece has ended. ``waiting`` has the log's pieces by
    ``(*log, seq)``."""
    (seq, line, tail, kept), runs = place, []
    while True:
        at = (*log, seq)
        waited = kept and waiting.containsKey(at)
        if not waited and seq not in here:
            break
        text, last = here.pop(seq) if seq in here else waiting.getValue(at)
        if waited:
            waiting.removeKey(at)
            kept -= 1
        whole, end, rest = (text, "\n", "") if last else text.rpartition("\n")
        if end:
            runs.append((line, tail + whole))
            line += whole.count("\n") + 1
        tail, seq = rest if end else tail + rest, seq + 1
    for s, piece in here.items():
        if s > seq:  # what is behind has been numbered already
            kept -= kept and waiting.containsKey((*log, s))  # sent again
            waiting.updateValue((*log, s), piece)
            kept += 1
    return (seq, line, tail, kept), runs


def pieces_in(part: pd.DataFrame) -> Iterator[tuple[int, tuple[str, bool]]]:
    for s, text, last in zip(part["seq"], part["text"], part["last"], strict=True):
        yield int(s), (text if isinstance(text, str) else "", bool(last))


def frame(schema: str, rows: list[tuple]) -> pd.DataFrame:
    fields = [field.split() for field in schema.split(", ")]
    columns = zip(*rows) if rows else [()] * len(fields)
    kinds = {"string": object, "bigint": "int64"}
    return pd.DataFrame({name: pd.Series(values, dtype=kinds[kind]) for (name, kind), values in zip(fields, columns, strict=True)})


def numbered_pieces(pieces: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``(path, line_no, log)`` of a stream of ``(path, seq, last, text)``.

    A log comes in pieces 0, 1, 2 ... that may cut a line and may arrive in any order;
    the one marked ``last`` ends its last line. Every piece is numbered once its
    predecessors are there, and blank lines count but are left out, as in the batch form.
    State is one small row a log, and the pieces that still wait. A piece that is sent
    again is numbered once.

    Logs are dealt into ``buckets``, the keys of the state, so that calls of Python and
    of the state do not grow with the logs; Python hands back whole lines piece by piece,
    and Spark cuts them. A batch reads and writes the small rows of all logs of a bucket
    that it has a piece of, so many millions of logs want more ``buckets``. They must stay
    the same for a checkpoint.
    """
    spark = pieces.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    bucket = F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int").alias("bucket")
    runs = pieces.select(bucket, "path", "seq", "last", "text").groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=BucketLineNumbers(), outputStructType=RUNS, outputMode="Append", timeMode="None"
    )
    lines = runs.select("path", "line", F.posexplode(F.split("text", "\n")).alias("pos", "log"))
    return lines.select("path", (F.col("line") + F.col("pos")).alias("line_no"), "log").where(not_blank(F.col("log")))
