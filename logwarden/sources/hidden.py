"""Text files that Spark's readers hide: names that begin with ``_``, and what lies in
folders that begin with ``_`` or a dot.

They are found through the Hadoop file system, one listing for each depth of the tree,
and cut into byte ranges of ``RANGE_BYTES``; tasks read their ranges through Arrow's file
systems. A line belongs to the range in which it begins; lines end with ``\\n``, ``\\r`` or
both, as in Spark's own scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

RANGE_BYTES = 16 << 20
AHEAD = 1 << 16
SEEN = "uri string, start long, end long, i long, value binary"


def hidden_files(spark: SparkSession, root: str) -> list[tuple[str, int]]:
    """``(uri, length)`` of the files below ``root`` that Spark hides; dot files and empty ones stay out."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    level = re.sub(r"([\[\]{}*?\\])", r"\\\1", store.makeQualified(path).toString().rstrip("/"))
    hidden = lambda name: name.startswith(".") or (name.startswith("_") and "=" not in name)
    found: dict[str, int] = {}

    def add(status) -> None:
        if status.getLen() and not status.getPath().getName().startswith("."):
            found[status.getPath().toString()] = status.getLen()

    while True:
        for status in store.globStatus(jvm.org.apache.hadoop.fs.Path(level + "/{_*,.*}")) or []:
            if not hidden(status.getPath().getName()):
                continue
            if status.isFile():
                add(status)
                continue
            inside = store.listFiles(status.getPath(), True)
            while inside.hasNext():
                add(inside.next())
        level += "/*"
        if not len(store.globStatus(jvm.org.apache.hadoop.fs.Path(level)) or []):
            return sorted(found.items())


#: names of one store in Hadoop and in Arrow
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def opened(uri: str):
    """The file, for random reads. Hadoop writes paths without the escapes of a URI."""
    scheme, rest = re.fullmatch(r"(?s)(?:([A-Za-z][A-Za-z0-9+.-]*):)?(.*)", uri).groups()
    if scheme in (None, "file"):
        return fs.LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    store, path = fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{quote(rest)}")
    return store.open_input_file(path)


def range_lines(source, start: int, end: int) -> list[bytes]:
    """The lines that begin at places from ``start`` to ``end`` - 1."""
    size = source.size()
    end = min(end, size)
    if start >= end:
        return []
    before = 1 if start else 0
    source.seek(start - before)
    data = source.read(end - start + before)
    x = np.frombuffer(data, np.uint8)
    now, last = x[before:], np.concatenate([[10], x])[: len(x)][before:] if not before else x[:-1]
    begins = np.flatnonzero((last == 10) | ((last == 13) & (now != 10)))
    if not len(begins):
        return []
    # the last line may go on behind the range
    parts, step = [data[before + int(begins[-1]) :]], AHEAD
    while not re.search(rb"[\r\n]", parts[-1]):
        parts.append(source.read(step))
        if not parts[-1]:
            break
        step *= 2
    tail = b"".join(parts)
    out = [data[before + a : before + b] for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]
    return [re.sub(rb"(\r\n|\r|\n)\Z", b"", line) for line in out] + [re.split(rb"[\r\n]", tail, maxsplit=1)[0]]


def hidden_lines(spark: SparkSession, files: list[tuple[str, int]]) -> DataFrame:
    """``(uri, start, end, i, value)``: the lines of each range, numbered from 0."""
    ranges = [(uri, a, min(a + RANGE_BYTES, length)) for uri, length in files for a in range(0, length, RANGE_BYTES)]
    table = spark.createDataFrame(ranges, "uri string, start long, end long").repartition(max(1, min(10_000, len(ranges))))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with opened(uri) as source:
                    lines = range_lines(source, start, end)
                n = len(lines)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([uri] * n, pa.string()), pa.array([start] * n, pa.int64()), pa.array([end] * n, pa.int64()),
                        pa.array(range(n), pa.int64()), pa.array(lines, pa.binary()),
                    ],
                    ["uri", "start", "end", "i", "value"],
                )

    return table.mapInArrow(read, SEEN)
