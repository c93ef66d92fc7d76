"""Sums of rows by segment, and blocks of lists, in numpy and Arrow."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

FEW = 64
OUT_ROWS = 1 << 18  # handed out by a task at once


def segment_sums(take: Callable[[np.ndarray], np.ndarray], first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each segment, the sum of the rows ``take`` gives for ``first`` and the places after it.

    All segments' next rows are added at once; the few that are much longer, on their
    own. For short segments of wide rows this takes a fraction of ``np.add.reduceat``.
    """
    out, live, k = take(first).copy(), np.flatnonzero(counts > 1), 1
    while len(live) > FEW:
        out[live] += take(first[live] + k)
        k += 1
        live = live[counts[live] > k]
    for i in live:
        out[i] += take(np.arange(first[i] + k, first[i] + counts[i])).sum(axis=0)
    return out


def starts_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal keys begin, and how long they are."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return first, np.diff(np.append(first, len(keys)))


def sums_by(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sum of the rows of each."""
    order = np.argsort(keys, kind="stable")
    first, counts = starts_of(keys[order])
    return keys[order[first]], segment_sums(lambda i: values[order[i]], first, counts)


def list_blocks(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.Array]:
    """The lists of a task, in blocks of about ``most`` elements."""
    held, n = [], 0
    for batch in batches:
        lists, at = batch.column(column), 0
        ends = np.asarray(lists.offsets)
        while at < len(lists):
            upto = max(at + 1, int(np.searchsorted(ends, ends[at] + most - n, side="right")) - 1)
            held.append(lists.slice(at, upto - at))
            n += int(ends[upto] - ends[at])
            at = upto
            if n >= most:
                yield pa.concat_arrays(held)
                held, n = [], 0
    if held:
        yield pa.concat_arrays(held)


def named(values: pa.Array, places: np.ndarray) -> pa.Array:
    """The values at places, null for place -1."""
    return values.take(pa.array(places, mask=places < 0))
