"""Words, hashes and batches for the operators that run in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20


def mixed_bits(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix, so that all bits of the result depend on all of ``x``."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    return mixed_bits((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15))


BYTE_VALUE = stream(1, 256)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
STEP = np.uint64(0x9E3779B97F4A7C15)


def slices(batches: Iterable[pa.RecordBatch], column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces whose texts take about ``size`` bytes, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        piece = np.cumsum(lengths) // size
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and the n + 1 places where texts begin and end."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word, A-Z taken as a-z, and the n + 1 places where texts begin in them.

    A word is a longest run of bytes other than 0x20 and 0x09 to 0x0D.
    """
    solid = ~SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges], last[edges - 1] = solid[edges], solid[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    lengths = ends - starts
    at = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(at, lengths)
    power = np.cumprod(np.full(int(lengths.max()), STEP), dtype=np.uint64)
    value = BYTE_VALUE[LOWER[data[solid]]] * power[place]
    hashes = mixed_bits(np.add.reduceat(value, at) + lengths.astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets)


def fresh(taken: list[str], name: str) -> str:
    """``name``, with underscores until no column of ``taken`` has it."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def crc32_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, from the table of its rule; DuckDB has no function for it."""
    table = []
    for byte in range(256):
        for _ in range(8):
            byte = (byte >> 1) ^ (0xEDB88320 if byte & 1 else 0)
        table.append(byte)
    digits = f"hex(encode({text}))"
    each = f"list_transform(range(strlen({text})), lambda i: ('0x' || substr(x16, 2 * i::bigint + 1, 2))::bigint)"
    return (
        f"(select xor(list_reduce([4294967295::bigint] || {each}, "
        f"lambda a, b: xor(a >> 8, ({table}::bigint[])[(xor(a, b) & 255) + 1])), 4294967295) from (select {digits} x16))"
    )
