"""Document fingerprints: invertible Bloom lookup sketches of paragraphs.

A text is a set of paragraph digests: lines, cut into runs of ``RUN_WORDS`` words
from the line's start, each hashed with the number of earlier equal ones, so
repeated paragraphs count. Each digest is added to ``HASHES`` cells of a sketch; a
cell holds a count, the xor of its digests and the xor of their check values. The
sketches of two versions are subtracted cell by cell, and peeling recovers the
digests that only one of them has: a cell with count 1 or -1 whose check value fits
gives a digest, which is taken out of its other cells, and so on. If cells remain,
both sketches are made anew with twice the cells, until peeling succeeds. Likeness
is the Jaccard similarity that follows: with d differing digests and sizes a and b,
(a + b - d) / (a + b + d); two empty texts are alike.

A fingerprint is the sketch with ``CELLS`` cells in hexadecimal. Equal texts have
equal fingerprints.

The edited text of a document takes its last quarter from the next document by
ascending id (after the last comes the first; a single document is its own next).
Null texts are empty texts; null ids come first, equal ids are ordered by their
text. Repeated rows each have a row of the result. Extra columns are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.llm.common import mixed_bits, slices, stream

CELLS = 32
HASHES = 3
RUN_WORDS = 8
ROWS_PER_RANGE = 5_000
SALTS = stream(9, HASHES)


def paragraphs(text: str) -> np.ndarray:
    """The digests of a text's paragraphs."""
    seen: dict[str, int] = {}
    out = []
    for line in text.split("\n"):
        words = line.split(" ")
        for i in range(0, len(words), RUN_WORDS):
            run = " ".join(words[i : i + RUN_WORDS])
            n = seen[run] = seen.get(run, -1) + 1
            out.append(xxhash.xxh3_64_intdigest(run, n))
    return np.unique(np.array(out, np.uint64))


def _places(keys: np.ndarray, cells: int) -> np.ndarray:
    """The cells of each digest: one in each third of the sketch."""
    third = cells // HASHES
    parts = [mixed_bits(keys + salt) % np.uint64(third) + np.uint64(h * third) for h, salt in enumerate(SALTS)]
    return np.stack(parts).astype(np.int64)


def _check(keys: np.ndarray) -> np.ndarray:
    return mixed_bits(keys ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(0xFFFFFFFF)


def sketch(keys: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, digest xors and check xors of the cells (a multiple of ``HASHES``)."""
    cells -= cells % HASHES
    at = _places(keys, cells).ravel()
    count = np.bincount(at, minlength=cells).astype(np.int32)
    xor, check = np.zeros(cells, np.uint64), np.zeros(cells, np.uint64)
    np.bitwise_xor.at(xor, at, np.tile(keys, HASHES))
    np.bitwise_xor.at(check, at, np.tile(_check(keys), HASHES))
    return count, xor, check


def fingerprint(keys: np.ndarray, cells: int = CELLS) -> str:
    count, xor, check = sketch(keys, cells)
    return np.rec.fromarrays([count.astype("<i4"), xor.astype("<u8"), check.astype("<u4")]).tobytes().hex()


def differences(pairs: list[tuple[np.ndarray, np.ndarray]], cells: int = CELLS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pair of digest sets, the digests that only the first, or only the second, has.

    All pairs are peeled together, each in its own stretch of cells; the pairs that
    fail go on with twice the cells.
    """
    none = np.zeros(0, np.uint64)
    out = [(none, none)] * len(pairs)
    todo, cells = list(range(len(pairs))), cells - cells % HASHES
    while todo:
        keys = np.concatenate([k for i in todo for k in pairs[i]])
        sides = np.array([len(k) for i in todo for k in pairs[i]])
        sign = np.repeat(np.tile([1, -1], len(todo)), sides)
        pair = np.repeat(np.arange(len(todo)).repeat(2), sides)
        at = _places(keys, cells) + pair * cells
        size = cells * len(todo)
        count = np.zeros(size, np.int64)
        xor, check = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        proof = _check(keys)
        for row in at:
            count += np.bincount(row, sign, minlength=size).astype(np.int64)
            np.bitwise_xor.at(xor, row, keys)
            np.bitwise_xor.at(check, row, proof)
        got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        look = np.arange(size)
        while len(look):
            pure = look[np.abs(count[look]) == 1]
            pure = pure[check[pure] == _check(xor[pure])]
            if not len(pure):
                break
            key, owner = xor[pure], pure // cells
            home = _places(key, cells) + owner * cells
            own = (home == pure).any(0)  # a digest sits in one of its own cells
            first = np.unique(np.stack([owner[own].astype(np.uint64), key[own]]), axis=1, return_index=True)[1]
            key, owner, of = key[own][first], owner[own][first], count[pure][own][first]
            home = home[:, own][:, first]
            got.append((owner, key, of))
            for row in home:
                np.subtract.at(count, row, of)
                np.bitwise_xor.at(xor, row, key)
                np.bitwise_xor.at(check, row, _check(key))
            look = np.unique(home)
        failed = np.unique(np.flatnonzero((count != 0) | (xor != 0) | (check != 0)) // cells)
        owner, key, of = (np.concatenate(x) if got else none for x in (zip(*got, strict=True) if got else ((), (), ())))
        order = np.argsort(owner, kind="stable")
        owner, key, of = owner[order], key[order], of[order]
        for n, i in enumerate(todo):
            a, b = np.searchsorted(owner, [n, n + 1])
            out[i] = key[a:b][of[a:b] > 0], key[a:b][of[a:b] < 0]
        todo, cells = [todo[n] for n in failed], cells * 2
    return out


def likeness(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[float]:
    values = []
    for (a, b), (x, y) in zip(pairs, differences(pairs), strict=True):
        total, apart = len(a) + len(b), len(x) + len(y)
        values.append((total - apart) / (total + apart) if total else 1.0)
    return values


def _range_of(value: Column, cuts: list) -> Column:
    """How many of the sorted cuts are not above the value: by groups first, then within one."""
    if not cuts:
        return F.lit(0)
    width = int(len(cuts) ** 0.5) + 1
    groups = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    below = lambda array: F.size(F.filter(array, lambda c: c <= value))
    group = below(F.array(*(F.lit(g[0]) for g in groups))) - 1
    inside = below(F.get(F.array(*(F.array(*map(F.lit, g)) for g in groups)), group))
    return F.when(value.isNull() | (group < 0), 0).otherwise(group * width + inside)


def with_next(docs: DataFrame, id_col: str, text_col: str, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """The rows in id order by range, each range followed by the first of the next one.

    Ranges are cut at quantiles of the ids. Only the cuts and the first id of each
    range go through the driver, one for each ``rows_per_range`` rows.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = base.count()
    ranges = max(1, min(20_000, -(-total // rows_per_range)))
    cuts: list = []
    if ranges > 1:
        found = base.select(
            F.percentile_approx("id", [i / ranges for i in range(1, ranges)], 10 * ranges)
        ).first()[0]
        cuts = sorted(set(found or []))
    placed = base.withColumn("range", _range_of(F.col("id"), cuts))
    # the least id of each range that has rows; nulls come first
    rows = placed.groupBy("range").agg(F.min("id").alias("id"), F.max(F.col("id").isNull()).alias("none"))
    firsts = rows.orderBy("range").collect()
    least, hosts = [None] * (len(cuts) + 1), [None] * (len(cuts) + 1)
    for here, after in zip(firsts, [*firsts[1:], *firsts[:1]], strict=True):
        least[after["range"]] = None if after["none"] else after["id"]
        hosts[after["range"]] = here["range"]
    of_range = lambda values, kind: F.get(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), F.col("range"))
    is_first = F.col("id").eqNullSafe(of_range(least, dict(placed.dtypes)["id"]))
    own = F.struct("range", F.lit(False).alias("guest"))
    guest = F.when(is_first, F.struct(of_range(hosts, "int").alias("range"), F.lit(True).alias("guest")))
    spread = placed.withColumn("_p", F.explode(F.filter(F.array(own, guest), lambda p: p.isNotNull())))
    return (
        spread.select("id", "text", "_p.range", "_p.guest")
        .repartition(max(1, len(firsts)), "range")
        .sortWithinPartitions("range", "guest", F.col("id").asc_nulls_first(), F.xxhash64("text"), "text")
    )


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The fingerprints of each text and of its edited text, and their likeness.

    A range is read in order; only the last document waits for the next one.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = f"`{id_col}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def rows_of(done: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        ids, texts, keys, afters, after_keys = zip(*done, strict=True)
        edited = []
        for text, after in zip(texts, afters, strict=True):
            cut = len(text) // 4
            edited.append(text[: len(text) - cut] + after[:cut])
        edited_keys = [k if t == e else paragraphs(e) for t, e, k in zip(texts, edited, keys, strict=True)]
        near_edited = likeness(list(zip(keys, edited_keys, strict=True)))
        near_next = likeness(list(zip(keys, after_keys, strict=True)))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, id_type),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
                pa.array([fingerprint(k) for k in keys]),
                pa.array([fingerprint(k) for k in edited_keys]),
                pa.array(near_edited, pa.float64()),
                pa.array(near_next, pa.float64()),
            ],
            names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (range, id, text, digests) of the document that waits
        for batch in slices(batches, "text"):
            done = []
            for id_, text, place, guest in zip(
                batch.column("id").to_pylist(), batch.column("text").to_pylist(),
                batch.column("range").to_pylist(), batch.column("guest").to_pylist(), strict=True,
            ):
                keys = paragraphs(text)
                if last is not None and last[0] == place:
                    done.append((last[1], last[2], last[3], text, keys))
                last = None if guest else (place, id_, text, keys)
            if done:
                yield rows_of(done, batch.schema.field("id").type)

    return with_next(docs, id_col, text_col).mapInArrow(run, schema)


def op9_fingerprints(spark, sf_dir: str) -> DataFrame:
    return compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
