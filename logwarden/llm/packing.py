"""Packing of token sequences by non-negative least squares over lengths.

Every document becomes token ids and an end id. Its full windows are sequences of
their own; what is left is a tail of less than a window. The tails are packed by
their histogram alone, which has at most ``window - 1`` lengths however many
documents there are:

1. shallow combinations of two or three lengths that fill a window exactly are
   enumerated, and their repeat counts solved by non-negative least squares
   against the histogram (accelerated projected gradient);
2. the counts are rounded, and lowered where a length runs out;
3. residual tails are packed greedily, longest first; the gap takes the longest
   tail that fits, and if none fits, the head of a tail that is cut for it.

Cuts and counts work on ranges of tails of one length ("the tails of length r with
ranks a to b"), so the plan is as small as the histogram. It goes to the pieces by
length and rank. Ranks come from hash buckets, so a length that most documents
share is no single group. All sequences are full but the last one.

Null texts are empty and still hold the end id. Repeated rows are packed as
documents of their own, told apart by a row number. Extra columns are ignored.
An empty table gives no pieces. The token ids are stored once, two bytes each where
the vocabulary allows.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logwarden.llm.common import slices
from logwarden.session import stored

WINDOW = 2048
END_ID = 1
CACHE_PIECES = 200_000
GRID = 16
STEPS = 300
RANK_BUCKETS = 4096


# ------------------------------------------------------------------- token ids
# How the tokenizer file splits lower-case text of ASCII and Latin-1 letters, and the
# characters it shows for bytes.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^\sa-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
PLAIN = re.compile("[\t\n !-~\u00c0-\u00ff]*")
SHOWN = {b: b for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
SHOWN |= {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in SHOWN)}


class Pieces(dict):
    """Token ids, as bytes, by piece of lower-case text; grows as pieces come up.

    At ``CACHE_PIECES`` it starts anew, and takes over from the last table the pieces
    that come up again.
    """

    def __init__(self, model, width: int) -> None:
        self.model, self.width, self.last = model, width, {}

    def bytes_of(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.width == 2 else 'I'}", *ids)

    def __missing__(self, piece: str) -> bytes:
        found = self.last.get(piece)
        if found is None:
            shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(SHOWN)
            found = self.bytes_of([t.id for t in self.model.tokenize(shown)])
        self[piece] = found
        return found


class Encoder:
    """Token ids of texts, as bytes.

    The tokenizer lowers the case, splits a text into pieces and works piece by
    piece. Texts of ASCII and Latin-1 letters are split here, and each piece goes to
    the tokenizer's model once; all others go to the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.width = 2 if self.full.get_vocab_size() <= 1 << 16 else 4
        self.pieces = Pieces(self.full.model, self.width)

    def encode(self, text: str) -> bytes:
        if "<|" in text or not PLAIN.fullmatch(text):
            return self.pieces.bytes_of(self.full.encode(text, add_special_tokens=False).ids)
        if len(self.pieces) > CACHE_PIECES:
            self.pieces.last = dict(self.pieces)
            self.pieces.clear()
        return b"".join([self.pieces[p] for p in PIECES.findall(text.lower())])


def tokenise(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, id, ids (bytes), width, n: the ids of each text and the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Encoder(path)
        end = table.pieces.bytes_of([END_ID])
        for batch in slices(batches, "text"):
            ids = [table.encode(t or "") + end for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(ids, pa.binary()),
                    pa.array([table.width] * len(ids), pa.int32()),
                    pa.array([len(i) // table.width for i in ids], pa.int64()),
                ],
                ["id", "ids", "width", "n"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids binary, width int, n long").withColumn(
        "row", F.monotonically_increasing_id()
    )


# ------------------------------------------------------------------------ plan
def combinations(lengths: np.ndarray, window: int, grid: int = GRID) -> np.ndarray:
    """Pairs and triples of present lengths that fill a window; unused places are 0.

    All pairs, and the triples whose two smaller lengths are multiples of ``grid``
    or the same as each other.
    """
    have = np.zeros(window + 1, bool)
    have[lengths] = True
    found = [(window - b, b, 0) for b in lengths if b <= window - b and have[window - b]]
    small = [x for x in lengths if x <= window // 2 and x % grid == 0]
    thirds = list(combinations_with_replacement(small, 2)) + [(x, x) for x in lengths if x % grid]
    for a, b in thirds:
        c = window - a - b
        if c >= max(a, b) and have[c]:
            found.append((c, max(a, b), min(a, b)))
    return np.array(sorted(set(found), reverse=True), np.int64).reshape(-1, 3)


def solve_counts(combos: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """x >= 0 that brings the lengths used by the combinations near the histogram."""
    if not len(combos):
        return np.zeros(0)
    used = combos > 0
    flat, weight = combos.ravel(), np.repeat(1.0, 3 * len(combos)) * used.ravel()

    def residual(x: np.ndarray) -> np.ndarray:
        return np.bincount(flat, weight * np.repeat(x, 3), minlength=len(histogram)) - histogram

    v = np.ones(len(combos))  # largest eigenvalue of A'A by power iteration
    for _ in range(20):
        v = ((residual(v) + histogram)[combos] * used).sum(1)
        bound = np.linalg.norm(v)
        v /= bound
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - (residual(y)[combos] * used).sum(1) / (bound * 1.05))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


class Ranges:
    """What is left to pack: for each length, stacks of (tail, from, first rank, count)."""

    def __init__(self, histogram: np.ndarray) -> None:
        self.left = histogram.astype(np.int64).copy()
        self.stacks: dict[int, list[list[int]]] = {
            int(r): [[int(r), 0, 0, int(histogram[r])]] for r in np.flatnonzero(histogram)
        }

    def take(self, length: int, count: int) -> list[tuple[int, int, int, int]]:
        """Ranges of ``count`` pieces of a length."""
        out = []
        self.left[length] -= count
        while count:
            top = self.stacks[length][-1]
            n = min(count, top[3])
            out.append((top[0], top[1], top[2], n))
            top[2], top[3], count = top[2] + n, top[3] - n, count - n
            if not top[3]:
                self.stacks[length].pop()
        return out

    def give(self, length: int, ranges: list[tuple[int, int, int, int]]) -> None:
        for r in ranges:
            self.stacks.setdefault(length, []).append(list(r))
            self.left[length] += r[3]


def plan(histogram: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int, int, int, int, int]]:
    """Rows (tail, start, length, first rank, count, first sequence, offset).

    The tails of a length with ranks from ``first rank`` on give their tokens from
    ``start`` to sequences from ``first sequence`` on, at ``offset``.
    """
    rows: list[tuple[int, int, int, int, int, int, int]] = []
    todo, sequence = Ranges(histogram), 0

    def place(parts: list[tuple[int, list[tuple[int, int, int, int]]]], count: int) -> None:
        """``count`` sequences, each with one piece of every part."""
        nonlocal sequence
        offset = 0
        for length, ranges in parts:
            at = sequence
            for tail, start, rank, n in ranges:
                rows.append((tail, start, length, rank, n, at, offset))
                at += n
            offset += length
        sequence += count

    combos = combinations(np.flatnonzero(histogram), window)
    counts = solve_counts(combos, histogram.astype(float))
    for k in np.argsort(-counts, kind="stable"):
        want = int(counts[k] + 0.5)
        if not want:
            break
        lengths, times = np.unique(combos[k][combos[k] > 0], return_counts=True)
        want = min(want, int((todo.left[lengths] // times).min()))
        if want:
            place([(int(x), todo.take(int(x), want)) for x in combos[k] if x], want)
    while todo.left.any():
        longest = int(np.flatnonzero(todo.left)[-1])
        count = int(todo.left[longest])
        parts, gap = [(longest, 1)], window - longest
        used = {longest: 1}
        while gap:
            free = np.array([x for x in np.flatnonzero(todo.left) if todo.left[x] > used.get(int(x), 0)], int)
            fits = free[free <= gap]
            if not len(fits):
                break
            x = int(fits[-1])
            used[x] = used.get(x, 0) + 1
            parts.append((x, 1))
            gap -= x
        cut = int(free[free > gap][0]) if gap and len(free[free > gap]) else 0
        if cut:
            used[cut] = used.get(cut, 0) + 1
        count = min(int(todo.left[x]) // n for x, n in used.items())
        taken = [(x, todo.take(x, count)) for x, _ in parts]
        if cut:
            ranges = todo.take(cut, count)
            taken.append((gap, ranges))
            todo.give(cut - gap, [(t, s + gap, r, n) for t, s, r, n in ranges])
        place(taken, count)
    return rows


# ---------------------------------------------------------------------- pieces
PLAN = "tail int, start int, length int, rank long, count long, sequence long, offset int"


def ranked(df: DataFrame, keys: list[str], by: str, buckets: int = RANK_BUCKETS) -> DataFrame:
    """Adds ``rank`` from 0 within ``keys``; ``by`` is unique. Runs in hash buckets of each key."""
    df = df.withColumn("_b", F.pmod(F.xxhash64(by), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(*keys, "_b").count().select(
        *keys, "_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_s")
    )
    within = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(by)) - 1
    return df.withColumn("_w", within).join(starts, [*keys, "_b"]).withColumn(
        "rank", F.col("_s") + F.col("_w")
    ).drop("_b", "_s", "_w")


def pieces(lengths: DataFrame, window: int = WINDOW) -> DataFrame:
    """row, start, length, sequence_id, offset for a table of row and n."""
    spark = lengths.sparkSession
    full = F.floor(F.col("n") / window).cast("long")
    cuts = lengths.select("row", "n", full.alias("full"), (F.col("n") - full * window).cast("int").alias("tail"))
    histogram = np.zeros(window, np.int64)
    for tail, n in cuts.groupBy("tail").count().collect():  # a row for each length below the window
        histogram[tail] = n
    histogram[0] = 0
    rows = plan(histogram, window)
    planned = F.broadcast(spark.createDataFrame(rows, PLAN))  # as small as the histogram
    tails = ranked(cuts.where("tail > 0").select("row", "full", "tail"), ["tail"], "row")
    t, p = tails.alias("t"), planned.alias("p")
    met = (F.col("t.tail") == F.col("p.tail")) & (F.col("t.rank") >= F.col("p.rank")) & (
        F.col("t.rank") < F.col("p.rank") + F.col("p.count")
    )
    ends = t.join(p, met).select(
        "row",
        (F.col("full") * window + F.col("start")).alias("start"),
        F.col("length").cast("long"),
        (F.col("sequence") + F.col("t.rank") - F.col("p.rank")).alias("sequence_id"),
        F.col("offset").cast("long"),
    )
    first = max((r[5] + r[4] for r in rows), default=0)
    # full windows: a document's own stretch of sequence numbers, by running sums over buckets
    whole = cuts.where("full > 0").withColumn("_b", F.pmod(F.xxhash64("row"), F.lit(RANK_BUCKETS)).cast("int"))
    before = lambda w: F.coalesce(F.sum("full").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = whole.groupBy("_b").agg(F.sum("full").alias("full")).select(
        "_b", before(Window.orderBy("_b")).alias("_s")
    )
    windows = (
        whole.withColumn("_w", before(Window.partitionBy("_b").orderBy("row")))
        .join(F.broadcast(sums), "_b")  # a row for each bucket
        .select("row", (F.col("_s") + F.col("_w") + first).alias("base"), F.explode(F.sequence(F.lit(0), (F.col("full") - 1).cast("int"))).alias("k"))
        .select(
            "row", (F.col("k") * window).cast("long").alias("start"), F.lit(window).cast("long").alias("length"),
            (F.col("base") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
        )
    )
    return ends.unionByName(windows)


def pack(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """A row per piece: id, start, length, doc_tokens, sequence_id, offset, ids (bytes), width."""
    tokens = stored(tokenise(docs, path, id_col, text_col), "token-ids")
    placed = stored(pieces(tokens.select("row", "n"), window), "pieces")
    lists = placed.groupBy("row").agg(
        F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("parts")
    )
    cut: Column = F.expr("substring(ids, cast(part.start * width + 1 as int), cast(part.length * width as int))")
    return (
        tokens.join(lists, "row")
        .withColumn("part", F.explode("parts"))
        .select(
            F.col("id").alias(id_col), "part.start", "part.length", F.col("n").alias("doc_tokens"),
            "part.sequence_id", "part.offset", cut.alias("ids"), "width",
        )
    )


def with_checksums(packed: DataFrame) -> DataFrame:
    """The pieces with ``ids_crc32`` instead of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [
                zlib.crc32(np.frombuffer(i, f"<u{w}").astype("<u4").tobytes())
                for i, w in zip(batch.column("ids").to_pylist(), batch.column("width").to_pylist(), strict=True)
            ]
            kept = [c for c in batch.schema.names if c not in ("ids", "width")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(sums, pa.int64())], [*kept, "ids_crc32"]
            )

    kept = [f for f in packed.schema if f.name not in ("ids", "width")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "ids_crc32 long"])
    return packed.mapInArrow(run, schema)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return with_checksums(pack(docs, public_tokenizers.path("word_bpe_49k.json")))
