"""Language-model scores from a log-frequency Bloom filter.

Counts of words and of word pairs over all training texts are quantised on a
logarithmic scale: count c has level 1 + floor(log2 c). For an n-gram of level q the
filter holds the items (n-gram, 1) to (n-gram, q); a count is read back by probing
(n-gram, 1), (n-gram, 2), ... until one is not there, and stands for the middle of
its level. The filter is made in segments by hash, each by one task from that
segment's counts; it has ``BITS_PER_ITEM`` bits for an item, however many there are.
A filter of ``MAX_BITS`` at most is broadcast and read directly. A larger one stays in
shards, runs of segments of ``SHARD_BITS``, and the probes travel: texts are cut into
parts of about a megabyte, each part sends its distinct n-grams to their shards, every
shard answers with the levels it holds, and the answers meet their part again. That is
one pass over the texts however many shards there are; the levels are the same.

p(w | v) = m c(v w) / c(v) + (1 - m) (c(w) + 1) / (N + V + 1), all counts read from
the filter, N tokens and V distinct tokens of the training texts. The weight m
depends on the level of c(v) and is the one of ``WEIGHTS`` with the largest
likelihood over all training texts, each pair's own occurrence left out.

The base score takes the exact counts. The ``HEAD`` most frequent words at most are
broadcast; the other words of a text meet their counts in a join, where no word is
frequent.

A text is its words (A-Z as a-z) and an end, which is a token and also the first
word's left neighbour. Null and empty texts are one end. Null ids are training
texts. Repeated rows are texts of their own; extra columns are ignored. Without
training texts all counts are 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.llm.common import mixed_bits, slices, stream, text_bytes, words
from logwarden.session import stored

HASHES = 4
BITS_PER_ITEM = 8
MAX_BITS = 1 << 30
SHARD_BITS = 1 << 28
PART_BYTES = 1 << 20
SEGMENT_BITS = 1 << 32
HEAD = 1 << 19
PARTITION_BYTES = 8 << 20
FLUSH_TOKENS = 1_500_000
LEVELS = 40
SIDE = LEVELS + 1
WEIGHTS = np.array([0.001, 0.05, 0.15, 0.3, 0.5, 0.7, 0.85, 0.95])
END, PAIR_A, PAIR_B, ONE = stream(40, 4) | np.uint64(1)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes with the ends, their left neighbours, and where texts begin."""
    hashes, starts = words(*text_bytes(column))
    n = len(starts) - 1
    places = starts + np.arange(n + 1)
    out = np.full(len(hashes) + n, END, np.uint64)
    is_word = np.ones(len(out), bool)
    is_word[places[1:] - 1] = False
    out[is_word] = hashes
    left = np.full(len(out), END, np.uint64)
    left[1:] = out[:-1]
    return out, left, places


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mixed_bits(left * PAIR_A + mixed_bits(right) * PAIR_B)


def word_keys(hashes: np.ndarray) -> np.ndarray:
    return mixed_bits(hashes ^ ONE)


def levels(counts: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(counts)).astype(np.int64) + 1


#: the count that a level stands for: the middle of its range, 0 for level 0
MIDDLE = np.array([0.0, *((2.0 ** (q - 1) + 2.0**q - 1) / 2 for q in range(1, LEVELS + 1))])


def _positions(keys: np.ndarray, level: int | np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    item = mixed_bits(keys + np.asarray(level, np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    step = (item >> np.uint64(33)) | np.uint64(1)
    low = item & np.uint64(0xFFFFFFFF)
    # a 32-bit hash, scaled to the size instead of divided by it
    return [(((low + np.uint64(i) * step) & np.uint64(0xFFFFFFFF)) * size) >> np.uint64(32) for i in range(HASHES)]


def make_segment(keys: np.ndarray, counts: np.ndarray, most_bits: int) -> np.ndarray:
    """The bits, packed, of one segment, which may not need more than ``most_bits``."""
    q = levels(counts)
    bits = max(64, BITS_PER_ITEM * int(q.sum())) // 8 * 8
    if bits > most_bits:
        raise ValueError(f"a segment needs {bits} bits, more than {most_bits}: take more segments")
    out = np.zeros(bits, bool)
    for level in range(1, int(q.max(initial=0)) + 1):
        for at in _positions(keys[q >= level], level, np.uint64(bits)):
            out[at] = True
    return np.packbits(out, bitorder="little")


class Filter:
    """Segments in one array of bytes, with the bit where each begins; those not there are empty."""

    def __init__(self, data: np.ndarray, starts: np.ndarray) -> None:
        self.data, self.starts = data, starts

    def level(self, keys: np.ndarray) -> np.ndarray:
        """The level of each n-gram, by probing until an item is not there."""
        out = np.zeros(len(keys), np.int64)
        if not len(self.data):
            return out
        segment = segment_of(keys, len(self.starts) - 1)
        start = self.starts[segment].astype(np.uint64)
        size = (self.starts[segment + 1] - self.starts[segment]).astype(np.uint64)
        alive = np.flatnonzero(size > 0)
        for level in range(1, LEVELS + 1):
            for_item = _positions(keys[alive], level, size[alive])
            there = np.ones(len(alive), bool)
            for at in for_item:
                at += start[alive]
                there &= (self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
            alive = alive[there]
            if not len(alive):
                break
            out[alive] = level
        return out


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) % np.uint64(segments)).astype(np.int32)


def _counted(kind: int, keys: np.ndarray, segments: int) -> pa.RecordBatch:
    """A row for each segment: its keys in order and their counts, as bytes."""
    keys, n = np.unique(keys, return_counts=True)
    of = segment_of(word_keys(keys) if kind == 0 else keys, segments)
    order = np.argsort(of, kind="stable")
    keys, n, of = keys[order], n[order].astype(np.uint32), of[order]
    cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
    spans = list(zip(cuts[:-1], cuts[1:], strict=True)) if len(of) else []
    return pa.RecordBatch.from_pydict(
        {
            "segment": pa.array([int(of[a]) for a, _ in spans], pa.int32()),
            "kind": pa.array([kind] * len(spans), pa.int32()),
            "keys": pa.array([keys[a:b].tobytes() for a, b in spans], pa.binary()),
            "counts": pa.array([n[a:b].tobytes() for a, b in spans], pa.binary()),
        }
    )


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k, n = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[first], np.add.reduceat(n, first)


def gather(training: DataFrame, segments: int, partitions: int) -> DataFrame:
    """kind 0: a word's hash and count; kind 1: a segment's number and bits.

    Each task sums what it has read before it sends it, packed by segment.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ones, twos, size = [], [], 0
        for batch in slices(batches, "text"):
            right, left, _ = tokens(batch.column("text"))
            ones.append(right)
            twos.append(pair_keys(left, right))
            size += len(right)
            if size >= FLUSH_TOKENS:
                yield _counted(0, np.concatenate(ones), segments)
                yield _counted(1, np.concatenate(twos), segments)
                ones, twos, size = [], [], 0
        if size:
            yield _counted(0, np.concatenate(ones), segments)
            yield _counted(1, np.concatenate(twos), segments)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, tuple[tuple[list, list], tuple[list, list]]] = {}
        for batch in batches:
            keys, counts = batch.column("keys"), batch.column("counts")
            for i, (segment, kind) in enumerate(zip(batch.column("segment").to_pylist(), batch.column("kind").to_pylist(), strict=True)):
                lists = parts.setdefault(segment, (([], []), ([], [])))[kind]
                lists[0].append(np.frombuffer(keys[i].as_buffer(), np.uint64))
                lists[1].append(np.frombuffer(counts[i].as_buffer(), np.uint32))
        for segment in sorted(parts):
            (words_k, words_n), (pairs_k, pairs_n) = (_summed(*lists) for lists in parts.pop(segment))
            bits = make_segment(
                np.concatenate([word_keys(words_k), pairs_k]), np.concatenate([words_n, pairs_n]), SEGMENT_BITS
            )
            none = len(words_k)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.append(np.zeros(none, np.int32), 1).astype(np.int32)),
                    pa.array(np.append(words_k.view(np.int64), segment)),
                    pa.array(np.append(words_n, len(bits))),
                    pa.array([None] * none + [bits.tobytes()], pa.binary()),
                ],
                ["kind", "h", "n", "bits"],
            )

    counts = training.select("text").mapInArrow(count, "segment int, kind int, keys binary, counts binary")
    return counts.repartition(partitions, "segment").mapInArrow(build, "kind int, h long, n long, bits binary")


def read_levels(bloom: Filter | Answers, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One number for the levels of the left word, the pair and the word of each token."""
    distinct, at = np.unique(np.append(right, END), return_inverse=True)
    level = bloom.level(word_keys(distinct))
    of_right, of_end = level[at[:-1]], level[at[-1]]
    of_left = np.append(of_end, of_right[:-1])
    of_left[left == END] = of_end
    pair = bloom.level(pair_keys(left, right))
    return (of_left * SIDE + pair) * SIDE + of_right


def probabilities(codes: np.ndarray, weight: np.ndarray | float, total: int, distinct: int, leave_out: bool) -> np.ndarray:
    """p(w | v) for codes of levels; ``leave_out`` takes one occurrence of the pair out of all counts."""
    off = 1.0 if leave_out else 0.0
    left, pair, word = codes // SIDE**2, codes // SIDE % SIDE, codes % SIDE
    have, one = np.maximum(MIDDLE[left] - off, 0), np.maximum(MIDDLE[word] - off, 0)
    both = np.minimum(np.maximum(MIDDLE[pair] - off, 0), have)
    share = np.divide(both, have, out=np.zeros(len(codes)), where=have > 0)
    m = weight[left] if isinstance(weight, np.ndarray) else weight
    return m * share + (1 - m) * (one + 1) / (total + distinct + 1)


class Answers:
    """Levels of n-grams that the shards have sent back; all others are 0."""

    def __init__(self, keys: np.ndarray, held: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.held = keys[order], held[order].astype(np.int64)

    def level(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.held[at], 0)


def _in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with ``part``, equal for neighbours of about ``PART_BYTES`` together."""
    part, size = TaskContext.get().partitionId() << 32, 0
    for batch in slices(batches, "text", PART_BYTES):
        size += pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
        numbers = pa.array(np.full(batch.num_rows, part))
        yield pa.RecordBatch.from_arrays([*batch.columns, numbers], [*batch.schema.names, "part"])
        if size >= PART_BYTES:
            part, size = part + 1, 0


def _probes(shard_of: np.ndarray):
    """shard, part, keys: each part's distinct n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                right, left, _ = tokens(batch.column("text").slice(a, b - a))
                keys = np.unique(np.concatenate([word_keys(np.unique(np.append(right, END))), pair_keys(left, right)]))
                shard = shard_of[segment_of(keys, len(shard_of))]
                order = np.argsort(shard, kind="stable")
                ends = np.flatnonzero(np.diff(shard[order])) + 1
                pieces = np.split(order, ends)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(shard[x[0]]) for x in pieces], pa.int32()), pa.array([int(part[a])] * len(pieces), pa.int64()),
                        pa.array([keys[x].tobytes() for x in pieces], pa.binary()),
                    ],
                    ["shard", "part", "data"],
                )

    return run


def _answered(sizes: np.ndarray, cuts: list[tuple[int, int]]):
    """part, keys, levels; the segments of a shard come before its probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, data, starts = -1, None, None
        for batch in batches:
            columns = (batch.column(c) for c in ("shard", "kind", "part", "data"))
            for shard, kind, part, bits in zip(*columns, strict=True):
                if shard.as_py() != now:
                    now = shard.as_py()
                    first, last = cuts[now]
                    inside = np.zeros(len(sizes), np.int64)
                    inside[first:last] = sizes[first:last]
                    starts = np.concatenate([[0], np.cumsum(inside)])
                    data = np.zeros(int(starts[-1]), np.uint8)  # SHARD_BITS, or one segment
                if kind.as_py() == 0:
                    h = part.as_py()
                    data[starts[h] : starts[h + 1]] = np.frombuffer(bits.as_buffer(), np.uint8)
                    continue
                keys = np.frombuffer(bits.as_buffer(), np.uint64)
                level = Filter(data, starts * 8).level(keys)
                held = np.flatnonzero(level)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part.as_py()], pa.int64()), pa.array([keys[held].tobytes()], pa.binary()),
                        pa.array([level[held].astype(np.uint8).tobytes()], pa.binary()),
                    ],
                    ["part", "keys", "levels"],
                )

    return run


def with_levels(rows: DataFrame, known: DataFrame, sizes: np.ndarray, cuts: list[tuple[int, int]]) -> DataFrame:
    """``rows`` with ``levels``, a number for the levels of each token, read from a filter in shards."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    names = rows.columns
    texts = stored(rows.mapInArrow(_in_parts, f"{kinds}, part long"), "lm-parts")
    shard_of = np.repeat(np.arange(len(cuts), dtype=np.int32), [b - a for a, b in cuts])
    firsts = F.array(*(F.lit(a) for a, _ in cuts))
    segments = known.where("kind = 1").select(
        (F.size(F.filter(firsts, lambda a: a <= F.col("h"))) - 1).alias("shard"), F.lit(0).alias("kind"),
        F.col("h").alias("part"), F.col("bits").alias("data"),
    )
    probes = texts.select("text", "part").mapInArrow(_probes(shard_of), "shard int, part long, data binary").select(
        "shard", F.lit(1).alias("kind"), "part", "data"
    )
    answers = (
        segments.unionByName(probes).repartition(len(cuts), "shard").sortWithinPartitions("shard", "kind")
        .mapInArrow(_answered(sizes, cuts), "part long, keys binary, levels binary")
    )

    def read(table: pa.Table, found: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x, np.uint64) for x in found.column("keys").to_pylist()]
        held = [np.frombuffer(x, np.uint8) for x in found.column("levels").to_pylist()]
        source = Answers(*(np.concatenate([np.zeros(0, t), *x]) for x, t in ((keys, np.uint64), (held, np.uint8))))
        table = table.combine_chunks()
        if not table.num_rows:
            return table.select(names).append_column("levels", pa.array([], pa.list_(pa.int32())))
        right, left, places = tokens(table.column("text").chunk(0))
        codes = pa.array(read_levels(source, left, right).astype(np.int32))
        return table.select(names).append_column("levels", pa.ListArray.from_arrays(pa.array(places.astype(np.int32)), codes))

    met = texts.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(read, f"{kinds}, levels array<int>")
    return stored(met, "lm-levels")


def _reader(share):
    """Words, places and numbers for levels of a batch; without a filter from its column of levels."""
    bloom = Filter(*share.value) if share else None

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        right, left, places = tokens(batch.column("text"))
        codes = read_levels(bloom, left, right) if bloom else batch.column("levels").flatten().to_numpy().astype(np.int64)
        return right, places, codes

    return read


def weights(training: DataFrame, share, total: int, distinct: int) -> np.ndarray:
    """The weight of pairs for each level of the left word's count.

    The likelihood depends on levels alone, so tasks only count them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, sums = _reader(share), np.zeros(SIDE**3, np.int64)
        for batch in slices(batches, "text"):
            sums += np.bincount(read(batch)[2], minlength=SIDE**3)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["code", "n"])

    rows = training.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    codes, n = rows["code"].to_numpy(np.int64), rows["n"].to_numpy(float)  # SIDE^3 rows at most
    table = np.stack(
        [
            np.bincount(codes // SIDE**2, n * np.log(probabilities(codes, m, total, distinct, True)), minlength=SIDE)
            for m in WEIGHTS.tolist()
        ],
        1,
    )
    best = WEIGHTS[table.argmax(1)]
    best[0] = 0.0
    return best


def _sizes(known: DataFrame, segments: int) -> np.ndarray:
    """The bytes of each segment."""
    sizes = np.zeros(segments, np.int64)
    for r in known.where("kind = 1").select("h", "n").collect():  # a row for each segment
        sizes[r["h"]] = r["n"]
    return sizes


def shards(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Runs of segments with ``SHARD_BITS`` at most, or of one segment."""
    cuts, held = [0], 0
    for i, n in enumerate(sizes.tolist()):
        if held and 8 * (held + n) > SHARD_BITS:
            cuts.append(i)
            held = 0
        held += n
    return list(zip(cuts, [*cuts[1:], len(sizes)], strict=True))


def _bits(known: DataFrame, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All segments in one array of bytes, fetched one after the other, and where each begins."""
    starts = np.concatenate([[0], np.cumsum(sizes)])
    data = np.zeros(int(starts[-1]), np.uint8)  # MAX_BITS at most
    for r in known.where("kind = 1").select("h", "bits").toLocalIterator():
        data[starts[r["h"]] : starts[r["h"] + 1]] = np.frombuffer(r["bits"], np.uint8)
    return data, starts * 8


def scores(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), training.alias("training"))
    train = rows.where("training")
    size = train.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = max(1, min(100_000, -(-int(size) // PARTITION_BYTES)))
    segments = 2 * partitions
    known = stored(gather(train, segments, partitions), "lm-counts")
    counts = known.where("kind = 0").select("h", "n")
    total, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    total, distinct = int(total or 0), int(distinct)
    sizes = _sizes(known, segments)
    share = spark.sparkContext.broadcast(_bits(known, sizes)) if 8 * int(sizes.sum()) <= MAX_BITS else None
    if not share:
        rows = with_levels(rows, known, sizes, shards(sizes))
    held = ["text"] if share else ["text", "levels"]
    mix = weights(rows.where("training").select(*held), share, total, distinct)
    log_p = np.log10(probabilities(np.arange(SIDE**3), mix, total, distinct, False))
    # the least count that HEAD words at most have
    least, n = 1, 0
    for r in counts.groupBy("n").count().orderBy(F.desc("n")).limit(HEAD).toLocalIterator():
        n += r["count"]
        if n > HEAD:
            least = r["n"] + 1
            break
    top = counts.where(F.col("n") >= least).toPandas().sort_values("h")  # HEAD rows at most
    order = np.argsort(top["h"].to_numpy(np.int64).view(np.uint64))
    head = spark.sparkContext.broadcast(
        (top["h"].to_numpy(np.int64).view(np.uint64)[order], np.log10(top["n"].to_numpy(float)[order] + 1))
    )
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, (common, logs) = _reader(share), head.value
        for batch in slices(batches, "text"):
            right, places, codes = read(batch)
            p = log_p[codes]
            distinct_words, at = np.unique(right, return_inverse=True)
            place = np.minimum(np.searchsorted(common, distinct_words), max(0, len(common) - 1))
            hit = common[place] == distinct_words if len(common) else np.zeros(len(distinct_words), bool)
            value = np.where(hit, logs[place], 0.0) if len(common) else np.zeros(len(distinct_words))
            is_head = hit[at]
            begin = places[:-1]
            total_of = lambda x: np.add.reduceat(x, begin)  # noqa: E731  every text has its end
            rest = np.flatnonzero(~is_head)
            cuts = np.searchsorted(rest, places)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), pa.array(np.diff(places)), pa.array(total_of(is_head.astype(np.int64))),
                    pa.array(total_of(value[at])), pa.array(total_of(p)),
                    pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(right[rest].view(np.int64))),
                ],
                ["id", "n_tokens", "known", "logs", "score", "rest"],
            )

    first = stored(
        rows.select("id", *held).mapInArrow(
            run, f"id {kind}, n_tokens long, known long, logs double, score double, rest array<long>"
        ).withColumn("row", F.monotonically_increasing_id()),
        "lm-scores",
    )
    tail = (
        first.select("row", F.explode("rest").alias("h")).groupBy("row", "h").agg(F.count("*").alias("times"))
        .join(counts.where(F.col("n") < least), "h")
        .groupBy("row").agg(F.sum("times").alias("k"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("l"))
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return first.drop("rest").join(tail, "row", "left").select(
        F.col("id").alias(id_col), "n_tokens", (F.col("known") + zero("k")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + zero("l") - F.col("n_tokens") * F.log10(F.lit(float(total + distinct + 1)))).alias("base_score"),
        "score",
    )


def held_out(id_col: str = "doc_id", fold: int = 2, folds: int = 7) -> Column:
    """Whether crc32 of the id as text falls in the held-out fold (null ids: no)."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds)) == fold, F.lit(False))


def op4_lm_scores(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scores(docs, ~held_out())
    return found.select("doc_id", held_out().alias("held_out"), *found.columns[1:])
