"""Language identification by error-correcting output codes.

Each language has a codeword; a binary classifier over hashed character n-grams
predicts each bit. With up to ``EXHAUSTIVE`` languages the code is the exhaustive
one (all splits of the languages), beyond it fixed random words, so the model grows
with the logarithm of the number of languages. Decoding sums over the bits the
logistic loss of the classifier's margin for the bit of each codeword, weighted by
how well the classifier separates its training texts, and takes the codeword of
least loss; ``score`` is its share after a softmax, and ``ambiguous`` says that the
second best is within ``AMBIGUOUS`` of it.

Classifiers are fitted on a bounded sample of labelled rows: about
``SAMPLE_PER_LANG`` distinct texts a language, chosen by hash (``sample`` is that
bound); a text with many copies is learned from once.
They are log odds of n-gram counts, kept as 16-bit integers, so margins are exact
sums and do not depend on batches. Whole texts are read, for training and for
prediction; case and everything but letters is dropped first.

Null texts and texts without a letter get ``und``, score 0, and count as
ambiguous. Rows with null language are not learned from. Without any labelled row
everything is ``und``. Repeated rows and ties are decided alike (ties go to the
first language in code point order). Other columns are kept, but for ones named
``lang_pred``, ``score`` or ``ambiguous``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.llm.common import LOWER, fresh, mixed_bits, slices, stream, text_bytes

BITS = 16
ORDERS = (2, 3, 4)
SAMPLE_PER_LANG = 4000
EXHAUSTIVE = 6
SCALE = 256.0
AMBIGUOUS = 0.1
UND = "und"
#: bytes of letters stay (all of UTF-8 beyond ASCII), the rest becomes a blank
CLEAN = np.where(
    (np.arange(256) >= 0x80) | ((LOWER >= 97) & (LOWER <= 122)), LOWER, np.uint8(32)
).astype(np.uint8)
BYTE = stream(8, 256 * max(ORDERS)).reshape(max(ORDERS), 256)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each order, the hashed n-grams of all texts and the places where texts begin in them."""
    data = CLEAN[data]
    keep = np.ones(len(data), bool)
    if len(data) > 1:
        keep[1:] = (data[1:] != 32) | (data[:-1] != 32)
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    keep[begins] = True
    places = np.concatenate([[0], np.cumsum(keep)])[offsets]
    data = data[keep]
    ids, starts = [], []
    for n in ORDERS:
        size = max(0, len(data) - n + 1)
        h = np.zeros(size, np.uint64)
        for k in range(n):
            h += BYTE[k][data[k : k + size]]
        h = (mixed_bits(h) >> np.uint64(64 - BITS)).astype(np.int32)
        inside = np.ones(size, bool)
        for edge in places[1:-1]:
            inside[max(0, edge - n + 1) : edge] = False
        ids.append(h[inside])
        starts.append(np.concatenate([[0], np.cumsum(inside)])[np.minimum(places, size)])
    return ids, starts


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The sum of ``values`` over each text, 0 for texts without any."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[starts[1:]] - total[starts[:-1]]


def codewords(n: int) -> np.ndarray:
    """A row of -1 and 1 for each of ``n`` languages."""
    if n <= EXHAUSTIVE:
        splits = [s for s in range(1, 2 ** max(1, n - 1))] or [1]
        rows = np.array([[(s >> i) & 1 for s in splits] for i in range(n)])
    else:
        width = int(np.ceil(10 * np.log2(n)))
        rows = (stream(77, n * width) >> np.uint64(63)).astype(int).reshape(n, width)
        rows = rows[:, (rows.min(0) != rows.max(0))]
    return rows * 2 - 1


class Model:
    """Codewords, weights of the bits' classifiers (bit x bucket), and the bits' loss weights."""

    def __init__(self, langs: list[str], counts: np.ndarray) -> None:
        self.langs, self.code = langs, codewords(len(langs))
        share = np.log((counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)) if len(langs) else counts
        self.tables, strength = [], []
        for bit in self.code.T:
            sides = [np.exp(share[bit == side]).mean(0) if (bit == side).any() else None for side in (1, -1)]
            odds = np.log(sides[0]) - np.log(sides[1]) if all(s is not None for s in sides) else np.ones(1 << BITS)
            self.tables.append(np.clip(np.rint(odds * SCALE), -32000, 32000).astype(np.int16))
            # how far apart the bit's margin puts the languages of the two sides
            means = (counts * odds).sum(1) / np.maximum(counts.sum(1), 1)
            strength.append(max(1e-3, float((means * bit).min())))
        self.weight = np.array(strength) / max(sum(strength), 1e-9)

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The place of the best language (-1: none), its score, and whether it is ambiguous."""
        n = len(offsets) - 1
        ids, starts = grams(data, offsets)
        number = sum(np.diff(s) for s in starts)
        margin = np.zeros((n, len(self.tables)))
        for b, table in enumerate(self.tables):
            margin[:, b] = sum(_sums(table[i], s) for i, s in zip(ids, starts, strict=True))
        # mean log odds of an n-gram, times the root of how many there are up to 100
        margin *= (np.sqrt(np.minimum(number, 100)) / np.maximum(number, 1) / SCALE)[:, None]
        loss = np.stack([np.logaddexp(0, -margin * word) @ self.weight for word in self.code], 1)
        order = np.argsort(loss, 1, kind="stable")
        p = np.exp((loss.min(1, keepdims=True) - loss) * len(self.tables))
        p /= p.sum(1, keepdims=True)
        best = order[:, 0]
        top = p[np.arange(n), best]
        second = p[np.arange(n), order[:, 1]] if p.shape[1] > 1 else np.zeros(n)
        return best, top, top - second < AMBIGUOUS


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, bucket, n: n-gram counts of each task."""
    totals: dict[str, np.ndarray] = {}
    for batch in slices(batches, "text"):
        data, offsets = text_bytes(batch.column("text"))
        ids, starts = grams(data, offsets)
        lang = batch.column("lang").to_numpy(zero_copy_only=False)
        for name in dict.fromkeys(lang):
            mine = totals.setdefault(name, np.zeros(1 << BITS, np.int64))
            for i, s in zip(ids, starts, strict=True):
                mine += np.bincount(i[np.repeat(lang == name, np.diff(s))], minlength=1 << BITS)
    for name, n in totals.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict(
            {"lang": pa.array([name] * len(at), pa.string()), "bucket": at.astype(np.int32), "n": n[at]}
        )


def fit(labelled: DataFrame, text_col: str, lang_col: str, sample: int = SAMPLE_PER_LANG) -> Model:
    """The model of about ``sample`` distinct texts of each language (those of languages with more are drawn by hash)."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(F.col(text_col)).alias("digest")
    )
    # a row per language; a text counts once, however many copies it has
    sizes = {r[0]: max(1, r[1]) for r in rows.groupBy("lang").agg(F.approx_count_distinct("digest")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((0, 1 << BITS)))
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 30)).cast("double") / (1 << 30)
    share = F.create_map(*(F.lit(v) for k in langs for v in (k, min(1.0, sample / sizes[k]))))
    chosen = rows.where(draw < F.element_at(share, F.col("lang"))).dropDuplicates(["lang", "digest"]).select("text", "lang")
    table = (
        chosen.mapInArrow(_count, "lang string, bucket int, n long")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    )  # languages x 65,536 numbers at most
    counts = np.zeros((len(langs), 1 << BITS))
    counts[table["lang"].map(langs.index).to_numpy(int), table["bucket"].to_numpy(int)] = table["n"]
    return Model(langs, counts)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``ambiguous``."""
    names, source = pa.array([*model.langs, UND], pa.string()), fresh(docs.columns, "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, source):
            text = batch.column(source)
            n, known = batch.num_rows, pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False)
            best, score, vague = np.full(n, len(model.langs)), np.zeros(n), np.ones(n, bool)
            if model.langs:
                best, score, vague = model.predict(*text_bytes(pc.utf8_lower(pc.fill_null(text, ""))))
            off = ~known.to_numpy(zero_copy_only=False)
            best, score, vague = np.where(off, len(model.langs), best), np.where(off, 0.0, score), vague | off
            kept = [batch.column(c) for c in batch.schema.names if c != source]
            yield pa.RecordBatch.from_arrays(
                [*kept, names.take(pa.array(best)), pa.array(score), pa.array(vague)], fields
            )

    added = {"lang_pred": "string", "score": "double", "ambiguous": "boolean"}
    base = docs.drop(*added)
    fields = [*base.columns, *added]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema] + [f"{k} {v}" for k, v in added.items()])
    return base.withColumn(source, F.col(text_col)).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id", fold: int = 2, folds: int = 4) -> Column:
    """Whether crc32 of the id as text falls in the held-out fold (null ids: no)."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds)) == fold, F.lit(False))


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out()), "text", "lang")
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select(
        "doc_id", "held_out", "lang_pred", "score", "ambiguous"
    )
