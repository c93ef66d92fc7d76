"""Fill-in-the-middle texts, cut at token boundaries by a learned rank index.

A token is a run of non-blank characters with the blanks before it; blanks at the end
are one more. The index of a text maps a rank (how many tokens) to a place (how many
code points) without keeping the places:

* a piecewise-linear model, fitted to all boundaries from rank 0 on: each segment goes
  as far as one slope keeps every boundary within ``BOUND`` code points (the cone of
  feasible slopes is narrowed from point to point, O'Rourke 1981);
* a residual of one byte for each boundary, prediction to place.

A cut looks up its segment, predicts, and adds the residual, which is exact. The index
takes a byte a token, can be stored beside the texts (``with_boundaries``), and serves
any number of new draws of cuts (``fill_in_middle``) without tokenising again.

The draws come from SHA-256 of a seed and the document's id, so reruns agree. Texts that
are empty or hold a marker stay plain; ``restored`` undoes the other forms, which is
possible because no text holds a marker and none can arise at a seam. Null texts count
as empty, null ids as an empty id; repeated rows, equal texts and ties of the two cuts
(an empty middle) are like any others. Texts of any length are indexed whole, in numpy,
about a megabyte at a time; a longer text is one piece, and takes some 20 times its size. Columns named like an added one are replaced, other extra
columns are kept. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden.functions.vectors import once
from logwarden.llm.common import SPACE, slices, text_bytes

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_BELOW, SPM_BELOW, SEED = 50, 80, "42:"
BOUND = 120
WINDOW = 1 << 14
INDEX = "n long, ranks array<long>, places array<long>, slopes array<double>, residuals binary"


# ------------------------------------------------------------------ the index
def boundaries(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The places, in code points, where each text's tokens end, with 0 before them."""
    solid = ~SPACE[data]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    edges = offsets[1:][np.diff(offsets) > 0] - 1
    last[edges] = True  # a word or blanks end with the text
    ends = np.flatnonzero(last) + 1
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    first = np.searchsorted(ends, offsets, side="right")
    return [
        np.concatenate([[0], points[ends[a:b]] - points[at]])
        for a, b, at in zip(first[:-1].tolist(), first[1:].tolist(), offsets[:-1].tolist(), strict=True)
    ]


def fit(places: np.ndarray, bound: int = BOUND) -> tuple[list[int], list[int], list[float], np.ndarray]:
    """First rank, first place and slope of each segment, and all residuals."""
    ranks, starts, slopes = [], [], []
    residuals = np.zeros(len(places), np.int64)
    at = 0
    while at < len(places):
        low, high, end = -np.inf, np.inf, at + 1
        while end < len(places):
            rise = (places[end : end + WINDOW] - places[at]).astype(np.float64)
            run = np.arange(end - at, end - at + len(rise), dtype=np.float64)
            lows = np.maximum(np.maximum.accumulate((rise - bound) / run), low)
            highs = np.minimum(np.minimum.accumulate((rise + bound) / run), high)
            over = lows > highs
            good = int(over.argmax()) if over.any() else len(rise)
            if good:
                low, high = float(lows[good - 1]), float(highs[good - 1])
            end += good
            if good < len(rise):
                break
        slope = (low + high) / 2 if end > at + 1 else 0.0
        run = np.arange(end - at, dtype=np.float64)
        residuals[at:end] = places[at:end] - places[at] - np.floor(run * slope + 0.5).astype(np.int64)
        ranks.append(at)
        starts.append(int(places[at]))
        slopes.append(slope)
        at = end
    return ranks, starts, slopes, residuals


def _index(texts: pa.Array) -> pa.Array:
    out: list[pa.Array] = []
    names = ["n", "ranks", "places", "slopes", "residuals"]
    for piece in slices([pa.RecordBatch.from_arrays([texts], ["t"])], "t"):
        rows = [(len(b) - 1, *fit(b)) for b in boundaries(*text_bytes(piece.column("t")))]
        n, ranks, places, slopes, residuals = zip(*rows, strict=True)
        columns = [
            pa.array(n, pa.int64()), pa.array(ranks, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int64())),
            pa.array(slopes, pa.list_(pa.float64())), pa.array([r.astype(np.int8).tobytes() for r in residuals], pa.binary()),
        ]
        out.append(pa.StructArray.from_arrays(columns, names))
    return pa.concat_arrays(out)


def _boundary_index(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        if len(texts):
            yield _index(texts)


def with_boundaries(docs: DataFrame, text_col: str = "text", out: str = "boundaries") -> DataFrame:
    """``docs`` with the index of each text, as a struct."""
    indexed = F.arrow_udf(_boundary_index, INDEX)
    return docs.withColumn(out, indexed(F.coalesce(F.col(text_col), F.lit(""))))


def place_of(index: Column, rank: Column) -> Column:
    """The place where ``rank`` tokens end: prediction and residual."""
    byte = F.conv(F.hex(F.substring(index["residuals"], (rank + 1).cast("int"), F.lit(1))), 16, 10).cast("long")

    def corrected(segment: Column) -> Column:
        run = (rank - F.get(index["ranks"], segment)).cast("double")
        predicted = F.get(index["places"], segment) + F.floor(run * F.get(index["slopes"], segment) + 0.5)
        return (predicted + byte - F.when(byte > 127, 256).otherwise(0)).cast("long")

    return once(F.size(F.filter(index["ranks"], lambda r: r <= rank)) - 1, corrected)


# ------------------------------------------------------------------ the texts
def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index_col: str = "boundaries",
    seed: str = SEED, plain_below: int = PLAIN_BELOW, spm_below: int = SPM_BELOW,
) -> DataFrame:
    """``docs``, which has the index, with n_tokens, form, prefix_chars, middle_chars and fim_text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring("_digest", 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    index = F.col(index_col)
    ranks = [h[i] % (index["n"] + 1) for i in range(2)]
    marked = F.lit(False)
    for m in (PREFIX, SUFFIX, MIDDLE):
        marked |= F.contains(text, F.lit(m))
    plain = (text == "") | marked | (h[2] % 100 >= plain_below)
    form = F.when(plain, "plain").when(h[3] % 100 < spm_below, "spm").otherwise("psm")
    cut = (
        docs.withColumn("_digest", digest).withColumn("form", form)
        .withColumns({
            "_a": F.when(F.col("form") != "plain", place_of(index, F.least(*ranks))),
            "_b": F.when(F.col("form") != "plain", place_of(index, F.greatest(*ranks))),
        })
    )
    part = lambda a, n: F.substring(text, (a + 1).cast("int"), n.cast("int"))
    prefix, middle = part(F.lit(0), F.col("_a")), part(F.col("_a"), F.col("_b") - F.col("_a"))
    suffix = part(F.col("_b"), F.greatest(F.lit(0), F.char_length(text) - F.col("_b")))
    built = (
        F.when(F.col("form") == "plain", text)
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    )
    return cut.withColumns({
        "n_tokens": index["n"], "prefix_chars": F.col("_a"), "middle_chars": F.col("_b") - F.col("_a"), "fim_text": built,
    }).drop("_digest", "_a", "_b")


def restored(text: Column, form: Column) -> Column:
    """The original of a text that :func:`fill_in_middle` made."""
    second = F.when(form == "psm", SUFFIX).otherwise(PREFIX)
    tail = F.substring_index(text, MIDDLE, -1)
    front = F.substring_index(text, MIDDLE, 1)
    width = F.lit(len(PREFIX))
    one = F.substring(front, width + 1, F.position(second, front) - 1 - width)
    two = F.substring(front, F.position(second, front) + width, F.char_length(front))
    return F.when(form == "plain", text).when(form == "psm", F.concat(one, tail, two)).otherwise(F.concat(two, tail, one))


def op13_fill_middle(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = fill_in_middle(with_boundaries(docs))
    return made.select(
        "doc_id", F.col("n_tokens").alias("n"), "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("fim_text").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("fim_text"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )


ORACLE_SQL = r"""
with d as (select doc_id, coalesce(text, '') x, sha256('42:' || coalesce(doc_id::varchar, '')) h,
  regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') t from documents),
k as (select *, len(t)::bigint n, ('0x' || h[1:8])::bigint h1, ('0x' || h[9:16])::bigint h2,
  ('0x' || h[17:24])::bigint h3, ('0x' || h[25:32])::bigint h4 from d),
f as (select *, least(h1 % (n + 1), h2 % (n + 1)) a, greatest(h1 % (n + 1), h2 % (n + 1)) b,
  case when x = '' or contains(x, '<P>') or contains(x, '<S>') or contains(x, '<M>') or h3 % 100 >= 50 then 'plain'
  when h4 % 100 < 80 then 'spm' else 'psm' end form from k),
c as (select *, array_to_string(t[1:a], '') p, array_to_string(t[a + 1:b], '') m, array_to_string(t[b + 1:], '') s from f)
select doc_id, n, form, case when form != 'plain' then length(p)::bigint end prefix_chars,
  case when form != 'plain' then length(m)::bigint end middle_chars,
  sha256(case form when 'plain' then x when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
  else '<S>' || s || '<P>' || p || '<M>' || m end) output_sha256, sha256(x) restored_sha256 from c
"""
