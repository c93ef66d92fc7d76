"""From documents to packed sequences: five stages, each written and read again.

Language identification drops what it rejects (no letters, or two languages nearly
as likely) and fills in a missing language; line dedup drops the boilerplate lines of
each source; the n-gram join keeps one document of each group of near copies (five
words, similarity 0.8); mixing repeats documents by the target weights of their
sources and leaves out those that are not taken; packing cuts all tokens into
sequences. ``run`` gives the pieces. The stages learn (a classifier) and tokenise,
which SQL can't express, so there is no SQL twin; tests check each stage on a planted
corpus.

Null texts and texts without letters are rejected by the first stage, so no later one
meets them; a null source is one source, and null ids are documents like others. Equal
rows and copies of a text are one group of near copies, of which the row with the least
id stays (null ids last, ties by text digest; rows equal in both are one). An empty table
gives no pieces. All but the last stage return the columns of ``documents`` only, whatever
other columns the table has or a stage adds, so clashing names cannot pass on.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.llm import language_id, line_dedup, mixing, ngram_join, packing
from logwarden.session import stored

TOKENIZER = "word_bpe_49k.json"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.fit(docs, "text", "lang")
    found = language_id.identify(docs, model).where((F.col("lang_pred") != language_id.UND) & ~F.col("ambiguous"))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_boilerplate(docs, F.col("source"), count_copies=False)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs, width=5, num=80, den=100).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.with_checksums(packing.pack(docs, public_tokenizers.path(TOKENIZER)))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_boilerplate_lines),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
