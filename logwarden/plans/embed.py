"""Labelled records to one vector per record, by one of four methods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwarden.functions.hashing import exact_split, with_split
from logwarden.operators.graph import (
    centralities,
    cooccurrence_edges,
    graph_nodes,
    graph_vectors,
)
from logwarden.operators.tfidf import SvdModel, TfidfModel, with_terms
from logwarden.operators.word_vectors import (
    mean_vectors,
    subword_table,
    with_tokens,
    word_vectors,
)
from logwarden.session import stored

METHODS = ("tfidf", "word2vec", "subword", "graph")


def embed(records: DataFrame, method: str, size: int = 100, exact: bool = False, sources: int | None = None, **training) -> DataFrame:
    """``(id, split, y, features)`` from ``(id, log, y)``; models see the train
    split only. ``sources`` bounds the searches for betweenness (``graph``)."""
    split = exact_split if exact else with_split
    rows = split(records.select("id", "log", "y"), F.col("id"))
    if method == "tfidf":
        return _tfidf(rows, size)
    rows = with_tokens(rows)
    train = rows.where("split = 'train'")
    if method == "word2vec":
        vectors = stored(word_vectors(train, size=size, **training), "words")
        means = mean_vectors(rows, vectors, ["id", "split", "y"], size)
        return means.select("id", "split", "y", "features")
    vectors = subword_table(train, rows, size, **training)
    if method == "subword":
        return mean_vectors(rows, vectors, ["id", "split", "y"], size).select(
            "id", "split", "y", "features"
        )
    if method == "graph":
        nodes = stored(graph_nodes(train), "nodes")
        edges = stored(cooccurrence_edges(train), "edges")
        return graph_vectors(
            rows, vectors, centralities(nodes, edges, sources), ["id", "split", "y"], size
        )
    raise ValueError(f"unknown method {method!r}; known are {', '.join(METHODS)}")


def _tfidf(rows: DataFrame, size: int) -> DataFrame:
    rows = with_terms(rows)
    train = rows.where("split = 'train'")
    model = TfidfModel.fit(train)
    sparse = stored(model.transform(rows).select("id", "split", "y", "indices", "values"), "tfidf")
    svd = SvdModel.fit(sparse.where("split = 'train'"), len(model.terms), size)
    return svd.transform(sparse).select("id", "split", "y", "features")
