"""Every operator as a query over the given tables, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logwarden.functions.hashing import exact_split, hash_sample, with_split
from logwarden.functions.labels import class_label, distinct_labels, label_codes
from logwarden.functions.text import char_ngrams, preview, simple_tokens, word_tokens
from logwarden.operators import augment as A
from logwarden.operators import distributions as D
from logwarden.operators import graph as G
from logwarden.operators import metrics as M
from logwarden.operators import tfidf as TF
from logwarden.operators import word_vectors as W
from logwarden.operators.models import model_predictions
from logwarden.operators.neighbors import knn_predictions, nearest_neighbors
from logwarden.operators.projection import pca_projection
from logwarden.plans.evaluate import augmentation_effect, train_and_evaluate
from logwarden.plans.steps import materialize
from logwarden.session import scratch_path, stored
from logwarden.sources import logs as L
from logwarden.sources import records as R
from logwarden.sources import tables as T
from logwarden.streaming.numbering import numbered_pieces
from logwarden.streaming.scoring import alerts_per_window

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
LINE = ["doc_id", "line_no"]


def query(fn: Query, name: str | None = None) -> Query:
    QUERIES[name or fn.__name__] = fn
    return fn


def named(name: str):
    """For names that an imported function already has."""
    return lambda fn: query(fn, name)


def r(col, digits: int = 6):
    """Rounded, with negative zero made zero."""
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col, digits) + F.lit(0.0)


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: r(c, digits) for c in cols})


# ------------------------------------------------------------ sources and sinks
@query
def text_file_filter(spark, sf):
    docs = T.table(spark, sf, "documents")
    is_text = L.head_is_text(F.encode("text", "UTF-8"))
    return docs.groupBy("lang").agg(
        F.count("*").alias("files"), F.count_if(is_text).alias("text_files")
    )


@query
def numbered_lines(spark, sf):
    return T.document_lines(spark, sf)


@query
def log_file_scan(spark, sf):
    """Writes the documents as text files by source and numbers them back."""
    docs = T.table(spark, sf, "documents")
    path = scratch_path(spark, "textlogs")
    docs.select("source", F.explode(F.split("text", "\n")).alias("value")).hint(
        "rebalance", "source"
    ).write.partitionBy("source").text(path)
    lines = L.log_lines(spark, path)
    per_file = lines.groupBy("path").agg(
        F.count("*").alias("lines"),
        F.max("line_no").alias("last"),
        F.sum(F.length("log")).alias("chars"),
    )
    return per_file.groupBy(
        F.regexp_extract("path", "source=([^/]*)/", 1).alias("source")
    ).agg(
        F.sum("lines").alias("lines"), F.sum("last").alias("last_numbers"), F.sum("chars").alias("chars")
    )


@query
def label_map(spark, sf):
    return L.parse_label_rows(T.label_text_rows(spark, sf))


@query
def labelled_write_read(spark, sf):
    docs = T.table(spark, sf, "documents").select("doc_id", "lang", "source")
    records = T.labelled_lines(spark, sf).join(docs, "doc_id").select(
        F.col("doc_id").cast("string").alias("path"),
        "line_no",
        "log",
        "y",
        F.col("source").alias("dataset"),
        F.col("lang").alias("category"),
    )
    path = scratch_path(spark, "records")
    R.write_records(records, path)
    back = R.read_records(spark, path)
    return back.groupBy("dataset", "category").agg(
        F.count("*").alias("records"),
        F.count_if(F.col("y") != "[]").alias("labelled"),
        F.sum(F.length("log")).alias("chars"),
    )


@query
def embedding_roundtrip(spark, sf):
    rows = with_split(T.feature_rows(spark, sf), F.col("id")).select(
        F.col("id").cast("string").alias("id"),
        "features",
        F.to_json(F.array("label")).alias("y"),
        "split",
    )
    path = scratch_path(spark, "embeddings")
    R.write_embeddings(rows, path)
    back = R.read_embeddings(spark, path)
    return back.groupBy("split", class_label("y").alias("label")).agg(
        F.count("*").alias("rows"),
        r(F.sum(F.aggregate("features", F.lit(0.0), lambda a, x: a + x)), 4).alias("total"),
    )


@query
def token_csv_parse(spark, sf):
    lines = T.document_lines(spark, sf).select(*LINE, simple_tokens("log").alias("t"))
    text = F.concat(F.lit("['"), F.array_join("t", "', '"), F.lit("']"))
    path = scratch_path(spark, "tokens")
    lines.where(F.size("t") > 0).select(*LINE, text.alias("tokens")).write.option(
        "header", "true"
    ).option("quoteAll", "true").option("escape", '"').csv(path)
    back = R.read_token_csv(spark, path)
    return back.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("line_no").cast("bigint").alias("line_no"),
        F.size("tokens").cast("bigint").alias("n"),
        F.array_join("tokens", " ").alias("tokens"),
    )


@query
def materialize_idempotent(spark, sf):
    path = scratch_path(spark, "step")

    def build():
        labelled = T.labelled_lines(spark, sf).withColumn("label", class_label("y"))
        return labelled.groupBy("label").agg(F.count("*").alias("n"))

    def never():
        raise AssertionError("a present table must not be built again")

    materialize(spark, path, build)
    return materialize(spark, path, never)


# --------------------------------------------------------- projections, filters
@query
def label_parse(spark, sf):
    """Arrays, objects, scalars and prose as label texts."""
    events = T.table(spark, sf, "events")
    docs = T.table(spark, sf, "documents")
    kinds = events.select(
        F.explode(
            F.array(
                F.struct(F.lit("object").alias("kind"), F.col("props").alias("y")),
                F.struct(F.lit("scalar").alias("kind"), F.concat(F.lit('"'), "event_type", F.lit('"')).alias("y")),
                F.struct(F.lit("array").alias("kind"), F.to_json(F.array("event_type", "props")).alias("y")),
                F.struct(F.lit("number").alias("kind"), F.col("user_id").cast("string").alias("y")),
                F.struct(F.lit("cut").alias("kind"), F.concat(F.lit('["'), "event_type").alias("y")),
            )
        ).alias("k")
    ).select("k.kind", "k.y")
    prose = docs.select(F.lit("prose").alias("kind"), F.col("text").alias("y"))
    none = T.labelled_lines(spark, sf).select(F.lit("lines").alias("kind"), "y")
    return (
        kinds.unionByName(prose)
        .unionByName(none)
        .groupBy("kind", class_label("y").alias("label"))
        .agg(F.count("*").alias("n"))
    )


def _log_paths(spark, sf):
    docs = T.table(spark, sf, "documents")
    suffix = F.when(F.col("n_chars") > 2000, ".log.1").otherwise(".log")
    return docs.select(
        "doc_id", F.concat("lang", F.lit("/"), "source", F.lit("/doc"), "doc_id", suffix).alias("rel")
    )


@query
def path_keys(spark, sf):
    parts = L.path_parts("rel")
    return _log_paths(spark, sf).select(
        "rel", parts["stem"].alias("stem"), parts["suffix"].alias("suffix"), L.record_key("rel").alias("record_key")
    )


@query
def record_preview(spark, sf):
    heads = D.head_rows(T.document_lines(spark, sf), ["doc_id"], ["line_no"], 3)
    return heads.select(*LINE, preview("log").alias("preview"))


def _vectors(spark, sf):
    return with_split(T.feature_rows(spark, sf), F.col("id"))


@query
def class_vectors(spark, sf):
    rows = A.class_vectors(_vectors(spark, sf), "class_3")
    return rows.select(
        "id", "label", r(F.aggregate("features", F.lit(0.0), lambda a, x: a + x)).alias("total")
    )


@query
def embedding_health(spark, sf):
    return rounded(D.embedding_health(_vectors(spark, sf)), "mean", "std")


@query
def label_encode(spark, sf):
    outs = T.outcomes(spark, sf)
    truth, pred = outs.select(F.col("truth").alias("label")), outs.select(F.col("pred").alias("label"))
    codes = label_codes(truth, pred)
    return truth.join(codes, "label").groupBy("label", "code").agg(F.count("*").alias("n"))


@query
def label_universe(spark, sf):
    outs = T.outcomes(spark, sf)
    return distinct_labels(
        outs.select(F.col("truth").alias("label")), outs.select(F.col("pred").alias("label"))
    )


# ------------------------------------------------------------------------ joins
@query
def label_join(spark, sf):
    return T.labelled_lines(spark, sf).select(*LINE, "y", class_label("y").alias("label"))


@query
def label_file_match(spark, sf):
    docs = T.table(spark, sf, "documents").select("doc_id", "lang", "source")
    labels = T.table(spark, sf, "labels").join(docs, "doc_id").select(
        F.concat(
            "lang", F.lit("/"), "source", F.lit("/doc"), "doc_id",
            F.when(F.col("quality") == 1, ".log").otherwise(".log.2"),
        ).alias("rel")
    )
    return L.match_label_files(_log_paths(spark, sf), labels)


@query
def split_80_20(spark, sf):
    return with_split(T.document_lines(spark, sf), T.line_id()).select(*LINE, "split")


@named("exact_split")
def exact_split_80_20(spark, sf):
    return exact_split(T.document_lines(spark, sf), T.line_id()).select(*LINE, "split")


@query
def cooccurrence_edges(spark, sf):
    return G.cooccurrence_edges(_token_lines(spark, sf))


@query
def knn_neighbors(spark, sf):
    v = _vectors(spark, sf)
    found = nearest_neighbors(v.where("split = 'test'"), v.where("split = 'train'"), 5)
    return rounded(found.withColumn("rank", F.col("rank").cast("bigint")), "distance")


# ----------------------------------------------------------------- aggregations
def _labelled(spark, sf):
    return T.labelled_lines(spark, sf).withColumn("label", class_label("y"))


@query
def label_distribution(spark, sf):
    return rounded(D.label_distribution(_labelled(spark, sf)), "percent")


@query
def split_label_distribution(spark, sf):
    rows = with_split(_labelled(spark, sf), T.line_id())
    return rounded(D.split_label_distribution(rows), "percent")


@query
def dataset_summary(spark, sf):
    rows = with_split(_labelled(spark, sf), T.line_id())
    return rounded(D.dataset_summary(rows), "normal_percent", "abnormal_percent")


@query
def top_labels_other(spark, sf):
    users = T.table(spark, sf, "documents").select(F.col("source").alias("label"))
    return D.top_labels_and_other(users)


@query
def file_summary(spark, sf):
    return D.file_summary(T.document_lines(spark, sf), "doc_id")


def _cells(spark, sf, *names):
    by = ["model"] if len(names) > 1 else []
    return M.confusion_cells(T.outcomes(spark, sf, *names), by)


@query
def accuracy(spark, sf):
    return rounded(M.accuracy(_cells(spark, sf)), "accuracy")


@query
def confusion_matrix(spark, sf):
    return rounded(M.confusion_matrix(_cells(spark, sf)), "share")


@query
def confusion_matrix_full(spark, sf):
    return rounded(M.confusion_matrix_all(_cells(spark, sf)), "share")


@query
def class_metrics(spark, sf):
    return rounded(M.class_metrics(_cells(spark, sf)), "precision", "recall", "f1")


@query
def class_metrics_union(spark, sf):
    return rounded(
        M.class_metrics(_cells(spark, sf), truth_only=False), "precision", "recall", "f1"
    )


@query
def classification_report(spark, sf):
    return rounded(M.classification_report(_cells(spark, sf)), "precision", "recall", "f1")


@query
def weighted_prf(spark, sf):
    return rounded(M.weighted_scores(_cells(spark, sf)), "precision", "recall", "f1")


@query
def class_accuracy(spark, sf):
    return rounded(M.class_accuracy(_cells(spark, sf)), "accuracy")


@query
def class_accuracy_top5(spark, sf):
    table = M.class_accuracy(_cells(spark, sf)).orderBy(F.desc("support"), "label").limit(5)
    return rounded(table, "accuracy")


@query
def leaderboard(spark, sf):
    cells = _cells(spark, sf, "original", "augmented", "constant")
    return rounded(M.leaderboard(cells, ["model"]), "accuracy")


@query
def metric_compare(spark, sf):
    table = M.compare_classes(_cells(spark, sf, "original", "augmented"), "model", "original", "augmented")
    return rounded(M.by_change(table), "original", "augmented", "change")


@query
def metric_compare_top_f1(spark, sf):
    table = M.compare_classes(_cells(spark, sf, "original", "augmented"), "model", "original", "augmented")
    return rounded(M.largest_changes(table), "original", "augmented", "change")


@query
def metric_compare_overall(spark, sf):
    table = M.compare_overall(_cells(spark, sf, "original", "augmented"), "model", "original", "augmented")
    return rounded(table, "original", "augmented", "change")


@query
def class_weights(spark, sf):
    return rounded(D.class_weights(_labelled(spark, sf)), "weight")


@query
def graph_size(spark, sf):
    lines = _token_lines(spark, sf)
    return G.graph_size(G.graph_nodes(lines), G.cooccurrence_edges(lines))


# ----------------------------------------------------------- text and embedding
@query
def tokenize_simple(spark, sf):
    return T.document_lines(spark, sf).select(*LINE, F.array_join(simple_tokens("log"), " ").alias("tokens"))


@query
def tokenize_tfidf(spark, sf):
    return T.document_lines(spark, sf).select(*LINE, F.array_join(word_tokens("log"), " ").alias("tokens"))


@query
def ngrams_1_2(spark, sf):
    return TF.with_terms(T.document_lines(spark, sf)).select(*LINE, F.array_join("terms", "|").alias("terms"))


@named("char_ngrams")
def char_ngrams_3_6(spark, sf):
    tokens = G.graph_nodes(_token_lines(spark, sf))
    return tokens.select("token", F.array_join(char_ngrams("token"), "|").alias("grams"))


def _token_lines(spark, sf):
    return W.with_tokens(T.document_lines(spark, sf))


def _term_lines(spark, sf):
    return TF.with_terms(with_split(T.document_lines(spark, sf), T.line_id()))


@query
def term_stats(spark, sf):
    return TF.term_stats(TF.with_terms(T.document_lines(spark, sf)))


@query
def tfidf_vocab(spark, sf):
    train = _term_lines(spark, sf).where("split = 'train'")
    n = train.agg(F.count("*").alias("n")).scalar()
    return rounded(TF.vocabulary(TF.term_stats(train), n), "idf")


@query
def tfidf_weights(spark, sf):
    """Weights of all lines, summed by split and term."""
    rows = _term_lines(spark, sf)
    model = TF.TfidfModel.fit(rows.where("split = 'train'"))
    cells = model.long(model.transform(rows), "split")
    return cells.groupBy("split", "term").agg(
        F.count("*").alias("rows"), r(F.sum("weight"), 4).alias("weight")
    )


def _sparse(spark, sf):
    rows = _term_lines(spark, sf)
    model = TF.TfidfModel.fit(rows.where("split = 'train'"))
    kept = model.transform(rows).select(*LINE, "split", "indices", "values")
    return stored(kept, "tfidf"), len(model.terms)


@query
def tfidf_svd(spark, sf):
    """One row per line: how many coordinates it has, and whether they are zeros (no known term)."""
    rows, width = _sparse(spark, sf)
    svd = TF.SvdModel.fit(rows.where("split = 'train'"), width)
    return _determined(svd.transform(rows), "split")


@query
def tfidf_explained(spark, sf):
    """The share of the train lines' variance that the 100 components keep."""
    rows, width = _sparse(spark, sf)
    train = rows.where("split = 'train'")
    share = TF.SvdModel.fit(train, width).explained_variance(train)
    return train.agg(F.count("*").alias("rows")).select("rows", F.lit(width).alias("terms"), r(F.lit(share)).alias("explained"))


@query
def mean_token_vectors(spark, sf):
    """Means over tokens the train lines know, for all lines."""
    rows = with_split(_token_lines(spark, sf), T.line_id())
    known = G.graph_nodes(rows.where("split = 'train'"))
    n = F.length("token").cast("double")
    es = n - F.length(F.replace("token", F.lit("e")))
    vectors = known.select("token", F.array(n, n * n, es).alias("vector"))
    means = W.mean_vectors(rows, vectors, LINE, 3)
    return means.select(
        *LINE, "known", *[r(F.col("features")[i]).alias(f"v{i}") for i in range(3)]
    )


def _determined(means: DataFrame, *cols: str) -> DataFrame:
    """What does not depend on the training: size, known tokens, and which rows are zeros."""
    zero = F.forall("features", lambda x: x == 0)
    return means.select(*LINE, *cols, F.size("features").cast("bigint").alias("size"), zero.alias("zero"))


@query
def word2vec_docs(spark, sf):
    rows = with_split(_token_lines(spark, sf), T.line_id())
    vectors = stored(W.word_vectors(rows.where("split = 'train'")), "words")
    return _determined(W.mean_vectors(rows, vectors, LINE, 100), "known")


@query
def subword_docs(spark, sf):
    rows = with_split(_token_lines(spark, sf), T.line_id())
    vectors = W.subword_table(rows.where("split = 'train'"), rows)
    return _determined(W.mean_vectors(rows, vectors, LINE, 100), "known")


@query
def indexed_docs(spark, sf):
    rows = with_split(_token_lines(spark, sf), T.line_id())
    vectors = stored(W.word_vectors(rows.where("split = 'train'"), trainer="indexed"), "words")
    return _determined(W.mean_vectors(rows, vectors, LINE, 100), "known").drop("zero")


def _sources(nodes: DataFrame) -> int | None:
    """As in the reference: searches from all nodes of a graph of up to 1,000, else from 500."""
    return None if nodes.count() <= 1000 else 500


@query
def graph_docs(spark, sf):
    """Betweenness is searched from all nodes, however many there are."""
    rows = stored(_token_lines(spark, sf), "lines")
    nodes, edges = stored(G.graph_nodes(rows), "nodes"), stored(G.cooccurrence_edges(rows), "edges")
    vectors = W.subword_table(rows, rows)
    central = G.centralities(nodes, edges)
    return _determined(G.graph_vectors(rows, vectors, central, LINE, 100))


@named("pca_projection")
def pca_view(spark, sf):
    rows = _binary(spark, sf)
    made = A.synthetic_rows(A.minority_plan(rows, 0.2), A.class_scaler(rows))
    return pca_projection(A.augmented(rows, made), "id", "label", "origin")


@named("hash_sample")
def hash_sample_5000(spark, sf):
    return hash_sample(T.document_lines(spark, sf), T.line_id(), 5000).select(*LINE)


# ------------------------------------------------------------------------ graph
@query
def degree_centrality(spark, sf):
    lines = _token_lines(spark, sf)
    nodes = stored(G.graph_nodes(lines), "nodes")
    return rounded(G.degree_centrality(nodes, G.cooccurrence_edges(lines)), "centrality")


def _graph(spark, sf):
    lines = _token_lines(spark, sf)
    return stored(G.graph_nodes(lines), "nodes"), stored(G.cooccurrence_edges(lines), "edges")


@query
def eigenvector_centrality(spark, sf):
    return rounded(G.eigenvector_centrality(*_graph(spark, sf)), "centrality")


@query
def betweenness_centrality(spark, sf):
    nodes, edges = _graph(spark, sf)
    return rounded(G.betweenness_centrality(nodes, edges, _sources(nodes)), "centrality")


@query
def betweenness_subgraph(spark, sf):
    """Exact betweenness inside the subgraph of the nodes of highest degree."""
    nodes, edges = _graph(spark, sf)
    top = stored(G.top_degree_nodes(nodes, edges).select("token"), "top")
    inside = stored(G.induced_edges(edges, top), "inside")
    return rounded(G.betweenness_centrality(top, inside), "centrality")


@query
def top_degree_subgraph(spark, sf):
    nodes, edges = _graph(spark, sf)
    top = stored(G.top_degree_nodes(nodes, edges), "top")
    return rounded(G.edge_widths(stored(G.induced_edges(edges, top), "inside")), "width")


@query
def subgraph_styling(spark, sf):
    nodes, edges = _graph(spark, sf)
    top = stored(G.top_degree_nodes(nodes, edges), "top")
    return G.labelled_nodes(top, stored(G.induced_edges(edges, top), "inside"))


# ----------------------------------------------------------------------- models
def _sides(spark, sf):
    v = _vectors(spark, sf)
    return v.where("split = 'train'"), v.where("split = 'test'")


@named("knn_predictions")
def knn_vote(spark, sf):
    train, test = _sides(spark, sf)
    return knn_predictions(test, train)


@query
def rf_predictions(spark, sf):
    return model_predictions("rf", *_sides(spark, sf))


@query
def gbt_predictions(spark, sf):
    return model_predictions("gbt", *_sides(spark, sf))


@query
def lr_predictions(spark, sf):
    return model_predictions("lr", *_sides(spark, sf))


@query
def svm_rff_predictions(spark, sf):
    return model_predictions("svm", *_sides(spark, sf))


@query
def model_run(spark, sf):
    """Four classifiers fitted, saved, loaded and evaluated again, in a short form of each."""
    rows, place = _vectors(spark, sf), scratch_path(spark, "models")
    models = {"rf": {"trees": 20, "depth": 8}, "gbt": {"rounds": 5, "depth": 4}, "knn": {}, "lr": {"iterations": 50}}
    first = train_and_evaluate(rows, "embeddings", models, models_dir=place)
    again = train_and_evaluate(rows, "embeddings", models, models_dir=place)
    both = first.join(again.withColumnsRenamed({"accuracy": "loaded", "seconds": "kept"}), ["embedding", "model"])
    return both.select(
        "embedding", "model", r("accuracy").alias("accuracy"), (F.col("accuracy") == F.col("loaded")).alias("same_when_loaded"),
        ((F.col("seconds") == F.col("kept")) & ((F.col("seconds") > 0) | (F.col("model") == "knn"))).alias("time_kept"),
    )


# ----------------------------------------------------------------- augmentation
def _binary(spark, sf):
    label = F.when(F.col("label") == "class_0", "attack").otherwise("normal")
    return T.feature_rows(spark, sf).withColumn("label", label)


@query
def minority_plan(spark, sf):
    return A.minority_plan(T.outcomes(spark, sf).select(F.col("pred").alias("label")))


@query
def class_scaler(spark, sf):
    scaler = A.class_scaler(T.feature_rows(spark, sf))
    cells = scaler.select("label", F.posexplode(F.arrays_zip("mean", "std")).alias("dim", "x"))
    return cells.select("label", F.col("dim").cast("bigint").alias("dim"), r("x.mean").alias("mean"), r("x.std").alias("std"))


@query
def class_scale_roundtrip(spark, sf):
    rows = T.feature_rows(spark, sf)
    both = A.scaled(rows, A.class_scaler(rows))
    return both.select(
        "id",
        r(F.aggregate("scaled", F.lit(0.0), lambda a, x: a + F.abs(x))).alias("scaled_size"),
        r(F.aggregate("restored", F.lit(0.0), lambda a, x: a + x)).alias("restored_total"),
    )


def _synthetic(spark, sf):
    rows = _binary(spark, sf)
    scaler = A.class_scaler(rows)
    return rows, scaler, A.synthetic_rows(A.minority_plan(rows, 0.2), scaler)


@query
def synthetic_rows(spark, sf):
    """Per class: rows made, distinct rows, and rows within one deviation."""
    _, scaler, made = _synthetic(spark, sf)
    sizes = F.zip_with("features", "mean", lambda x, m: F.abs(x - m))
    inside = F.forall(F.zip_with(sizes, "std", lambda d, s: d <= s * (1 + 1e-9)), lambda ok: ok)
    return made.join(scaler, "label").groupBy("label").agg(
        F.count("*").alias("rows"),
        F.count_distinct("features").alias("distinct_rows"),
        F.count_if(inside).alias("inside"),
    )


@query
def interpolated_rows(spark, sf):
    """Synthetic rows between two real ones: which, where, and the sum of the features."""
    rows = _binary(spark, sf)
    made = A.interpolated_rows(A.minority_plan(rows, 0.2), rows)
    return made.select(
        "label", "row", "first_id", "second_id", r("share").alias("share"),
        r(F.aggregate("features", F.lit(0.0), lambda a, x: a + x), 4).alias("total"),
    )


@query
def augmented_union(spark, sf):
    rows, _, made = _synthetic(spark, sf)
    path = scratch_path(spark, "augmented")
    A.augmented(rows, made).write.partitionBy("origin").parquet(path)
    table = spark.read.parquet(path)
    arms = R.training_rows(table, True).withColumn("arm", F.lit("augmented")).unionByName(
        R.training_rows(table, False).withColumn("arm", F.lit("original"))
    )
    return arms.groupBy("arm", "origin", "label").agg(F.count_distinct("id").alias("rows"))


@query
def augmented_distribution(spark, sf):
    rows, _, made = _synthetic(spark, sf)
    return A.augmented_distribution(A.augmented(rows, made))


@named("augmentation_effect")
def augmentation_effect_rf(spark, sf):
    v = with_split(_binary(spark, sf), F.col("id"))
    cells = augmentation_effect(
        v.where("split = 'train'"),
        v.where("split = 'test'"),
        {
            "rf": {"trees": 100, "leaf": 1, "balanced": False},
            "gbt": {"rounds": 100, "depth": 6, "gamma": 0.0, "l1": 0.0},
        },
        threshold=0.2,
    )
    return M.compare_overall(cells, "arm", "original", "augmented", ["model"])


# --------------------------------------------------------------------- streaming
@named("alerts_per_window")
def alerts_by_hour(spark, sf):
    """The batch form of the streaming count."""
    counted = alerts_per_window(T.table(spark, sf, "events"), "ts", "event_type")
    return counted.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "label", "alerts"
    )


@query
def stream_numbered_lines(spark, sf):
    """The documents sent in three pieces each, numbered as a stream of several batches."""
    docs = T.table(spark, sf, "documents").where("text is not null")
    n = F.ceil(F.length("text") / 3).cast("int")
    pieces = docs.select("doc_id", "text", n.alias("n"), F.explode(F.array(*map(F.lit, range(3)))).alias("k")).select(
        F.col("doc_id").cast("string").alias("path"),
        F.col("k").cast("bigint").alias("seq"),
        (F.col("k") == 2).alias("last"),
        F.substring("text", F.col("k") * F.col("n") + 1, F.col("n")).alias("text"),
    )
    sent, out = scratch_path(spark, "pieces"), scratch_path(spark, "numbered")
    files = max(2, spark.sparkContext.defaultParallelism)  # of each of three batches
    pieces.repartition(3 * files).write.parquet(sent)
    stream = spark.readStream.schema(pieces.schema).option("maxFilesPerTrigger", files).parquet(sent)
    run = (
        numbered_pieces(stream).writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", scratch_path(spark, "stream")).trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return spark.read.schema("path string, line_no bigint, log string").parquet(out).select(
        F.col("path").cast("bigint").alias("doc_id"), "line_no", "log"
    )
