"""The SQL twin of every query whose result is determined, for DuckDB."""

from __future__ import annotations

from logwarden.functions.text import ALPHABETIC_RUN, WHITESPACE, WORD_RUN
from logwarden.operators.skipgram import BUCKETS, LONGEST, SHORTEST

ORACLES: dict[str, str] = {}


def r(expr: str, digits: int = 6) -> str:
    return f"(round({expr}, {digits}) + 0.0)"


def hash_of(row_id: str) -> str:
    return f"md5('42:' || {row_id})"


def in_train(row_id: str) -> str:
    return f"CAST('0x' || substr({hash_of(row_id)}, 1, 8) AS BIGINT) < {round(0.8 * 2**32)}"


def split(row_id: str) -> str:
    return f"CASE WHEN {in_train(row_id)} THEN 'train' ELSE 'test' END"


def simple(text: str) -> str:
    return (
        f"list_filter(regexp_extract_all(lower({text}), '{ALPHABETIC_RUN}'), "
        "lambda x: length(x) BETWEEN 2 AND 15 AND NOT starts_with(x, '_'))"
    )


def words(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '{WORD_RUN}')"


LINE_ID = "doc_id || ':' || line_no"
LINES = f"""lines AS (
  SELECT * FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS log,
           unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no
    FROM documents)
  WHERE regexp_matches(log, '[^{WHITESPACE}]'))"""
LABEL_ARRAYS = """arrays AS (
  SELECT doc_id, list_filter([CASE WHEN toxic = 1 THEN 'toxic' END,
                              CASE WHEN quality = 0 THEN 'low_quality' END],
                             lambda x: x IS NOT NULL) AS labels
  FROM labels)"""
LABELLED = f"""{LINES}, {LABEL_ARRAYS}, labelled AS (
  SELECT l.doc_id, l.line_no, l.log,
         CASE WHEN a.labels IS NULL THEN '[]' ELSE CAST(to_json(a.labels) AS VARCHAR) END AS y,
         CASE WHEN coalesce(len(a.labels), 0) = 0 THEN 'normal' ELSE a.labels[1] END AS label
  FROM lines l LEFT JOIN arrays a ON l.doc_id = a.doc_id AND l.line_no = 1)"""
TOKEN_LINES = f"""{LINES}, token_lines AS (
  SELECT doc_id, line_no, {simple('log')} AS t FROM lines)"""
TOKENS = f"{TOKEN_LINES}, tokens AS (SELECT doc_id, line_no, unnest(t) AS token FROM token_lines)"
VECTORS = f"""vectors AS (
  SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS features, 'class_' || label AS label,
         {split('vec_id')} AS split
  FROM embeddings)"""


# ------------------------------------------------------------ sources and sinks
ORACLES["text_file_filter"] = """
SELECT lang, count(*) AS files,
       count(*) FILTER (WHERE strpos(text, chr(0)) = 0
         OR octet_length(encode(substr(text, 1, CAST(strpos(text, chr(0)) - 1 AS BIGINT)))) >= 1024)
         AS text_files
FROM documents GROUP BY lang"""

ORACLES["numbered_lines"] = f"WITH {LINES} SELECT doc_id, line_no, log FROM lines"

ORACLES["log_file_scan"] = """
WITH l AS (SELECT source, unnest(string_split(text, chr(10))) AS log FROM documents)
SELECT source, count(*) AS lines, count(*) AS last_numbers, CAST(sum(length(log)) AS BIGINT) AS chars
FROM l GROUP BY source"""

ORACLES["label_map"] = f"""
WITH {LABEL_ARRAYS}
SELECT CAST(doc_id AS VARCHAR) AS path, CAST(1 AS BIGINT) AS line_no,
       CAST(to_json(labels) AS VARCHAR) AS y FROM arrays"""

ORACLES["labelled_write_read"] = f"""
WITH {LABELLED}
SELECT d.source AS dataset, d.lang AS category, count(*) AS records,
       count(*) FILTER (WHERE y <> '[]') AS labelled, CAST(sum(length(log)) AS BIGINT) AS chars
FROM labelled JOIN documents d USING (doc_id) GROUP BY ALL"""

ORACLES["embedding_roundtrip"] = f"""
WITH {VECTORS}
SELECT split, label, count(*) AS rows, {r('sum(list_sum(features))', 4)} AS total
FROM vectors GROUP BY ALL"""

ORACLES["token_csv_parse"] = f"""
WITH {TOKEN_LINES}
SELECT doc_id, line_no, len(t) AS n, array_to_string(t, ' ') AS tokens FROM token_lines WHERE len(t) > 0"""

ORACLES["materialize_idempotent"] = f"""
WITH {LABELLED} SELECT label, count(*) AS n FROM labelled GROUP BY label"""

# --------------------------------------------------------- projections, filters
ORACLES["label_parse"] = f"""
WITH {LABELLED}, kinds AS (
  SELECT 'object' AS kind, props AS y FROM events
  UNION ALL SELECT 'scalar', '"' || event_type || '"' FROM events
  UNION ALL SELECT 'array', CAST(to_json([event_type, props]) AS VARCHAR) FROM events
  UNION ALL SELECT 'number', CAST(user_id AS VARCHAR) FROM events
  UNION ALL SELECT 'cut', '["' || event_type FROM events
  UNION ALL SELECT 'prose', text FROM documents
  UNION ALL SELECT 'lines', y FROM labelled)
SELECT kind,
       CASE WHEN NOT json_valid(y) THEN 'unknown'
            WHEN json_type(CASE WHEN json_valid(y) THEN y ELSE 'null' END) <> 'ARRAY' THEN 'unknown'
            WHEN json_array_length(CASE WHEN json_valid(y) THEN y ELSE '[]' END) = 0 THEN 'normal'
            ELSE json_extract_string(CASE WHEN json_valid(y) THEN y ELSE '[]' END, '$[0]') END AS label,
       count(*) AS n
FROM kinds GROUP BY ALL"""

LOG_PATHS = """log_paths AS (
  SELECT doc_id, lang || '/' || source AS dir, 'doc' || doc_id AS base,
         CASE WHEN n_chars > 2000 THEN '.1' ELSE '.log' END AS suffix,
         CASE WHEN n_chars > 2000 THEN 'doc' || doc_id || '.log' ELSE 'doc' || doc_id END AS stem,
         lang || '/' || source || '/doc' || doc_id ||
           CASE WHEN n_chars > 2000 THEN '.log.1' ELSE '.log' END AS rel
  FROM documents)"""
ORACLES["path_keys"] = f"""
WITH {LOG_PATHS}
SELECT rel, stem, suffix, replace(dir, '/', '_') || '_' || stem AS record_key FROM log_paths"""

ORACLES["record_preview"] = f"""
WITH {LINES}
SELECT doc_id, line_no, CASE WHEN length(log) > 50 THEN substr(log, 1, 50) || '...' ELSE log END AS preview
FROM lines QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line_no) <= 3"""

ORACLES["class_vectors"] = f"""
WITH {VECTORS} SELECT id, label, {r('list_sum(features)')} AS total FROM vectors WHERE label = 'class_3'"""

ORACLES["embedding_health"] = f"""
WITH {VECTORS}, cells AS (SELECT split, id, unnest(features) AS x FROM vectors)
SELECT split, count(DISTINCT id) AS rows, {r('avg(x)')} AS mean, {r('stddev_pop(x)')} AS std,
       bool_or(isnan(x)) AS has_nan, bool_or(isinf(x)) AS has_inf
FROM cells GROUP BY split"""

OUTCOMES = """outcomes AS (
  SELECT event_id AS id, event_type AS truth,
         CASE WHEN value < 15 THEN 'error' WHEN value > 200 THEN 'unknown' ELSE event_type END AS pred,
         CASE WHEN value < 5 THEN 'error' WHEN value > 150 THEN 'view' ELSE event_type END AS pred2
  FROM events)"""
ORACLES["label_encode"] = f"""
WITH {OUTCOMES}, u AS (SELECT truth AS label FROM outcomes UNION SELECT pred FROM outcomes),
codes AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS code FROM u)
SELECT label, code, count(*) AS n FROM codes JOIN outcomes ON truth = label GROUP BY ALL"""

ORACLES["label_universe"] = f"""
WITH {OUTCOMES} SELECT truth AS label FROM outcomes UNION SELECT pred FROM outcomes"""

# ------------------------------------------------------------------------ joins
ORACLES["label_join"] = f"WITH {LABELLED} SELECT doc_id, line_no, y, label FROM labelled"

ORACLES["label_file_match"] = f"""
WITH {LOG_PATHS}, label_paths AS (
  SELECT d.lang || '/' || d.source AS dir,
         'doc' || doc_id || CASE WHEN quality = 1 THEN '.log' ELSE '.log.2' END AS name,
         CASE WHEN quality = 1 THEN '.log' ELSE '.2' END AS suffix
  FROM labels JOIN documents d USING (doc_id))
SELECT l.rel AS log_rel,
       first(b.dir || '/' || b.name ORDER BY
         CASE WHEN b.suffix = l.suffix THEN 0
              WHEN l.suffix = '.1' AND b.suffix = '.2' THEN 1 ELSE 2 END,
         b.dir <> l.dir, b.dir || '/' || b.name) FILTER (WHERE b.name IS NOT NULL) AS label_rel
FROM log_paths l LEFT JOIN label_paths b ON starts_with(b.name, l.stem)
GROUP BY l.rel"""

ORACLES["split_80_20"] = f"WITH {LINES} SELECT doc_id, line_no, {split(LINE_ID)} AS split FROM lines"

ORACLES["exact_split"] = f"""
WITH {LINES}
SELECT doc_id, line_no,
       CASE WHEN row_number() OVER (ORDER BY {hash_of(LINE_ID)}) <= round(count(*) OVER () * 0.8)
            THEN 'train' ELSE 'test' END AS split
FROM lines"""

EDGES = f"""{TOKEN_LINES}, places AS (
  SELECT doc_id, line_no, unnest(t) AS token, unnest(range(1, len(t) + 1)) AS pos FROM token_lines),
edges AS (
  SELECT least(a.token, b.token) AS u, greatest(a.token, b.token) AS v, count(*) AS weight
  FROM places a JOIN places b
    ON a.doc_id = b.doc_id AND a.line_no = b.line_no AND b.pos > a.pos AND b.pos <= a.pos + 5
  GROUP BY ALL),
nodes AS (SELECT DISTINCT token FROM places),
ends AS (SELECT u AS token FROM edges UNION ALL SELECT v FROM edges),
degrees AS (
  SELECT n.token, coalesce(d.degree, 0) AS degree
  FROM nodes n LEFT JOIN (SELECT token, count(*) AS degree FROM ends GROUP BY token) d USING (token))"""
ORACLES["cooccurrence_edges"] = f"WITH {EDGES} SELECT u, v, weight FROM edges"

NEIGHBORS = f"""{VECTORS}, pairs AS (
  SELECT q.id, q.label AS truth, t.id AS neighbor, t.label,
         list_distance(q.features, t.features) AS d
  FROM vectors q JOIN vectors t ON q.split = 'test' AND t.split = 'train'),
nearest AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, neighbor) AS rank FROM pairs
  QUALIFY rank <= 5)"""
ORACLES["knn_neighbors"] = f"""
WITH {NEIGHBORS} SELECT id, neighbor, {r('d')} AS distance, rank FROM nearest"""

# ----------------------------------------------------------------- aggregations
ORACLES["label_distribution"] = f"""
WITH {LABELLED}
SELECT label, count(*) AS n, {r('100.0 * count(*) / sum(count(*)) OVER ()')} AS percent
FROM labelled GROUP BY label"""

ORACLES["split_label_distribution"] = f"""
WITH {LABELLED}, s AS (SELECT {split(LINE_ID)} AS split, label FROM labelled)
SELECT split, label, count(*) AS n,
       {r('100.0 * count(*) / sum(count(*)) OVER (PARTITION BY split)')} AS percent
FROM s GROUP BY split, label"""

ORACLES["dataset_summary"] = f"""
WITH {LABELLED}, s AS (SELECT {split(LINE_ID)} AS split, label FROM labelled),
top AS (SELECT label, count(*) AS n FROM s WHERE split = 'train' AND label <> 'normal'
        GROUP BY label ORDER BY n DESC, label LIMIT 5),
c AS (SELECT count(*) FILTER (WHERE split = 'train') AS train_rows,
             count(*) FILTER (WHERE split = 'test') AS test_rows,
             count(DISTINCT label) AS labels,
             count(*) FILTER (WHERE split = 'train' AND label = 'normal') AS normal_rows,
             count(*) FILTER (WHERE split = 'train' AND label <> 'normal') AS abnormal_rows FROM s)
SELECT train_rows, test_rows, labels, normal_rows,
       {r('100.0 * normal_rows / train_rows')} AS normal_percent, abnormal_rows,
       {r('100.0 * abnormal_rows / train_rows')} AS abnormal_percent,
       (SELECT string_agg(label || '=' || n, ',' ORDER BY n DESC, label) FROM top) AS top_abnormal
FROM c"""

ORACLES["top_labels_other"] = """
WITH c AS (SELECT source AS label, count(*) AS n FROM documents GROUP BY source),
k AS (SELECT *, row_number() OVER (ORDER BY n DESC, label) AS p FROM c)
SELECT label, n FROM k WHERE p <= 10
UNION ALL
SELECT 'Other', CAST(sum(n) AS BIGINT) FROM k WHERE p > 10 HAVING sum(n) > 0"""

ORACLES["file_summary"] = f"""
WITH {LINES}, k AS (
  SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS p,
         CASE WHEN length(log) > 50 THEN substr(log, 1, 50) || '...' ELSE log END AS preview
  FROM lines)
SELECT doc_id, count(*) AS records,
       string_agg(preview, ' | ' ORDER BY line_no) FILTER (WHERE p <= 3) AS sample
FROM k GROUP BY doc_id"""

ORACLES["accuracy"] = f"""
WITH {OUTCOMES}
SELECT count(*) FILTER (WHERE truth = pred) AS correct, count(*) AS total,
       {r('avg(CAST(truth = pred AS DOUBLE))')} AS accuracy FROM outcomes"""

SHARE = r("CASE WHEN sum(n) OVER (PARTITION BY truth) = 0 THEN 0 ELSE n / sum(n) OVER (PARTITION BY truth) END")
ORACLES["confusion_matrix"] = f"""
WITH {OUTCOMES}, top AS (
  SELECT truth AS label FROM outcomes GROUP BY truth ORDER BY count(*) DESC, truth LIMIT 15),
grid AS (SELECT a.label AS truth, b.label AS pred FROM top a, top b),
cells AS (SELECT truth, pred, count(*) AS c FROM outcomes GROUP BY ALL),
full_grid AS (SELECT g.truth, g.pred, coalesce(c, 0) AS n FROM grid g LEFT JOIN cells USING (truth, pred))
SELECT truth, pred, n, {SHARE} AS share FROM full_grid"""

ORACLES["confusion_matrix_full"] = f"""
WITH {OUTCOMES}, counts AS (SELECT truth, pred, count(*) AS n FROM outcomes GROUP BY ALL),
names AS (SELECT truth AS label FROM outcomes UNION SELECT pred FROM outcomes),
cells AS (SELECT a.label AS truth, b.label AS pred, coalesce(n, 0) AS n FROM names a, names b
  LEFT JOIN counts c ON c.truth = a.label AND c.pred = b.label)
SELECT truth, pred, n, {SHARE} AS share FROM cells"""


def per_class(source: str, pred: str = "pred", name: str = "m") -> str:
    return f"""{name}_labels AS (SELECT truth AS label FROM {source} UNION SELECT {pred} FROM {source}),
{name}_counts AS (
  SELECT label,
         (SELECT count(*) FROM {source} WHERE truth = label) AS support,
         (SELECT count(*) FROM {source} WHERE {pred} = label) AS predicted,
         (SELECT count(*) FROM {source} WHERE truth = label AND {pred} = label) AS tp
  FROM {name}_labels),
{name}_pr AS (
  SELECT label, support, tp,
         CASE WHEN predicted = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / predicted END AS p,
         CASE WHEN support = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / support END AS r
  FROM {name}_counts),
{name} AS (
  SELECT label, p AS precision, r AS recall,
         CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f1, support, tp
  FROM {name}_pr)"""


METRICS = f"{OUTCOMES}, {per_class('outcomes')}"
SCORES = ", ".join(f"{r(m)} AS {m}" for m in ("precision", "recall", "f1"))
WEIGHTED = ", ".join(f"{r(f'sum({m} * support) / sum(support)')} AS {m}" for m in ("precision", "recall", "f1"))
MACRO = ", ".join(f"{r(f'avg({m})')} AS {m}" for m in ("precision", "recall", "f1"))
ORACLES["class_metrics"] = f"WITH {METRICS} SELECT label, {SCORES}, support FROM m WHERE support > 0"
ORACLES["class_metrics_union"] = f"WITH {METRICS} SELECT label, {SCORES}, support FROM m"
ORACLES["weighted_prf"] = f"WITH {METRICS} SELECT {WEIGHTED} FROM m"
ACCURACY = r("CAST(sum(tp) AS DOUBLE) / sum(support)")
ORACLES["classification_report"] = f"""
WITH {METRICS}
SELECT label, {SCORES}, support FROM m
UNION ALL SELECT 'accuracy', {ACCURACY}, {ACCURACY}, {ACCURACY}, CAST(sum(support) AS BIGINT) FROM m
UNION ALL SELECT 'macro avg', {MACRO}, CAST(sum(support) AS BIGINT) FROM m
UNION ALL SELECT 'weighted avg', {WEIGHTED}, CAST(sum(support) AS BIGINT) FROM m"""
CLASS_ACCURACY = r("CASE WHEN support = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / support END")
ORACLES["class_accuracy"] = f"""
WITH {METRICS} SELECT label, support, tp AS correct, {CLASS_ACCURACY} AS accuracy FROM m"""
ORACLES["class_accuracy_top5"] = f"""
WITH {METRICS} SELECT label, support, tp AS correct, {CLASS_ACCURACY} AS accuracy FROM m
ORDER BY support DESC, label LIMIT 5"""

ORACLES["leaderboard"] = f"""
WITH {OUTCOMES}
SELECT 'original' AS model, {r('avg(CAST(truth = pred AS DOUBLE))')} AS accuracy FROM outcomes
UNION ALL SELECT 'augmented', {r('avg(CAST(truth = pred2 AS DOUBLE))')} FROM outcomes
UNION ALL SELECT 'constant', {r("avg(CAST(truth = 'click' AS DOUBLE))")} FROM outcomes"""

COMPARED = f"""{OUTCOMES}, {per_class('outcomes', 'pred', 'o')}, {per_class('outcomes', 'pred2', 'a')},
both_arms AS (
  SELECT coalesce(o.label, a.label) AS label, coalesce(o.support, 0) AS support,
         coalesce(o.precision, 0) AS op, coalesce(o.recall, 0) AS orc, coalesce(o.f1, 0) AS of1,
         coalesce(a.precision, 0) AS ap, coalesce(a.recall, 0) AS arc, coalesce(a.f1, 0) AS af1
  FROM o FULL JOIN a ON o.label = a.label),
compared AS (
  SELECT label, 'precision' AS metric, op AS original, ap AS augmented, support FROM both_arms
  UNION ALL SELECT label, 'recall', orc, arc, support FROM both_arms
  UNION ALL SELECT label, 'f1', of1, af1, support FROM both_arms)"""
CHANGE = f"{r('original')} AS original, {r('augmented')} AS augmented, {r('augmented - original')} AS change"
ORACLES["metric_compare"] = f"WITH {COMPARED} SELECT label, metric, {CHANGE}, support FROM compared"
ORACLES["metric_compare_top_f1"] = f"""
WITH {COMPARED} SELECT label, metric, {CHANGE}, support FROM compared
WHERE metric = 'f1' ORDER BY abs(compared.augmented - compared.original) DESC, label LIMIT 10"""
ORACLES["metric_compare_overall"] = f"""
WITH {COMPARED}, weights AS (
  SELECT metric, sum(original * s) / sum(s) AS original, sum(augmented * s) / sum(s) AS augmented
  FROM compared JOIN (SELECT truth AS l, count(*) AS s FROM outcomes GROUP BY truth) ON l = label
  GROUP BY metric)
SELECT metric, {CHANGE} FROM weights"""

ORACLES["class_weights"] = f"""
WITH {LABELLED}
SELECT label, count(*) AS n,
       {r('CAST(sum(count(*)) OVER () AS DOUBLE) / count(*) OVER () / count(*)')} AS weight
FROM labelled GROUP BY label"""

ORACLES["graph_size"] = f"""
WITH {EDGES} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges"""

# ----------------------------------------------------------- text and embedding
ORACLES["tokenize_simple"] = f"""
WITH {LINES} SELECT doc_id, line_no, array_to_string({simple('log')}, ' ') AS tokens FROM lines"""
ORACLES["tokenize_tfidf"] = f"""
WITH {LINES} SELECT doc_id, line_no, array_to_string({words('log')}, ' ') AS tokens FROM lines"""

TERM_LINES = f"""{LINES}, word_lines AS (
  SELECT doc_id, line_no, {split(LINE_ID)} AS split, {words('log')} AS w FROM lines),
term_lines AS (
  SELECT doc_id, line_no, split,
         list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS terms
  FROM word_lines)"""
ORACLES["ngrams_1_2"] = f"""
WITH {TERM_LINES} SELECT doc_id, line_no, array_to_string(terms, '|') AS terms FROM term_lines"""

ORACLES["char_ngrams"] = f"""
WITH {TOKENS}, d AS (SELECT DISTINCT token, '<' || token || '>' AS w FROM tokens)
SELECT token, array_to_string(flatten(list_transform(range(3, least(6, length(w)) + 1),
         lambda n: list_transform(range(1, length(w) - n + 2), lambda i: substr(w, i, n)))), '|') AS grams
FROM d"""

STATS = """stats AS (
  SELECT term, CAST(sum(tf) AS BIGINT) AS cf, count(*) AS df FROM (
    SELECT doc_id, line_no, term, count(*) AS tf FROM (
      SELECT doc_id, line_no, unnest(terms) AS term FROM {source}) GROUP BY ALL)
  GROUP BY term)"""
ORACLES["term_stats"] = f"""
WITH {TERM_LINES}, {STATS.format(source='term_lines')} SELECT term, cf, df FROM stats"""

VOCAB = f"""{TERM_LINES}, train AS (SELECT * FROM term_lines WHERE split = 'train'),
{STATS.format(source='train')}, size AS (SELECT count(*) AS n FROM train),
vocab AS (
  SELECT term, cf, df, ln((1.0 + n) / (1.0 + df)) + 1 AS idf FROM stats, size
  WHERE df >= 2 AND df <= 0.9::DOUBLE * n ORDER BY cf DESC, term LIMIT 5000)"""
ORACLES["tfidf_vocab"] = f"WITH {VOCAB} SELECT term, cf, df, {r('idf')} AS idf FROM vocab"
ORACLES["tfidf_weights"] = f"""
WITH {VOCAB}, cells AS (
  SELECT doc_id, line_no, split, term, count(*) AS tf FROM (
    SELECT doc_id, line_no, split, unnest(terms) AS term FROM term_lines) GROUP BY ALL),
raw AS (SELECT doc_id, line_no, split, term, (1 + ln(tf)) * idf AS w FROM cells JOIN vocab USING (term)),
unit AS (SELECT split, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id, line_no)) AS w FROM raw)
SELECT split, term, count(*) AS rows, {r('sum(w)', 4)} AS weight FROM unit GROUP BY ALL"""

ORACLES["tfidf_svd"] = f"""
WITH {VOCAB}, hits AS (SELECT DISTINCT doc_id, line_no, true AS hit FROM (
  SELECT doc_id, line_no, unnest(terms) AS term FROM term_lines) JOIN vocab USING (term))
SELECT doc_id, line_no, split, least(100, (SELECT count(*) FROM vocab))::BIGINT AS size, hit IS NULL AS zero
FROM term_lines LEFT JOIN hits USING (doc_id, line_no)"""

ORACLES["mean_token_vectors"] = f"""
WITH {TOKENS}, known AS (
  SELECT DISTINCT token, length(token) AS n, length(token) - length(replace(token, 'e', '')) AS e
  FROM tokens WHERE {in_train(LINE_ID)}),
sums AS (
  SELECT doc_id, line_no, count(*) AS known, avg(n) AS v0, avg(n * n) AS v1, avg(e) AS v2
  FROM tokens JOIN known USING (token) GROUP BY ALL)
SELECT doc_id, line_no, coalesce(known, 0) AS known, {r('coalesce(v0, 0.0)')} AS v0,
       {r('coalesce(v1, 0.0)')} AS v1, {r('coalesce(v2, 0.0)')} AS v2
FROM lines LEFT JOIN sums USING (doc_id, line_no)"""

# learned vectors: what is determined about them
_KNOWN = f"""{TOKENS}, train AS (SELECT DISTINCT token FROM tokens WHERE {in_train(LINE_ID)}),
found AS (SELECT doc_id, line_no, count(*) AS known FROM tokens JOIN train USING (token) GROUP BY ALL)"""
ORACLES["word2vec_docs"] = f"""
WITH {_KNOWN} SELECT doc_id, line_no, coalesce(known, 0) AS known, 100::BIGINT AS size, known IS NULL AS zero
FROM lines LEFT JOIN found USING (doc_id, line_no)"""
ORACLES["indexed_docs"] = f"""
WITH {_KNOWN} SELECT doc_id, line_no, coalesce(known, 0) AS known, 100::BIGINT AS size
FROM lines LEFT JOIN found USING (doc_id, line_no)"""


def crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, from the table of its rule; DuckDB has no function for it."""
    table = []
    for byte in range(256):
        for _ in range(8):
            byte = (byte >> 1) ^ (0xEDB88320 if byte & 1 else 0)
        table.append(byte)
    each = f"list_transform(range(strlen({text})), lambda i: ('0x' || substr(hex(encode({text})), 2 * i::BIGINT + 1, 2))::BIGINT)"
    return (
        f"xor(list_reduce([4294967295::BIGINT] || {each}, "
        f"lambda a, b: xor(a >> 8, ({table}::BIGINT[])[(xor(a, b) & 255) + 1])), 4294967295)"
    )


# a token has a vector if it was trained, or shares a bucket of n-grams with one that was
ORACLES["subword_docs"] = f"""
WITH {TOKENS}, train AS (SELECT DISTINCT token FROM tokens WHERE {in_train(LINE_ID)}),
every AS (SELECT token, token IN (SELECT token FROM train) AS trained FROM (SELECT DISTINCT token FROM tokens)),
marked AS (SELECT token, trained, '<' || token || '>' AS m FROM every),
grams AS (SELECT token, trained, substr(m, i, n) AS g FROM (SELECT *, unnest(range(1, length(m) - n + 2)) AS i
  FROM (SELECT *, unnest(range({SHORTEST}, {LONGEST} + 1)) AS n FROM marked) WHERE n <= length(m))),
buckets AS (SELECT g, {crc32('g')} % {BUCKETS} AS b FROM (SELECT DISTINCT g FROM grams)),
held AS (SELECT DISTINCT b FROM grams JOIN buckets USING (g) WHERE trained),
known AS (SELECT token FROM every WHERE trained UNION
  SELECT token FROM grams JOIN buckets USING (g) JOIN held USING (b) WHERE NOT trained),
found AS (SELECT doc_id, line_no, count(*) AS known FROM tokens JOIN known USING (token) GROUP BY ALL)
SELECT doc_id, line_no, coalesce(known, 0) AS known, 100::BIGINT AS size, known IS NULL AS zero
FROM lines LEFT JOIN found USING (doc_id, line_no)"""
ORACLES["graph_docs"] = f"""
WITH {TOKEN_LINES} SELECT doc_id, line_no, 103::BIGINT AS size, len(t) = 0 AS zero FROM token_lines"""

ORACLES["hash_sample"] = f"""
WITH {LINES} SELECT doc_id, line_no FROM lines ORDER BY {hash_of(LINE_ID)} LIMIT 5000"""

# ------------------------------------------------------------------------ graph
ORACLES["degree_centrality"] = f"""
WITH {EDGES}
SELECT token, degree, {r('degree / ((SELECT count(*) FROM nodes) - 1.0)')} AS centrality FROM degrees"""

SUBGRAPH = f"""{EDGES}, top AS (SELECT token FROM degrees ORDER BY degree DESC, token LIMIT 100),
sub AS (SELECT * FROM edges WHERE u IN (SELECT token FROM top) AND v IN (SELECT token FROM top)),
sub_ends AS (SELECT u AS token FROM sub UNION ALL SELECT v FROM sub)"""
ORACLES["top_degree_subgraph"] = f"""
WITH {SUBGRAPH}
SELECT u, v, weight, {r('0.5 + 2.0 * weight / (SELECT max(weight) FROM sub)')} AS width FROM sub"""
_LEVELS = 6  # of a dense graph of 100 nodes
_PATHS = ",\n".join(
    f"""p{k} AS (SELECT s, b AS v, {k} AS d, sum(c)::DOUBLE AS c FROM p{k - 1} JOIN ways ON a = v
  WHERE (s, b) NOT IN (SELECT (s, v) FROM seen{k - 1}) GROUP BY ALL),
seen{k} AS (SELECT s, v FROM seen{k - 1} UNION ALL SELECT s, v FROM p{k})"""
    for k in range(1, _LEVELS + 1)
)
ORACLES["betweenness_subgraph"] = f"""
WITH {SUBGRAPH}, ways AS (SELECT u AS a, v AS b FROM sub WHERE u <> v UNION SELECT v, u FROM sub WHERE u <> v),
p0 AS (SELECT token AS s, token AS v, 0 AS d, 1.0::DOUBLE AS c FROM top), seen0 AS (SELECT s, v FROM p0),
{_PATHS},
paths AS ({" UNION ALL ".join(f"SELECT * FROM p{k}" for k in range(1, _LEVELS + 1))}),
dep AS (SELECT x.v AS token, sum(x.c * y.c / z.c) AS b FROM paths x JOIN paths y ON y.s = x.v
  JOIN paths z ON z.s = x.s AND z.v = y.v AND z.d = x.d + y.d GROUP BY ALL)
SELECT token, {r('coalesce(b, 0) / ((n - 1) * (n - 2))')} AS centrality, n AS sources
FROM top LEFT JOIN dep USING (token), (SELECT count(*) AS n FROM top)"""
ORACLES["subgraph_styling"] = f"""
WITH {SUBGRAPH}
SELECT token, count(s.token) AS degree,
       count(s.token) > (SELECT count(*) FROM top) / 10.0 AS labelled
FROM top t LEFT JOIN sub_ends s USING (token) GROUP BY token"""

ORACLES["eigenvector_centrality"] = f"""
WITH RECURSIVE {EDGES}, links AS (
  SELECT u AS a, v AS b FROM edges UNION ALL SELECT v, u FROM edges WHERE u <> v
  UNION ALL SELECT token, token FROM nodes),
size AS (SELECT count(*) AS n FROM nodes),
rounds AS (
  SELECT 0 AS k, token, 1.0::DOUBLE / n AS x, 1e9::DOUBLE AS moved FROM nodes, size
  UNION ALL
  SELECT k + 1, token, x, sum(abs(x - x0)) OVER () AS moved FROM (
    SELECT k, token, y / sqrt(sum(y * y) OVER ()) AS x, x0 FROM (
      SELECT r.k, l.b AS token, sum(r.x) AS y, any_value(o.x) AS x0
      FROM rounds r JOIN links l ON r.token = l.a JOIN rounds o ON o.token = l.b, size
      WHERE r.moved >= size.n * 1e-6 AND r.k < 1000
      GROUP BY r.k, l.b)))
SELECT token, {r('x')} AS centrality, false AS fallback
FROM rounds WHERE k = (SELECT max(k) FROM rounds)"""

# ----------------------------------------------------------------------- models
ORACLES["knn_predictions"] = f"""
WITH {NEIGHBORS}, votes AS (
  SELECT id, truth, label, count(*) FILTER (WHERE d = 0) AS z,
         coalesce(sum(1 / d) FILTER (WHERE d > 0), 0) AS w
  FROM nearest GROUP BY ALL)
SELECT id, truth, label AS pred FROM votes
QUALIFY row_number() OVER (PARTITION BY id ORDER BY z DESC, CASE WHEN z > 0 THEN 0 ELSE w END DESC, label) = 1"""

# ----------------------------------------------------------------- augmentation
ORACLES["minority_plan"] = f"""
WITH {OUTCOMES}, c AS (SELECT pred AS label, count(*) AS n FROM outcomes GROUP BY pred),
m AS (SELECT label, n, max(n) OVER () AS majority FROM c)
SELECT label, n, majority, (n < 0.1::DOUBLE * majority AND label <> 'normal') AS minority,
       CASE WHEN n < 0.1::DOUBLE * majority AND label <> 'normal' AND n >= 5 THEN majority - n ELSE 0 END AS need
FROM m"""

CELLS = f"""{VECTORS}, cells AS (
  SELECT id, label, unnest(features) AS x, unnest(range(0, len(features))) AS dim FROM vectors),
scaler AS (
  SELECT label, dim, avg(x) AS mean, CASE WHEN stddev_pop(x) = 0 THEN 1.0 ELSE stddev_pop(x) END AS std
  FROM cells GROUP BY ALL)"""
ORACLES["class_scaler"] = f"""
WITH {CELLS} SELECT label, dim, {r('mean')} AS mean, {r('std')} AS std FROM scaler"""
ORACLES["class_scale_roundtrip"] = f"""
WITH {CELLS}
SELECT id, {r('sum(abs((x - mean) / std))')} AS scaled_size,
       {r('sum((x - mean) / std * std + mean)')} AS restored_total
FROM cells JOIN scaler USING (label, dim) GROUP BY id"""

BINARY = """b AS (
  SELECT CASE WHEN label = 0 THEN 'attack' ELSE 'normal' END AS label, count(*) AS n
  FROM embeddings GROUP BY ALL),
plan AS (
  SELECT label, n, CASE WHEN label <> 'normal' AND n < 0.2::DOUBLE * max(n) OVER () AND n >= 5
                        THEN max(n) OVER () - n ELSE 0 END AS need FROM b)"""
ORACLES["synthetic_rows"] = f"""
WITH {BINARY}
SELECT label, need AS rows, need AS distinct_rows, need AS inside FROM plan WHERE need > 0"""
_PICK = "('0x' || substr(md5(concat_ws('|', 42, label, row, '{}')), 1, 13))::bigint"
ORACLES["interpolated_rows"] = f"""
WITH {BINARY},
x AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v,
        CASE WHEN label = 0 THEN 'attack' ELSE 'normal' END AS label,
        md5(concat_ws('|', 42, 'number', vec_id::varchar)) AS h FROM embeddings),
k AS (SELECT *, row_number() OVER (PARTITION BY label
        ORDER BY ('0x' || substr(h, 1, 8))::bigint % 4096, h) - 1 AS number FROM x),
w AS (SELECT label, n, unnest(range(need)) AS row FROM plan WHERE need > 0),
p AS (SELECT *, {_PICK.format("a")} % n AS a, {_PICK.format("b")} % n AS b,
        {_PICK.format("t")} / 4503599627370496.0::DOUBLE AS share FROM w)
SELECT p.label, p.row, c.id AS first_id, d.id AS second_id, round(share, 6) + 0 AS share,
  round(list_sum(list_transform(range(1, len(c.v) + 1), lambda i: c.v[i] + share * (d.v[i] - c.v[i]))), 4) + 0 AS total
FROM p JOIN k c ON c.label = p.label AND c.number = p.a JOIN k d ON d.label = p.label AND d.number = p.b"""
ORACLES["augmented_union"] = f"""
WITH {BINARY}
SELECT 'augmented' AS arm, 'real' AS origin, label, n AS rows FROM plan
UNION ALL SELECT 'original', 'real', label, n FROM plan
UNION ALL SELECT 'augmented', 'synthetic', label, need FROM plan WHERE need > 0"""
ORACLES["augmented_distribution"] = f"""
WITH {BINARY} SELECT label, n + need AS n, need AS added FROM plan"""

# --------------------------------------------------------------------- streaming
ORACLES["alerts_per_window"] = """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type AS label,
       count(*) AS alerts
FROM events GROUP BY ALL"""
ORACLES["stream_numbered_lines"] = ORACLES["numbered_lines"]
