"""Sharding, prefix trie, fill-in-the-middle, language-model filters in shards, and texts that strain patterns."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logwarden.llm import fill_middle, lm_scores, prefix_trie, pseudonyms, secret_scan, sharding
from logwarden.llm.registry import ORACLES, QUERIES
from oracle_check import compare, duck

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


# --------------------------------------------------------------------- sharding
@pytest.mark.parametrize("total, good, n", [(40, 13, 9), (12, 12, 5), (30, 0, 7), (1000, 400, 1), (6, 2, 5), (2000, 1000, 1000)])
def test_hypergeometric_draws(spark, total, good, n):
    """Over a grid of u, each count comes as often as its exact probability says."""
    grid = 4000
    u = (F.col("id") + 0.5) / grid
    rows = spark.range(grid).select(sharding.hypergeometric(F.lit(total), F.lit(good), F.lit(n), u).alias("k"))
    got = {r["k"]: r["count"] for r in rows.groupBy("k").count().collect()}
    for k in range(max(0, n - total + good), min(n, good) + 1):
        p = math.comb(good, k) * math.comb(total - good, n - k) / math.comb(total, n)
        assert abs(got.pop(k, 0) - p * grid) <= 1.01
    assert not got


def test_matrix_has_exact_margins(spark):
    rng = np.random.default_rng(5)
    sizes = rng.integers(0, 60, 1024) * (rng.random(1024) < 0.7)
    counts = spark.createDataFrame([(i, int(c)) for i, c in enumerate(sizes) if c], "part long, c long")
    got = {r["part"]: r["row"] for r in sharding.communication_matrix(counts, 2, 5).collect()}
    n = int(sizes.sum())
    assert {p: sum(r) for p, r in got.items() if sum(r)} == {i: int(c) for i, c in enumerate(sizes) if c}
    assert np.sum(list(got.values()), axis=0).tolist() == [n // 5 + (s < n % 5) for s in range(5)]
    share = np.array([r[0] for r in got.values() if sum(r) > 30]) / [sum(r) for r in got.values() if sum(r) > 30]
    assert 0.03 < share.std() < 0.12 and abs(share.mean() - 0.2) < 0.02  # a draw, not a split in proportion


def test_dealing_odd_rows(spark, tmp_path):
    rows = [(i, f"text {i % 50}", 1, {"a": i}) for i in range(400)] + [(None, None, 2, None)] * 300 + [(7, "", 3, {})] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int, extra map<string, int>")
    got = sharding.deal(docs)
    assert got.columns == ["doc_id", "text", "extra", "shard", "slot"]
    found = [tuple(r) for r in got.withColumn("extra", F.to_json("extra")).collect()]
    assert sorted(map(str, ((r[0], r[1]) for r in found))) == sorted(map(str, ((r[0], r[1]) for r in rows)))
    for s in range(8):
        slots = sorted(r[4] for r in found if r[3] == s)
        assert slots == list(range(len(slots))) and len(slots) in (88, 89)
    nulls = Counter(r[3] for r in found if r[0] is None)
    assert max(nulls.values()) < 65 and len(nulls) == 8  # copies of a row are spread
    again = sharding.deal(docs.repartition(3)).withColumn("extra", F.to_json("extra")).collect()
    assert sorted(map(str, map(tuple, again))) == sorted(map(str, found))
    sharding.write_shards(got, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)
    assert sharding.deal(docs.limit(0)).count() == 0


def test_shards_are_uniform(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    got = sharding.deal(docs).toPandas().sort_values("doc_id")
    table = np.zeros((8, 8))
    np.add.at(table, (got["doc_id"] // 500, got["shard"]), 1)
    assert ((table - 62.5) ** 2 / 62.5).sum() < 90  # 49 degrees of freedom
    assert abs(np.corrcoef(got["doc_id"], got["slot"])[0, 1]) < 0.06


# ------------------------------------------------------------------ prefix trie
def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn, role or "", text or ""))
    for c in own:
        own[c] = [(r, t) for _, _, r, t in sorted(own[c], key=lambda x: (x[0], x[1] or 0, hashlib.md5(f"{len(x[2])}:{x[2]}{x[3]}".encode()).digest()))]
    nodes, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(math.fmod(c, 20))
        full = own.get(base, [])[:h] + own[c][h:]
        for d in range(len(full) + 1):
            nodes[tuple(full[:d])].append(c)
        ends[tuple(full)].append(c)
    out = {}
    for prefix, members in nodes.items():
        below = [p for p in nodes if p[: len(prefix)] == prefix]
        out[members[0], len(prefix)] = (
            nodes[prefix[:-1]][0] if prefix else None, len(members), sum(len(p) == len(prefix) + 1 for p in below),
            sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below) for p in below),
            sum((len(nodes[p]) - 1) * len(WORD.findall(p[-1][1])) for p in below if p),
            hashlib.sha256(",".join(map(str, ends[prefix])).encode()).hexdigest(),
        )
    return out


def trie_rows(seed=1, n=140):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        for t in range(int(rng.integers(1, 7))):
            rows.append((c, t, "user" if t % 2 == 0 else "bot", "word " * int(rng.integers(1, 3)) if rng.random() < 0.8 else f"own {c}"))
    rows += [(500 + i, t, "user", f"hot {t}") for i in range(60) for t in range(3)]  # equal conversations
    rows += [(None, 0, "user", "nobody"), (900, None, None, None), (900, 3, "a", "b"), (900, 3, "a", "b"), (900, 3, "a", "a"), (-3, 0, "user", ""), (901, 0, "u", "x" * 3000)]
    rows += [(902, t, "user", "same") for t in range(300)]  # a long one
    return rows


@pytest.mark.parametrize("turns, ids", [(100_000, 4096), (40, 3)])
def test_trie_equals_brute_force(spark, monkeypatch, turns, ids):
    monkeypatch.setattr(prefix_trie, "RUN_TURNS", turns)
    monkeypatch.setattr(prefix_trie, "IDS", ids)
    rows = trie_rows()
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("id", F.lit(1)).withColumn("units", F.lit(2))
    got = prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.sequences(table.repartition(5)))).collect()
    want = brute_trie(rows)
    assert len(got) == len(want)
    for r in got:
        assert want[r["conv_id"], r["depth"]] == (
            r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]
        )


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(prefix_trie.sequences(empty)).count() == 0
    convs = spark.createDataFrame([(5, []), (2, [])], "id long, units array<binary>")
    (root,) = prefix_trie.prefix_trie(convs).collect()
    assert (root["conv_id"], root["depth"], root["parent_conv_id"], root["n_convs"], root["n_leaves"]) == (2, 0, None, 2, 1)
    assert root["ends_sha256"] == hashlib.sha256(b"2,5").hexdigest()


def test_extents_equal_a_scan():
    rng = np.random.default_rng(2)
    lcp = rng.integers(0, 4, 37)
    row, depth = rng.integers(0, 38, 500), rng.integers(1, 4, 500)
    left, right = prefix_trie.extents(prefix_trie.sparse_table(lcp), row, depth)
    for r, d, a, b in zip(row, depth, left, right, strict=True):
        lo = hi = r
        while lo and lcp[lo - 1] >= d:
            lo -= 1
        while hi < 37 and lcp[hi] >= d:
            hi += 1
        assert (a, b) == (lo, hi)


# ------------------------------------------------------------------- fill-in-middle
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_fim(i, text, cut=None):
    text = text or ""
    parts = TOKEN.findall(text)
    h = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(parts) + 1), h2 % (len(parts) + 1)))
    p, m, s = ("".join(x) for x in (parts[:a], parts[a:b], parts[b:]))
    if not text or any(k in text for k in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(parts), "plain", None, None, text
    if h4 % 100 < 80:
        return len(parts), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(parts), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def fim_texts():
    rng = np.random.default_rng(9)
    texts = [None, "", " ", "a", "a ", " a", "\t\n", "x <M> y", "<P", "S> <S", "\U0001f600 é  x  ", "word " * 40_000 + "end"]
    texts += ["z" * int(n) + " b" * 300 for n in rng.integers(1, 9000, 10)]
    texts += ["".join(rng.choice(list("ab é\U0001f600 \n<>PSM"), rng.integers(1, 400))) for _ in range(150)]
    texts += [" ".join("w" * int(k) for k in rng.zipf(1.6, 3000).clip(1, 4000))]
    return texts


def test_fill_in_middle_equals_brute_force(spark):
    texts = fim_texts()
    rows = [(i, t, 1, "keep") for i, t in enumerate(texts)] + [(None, "no id here", 1, "keep")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, form int, boundaries2 string")
    made = fill_middle.fill_in_middle(fill_middle.with_boundaries(docs)).withColumn(
        "back", fill_middle.restored(F.col("fim_text"), F.col("form"))
    )
    got = made.collect()
    assert len(got) == len(rows) and got[0]["boundaries2"] == "keep"
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    for r in got:
        want = brute_fim(r["doc_id"], r["text"])
        assert (r["n_tokens"], r["form"], r["prefix_chars"], r["middle_chars"], r["fim_text"]) == want
        assert r["back"] == (r["text"] or "")
    assert fill_middle.with_boundaries(docs.limit(0)).count() == 0


def test_stored_index_serves_other_draws(spark, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(fim_texts())], "doc_id long, text string")
    fill_middle.with_boundaries(docs).write.parquet(str(tmp_path / "indexed"))
    kept = spark.read.parquet(str(tmp_path / "indexed"))
    forms = [fill_middle.fill_in_middle(kept, seed=s, plain_below=100).select("fim_text", "form", "text") for s in ("1:", "2:")]
    assert forms[0].exceptAll(forms[1]).count() > 50
    for made in forms:
        assert made.where(fill_middle.restored(F.col("fim_text"), F.col("form")) != F.coalesce("text", F.lit(""))).count() == 0


def test_index_is_bounded_and_exact_at_every_rank(spark):
    places = np.concatenate([[0], np.cumsum(np.random.default_rng(3).zipf(1.7, 30_000).clip(1, 3000))])
    ranks, starts, slopes, residuals = fill_middle.fit(places)
    assert np.abs(residuals).max() <= fill_middle.BOUND + 1 and len(ranks) < 6000
    seg = np.searchsorted(ranks, np.arange(len(places)), side="right") - 1
    run = np.arange(len(places)) - np.array(ranks)[seg]
    assert (np.array(starts)[seg] + np.floor(run * np.array(slopes)[seg] + 0.5) + residuals == places).all()
    even = np.arange(0, 700_000, 7)
    assert len(fill_middle.fit(even)[0]) == 1 and len(fill_middle.fit(np.array([0]))[0]) == 1
    docs = spark.createDataFrame([(1, " ".join("w" * int(n) for n in np.diff(places)[:400]))], "doc_id long, text string")
    text = docs.first()["text"]
    every = fill_middle.with_boundaries(docs).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(400))))
    got = dict(every.select("r", fill_middle.place_of(F.col("boundaries"), F.col("r"))).collect())
    ends = [0, *(m.end() for m in TOKEN.finditer(text))]
    assert got == dict(enumerate(ends))


# ------------------------------------------------------------- language-model filter
def lm_corpus(n=90):
    rng = np.random.default_rng(4)
    vocabulary = [f"{a}{b}" for a in "ka lo mi re ta".split() for b in "na su pe vo di ru".split()]
    return [" ".join(rng.choice(vocabulary, rng.integers(1, 90))) for _ in range(n)] + [None, "", "Z " * 4000]


def lm_table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_probes_that_travel_read_the_same_levels(spark, monkeypatch):
    docs = lm_table(spark, lm_corpus()).withColumn("row", F.lit(1)).withColumn("part", F.lit(1))
    monkeypatch.setattr(lm_scores, "PARTITION_BYTES", 2000)
    rows = lambda: sorted(map(tuple, lm_scores.scores(docs, ~lm_scores.held_out()).collect()))
    whole = rows()
    for name, value in (("MAX_BITS", 100), ("SHARD_BITS", 4000), ("PART_BYTES", 700)):
        monkeypatch.setattr(lm_scores, name, value)
    parted = rows()
    for a, b in zip(whole, parted, strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:])


def test_score_equals_brute_force(spark, monkeypatch):
    """With a filter too large to err, the score follows from the exact counts' levels."""
    monkeypatch.setattr(lm_scores, "BITS_PER_ITEM", 400)
    texts = lm_corpus()
    got = {r["doc_id"]: r["score"] for r in lm_scores.scores(lm_table(spark, texts), ~lm_scores.held_out()).collect()}
    end = ("end",)
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    tokens = {i: [*WORD.findall(low(t)), end] for i, t in enumerate(texts)}
    pairs = {i: list(zip([end, *t[:-1]], t)) for i, t in tokens.items()}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2]
    one, two = Counter(), Counter()
    for i in train:
        one.update(tokens[i])
        two.update(pairs[i])
    n, v = sum(one.values()), len(one)
    level = lambda c: math.floor(math.log2(c)) + 1 if c else 0
    middle = lambda c, off: max(0, (2.0 ** (level(c) - 1) + 2.0 ** level(c) - 1) / 2 - off) if c else 0.0

    def p(a, b, m, off):
        have = middle(one[a], off)
        both = min(middle(two[a, b], off), have)
        return m * (both / have if have else 0) + (1 - m) * (middle(one[b], off) + 1) / (n + v + 1)

    by_level = defaultdict(Counter)
    for i in train:
        for a, b in pairs[i]:
            by_level[level(one[a])][a, b] += 1
    best = {0: 0.0}
    for q, seen in by_level.items():
        if q:
            best[q] = max(lm_scores.WEIGHTS.tolist(), key=lambda m: sum(k * math.log(p(a, b, m, 1.0)) for (a, b), k in seen.items()))
    held = {i for i in tokens if i not in train}
    for i in tokens:
        assert got[i] == pytest.approx(sum(math.log10(p(a, b, best.get(level(one[a]), 0.001), 0.0)) for a, b in pairs[i]), abs=1e-6)
    base = lambda i: sum(math.log10((one[w] + 1) / (n + v + 1)) for w in tokens[i])
    assert len(held) > 5 and sum(got[i] for i in held) > sum(base(i) for i in held)


# ---------------------------------------------------------------- straining patterns
LONG = 1 << 20
STRAIN = [
    "a@b" + ".c" * 100_000, "x@" + "ab." * 100_000 + "com", "a@" + "b" * LONG, "a" * LONG, "A" * LONG, "0" * LONG, "AKIA" + "A" * LONG,
    "password=" + "a" * LONG, "1234 " * (LONG // 5), "4041-" * (LONG // 5), "1." * (LONG // 2), "http://" + "x" * LONG, "+1" * (LONG // 2),
    "GB82 " + "ABCD " * (LONG // 5), "user=" + "u" * LONG, "2024-01-01" * (LONG // 10), "a.b@c.de " * (LONG // 40), "(" * LONG, "é" * LONG, "@" * LONG, "." * LONG, "-" * LONG,
]


@pytest.mark.parametrize("name", ["op2", "op10"])
def test_long_texts_do_not_end_an_executor(spark, name):
    docs = lm_table(spark, [*STRAIN, "mail bob.smith@mail.example.com"]).repartition(4)
    if name == "op2":
        found = secret_scan.secret_digest(secret_scan.find_secrets(docs))
        assert found.count() == len(STRAIN) + 1 and found.where("n_assign > 0").count() == 1
    else:
        got = {r["doc_id"]: r for r in pseudonyms.pseudonymise(docs).select("doc_id", F.length("text").alias("n"), "n_email").collect()}
        assert len(got) == len(STRAIN) + 1 and got[len(STRAIN)]["n_email"] == 1 and got[1]["n_email"] == 1


# -------------------------------------------------------------------------- contracts
CONTRACT = {
    "op1_nearest": "query_id bigint, rank int, vec_id bigint, score double",
    "op2_secret_scan": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op3_line_dedup": "page_id bigint",
    "op4_lm_scores": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op5_ngram_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op6_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op7_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op8_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op9_fingerprints": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op10_pseudonyms": "doc_id bigint, text string",
    "op11_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op12_prefix_trie": "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string",
    "op13_fill_middle": "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string",
}


@needs_tables
@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_registered_query_keeps_its_columns(spark, name):
    got = QUERIES[name](spark, SF)
    types = dict(got.dtypes)
    for column in CONTRACT[name].split(", "):
        column, kind = column.split(" ")
        assert types[column] == kind, column
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    if "doc_id" in types and name != "op6_packing":
        assert got.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0 and got.count() == docs.count()
    if "held_out" in types:
        fold = {"op4_lm_scores": 7, "op8_language_id": 4}[name]
        assert {r["doc_id"]: r["held_out"] for r in got.select("doc_id", "held_out").collect()} == {
            r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % fold == 2 for r in docs.select("doc_id").collect()
        }


def test_every_query_is_under_contract():
    assert set(CONTRACT) == set(QUERIES) and set(ORACLES) <= set(QUERIES)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_join", "mixing", "packing"]
