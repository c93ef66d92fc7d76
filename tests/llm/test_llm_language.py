"""Language identification against a plain version, text by text and n-gram by n-gram."""

import math
import os
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from logwarden.llm import language_id as L
from logwarden.llm.common import mixed_bits, text_bytes

SF = "/root/testdata/sf0.001/documents.parquet"
needs_tables = pytest.mark.skipif(not os.path.isfile(SF), reason="test tables are not here")


def plain_grams(text):
    kept = bytearray()
    for byte in text.lower().encode():
        byte = byte + 32 if 65 <= byte <= 90 else byte
        byte = byte if byte >= 0x80 or 97 <= byte <= 122 else 32
        if byte != 32 or not kept or kept[-1] != 32:
            kept.append(byte)
    out = Counter()
    for n in L.ORDERS:
        for i in range(len(kept) - n + 1):
            h = sum(int(L.BYTE[k][kept[i + k]]) for k in range(n)) % 2**64
            out[int(mixed_bits(np.array([h], np.uint64))[0]) >> (64 - L.BITS)] += 1
    return out


def plain_model(counts):
    """Tables of log odds and loss weights of the bits, from a Counter for each language."""
    langs = sorted(counts)
    size = 1 << L.BITS
    code = [[1 if (s >> i) & 1 else -1 for s in range(1, 2 ** (len(langs) - 1))] for i in range(len(langs))]
    share = {}
    for x in langs:
        total = sum(counts[x].values()) + 0.5 * size
        share[x] = lambda b, x=x, total=total: (counts[x][b] + 0.5) / total
    seen = set().union(*counts.values()) | {-1}  # -1 stands for all that training has not seen
    tables, weight = [], []
    for k in range(len(code[0])):
        sides = {s: [x for i, x in enumerate(langs) if code[i][k] == s] for s in (1, -1)}
        odds = {b: math.log(sum(share[x](b) for x in sides[1]) / len(sides[1])) - math.log(sum(share[x](b) for x in sides[-1]) / len(sides[-1])) for b in seen}
        tables.append({b: max(-32000, min(32000, round(o * L.SCALE))) for b, o in odds.items()})
        means = [sum(n * odds[b] for b, n in counts[x].items()) / max(1, sum(counts[x].values())) for x in langs]
        weight.append(max(1e-3, min(m * code[i][k] for i, m in enumerate(means))))
    return langs, code, tables, [w / sum(weight) for w in weight]


def plain_predict(model, text):
    langs, code, tables, weight = model
    found = plain_grams(text)
    n = sum(found.values())
    margins = [sum(c * t.get(b, t[-1]) for b, c in found.items()) / L.SCALE * math.sqrt(min(n, 100)) / max(n, 1) for t in tables]
    loss = [sum(w * math.log1p(math.exp(-m * s)) for w, m, s in zip(weight, margins, word, strict=True)) for word in code]
    p = [math.exp((min(loss) - x) * len(tables)) for x in loss]
    order = sorted(range(len(langs)), key=lambda i: loss[i])
    top, second = (p[i] / sum(p) for i in order[:2])
    return langs[order[0]], top, top - second < L.AMBIGUOUS


def documents(path=SF):
    return duckdb.sql(f"select doc_id, text, lang from '{path}' order by doc_id").fetchall()


def counted(rows):
    batch = pa.RecordBatch.from_pydict({"text": pa.array([t for t, _ in rows]), "lang": pa.array([x for _, x in rows])})
    counts = {}
    for part in L._count(iter([batch])):
        for x, b, n in zip(*(part.column(c).to_pylist() for c in ("lang", "bucket", "n")), strict=True):
            counts.setdefault(x, Counter())[b] += n
    return counts


@needs_tables
def test_counts_and_predictions_equal_a_plain_version():
    docs = [(i, t[:700], x) for i, t, x in documents() if t and x][:90]
    train = [(t.lower(), x) for i, t, x in docs if zlib.crc32(str(i).encode()) % 4 != 2]
    counts = counted(train)
    want = {}
    for t, x in train:
        want.setdefault(x, Counter()).update(plain_grams(t))
    assert counts == want
    langs = sorted(counts)
    table = np.zeros((len(langs), 1 << L.BITS))
    for i, x in enumerate(langs):
        for b, n in counts[x].items():
            table[i, b] = n
    model, plain = L.Model(langs, table), plain_model(counts)
    texts = [t.lower() for _, t, _ in docs] + ["a", "é", "x y z", "und der the les", "q" * 400, "1 a 2"]
    best, score, vague = model.predict(*text_bytes(pa.array(texts)))
    for i, t in enumerate(texts):
        lang, top, ambiguous = plain_predict(plain, t)
        assert (langs[best[i]], bool(vague[i])) == (lang, ambiguous) and score[i] == pytest.approx(top, abs=1e-9), t
    alone = [model.predict(*text_bytes(pa.array([t]))) for t in texts]
    assert [a[0][0] for a in alone] == best.tolist() and [a[1][0] for a in alone] == pytest.approx(score.tolist())


@needs_tables
def test_held_out_texts_are_recognised():
    docs = [(i, t, x) for i, t, x in documents() if t and x]
    held = [zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in docs]
    counts = counted([(t.lower(), x) for (_, t, x), h in zip(docs, held, strict=True) if not h])
    langs = sorted(counts)
    table = np.array([[counts[x][b] for b in range(1 << L.BITS)] for x in langs], float)
    model = L.Model(langs, table)
    own = [(t, x) for (_, t, x), h in zip(docs, held, strict=True) if h and any(c.isalpha() for c in t)]
    best, _, _ = model.predict(*text_bytes(pa.array([t.lower() for t, _ in own])))
    assert np.mean([langs[b] == x for b, (_, x) in zip(best, own, strict=True)]) > 0.97 and len(own) > 20


@pytest.mark.parametrize("n", [1, 2, 4, 6, 7, 40])
def test_codewords_differ(n):
    code = L.codewords(n)
    assert len(code) == n and set(np.unique(code)) <= {-1, 1}
    assert all((code[i] != code[j]).any() for i in range(n) for j in range(i))
