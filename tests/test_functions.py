import json
import re

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logwarden.functions import hashing as H
from logwarden.functions import labels as LB
from logwarden.functions import text as TX


def column(spark, values, expr, name="v"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def expected_class(y):
    try:
        data = json.loads(y)
    except ValueError:
        return "unknown"
    if not isinstance(data, list):
        return "unknown"
    return data[0] if data else "normal"


def test_class_label(spark):
    ys = ['["a","b"]', "[]", '{"a":1}', "null", '"x"', "bad", "", '["only"]', "5", '["cut"']
    assert column(spark, ys, LB.class_label("v")) == [expected_class(y) for y in ys]


def simple(text):
    runs = re.findall(r"(?:(?!\d)\w)+", text.lower(), re.UNICODE)
    return [t for t in runs if 2 <= len(t) <= 15 and not t.startswith("_")]


TEXTS = [
    "[Mon Jan 17] client 10.0.0.1:99 GET /wp-login.php?x_y=1 AH00123: ok",
    "a bb " + "c" * 15 + " " + "d" * 16 + " _hidden x9y Éléphant straße ½half ⅷroman",
    "",
    "____ 123 4x5",
]


def test_tokenisers(spark):
    assert column(spark, TEXTS, TX.simple_tokens("v")) == [simple(t) for t in TEXTS]
    assert column(spark, TEXTS, TX.word_tokens("v")) == [
        re.findall(r"\b\w\w+\b", t.lower()) for t in TEXTS
    ]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aB_9é -\n.²", max_size=40), min_size=1, max_size=20))
def test_tokenisers_on_any_text(spark, texts):
    assert column(spark, texts, TX.simple_tokens("v")) == [simple(t) for t in texts]


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["x"],), ([],)], "t array<string>")
    got = [r[0] for r in df.select(TX.unigrams_and_bigrams("t")).collect()]
    assert got == [["a", "b", "c", "a b", "b c"], ["x"], []]
    assert column(spark, ["abc", "a"], TX.char_ngrams("v")) == [
        ["<ab", "abc", "bc>", "<abc", "abc>", "<abc>"],
        ["<a>"],
    ]


def test_blank_and_preview(spark):
    vs = ["x", " \t", "  ", "\x1c\x1f", "", " y"]
    assert column(spark, vs, TX.not_blank(F.col("v"))) == [bool(v.strip()) for v in vs]
    assert column(spark, ["a" * 50, "b" * 51], TX.preview("v")) == ["a" * 50, "b" * 50 + "..."]


def test_label_codes(spark):
    a = spark.createDataFrame([("b",), ("a",), ("b",)], "label string")
    b = spark.createDataFrame([("Z",)], "label string")
    got = {r["label"]: r["code"] for r in LB.label_codes(a, b).collect()}
    assert got == {"Z": 0, "a": 1, "b": 2}


def test_split_is_stable_and_complete(spark):
    df = spark.range(5000)
    one = H.with_split(df, F.col("id")).toPandas().set_index("id")["split"]
    two = H.with_split(df.repartition(13), F.col("id")).toPandas().set_index("id")["split"]
    assert one.sort_index().equals(two.sort_index())
    assert set(one) == {"train", "test"} and abs((one == "train").mean() - 0.8) < 0.03


def test_exact_split_and_samples(spark):
    for n in (0, 1, 4, 1003):
        df = spark.range(n)
        got = H.exact_split(df, F.col("id")).toPandas()
        assert len(got) == n and (got["split"] == "train").sum() == int(n * 0.8 + 0.5)
    df = spark.range(1000)
    order = df.select("id", H.row_hash(F.col("id")).alias("h")).toPandas().sort_values("h")["id"]
    for size in (0, 1, 37, 999, 1000, 2000):
        got = H.hash_sample(df, F.col("id"), size).toPandas()["id"]
        assert sorted(got) == sorted(order[:size])


def test_class_label_is_strict_json(spark):
    from logwarden.functions.labels import class_label

    texts = ["['a']", '["a"] junk', '["a"]]', '["a"],["b"]', '["a"]', "[]", ' ["b", "c"] ', "null", None, '["a"],"x":1']
    rows = spark.createDataFrame([(t,) for t in texts], "y string")
    got = [r[0] for r in rows.select(class_label("y")).collect()]
    assert got == ["unknown"] * 4 + ["a", "normal", "b"] + ["unknown"] * 3
