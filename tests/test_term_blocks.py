from logwarden.operators import tfidf as TF


def test_term_stats_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(TF, "BLOCK_TERMS", 4)
    rows = [(["a", "b", "a"],), ([],), (None,), (["a", None, "c d"],), (["b"] * 9,)]
    found = TF.term_stats(spark.createDataFrame(rows, "terms array<string>").coalesce(1)).collect()
    assert {(r["term"], r["cf"], r["df"]) for r in found} == {("a", 3, 2), ("b", 10, 2), (None, 1, 1), ("c d", 1, 1)}
