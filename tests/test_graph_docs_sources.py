from logwarden.plans import queries


def test_graph_docs_searches_from_all_nodes_of_a_large_graph(spark, monkeypatch):
    rows = spark.createDataFrame([(i, 1, [f"w{i}", f"w{i + 1}"]) for i in range(1100)], "doc_id bigint, line_no bigint, tokens array<string>")
    asked, central = [], "token string, degree double, eigenvector double, betweenness double"

    def centralities(nodes, edges, sources=None):
        asked.append((nodes.count(), sources))
        return spark.createDataFrame([("w0", 0.1, 0.2, 0.3)], central)

    monkeypatch.setattr(queries, "_token_lines", lambda spark, sf: rows)
    monkeypatch.setattr(queries.W, "subword_table", lambda train, records: spark.createDataFrame([("w0", [1.0] * 100)], "token string, vector array<double>"))
    monkeypatch.setattr(queries.G, "centralities", centralities)
    got = {x["doc_id"]: (x["size"], x["zero"]) for x in queries.QUERIES["graph_docs"](spark, "").collect()}
    assert asked == [(1101, None)]
    assert len(got) == 1100 and got[0] == (103, False) and got[5] == (103, True)
