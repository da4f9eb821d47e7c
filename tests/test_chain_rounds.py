"""The search for chains goes no further than the pairs that were asked for."""

from srcweave.operators import traversal as TV

EDGES = "project_id string, source string, target string"


def chains(spark, edges, pairs):
    found = TV.dependency_chain(spark.createDataFrame(edges, EDGES), spark.createDataFrame(pairs, EDGES))
    return {(r.project_id, r.source, r.target): list(r.path) for r in found.collect()}


def test_search_ends_with_the_pairs(spark, monkeypatch):
    tables, search = [], TV._waves

    def spied(*args):
        tables.append(search(*args))
        return tables[-1]

    monkeypatch.setattr(TV, "_waves", spied)
    edges = [("p", f"n{i:02}", f"n{(i + 1) % 30:02}") for i in range(30)]
    pairs = [("p", f"n{i:02}", f"n{(i + 2) % 30:02}") for i in range(30)] + [("p", "n00", "n00")]
    found = chains(spark, edges, pairs)
    assert found == {p: [f"n{(int(p[1][1:]) + j) % 30:02}" for j in range(3 if p[1] != p[2] else 1)] for p in pairs}
    assert tables[0].agg({"depth": "max"}).head()[0] == 2


def test_pairs_without_a_chain_end_the_search_with_the_graph(spark):
    edges = [("p", "a", "b"), ("p", "b", "c"), ("q", "c", "a")]
    pairs = [("p", "a", "c"), ("p", "c", "a"), ("q", "a", "c"), ("p", "x", "a"), ("p", None, "a")]
    assert chains(spark, edges, pairs) == {("p", "a", "c"): ["a", "b", "c"]}
