"""Nothing is lost to short ids or to the way a table is stored."""

from pyspark.sql import functions as F

from srcweave.functions import ids
from srcweave.operators.resolve import relationships
from srcweave.sources.python_facts import parse_python
from srcweave.streaming.incremental import append_results, file_stream, growth_windows


def test_edges_that_share_a_short_id_are_kept(spark, monkeypatch):
    monkeypatch.setattr(ids, "DIGEST_CHARS", 1)
    edges = spark.range(100).select(
        F.lit("p").alias("project_id"), F.concat(F.lit("a"), "id").alias("source"), F.lit("b").alias("target"),
        F.lit("calls").alias("type"), F.lit("/f.py").alias("file_path"), F.col("id").alias("ord"),
        F.lit(None).cast("array<string>").alias("import_specifiers"),
    )
    kept = relationships(edges, edges)
    assert kept.count() == 100 and kept.select("id").distinct().count() <= 16


def test_folder_tables_stream_whole(spark, tmp_path):
    rows = spark.range(1_000).withColumn("text", F.lit("x"))
    rows.repartition(4).write.parquet(str(tmp_path / "in" / "part.parquet"))
    got = append_results(file_stream(spark, str(tmp_path / "in"), "part"), str(tmp_path / "work"))
    assert got.count() == 1_000


def test_events_out_of_order_all_count(spark, tmp_path):
    for at, days in enumerate(([40, 41], [1, 2, 40], [20])):
        rows = [(f"2024-01-01 00:00:0{d % 10}", "a", d) for d in days]
        frame = spark.createDataFrame(rows, "ts string, event_type string, d int").select(
            F.expr("cast(ts as timestamp) + make_dt_interval(d)").alias("ts"), "event_type"
        )
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    got = growth_windows(spark, str(tmp_path)).collect()
    assert sorted((r.window_start, r.n) for r in got) == [
        ("2024-01-02", 1), ("2024-01-03", 1), ("2024-01-21", 1), ("2024-02-10", 2), ("2024-02-11", 1)]


def test_deep_expressions_lose_no_facts():
    chain = " + ".join(f"a{i}" for i in range(5_000))
    facts = parse_python(f'password = "hunter22"\ndef f():\n    x = {chain}\n    g(1, 2, 3, x)\n')
    assert facts["error"] is None and [a["target"] for a in facts["assigns"]] == ["password", "x"]
    assert [a["text"] for a in facts["calls"][0]["args"]] == ["1", "2", "3", "x"]
    uses = facts["assigns"][1]["uses"]
    assert len(uses) == 5_001 and sum(len(u["text"]) for u in uses) < 2 * len(chain)
    scope = facts["scopes"][0]
    assert (scope["first_call"], scope["n_calls"], facts["calls"][0]["callee"], facts["calls"][0]["caller"]) == (0, 1, "g", "f")
    assert (scope["first_step"], scope["n_steps"]) == (1, 1)


def test_nested_functions_store_a_fact_once():
    """Each function's interval holds what the functions in it assign; the facts grow with the source."""
    depth = 80
    lines = [f"{' ' * d}def f{d}():\n{' ' * (d + 1)}x{d} = g{d}(x)\n" for d in range(depth)]
    facts = parse_python("".join(lines))
    assert facts["error"] is None and len(facts["assigns"]) == len(facts["calls"]) == depth
    assert [(s["first_step"], s["n_steps"], s["n_calls"]) for s in facts["scopes"]] == [(d, depth - d, depth - d) for d in range(depth)]
    assert len(str(facts)) < 1_500 * depth


def test_a_file_without_content_is_an_error():
    facts = parse_python(None)
    assert facts["error"] == "no content" and facts["n_lines"] == 0


def test_components_that_share_a_short_id_stay_apart(spark, files, monkeypatch):
    """Sixteen possible ids of one name: all nodes, edges, degrees, clusters and cycles are kept."""
    from srcweave.operators import components as CO
    from srcweave.operators import graph as GR
    from srcweave.plans.analysis import analyze

    monkeypatch.setattr(ids, "DIGEST_CHARS", 1)
    n = 40
    texts = {f"/p/d{i:02}/mod.py": f"from d{(i + 1) % n:02}.mod import f{(i + 1) % n}\ndef f{i}():\n    return f{(i + 1) % n}()\n" for i in range(n)}
    result = analyze(files(texts), "python")
    assert result.components.count() == result.components.select("key").distinct().count() == 2 * n
    assert result.components.where("type = 'file'").select("id").distinct().count() <= 16
    kinds = {r.type: r["count"] for r in result.relationships.groupBy("type").count().collect()}
    assert kinds == {"imports": n, "calls": n}
    nodes = result.nodes.collect()
    assert len(nodes) == 2 * n and len({r.key for r in nodes}) == 2 * n
    degrees = GR.node_degree(result.relationships).collect()
    assert len(degrees) == 2 * n and {r.degree for r in degrees} == {2}
    assert GR.island_nodes(GR.clustered(result.components), result.relationships).count() == 0
    coupling = GR.cluster_coupling(GR.clustered(result.components), result.relationships).collect()
    assert len(coupling) == n and {r.n_edges for r in coupling} == {2}
    check = GR.edge_key_check(result.components, result.relationships).collect()
    assert [tuple(r) for r in check] == [("p", 2 * n, 2 * n, 0)]
    refs = CO.of_type(result.components, "function").selectExpr(
        "project_id", "file_path", "'function' AS ref_type", "upper(name) AS ref_name")
    from srcweave.operators.resolve import resolve_ids

    assert {(r.file_path, r.found_name) for r in resolve_ids(refs, result.components).collect()} == {
        (f"/p/d{i:02}/mod.py", f"f{i}") for i in range(n)}
    (cycle,) = result.cycles().collect()
    assert cycle.length == n and len(set(cycle.path)) == n and set(cycle.labels) == {"mod.py"}
