import math
import random

import pytest

from srcweave.operators import components as CO
from srcweave.operators import graph as GR
from srcweave.operators import resolve as RS
from srcweave.operators import traversal as TV
from srcweave.sources.python_facts import python_facts


@pytest.fixture
def edges(spark):
    def make(pairs, project="p"):
        return spark.createDataFrame(
            [(project, a, b, "imports") for a, b in pairs],
            "project_id string, source string, target string, type string",
        )

    return make


def test_degrees(edges):
    rows = edges([("a", "b"), ("a", "c"), ("c", "c")])
    assert {r.id: r.degree for r in GR.node_degree(rows).collect()} == {"a": 2, "b": 1, "c": 3}
    both = {r.id: (r.in_degree, r.out_degree) for r in GR.in_out_degree(rows).collect()}
    assert both == {"a": (0, 2), "b": (1, 0), "c": (2, 1)}


def test_degrees_sum_to_twice_the_edges(edges):
    rng = random.Random(1)
    pairs = [(f"n{rng.randrange(20)}", f"n{rng.randrange(20)}") for _ in range(100)]
    assert sum(r.degree for r in GR.node_degree(edges(pairs)).collect()) == 200


def test_nodes_edges_and_clusters(files):
    parsed = python_facts(files({
        "/p/x/util/a.py": "from b import g\ndef f():\n    return g()\n",
        "/p/y/util/b.py": "class B: pass\nclass C(B): pass\ndef g(): pass\n",
    }))
    comps = CO.components(parsed)
    rels = RS.python_relationships(parsed, comps)
    nodes = {r.label: r for r in GR.graph_nodes(comps, rels).collect()}
    assert nodes["f"].size == pytest.approx(math.log2(3) + 1)
    assert nodes["b.py"].size == pytest.approx(math.log2(5) + 1)
    assert nodes["B"].group == "util"
    assert {r.type: r.weight for r in GR.graph_edges(rels).collect()} == {
        "imports": 2, "calls": 1, "extends": 3}
    clusters = GR.clusters(comps).collect()
    assert sorted((r.dir, r.cluster_id, r.n_nodes) for r in clusters) == [
        ("/p/x/util", "cluster-util", 2), ("/p/y/util", "cluster-util", 4)]
    lists = GR.cluster_node_lists(comps, per_row=1).collect()
    assert sorted(i for r in lists for i in r.node_ids) == sorted(r.id for r in comps.collect())


def test_coupling_and_cluster_classes(edges, spark):
    place = {"a1": "A", "a2": "A", "b1": "B", "c1": "C", "d1": "D"}
    nodes = spark.createDataFrame(
        [("p", n, "file", c) for n, c in place.items()],
        "project_id string, id string, type string, cluster string")
    rows = edges([("a1", "b1"), ("a2", "b1"), ("b1", "a1"), ("c1", "b1"), ("a1", "a2")])
    pairs = {(r.cluster_a, r.cluster_b): (r.n_edges, r.a_to_b, r.b_to_a, r.high_coupling)
             for r in GR.cluster_coupling(nodes, rows, 3).collect()}
    assert pairs == {("A", "B"): (3, 2, 1, True), ("B", "C"): (1, 0, 1, False)}
    assert [(r.from_cluster, r.to_cluster) for r in GR.one_way_pairs(nodes, rows).collect()] == [("C", "B")]
    assert [r.cluster for r in GR.isolated_clusters(nodes, rows).collect()] == ["D"]
    assert [r.cluster for r in GR.star_clusters(nodes, rows, 2).collect()] == ["B"]
    assert [r.id for r in GR.island_nodes(nodes, rows).collect()] == ["d1"]
    stats = {r.cluster: (r.n_nodes, r.n_inner, r.n_cross) for r in GR.cluster_stats(nodes, rows).collect()}
    assert stats == {"A": (2, 1, 3), "B": (1, 0, 4), "C": (1, 0, 1), "D": (1, 0, 0), None: (5, 1, 4)}
    _, kept = GR.subgraph(nodes, rows, clusters_=["A", "B"])
    assert kept.count() == 4


def reach(pairs):
    """Every node each node reaches by one step or more."""
    nodes = {n for p in pairs for n in p}
    out = {n: {b for a, b in pairs if a == n} for n in nodes}
    seen = {n: set(out[n]) for n in nodes}
    changed = True
    while changed:
        changed = False
        for n in nodes:
            more = set().union(*[out[m] for m in seen[n]], seen[n])
            changed |= more != seen[n]
            seen[n] = more
    return seen


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_cyclic_components_against_brute_force(edges, seed):
    rng = random.Random(seed)
    pairs = {(f"n{rng.randrange(25):02}", f"n{rng.randrange(25):02}") for _ in range(34)}
    seen = reach(pairs)
    want = {}
    for n in seen:
        if n in seen[n]:
            group = {m for m in seen[n] if n in seen[m]}
            want[n] = (min(group), len(group))
    got = {r.id: (r.scc, r.size) for r in TV.cyclic_components(edges(sorted(pairs))).collect()}
    assert got == want


def test_long_chain_and_long_cycle(edges):
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)]
    ring = [(f"r{(i * 7) % 40:03}", f"r{((i + 1) * 7) % 40:03}") for i in range(40)]
    got = TV.cyclic_components(edges(chain + ring)).collect()
    assert {r.id for r in got} == {f"r{i:03}" for i in range(40)}
    assert {(r.scc, r.size) for r in got} == {("r000", 40)}


def test_no_cycle_gives_nothing_and_projects_stay_apart(edges):
    assert TV.cyclic_components(edges([("a", "b"), ("b", "c")])).count() == 0
    apart = edges([("a", "b")], "p").unionByName(edges([("b", "a")], "q"))
    assert TV.cyclic_components(apart).count() == 0


def brute_cycles(pairs, longest):
    out, found = {}, set()
    for a, b in pairs:
        out.setdefault(a, set()).add(b)

    def walk(path):
        for nxt in out.get(path[-1], ()):
            if nxt == path[0]:
                found.add((*path, nxt))
            elif nxt > path[0] and nxt not in path and len(path) < longest:
                walk((*path, nxt))

    for n in out:
        walk((n,))
    return found


def test_short_cycles_against_brute_force(edges, spark):
    rng = random.Random(9)
    pairs = {(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for _ in range(24)}
    names = spark.createDataFrame(
        [("p", f"n{i}", f"N{i}") for i in range(9)], "project_id string, id string, label string")
    rows = TV.short_cycles(edges(sorted(pairs)), 4, names).collect()
    assert {tuple(r.path) for r in rows} == brute_cycles(pairs, 4)
    assert all(r.severity == ("high" if r.length <= 2 else "medium") for r in rows)
    assert all(r.labels == [p.upper() for p in r.path] for r in rows)


def test_reachable_and_chains(edges, spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("a", "e"), ("e", "d")]
    seeds = spark.createDataFrame([("p", "a"), ("p", "d")], "project_id string, id string")
    got = {(r.seed, r.id): r.depth for r in TV.reachable(edges(pairs), seeds).collect()}
    assert got == {("a", "a"): 0, ("a", "b"): 1, ("a", "e"): 1, ("a", "c"): 2, ("a", "d"): 2, ("d", "d"): 0}
    back = {(r.seed, r.id) for r in TV.impact_set(edges(pairs), seeds, 1).collect()}
    assert back == {("a", "a"), ("a", "c"), ("d", "d"), ("d", "c"), ("d", "e")}
    wanted = spark.createDataFrame(
        [("p", "a", "d"), ("p", "d", "a"), ("p", "a", "a")],
        "project_id string, source string, target string")
    chains = {(r.source, r.target): r.path for r in TV.dependency_chain(edges(pairs), wanted).collect()}
    assert chains == {("a", "d"): ["a", "e", "d"], ("a", "a"): ["a"]}


def test_first_and_last_wins_ignore_row_order(spark):
    rows = [("k", i, f"v{i}") for i in range(20)] + [("j", 5, "w")]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "key string, ord int, v string").repartition(5)
        assert sorted(r.v for r in RS.first_wins(df, ["key"], ["ord"]).collect()) == ["v0", "w"]
        assert sorted(r.v for r in RS.last_wins(df, ["key"], ["ord"]).collect()) == ["v19", "w"]


def witness(rows):
    """The steps of each component's path, in order."""
    paths = {}
    for r in sorted(rows.collect(), key=lambda r: r.pos):
        paths.setdefault((r.project_id, r.scc), []).append(r)
    return paths


def test_a_witness_of_any_length(edges):
    ring = [(f"r{(i * 7) % 50:02}", f"r{((i + 1) * 7) % 50:02}") for i in range(50)]
    tail = [("r00", "t0"), ("t0", "t1"), ("s0", "r03")]
    loop = [("z", "z"), ("z", "t1")]
    paths = witness(TV.cycle_witness(edges(ring + tail + loop).unionByName(edges([("a", "b"), ("b", "a")], "q"))))
    assert {k: [r.id for r in v][:3] for k, v in paths.items()} == {
        ("p", "r00"): ["r00", "r07", "r14"], ("p", "z"): ["z", "z"], ("q", "a"): ["a", "b", "a"]}
    long = paths["p", "r00"]
    assert [r.pos for r in long] == list(range(51)) and {r.length for r in long} == {50}
    assert long[0].id == long[50].id and len({r.id for r in long}) == 50 and long[0].severity == "medium"
    assert paths["q", "a"][0].severity == "high"


@pytest.mark.parametrize("seed", [6, 7])
def test_witnesses_of_dense_components(edges, seed):
    rng = random.Random(seed)
    pairs = {(f"n{rng.randrange(40):02}", f"n{rng.randrange(40):02}") for _ in range(70)}
    seen = reach(pairs)
    members = {n: min(m for m in seen[n] if n in seen[m]) for n in seen if n in seen[n]}
    paths = witness(TV.cycle_witness(edges(sorted(pairs))))
    assert {scc for _, scc in paths} == set(members.values())
    for (_, scc), steps in paths.items():
        ids = [r.id for r in steps]
        assert all(members[n] == scc for n in ids) and ids[0] == ids[-1] and len(set(ids)) == len(ids) - 1
        assert all(p in pairs for p in zip(ids, ids[1:])) and ids[0] == min(ids)
        assert {(r.length, r.size) for r in steps} == {(len(ids) - 1, list(members.values()).count(scc))}


def test_no_witness_without_a_cycle(edges):
    assert TV.cycle_witness(edges([("a", "b"), ("b", "c")])).count() == 0


def test_reachable_many_seeds_and_deep(edges, spark):
    """More seeds than fit one long, and a chain as deep as the rounds are many."""
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(12)]
    fan = [(f"s{i:03}", "c000") for i in range(150)] + [("c003", "c001")]
    seeds = spark.createDataFrame([("p", f"s{i:03}") for i in range(150)] + [("p", "gone")], "project_id string, id string")
    rows = TV.reachable(edges(chain + fan), seeds).collect()
    got = {(r.seed, r.id): r.depth for r in rows}
    assert len(rows) == len(got) == 150 * 14 + 1
    assert all(got[f"s{i:03}", f"c{j:03}"] == j + 1 for i in range(150) for j in range(13))
    assert got["gone", "gone"] == 0
    assert TV.reachable(edges(chain), seeds.limit(0)).count() == 0


def test_chains_against_brute_force(edges, spark):
    rng = random.Random(8)
    pairs = sorted({(f"n{rng.randrange(18):02}", f"n{rng.randrange(18):02}") for _ in range(40)})
    nodes = sorted({n for p in pairs for n in p})
    asked = [(a, b) for a in nodes for b in nodes if rng.random() < 0.4]

    def shortest(a, b):
        paths = [[a]]
        for _ in nodes:
            ends = [p for p in paths if p[-1] == b]
            if ends:
                return min(ends)
            paths = [[*p, z] for p in paths for y, z in pairs if y == p[-1] and z not in p]
        return None

    wanted = spark.createDataFrame([("p", a, b) for a, b in asked], "project_id string, source string, target string")
    rows = TV.dependency_chain(edges(pairs), wanted).collect()
    got = {(r.source, r.target): r.path for r in rows}
    assert got == {(a, b): shortest(a, b) for a, b in asked if shortest(a, b)}
    assert all(r.length == len(r.path) - 1 for r in rows)


def test_dense_numbers_follow_the_order(spark):
    from srcweave.operators.keys import numbered

    rows = spark.range(500).selectExpr("concat('p', id % 3) AS project_id", "concat('n', id % 100) AS id").repartition(7)
    got = [(r.project_id, r.id) for r in numbered(rows, ["project_id", "id"]).orderBy("n").collect()]
    assert got == sorted(set(got)) and len(got) == 300
    assert [r.n for r in numbered(rows, ["project_id", "id"]).orderBy("n").collect()] == list(range(300))


def test_folder_rollup_against_brute_force(spark):
    rng = random.Random(10)
    paths = ["/" + "/".join(rng.choice("abc") for _ in range(rng.randint(0, 3))) + f"/f{i}.py" for i in range(60)]
    paths = [p.replace("//", "/") for p in paths]
    pairs = {(rng.choice(paths), rng.choice(paths)) for _ in range(150)}
    comps = spark.createDataFrame([("p", p) for p in paths for _ in range(2)], "project_id string, file_path string")
    edges = spark.createDataFrame([("p", a, b) for a, b in pairs] * 2, "project_id string, file_path string, target_path string")

    def folders(path):
        parts = path.split("/")[1:-1]
        return {"/" + "/".join(parts[:n]) for n in range(1, len(parts) + 1)} or {"/"}

    want = {}
    for p in paths:
        for f in folders(p):
            want.setdefault(f, [0, 0, 0])[0] += 2
    for a, b in pairs:
        for f in folders(a) | folders(b):
            want[f][1 if f in folders(a) & folders(b) else 2] += 1
    rows = GR.folder_rollup(comps, edges).collect()
    assert {r.folder: [r.n_nodes, r.n_inner, r.n_cross] for r in rows} == want
