import json

import pytest
from pyspark.sql import functions as F

from srcweave.operators import components as CO
from srcweave.operators import contracts as CK
from srcweave.operators import findings as FN
from srcweave.operators import growth as GW
from srcweave.operators import posture as PO
from srcweave.operators import reports as RP
from srcweave.plans.analysis import analyze
from srcweave.session import broadcast_if_small, write_counted
from srcweave.sources import config as CF
from srcweave.sources import corpus as SR
from srcweave.sources import sinks
from srcweave.sources.python_facts import python_facts


@pytest.fixture
def tree(tmp_path):
    texts = {
        "one/pkg/__init__.py": b"", "one/pkg/a.py": b"x = 1\n", "one/pkg/B.PY": b"y = '\xff'\n",
        "one/pkg/c.txt": b"no", "one/node_modules/d.py": b"no", "one/.git/e.py": b"no",
        "one/my.egg-info/f.py": b"z = 1", "two/g.ts": b"const a = 1;",
    }
    deep = "two/" + "/".join(f"d{i}" for i in range(16))
    texts[deep + "/late.py"] = b"no"
    texts[deep.rsplit("/", 1)[0] + "/last.py"] = b"yes"
    for name, content in texts.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    return tmp_path


def test_tree_scan(spark, tree):
    rows = SR.read_files(spark, str(tree)).collect()
    got = {r.file_path.removeprefix(str(tree) + "/"): r for r in rows}
    last = "two/" + "/".join(f"d{i}" for i in range(15)) + "/last.py"
    assert set(got) == {"one/pkg/__init__.py", "one/pkg/a.py", "one/pkg/B.PY",
                        "one/my.egg-info/f.py", "two/g.ts", last}
    assert {r.project_id for r in rows} == {"one", "two"}
    assert got["one/pkg/B.PY"].content == "y = '�'\n" and got["one/pkg/B.PY"].ext == ".py"
    assert got["one/pkg/a.py"].n_lines == 2 and got["one/pkg/__init__.py"].n_lines == 1


def test_trees_of_other_languages_and_errors(spark, tree):
    """TypeScript lies in any folder and at any depth; what can't be read is a row; nothing to read is an error."""
    deep = "two/" + "/".join(f"d{i}" for i in range(18)) + "/far.tsx"
    for name in (deep, "two/dist/out.js", "two/env/x.ts", "two/node_modules/no.ts", "two/venv/no.py"):
        (tree / name).parent.mkdir(parents=True, exist_ok=True)
        (tree / name).write_text("let a;")
    (tree / "two/gone.ts").write_text("let b;")
    files = SR.read_files(spark, str(tree))  # listed now, read later
    (tree / "two/gone.ts").unlink()
    rows = {r.file_path.removeprefix(str(tree) + "/"): r for r in files.collect()}
    assert {deep, "two/dist/out.js", "two/env/x.ts", "two/gone.ts", "two/g.ts"} <= set(rows)
    assert not {"two/node_modules/no.ts", "two/venv/no.py"} & set(rows)
    assert {p for p, r in rows.items() if r.error is not None} == {"two/gone.ts"} and rows["two/gone.ts"].content is None
    (missing,) = SR.read_files(spark, str(tree / "missing")).collect()
    assert missing.file_path == str(tree / "missing") and "FileNotFoundError" in missing.error
    (tree / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        SR.read_files(spark, str(tree / "none"))


def test_configuration_of_each_project(spark):
    docs = [("a", json.dumps(CONFIG)), ("b", json.dumps({"security": CONFIG})), ("c", "{no"), ("d", "{}"), ("e", None)]
    config = CF.project_config(spark.createDataFrame(docs, "project_id string, json string"))
    rows = {r.project_id: r for r in config.collect()}
    for project in "ab":
        got = {k: (v.enabled, v.severity) for k, v in rows[project].rules.items()}
        assert got == {"sec-003": (False, None), "py-004": (None, "high")} and rows[project].min_severity == "medium"
    assert rows["c"].error == "no JSON: {no" and rows["c"].rules == {} and rows["d"].error is None and rows["d"].min_severity is None
    flags = {r.project_id: r for r in CF.with_flags(config, "low", ("py-004", "py-001")).collect()}
    assert {k: v.enabled for k, v in flags["a"].rules.items()} == {"sec-003": False, "py-004": False, "py-001": False}
    assert {r.min_severity for r in flags.values()} == {"low"}
    found = spark.createDataFrame(
        [(p, r, s) for p in "acx" for r, s in (("sec-003", "high"), ("py-004", "low"), ("py-002", "low"))], "project_id string, rule_id string, severity string")
    kept = {tuple(r) for r in FN.apply_project_config(found, config).collect()}
    rest = {(p, r, s) for p in "cx" for r, s in (("sec-003", "high"), ("py-004", "low"), ("py-002", "low"))}
    assert kept == {("a", "py-004", "high")} | rest


def test_snapshot_log(spark, tmp_path):
    """A batch appended again takes the place of itself; one that is not in the manifest doesn't count."""
    log = sinks.SnapshotLog(spark, str(tmp_path / "log"))
    log.append(spark.range(5), "a")
    log.append(spark.range(3), "b")
    log.append(spark.range(7), "a")
    spark.range(100).write.parquet(str(tmp_path / "log/data/attempt=lost"))
    assert {r.batch: r["count"] for r in log.read().groupBy("batch").count().collect()} == {"a": 7, "b": 3}


def test_language_majority(spark):
    rows = [("p", "/p/a.py"), ("p", "/p/b.pyw"), ("p", "/p/c.ts"), ("t", "/t/a.py"), ("t", "/t/b.JS"),
            ("n", "/n/readme.md")]
    df = spark.createDataFrame(rows, "project_id string, file_path string")
    assert {r.project_id: r.language for r in SR.detect_language(df).collect()} == {
        "p": "python", "t": "typescript", "n": "typescript"}
    forced = SR.detect_language(df, "python").collect()
    assert {r.language for r in forced} == {"python"}


CONFIG = {
    "minSeverity": "medium", "customSources": ["ev.data"], "customSinks": {"sql": ["$raw"]},
    "falsePositivePatterns": ["DEMO"],
    "rules": {"sec-003": {"enabled": False}, "py-004": {"severity": "high"}},
}


@pytest.mark.parametrize("nested", [False, True])
def test_config_files(spark, tmp_path, nested):
    path = tmp_path / "rules.json"
    path.write_text(json.dumps({"security": CONFIG} if nested else CONFIG, indent=2))
    config = CF.read_config(spark, str(path))
    options = CF.rule_options(config, disable=("py-001",))
    assert options.min_severity == "medium" and options.disabled == {"sec-003", "py-001"}
    assert options.severity == {"py-004": "high"} and options.custom_sinks == {"sql": ("$raw",)}
    assert options.custom_sources == ("ev.data",) and options.false_positives == ("DEMO",)
    assert CF.rule_options(config, min_severity="low").min_severity == "low"
    rows = {r.rule_id: (r.enabled, r.severity) for r in CF.rule_config(config).collect()}
    assert rows == {"sec-003": (False, None), "py-004": (True, "high")}


def test_defaults_without_config():
    options = CF.rule_options()
    assert options.min_severity is None and options.disabled == frozenset()


@pytest.fixture
def analysis(spark, files):
    return analyze(files({
        "/p/x/a.py": 'from b import g\npassword = "hunter22"\nclass A: pass\n',
        "/p/y/b.py": "from a import A\nimport pickle\ndef g(): return pickle.loads(q)\n",
        "/r/z/clean.py": "x = 1\n",
    }), "python")


def test_whole_analysis(analysis):
    assert {r.project_id: (r.score, r.grade) for r in analysis.posture.collect()} == {
        "p": (67, "D"), "r": (100, "A")}
    assert {r.project_id: (r.total_files, r.total_components, r.total_relationships)
            for r in analysis.summary.collect()} == {"p": (2, 4, 2), "r": (1, 1, 0)}
    cycle = analysis.cycles().collect()
    assert [sorted(r.labels[:-1]) for r in cycle] == [["a.py", "b.py"]]
    assert cycle[0].labels[0] == cycle[0].labels[-1] and cycle[0].severity == "high"
    assert analysis.cyclic_components().count() == 2


def test_reports(analysis, tmp_path, spark):
    sarif = {r.ruleId: r.level for r in RP.sarif_results(analysis.findings).collect()}
    assert sarif == {"py-004": "warning", "py-005": "error"}
    table = RP.report_findings(analysis.findings).collect()
    assert {r.severity for r in table} == {"MEDIUM", "CRITICAL"}
    head = {r.project_id: json.loads(r.json) for r in RP.report_json(
        analysis.summary, analysis.posture).collect()}
    assert head["p"]["metadata"]["totalComponents"] == 4 and head["r"]["security"]["score"] == 100
    parts = RP.section_parts(analysis.findings, "findings", per_part=1).collect()
    items = [item for r in parts for item in json.loads(r.json)]
    assert sorted(i["rule_id"] for i in items) == ["py-004", "py-005"]
    sinks.write_report({"findings": analysis.findings, "posture": analysis.posture}, str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out" / "findings"))
    assert back.count() == 2 and "project_id" in back.columns
    sinks.write_table(analysis.components, str(tmp_path / "components"))
    assert spark.read.parquet(str(tmp_path / "components")).where("project_id = 'p'").count() == 4


def test_review_helpers(analysis, spark):
    found = analysis.findings
    clean = FN.clean_clusters(analysis.clusters, found).collect()
    assert [r.dir for r in clean] == ["/r/z"]
    shares = {r.rule_id: r.share for r in FN.category_share(found).collect()}
    assert shares == {"py-004": 0.5, "py-005": 0.5}
    first = FN.action_list(found).first()
    assert (first.priority, first.rule_id) == (1, "py-005")
    assert [r.rule_id for r in FN.ranked(found).collect()] == ["py-005", "py-004"]


def test_contracts(analysis, spark):
    checks = CK.contract_check(analysis.components, "components").collect()
    assert all(r.n_violations == 0 and r.n_rows == 5 for r in checks)
    assert all(r.n_violations == 0 for r in CK.contract_check(analysis.posture, "posture").collect())
    bad = analysis.posture.withColumn("score", F.lit(101)).withColumn("grade", F.lit("Z"))
    broken = {r.check: r.n_violations for r in CK.contract_check(bad, "posture").collect()}
    assert broken["score out of range"] == 2 and broken["grade not in list"] == 2
    rels = CK.contract_check(analysis.relationships, "relationships").collect()
    assert all(r.n_violations == 0 for r in rels)


def test_metrics_log_and_growth(analysis, spark, tmp_path):
    log = str(tmp_path / "metrics")
    for day in ("2024-01-01", "2024-01-02"):
        sinks.append_metrics(GW.component_snapshot(analysis.components, F.lit(day)), log)
    assert spark.read.json(log).where("project_id = 'p'").count() == 2
    rows = spark.createDataFrame(
        [("p", "2024-01-01", "file", 3), ("p", "2024-01-03", "file", 7), ("p", "2024-01-01", "class", 1)],
        "project_id string, snapshot string, type string, n int")
    got = {(r.snapshot, r.type): r.delta for r in GW.growth_delta(rows).collect()}
    assert got == {("2024-01-01", "file"): None, ("2024-01-03", "file"): 4, ("2024-01-01", "class"): None}


def test_posture_comparison_keeps_projects_of_one_side(spark):
    before = spark.createDataFrame([("p", 90), ("old", 50)], "project_id string, score int")
    after = spark.createDataFrame([("p", 80), ("new", 70)], "project_id string, score int")
    rows = {r.project_id: (r.change, r.regressed) for r in PO.posture_diff(before, after).collect()}
    assert rows == {"p": (-10, True), "old": (None, False), "new": (None, False)}


def test_broadcast_only_when_proven_small(spark):
    small = broadcast_if_small(spark.range(10), 10)._jdf.queryExecution().toString()
    large = broadcast_if_small(spark.range(11), 10)._jdf.queryExecution().toString()
    assert "broadcast" in small.lower() and "broadcast" not in large.lower()


def test_written_tables_count_their_rows(spark):
    table, n = write_counted(spark.range(7))
    assert n == 7 and table.count() == 7
    assert write_counted(spark.range(0))[1] == 0


def test_file_with_one_hot_name_resolves_like_the_others(files):
    texts = {f"/p/m{i:03}.py": "def common(): pass\ndef own(): common()\n" for i in range(60)}
    parsed = python_facts(files(texts))
    comps = CO.components(parsed)
    from srcweave.operators import resolve as RS
    edges = RS.python_relationships(parsed, comps)
    assert edges.count() == 60 and edges.select("target").distinct().count() == 1


def test_fact_store_parses_a_text_once(spark, files, tmp_path):
    from srcweave.sources.fact_store import FactStore

    store = FactStore(spark, str(tmp_path / "facts"))
    first = files({"/p/a.py": "x = 1\n", "/q/b/a.py": "x = 1\n", "/q/c.py": "def f(): pass\n", "/q/d.ts": "let a;"})
    got = {r.file_path: (r.project_id, len(r.assigns), len(r.decls)) for r in store.facts(first).collect()}
    assert got == {"/p/a.py": ("p", 1, 0), "/q/b/a.py": ("q", 1, 0), "/q/c.py": ("q", 0, 1)}
    assert store.size() == 2
    again = files({"/r/new.py": "x = 1\n", "/q/c.py": "def f(): pass\ndef g(): pass\n"})
    assert {r.file_path: len(r.decls) for r in store.facts(again).collect()} == {"/r/new.py": 0, "/q/c.py": 2}
    assert store.size() == 3
    assert {r.file_path for r in store.facts(first).collect()} == set(got) and store.size() == 3
