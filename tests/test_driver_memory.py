"""Rows whose size is only guessed are not sent through the driver."""

from srcweave.operators import findings as FN
from srcweave.operators import posture as PO
from srcweave.operators import resolve as RS
from srcweave.session import write_once
from srcweave.sources.fact_store import FactStore
from srcweave.sources.python_facts import python_facts


def test_imports_are_not_broadcast(files):
    parsed = python_facts(files({
        "/p/pkg/a.py": "from .b import x\nfrom . import c, d\nimport e\n", "/p/pkg/b.py": "x = 1\n", "/p/pkg/c.py": "",
        "/p/pkg/d.py": "", "/p/e.py": "",
    }))
    hits = RS.resolved_imports(parsed)
    assert "BroadcastExchange" not in hits._jdf.queryExecution().executedPlan().toString()
    found = {(r.file_path, r.module, r.target_path) for r in hits.collect()}
    assert found == {
        ("/p/pkg/a.py", "b", "/p/pkg/b.py"), ("/p/pkg/a.py", "", "/p/pkg/c.py"), ("/p/pkg/a.py", "", "/p/pkg/d.py"),
        ("/p/pkg/a.py", "e", "/p/e.py"),
    }


def test_counts_of_files_are_not_broadcast(files):
    from pyspark.sql import functions as F

    parsed = python_facts(write_once(files({"/p/a.py": 'password = "hunter22"\n', "/p/b.py": "x = 1\n"})))
    found = FN.findings(parsed).withColumn("project_id", F.col("file_path"))
    scored = PO.posture(found, parsed.select(F.col("file_path").alias("project_id")))
    assert "BroadcastExchange" not in scored._jdf.queryExecution().executedPlan().toString()
    assert {r.project_id: r.total for r in scored.collect()} == {"/p/a.py": 1, "/p/b.py": 0}


def test_stored_facts_do_not_broadcast_files(spark, files, tmp_path):
    table = write_once(files({"/p/a.py": "x = 1\n", "/p/b.py": "x = 1\n", "/p/c.py": "y = 1\n"}))
    facts = FactStore(spark, str(tmp_path / "store")).facts(table)
    plan = facts._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [digest" in plan
    assert sorted(r.file_path for r in facts.collect()) == ["/p/a.py", "/p/b.py", "/p/c.py"]


def test_ranked_findings_parse_once(files):
    parsed = python_facts(files({"/p/a.py": 'password = "hunter22"\n', "/p/b.py": 'token = "abcdefgh1"\n'}))
    ranked = FN.ranked(FN.findings(parsed))
    assert "MapInArrow" not in ranked._jdf.queryExecution().executedPlan().toString()
    assert [r.file_path for r in ranked.collect()] == ["/p/a.py", "/p/b.py"]
