"""A third and more of all rows on one key: the joins split it and stay whole."""

import pytest

from srcweave.operators import components as CO
from srcweave.operators import graph as GR
from srcweave.operators import resolve as RS
from srcweave.session import write_once
from srcweave.sources.python_facts import python_facts

TIGHT = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2000",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2000",
    "spark.sql.shuffle.partitions": "8",
}


@pytest.fixture
def tight(spark):
    """Sizes at which a few hundred rows count as skewed."""
    before = {k: spark.conf.get(k, None) for k in TIGHT}
    for key, value in TIGHT.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def plan_after(df):
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString()


def test_hot_name_is_split(tight, files):
    texts = {f"/p/m{i:04}.py": f"def own{i}():\n    common()\n    own{(i * 7) % 400}()\n" for i in range(400)}
    texts["/p/zz.py"] = "def common(): pass\n"
    parsed = write_once(python_facts(files(texts).repartition(8)))
    rows, plan = plan_after(RS.call_edges(parsed, CO.components(parsed)))
    assert "skew=true" in plan
    hot = [r for r in rows if r.target.startswith("function-common-")]
    assert len(hot) == 400 and len(rows) == 400 + sum((i * 7) % 400 != i for i in range(400))


def test_hot_module_is_split(tight, files):
    texts = {f"/p/m{i:04}.py": f"import util\nimport m{(i * 7) % 400:04}\n" for i in range(400)}
    texts["/p/util.py"] = ""
    parsed = write_once(python_facts(files(texts).repartition(8)))
    rows, plan = plan_after(RS.import_edges(parsed))
    assert "skew=true" in plan
    assert len(rows) == 800


def test_hub_is_split(tight):
    edges = tight.range(0, 3000, 1, 8).selectExpr(
        "'p' AS project_id", "if(id % 3 = 0, concat('n', id % 500), 'hub') AS source",
        "concat('n', id) AS target", "'calls' AS type")
    nodes = tight.range(3000).selectExpr(
        "'p' AS project_id", "concat('n', id) AS id", "concat('c', id % 4) AS cluster").unionByName(
        tight.sql("SELECT 'p' AS project_id, 'hub' AS id, 'h' AS cluster"))
    rows, plan = plan_after(GR.directed_pairs(nodes, edges))
    assert "skew=true" in plan
    assert sum(r.n for r in rows if r.source_cluster == "h") == 2000
