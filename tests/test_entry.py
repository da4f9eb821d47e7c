from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from srcweave.plans.queries import all_queries

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(all_queries()) <= set(entry.oracle_sql())


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 100 for r in rows)


@pytest.mark.parametrize("name", [
    "all_components", "all_relationships", "all_findings", "ts_findings", "ts_call_edges",
    "taint_paths", "cluster_coupling", "stream_scan", "growth_windows", "secret_lines",
])
def test_against_sql(spark, database, name):
    frame = entry.queries()[name](spark, FOLDER)
    cursor = database.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    want = Counter(cursor.fetchall())
    assert Counter(tuple(r) for r in frame.select(*columns).collect()) == want
