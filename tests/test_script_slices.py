"""Facts of many TypeScript texts take the disk of a slice at a time, and columns that nobody reads are not made."""

import os

import pytest
from pyspark.sql import functions as F

from srcweave.plans import inputs
from srcweave.plans import queries as Q
from srcweave.session import shared_dir
from srcweave.sources import script_facts as SF
from srcweave.sources.corpus import as_source_files

TEXT = """import def, {{ b as c }} from './m{k}';
export class A{k} extends B implements I {{ private x: string = `v${{q + {k}}}`; run(a: number, b?: string) {{ return go(a, "s" + b); }} }}
const f{k} = (req, res) => {{ const v = req.body.q; el.innerHTML = v; eval(v); }};
function g{k}(x: number = 1): void {{ path.resolve(x); }}
"""


def sources(spark):
    rows = [("p", f"/p/m{k}.ts", TEXT.format(k=k)) for k in range(9)]
    rows += [("p", "/p/m1.ts", "let z = 'other';\n"), ("p", "/p/none.ts", None), ("p", "/p/empty.ts", ""), ("q", None, "let n = 1;"), ("p", "/p/x.py", "x = 1")]
    return as_source_files(spark.createDataFrame(rows, "project_id string, file_path string, content string"))


def rows_of(facts):
    return sorted(r[0] for r in facts.select(F.to_json(F.struct("*"))).collect())


def tables(spark):
    top = f"{shared_dir(spark)}/tables".removeprefix("file:")
    return set(os.listdir(top)) if os.path.isdir(top) else set()


def test_slices_give_the_facts_of_the_whole_and_leave_nothing_else(spark, monkeypatch):
    files, columns = sources(spark), ["decls", "imports"]
    whole = rows_of(SF.script_facts(files, columns))
    monkeypatch.setattr(SF, "_SLICE_BYTES", 2000)
    before, made, one_slice = tables(spark), [], SF._facts
    monkeypatch.setattr(SF, "_facts", lambda *args: made.append(args) or one_slice(*args))
    sliced = SF.script_facts(files, columns)
    assert len(made) == 2 and len(tables(spark) - before) == 1
    assert sliced.columns == ["project_id", "file_path", "language", "n_lines", "error", *columns]
    assert rows_of(sliced) == whole and len(whole) == 12


def columns_read(spark, tmp_path, monkeypatch, query):
    """The columns of facts a query asks for; its later steps are analysed over a table of only those."""
    asked = []

    def empty(files, only=None, stored=False):
        asked.append(list(only))
        fields = [f for f in SF._schema() if f.name not in SF._PLACES or f.name in only]
        return spark.createDataFrame([], SF.StructType(fields))

    monkeypatch.setattr(inputs, "script_facts", empty)
    spark.createDataFrame([(0, 1)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    query(inputs.Inputs(spark, str(tmp_path))).schema
    return asked


def test_import_edges_read_imports(spark, tmp_path, monkeypatch):
    assert columns_read(spark, tmp_path, monkeypatch, Q.ts_import_edges) == [["imports"]]


@pytest.mark.parametrize("query", [Q.ts_decl_facts, Q.ts_members, Q.ts_properties])
def test_components_read_declarations(spark, tmp_path, monkeypatch, query):
    assert columns_read(spark, tmp_path, monkeypatch, query) == [["decls"]]


def test_edges_between_classes_read_declarations_and_imports(spark, tmp_path, monkeypatch):
    assert columns_read(spark, tmp_path, monkeypatch, Q.ts_inherit_edges) == [["decls", "imports"]]


def test_calls_are_facts_of_call_edges_only(spark, tmp_path, monkeypatch):
    assert columns_read(spark, tmp_path, monkeypatch, Q.ts_call_edges) == [["decls", "imports", "calls"]]
