"""Tokens become units where their file is: files are shuffled, tokens are not."""

from pyspark.sql import functions as F

from srcweave.sources import script_facts as SF
from srcweave.sources import script_units as SU

TEXTS = {
    "/p/a.ts": "import { b } from './b';\nexport class A { run(x: number) { return b(x, [1, 2]); } }\n",
    "/p/b.ts": "const é = `x${a + 1}`;\n// note\nif (a) { f(a)\n g(\"q\") }\n) } stray\n",
    "/p/c.ts": "", "/p/d.ts": None,
}


def texts(files):
    return files(TEXTS).select("project_id", "file_path", F.coalesce("content", F.lit("")).alias("text"))


def test_one_shuffle_of_files(files):
    plan = SF._units(texts(files))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan and "Generate" not in plan


def test_places_do_not_depend_on_batches(spark, files):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    tokens = texts(files).select(
        "project_id", "file_path", F.regexp_extract_all("text", F.lit(SF._TOKEN), F.lit(0)).alias("tokens"), F.lit(None).cast("array<int>").alias("places")
    ).toArrow().combine_chunks().to_batches()
    marks = {"before_object": SF._BEFORE_OBJECT, "goes_on_before": SF._GOES_ON_BEFORE, "goes_on_after": SF._GOES_ON_AFTER}
    run = SU.unit_batches(to_arrow_schema(StructType.fromDDL(SU.UNIT)), marks)
    whole = [r for b in run(iter(tokens)) for r in b.to_pylist()]
    many, SU._BATCH_TOKENS = SU._BATCH_TOKENS, 3
    try:
        assert [r for b in run(iter(tokens)) for r in b.to_pylist()] == whole
    finally:
        SU._BATCH_TOKENS = many
    content = {p: (t or "").encode() for p, t in TEXTS.items()}
    assert all(content[r["file_path"]][x["pos"]:x["fin"]].decode() == x["t"] for r in whole for x in r["toks"])
    top = [r["flat"] for r in whole if r["file_path"] == "/p/a.ts" and r["depth"] == 0]
    assert top == ["import {} from ''", "export class A {}"]
    assert {r["flat"]: r["around"] for r in whole if r["file_path"] == "/p/b.ts"}["f()"] == "b"
    assert min(r["depth"] for r in whole) == -2
