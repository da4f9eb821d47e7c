import hashlib

from pyspark.sql import functions as F

from srcweave.functions import ids
from srcweave.functions import paths as P
from srcweave.functions import severity as S


def test_component_id_is_prefix_name_and_digest(spark):
    row = spark.range(1).select(
        ids.component_id("class", F.lit("/x/User.ts"), F.lit("User_A b")).alias("a"),
        ids.component_id("class", F.lit("/x/user.ts"), F.lit("user_a B")).alias("b"),
    ).first()
    digest = hashlib.sha256(b"class:/x/user.ts:user_a b").hexdigest()[:8]
    assert row.a == row.b == f"class-user-a-b-{digest}"


def test_relationship_id_keeps_case(spark):
    row = spark.range(1).select(
        ids.relationship_id(F.lit("A"), F.lit("b"), "calls").alias("x"),
        ids.relationship_id(F.lit("a"), F.lit("b"), "calls").alias("y"),
    ).first()
    assert row.x == "rel-calls-" + hashlib.sha256(b"A:b:calls").hexdigest()[:8]
    assert row.x != row.y


def test_paths(spark):
    rows = spark.createDataFrame(
        [("/a/b/c.test.ts",), ("/top.py",), ("bare.py",), ("/a/.hidden",)], "p string"
    ).select(
        "p", P.dir_name(F.col("p")).alias("dir"), P.base_name(F.col("p")).alias("base"),
        P.extension(F.col("p")).alias("ext"), P.group_name(F.col("p")).alias("grp"),
    ).collect()
    assert [tuple(r)[1:] for r in rows] == [
        ("/a/b", "c.test.ts", ".ts", "b"), ("/", "top.py", ".py", ""),
        (".", "bare.py", ".py", "."), ("/a", ".hidden", "", "a"),
    ]


def test_module_names_are_all_suffixes(spark):
    row = spark.range(1).select(P.module_names(F.lit("/app/pkg/mod.py")).alias("m")).first()
    assert row.m == ["app.pkg.mod", "pkg.mod", "mod"]


def test_grades_and_clamp(spark):
    rows = spark.createDataFrame([(d,) for d in (0, 10, 11, 30, 40, 41, 500)], "d int").select(
        S.clamp_score(F.col("d")).alias("s"), S.grade(S.clamp_score(F.col("d"))).alias("g")
    ).collect()
    assert [(r.s, r.g) for r in rows] == [
        (100, "A"), (90, "A"), (89, "B"), (70, "C"), (60, "D"), (59, "F"), (0, "F")
    ]
