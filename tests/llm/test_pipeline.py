"""The pipeline against brute force on null ids, repeated rows and groups of copies."""

from collections import Counter

import numpy as np

import corpus_pipeline
from srcweave.llm import mixing

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, words=40):
    return " ".join(f"w{i}" for i in rng.integers(0, 5000, words))


def test_rows_decide(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    first, twice, dirty, near = (prose(rng) for _ in range(4))
    items = [(i, prose(rng), "en", "ab"[i % 2], 1) for i in range(30)]
    items += [(None, prose(rng), "en", "a", 1) for _ in range(3)]
    items += [(None, first, "en", "b", 1), (50, first, "en", "a", 1)]
    items += [(60, twice, "en", "a", 1)] * 4
    items += [(70, near + " end", "en", "a", 1), (71, near, "en", "b", 1), (71, near, "en", "b", 1)]
    items += [(80, dirty, "en", "b", 1), (80, prose(rng), "en", "a", 1), (None, dirty + " more", "en", "a", 1), (81, "", "en", "a", 1)]
    bad = (90, prose(rng) + " REJECT", "en", "a", 1)
    items += [bad, (90, prose(rng), "en", "a", 1), (None, bad[1], "en", "a", 1)]
    spark.createDataFrame(items, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, dirty)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def judged(docs, labels, row):
        from pyspark.sql import functions as F

        return docs.select((~F.contains("text", F.lit("REJECT"))).cast("int").alias("predicted"), F.col(row).alias("row"))

    monkeypatch.setattr(corpus_pipeline.quality, "score_quality", judged)
    seen = []
    stages = [(n, lambda *a, f=f: seen.append(f(*a)) or seen[-1]) for n, f in corpus_pipeline.STAGES]
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = [Counter((r.doc_id, r.text, r.source) for r in frame.collect()) for frame in seen[:4]]

    want = Counter((i, t, s) for i, t, _, s, _ in items if "REJECT" not in t)
    assert kept[0] == want
    want -= Counter({(None, first, "b"): 1, (60, twice, "a"): 3, (71, near, "b"): 2, (None, dirty + " more", "a"): 1})
    assert kept[1] == want
    want -= Counter({(80, dirty, "b"): 1})
    assert kept[2] == want
    sizes, targets = Counter(), {}
    for (_, t, s), n in want.items():
        sizes[s] += n * len(t.split())
    for r in mixing.mix_sources(seen[2], key=corpus_pipeline._keyed(seen[2])[1]).collect():
        targets[r.source] = r.target
    for s in sizes:
        taken = sum(n * len(t.split()) for (_, t, of), n in kept[3].items() if of == s)
        assert abs(taken - targets[s]) <= 41
    assert len(final) == sum(kept[3].values()) and Counter(r.doc_id for r in final) == Counter(i for (i, _, _), n in kept[3].items() for _ in range(n))


def test_quality_keeps_row_keys(spark):
    docs = spark.createDataFrame([(1, "good text", 7), (None, "other", 8), (1, "good text", 9)], "doc_id long, text string, r long")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = corpus_pipeline.quality.score_quality(docs, labels, row="r").collect()
    assert sorted((r.row, r.doc_id or 0, r.predicted) for r in got) == [(7, 1, 1), (8, 0, 1), (9, 1, 1)]


def test_columns_that_clash_with_the_key(spark, tmp_path):
    """Columns named like those the stages add are columns like others; an empty table goes through."""
    rng = np.random.default_rng(4)
    rows = [(i, prose(rng), "en", "ab"[i % 2], 1, 7, 8, 9, 2) for i in range(40)]
    schema = COLUMNS + ", pipeline_row long, kept_row long, mixed_row long, mixed_copies int"
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([("x", "none of these words")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = corpus_pipeline.uncontaminated(spark, docs, str(tmp_path))
    assert kept.columns[: len(docs.columns)] == docs.columns and kept.count() == 40
    unique = corpus_pipeline.unlike(spark, kept, str(tmp_path))
    mixed = corpus_pipeline.mixed(spark, unique, str(tmp_path)).collect()
    assert unique.count() == 40 and 30 <= len(mixed) <= 60 and {(r.pipeline_row, r.kept_row, r.mixed_copies) for r in mixed} == {(7, 8, 2)}
    assert len({c for c in kept.columns}) == len(kept.columns) == len(docs.columns) + 1
    none = corpus_pipeline.unlike(spark, docs.limit(0), str(tmp_path))
    assert corpus_pipeline.mixed(spark, none, str(tmp_path)).count() == 0
