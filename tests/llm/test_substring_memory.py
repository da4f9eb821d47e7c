"""What bounds the memory of op1_substrings: one Python worker for a task, few arrays for a block."""

import re
import tracemalloc

import numpy as np
import pandas as pd

from srcweave.llm import substrings
from srcweave.llm.scratch import Scratch
from srcweave.llm.text_arrays import fixed_hashes, mix, prefix_sums, span_hashes


def python_steps(plan):
    """The most steps in Python that follow each other in one stage."""
    most, above = 0, []
    for line in plan.splitlines():
        name = re.search(r"\w+", line)
        if not name:
            continue
        above = [a for a in above if a[0] < name.start()]
        steps = 0 if "Exchange" in line else (above[-1][1] if above else 0)
        steps += bool(re.search("InPandas|InArrow|EvalPython", line[: line.find("(") if "(" in line else None]))
        most = max(most, steps)
        above.append((name.start(), steps))
    return most


def test_no_task_needs_two_python_workers(spark, monkeypatch):
    plans = []
    write = Scratch.write

    def kept(self, df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(self, df)

    monkeypatch.setattr(Scratch, "write", kept)
    monkeypatch.setattr(substrings, "CONTEXTS", 3)
    shared = " ".join(f"word{i * i}" for i in range(40))
    docs = [(i, f"{i} before {i * 7} {shared} after {i * 13} {i}" * 2) for i in range(12)]
    frame = spark.createDataFrame([*docs, (None, None), (3, ""), (4, docs[4][1])], "doc_id long, text string")
    result = substrings.remove_repeats(frame)
    assert sum(r.n_removed for r in result.collect()) > 0
    plans.append(result._jdf.queryExecution().executedPlan().toString())
    steps = [python_steps(p) for p in plans]
    assert max(steps) == 1, steps


def test_spans_of_one_group_are_merged_as_they_are_found(monkeypatch):
    monkeypatch.setattr(substrings, "ARRAY_BYTES", 1)  # each anchor in an array of its own
    text = bytes(np.random.default_rng(5).integers(97, 123, 180, np.uint8))
    rows = [(did, did, h, at, 0, text + end) for h, at in ((9, 100), (10, 110)) for did, end in ((1, b""), (2, b"x"), (3, b"y"))]
    group = pd.DataFrame(rows, columns=["did", "tkey", "h", "at", "low", "bytes"])
    found = substrings._repeats(100)(group)
    assert sorted(found[["did", "low", "high"]].itertuples(index=False, name=None)) == [(2, 32, 180), (3, 32, 180)]


def test_hashes_of_a_block_take_few_arrays():
    data = np.random.default_rng(1).integers(0, 256, 1 << 20).astype(np.uint8)
    sums = prefix_sums(data)
    for make, most in ((lambda: prefix_sums(data), 18), (lambda: fixed_hashes(sums, 32), 18)):
        tracemalloc.start()
        make()
        _, peak = tracemalloc.get_traced_memory()
        tracemalloc.stop()
        assert peak < most * len(data)


def test_hashes_are_what_they_were():
    data = np.arange(1000, dtype=np.uint32).astype(np.uint8)
    sums = prefix_sums(data)
    at = np.arange(0, 900, 7)
    before = sums.copy()
    assert (span_hashes(data, at, at + 32) == fixed_hashes(sums, 32)[at]).all()
    assert (span_hashes(data, at, at + 32, sums) == fixed_hashes(sums, 32)[at]).all()
    assert (sums == before).all()
    values = np.arange(5, dtype=np.uint64)
    mix(values)
    assert values.tolist() == [0, 1, 2, 3, 4]
