"""Tables of a workspace."""

import os
import random

import pytest

from lectern.llm import workspace
from lectern.llm.workspace import Workspace


def test_tables_written_by_tasks(spark, monkeypatch):
    """Tables of many queries are written without Hadoop's file system, which starts a process a file; rows, types and empty ones stay."""
    work = Workspace(spark, "t")
    rows = [(i, None if i % 3 else [i, None], bytes([i]), i % 2 == 0, f"é{i}", i) for i in range(40)]
    frame = spark.createDataFrame(rows, "a long, b array<long>, c binary, d boolean, e string, f int").repartition(7)
    for kernel, schema in ((None, ""), (lambda batches: batches, "a long, b array<long>, c binary, d boolean, e string, f int")):
        got = work.table(frame, "rows", kernel=kernel, schema=schema, direct=True)
        assert sorted(map(tuple, got.collect())) == sorted((a, b, bytearray(c), d, e, f) for a, b, c, d, e, f in rows) and got.schema == frame.schema
        files = os.listdir(f"{work.plain}/{work.latest.rsplit('/', 1)[1]}")
        assert files and all(f.startswith("part-") and f.endswith(".parquet") for f in files)  # no checksums, no marks, nothing left over
    assert work.table(frame.where("a < 0"), "none", direct=True).collect() == []
    monkeypatch.setattr(work, "plain", "")
    assert work.table(frame, "rows", kernel=lambda batches: batches, schema="a long, b array<long>, c binary, d boolean, e string, f int").count() == 40


@pytest.mark.parametrize("most", [0, workspace.ONE_TASK])
def test_components_by_rounds_and_by_one_task(spark, monkeypatch, most):
    """Few edges take one contraction and no rounds; both ways give the same."""
    monkeypatch.setattr(workspace, "ONE_TASK", most)
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(100, 160)]
    rng.shuffle(chain)
    names = []

    class Counting(Workspace):
        def table(self, frame, name="t", **options):
            names.append(name)
            return super().table(frame, name, **options)

    edges = spark.createDataFrame([*chain, (7, 3), (9, 7), (5, 5)], "u long, v long").repartition(5)
    got = {r.node: r.component for r in workspace.components(edges, Counting(spark, "t")).collect()}
    assert got == {**dict.fromkeys(range(101, 161), 100), 7: 3, 9: 3}
    assert most == 0 or names == ["edges", "stars"]
