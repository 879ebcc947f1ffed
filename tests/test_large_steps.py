"""Steps whose partitions, batches or shuffles matter only on large tables, made small by settings."""

from contextlib import contextmanager

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.functions.frames import BATCH_BYTES, in_frames
from lectern.operators import audits, markup, matching, segmentation
from lectern.plans import match_queries, text_queries


@contextmanager
def settings(spark, **values):
    names = {k.replace("_", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_positions_do_not_depend_on_how_ranges_are_joined(spark):
    rows = spark.range(0, 20_000, 1, 8).select(((F.col("id") * 7919) % 20_000).alias("k"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 4).alias("wide"))
    rows = rows.withColumn("k", F.when(F.col("k") < 19_990, F.col("k")))
    with settings(spark, spark_sql_shuffle_partitions="16", spark_sql_adaptive_advisoryPartitionSizeInBytes="400k", spark_sql_adaptive_coalescePartitions_parallelismFirst="false"):
        got = [(r.k, r.position) for r in audits.ordered(rows, "k").select("k", "position").collect()]
    assert sorted(p for _, p in got) == list(range(20_000))
    assert all(p == k if k is not None else p >= 19_990 for k, p in got)


SEGMENTS = "".join(f'<p id="c-segment{i}">word</p>' for i in range(120))
KERNELS = {
    "mark_pages": (lambda t: markup.mark_pages(t, "k", {}), "<p>One.</p>" * 120),
    "page_texts": (lambda t: markup.page_texts(t, "k"), "<p>" + "word " * 8_000),
    "clean_pages": (lambda t: markup.clean_pages(t, "k", {}), "<p>" + "word " * 8_000),
    "read_segments": (lambda t: markup.read_segments(t, ["k"]), SEGMENTS),
    "segments": (lambda t: segmentation.segments(t, "k", "html"), "One. " * 1_000),
}


@pytest.mark.parametrize("name", KERNELS)
def test_frames_from_python_do_not_grow_with_the_batch(spark, monkeypatch, name):
    kernels = []
    monkeypatch.setattr(type(spark.range(0)), "mapInPandas", lambda self, run, schema: kernels.append(run))
    query, page = KERNELS[name]
    query(spark.createDataFrame([(1, page)], "k long, html string"))
    batch = pd.DataFrame({"k": range(400), "html": page, "_model": "english"})[["k", "html", *(["_model"] if name == "segments" else [])]]
    sizes = [f.memory_usage(deep=True).sum() for f in kernels[0](iter([batch]))]
    assert len(sizes) > 1
    assert max(sizes) <= 2 * BATCH_BYTES


def test_rows_in_frames_are_all_rows():
    rows = [(i, "x" * (i % 50)) for i in range(1_000)]
    frames = list(in_frames(iter(rows), ["k", "t"], 5_000))
    assert len(frames) > 10
    assert [tuple(r) for f in frames for r in f.itertuples(index=False)] == rows


@pytest.mark.parametrize("query", [text_queries.window_multiset, match_queries.probe_window_overlap])
def test_window_counts_are_not_moved(spark, sf_dir, query):
    with settings(spark, spark_sql_adaptive_enabled="false"):
        plan = query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert not [line for line in moved if "window_index" in line]
    assert any("hashpartitioning(doc_id" in line and "REPARTITION_BY_NUM" in line for line in moved)


def test_tasks_of_a_key_grow_in_number_with_the_input(spark, sf_dir, monkeypatch):
    from lectern.functions import frames

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    few = frames.by_key(docs, "doc_id").rdd.getNumPartitions()
    monkeypatch.setattr(frames, "KEYED_BYTES", 1 << 13)
    assert frames.by_key(docs, "doc_id").rdd.getNumPartitions() > few


def test_matching_does_not_move_counts(spark, sf_dir, monkeypatch):
    plans = []

    def keep(frame, name, kept=matching.keep):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return kept(frame, name)

    monkeypatch.setattr(matching, "keep", keep)
    with settings(spark, spark_sql_adaptive_enabled="false"):
        match_queries.ordered_match_fold(spark, sf_dir)
    moved = [line for plan in plans for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert not [line for line in moved if "window_index" in line.split("hashpartitioning(")[1]]
