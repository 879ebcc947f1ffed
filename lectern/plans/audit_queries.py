"""Data-quality checks with the test tables in the roles of audio, clips, transcripts and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import audits as A
from lectern.operators import lineage, packages

from .base import sql_toks, table
from .text_queries import document_tokens
from .timeline_queries import CHUNK_S, SQL_INTERVALS, intervals

CLIP_S = 3_600.0


def _clips(spark: SparkSession, sf_dir: str, length: float) -> DataFrame:
    return intervals(spark, sf_dir).select("user_id", "event_id", F.col("s").alias("begin"), (F.col("s") + length).alias("end"))


def _inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("orderkey"), "l_quantity")
    return A.inventory(orders, lines, "orderkey", "l_quantity")


def audio_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inventory(spark, sf_dir)


def substantial_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.substantial(_inventory(spark, sf_dir))


def missing_long_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substantial orders, neither first nor last of their customer, without a returned line."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey"), "o_custkey")
    inner = A.inner_rows(orders, "o_custkey", "orderkey")
    used = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("orderkey"))
    return A.substantial(_inventory(spark, sf_dir)).join(inner, "orderkey").join(used, "orderkey", "left_anti")


def missing_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.transcript_states(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", F.col("quality") == 1, 1 - F.col("toxic"))


def low_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = _clips(spark, sf_dir, CLIP_S)
    durations = clips.groupBy("user_id").agg((F.max("end") - F.min("begin")).alias("duration"))
    rows = A.coverage(clips, durations, "user_id").join(A.covered_union(clips, "user_id"), "user_id").where(F.col("ratio") < A.COVERAGE)
    return rows.select("user_id", "clip_count", *(F.round(c, 3).alias(c) for c in ("covered", "covered_once", "duration", "ratio")))


def duplicate_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [F.col("l_orderkey"), F.col("l_linenumber"), F.round("l_discount", 3).alias("discount")]
    return A.duplicate_clips(table(spark, sf_dir, "lineitem"), keys)


def overlapping_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.overlapping_clips(_clips(spark, sf_dir, float(CHUNK_S)), "user_id", "event_id", float(CHUNK_S))
    return rows.withColumn("overlap", F.round("overlap", 3))


def raw_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as written clip clocks, three an overlay, some of them broken on purpose."""
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id", F.floor(i / 3).alias("overlay"),
        F.when(i % 11 != 0, F.concat(F.lit("a"), i.cast("string"))).alias("audio_file"),
        F.when(i % 7 == 0, F.lit("1:02")).otherwise(F.concat(i.cast("string"), F.lit(".5s"))).alias("begin_raw"),
        F.when(i % 13 == 0, F.lit("")).when(i % 5 == 0, F.concat((i - 1).cast("string"), F.lit("s"))).otherwise(F.concat((i + 2).cast("string"), F.lit(".25"))).alias("end_raw"),
    )


def invalid_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.parse_clips(raw_clips(spark, sf_dir)).where("NOT valid").select("event_id", "begin", "end", "problem")


def overlay_without_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw_clips(spark, sf_dir)
    return A.silent_overlays(rows, A.parse_clips(rows), "overlay")


def unmatched_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unlabelled documents between labelled ones; every ninth stands for a contents page."""
    contents = table(spark, sf_dir, "documents").where("doc_id % 9 = 0").select("doc_id")
    return A.unmatched_between(document_tokens(spark, sf_dir).select("doc_id", "n_tokens"), table(spark, sf_dir, "labels"), "doc_id", contents=contents)


def missing_overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers wired to nations and regions; the first missing link names the issue."""
    nation = table(spark, sf_dir, "nation").where("n_nationkey % 9 <> 8").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    region = table(spark, sf_dir, "region").where("r_regionkey <> 3").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    rows = table(spark, sf_dir, "customer").join(nation, "c_nationkey", "left").join(region, "n_regionkey", "left")
    issue = packages.wiring_issue(F.col("n_regionkey").isNotNull(), F.col("c_acctbal") >= 0, F.col("r_name").isNotNull(), F.col("r_name") != "ASIA", F.col("c_mktsegment") != "BUILDING")
    return rows.select("c_custkey", issue.alias("issue")).where("issue IS NOT NULL")


def chunk_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = F.when(F.col("event_id") % 2 == 0, "aac").otherwise("copy")
    rows = intervals(spark, sf_dir).where("next_s IS NOT NULL").withColumn("actual", F.col("next_s") - F.col("s") + F.col("event_id") % 9 - 4)
    done = lineage.chunk_complete(F.col("event_id") % 17 != 0, F.col("event_id") % 19 != 0, F.col("s"), F.col("next_s"), F.when(F.col("event_id") % 23 != 0, F.col("actual")), codec)
    return rows.select("event_id", done.alias("complete"))


def stamp_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    wanted = docs.select("doc_id", F.struct("lang", "source").alias("stamp"))
    stamp = F.when(F.col("quality") == 1, F.struct("lang", F.when(F.col("toxic") == 0, F.col("source")).alias("source")))
    return lineage.work_list(wanted, docs.join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", stamp.alias("stamp")), "doc_id")


def check_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = missing_transcripts(spark, sf_dir).where("state <> 'ok'")
    found = [("missing_transcripts", states)] + [(f.__name__, f(spark, sf_dir)) for f in (missing_long_audio, low_coverage, duplicate_clips, overlapping_clips, invalid_clips, overlay_without_audio, unmatched_spine, missing_overlays)]
    return A.roll_up([(n, f, n == "low_coverage") for n, f in found])


QUERIES = {
    f.__name__: f
    for f in (
        audio_inventory, substantial_audio, missing_long_audio, missing_transcripts, low_coverage, duplicate_clips, overlapping_clips, invalid_clips,
        overlay_without_audio, unmatched_spine, missing_overlays, chunk_completeness, stamp_worklist, check_rollup,
    )
}

_INVENTORY = "inv AS (SELECT o_orderkey AS orderkey, coalesce(sum(l_quantity), 0.0) AS duration, count(l_orderkey) AS word_count FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)"
_LONG = f"""
    WITH {_INVENTORY},
         o AS (SELECT o_orderkey AS orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS z FROM orders)
    SELECT orderkey, duration, word_count, o_custkey FROM inv JOIN o USING (orderkey)
    WHERE a > 1 AND z > 1 AND (duration >= 180 OR word_count >= 300) AND orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
"""
_STATES = """
    SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN coalesce(quality, 0) <> 1 THEN 'unreadable' WHEN coalesce(1 - toxic, 0) = 0 THEN 'empty' ELSE 'ok' END AS state
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
"""
_COVERAGE = f"""
    WITH {SQL_INTERVALS}, c AS (SELECT user_id, s AS b, s + {CLIP_S} AS e FROM iv),
         u AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c),
         g AS (SELECT user_id, count(*) AS clip_count, sum(e - b) AS covered, sum(greatest(e - greatest(b, coalesce(reach, b)), 0)) AS covered_once, max(e) - min(b) AS duration FROM u GROUP BY user_id)
    SELECT user_id, clip_count, round(covered, 3) AS covered, round(covered_once, 3) AS covered_once, round(duration, 3) AS duration, round(covered / duration, 3) AS ratio FROM g WHERE covered / duration < 0.6
"""
_DUPLICATES = "SELECT l_orderkey, l_linenumber, round(l_discount, 3) AS discount, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1"
_OVERLAPPING = f"""
    WITH {SQL_INTERVALS}, c AS (SELECT user_id, event_id, s AS b, s + {CHUNK_S} AS e, row_number() OVER (PARTITION BY user_id ORDER BY s, s + {CHUNK_S}, event_id) AS rn FROM iv)
    SELECT x.user_id, x.event_id AS a, y.event_id AS b, round(least(x.e, y.e) - greatest(x.b, y.b), 3) AS overlap
    FROM c x JOIN c y ON x.user_id = y.user_id AND x.rn < y.rn AND y.b < x.e
    WHERE NOT (round(x.b, 3) = round(y.b, 3) AND round(x.e, 3) = round(y.e, 3)) AND least(x.e, y.e) - greatest(x.b, y.b) >= 0.5
"""
SQL_RAW_CLIPS = """
    clips AS (SELECT event_id, event_id // 3 AS overlay, event_id % 11 <> 0 AS src, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id + 0.5::DOUBLE END AS b,
                     CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 5 = 0 THEN CAST(event_id - 1 AS DOUBLE) ELSE event_id + 2.25::DOUBLE END AS e FROM events)
"""
_INVALID = f"""
    WITH {SQL_RAW_CLIPS},
         p AS (SELECT event_id, b AS "begin", e AS "end", CASE WHEN NOT src THEN 'src' WHEN b IS NULL THEN 'begin' WHEN e IS NULL THEN 'end' WHEN e <= b THEN 'order' END AS problem FROM clips)
    SELECT * FROM p WHERE problem IS NOT NULL
"""
_SILENT = f"WITH {SQL_RAW_CLIPS} SELECT overlay FROM clips GROUP BY overlay HAVING count(*) FILTER (WHERE src AND e > b) = 0"
_SPINE = f"""
    WITH {sql_toks()}
    SELECT doc_id, CAST(n_tokens AS INTEGER) AS n_tokens FROM toks
    WHERE doc_id BETWEEN (SELECT min(doc_id) FROM labels) AND (SELECT max(doc_id) FROM labels) AND doc_id NOT IN (SELECT doc_id FROM labels) AND n_tokens >= 80 AND doc_id % 9 <> 0
"""
_WIRING = """
    WITH w AS (SELECT c_custkey, CASE WHEN n_nationkey IS NULL THEN 'no manifest item' WHEN c_acctbal < 0 THEN 'no overlay' WHEN r_name IS NULL THEN 'overlay not listed'
                                      WHEN r_name = 'ASIA' THEN 'wrong overlay type' WHEN c_mktsegment = 'BUILDING' THEN 'overlay file missing' END AS issue
               FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 9 <> 8) ON n_nationkey = c_nationkey LEFT JOIN (SELECT * FROM region WHERE r_regionkey <> 3) ON r_regionkey = n_regionkey)
    SELECT * FROM w WHERE issue IS NOT NULL
"""
_CHECKS = {
    "missing_transcripts": f"SELECT * FROM ({_STATES}) WHERE state <> 'ok'", "missing_long_audio": _LONG, "low_coverage": _COVERAGE, "duplicate_clips": _DUPLICATES, "overlapping_clips": _OVERLAPPING,
    "invalid_clips": _INVALID, "overlay_without_audio": _SILENT, "unmatched_spine": _SPINE, "missing_overlays": _WIRING,
}
_ROWS = " UNION ALL ".join(f"SELECT '{n}' AS name, {str(n == 'low_coverage').lower()} AS skipped, (SELECT count(*) FROM ({q})) AS findings" for n, q in _CHECKS.items())
ORACLES = {
    "audio_inventory": f"WITH {_INVENTORY} SELECT * FROM inv",
    "substantial_audio": f"WITH {_INVENTORY} SELECT * FROM inv WHERE duration >= 180 OR word_count >= 300",
    "missing_transcripts": _STATES,
    **{n: q for n, q in _CHECKS.items() if n != "missing_transcripts"},
    "chunk_completeness": f"""
        WITH {SQL_INTERVALS}
        SELECT event_id, event_id % 17 <> 0 AND event_id % 19 <> 0 AND next_s - s > 0 AND event_id % 23 <> 0
                         AND abs(next_s - s + event_id % 9 - 4 - greatest(next_s - s, 0)) <= CASE WHEN event_id % 2 = 0 THEN 5 ELSE 1 END AS complete
        FROM iv WHERE next_s IS NOT NULL
    """,
    "stamp_worklist": """
        SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'create' WHEN quality = 1 AND toxic = 0 THEN 'reuse' ELSE 'regenerate' END AS action
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
    """,
    "check_rollup": f"""
        WITH r AS (SELECT name, skipped OR findings = 0 AS ok, skipped, findings FROM ({_ROWS}))
        SELECT name, ok, skipped, findings FROM r UNION ALL SELECT 'total', bool_and(ok), false, CAST(count(*) FILTER (WHERE NOT ok) AS BIGINT) FROM r
    """,
}
