"""Ordered time queries over events, line items and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import clock
from lectern.functions.text import words
from lectern.operators import packages
from lectern.operators import timeline as L
from lectern.operators.windows import fixed_chunks as chunks
from lectern.sources.transcripts import audio_tokens, parse_transcripts

from .base import SQL_SECONDS, SQL_SPACE, seconds, table

CHUNK_S = 21_600
SHORT_S = 7_200.0


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, event_id, event_type, value, idx, s, next_s): events of a user in time order."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", (F.row_number().over(w) - 1).cast("long").alias("idx"), seconds("ts").alias("s"))
    return rows.withColumn("next_s", F.lead("s").over(Window.partitionBy("user_id").orderBy("idx")))


def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = table(spark, sf_dir, "events").groupBy("user_id").agg((F.max(seconds("ts")) - F.min(seconds("ts"))).alias("total"))
    return chunks(totals, "user_id", "total", CHUNK_S)


def chapter_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intervals(spark, sf_dir).where("next_s IS NOT NULL").select("user_id", F.col("s").alias("start"), F.col("next_s").alias("end"))
    return L.merge_chapters(rows, "user_id", SHORT_S)


def segment_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intervals(spark, sf_dir).select("user_id", "event_type", "idx", "s", (F.col("s") + F.col("value")).alias("e"), F.col("event_id").cast("string").alias("word"))
    return L.envelopes(rows, ["user_id", "event_type"], "idx", "s", "e", "word")


def alignment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intervals(spark, sf_dir).select("user_id", (F.col("idx") * 3).alias("text_start"), (F.col("idx") * 2).alias("audio_start"), (F.col("event_id") % 4).alias("length"))
    return L.summarise_runs(rows, "user_id")


def interior_gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = intervals(spark, sf_dir).where("event_id % 3 <> 0").select("user_id", F.col("idx").alias("seg_index"), F.col("s").alias("start"), (F.col("s") + F.col("value")).alias("end"))
    return L.fill_gaps(matched, "user_id")


def close_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.max("s").over(Window.partitionBy("user_id")) + 3600
    rows = intervals(spark, sf_dir).select("user_id", "idx", F.col("s").alias("start"), total.alias("total"))
    return L.close_timeline(rows, "user_id", "idx", "total").select("user_id", "idx", "start", "end")


def first_writer_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col(c) for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity")]
    return L.first_writer(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


def span_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("n"))
    rows = rows.select("conv_id", "turn", (F.sum("n").over(w.orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("audio_start"), F.sum("n").over(w).alias("total"))
    return L.backfill_ends(rows, "conv_id", "turn", "audio_start", "total").drop("total")


def backward_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("place"))
    return L.backward_jumps(rows, "conv_id", "turn", "place")


def media_duration_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations of event types and of all, summed in whole milliseconds."""
    rows = table(spark, sf_dir, "events").select("event_type", F.floor(F.col("value") * 1000).cast("double").alias("seconds"))
    totals = packages.overlay_totals(rows, "event_type")
    return totals.select("event_type", clock.media_duration(F.col("duration") / 1000).alias("duration"))


def transcript_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as timed words, some without times, even conversations in one layout and odd ones in the other."""
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(words(F.col("text"))).alias("pos", "word"))
    at = F.col("turn") * 1000.0 + F.col("pos")
    said = said.select("conv_id", F.struct("turn", "pos", F.struct("word", F.when((F.col("turn") + F.col("pos")) % 5 != 3, at).alias("start"), (at + 0.5).alias("end")).alias("w")).alias("x"))
    rows = said.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x.w).alias("w"))
    flat, nested = F.to_json(F.struct(F.col("w").alias("word_segments"))), F.to_json(F.struct(F.array(F.struct(F.col("w").alias("words"))).alias("segments")))
    texts = rows.select("conv_id", F.when(F.col("conv_id") % 2 == 0, flat).otherwise(nested).alias("json"))
    return audio_tokens(parse_transcripts(texts, "conv_id", "json"), "conv_id")


QUERIES = {f.__name__: f for f in (fixed_chunks, chapter_merge, segment_envelope, alignment_summary, interior_gap_fill, close_timeline, first_writer_wins, span_backfill, backward_jumps, media_duration_rollup, transcript_layouts)}

_S = SQL_SECONDS.format("ts")
SQL_INTERVALS = f"""
    iv0 AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, {_S} AS s FROM events),
    iv AS (SELECT *, lead(s) OVER (PARTITION BY user_id ORDER BY idx) AS next_s FROM iv0)
"""
ORACLES = {
    "fixed_chunks": f"""
        WITH t AS (SELECT user_id, max({_S}) - min({_S}) AS total FROM events GROUP BY user_id),
             c AS (SELECT user_id, total, unnest(range(0, CAST(ceil(total / {CHUNK_S}) AS BIGINT))) AS chunk FROM t WHERE total > 0)
        SELECT user_id, CAST(chunk AS INTEGER) AS chunk, chunk * {CHUNK_S}.0::DOUBLE AS start, least((chunk + 1) * {CHUNK_S}.0::DOUBLE, total) AS "end" FROM c
    """,
    "chapter_merge": f"""
        WITH RECURSIVE {SQL_INTERVALS},
             c AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY s, next_s) - 1 AS i, s, next_s AS e FROM iv WHERE next_s IS NOT NULL),
             f AS (SELECT user_id, i, s, e, 0 AS g FROM c WHERE i = 0
                   UNION ALL
                   SELECT c.user_id, c.i, CASE WHEN f.e - f.s < {SHORT_S} THEN f.s ELSE c.s END, c.e, CASE WHEN f.e - f.s < {SHORT_S} THEN f.g ELSE f.g + 1 END
                   FROM f JOIN c ON c.user_id = f.user_id AND c.i = f.i + 1),
             m AS (SELECT user_id, g, min(s) AS s, max(e) AS e FROM f GROUP BY user_id, g),
             l AS (SELECT *, max(g) OVER (PARTITION BY user_id) AS last FROM m),
             t AS (SELECT user_id, CASE WHEN g = last AND g > 0 AND e - s < {SHORT_S} THEN g - 1 ELSE g END AS id, s, e FROM l)
        SELECT user_id, CAST(id AS INTEGER) AS id, min(s) AS start, max(e) AS "end" FROM t GROUP BY user_id, id
    """,
    "segment_envelope": f"""
        WITH {SQL_INTERVALS}
        SELECT user_id, event_type, min(s) AS start, max(s + value) AS "end", string_agg(CAST(event_id AS VARCHAR), ' ' ORDER BY idx) AS audio_text, count(*) AS n_words FROM iv GROUP BY ALL
    """,
    "alignment_summary": f"""
        WITH {SQL_INTERVALS}, r AS (SELECT user_id, idx * 3 AS t, idx * 2 AS a, event_id % 4 AS n FROM iv)
        SELECT user_id, CAST(sum(n) AS BIGINT) AS matched, coalesce(max(t + n - 1) FILTER (WHERE n > 0), -1) AS max_text,
               min(a) FILTER (WHERE n > 0) AS min_audio, coalesce(max(a + n - 1) FILTER (WHERE n > 0), -1) AS max_audio FROM r GROUP BY user_id
    """,
    "interior_gap_fill": f"""
        WITH {SQL_INTERVALS}, m AS (SELECT user_id, idx, s, s + value AS e FROM iv WHERE event_id % 3 <> 0),
             n AS (SELECT *, lead(idx) OVER w AS ni, lead(s) OVER w AS ns FROM m WINDOW w AS (PARTITION BY user_id ORDER BY idx)),
             h AS (SELECT user_id, idx, e, ns - e AS gap, ni - idx - 1 AS k, unnest(range(1, ni - idx)) AS j FROM n WHERE ni > idx + 1 AND ns > e)
        SELECT user_id, idx AS seg_index, s AS start, e AS "end", false AS interpolated FROM m
        UNION ALL SELECT user_id, idx + j, e + gap / (k + 1) * j, e + gap / (k + 1) * j, true FROM h
    """,
    "close_timeline": f"""
        WITH {SQL_INTERVALS}
        SELECT user_id, idx, CASE WHEN idx = 0 THEN 0.0::DOUBLE ELSE s END AS start, coalesce(next_s, max(s) OVER (PARTITION BY user_id) + 3600) AS "end" FROM iv
    """,
    "first_writer_wins": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity) = 1
    """,
    "span_backfill": """
        WITH t AS (SELECT conv_id, turn, length(text) AS n FROM conversations),
             s AS (SELECT conv_id, turn, CAST(sum(n) OVER (PARTITION BY conv_id ORDER BY turn) - n AS BIGINT) AS audio_start, CAST(sum(n) OVER (PARTITION BY conv_id) AS BIGINT) AS total FROM t)
        SELECT conv_id, turn, audio_start, greatest(audio_start, coalesce(lead(audio_start) OVER (PARTITION BY conv_id ORDER BY turn), total) - 1) AS audio_end FROM s
    """,
    "backward_jumps": """
        WITH t AS (SELECT conv_id, turn, length(text) AS place, lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations)
        SELECT * FROM t WHERE place < previous
    """,
    "media_duration_rollup": """
        WITH t AS (SELECT event_type, CAST(sum(greatest(floor(value * 1000), 0)) AS BIGINT) AS ms FROM events GROUP BY ROLLUP (event_type))
        SELECT event_type, (ms // 3600000) || ':' || lpad(CAST(ms % 3600000 // 60000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ms % 60000 // 1000 AS VARCHAR), 2, '0')
               || '.' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') AS duration FROM t
    """,
    "transcript_layouts": rf"""
        WITH w0 AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(coalesce(text, ''), '{SQL_SPACE}'), lambda x: x <> '') AS l FROM conversations),
             w AS (SELECT conv_id, turn, unnest(range(len(l))) AS pos, unnest(l) AS word FROM w0),
             p AS (SELECT conv_id, turn, pos, word, unnest(regexp_split_to_array(word, '[-‐-―]')) AS part, generate_subscripts(regexp_split_to_array(word, '[-‐-―]'), 1) AS j FROM w WHERE (turn + pos) % 5 <> 3),
             c AS (SELECT conv_id, turn, pos, j, word, regexp_replace(lower(part), '[^\p{{L}}\p{{N}}_]', '', 'g') AS token FROM p)
        SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos, j) - 1 AS INTEGER) AS idx, token, word, turn * 1000.0::DOUBLE + pos AS start, turn * 1000.0::DOUBLE + pos + 0.5 AS "end" FROM c WHERE token <> ''
    """,
}
