"""Span, overlay and name-usage queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import overlays
from lectern.operators.lineage import reason_counts
from lectern.sources.transcripts import duration_or_fallback

from .base import sql_toks, table

SEGMENT_TOKENS, DROPPED = 8, 7


def overlay_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark text as a book of one page, read out with every seventh word missing."""
    books = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("book"), T.text_tokens(F.col("text")).alias("tokens")).where(F.size("tokens") > 0)
    words = books.select("book", F.posexplode("tokens").alias("pos", "token"))
    segments = words.groupBy("book", F.floor(F.col("pos") / SEGMENT_TOKENS).cast("int").alias("seg_index")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x.token).alias("tokens"))
    segments = segments.select("book", F.lit(0).cast("long").alias("html_order"), "seg_index", "tokens")
    heard = words.where(F.col("pos") % DROPPED != DROPPED - 1)
    idx = (F.col("pos") - F.floor((F.col("pos") + 1) / DROPPED)).cast("int")
    audio = heard.select("book", F.lit(1).cast("long").alias("chunk"), idx.alias("idx"), "token", F.col("token").alias("word"), (F.col("pos") * 0.5).alias("start"), (F.col("pos") * 0.5 + 0.25).alias("end"))
    n = F.size("tokens")
    spans = books.select("book", F.lit(1).cast("long").alias("chunk"), F.lit(0).alias("span_index"), F.lit(0).cast("long").alias("html_order"), F.lit(0).alias("window_start"), n.alias("window_end"), F.lit(0).alias("audio_start"), F.lit(-1).alias("audio_end"))
    durations = books.select("book", F.lit(1).cast("long").alias("chunk"), (n * 0.5 + 1).alias("duration"))
    return overlays.clip_plan(spans, audio, segments, durations)


def span_adapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as match rows of older and newer shape, in transcript order."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_returnflag") == "R", "").otherwise(F.concat(F.lit("t"), F.col("l_orderkey").cast("string"))).alias("json_file"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("audio_file"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("file_name"), F.col("l_linenumber").alias("span_index"), F.col("l_suppkey").cast("int").alias("html_order"), F.col("l_partkey").alias("window_index"), F.col("l_quantity").cast("int").alias("window_start"),
    )
    rows = overlays.span_order(overlays.spans_adapter(lines)).where("place = 0")
    return rows.select("json_file", "span_index", "html_order", "candidate_index", "audio_end_index")


def first_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber")
    return overlays.first_mentions(rows, "l_partkey", "l_orderkey", "l_linenumber").select("l_partkey", F.col("first.l_orderkey").alias("orderkey"), F.col("first.l_linenumber").alias("linenumber"))


def missing_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines 1 to 3 that the line items lack."""
    expected = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("line"))
    present = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("line"))
    return overlays.missing_entries(expected, present, ["orderkey", "line"])


def unused_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class names of pages that no inline stylesheet selects by name."""
    pages = table(spark, sf_dir, "pages")
    lists = F.transform(F.regexp_extract_all("html", F.lit('class="([^"]*)"'), F.lit(1)), lambda x: F.split(x, " "))
    used = pages.select(F.lit("class").alias("kind"), F.explode(F.flatten(lists)).alias("name")).where("name <> ''").distinct()
    known = pages.select(F.explode(F.regexp_extract_all("html", F.lit(r"(?:\.|^|[\s,>{};])([A-Za-z][A-Za-z0-9_-]*)\{"), F.lit(1))).alias("name")).select(F.lit("class").alias("kind"), "name").distinct()
    return overlays.unused_names(used, known)


def audio_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(i % 3 == 0, F.lit(0.0)).when(i % 3 == 1, F.col("o_totalprice")).alias("stream_s"), F.when(i % 5 != 0, F.col("o_totalprice") + 1).alias("container_s"), F.when(i % 7 != 0, F.lit(10.0)).alias("last_end"),
    )
    return rows.select("o_orderkey", duration_or_fallback().alias("duration"))


def match_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .match_queries import _probes

    return reason_counts(_probes(spark, sf_dir))


QUERIES = {f.__name__: f for f in (overlay_clips, span_adapter, first_mentions, missing_entries, unused_names, audio_durations, match_reasons)}

ORACLES = {
    "span_adapter": """
        WITH r AS (SELECT CASE WHEN l_returnflag = 'R' THEN 'o' ELSE 't' END || l_orderkey AS json_file, l_linenumber AS span_index, CAST(l_suppkey AS INTEGER) AS html_order, l_partkey AS candidate_index FROM lineitem)
        SELECT *, -1 AS audio_end_index FROM r QUALIFY row_number() OVER (PARTITION BY json_file ORDER BY span_index, html_order, candidate_index) = 1
    """,
    "first_mentions": """
        SELECT l_partkey, l_orderkey AS orderkey, l_linenumber AS linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) = 1
    """,
    "missing_entries": """
        SELECT orderkey, CAST(line AS INTEGER) AS line FROM (SELECT o_orderkey AS orderkey, unnest([1, 2, 3]) AS line FROM orders)
        WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = orderkey AND l_linenumber = line)
    """,
    "unused_names": r"""
        WITH u AS (SELECT DISTINCT unnest(flatten(list_transform(regexp_extract_all(html, 'class="([^"]*)"', 1), lambda x: string_split(x, ' ')))) AS name FROM pages),
             k AS (SELECT DISTINCT unnest(regexp_extract_all(html, '(?:\.|^|[\s,>{};])([A-Za-z][A-Za-z0-9_-]*)\{', 1)) AS name FROM pages)
        SELECT 'class' AS kind, name FROM u WHERE name <> '' AND name NOT IN (SELECT name FROM k) AND EXISTS (SELECT 1 FROM k)
    """,
    "audio_durations": """
        WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 1 THEN o_totalprice END AS s, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice + 1 END AS c, CASE WHEN o_orderkey % 7 <> 0 THEN 10.0::DOUBLE END AS l FROM orders)
        SELECT o_orderkey, coalesce(CASE WHEN s > 0 THEN s END, CASE WHEN c > 0 THEN c END, l + 1) AS duration FROM r
    """,
    "match_reasons": f"""
        WITH {sql_toks('benchmark', 'item_id')}
        SELECT CASE WHEN n_tokens < 5 THEN 'short' WHEN len(list_filter(tokens[1:120], lambda t: len(t) >= 4)) = 0 THEN 'no probe' ELSE 'ok' END AS reason, count(*) AS n FROM toks GROUP BY 1
    """,
}
