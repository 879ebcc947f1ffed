"""Queries of whole runs: packages, files, stamps, reuse, marked pages, clip totals, ordered findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import audits, lineage, markup, overlays, packages, reuse

from .audit_queries import SQL_RAW_CLIPS, duplicate_clips, raw_clips
from .base import sql_tokens, table


def _name(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def valid_clip_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips of three events an overlay; overlays without a valid one count 0."""
    rows = raw_clips(spark, sf_dir)
    return audits.clip_counts(rows, audits.parse_clips(rows), "overlay")


def overlay_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw_clips(spark, sf_dir).withColumn("end_raw", F.when(F.col("event_id") % 4 == 0, F.concat("end_raw", F.lit("ss"))).when(F.col("event_id") % 9 != 0, F.col("end_raw")))
    return audits.overlay_seconds(rows, "overlay")


def package_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as packages: early lines are overlay files, pending orders have an item with an overlay."""
    early = F.col("l_shipdate") < F.expr("TIMESTAMP_NTZ '1993-01-01 00:00:00'")
    entries = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("archive"), F.when(early, _name("smil/c", F.col("l_linenumber"), ".smil")).otherwise("OPS/text.xhtml").alias("entry"))
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("archive"), F.when(F.col("o_orderstatus") == "P", "overlay").when(F.col("o_orderstatus") == "F", "").alias("media_overlay"))
    return packages.processed(entries, "archive", "entry", items)


def package_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    output = F.when(k % 3 == 0, _name("/b/", k, "/w/n", k, ".epub3")).when(k % 3 == 1, _name("n", k, ".epub")).otherwise(_name("/b/n", k, ".zip"))
    source = F.when(k % 4 != 0, _name("/b/", k, "/w/n", k, ".epub"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.posexplode(packages.candidate_paths(output, source)).alias("rank", "path"))
    return rows


def opened_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's processed event; none shows null."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", ((F.col("event_type") == "purchase") & (F.col("value") > 50)).alias("processed"))
    return packages.opened(rows.withColumn("path", F.col("event_id")), "user_id", "event_id", require_processed=True).select("user_id", "path", "processed")


def ingested_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("book"), F.when(F.col("l_linenumber") % 3 == 1, _name("p", F.col("l_partkey"), ".epub")).otherwise(_name("a", F.col("l_suppkey"), ".mp3")).alias("name"))
    return packages.ingested(rows)


def file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered chunks and overlay documents among the files of each order."""
    line = F.col("l_linenumber")
    name = F.when(line % 2 == 0, _name("00", line, ".mp3")).when(line % 3 == 0, _name("c", F.col("l_partkey"), ".smil")).otherwise(_name("x", line, ".mp3"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("book"), name.alias("name")).distinct()
    chunks, drawn = packages.chunk_files(rows, "book", "name", ".mp3"), packages.overlay_files(rows, "book", "name")
    return chunks.withColumn("kind", F.lit("chunk")).unionByName(drawn.withColumn("kind", F.lit("overlay")))


def marked_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as segments of a page, read back from its markup."""
    escaped = F.replace(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit('<p><i>not this</i> <span id="cx-segment'), F.col("turn").cast("string"), F.lit('">'), escaped, F.lit("</span></p>")).alias("part"))
    pages = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "part"))), lambda x: x.part), "").alias("html"))
    rows = markup.read_segments(pages, ["conv_id"])
    return rows.select("conv_id", "seg_index", "seg_id", F.array_join(T.text_tokens(F.col("text")), " ").alias("tokens"))


def transcript_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as chunks whose transcripts are missing, unstamped, of another model or of a chunk cut otherwise."""
    i, none = F.col("o_orderkey"), F.lit(None).cast("string")

    def settings(size: Column, model: Column) -> Column:
        return F.struct(none.alias("audio_codec"), none.alias("audio_bitrate"), none.alias("audio_sample_rate"), none.alias("audio_channels"), size.alias("chunk_seconds"), F.lit("x").alias("backend"), model.alias("model"), none.alias("language"))

    rows = table(spark, sf_dir, "orders").withColumn("settings", settings(F.lit(600), F.col("o_orderpriority"))).withColumn("then", settings(F.when(i % 11 == 0, 300).otherwise(600), F.when(i % 5 == 0, "old").otherwise(F.col("o_orderpriority"))))
    now = lineage.transcript_stamp(lineage.chunk_stamp(i, i + 10))
    made = lineage.transcript_stamp(lineage.chunk_stamp(i, i + 10, "then"), "then")
    done = lineage.transcript_complete(i % 13 != 0, F.when(i % 7 != 0, made), now)
    return rows.select("o_orderkey", done.alias("complete"))


def stage_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as books: what of their stages is reused."""
    books = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("book"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book"), F.col("o_orderkey").cast("string").alias("json_file"), "o_orderstatus", "o_totalprice")
    sources = books.where("book % 10 <> 0").withColumn("name", F.lit("source"))
    verdicts = {
        "prepare": reuse.all_present(books, books.withColumn("name", F.lit("source")), sources, "name"),
        "transcribe": reuse.all_hold(books, orders, F.col("o_totalprice") > 2000),
        "match": reuse.matches_valid(books, orders.where("o_orderstatus <> 'P'"), orders),
    }
    return reuse.reconcile(verdicts)


def ordered_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = duplicate_clips(spark, sf_dir)
    return audits.ordered(rows, "l_orderkey", "l_linenumber", "discount")


def expected_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace("url", "[?#].*$", "")
    rows = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    return rows.select("page_id", T.transcript_name(F.col("path")).alias("transcript"), lineage.stamp_path(F.col("path")).alias("stamp"), lineage.book_path(F.lit("/books/"), F.regexp_replace("path", "^https?:/", "")).alias("place"))


def tuple_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("l_linenumber")
    long = F.array(_name("t", F.col("l_orderkey")), _name("p", F.col("l_partkey")), F.col("l_discount").cast("string"))
    rows = table(spark, sf_dir, "lineitem").select(F.when(line % 3 == 0, F.slice(long, 1, 2)).when(line % 3 == 1, long).otherwise(F.slice(long, 1, 1)).alias("match"))
    return overlays.tuple_spans(rows).select("json_file", "html_file", "score", "audio_end_index")


QUERIES = {
    f.__name__: f
    for f in (
        valid_clip_counts, overlay_seconds, package_facts, package_candidates, opened_packages, ingested_files, file_listing, marked_tokens, transcript_reuse, stage_actions, ordered_findings,
        expected_files, tuple_matches,
    )
}

_EXTENSION = r"regexp_replace({0}, '([^/])\.[^./]*$', '\1')"
ORACLES = {
    "valid_clip_counts": f"""
        WITH {SQL_RAW_CLIPS}
        SELECT overlay, count(*) FILTER (WHERE src AND e > b) AS clip_count, coalesce(sum(e - b) FILTER (WHERE src AND e > b), 0.0) AS covered FROM clips GROUP BY overlay
    """,
    "overlay_seconds": f"""
        WITH {SQL_RAW_CLIPS}
        SELECT overlay, coalesce(sum(greatest(CASE WHEN event_id % 4 <> 0 AND event_id % 9 = 0 THEN 0.0 ELSE e END - b, 0.0)), 0.0) AS seconds FROM clips GROUP BY overlay
    """,
    "package_facts": """
        SELECT l_orderkey AS archive, bool_or(l_shipdate < TIMESTAMP '1993-01-01' OR coalesce(o_orderstatus = 'P', false)) AS processed FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey GROUP BY 1
    """,
    "package_candidates": """
        WITH c AS (SELECT c_custkey, '/b/' || c_custkey || '/w/n' || c_custkey AS w, 'n' || c_custkey AS n FROM customer),
             p AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN ['/b/' || c_custkey || '/' || n || '.epub', w || '.epub3', w || '.epub'] WHEN 1 THEN [n || '.epub'] ELSE [] END AS o,
                          CASE WHEN c_custkey % 4 <> 0 AND c_custkey % 3 <> 0 THEN [w || '.epub'] ELSE [] END AS s FROM c),
             l AS (SELECT c_custkey, o || s AS a FROM p)
        SELECT c_custkey, CAST(unnest(range(len(a))) AS INTEGER) AS rank, unnest(a) AS path FROM l
    """,
    "opened_packages": """
        SELECT user_id, min(event_id) FILTER (WHERE event_type = 'purchase' AND value > 50) AS path, coalesce(bool_or(event_type = 'purchase' AND value > 50), false) AS processed FROM events GROUP BY 1
    """,
    "ingested_files": """
        WITH f AS (SELECT l_orderkey AS book, CASE WHEN l_linenumber % 3 = 1 THEN 'p' || l_partkey || '.epub' ELSE 'a' || l_suppkey || '.mp3' END AS name FROM lineitem),
             e AS (SELECT book, min(name) FILTER (WHERE name LIKE '%.epub') AS epub FROM f GROUP BY 1)
        SELECT book, epub, (SELECT min(name) FROM f WHERE f.book = e.book AND name <> epub) AS audio, regexp_replace(epub, '\\.epub$', '.epub3') AS working FROM e
    """,
    "file_listing": """
        WITH f AS (SELECT DISTINCT l_orderkey AS book, CASE WHEN l_linenumber % 2 = 0 THEN '00' || l_linenumber || '.mp3' WHEN l_linenumber % 3 = 0 THEN 'c' || l_partkey || '.smil' END AS name FROM lineitem)
        SELECT book, name, CAST(row_number() OVER (PARTITION BY book, name LIKE '%.smil' ORDER BY name) - 1 AS INTEGER) AS position, CASE WHEN name LIKE '%.smil' THEN 'overlay' ELSE 'chunk' END AS kind
        FROM f WHERE name IS NOT NULL
    """,
    "marked_tokens": f"""
        SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS seg_index, 'cx-segment' || turn AS seg_id, array_to_string({sql_tokens('text')}, ' ') AS tokens FROM conversations
    """,
    "transcript_reuse": "SELECT o_orderkey, o_orderkey % 13 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 5 <> 0 AS complete FROM orders",
    "stage_actions": """
        WITH o AS (SELECT o_custkey AS book, bool_and(o_totalprice > 2000) AS heard, bool_and(o_orderstatus <> 'P') AS placed FROM orders GROUP BY 1),
             v AS (SELECT c_custkey AS book, 'prepare' AS stage, 0 AS position, c_custkey % 10 <> 0 AS valid FROM customer
                   UNION ALL SELECT c_custkey, 'transcribe', 2, coalesce(heard, false) FROM customer LEFT JOIN o ON book = c_custkey
                   UNION ALL SELECT c_custkey, 'match', 3, coalesce(placed, false) FROM customer LEFT JOIN o ON book = c_custkey)
        SELECT *, CASE WHEN bool_and(valid) OVER (PARTITION BY book ORDER BY position) THEN 'reuse' ELSE 'run' END AS action FROM v
    """,
    "ordered_findings": """
        WITH d AS (SELECT l_orderkey, l_linenumber, round(l_discount, 3) AS discount, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1)
        SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, discount) - 1 AS position FROM d
    """,
    "expected_files": f"""
        WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS path FROM pages)
        SELECT page_id, {_EXTENSION.format("regexp_extract(path, '([^/]*)$', 1)")} || '.json' AS transcript, path || '.meta' AS stamp,
               CASE WHEN regexp_replace(path, '^https?:/', '') LIKE '/%' THEN regexp_replace(path, '^https?:/', '') ELSE '/books/' || path END AS place FROM p
    """,
    "tuple_matches": """
        SELECT 't' || l_orderkey AS json_file, 'p' || l_partkey AS html_file, CASE WHEN l_linenumber % 3 = 1 THEN l_discount ELSE 0.0::DOUBLE END AS score, -1 AS audio_end_index FROM lineitem WHERE l_linenumber % 3 < 2
    """,
}
