"""Package queries: reading order, manifests, wiring, overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import clock
from lectern.operators import audits, packages
from lectern.sources import smil

from .base import table


def spine_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a brand in the order returned lines mention them, then the others by name."""
    parts = table(spark, sf_dir, "part")
    manifest = parts.select(F.col("p_brand").alias("book"), F.col("p_partkey").alias("item"), F.col("p_name").alias("name"))
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("item"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return packages.reading_order(manifest, lines.join(manifest.select("book", "item"), "item"), "book", "item", "name", "pos")


def manifest_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col(c) for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity")]
    return packages.manifest_map(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


def classify_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds, ends = ["text/css", "application/javascript", "application/x-dtbncx+xml", "", " Text/HTML "], [".css", ".JS", ".mp3", ".xhtml", ".opus", ".bin"]
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("page_id") % len(values) + 1).cast("int"))
    rows = table(spark, sf_dir, "pages").select("page_id", pick(kinds).alias("media"), F.concat(F.lit("item"), F.col("page_id").cast("string"), pick(ends)).alias("path"))
    return rows.select("page_id", "path", packages.source_kind(F.col("media"), F.col("path")).alias("kind"), clock.audio_media_type(F.col("path")).alias("audio_type"), clock.chunk_name(F.regexp_replace("path", "^item", "00"), ".mp3").alias("chunk"))


def toc_like_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", packages.toc_like(F.col("html")).alias("toc"))


def preferred_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's first processed event, else the first one, with a click standing in for overlay files."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") == "purchase").alias("processed"))
    return packages.preferred(rows, "user_id", "event_id")


def processed_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("l_shipdate") < F.expr("TIMESTAMP_NTZ '1993-01-01 00:00:00'"), F.concat(F.lit("OPS/smil/c"), F.col("l_linenumber").cast("string"), F.lit(".smil"))).otherwise("OPS/text.xhtml")
    return packages.processed(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("archive"), name.alias("entry")), "archive", "entry")


def smil_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations rendered as overlay documents and read back as clips with their totals."""
    clips = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.concat(F.lit("page"), F.col("conv_id").cast("string"), F.lit(".xhtml")).alias("href"), F.concat(F.lit("s"), F.col("turn").cast("string")).alias("seg_id"),
        F.concat(F.lit("a"), (F.col("turn") % 2).cast("string"), F.lit(".mp3")).alias("audio_file"), (F.col("turn") * 2.0).alias("start"), (F.col("turn") * 2.0 + F.col("turn") % 3).alias("end"),
    )
    documents = smil.render_overlays(clips, "conv_id", "href", "turn")
    rows = audits.parse_clips(smil.clip_rows(documents, "conv_id", "xml")).where("valid")
    return rows.groupBy("conv_id", "audio_file").agg(F.count("*").alias("clips"), F.sum(F.col("end") - F.col("begin")).alias("covered"))


QUERIES = {f.__name__: f for f in (spine_order, manifest_map, classify_manifest, toc_like_pages, preferred_package, processed_packages, smil_clips)}

ORACLES = {
    "spine_order": """
        WITH f AS (SELECT l_partkey AS item, min(l_orderkey * 10 + l_linenumber) AS pos FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
        SELECT p_brand AS book, p_partkey AS item, row_number() OVER (PARTITION BY p_brand ORDER BY pos IS NULL, pos, p_name, p_partkey) - 1 AS place, pos IS NOT NULL AS in_spine
        FROM part LEFT JOIN f ON item = p_partkey
    """,
    "manifest_map": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC) = 1
    """,
    "classify_manifest": """
        WITH p AS (SELECT page_id, trim(lower(['text/css', 'application/javascript', 'application/x-dtbncx+xml', '', ' Text/HTML '][page_id % 5 + 1])) AS m,
                          'item' || page_id || ['.css', '.JS', '.mp3', '.xhtml', '.opus', '.bin'][page_id % 6 + 1] AS path FROM pages)
        SELECT page_id, path, CASE WHEN m = 'text/css' OR path LIKE '%.css' THEN 'css' WHEN m = 'application/javascript' OR lower(path) LIKE '%.js' THEN 'js'
                                   WHEN m = 'application/x-dtbncx+xml' THEN 'ncx' WHEN m = 'text/html' OR path LIKE '%.xhtml' THEN 'html' END AS kind,
               CASE WHEN path LIKE '%.mp3' THEN 'audio/mpeg' WHEN path LIKE '%.opus' THEN 'audio/ogg' ELSE 'audio/mp4' END AS audio_type,
               path LIKE '%.mp3' AND regexp_matches('00' || page_id, '^[0-9]{3,}$') AS chunk FROM p
    """,
    "toc_like_pages": r"""SELECT page_id, regexp_matches(html, '(?i)<nav[\s>]') OR regexp_matches(html, '(?i)epub:type\s*=\s*["''][^"'']*\b(toc|landmarks)\b') AS toc FROM pages""",
    "preferred_package": """
        SELECT user_id, event_id, event_type = 'purchase' AS processed FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'purchase' DESC, event_id) = 1
    """,
    "processed_packages": "SELECT l_orderkey AS archive, bool_or(l_shipdate < TIMESTAMP '1993-01-01') AS processed FROM lineitem GROUP BY 1",
    "smil_clips": """
        SELECT conv_id, 'a' || (turn % 2) || '.mp3' AS audio_file, count(*) AS clips, CAST(sum(turn % 3) AS DOUBLE) AS covered FROM conversations WHERE turn % 3 > 0 GROUP BY ALL
    """,
}
