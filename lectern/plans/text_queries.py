"""Token, window and identifier queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.frames import by_key, spread
from lectern.operators import windows as W

from .base import SQL_SPACE, SQL_WINDOWS, sql_toks, table


def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.tokenised(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id")


def keyed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' tokens, those of one document in one task, for counts by document."""
    return W.tokenised(by_key(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"), "doc_id")


def normalize_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.posexplode_outer(T.displayed_tokens(F.col("text"))).alias("pos", "t"))
    return rows.where("pos IS NOT NULL").select("doc_id", "pos", F.col("t.display").alias("display"), F.col("t.token").alias("token"))


def token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = W.window_spans(document_tokens(spark, sf_dir), "doc_id")
    return W.global_index(spans, "doc_id", "window_index")


def window_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.window_multiset(keyed_tokens(spark, sf_dir), "doc_id")


def probe_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = W.probes(W.tokenised(table(spark, sf_dir, "benchmark"), "item_id"), "item_id")
    return rows.select("item_id", "n_tokens", F.size("probe").alias("n_probe"), "n_long", "reason", F.array_join("probe", " ").alias("probe"))


def short_page_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_tokens(spark, sf_dir).where((F.col("n_tokens") >= W.MIN_TOKENS) & (F.col("n_tokens") < W.MIN_WINDOW)).select("doc_id", "n_tokens")


def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace("url", "[?#].*$", "")
    rows = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    c = F.col("path")
    return rows.select("page_id", T.identifier(c).alias("name"), T.segment_prefix(c).alias("prefix"), T.overlay_name(c).alias("overlay"), T.overlay_id(c).alias("overlay_id"), T.letters_only(c).alias("letters"))


def fragment_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    both = pages.select("page_id", F.explode(T.fragment_names(F.concat_ws(" ", "url", "html"))).alias("name"))
    return both.groupBy("name").agg(F.count_distinct("page_id").alias("pages"), F.count("*").alias("mentions"))


def js_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    scripts = F.regexp_extract_all("html", F.lit("(?is)<script[^>]*>(.*?)</script>"), F.lit(1))
    pages = table(spark, sf_dir, "pages").select("page_id", F.explode(scripts).alias("script"))
    return pages.select(F.explode(T.script_names(F.col("script"))).alias("name")).groupBy("name").agg(F.count("*").alias("mentions"))


def sentence_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(T.sentence_language(F.col("lang")).alias("model"), "lang")
    return docs.groupBy("model", "lang").agg(F.count("*").alias("documents"))


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.operators.lineage import content_fingerprint

    rows = table(spark, sf_dir, "documents").select("doc_id", content_fingerprint(F.col("text")).alias("f"))
    return rows.select("doc_id", F.col("f.size").alias("size"), F.col("f.sha256").alias("sha256"))


QUERIES = {f.__name__: f for f in (normalize_tokens, token_windows, window_multiset, probe_prefix, short_page_candidates, identifiers, fragment_ids, js_tokens, sentence_languages, content_hash)}

_IDENT = "regexp_replace(regexp_replace(lower({0}), '[^0-9a-z]+', '_', 'g'), '^_+|_+$', '', 'g')"
_CLEAN = r"regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_]', '', 'g')"
ORACLES = {
    "normalize_tokens": rf"""
        WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(coalesce(text, ''), '{SQL_SPACE}'), lambda x: x <> '')) AS display,
                          generate_subscripts(list_filter(regexp_split_to_array(coalesce(text, ''), '{SQL_SPACE}'), lambda x: x <> ''), 1) AS i FROM documents),
             t AS (SELECT doc_id, i, display, unnest(regexp_split_to_array(display, '[-‐-―]')) AS part,
                          generate_subscripts(regexp_split_to_array(display, '[-‐-―]'), 1) AS j FROM w),
             c AS (SELECT doc_id, i, j, display, regexp_replace(lower(part), '[^\p{{L}}\p{{N}}_]', '', 'g') AS token FROM t)
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS INTEGER) AS pos, display, token FROM c WHERE token <> ''
    """,
    "token_windows": f"""
        WITH {sql_toks()}, {SQL_WINDOWS}
        SELECT *, CAST(row_number() OVER (ORDER BY doc_id, window_index) - 1 AS BIGINT) AS global_index FROM wins
    """,
    "window_multiset": f"""
        WITH {sql_toks()}, {SQL_WINDOWS},
             e AS (SELECT doc_id, window_index, unnest(list_filter(tokens[window_start + 1:window_end], lambda t: len(t) >= 4)) AS token FROM wins JOIN toks USING (doc_id))
        SELECT doc_id, window_index, token, count(*) AS n FROM e GROUP BY ALL
    """,
    "probe_prefix": f"""
        WITH {sql_toks('benchmark', 'item_id')}, p AS (SELECT *, tokens[1:120] AS probe FROM toks), l AS (SELECT *, len(list_filter(probe, lambda t: len(t) >= 4)) AS k FROM p)
        SELECT item_id, CAST(n_tokens AS INTEGER) AS n_tokens, CAST(len(probe) AS INTEGER) AS n_probe, CAST(k AS INTEGER) AS n_long,
               CASE WHEN n_tokens < 5 THEN 'short' WHEN k = 0 THEN 'no probe' ELSE 'ok' END AS reason, array_to_string(probe, ' ') AS probe FROM l
    """,
    "short_page_candidates": f"WITH {sql_toks()} SELECT doc_id, CAST(n_tokens AS INTEGER) AS n_tokens FROM toks WHERE n_tokens BETWEEN 5 AND 19",
    "identifiers": rf"""
        WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS path FROM pages),
             s AS (SELECT *, regexp_replace(path, '([^/])\.[^./]*$', '\1') AS stem FROM p),
             i AS (SELECT *, {_IDENT.format('path')} AS a, {_IDENT.format('stem')} AS b FROM s),
             n AS (SELECT *, CASE WHEN a = '' THEN 'item' WHEN regexp_matches(a, '^[0-9]') THEN 'item_' || a ELSE a END AS name,
                          CASE WHEN b = '' THEN 'item' WHEN regexp_matches(b, '^[0-9]') THEN 'item_' || b ELSE b END AS base FROM i)
        SELECT page_id, name, 'seg_' || base AS prefix, base || '.smil' AS overlay, 'html_overlay.' || base AS overlay_id, regexp_replace(path, '[^\p{{L}} ]', '', 'g') AS letters FROM n
    """,
    "fragment_ids": r"""
        WITH f AS (SELECT page_id, unnest(regexp_extract_all(concat_ws(' ', url, html), '#([^#\s"'']+)', 1)) AS name FROM pages)
        SELECT name, count(DISTINCT page_id) AS pages, count(*) AS mentions FROM f GROUP BY name
    """,
    "js_tokens": r"""
        WITH s AS (SELECT unnest(regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script>', 1)) AS script FROM pages),
             t AS (SELECT unnest(regexp_extract_all(script, '[A-Za-z_][A-Za-z0-9_-]+')) AS name FROM s)
        SELECT name, count(*) AS mentions FROM t GROUP BY name
    """,
    "sentence_languages": """
        SELECT CASE lang WHEN 'de' THEN 'german' WHEN 'en' THEN 'english' WHEN 'es' THEN 'spanish' WHEN 'fr' THEN 'french' ELSE lang END AS model, lang, count(*) AS documents
        FROM documents GROUP BY ALL
    """,
    "content_hash": "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS sha256 FROM documents",
}
