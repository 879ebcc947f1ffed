"""Retrieval and alignment queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import alignment, matching
from lectern.operators import retrieval as R
from lectern.operators import windows as W

from .base import SQL_WINDOWS, sql_tokens, sql_toks, table
from .text_queries import document_tokens, keyed_tokens


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.probes(W.tokenised(table(spark, sf_dir, "benchmark"), "item_id"), "item_id")


def probe_window_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.overlaps(keyed_tokens(spark, sf_dir), "doc_id", _probes(spark, sf_dir), "item_id")


def _shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.shortlist(probe_window_overlap(spark, sf_dir), "item_id", "doc_id")


def topk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = W.global_index(W.window_spans(document_tokens(spark, sf_dir), "doc_id"), "doc_id", "window_index")
    rows = _shortlist(spark, sf_dir).join(spans, ["doc_id", "window_index"])
    return rows.select("item_id", "rank", "doc_id", "window_index", "global_index", "overlap")


def accept_overlap_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = probe_window_overlap(spark, sf_dir)
    return rows.groupBy("item_id").agg(F.count("*").alias("candidates"), F.count_if(F.col("overlap") >= R.MIN_OVERLAP).alias("accepted"), F.max("overlap").alias("best"))


def probe_window_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rescored shortlist; the matching-block ratio has no SQL form."""
    tokens = document_tokens(spark, sf_dir)
    scored = R.rescored(_shortlist(spark, sf_dir), tokens, "doc_id", W.window_spans(tokens, "doc_id"), _probes(spark, sf_dir), "item_id")
    return R.best_windows(scored, "item_id").select("item_id", "doc_id", "window_index", "rank", "overlap", F.round("ratio", 9).alias("ratio"), F.round("score", 9).alias("score"), "accepted")


def page_prefix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = document_tokens(spark, sf_dir)
    probes = W.probes(tokens, "doc_id").where("reason = 'ok'").select("doc_id", "probe")
    return R.page_prefixes(tokens.where(F.col("n_tokens") >= W.MIN_TOKENS), "doc_id", probes, "doc_id")


def ordered_match_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts as transcripts, matched forward through the documents of each source; a rejected one keeps a row with its reason."""
    pages = table(spark, sf_dir, "documents").select(F.col("source").alias("book"), F.col("doc_id").alias("html_order"), "text")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("chunk"), "text")
    return matching.match_books(pages, pages.select("book").distinct().crossJoin(F.broadcast(items)))


def sequence_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark text aligned with its best window."""
    best = probe_window_score(spark, sf_dir).select("item_id", "doc_id", "window_index")
    spans = W.window_spans(document_tokens(spark, sf_dir), "doc_id")
    rows = best.join(spans, ["doc_id", "window_index"]).join(document_tokens(spark, sf_dir).select("doc_id", "tokens"), "doc_id")
    rows = rows.join(_probes(spark, sf_dir).select("item_id", "probe"), "item_id")
    runs = alignment.align(rows.select("item_id", F.slice("tokens", F.col("window_start") + 1, F.col("window_end") - F.col("window_start")).alias("text_tokens"), F.col("probe").alias("audio_tokens")), "item_id")
    from lectern.operators.timeline import summarise_runs

    return summarise_runs(runs, "item_id")


QUERIES = {f.__name__: f for f in (probe_window_overlap, topk_windows, accept_overlap_gate, probe_window_score, page_prefix_match, ordered_match_fold, sequence_alignment)}

_OVERLAP = f"""
    {sql_toks()}, {SQL_WINDOWS},
    counts AS (SELECT doc_id, window_index, token, count(*) AS n
               FROM (SELECT doc_id, window_index, unnest(list_filter(tokens[window_start + 1:window_end], lambda t: len(t) >= 4)) AS token FROM wins JOIN toks USING (doc_id)) GROUP BY ALL),
    probe0 AS (SELECT item_id, {sql_tokens('text')} AS tokens FROM benchmark),
    probe AS (SELECT item_id, token, count(*) AS probe_n
              FROM (SELECT item_id, unnest(list_filter(tokens[1:120], lambda t: len(t) >= 4)) AS token FROM probe0 WHERE len(tokens) >= 5) GROUP BY ALL),
    shared AS (SELECT item_id, doc_id, window_index, CAST(sum(least(n, probe_n)) AS BIGINT) AS overlap FROM counts JOIN probe USING (token) GROUP BY ALL)
"""
ORACLES = {
    "probe_window_overlap": f"WITH {_OVERLAP} SELECT * FROM shared",
    "topk_windows": f"""
        WITH {_OVERLAP},
             g AS (SELECT doc_id, window_index, CAST(row_number() OVER (ORDER BY doc_id, window_index) - 1 AS BIGINT) AS global_index FROM wins),
             r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, global_index) AS INTEGER) AS rank, doc_id, window_index, global_index, overlap
                   FROM shared JOIN g USING (doc_id, window_index))
        SELECT * FROM r WHERE rank <= 24
    """,
    "accept_overlap_gate": f"""
        WITH {_OVERLAP} SELECT item_id, count(*) AS candidates, CAST(count(*) FILTER (WHERE overlap >= 6) AS BIGINT) AS accepted, max(overlap) AS best FROM shared GROUP BY item_id
    """,
    "page_prefix_match": f"""
        WITH {sql_toks()},
             pages AS (SELECT doc_id AS page, tokens, n_tokens AS n, unnest(range(0, least(2, n_tokens - greatest(3, CAST(ceil(n_tokens * 0.6) AS BIGINT))) + 1)) AS h FROM toks WHERE n_tokens BETWEEN 5 AND 19),
             rests AS (SELECT page, tokens[h + 1:] AS rest, len(tokens[h + 1:]) AS k FROM pages),
             probes AS (SELECT doc_id AS probe_id, tokens[1:120] AS probe, unnest([0, 1, 2]) AS o FROM toks WHERE n_tokens >= 5 AND len(list_filter(tokens[1:120], lambda t: len(t) >= 4)) > 0)
        SELECT DISTINCT page, probe_id FROM rests JOIN probes ON rest[1] = probe[o + 1] WHERE probe[o + 1:o + k] = rest
    """,
}
