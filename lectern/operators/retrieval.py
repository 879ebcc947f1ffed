"""Probe-to-window retrieval: multiset overlap as a join, shortlists, rescoring."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lectern.functions.text import MIN_LONG

from .windows import SHORTLIST, window_multiset

MIN_SCORE, MIN_OVERLAP = 0.35, 6
WEIGHTS = (0.7, 0.3, 0.02)
SHORT_PAGE, MIN_RUN, COVER, MAX_OFFSET, MAX_SKIP = 20, 3, 0.6, 2, 2


def probe_multiset(probes: DataFrame, key: str) -> DataFrame:
    """(key, token, probe_n) of the long tokens of usable probes."""
    ok = probes.where("reason = 'ok'").select(key, F.explode("probe").alias("token")).where(F.length("token") >= MIN_LONG)
    return ok.groupBy(key, "token").agg(F.count("*").alias("probe_n"))


def overlaps(tokens: DataFrame, doc_key: str, probes: DataFrame, probe_key: str) -> DataFrame:
    """(probe, doc, window_index, overlap): summed minimum counts of shared long tokens.

    Document tokens outside the probes' vocabulary go before windows are formed.
    """
    wanted = probe_multiset(probes, probe_key)
    counts = window_multiset(tokens, doc_key, wanted.select("token").distinct())
    shared = counts.join(wanted, "token").select(probe_key, doc_key, "window_index", F.least("n", "probe_n").alias("m"))
    return shared.groupBy(probe_key, doc_key, "window_index").agg(F.sum("m").alias("overlap"))


def shortlist(scored: DataFrame, probe_key: str, doc_key: str, limit: int = SHORTLIST) -> DataFrame:
    """The `limit` windows of most overlap for each probe, earlier windows in reading order first on ties."""
    order = Window.partitionBy(probe_key).orderBy(F.desc("overlap"), F.asc(doc_key), F.asc("window_index"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


@F.pandas_udf(DoubleType())
def sequence_ratio(window: pd.Series, probe: pd.Series) -> pd.Series:
    """Similarity of two token sequences by matching blocks; the order of the two matters."""
    return pd.Series([difflib.SequenceMatcher(None, list(w), list(p), autojunk=False).ratio() for w, p in zip(window, probe, strict=True)])


def rescored(short: DataFrame, tokens: DataFrame, doc_key: str, spans: DataFrame, probes: DataFrame, probe_key: str) -> DataFrame:
    """The shortlist with `ratio` and `score` (without the order bonus, which depends on earlier matches)."""
    rows = short.join(spans, [doc_key, "window_index"]).join(tokens.select(doc_key, "tokens"), doc_key).join(probes.select(probe_key, "probe", "n_long"), probe_key)
    length = F.least(F.col("window_end") - F.col("window_start"), F.size("probe"))
    rows = rows.withColumn("ratio", sequence_ratio(F.slice("tokens", F.col("window_start") + 1, length), F.col("probe")))
    score = F.lit(WEIGHTS[0]) * F.col("overlap") / F.greatest(F.col("n_long"), F.lit(1)) + F.lit(WEIGHTS[1]) * F.col("ratio")
    return rows.withColumn("score", score).drop("tokens")


def best_windows(scored: DataFrame, probe_key: str) -> DataFrame:
    """The best-scored window of each probe, the better-ranked one on ties, and whether it is accepted."""
    order = Window.partitionBy(probe_key).orderBy(F.desc("score"), F.asc("rank"))
    best = scored.withColumn("_n", F.row_number().over(order)).where("_n = 1 AND score > 0").drop("_n")
    return best.withColumn("accepted", (F.col("score") >= MIN_SCORE) & (F.col("overlap") >= MIN_OVERLAP))


def page_prefixes(pages: DataFrame, page_key: str, probes: DataFrame, probe_key: str, group: str | None = None) -> DataFrame:
    """(page, probe) of one group where a short page, up to a short heading, opens a probe.

    A page of n tokens may lose a heading of at most two tokens as long as
    max(3, ceil(0.6 n)) stay; all that stays must stand in the probe, starting at
    one of its first three tokens.  The first token that must agree is an equi-join
    key, so no pair is tried that cannot match.
    """
    n = F.size("tokens")
    skip = F.least(F.lit(MAX_SKIP), n - F.greatest(F.lit(MIN_RUN), F.ceil(n * F.lit(COVER)).cast("int")))
    same = [F.col(group).alias("_group") if group else F.lit(0).alias("_group")]
    left = pages.where((n < SHORT_PAGE) & (skip >= 0)).select(F.col(page_key).alias("page"), *same, "tokens", F.explode(F.sequence(F.lit(0), skip)).alias("h"))
    left = left.select("page", "_group", F.slice("tokens", F.col("h") + 1, F.size("tokens")).alias("rest"), F.get("tokens", F.col("h")).alias("token"))
    right = probes.select(F.col(probe_key).alias("probe_id"), *same, "probe", F.posexplode(F.slice("probe", 1, MAX_OFFSET + 1)).alias("o", "token"))
    met = left.join(right, ["token", "_group"]).where(F.slice("probe", F.col("o") + 1, F.size("rest")) == F.col("rest"))
    return met.select("page", "probe_id").distinct()


