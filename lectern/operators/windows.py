"""Token windows, global order and probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import MIN_LONG, text_tokens

WINDOW, STEP, MIN_WINDOW, MIN_TOKENS = 160, 80, 20, 5
PROBE = 120
SHORTLIST = 24
_BUCKET = 4096


def window_starts(n: Column, size: int = WINDOW, step: int = STEP, least: int = MIN_TOKENS) -> Column:
    """Starts of the windows over n tokens.

    Every `step` tokens while a full window fits, and one more that ends with the
    last token; a text of at most one window's size is one window, a text below
    `least` tokens has none.
    """
    last = n - size
    full = F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(step))
    return F.when(n < least, F.array().cast("array<int>")).when(last <= 0, F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(full, F.array(last))))


def tokenised(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, tokens, n_tokens)."""
    return texts.select(key, text_tokens(F.col(text)).alias("tokens")).withColumn("n_tokens", F.size("tokens"))


def window_spans(tokens: DataFrame, key: str) -> DataFrame:
    """(key, window_index, window_start, window_end) of tokenised texts; no token is copied."""
    # outer: a plain explode makes Spark filter on the array's size first, which would tokenise twice
    spans = tokens.select(key, "n_tokens", F.posexplode_outer(window_starts(F.col("n_tokens"))).alias("window_index", "window_start"))
    return spans.where("window_start IS NOT NULL").select(key, "window_index", "window_start", F.least(F.col("window_start") + WINDOW, F.col("n_tokens")).alias("window_end"))


def global_index(rows: DataFrame, key: str, minor: str, name: str = "global_index") -> DataFrame:
    """Adds the position of each row in (key, minor) order over all rows.

    Numbers are counted inside buckets of neighbouring keys and shifted by the
    sizes of the buckets before, so only one number a bucket meets in one task.
    """
    bucketed = rows.withColumn("_bucket", F.floor(F.col(key) / _BUCKET))
    sizes = bucketed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(key, minor)) - 1
    return bucketed.withColumn("_inside", inside).join(shifts, "_bucket").withColumn(name, (F.col("_before") + F.col("_inside")).cast("long")).drop("_bucket", "_inside", "_before")


def window_multiset(tokens: DataFrame, key: str, vocabulary: DataFrame | None = None) -> DataFrame:
    """(key, window_index, token, n) of long tokens.

    A token position lies in few windows, so positions are exploded once and each
    names its windows by arithmetic; a vocabulary (column token) drops positions
    before that.  Tokens parted by the key (`frames.by_key`) are counted where they
    are; others are moved as exploded rows.
    """
    at = tokens.select(key, "n_tokens", F.posexplode_outer("tokens").alias("pos", "token")).where((F.length("token") >= MIN_LONG) & (F.col("n_tokens") >= MIN_TOKENS))
    if vocabulary is not None:
        at = at.join(vocabulary.select("token"), "token", "left_semi")
    last = F.col("n_tokens") - WINDOW
    regular = F.greatest(F.floor(last / STEP), F.lit(0))  # number of the last regular window
    low = F.greatest(F.ceil((F.col("pos") - WINDOW + 1) / STEP), F.lit(0))
    high = F.least(F.floor(F.col("pos") / STEP), regular)
    inside = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
    has_tail = (last > 0) & (last % STEP != 0)
    tail = F.when(has_tail & (F.col("pos") >= last), F.array(regular + 1)).otherwise(F.array().cast("array<bigint>"))
    windows = F.when(last <= 0, F.array(F.lit(0).cast("long"))).otherwise(F.concat(inside, tail))
    placed = at.select(key, "token", F.explode(windows).alias("window_index"))
    return placed.select(key, "token", F.col("window_index").cast("int").alias("window_index")).groupBy(key, "window_index", "token").agg(F.count("*").alias("n"))


def probes(tokens: DataFrame, key: str, limit: int = PROBE) -> DataFrame:
    """(key, n_tokens, probe, n_long, reason): a probe's tokens, or why there is none."""
    probe = F.slice("tokens", 1, limit)
    rows = tokens.select(key, "n_tokens", probe.alias("probe"), F.size(F.filter(probe, lambda t: F.length(t) >= MIN_LONG)).alias("n_long"))
    return rows.withColumn("reason", F.when(F.col("n_tokens") < MIN_TOKENS, "short").when(F.col("n_long") == 0, "no probe").otherwise("ok"))


def fixed_chunks(totals: DataFrame, key: str, total: str, size: float) -> DataFrame:
    """(key, chunk, start, end): slices of `size`, the last one clipped."""
    count = F.ceil(F.col(total) / size).cast("int")
    rows = totals.where(F.col(total) > 0).select(key, total, F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk"))
    return rows.select(key, "chunk", (F.col("chunk") * F.lit(float(size))).alias("start"), F.least((F.col("chunk") + 1) * F.lit(float(size)), F.col(total)).alias("end"))
