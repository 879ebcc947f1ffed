"""Ordered time operators: envelopes, gap filling, closed timelines, chapter merging."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.clock import MIN_CHAPTER_S


def backfill_ends(spans: DataFrame, group: str, order: str, start: str, total: str, end: str = "audio_end") -> DataFrame:
    """A span ends before the next one starts, at least where it starts; the last one at total - 1."""
    following = F.lead(start).over(Window.partitionBy(group).orderBy(order))
    return spans.withColumn(end, F.greatest(F.col(start), F.coalesce(following, F.col(total)) - 1))


def envelopes(words: DataFrame, keys: list[str], order: str, start: str, end: str, word: str) -> DataFrame:
    """Per group the earliest start, the latest end, the words in order and their number."""
    grouped = words.groupBy(*keys).agg(
        F.min(start).alias("start"), F.max(end).alias("end"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(word).alias("w")))).alias("_w"), F.count("*").alias("n_words")
    )
    return grouped.select(*keys, "start", "end", F.array_join(F.transform("_w", lambda x: x.w), " ").alias("audio_text"), "n_words")


def summarise_runs(runs: DataFrame, key: str, text_offset: int = 0, audio_offset: int = 0) -> DataFrame:
    """Per group of equal runs (text_start, audio_start, length): tokens matched and the extents reached.

    Without runs the latest positions are one before the offsets and the earliest is null.
    """
    some = F.col("length") > 0
    return runs.groupBy(key).agg(
        F.coalesce(F.sum("length"), F.lit(0)).alias("matched"),
        F.coalesce(F.max(F.when(some, F.col("text_start") + F.col("length") - 1)), F.lit(text_offset - 1)).alias("max_text"),
        F.min(F.when(some, F.col("audio_start"))).alias("min_audio"),
        F.coalesce(F.max(F.when(some, F.col("audio_start") + F.col("length") - 1)), F.lit(audio_offset - 1)).alias("max_audio"),
    )


def fill_gaps(matched: DataFrame, group: str, index: str = "seg_index") -> DataFrame:
    """Adds evenly spaced points for indices missing between two matched ones with a positive time gap.

    Columns (group, index, start, end, interpolated); nothing is added before the
    first or after the last matched index.
    """
    w = Window.partitionBy(group).orderBy(index)
    rows = matched.select(group, index, "start", "end", F.lead(index).over(w).alias("_next"), F.lead("start").over(w).alias("_at"))
    holes = rows.where((F.col("_next") > F.col(index) + 1) & (F.col("_at") > F.col("end")))
    missing = F.col("_next") - F.col(index) - 1
    points = holes.select(group, F.col(index).alias("_i"), F.col("end").alias("_e"), (F.col("_at") - F.col("end")).alias("_gap"), missing.alias("_m"), F.explode(F.sequence(F.lit(1).cast("long"), missing.cast("long"))).alias("_j"))
    at = F.col("_e") + F.col("_gap") / (F.col("_m") + 1) * F.col("_j")
    filled = points.select(group, (F.col("_i") + F.col("_j")).alias(index), at.alias("start"), at.alias("end"), F.lit(True).alias("interpolated"))
    return rows.select(group, index, "start", "end", F.lit(False).alias("interpolated")).unionByName(filled)


def close_timeline(rows: DataFrame, group: str, order: str, total: str) -> DataFrame:
    """Every row ends where the next starts; the first starts at 0 and the last ends at the total."""
    w = Window.partitionBy(group).orderBy(order)
    first, following = F.row_number().over(w) == 1, F.lead("start").over(w)
    return rows.withColumn("_end", F.coalesce(following, F.col(total))).withColumn("start", F.when(first, F.lit(0.0)).otherwise(F.col("start"))).withColumn("end", F.col("_end")).drop("_end")


def merged(chapters: list[tuple[float, float]], least: float = MIN_CHAPTER_S) -> list[tuple[float, float]]:
    """One book's chapters in order: one shorter than `least` takes in the next, a short last one joins the one before."""
    out: list[tuple[float, float]] = []
    for start, end in chapters:
        if out and out[-1][1] - out[-1][0] < least:
            out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    if len(out) > 1 and out[-1][1] - out[-1][0] < least:
        out[-2:] = [(out[-2][0], out[-1][1])]
    return out


def merge_chapters(chapters: DataFrame, group: str, least: float = MIN_CHAPTER_S) -> DataFrame:
    """(group, id, start, end) of each group's merged chapters; a group's chapters are read once, in one task."""
    kind = chapters.schema[group].dataType.simpleString()

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rows = merged(sorted(zip(frame["start"], frame["end"], strict=True)), least)
        return pd.DataFrame([(key[0], i, a, b) for i, (a, b) in enumerate(rows)], columns=[group, "id", "start", "end"])

    rows = chapters.select(group, F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))
    return rows.groupBy(group).applyInPandas(run, f"{group} {kind}, id int, start double, end double")


def first_writer(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key; everything later is a repeat."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def last_writer(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each key: later entries replace earlier ones."""
    return first_writer(rows, keys, [o.desc() for o in order])


def backward_jumps(rows: DataFrame, group: str, order: str, value: str, exempt: str = "(?i)intro|preface") -> DataFrame:
    """Rows whose value is below the one before, unless the row before has an exempt name (column name)."""
    w = Window.partitionBy(group).orderBy(order)
    marked = rows.withColumn("previous", F.lag(value).over(w))
    if "name" in rows.columns:
        marked = marked.withColumn("_exempt", F.coalesce(F.lag("name").over(w).rlike(exempt), F.lit(False))).where("NOT _exempt").drop("_exempt")
    return marked.where(F.col(value) < F.col("previous"))
