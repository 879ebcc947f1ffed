"""Read-only checks over clips, transcripts, overlays and manifests.

Each check returns its findings as rows; `roll_up` turns checks into one row
each and a total.  A check without input passes as skipped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.clock import clip_seconds, lenient_seconds
from lectern.functions.shared import keep

SUBSTANTIAL_S, SUBSTANTIAL_WORDS = 180.0, 300
COVERAGE = 0.60
OVERLAP_S = 0.5
SPINE_TOKENS = 80


def clip_problem(src: Column, begin: Column, end: Column, begin_raw: Column, end_raw: Column) -> Column:
    """First thing wrong with a clip, null if nothing is."""
    return (
        F.when(F.coalesce(src, F.lit("")) == "", "src").when(begin.isNull(), "begin").when(end.isNull(), "end").when(end <= begin, "order")
    )


def parse_clips(raw: DataFrame) -> DataFrame:
    """Clip rows (…, begin_raw, end_raw) with seconds, `problem` and `valid`."""
    rows = raw.withColumn("begin", clip_seconds(F.col("begin_raw"))).withColumn("end", clip_seconds(F.col("end_raw")))
    rows = rows.withColumn("problem", clip_problem(F.col("audio_file"), F.col("begin"), F.col("end"), F.col("begin_raw"), F.col("end_raw")))
    return rows.withColumn("valid", F.col("problem").isNull())


def inventory(audio: DataFrame, words: DataFrame, key: str, seconds: str) -> DataFrame:
    """(key, duration, word_count) of every audio; without words both are 0."""
    counted = words.groupBy(key).agg(F.sum(seconds).alias("duration"), F.count("*").alias("word_count"))
    rows = audio.select(key).join(counted, key, "left")
    return rows.select(key, F.coalesce("duration", F.lit(0.0)).alias("duration"), F.coalesce("word_count", F.lit(0)).alias("word_count"))


def substantial(rows: DataFrame, seconds: float = SUBSTANTIAL_S, words: int = SUBSTANTIAL_WORDS) -> DataFrame:
    return rows.where((F.col("duration") >= seconds) | (F.col("word_count") >= words))


def inner_rows(rows: DataFrame, group: str, order: str) -> DataFrame:
    """Rows that are neither the first nor the last of their group."""
    up, down = Window.partitionBy(group).orderBy(order), Window.partitionBy(group).orderBy(F.desc(order))
    return rows.withColumn("_a", F.row_number().over(up)).withColumn("_z", F.row_number().over(down)).where("_a > 1 AND _z > 1").drop("_a", "_z")


def coverage(clips: DataFrame, durations: DataFrame, key: str) -> DataFrame:
    """(key, clip_count, covered, duration, ratio); overlapping clips count twice, a zero duration gives ratio 0."""
    totals = clips.groupBy(key).agg(F.count("*").alias("clip_count"), F.sum(F.greatest(F.col("end") - F.col("begin"), F.lit(0.0))).alias("covered"))
    rows = totals.join(durations, key)
    return rows.withColumn("ratio", F.when(F.col("duration") > 0, F.col("covered") / F.col("duration")).otherwise(F.lit(0.0)))


def clip_counts(overlays: DataFrame, clips: DataFrame, key: str) -> DataFrame:
    """(key, clip_count, covered) of the valid clips of every overlay; one without any has 0."""
    valid = clips.where("valid").groupBy(key).agg(F.count("*").alias("clip_count"), F.sum(F.col("end") - F.col("begin")).alias("covered"))
    return overlays.select(key).distinct().join(valid, key, "left").select(key, F.coalesce("clip_count", F.lit(0)).alias("clip_count"), F.coalesce("covered", F.lit(0.0)).alias("covered"))


def silent_overlays(overlays: DataFrame, clips: DataFrame, key: str) -> DataFrame:
    """Overlays without a valid clip."""
    return clip_counts(overlays, clips, key).where("clip_count = 0").select(key)


def overlay_seconds(raw: DataFrame, key: str) -> DataFrame:
    """(key, seconds) under an overlay's clips by the lenient clock: a missing clock is 0, one that is no number leaves its clip out, a negative length counts 0."""
    begin, end = (lenient_seconds(F.coalesce(c, F.lit("0s"))) for c in (F.col("begin_raw"), F.col("end_raw")))
    return raw.groupBy(key).agg(F.coalesce(F.sum(F.greatest(end - begin, begin - begin)), F.lit(0.0)).alias("seconds"))


def ordered(findings: DataFrame, *order: str) -> DataFrame:
    """Findings with their position in the order that a report lists them in.

    Nulls come last.  Positions are counted over ranges of the order, so no task
    holds all findings.  Ranges are drawn from samples and joined by size, so two
    runs of them differ: they are written once, and both sizes and rows are read
    from there.
    """
    if not order:
        return findings.withColumn("position", F.lit(None).cast("long"))
    by = [F.asc_nulls_last(c) for c in order]
    ranged = findings.withColumn("_id", F.monotonically_increasing_id()).repartitionByRange(*by, "_id").sortWithinPartitions(*by, "_id")
    at = F.monotonically_increasing_id()
    ranged = keep(ranged.withColumn("_part", F.shiftright(at, 33)).withColumn("_inside", at.bitwiseAND(F.lit((1 << 33) - 1))), "ordered-findings")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.select("_part", before.alias("_before"))  # one row a partition
    return ranged.join(F.broadcast(shifts), "_part").withColumn("position", F.col("_before") + F.col("_inside")).drop("_id", "_part", "_inside", "_before")


def covered_union(clips: DataFrame, key: str) -> DataFrame:
    """(key, covered_once): time under at least one clip."""
    w = Window.partitionBy(key).orderBy("begin", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.col("end") - F.greatest(F.col("begin"), F.coalesce(reach, F.col("begin"))), F.lit(0.0))
    return clips.withColumn("_new", new).groupBy(key).agg(F.sum("_new").alias("covered_once"))


def duplicate_clips(clips: DataFrame, keys: list[Column]) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return clips.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def overlapping_clips(clips: DataFrame, key: str, clip_id: str, cell: float, least: float = OVERLAP_S) -> DataFrame:
    """(key, a, b, overlap): pairs of clips of one audio that overlap by at least `least` seconds.

    Clips equal to three decimals are duplicates, not overlaps.  Time is cut into
    cells; a clip joins in each cell it touches, and a pair is kept in the first
    cell both touch, so a long audio is spread over its cells.
    """
    cells = F.sequence(F.floor(F.col("begin") / cell), F.floor(F.col("end") / cell))
    left = clips.select(key, F.col(clip_id).alias("a"), F.col("begin").alias("b1"), F.col("end").alias("e1"), F.explode(cells).alias("cell"))
    right = clips.select(key, F.col(clip_id).alias("b"), F.col("begin").alias("b2"), F.col("end").alias("e2"), F.explode(cells).alias("cell"))
    ordered = (F.col("b1") < F.col("b2")) | ((F.col("b1") == F.col("b2")) & ((F.col("e1") < F.col("e2")) | ((F.col("e1") == F.col("e2")) & (F.col("a") < F.col("b")))))
    met = left.join(right, [key, "cell"]).where(ordered & (F.col("b2") < F.col("e1")))
    first = F.floor(F.greatest("b1", "b2") / cell) == F.col("cell")
    same = (F.round("b1", 3) == F.round("b2", 3)) & (F.round("e1", 3) == F.round("e2", 3))
    overlap = F.least("e1", "e2") - F.greatest("b1", "b2")
    return met.where(first & ~same).select(key, "a", "b", overlap.alias("overlap")).where(F.col("overlap") >= least)


def transcript_states(audio: DataFrame, transcripts: DataFrame, key: str, readable: Column, words: Column) -> DataFrame:
    """(key, state): missing, unreadable, empty or ok."""
    rows = audio.select(key).join(transcripts.withColumn("_there", F.lit(True)), key, "left")
    state = F.when(F.col("_there").isNull(), "missing").when(~F.coalesce(readable, F.lit(False)), "unreadable").when(F.coalesce(words, F.lit(0)) == 0, "empty").otherwise("ok")
    return rows.select(key, state.alias("state"))


def unmatched_between(pages: DataFrame, matched: DataFrame, key: str, least_tokens: int = SPINE_TOKENS, contents: DataFrame | None = None) -> DataFrame:
    """Pages with enough tokens, no match, and a place between the first and the last match; the keys of contents pages are left out."""
    ends = matched.agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"))
    inside = pages.join(F.broadcast(ends), F.col(key).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")
    if contents is not None:
        inside = inside.join(contents.select(key).distinct(), key, "left_anti")
    return inside.join(matched.select(key).distinct(), key, "left_anti").where(F.col("n_tokens") >= least_tokens)


def roll_up(checks: list[tuple[str, DataFrame, bool]]) -> DataFrame:
    """(name, ok, skipped, findings) of each (name, findings, skipped), and a row "total" with the number of failed ones."""
    rows = [f.agg(F.count("*").alias("findings")).select(F.lit(n).alias("name"), (F.lit(s) | (F.col("findings") == 0)).alias("ok"), F.lit(s).alias("skipped"), "findings") for n, f, s in checks]
    all_rows = reduce(DataFrame.unionByName, rows)
    total = all_rows.agg(F.bool_and("ok").alias("ok"), F.lit(False).alias("skipped"), F.count_if(~F.col("ok")).alias("findings")).select(F.lit("total").alias("name"), "ok", "skipped", "findings")
    return all_rows.unionByName(total)
