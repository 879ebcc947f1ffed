"""From matched spans to overlay clips, and the package rows that declare them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import clock, text

from .alignment import align_spans
from .timeline import first_writer

#: Prefixes and names of generated manifest items.
GENERATED = r"^(audio_|html_overlay\.)|^(readaloud_style|generated_nav)$"


def spans_adapter(rows: DataFrame) -> DataFrame:
    """Match rows in one shape: other names of the files are taken over, missing fields get their defaults."""
    have = set(rows.columns)

    def pick(*names: str, default=None, kind: str = "int") -> Column:
        present = [F.col(n) for n in names if n in have]
        return F.coalesce(*present, F.lit(default)).cast(kind)

    def named(*names: str) -> Column:
        present = [F.when(F.col(n) != "", F.col(n)) for n in names if n in have]
        return F.coalesce(*present, F.lit(""))

    start = pick("window_start", default=0)
    return rows.select(
        named("json_file", "audio_file").alias("json_file"), named("html_file", "file_name").alias("html_file"), pick("score", default=0.0, kind="double").alias("score"),
        pick("html_order", default=0).alias("html_order"), start.alias("window_start"), F.coalesce(F.col("window_end").cast("int") if "window_end" in have else F.lit(None).cast("int"), start).alias("window_end"),
        pick("candidate_index", "window_index", default=0, kind="long").alias("candidate_index"), pick("span_index", default=0).alias("span_index"),
        pick("audio_start_index", default=0).alias("audio_start_index"), pick("audio_end_index", default=-1).alias("audio_end_index"),
    )


def tuple_spans(rows: DataFrame, column: str = "match") -> DataFrame:
    """Match rows given as arrays of strings: transcript, page and, if there is a third, score; `bad_tuples` has the others."""
    t = F.col(column)
    fits = rows.where(F.size(t) >= 2)
    return spans_adapter(fits.select(F.get(t, F.lit(0)).alias("json_file"), F.get(t, F.lit(1)).alias("html_file"), F.get(t, F.lit(2)).try_cast("double").alias("score")))


def bad_tuples(rows: DataFrame, column: str = "match") -> DataFrame:
    """Match tuples of no known shape, which a caller has to reject."""
    return rows.where(F.coalesce(F.size(column) < 2, F.lit(True)))


def span_order(rows: DataFrame) -> DataFrame:
    """Adds the place of each span in its transcript."""
    order = Window.partitionBy("json_file").orderBy("span_index", "html_order", "candidate_index")
    return rows.withColumn("place", F.row_number().over(order) - 1)


def first_mentions(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """(name, first) of the distinct names in the order they are first mentioned."""
    return rows.groupBy(name).agg(F.min(F.struct(*order)).alias("first"))


def clip_plan(spans: DataFrame, audio: DataFrame, segments: DataFrame, durations: DataFrame) -> DataFrame:
    """(book, html_order, seg_index, chunk, start, end, interpolated) of every overlay clip.

    Spans are aligned; gaps inside a page are filled; a chunk's clips follow each
    other without a gap from 0 to its duration; a segment that several chunks
    speak belongs to the first.  durations: book, chunk, duration.
    """
    rows = align_spans(spans, audio, segments)
    page = ["book", "chunk", "span_index", "html_order"]
    w = Window.partitionBy(*page).orderBy("seg_index")
    rows = rows.select(*page, "seg_index", "start", "end", F.lead("seg_index").over(w).alias("_next"), F.lead("start").over(w).alias("_at"))
    missing = F.col("_next") - F.col("seg_index") - 1
    holes = rows.where((missing > 0) & (F.col("_at") > F.col("end"))).select(*page, "seg_index", "end", (F.col("_at") - F.col("end")).alias("_gap"), missing.alias("_m"), F.explode(F.sequence(F.lit(1), missing)).alias("_j"))
    at = F.col("end") + F.col("_gap") / (F.col("_m") + 1) * F.col("_j")
    filled = holes.select(*page, (F.col("seg_index") + F.col("_j")).alias("seg_index"), at.alias("start"), F.lit(True).alias("interpolated"))
    points = rows.select(*page, "seg_index", "start", F.lit(False).alias("interpolated")).unionByName(filled)
    line = Window.partitionBy("book", "chunk").orderBy("span_index", "html_order", "seg_index")
    closed = points.join(durations, ["book", "chunk"]).select(
        *page, "seg_index", "interpolated",
        F.when(F.row_number().over(line) == 1, 0.0).otherwise(F.col("start")).alias("start"), F.coalesce(F.lead("start").over(line), "duration").alias("end"),
    )
    order = [F.col(c) for c in ("chunk", "span_index", "html_order")]
    return first_writer(closed, ["book", "html_order", "seg_index"], order).select("book", "html_order", "seg_index", "chunk", "start", "end", "interpolated")


def package_rows(manifest: DataFrame, pages: DataFrame, chunks: DataFrame, clips: DataFrame) -> DataFrame:
    """(book, id, href, media_type, media_overlay, duration) of a finished package's manifest.

    Items generated by an earlier run go; chunks of audio, one overlay for each
    matched page and the stylesheet come, and matched pages name their overlay.
    A row with a null id holds a book's total duration.
    manifest: book, id, href, media_type, path; pages: book, path; chunks: book,
    chunk_file; clips: book, path, start, end.
    """
    matched = pages.select("book", "path").distinct()
    kept = manifest.where(~F.col("id").rlike(GENERATED)).join(matched.withColumn("_m", F.lit(True)), ["book", "path"], "left")
    kept = kept.select("book", "id", "href", "media_type", F.when(F.col("_m"), text.overlay_id(F.col("path"))).alias("media_overlay"), F.lit(None).cast("string").alias("duration"))
    spoken = clips.groupBy("book", "path").agg(F.sum(F.greatest(F.col("end") - F.col("start"), F.lit(0.0))).alias("seconds"))
    timed = matched.join(spoken, ["book", "path"], "left").withColumn("seconds", F.coalesce("seconds", F.lit(0.0)))
    none = F.lit(None).cast("string")
    overlays = timed.select("book", text.overlay_id(F.col("path")).alias("id"), F.concat(F.lit("smil/"), text.overlay_name(F.col("path"))).alias("href"), F.lit("application/smil+xml").alias("media_type"), none.alias("media_overlay"), clock.media_duration(F.col("seconds")).alias("duration"))
    audio = chunks.select("book", F.concat(F.lit("audio_"), "chunk_file").alias("id"), F.concat(F.lit("audio/"), "chunk_file").alias("href"), clock.audio_media_type(F.col("chunk_file")).alias("media_type"), none.alias("media_overlay"), none.alias("duration"))
    books = manifest.select("book").distinct()
    style = books.select("book", F.lit("readaloud_style").alias("id"), F.lit("readaloud.css").alias("href"), F.lit("text/css").alias("media_type"), none.alias("media_overlay"), none.alias("duration"))
    total = timed.groupBy("book").agg(F.sum("seconds").alias("seconds")).select("book", none.alias("id"), none.alias("href"), none.alias("media_type"), none.alias("media_overlay"), clock.media_duration(F.col("seconds")).alias("duration"))
    return kept.unionByName(overlays).unionByName(audio).unionByName(style).unionByName(total)


def missing_entries(expected: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Expected archive entries that are not there."""
    return expected.join(present.select(*keys), keys, "left_anti")


def unused_names(used: DataFrame, known: DataFrame) -> DataFrame:
    """(kind, name) uses that nothing refers to; a kind that is not known at all has none."""
    kinds = known.select("kind").distinct()
    return used.join(kinds, "kind", "left_semi").join(known.select("kind", "name"), ["kind", "name"], "left_anti")


def has_segments(markup: Column) -> Column:
    """Whether a page carries marked segments."""
    return markup.rlike("""id=["']c[^"']*-segment[0-9]+["']""")


def all_marked(pages: DataFrame, book: str, markup: str) -> DataFrame:
    """(book, marked): whether every page of a book carries segments."""
    return pages.groupBy(book).agg(F.bool_and(has_segments(F.col(markup))).alias("marked"))
