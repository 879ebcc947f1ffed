"""Package rows: manifests, reading order, wiring, navigation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.clock import chunk_name

from .timeline import last_writer

#: Media types by kind, looked at in this order before the extension.
KINDS = (
    ("css", ("text/css",), (".css",)),
    ("js", ("application/javascript", "application/x-javascript", "text/javascript"), (".js",)),
    ("ncx", ("application/x-dtbncx+xml",), (".ncx",)),
    ("html", ("application/xhtml+xml", "text/html"), (".xhtml", ".html", ".htm")),
)
TOC_PROPERTIES, TOC_GUIDE = "nav", "toc"


def source_kind(media_type: Column, path: Column) -> Column:
    """css, js, ncx or html by media type or extension, the first kind that fits; null for others."""
    kind, low = None, F.lower(path)
    clean = F.lower(F.trim(F.coalesce(media_type, F.lit(""))))
    for name, types, ends in KINDS:
        test = clean.isin(*types)
        for end in ends:
            test = test | low.endswith(end)
        kind = F.when(test, name) if kind is None else kind.when(test, name)
    return kind


def manifest_map(items: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One item a key; a later item with the same key replaces an earlier one."""
    return last_writer(items, keys, order)


def reading_order(manifest: DataFrame, spine: DataFrame, book: str, item: str, name: str, pos: str) -> DataFrame:
    """(book, item, place, in_spine): items in spine order (first mention counts), then the rest by name."""
    first = spine.groupBy(book, item).agg(F.min(pos).alias("_pos"))
    rows = manifest.select(book, item, name).join(first, [book, item], "left")
    order = Window.partitionBy(book).orderBy(F.col("_pos").isNull(), "_pos", name, item)
    return rows.select(book, item, (F.row_number().over(order) - 1).cast("long").alias("place"), F.col("_pos").isNotNull().alias("in_spine"))


def wiring_issue(has_item: Column, has_overlay: Column, overlay_listed: Column, overlay_typed: Column, overlay_present: Column) -> Column:
    """The first broken link from a page to its overlay file, null if all hold."""
    return (
        F.when(~has_item, "no manifest item").when(~has_overlay, "no overlay").when(~overlay_listed, "overlay not listed").when(~overlay_typed, "wrong overlay type").when(~overlay_present, "overlay file missing")
    )


def processed(entries: DataFrame, archive: str, entry: str, items: DataFrame | None = None, overlay: str = "media_overlay") -> DataFrame:
    """(archive, processed): whether an archive holds overlay files or the read-aloud stylesheet, or an item of its manifest names an overlay."""
    name = F.lower(entry)
    facts = entries.groupBy(archive).agg(F.bool_or(name.rlike(r"(^|/)smil/") | name.endswith("readaloud.css")).alias("_files"))
    if items is None:
        return facts.select(archive, F.col("_files").alias("processed"))
    wired = items.groupBy(archive).agg(F.bool_or(F.coalesce(F.col(overlay), F.lit("")) != "").alias("_wired"))
    return facts.join(wired, archive, "left").select(archive, (F.col("_files") | F.coalesce("_wired", F.lit(False))).alias("processed"))


def candidate_paths(output: Column, source: Column) -> Column:
    """Where a book's package may lie, in order of preference and each once.

    A working copy (.epub3) stands for the finished package one folder up,
    itself, and the finished package beside it; a package for itself.
    """

    def family(path: Column) -> Column:
        name, folder = F.regexp_extract(path, r"([^/]*)$", 1), F.regexp_replace(path, r"/?[^/]*$", "")
        finished = F.regexp_replace(name, r"\.epub3", ".epub")
        up = F.regexp_replace(folder, r"/?[^/]*$", "")
        joined = lambda d, n: F.when(d == "", F.when(path.startswith("/"), F.concat(F.lit("/"), n)).otherwise(n)).otherwise(F.concat(d, F.lit("/"), n))
        above = F.when(folder == "", F.concat(F.lit("../"), finished)).otherwise(joined(up, finished))
        copy = F.array(above, path, joined(folder, finished))
        return F.when(path.endswith(".epub3"), copy).when(path.endswith(".epub"), F.array(path)).otherwise(F.array().cast("array<string>"))

    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(family(output), none), F.coalesce(family(source), none)))


def opened(candidates: DataFrame, group: str, rank: str, require_processed: bool = False) -> DataFrame:
    """The package of each group as `preferred` picks it; with `require_processed` a group without a processed one has null in its other columns."""
    best = preferred(candidates, group, rank)
    if not require_processed:
        return best
    kept = [F.when(F.col("processed"), F.col(c)).alias(c) for c in best.columns if c not in (group, "processed")]
    return best.select(group, "processed", *kept)


def ingested(files: DataFrame, book: str = "book", name: str = "name", audio: str | None = None) -> DataFrame:
    """(book, epub, audio, working): the first package of each book's files by name, its first other file unless the audio is named, and the working copy's name."""
    package = F.col(name).endswith(".epub")
    picked = files.groupBy(book).agg(F.min(F.when(package, F.col(name))).alias("epub"), *([F.min(audio).alias("_named")] if audio else []))
    other = files.join(picked.select(book, "epub"), book).where(F.col(name) != F.col("epub")).groupBy(book).agg(F.min(name).alias("_other"))
    heard = F.coalesce(F.col("_named"), F.col("_other")) if audio else F.col("_other")
    return picked.join(other, book, "left").select(book, "epub", heard.alias("audio"), F.regexp_replace("epub", r"\.epub", ".epub3").alias("working"))


def chunk_files(files: DataFrame, book: str, name: str, extension: str) -> DataFrame:
    """(book, name, position) of the numbered chunks among a book's files, in the order of their names."""
    order = Window.partitionBy(book).orderBy(name)
    return files.where(chunk_name(F.col(name), extension)).select(book, name, (F.row_number().over(order) - 1).alias("position"))


def transcript_files(files: DataFrame, book: str, name: str) -> DataFrame:
    """(book, name, position) of the transcripts among a book's files, in the order of their names."""
    order = Window.partitionBy(book).orderBy(name)
    return files.where(F.col(name).endswith(".json")).select(book, name, (F.row_number().over(order) - 1).alias("position"))


def recovered(books: DataFrame, files: DataFrame, documents: DataFrame) -> DataFrame:
    """(book, audio, epub, working, opf, folder, depth) of books (book, audio, epub) whose sources and working copy are all there; others are not.

    files: book, name; documents: book, name of the working copy, opf, depth.
    """
    wanted = books.select("book", "audio", "epub", F.regexp_replace("epub", r"\.epub$", ".epub3").alias("working"))
    there = files.select("book", "name").distinct()
    for column in ("audio", "epub"):
        wanted = wanted.join(there.withColumnRenamed("name", column), ["book", column], "left_semi")
    opened_copies = documents.select("book", F.col("name").alias("working"), "opf", "depth")
    folder = F.when(F.col("opf").contains("/"), F.regexp_replace("opf", "/[^/]*$", "")).otherwise(".")
    return wanted.join(opened_copies, ["book", "working"]).where("opf IS NOT NULL").select("book", "audio", "epub", "working", "opf", folder.alias("folder"), "depth")


def overlay_files(files: DataFrame, book: str, name: str) -> DataFrame:
    """(book, name, position) of the overlay documents among a book's files, in the order of their names."""
    order = Window.partitionBy(book).orderBy(name)
    return files.where(F.col(name).endswith(".smil")).select(book, name, (F.row_number().over(order) - 1).alias("position"))


def preferred(candidates: DataFrame, group: str, rank: str) -> DataFrame:
    """First processed candidate of each group, else the first one."""
    order = Window.partitionBy(group).orderBy(F.desc("processed"), F.asc(rank))
    return candidates.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def toc_like(html: Column) -> Column:
    """Whether a page declares a table of contents: a nav element, or an epub:type of toc or landmarks."""
    return html.rlike(r"(?i)<nav[\s>]") | html.rlike("""(?i)epub:type\\s*=\\s*["'][^"']*\\b(toc|landmarks)\\b""")


def overlay_totals(durations: DataFrame, key: str) -> DataFrame:
    """(key, duration) of each overlay and, with a null key, of all, in one pass."""
    return durations.rollup(key).agg(F.sum(F.greatest(F.col("seconds"), F.lit(0.0))).alias("duration"))
