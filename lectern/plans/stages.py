"""From source packages to finished ones: every stage is a function of tables, for any number of books at once.

    prepare -> split -> transcribe -> match -> segment -> smil -> package -> validate

Tables are keyed by book.  What cannot run here, cutting and recognising audio,
comes in as tables or as one function of the chunks that lack a transcript.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import audits, lineage, markup, matching, overlays, packages, references, timeline, windows
from lectern.sources import archives, navigation, packaging, smil

_ITEMS = "book string, kind string, pos int, id string, href string, media_type string, properties string, media_overlay string, path string"


def _package_items(documents: DataFrame) -> DataFrame:
    """Manifest items and spine references of package documents (book, opf, xml); one that does not parse has none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _ITEMS.split(", ")]
        for f in frames:
            rows: list[tuple] = []
            for book, opf, xml in zip(f["book"], f["opf"], f["xml"], strict=True):
                folder = opf.rpartition("/")[0] or "."
                try:
                    rows += [(book, "item", *r) for r in navigation.manifest_rows(xml, folder)]
                    rows += [(book, "spine", pos, ref, None, None, None, None, None) for pos, ref in navigation.spine_rows(xml)]
                except ET.ParseError:
                    continue
            yield pd.DataFrame(rows, columns=names)

    return documents.select("book", "opf", "xml").mapInPandas(run, _ITEMS)


def prepare(members: DataFrame) -> dict[str, DataFrame]:
    """documents (book, opf, xml), manifest and spine rows, and pages (book, html_order, path, html) in reading order, of members (book, pos, entry, content)."""
    rows = members.withColumnRenamed("book", "archive")
    documents = archives.package_document(rows).select(F.col("archive").alias("book"), "opf")
    documents = documents.join(members.select("book", F.col("entry").alias("opf"), archives.member_text(F.col("content")).alias("xml")), ["book", "opf"])
    items = _package_items(documents)
    manifest, spine = items.where("kind = 'item'").drop("kind"), items.where("kind = 'spine'").select("book", "pos", "id")
    html = manifest.where(packages.source_kind(F.col("media_type"), F.col("path")) == "html")
    order = packages.reading_order(html, spine, "book", "id", "path", "pos").withColumnRenamed("place", "html_order")
    paths = html.select("book", "id", "path").dropDuplicates(["book", "id"])
    content = members.select("book", F.col("entry").alias("path"), archives.member_text(F.col("content")).alias("html"))
    pages = order.join(paths, ["book", "id"]).join(content, ["book", "path"]).select("book", "html_order", "path", "html")
    return {"documents": documents, "manifest": manifest, "spine": spine, "pages": pages}


def split(settings: DataFrame, durations: DataFrame, chapters: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """(book, chunk, start, end, name, stamp, action) of every planned chunk.

    Books with chapters (book, start, end) are cut there, short ones merged;
    others every `chunk_seconds` of their duration (book, seconds).  `done`
    (book, name, stamp) are the chunks there are: one cut under another plan is
    cut again.  settings: book, settings (a struct with the codec's fields and
    the audio extension).
    """
    cut = timeline.merge_chapters(chapters, "book").select("book", F.col("id").alias("chunk"), "start", "end")
    rest = durations.join(chapters.select("book").distinct(), "book", "left_anti").join(settings, "book").withColumn("size", F.col("settings.chunk_seconds"))
    count = F.ceil(F.col("seconds") / F.col("size")).cast("int")
    fixed = rest.where("seconds > 0").select("book", "seconds", F.col("size").cast("double").alias("size"), F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk"))
    fixed = fixed.select("book", "chunk", (F.col("chunk") * F.col("size")).alias("start"), F.least((F.col("chunk") + 1) * F.col("size"), "seconds").alias("end"))
    plan = cut.unionByName(fixed).join(settings, "book")
    plan = plan.withColumn("name", F.concat(F.lpad((F.col("chunk") + 1).cast("string"), 3, "0"), F.col("settings.audio_extension")))
    plan = plan.withColumn("stamp", lineage.chunk_stamp(F.col("start"), F.col("end")))
    if done is None:
        return plan.select("book", "chunk", "start", "end", "name", "stamp", F.lit("create").alias("action"))
    have = done.select("book", "name", F.col("stamp").alias("_have"), F.lit(True).alias("_there"))
    action = F.when(F.col("_there").isNull(), "create").when(lineage.same_stamp("stamp", "_have"), "reuse").otherwise("regenerate")
    return plan.join(have, ["book", "name"], "left").select("book", "chunk", "start", "end", "name", "stamp", action.alias("action"))


def transcribe(plan: DataFrame, settings: DataFrame, transcripts: DataFrame, words: DataFrame, recognise: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Words (book, chunk, idx, word, start, end) of every chunk: those of transcripts (book, chunk, stamp) that still fit, and `recognise` of the rest."""
    wanted = plan.select("book", "chunk", "name", "start", "end", "stamp").join(settings, "book").withColumn("wanted", lineage.transcript_stamp(F.col("stamp")))
    have = transcripts.select("book", "chunk", F.col("stamp").alias("_have"))
    rows = wanted.join(have, ["book", "chunk"], "left").withColumn("fits", lineage.transcript_complete(F.col("_have").isNotNull(), F.col("_have"), F.col("wanted")))
    kept = words.join(rows.where("fits").select("book", "chunk"), ["book", "chunk"], "left_semi")
    return kept.unionByName(recognise(rows.where("NOT fits").select("book", "chunk", "name", "start", "end")))


def audio_tokens(words: DataFrame) -> DataFrame:
    """(book, chunk, idx, token, word, start, end): timed words split into tokens that keep their times."""
    timed = words.where("start IS NOT NULL AND end IS NOT NULL").select("book", "chunk", F.col("idx").alias("_word"), "word", "start", "end", F.posexplode(T.match_tokens(F.col("word"))).alias("_part", "token"))
    order = Window.partitionBy("book", "chunk").orderBy("_word", "_part")
    return timed.select("book", "chunk", (F.row_number().over(order) - 1).cast("int").alias("idx"), "token", "word", "start", "end")


def match(pages: DataFrame, tokens: DataFrame) -> DataFrame:
    """Spans of every chunk's transcript in the pages of its book, and the reason of every one without."""
    keyed = pages.select(F.struct("book", "html_order").alias("page"), "html").withColumn("key", F.to_json("page"))
    texts = markup.page_texts(keyed, "key")
    place = F.from_json("key", "book string, html_order long")
    texts = texts.select(place.alias("p"), "text").select("p.book", "p.html_order", "text")
    spoken = tokens.groupBy("book", "chunk").agg(F.array_sort(F.collect_list(F.struct("idx", "token"))).alias("t"))
    transcripts = spoken.select("book", "chunk", F.array_join(F.transform("t", lambda x: x.token), " ").alias("text"))
    return matching.match_books(texts, transcripts)


def segment(pages: DataFrame, spans: DataFrame, known: markup.Known = references.own_names) -> dict[str, DataFrame]:
    """marked (book, html_order, path, html, error): each matched page once, with its segments marked; segments (book, html_order, seg_index, seg_id, tokens) read back from it."""
    matched = spans.where("html_order IS NOT NULL").select("book", "html_order").distinct()
    rows = pages.join(matched, ["book", "html_order"]).withColumn("prefix", T.segment_prefix(F.col("path")))
    depth = F.size(F.split("path", "/")) - 1
    rows = rows.withColumn("stylesheet", F.concat(F.repeat(F.lit("../"), depth), F.lit(packaging.STYLESHEET)))
    marked = markup.mark_documents(rows, ["book", "html_order", "path"], "prefix", known, "stylesheet")
    found = markup.read_segments(marked, ["book", "html_order"])
    return {"marked": marked, "segments": found.select("book", "html_order", "seg_index", "seg_id", T.text_tokens(F.col("text")).alias("tokens"))}


def synchronise(spans: DataFrame, tokens: DataFrame, segments: DataFrame, pages: DataFrame, plan: DataFrame) -> dict[str, DataFrame]:
    """clips (book, path, seg_index, seg_id, chunk, start, end, …) and overlays (book, path, entry, xml) of the matched pages."""
    placed = spans.where("html_order IS NOT NULL").select("book", "chunk", "span_index", "html_order", "window_start", "window_end", "audio_start", "audio_end")
    lengths = plan.select("book", F.col("chunk").cast("long").alias("chunk"), (F.col("end") - F.col("start")).alias("duration"))
    clips = overlays.clip_plan(placed, tokens.withColumn("chunk", F.col("chunk").cast("long")), segments, lengths)
    names = segments.select("book", "html_order", "seg_index", "seg_id")
    files = plan.select("book", F.col("chunk").cast("long").alias("chunk"), F.col("name").alias("audio_file"))
    clips = clips.join(names, ["book", "html_order", "seg_index"]).join(pages.select("book", "html_order", "path"), ["book", "html_order"]).join(files, ["book", "chunk"])
    rows = clips.select(F.struct("book", "path").alias("k"), "seg_index", "seg_id", F.concat(F.lit("../"), "path").alias("href"), F.concat(F.lit("../audio/"), "audio_file").alias("audio_file"), "start", "end")
    drawn = smil.render_overlays(rows, "k", "href", "seg_index").select("k.book", "k.path", F.concat(F.lit("smil/"), T.overlay_name(F.col("k.path"))).alias("entry"), "xml")
    return {"clips": clips, "overlays": drawn}


def package(prepared: dict[str, DataFrame], marked: DataFrame, clips: DataFrame, drawn: DataFrame, plan: DataFrame, members: DataFrame, audio: DataFrame, folder: str) -> DataFrame:
    """(archive, path, size) of the finished packages in a folder: marked pages, overlays, audio (book, name, content), stylesheet and the new package document."""
    rows = overlays.package_rows(prepared["manifest"], drawn.select("book", "path"), plan.select("book", F.col("name").alias("chunk_file")), clips)
    said = rows.groupBy("book").agg(F.collect_list(F.struct("id", "href", "media_type", "media_overlay", "duration")).alias("rows"))
    ncx = members.where(F.lower("entry").endswith(".ncx")).groupBy("book").agg(F.map_from_entries(F.collect_list(F.struct("entry", archives.member_text(F.col("content")).alias("xml")))).alias("ncx"))
    documents = prepared["documents"].join(said, "book").join(ncx, "book", "left")

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out: list[tuple] = []
            for r in f.itertuples(index=False):
                text, extra = packaging.finish_document(r.xml, r.opf, [dict(x) if isinstance(x, dict) else x.asDict() for x in r.rows], dict(r.ncx) if r.ncx is not None else {})
                out += [(r.book, entry, content.encode()) for entry, content in {r.opf: text, **extra}.items()]
            yield pd.DataFrame(out, columns=["archive", "entry", "content"])

    kind = "archive string, entry string, content binary"
    changes = documents.select("book", "opf", "xml", "rows", "ncx").mapInPandas(finish, kind)
    binary = lambda c: F.encode(F.col(c), "UTF-8")
    parts = [
        marked.select(F.col("book").alias("archive"), F.col("path").alias("entry"), binary("html").alias("content")),
        drawn.select(F.col("book").alias("archive"), "entry", binary("xml").alias("content")),
        audio.select(F.col("book").alias("archive"), F.concat(F.lit("audio/"), "name").alias("entry"), "content"),
        prepared["documents"].select(F.col("book").alias("archive"), F.concat(F.regexp_replace("opf", "[^/]*$", ""), F.lit(packaging.STYLESHEET)).alias("entry"), F.lit(packaging.STYLE.encode()).alias("content")),
    ]
    for part in parts:
        changes = changes.unionByName(part)
    return packaging.write_archives(packaging.merged_members(members.withColumnRenamed("book", "archive"), changes), folder)


def validate(pages: DataFrame, spans: DataFrame, clips: DataFrame, drawn: DataFrame, contents: DataFrame | None = None) -> DataFrame:
    """Checks over all books, one row each and a total: clips, silent overlays, order of matches, pages that no transcript reached."""
    raw = clips.select("book", "path", "audio_file", F.col("start").cast("string").alias("begin_raw"), F.col("end").cast("string").alias("end_raw"))
    parsed = audits.parse_clips(raw).withColumn("overlay", F.struct("book", "path"))
    silent = audits.silent_overlays(drawn.select(F.struct("book", "path").alias("overlay")), parsed, "overlay")
    placed = spans.where("html_order IS NOT NULL AND span_index = 0")
    jumps = timeline.backward_jumps(placed.select("book", "chunk", "html_order"), "book", "chunk", "html_order")
    checks = [("invalid_clips", parsed.where("NOT valid"), False), ("overlay_without_audio", silent, False), ("backward_jumps", jumps, False), ("unmatched_transcripts", spans.where("html_order IS NULL"), False)]
    tokens = windows.tokenised(pages.withColumn("key", F.struct("book", "html_order")).select("key", "html"), "key", "html").select("key", "n_tokens")
    inside = placed.groupBy("book").agg(F.min("html_order").alias("lo"), F.max("html_order").alias("hi"))
    missed = tokens.select("key.book", "key.html_order", "n_tokens").join(inside, "book").where("html_order BETWEEN lo AND hi").join(spans.select("book", "html_order"), ["book", "html_order"], "left_anti").where(F.col("n_tokens") >= audits.SPINE_TOKENS)
    missed = missed if contents is None else missed.join(contents, ["book", "html_order"], "left_anti")
    return audits.roll_up([*checks, ("unmatched_spine", missed, False)])


def run(members: DataFrame, settings: DataFrame, durations: DataFrame, chapters: DataFrame, audio: DataFrame, words: DataFrame, folder: str, keep: Callable[[DataFrame, str], DataFrame]) -> dict[str, DataFrame]:
    """All stages over source packages and their words; finished packages go to the folder.

    `keep` writes a stage's table and reads it back (see `streaming.arrivals` and
    `spark.checkpoint.dir` for places that all machines share), so that no stage
    runs twice.
    """
    prepared = {n: keep(f, n) for n, f in prepare(members).items()}
    plan = keep(split(settings, durations, chapters), "plan")
    tokens = keep(audio_tokens(words), "tokens")
    spans = keep(match(prepared["pages"], tokens), "spans")
    marked = {n: keep(f, n) for n, f in segment(prepared["pages"], spans).items()}
    timed = {n: keep(f, n) for n, f in synchronise(spans, tokens, marked["segments"], prepared["pages"], plan).items()}
    written = keep(package(prepared, marked["marked"], timed["clips"], timed["overlays"], plan, members, audio, folder), "written")
    named = prepared["pages"].join(navigation.contents_pages(prepared["documents"]), ["book", "path"], "left_semi")
    contents = named.unionByName(prepared["pages"].where(packages.toc_like(F.col("html")))).select("book", "html_order").distinct()
    checks = keep(validate(prepared["pages"], spans, timed["clips"], timed["overlays"], contents), "checks")
    return {**prepared, "plan": plan, "tokens": tokens, "spans": spans, **marked, **timed, "written": written, "checks": checks}
