"""Whether what the stages of a run left behind still fits, for all books at once.

Every verdict is (book, valid), one row a book of `books`; a book that nothing
is known of is not valid.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import STAGES
from .overlays import has_segments


def _verdict(books: DataFrame, found: DataFrame) -> DataFrame:
    return books.select("book").distinct().join(found, "book", "left").select("book", F.coalesce("valid", F.lit(False)).alias("valid"))


def all_hold(books: DataFrame, rows: DataFrame, holds: Column) -> DataFrame:
    """Books with rows, all of which hold: complete chunks of a plan, complete transcripts of its chunks."""
    return _verdict(books, rows.groupBy("book").agg(F.bool_and(F.coalesce(holds, F.lit(False))).alias("valid")))


def all_present(books: DataFrame, wanted: DataFrame, present: DataFrame, *keys: str) -> DataFrame:
    """Books that want something and have all of it: source files, overlay files, package members."""
    there = present.select("book", *keys).distinct().withColumn("_there", F.lit(True))
    return all_hold(books, wanted.select("book", *keys).distinct().join(there, ["book", *keys], "left"), F.col("_there"))


def matches_valid(books: DataFrame, matches: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Books whose matches (book, json_file) name exactly the transcripts (book, json_file) there are."""
    left, right = (x.select("book", "json_file").distinct().withColumn(n, F.lit(True)) for x, n in ((matches, "_m"), (transcripts, "_t")))
    both = left.join(right, ["book", "json_file"], "full_outer").groupBy("book")
    return _verdict(books, both.agg((F.bool_and(F.col("_m").isNotNull() & F.col("_t").isNotNull())).alias("valid")))


def segments_valid(books: DataFrame, matched: DataFrame, working: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Books of which one copy, the working one or the snapshot, has segments in every matched page (book, path, html)."""
    out = []
    for copy in (working, snapshot):
        pages = matched.select("book", "path").distinct().join(copy.select("book", "path", "html"), ["book", "path"], "left")
        out.append(all_hold(books, pages, has_segments(F.col("html"))))
    return out[0].join(out[1].withColumnRenamed("valid", "other"), "book").select("book", (F.col("valid") | F.col("other")).alias("valid"))


def package_valid(books: DataFrame, chunks: DataFrame, overlays: DataFrame, entries: DataFrame, processed: DataFrame) -> DataFrame:
    """Books whose finished package (book, entry) is processed (book, processed) and holds every chunk and overlay (book, name)."""
    wanted = chunks.select("book", F.concat(F.lit("audio/"), "name").alias("entry")).unionByName(overlays.select("book", F.concat(F.lit("smil/"), "name").alias("entry")))
    full = all_present(books, wanted, entries, "entry").join(processed.select("book", "processed"), "book", "left")
    return full.select("book", (F.col("valid") & F.coalesce("processed", F.lit(False))).alias("valid"))


def validation_valid(books: DataFrame, results: DataFrame, packages: DataFrame) -> DataFrame:
    """Books whose stored validation saw the bytes (book, fingerprint) that the package has now."""
    rows = packages.select("book", F.col("fingerprint").alias("_now")).join(results.select("book", "fingerprint"), "book", "left")
    return all_hold(books, rows, F.col("fingerprint") == F.col("_now"))


def reconcile(verdicts: dict[str, DataFrame]) -> DataFrame:
    """(book, stage, position, valid, action) of every stage: those before the first invalid one are reused, it and the rest run."""
    rows = reduce(DataFrame.unionByName, (v.select("book", F.lit(n).alias("stage"), F.lit(STAGES.index(n)).alias("position"), "valid") for n, v in verdicts.items()))
    first = rows.where("NOT valid").groupBy("book").agg(F.min("position").alias("_first"))
    action = F.when(F.col("_first").isNull() | (F.col("position") < F.col("_first")), "reuse").otherwise("run")
    return rows.join(first, "book", "left").select("book", "stage", "position", "valid", action.alias("action"))
