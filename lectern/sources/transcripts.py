"""Word transcripts in either JSON layout as timed token rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import match_tokens

_WORD = "struct<word:string,start:double,end:double>"
SCHEMA = f"word_segments array<{_WORD}>, segments array<struct<words:array<{_WORD}>>>"


def parse_transcripts(rows: DataFrame, key: str, json: str) -> DataFrame:
    """(key, word_segments, segments) of JSON texts; a broken text gives null in both."""
    return rows.select(key, F.from_json(json, SCHEMA).alias("t")).select(key, "t.word_segments", "t.segments")


def audio_tokens(transcripts: DataFrame, key: str) -> DataFrame:
    """(key, idx, token, word, start, end) in spoken order.

    Words come from `word_segments`, or from the segments if that is null (an
    empty list stays empty).  Words without both times are left out; a word split
    at a dash passes its times to each part.
    """
    words = F.coalesce("word_segments", F.flatten(F.transform("segments", lambda s: F.coalesce(s.words, F.array().cast(f"array<{_WORD}>")))))
    timed = F.filter(words, lambda w: w.start.isNotNull() & w.end.isNotNull())
    tokens = F.flatten(F.transform(timed, lambda w: F.transform(match_tokens(w.word), lambda t: F.struct(t.alias("token"), w.word.alias("word"), w.start.alias("start"), w.end.alias("end")))))
    rows = transcripts.select(key, F.posexplode(tokens).alias("idx", "t"))
    return rows.select(key, "idx", "t.token", "t.word", "t.start", "t.end")


def read_transcripts(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Transcript files (path, word_segments, segments); a broken file raises, or with strict=False gives nulls."""
    reader = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "FAILFAST" if strict else "PERMISSIVE")
    return reader.json(path).withColumn("path", F.col("_metadata.file_path"))


def duration_or_fallback(stream: str = "stream_s", container: str = "container_s", last_end: str = "last_end"):
    """First positive of stream and container duration, else a second after the last word; null without any."""
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    return F.coalesce(positive(stream), positive(container), F.col(last_end) + 1.0)
