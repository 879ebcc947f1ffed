"""Clock values, durations and media types as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Media types of audio files; others count as audio/mp4.
AUDIO_TYPES = {
    ".aac": "audio/aac", ".flac": "audio/flac", ".m4a": "audio/mp4", ".m4b": "audio/mp4", ".mp3": "audio/mpeg",
    ".mp4": "audio/mp4", ".oga": "audio/ogg", ".ogg": "audio/ogg", ".opus": "audio/ogg", ".wav": "audio/wav",
}
MIN_CHAPTER_S = 10.0
TOLERANCE_S = {"aac": 5.0, "copy": 1.0}
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def number(c: Column) -> Column:
    """A decimal number as written, else null."""
    c = F.trim(c)
    return F.when(c.rlike(_NUMBER), c.try_cast("double"))


def clip_seconds(clock: Column) -> Column:
    """Seconds of a clip clock, which may end in one "s"; null if it isn't a number."""
    return number(F.regexp_replace(F.trim(clock), "s$", ""))


def lenient_seconds(clock: Column) -> Column:
    """Seconds of a clock with any number of "s" at its end; null if it isn't a number."""
    return number(F.regexp_replace(F.trim(clock), "s+$", ""))


def media_duration(seconds: Column) -> Column:
    """H:MM:SS.mmm, milliseconds rounded half to even, never negative."""
    ms = F.greatest(F.bround(seconds * 1000).cast("long"), F.lit(0).cast("long"))
    h = F.floor(ms / 3600000)
    m = F.floor((ms % 3600000) / 60000)
    s = F.floor((ms % 60000) / 1000)
    r = ms % 1000
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(h.cast("string"), F.lit(":"), two(m), F.lit(":"), two(s), F.lit("."), F.lpad(r.cast("string"), 3, "0"))


def expected_duration(start: Column, end: Column) -> Column:
    return F.greatest(end - start, F.lit(0.0))


def split_tolerance(codec: Column) -> Column:
    return F.when(F.lower(codec) == "aac", TOLERANCE_S["aac"]).otherwise(TOLERANCE_S["copy"])


def audio_media_type(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in AUDIO_TYPES.items() for x in kv])
    return F.coalesce(table[F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))], F.lit("audio/mp4"))


def chunk_name(path: Column, extension: str) -> Column:
    """Whether a file name is a numbered chunk with this extension."""
    return path.rlike(r"^[0-9]{3,}\.[^.]+$") & path.endswith(extension)
