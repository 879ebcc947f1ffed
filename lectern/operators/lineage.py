"""Compatibility stamps, work lists and stage state: recompute only what changed."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.clock import expected_duration, split_tolerance

STAGES = ("prepare", "split", "transcribe", "match", "segment", "smil", "package", "validate")


def same_stamp(a: str, b: str) -> Column:
    """Whether two stamp structs agree field by field; a missing stamp agrees with nothing."""
    return F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(a).eqNullSafe(F.col(b))


#: The settings that a cut chunk depends on, and those of a transcript.
CHUNK_SETTINGS = ("audio_codec", "audio_bitrate", "audio_sample_rate", "audio_channels", "chunk_seconds")
TRANSCRIPT_SETTINGS = ("backend", "model", "language")


def chunk_stamp(start: Column, end: Column, settings: str = "settings") -> Column:
    """What a chunk was cut under: kind, codec settings and its planned times as written; no codec is "copy"."""
    fields = [F.coalesce(F.col(f"{settings}.{n}"), F.lit("copy")).alias(n) if n == "audio_codec" else F.col(f"{settings}.{n}").alias(n) for n in CHUNK_SETTINGS]
    return F.struct(F.lit("audio_chunk").alias("kind"), *fields, start.cast("string").alias("start_time"), end.cast("string").alias("end_time"))


def transcript_stamp(parent: Column, settings: str = "settings") -> Column:
    """What a transcript was made under, with the stamp of its chunk inside, so that cutting anew makes it stale."""
    return F.struct(F.lit("transcript").alias("kind"), *(F.col(f"{settings}.{n}").alias(n) for n in TRANSCRIPT_SETTINGS), parent.alias("chunk_stamp"))


def transcript_complete(exists: Column, stamp: Column, expected: Column) -> Column:
    """Whether a transcript is there and was made under the current settings from the current chunk."""
    return F.coalesce(exists, F.lit(False)) & stamp.isNotNull() & stamp.eqNullSafe(expected)


def stamp_path(artifact: Column) -> Column:
    """Where an artifact's stamp lies."""
    return F.concat(artifact, F.lit(".meta"))


def book_path(folder: Column, path: Column) -> Column:
    """A path of a book: itself if absolute, else inside the book's folder."""
    return F.when(path.startswith("/"), path).otherwise(F.concat_ws("/", F.regexp_replace(folder, "/+$", ""), path))


def chunk_complete(exists: Column, stamped: Column, start: Column, end: Column, actual: Column, codec: Column) -> Column:
    """Whether a cut chunk is there, was cut for this plan, and has the planned length within its codec's tolerance."""
    expected = expected_duration(start, end)
    return exists & stamped & (expected > 0) & F.coalesce(F.abs(actual - expected) <= split_tolerance(codec), F.lit(False))


def work_list(wanted: DataFrame, done: DataFrame, key: str, stamp: str = "stamp") -> DataFrame:
    """(key, action) for each wanted row: reuse, regenerate (stale or unstamped) or create."""
    rows = wanted.select(key, F.col(stamp).alias("_want")).join(done.select(key, F.col(stamp).alias("_have"), F.lit(True).alias("_there")), key, "left")
    action = F.when(F.col("_there").isNull(), "create").when(same_stamp("_want", "_have"), "reuse").otherwise("regenerate")
    return rows.select(key, action.alias("action"))


def same_names(a: DataFrame, b: DataFrame) -> bool:
    """Whether two one-column frames hold the same names the same number of times."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def content_fingerprint(content: Column) -> Column:
    raw = content.cast("binary")
    return F.struct(F.length(raw).cast("long").alias("size"), F.sha2(raw, 256).alias("sha256"))


def run_stages(state: dict, stages: dict[str, tuple[Callable[[dict], bool], Callable[[dict], dict]]], save: Callable[[dict], None], clock: Callable[[], str]) -> dict:
    """Run (valid, execute) pairs in order; a stage whose output is still valid is only marked.

    State is saved after each change, so a run that stops resumes at its stage; a
    failure is recorded and raised.
    """
    for name, (valid, execute) in stages.items():
        entry = state.setdefault("stages", {}).setdefault(name, {"status": "pending"})
        try:
            if valid(state):
                entry |= {"status": "complete", "reused": True, "updated_at": clock()}
            else:
                entry |= {"status": "running", "updated_at": clock()}
                save(state)
                entry |= {"result": execute(state), "status": "complete", "reused": False, "updated_at": clock()}
        except Exception as error:
            entry |= {"status": "failed", "error": f"{type(error).__name__}: {error}", "updated_at": clock()}
            save(state)
            raise
        save(state)
    return state


def reason_counts(rows: DataFrame, reason: str = "reason") -> DataFrame:
    return rows.groupBy(reason).agg(F.count("*").alias("n"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
