"""Positional alignment of two token sequences as rows of equal runs."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def equal_runs(text: list[str], audio: list[str]) -> list[tuple[int, int, int]]:
    """(text start, audio start, length) of the matching blocks; the text comes first."""
    blocks = difflib.SequenceMatcher(None, text, audio, autojunk=False).get_matching_blocks()
    return [(b.a, b.b, b.size) for b in blocks if b.size]


def align(pairs: DataFrame, key: str) -> DataFrame:
    """(key, text_start, audio_start, length) for rows (key, text_tokens, audio_tokens); a pair without runs gives one of length 0."""
    kind = pairs.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, *r) for k, a, b in frame.itertuples(index=False) for r in (equal_runs(list(a), list(b)) or [(0, 0, 0)])]
            yield pd.DataFrame(rows, columns=[key, "text_start", "audio_start", "length"])

    return pairs.select(key, "text_tokens", "audio_tokens").mapInPandas(run, f"{key} {kind}, text_start int, audio_start int, length int")


def search_ranges(n_text: int, n_audio: int, start: int, end: int, first_span: bool) -> list[tuple[int, int]]:
    """Token ranges of a page to align with, from the hinted one to the whole page.

    The first span starts 250 tokens before its window and reaches 400 past it or
    1,200 past the audio's length; a later span starts with the page and reaches
    200 past its window or 600 past the audio's length.
    """
    if first_span:
        low = min(n_text, max(0, start - 250))
        high = min(n_text, max(end + n_audio + 400, low + n_audio + 1200))
        ranges = [(low, high), (low, n_text), (0, n_text)]
    else:
        low, high = 0, min(n_text, max(end + n_audio + 200, n_audio + 600))
        ranges = [(0, high), (0, n_text)]
    return [r for i, r in enumerate(ranges) if r[0] < r[1] and r not in ranges[:i]]


def best_runs(text: list[str], audio: list[str], ranges: list[tuple[int, int]]) -> tuple[list[tuple[int, int, int]], int]:
    """Runs of the range that matches most; the search ends once a range matches a fifth of the audio, 25 tokens at least."""
    best, most = [], -1
    for low, high in ranges:
        runs = [(a + low, b, n) for a, b, n in equal_runs(text[low:high], audio)]
        matched = sum(n for _, _, n in runs)
        if matched > most:
            best, most = runs, matched
        if matched >= max(25, int(len(audio) * 0.2)):
            break
    return best, max(most, 0)


def align_spans(spans: DataFrame, audio: DataFrame, segments: DataFrame) -> DataFrame:
    """(book, chunk, span_index, html_order, seg_index, start, end, audio_text) of matched segments.

    spans: book, chunk, span_index, html_order, window_start, window_end, audio_start, audio_end
    audio: book, chunk, idx, token, word, start, end
    segments: book, html_order, seg_index, tokens

    A chunk is one group; its spans are aligned in order, and each starts where
    the one before stopped.
    """
    said = audio.groupBy("book", "chunk").agg(F.array_sort(F.collect_list(F.struct("idx", "token", "word", "start", "end"))).alias("audio"))
    pages = segments.groupBy("book", "html_order").agg(F.array_sort(F.collect_list(F.struct("seg_index", "tokens"))).alias("segments"))
    rows = spans.join(pages, ["book", "html_order"]).join(said, ["book", "chunk"])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out, cursor = [], 0
        for r in frame.sort_values(["span_index", "html_order"]).itertuples(index=False):
            words = list(r.audio)
            text = [(t, s["seg_index"]) for s in r.segments for t in s["tokens"]]
            begin = max(cursor, r.audio_start)
            if not text or begin >= len(words):
                continue
            stop = r.audio_end if r.audio_end >= begin else len(words) - 1
            heard = words[begin : min(len(words) - 1, stop) + 1]
            ranges = search_ranges(len(text), len(heard), r.window_start, r.window_end, r.span_index == 0)
            runs, matched = best_runs([t for t, _ in text], [w["token"] for w in heard], ranges)
            if not matched:
                continue
            by_segment: dict[int, list] = {}
            for a, b, n in runs:
                for k in range(n):
                    by_segment.setdefault(text[a + k][1], []).append(heard[b + k])
            for seg, got in sorted(by_segment.items()):
                got.sort(key=lambda w: w["idx"])
                out.append((r.book, r.chunk, r.span_index, r.html_order, seg, min(w["start"] for w in got), max(w["end"] for w in got), " ".join(w["word"] for w in got)))
            cursor = max(cursor, begin + max(b + n for _, b, n in runs))
        return pd.DataFrame(out, columns=["book", "chunk", "span_index", "html_order", "seg_index", "start", "end", "audio_text"])

    kinds = {f.name: f.dataType.simpleString() for f in spans.schema}
    schema = f"book {kinds['book']}, chunk {kinds['chunk']}, span_index int, html_order {kinds['html_order']}, seg_index int, start double, end double, audio_text string"
    return rows.groupBy("book", "chunk").applyInPandas(run, schema)
