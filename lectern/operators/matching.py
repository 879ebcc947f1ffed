"""Ordered matching: transcripts of a book are placed forward through its pages.

A transcript's first window is the best of its shortlist, where windows behind
the place last reached get a bonus; from there it runs on into following pages.
Only the bonus depends on the transcripts before, so

* windows, overlaps, shortlists and ratios of all transcripts are joined and
  scored beforehand, spread by token, transcript and page;
* each window that some place could make the first one is run on by itself, a
  page a round, all transcripts of all books at once;
* the fold over a book reads, for each transcript, its shortlist's scores, where
  each of those runs ended, and the short pages that open it: a few numbers a
  transcript, in the order of the transcripts' numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.frames import by_key, spread
from lectern.functions.shared import keep
from lectern.functions.text import MIN_LONG, text_tokens

from .alignment import best_runs, search_ranges
from .retrieval import COVER, MAX_OFFSET, MAX_SKIP, MIN_OVERLAP, MIN_RUN, MIN_SCORE, SHORT_PAGE, WEIGHTS, page_prefixes, sequence_ratio
from .windows import MIN_TOKENS, MIN_WINDOW, PROBE, SHORTLIST, STEP, WINDOW, probes, window_multiset, window_spans

REWIND = 24


def spans_of(n: int) -> list[tuple[int, int]]:
    """Windows over n tokens, as window_starts says."""
    if n < MIN_TOKENS:
        return []
    if n <= WINDOW:
        return [(0, n)]
    starts = list(range(0, n - WINDOW + 1, STEP))
    if starts[-1] != n - WINDOW:
        starts.append(n - WINDOW)
    return [(s, s + WINDOW) for s in starts]


def long_counts(tokens: list[str]) -> Counter:
    return Counter(t for t in tokens if len(t) >= MIN_LONG)


def reach(text: list[str], audio: list[str], start: int, hint: int) -> int | None:
    """Last audio position that aligns with a page from `start` on; None if there is nothing to align."""
    if start >= len(audio) or not text:
        return None
    heard = audio[start:]
    runs, _ = best_runs(text, heard, search_ranges(len(text), len(heard), hint, hint, True))
    return start + max((b + n for _, b, n in runs), default=0) - 1


def opens_with(probe: list[str], page: list[str]) -> bool:
    """Whether a short page opens a probe, as `retrieval.page_prefixes` says for tables of both."""
    least = max(MIN_RUN, ceil(COVER * len(page)))
    rests = (page[skip:] for skip in range(min(MAX_SKIP, len(page) - least) + 1))
    return any(probe[o : o + len(rest)] == rest for rest in rests for o in range(MAX_OFFSET + 1))


def rewound(end: int | None, cursor: int) -> int:
    """Where a transcript goes on after a page that it matched up to `end`."""
    return max(cursor, end - REWIND + 1) if end is not None and end >= 0 else cursor


def next_page(audio: list[str], cursor: int, page: list[str]) -> tuple[int, float, int] | None:
    """(window number, score, new cursor) of the page that follows a matched one, if the transcript runs on into it."""
    from difflib import SequenceMatcher

    following = audio[cursor : cursor + PROBE]
    wanted, spans = long_counts(following), spans_of(len(page))
    near = [i for i, (a, _) in enumerate(spans) if a <= 2 * WINDOW]
    if not near or not wanted:
        return None
    shared = [(sum(min(n, c[t]) for t, n in wanted.items()), i) for i in near for c in [long_counts(page[slice(*spans[i])])]]
    best, top, overlap = None, 0.0, 0
    for k, i in sorted((x for x in shared if x[0]), key=lambda x: (-x[0], x[1]))[:SHORTLIST]:
        ratio = SequenceMatcher(None, page[slice(*spans[i])][: len(following)], following, autojunk=False).ratio()
        score = WEIGHTS[0] * k / sum(wanted.values()) + WEIGHTS[1] * ratio + WEIGHTS[2]
        if score > top:
            best, top, overlap = i, score, k
    if best is None or top < MIN_SCORE or overlap < MIN_OVERLAP:
        return None
    end = reach(page, audio, cursor, spans[best][0])
    if end is None or end <= cursor:
        return None
    return best, top, rewound(end, cursor)


def choose(shortlist: list[tuple[int, float, int]], floor: int) -> tuple[int, float, int] | None:
    """(window, score, overlap) of the shortlist's best (window, score without bonus, overlap) for this floor; the earlier one on ties."""
    best = None
    for window, score, overlap in shortlist:
        score += WEIGHTS[2] if window >= floor else 0.0
        if score > (best[1] if best else 0.0):
            best = window, score, overlap
    return best


def possible(shortlist: list[tuple[int, float, int]]) -> list[int]:
    """The accepted windows that `choose` gives for any floor."""
    floors = [0, *(window + 1 for window, _, _ in shortlist)]
    chosen = (choose(shortlist, f) for f in floors)
    return sorted({c[0] for c in chosen if c and c[1] >= MIN_SCORE and c[2] >= MIN_OVERLAP})


def _shortlists(pages: DataFrame, windows: DataFrame, asked: DataFrame) -> DataFrame:
    """(book, chunk, rank, window, html_order, window_index, score, overlap) of the windows that share most with each probe."""
    wanted = asked.select("book", "chunk", F.explode("probe").alias("token")).where(F.length("token") >= MIN_LONG).groupBy("book", "chunk", "token").agg(F.count("*").alias("probe_n"))
    wanted = keep(wanted, "match-wanted")
    counts = window_multiset(by_key(pages, "page"), "page", wanted.select("token").distinct()).withColumn("book", F.col("page.book"))
    shared = counts.join(wanted, ["book", "token"]).groupBy("page", "chunk", "window_index").agg(F.sum(F.least("n", "probe_n")).alias("overlap"))
    order = Window.partitionBy("book", "chunk").orderBy(F.desc("overlap"), F.asc("html_order"), F.asc("window_index"))  # as windows are numbered
    ranked = shared.select("page.book", "chunk", "page.html_order", "window_index", "overlap").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= SHORTLIST)
    # a written table has a size, so the few rows go to the texts and not the texts to them
    placed = keep(keep(ranked, "match-ranked").join(windows, ["book", "html_order", "window_index"]), "match-ranked")
    rows = placed.join(pages.select("page.book", "page.html_order", "tokens"), ["book", "html_order"]).join(asked.select("book", "chunk", "probe", "n_long"), ["book", "chunk"])
    size = F.least(F.col("window_end") - F.col("window_start"), F.size("probe"))
    ratio = sequence_ratio(F.slice("tokens", F.col("window_start") + 1, size), F.col("probe"))
    score = F.lit(WEIGHTS[0]) * F.col("overlap") / F.col("n_long") + F.lit(WEIGHTS[1]) * ratio
    return rows.select("book", "chunk", "rank", "window", "html_order", "window_index", "window_start", "window_end", score.alias("score"), "overlap")


_RUN = "book string, chunk long, first long, number int, place long, html_order long, window_index int, window long, window_start int, window_end int, score double, audio_start int, cursor int"


def _first_steps(starts: DataFrame) -> DataFrame:
    """The first span of every possible start, with where it leaves the transcript."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["cursor"] = [rewound(reach(list(t), list(a), 0, s), 0) for t, a, s in zip(f["tokens"], f["audio"], f["window_start"], strict=True)]
            yield f.assign(number=0, audio_start=0)[[c.split()[0] for c in _RUN.split(", ")]]

    return starts.mapInPandas(run, _RUN)


def _next_steps(active: DataFrame) -> DataFrame:
    """The next span of every run that goes on into the page given with it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _RUN.split(", ")]
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                step = next_page(list(r.audio), r.cursor, list(r.tokens))
                if step is not None:
                    w, score, cursor = step
                    a, b = spans_of(len(r.tokens))[w]
                    rows.append((r.book, r.chunk, r.first, r.number + 1, r.next_place, r.next_order, w, r.first_window + w, a, b, score, r.cursor, cursor))
            yield pd.DataFrame(rows, columns=names)

    return active.mapInPandas(run, _RUN)


def _runs(pages: DataFrame, places: DataFrame, windows: DataFrame, said: DataFrame, shortlists: DataFrame) -> DataFrame:
    """Spans of every run that a transcript could take, from each window that could be its first."""
    ranked = shortlists.groupBy("book", "chunk").agg(F.array_sort(F.collect_list(F.struct("rank", "window", "score", "overlap"))).alias("s"))

    def starts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(b, c, w) for b, c, s in f.itertuples(index=False) for w in possible([(x["window"], x["score"], x["overlap"]) for x in s])]
            yield pd.DataFrame(rows, columns=["book", "chunk", "window"])

    first = ranked.mapInPandas(starts, "book string, chunk long, window long")
    texts = pages.select("page.book", "page.html_order", "tokens")
    audio = said.select("book", "chunk", F.col("tokens").alias("audio"))
    starting = keep(first.join(shortlists, ["book", "chunk", "window"]).join(places, ["book", "html_order"]), "match-starts")
    rows = starting.join(texts, ["book", "html_order"]).join(audio, ["book", "chunk"]).withColumn("first", F.col("window"))
    opening = windows.where("window_index = 0").select("book", "html_order", F.col("window").alias("first_window"))
    following = places.join(opening, ["book", "html_order"], "left").select("book", F.col("place").alias("next_place"), F.col("html_order").alias("next_order"), "first_window")
    following = keep(following, "match-following")
    lengths = said.select("book", "chunk", F.col("n_tokens").alias("n_audio"))
    found = last = keep(_first_steps(rows), "match-run")
    while True:  # a page a round, for the runs that still go on
        ahead = keep(last.withColumn("next_place", F.col("place") + 1).join(lengths, ["book", "chunk"]).where("cursor < n_audio").join(following, ["book", "next_place"]), "match-ahead")
        ahead = ahead.join(texts.withColumnRenamed("html_order", "next_order"), ["book", "next_order"]).join(audio, ["book", "chunk"])
        last = keep(_next_steps(ahead), "match-run")
        if last.isEmpty():
            return found
        found = found.unionByName(last)


_SCHEMA = "book string, chunk long, reason string, span_index int, html_order long, window_index int, window_start int, window_end int, candidate_index long, score double, audio_start int, audio_end int"
_COLUMNS = [c.split()[0] for c in _SCHEMA.split(", ")]


def fold(book: str, transcripts: list[dict]) -> list[tuple]:
    """Spans of a book's transcripts in the order of their numbers; one without a span says why.

    Each has chunk, n (tokens), reason, shortlist, runs (spans by first window)
    and shorts (window, html_order, window_end of the short pages that open it).
    """
    out: list[tuple] = []
    last_window = last_order = 0
    for t in sorted(transcripts, key=lambda t: t["chunk"]):
        best = choose(t["shortlist"], max(0, last_window - 1)) if t["reason"] == "ok" else None
        short = None
        if best and not (best[1] >= MIN_SCORE and best[2] >= MIN_OVERLAP):
            short = next((s for s in sorted(t["shorts"]) if s[1] >= last_order), None)
        if best is None or (short is None and best[0] not in t["runs"]) or (short is None and not (best[1] >= MIN_SCORE and best[2] >= MIN_OVERLAP)):
            reason = t["reason"] if t["reason"] != "ok" else "no overlap" if best is None else "below threshold"
            out.append((book, t["chunk"], reason, *[None] * (len(_COLUMNS) - 3)))
            continue
        if short:
            spans = [(short[1], 0, 0, short[2], short[0], best[1], 0)]
        else:
            run = t["runs"][best[0]]
            spans = [(*run[0][:5], best[1], run[0][6]), *run[1:]]
        for i, s in enumerate(spans):
            end = max(s[6], (spans[i + 1][6] if i + 1 < len(spans) else t["n"]) - 1)
            out.append((book, t["chunk"], "short page" if short else "ok", i, *s, end))
        last_window = spans[-1][4]
        last_order = max(last_order, spans[-1][0])
    return out


def match_books(pages: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Spans of every transcript (book, chunk, text) in the pages (book, html_order, text) of its book.

    Rejected transcripts get a row with the reason.  Texts never meet in the task
    of a whole book; only the numbers that the fold needs do.
    """
    tokenised = spread(pages.select("book", F.col("html_order").cast("long").alias("html_order"), "text")).select("book", "html_order", text_tokens(F.col("text")).alias("tokens"))
    numbered = keep(tokenised.where("book IS NOT NULL AND html_order IS NOT NULL"), "match-tokens")
    texts = numbered.select(F.struct("book", "html_order").alias("page"), "tokens", F.size("tokens").alias("n_tokens"))
    place = F.row_number().over(Window.partitionBy("book").orderBy("html_order"))
    places = keep(numbered.select("book", "html_order").withColumn("place", place.cast("long")), "match-places")
    order = Window.partitionBy("book").orderBy("html_order", "window_index")
    windows = window_spans(texts, "page").select("page.book", "page.html_order", "window_index", "window_start", "window_end")
    windows = keep(windows.withColumn("window", (F.row_number().over(order) - 1).cast("long")), "match-windows")
    said = keep(transcripts.select("book", F.col("chunk").cast("long").alias("chunk"), text_tokens(F.col("text")).alias("tokens")).withColumn("n_tokens", F.size("tokens")), "match-said")
    asked = probes(said.withColumn("key", F.struct("book", "chunk")), "key").select("key.book", "key.chunk", "n_tokens", "probe", "n_long", "reason")
    usable = asked.where("reason = 'ok'")
    shortlists = keep(_shortlists(texts, windows, usable), "match-shortlists")
    runs = _runs(texts, places, windows, said, shortlists)

    near = texts.where((F.col("n_tokens") >= MIN_TOKENS) & (F.col("n_tokens") < min(SHORT_PAGE, MIN_WINDOW + 1)))
    opened = page_prefixes(near.withColumn("book", F.col("page.book")), "page", usable.withColumn("key", F.struct("book", "chunk")), "key", "book")
    shorts = opened.select("probe_id.book", "probe_id.chunk", "page.html_order").join(windows.where("window_index = 0"), ["book", "html_order"])

    def gathered(rows: DataFrame, name: str, *columns: str) -> DataFrame:
        return rows.groupBy("book", "chunk").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))

    span = ["first", "number", "html_order", "window_index", "window_start", "window_end", "window", "score", "audio_start"]
    per = asked.select("book", "chunk", F.col("n_tokens").alias("n"), "reason")
    for rows, name, columns in ((shortlists, "shortlist", ["rank", "window", "score", "overlap"]), (runs, "runs", span), (shorts, "shorts", ["window", "html_order", "window_end"])):
        per = per.join(gathered(rows, name, *columns), ["book", "chunk"], "left")

    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        some = lambda x: [] if x is None else list(x)
        transcripts = []
        for r in frame.itertuples(index=False):
            by_first: dict[int, list[tuple]] = {}
            for s in some(r.runs):
                by_first.setdefault(s["first"], []).append(tuple(s[c] for c in span[2:]))
            transcripts.append({
                "chunk": r.chunk, "n": r.n, "reason": r.reason, "shortlist": [(s["window"], s["score"], s["overlap"]) for s in some(r.shortlist)], "runs": by_first,
                "shorts": [(s["window"], s["html_order"], s["window_end"]) for s in some(r.shorts)],
            })
        return pd.DataFrame(fold(frame["book"].iloc[0], transcripts), columns=_COLUMNS)

    return per.groupBy("book").applyInPandas(whole, _SCHEMA)
