"""One book's ordered matching in plain Python, all in memory: what the tables of `matching` have to give."""

import difflib
from collections import Counter
from dataclasses import dataclass, field

from lectern.functions.text import MIN_LONG
from lectern.operators.alignment import equal_runs
from lectern.operators.matching import REWIND, opens_with, spans_of
from lectern.operators.retrieval import MIN_OVERLAP, MIN_SCORE, SHORT_PAGE, WEIGHTS
from lectern.operators.windows import MIN_TOKENS, MIN_WINDOW, PROBE, SHORTLIST, WINDOW


@dataclass
class Candidate:
    page: int  # place of the page in the book
    window: int
    start: int
    end: int
    index: int
    counts: Counter


@dataclass
class Book:
    """A book's pages, its windows and an index from token to windows."""

    orders: list[int]
    pages: list[list[str]]
    windows: list[Candidate] = field(default_factory=list)
    by_token: dict[str, list[int]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for page, tokens in enumerate(self.pages):
            for w, (a, b) in enumerate(spans_of(len(tokens))):
                c = Candidate(page, w, a, b, len(self.windows), Counter(t for t in tokens[a:b] if len(t) >= MIN_LONG))
                for t in c.counts:
                    self.by_token.setdefault(t, []).append(c.index)
                self.windows.append(c)

    def best(self, probe: list[str], floor: int, among: set[int] | None = None) -> tuple[Candidate | None, float, int]:
        """Best-scored window of the shortlist, its score and overlap."""
        wanted = Counter(t for t in probe if len(t) >= MIN_LONG)
        total = sum(wanted.values())
        overlap: Counter = Counter()
        for t, n in wanted.items():
            for i in self.by_token.get(t, ()):
                if among is None or i in among:
                    overlap[i] += min(n, self.windows[i].counts[t])
        chosen, top, shared = None, 0.0, 0
        for i, k in sorted(overlap.items(), key=lambda x: (-x[1], x[0]))[:SHORTLIST]:
            c = self.windows[i]
            ratio = difflib.SequenceMatcher(None, self.pages[c.page][c.start : c.end][: len(probe)], probe, autojunk=False).ratio()
            score = WEIGHTS[0] * k / max(1, total) + WEIGHTS[1] * ratio + (WEIGHTS[2] if i >= floor else 0.0)
            if score > top:
                chosen, top, shared = c, score, k
        return chosen, top, shared

    def reach(self, page: int, audio: list[str], start: int, hint: int) -> int | None:
        """Last audio position that aligns with the page from `start` on; None if there is nothing to align."""
        text = self.pages[page]
        if start >= len(audio) or not text:
            return None
        n = len(audio) - start
        low = min(len(text), max(0, hint - 250))
        high = min(len(text), max(hint + n + 400, low + n + 1200))
        best, most = None, -1
        for a, b in dict.fromkeys([(low, high), (low, len(text)), (0, len(text))]):
            if a >= b:
                continue
            runs = equal_runs(text[a:b], audio[start:])
            matched = sum(r[2] for r in runs)
            if matched > most:
                most = matched
                best = start + max((r[1] + r[2] for r in runs), default=0) - 1
            if matched >= max(25, int(n * 0.2)):
                break
        return best


def match_book(book: Book, transcripts: list[tuple[int, list[str]]]) -> list[dict]:
    """Spans of the transcripts in order; one without a span says why."""
    out: list[dict] = []
    last_index = last_order = 0

    def span(chunk: int, c: Candidate, score: float, number: int, start: int) -> dict:
        return {"chunk": chunk, "reason": "ok", "html_order": book.orders[c.page], "window_index": c.window, "window_start": c.start, "window_end": c.end, "candidate_index": c.index, "span_index": number, "score": score, "audio_start": start, "page": c.page}

    for chunk, audio in sorted(transcripts):
        probe = audio[:PROBE]
        if len(audio) < MIN_TOKENS or not any(len(t) >= MIN_LONG for t in probe):
            out.append({"chunk": chunk, "reason": "short" if len(audio) < MIN_TOKENS else "no probe"})
            continue
        c, score, overlap = book.best(probe, max(0, last_index - 1))
        if c is None:
            out.append({"chunk": chunk, "reason": "no overlap"})
            continue
        if score >= MIN_SCORE and overlap >= MIN_OVERLAP:
            spans = [span(chunk, c, score, 0, 0)]
            end = book.reach(c.page, audio, 0, c.start)
            cursor = max(0, end - REWIND + 1) if end is not None and end >= 0 else 0
            page = c.page + 1
            while cursor < len(audio) and page < len(book.pages):
                near = {w.index for w in book.windows if w.page == page and w.start <= 2 * WINDOW}
                near = near or {w.index for w in book.windows if w.page == page}
                following = audio[cursor : cursor + PROBE]
                if not near or not any(len(t) >= MIN_LONG for t in following):
                    break
                d, d_score, d_overlap = book.best(following, c.index, near)
                if d is None or d_score < MIN_SCORE or d_overlap < MIN_OVERLAP:
                    break
                end = book.reach(page, audio, cursor, d.start)
                if end is None or end <= cursor:
                    break
                spans.append(span(chunk, d, d_score, len(spans), cursor))
                cursor = max(cursor, end - REWIND + 1)
                page += 1
        else:
            short = next((w for w in book.windows if w.start == 0 and w.end < SHORT_PAGE and w.end <= MIN_WINDOW and book.orders[w.page] >= last_order and opens_with(probe, book.pages[w.page])), None)
            if short is None:
                out.append({"chunk": chunk, "reason": "below threshold"})
                continue
            spans = [span(chunk, short, score, 0, 0) | {"reason": "short page"}]
        for s, following in zip(spans, [*spans[1:], None], strict=True):
            s["audio_end"] = max(s["audio_start"], (following["audio_start"] if following else len(audio)) - 1)
        out += spans
        last_index = spans[-1]["candidate_index"]
        last_order = max(last_order, spans[-1]["html_order"])
    return out
