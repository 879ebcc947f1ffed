"""Queries that SQL cannot say, against plain Python over the whole small tables."""

import difflib
import random
import re
from collections import Counter
from html.parser import HTMLParser

import one_book
import pyarrow.parquet as pq
import pytest

from lectern.operators import matching, retrieval, timeline
from lectern.plans import catalogue


@pytest.fixture(scope="module")
def tables(sf_dir):
    return {t: pq.read_table(f"{sf_dir}/{t}.parquet").to_pandas() for t in ("documents", "benchmark", "pages")}


def tokens(text):
    words = re.split(r"[\s\x1c-\x1f]+", re.sub("[-‐-―]", " ", text or ""))
    cleaned = ("".join(c for c in w.lower() if c == "_" or c.isalpha() or c.isnumeric()) for w in words)
    return [w for w in cleaned if w]


def windows(words):
    n = len(words)
    starts = [] if n < 5 else [0] if n <= 160 else sorted({*range(0, n - 159, 80), n - 160})
    return [(i, s, min(s + 160, n)) for i, s in enumerate(starts)]


@pytest.fixture(scope="module")
def best(tables):
    """item -> (score, -rank, doc, window, ratio, overlap, start, end)."""
    docs = {d: tokens(t) for d, t in zip(tables["documents"].doc_id, tables["documents"].text, strict=True)}
    spans = [(d, *w) for d in sorted(docs) for w in windows(docs[d])]
    counts = [Counter(t for t in docs[d][a:b] if len(t) >= 4) for d, _, a, b in spans]
    out = {}
    for item, text in zip(tables["benchmark"].item_id, tables["benchmark"].text, strict=True):
        words = tokens(text)
        probe = words[:120]
        wanted = Counter(t for t in probe if len(t) >= 4)
        if len(words) < 5 or not wanted:
            continue
        shared = [(sum(min(n, c[t]) for t, n in wanted.items()), s) for c, s in zip(counts, spans, strict=True)]
        top = sorted((x for x in shared if x[0]), key=lambda x: (-x[0], x[1][0], x[1][1]))[:24]
        scored = []
        for rank, (overlap, (d, w, a, b)) in enumerate(top, 1):
            ratio = difflib.SequenceMatcher(None, docs[d][a:b][: len(probe)], probe, autojunk=False).ratio()
            scored.append((0.7 * overlap / sum(wanted.values()) + 0.3 * ratio, -rank, d, w, ratio, overlap, a, b))
        if scored:
            out[item] = (*max(scored), docs, probe)
    return out


def test_probe_window_score(spark, sf_dir, best):
    got = {r.item_id: r for r in catalogue.QUERIES["probe_window_score"](spark, sf_dir).collect()}
    assert set(got) == set(best)
    for item, (score, rank, doc, window, ratio, overlap, *_) in best.items():
        r = got[item]
        assert (r.doc_id, r.window_index, r.rank, r.overlap) == (doc, window, -rank, overlap)
        assert r.score == pytest.approx(score, abs=1e-8) and r.ratio == pytest.approx(ratio, abs=1e-8) and r.accepted == (score >= 0.35 and overlap >= 6)


def test_sequence_alignment(spark, sf_dir, best):
    got = {r.item_id: r for r in catalogue.QUERIES["sequence_alignment"](spark, sf_dir).collect()}
    assert set(got) == set(best)
    for item, (_, _, doc, _, _, _, a, b, docs, probe) in best.items():
        blocks = [x for x in difflib.SequenceMatcher(None, docs[doc][a:b], probe, autojunk=False).get_matching_blocks() if x.size]
        r = got[item]
        assert r.matched == sum(x.size for x in blocks)
        assert (r.max_text, r.min_audio, r.max_audio) == (max(x.a + x.size - 1 for x in blocks), min(x.b for x in blocks), max(x.b + x.size - 1 for x in blocks))


class Strings(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden = max(0, self.hidden - (tag in ("script", "style")))

    def handle_data(self, data):
        if not self.hidden and data.strip():
            self.out.append(data.strip())


def strings(markup):
    parser = Strings()
    parser.feed(markup or "")
    parser.close()
    return parser.out


def test_html_text(spark, sf_dir, tables):
    got = {r.page_id: r.text for r in catalogue.QUERIES["html_text"](spark, sf_dir).collect()}
    assert got == {p: " ".join(strings(h)) for p, h in zip(tables["pages"].page_id, tables["pages"].html, strict=True)}


def squeeze(text):
    return "".join(text.split())


def test_clean_html(spark, sf_dir, tables):
    """The visible text stays; no attribute or element comes."""
    before = dict(zip(tables["pages"].page_id, tables["pages"].html, strict=True))
    for r in catalogue.QUERIES["clean_html"](spark, sf_dir).collect():
        assert squeeze("".join(strings(r.html))) == squeeze("".join(strings(before[r.page_id])))
        names = lambda h: Counter(n for c in re.findall(r'class="([^"]*)"', h) for n in c.split())
        assert not names(r.html) - names(before[r.page_id])


def test_mark_segments(spark, sf_dir, tables):
    """Segments are numbered in order, and all their text stands in the page in that order."""
    rows = catalogue.QUERIES["mark_segments"](spark, sf_dir).orderBy("page_id", "seg_index").toPandas()
    assert rows.error.isna().all()
    before = dict(zip(tables["pages"].page_id, tables["pages"].html, strict=True))
    for page, part in rows.groupby("page_id"):
        assert part.seg_id.tolist() == [f"c{page}-segment{i + 1}" for i in range(len(part))]
        text, at = squeeze("".join(strings(before[page]))), 0
        for segment in part.text:
            at = text.index(squeeze(segment), at) + len(squeeze(segment))


def test_segment_boundaries(spark, sf_dir, tables):
    """Segments tile every text, and each begins behind white space, a mark or a quotation's start."""
    rows = catalogue.QUERIES["segment_boundaries"](spark, sf_dir).orderBy("doc_id", "seg_index").toPandas()
    texts = dict(zip(tables["documents"].doc_id, tables["documents"].text, strict=True))
    assert set(rows.doc_id) == {d for d, t in texts.items() if t}
    for doc, part in rows.groupby("doc_id"):
        assert [0, *part.end] == [*part.start, len(texts[doc])]
        assert all(a == 0 or not texts[doc][a - 1].isalnum() or texts[doc][a] in "\"'“‘(" for a in part.start)


def test_reference_index(spark, sf_dir, tables):
    """Every class that an inline rule selects by itself is there, and every link's fragment."""
    got = {(r.kind, r.name) for r in catalogue.QUERIES["reference_index"](spark, sf_dir).collect()}
    for html in tables["pages"].html:
        for style in re.findall(r"(?is)<style[^>]*>(.*?)</style>", html or ""):
            assert {("class", n) for n in re.findall(r"\.([A-Za-z][\w-]*)\s*\{[^}]*:[^}]*\}", style)} <= got
        assert {("id", n) for n in re.findall(r'href="#([\w-]+)"', html or "")} <= got


def test_overlay_clips(spark, sf_dir, tables):
    """Clips of a book follow each other from 0 to its end, one for each segment between the first and the last heard one."""
    rows = catalogue.QUERIES["overlay_clips"](spark, sf_dir).orderBy("book", "seg_index").toPandas()
    items = dict(zip(tables["benchmark"].item_id, tables["benchmark"].text, strict=True))
    for book, part in rows.groupby("book"):
        n = len(tokens(items[book]))
        assert part.start.iloc[0] == 0.0 and part.end.iloc[-1] == n * 0.5 + 1
        assert part.start.tolist()[1:] == part.end.tolist()[:-1]
        assert part.seg_index.tolist() == list(range(part.seg_index.min(), part.seg_index.max() + 1))
    assert set(rows.book) == {i for i, t in items.items() if tokens(t)}


def test_prefix_rule_of_tables_and_lists(spark):
    rng = random.Random(3)
    pages = [(i, [rng.choice("abc") for _ in range(rng.randint(0, 8))]) for i in range(150)]
    probes = [(i, [rng.choice("abc") for _ in range(rng.randint(0, 12))]) for i in range(60)]
    got = retrieval.page_prefixes(spark.createDataFrame(pages, "p int, tokens array<string>"), "p", spark.createDataFrame(probes, "q int, probe array<string>"), "q")
    assert {tuple(r) for r in got.collect()} == {(p, q) for p, page in pages for q, probe in probes if matching.opens_with(probe, page)}


def test_chapters_of_a_long_book():
    chapters = [(float(i), float(i + 1)) for i in range(200_000)]
    got = timeline.merged(chapters, 10.0)
    assert len(got) == 20_000 and got[0] == (0.0, 10.0) and timeline.merged([(0.0, 50.0), (50.0, 55.0)], 10.0) == [(0.0, 55.0)]


def rows_of_book(book, spans):
    keys = ("reason", "span_index", "html_order", "window_index", "window_start", "window_end", "candidate_index", "audio_start", "audio_end")
    return [(book, r["chunk"], *(r.get(k) for k in keys), None if r.get("score") is None else round(r["score"], 9)) for r in spans]


def folded(frame):
    rows = frame.select("book", "chunk", "reason", "span_index", "html_order", "window_index", "window_start", "window_end", "candidate_index", "audio_start", "audio_end", "score").collect()
    return sorted(((*r[:-1], None if r.score is None else round(r.score, 9)) for r in rows), key=str)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_fold_by_force(spark, folder):
    """Every span of every transcript of every book, against one book at a time in memory."""
    docs, items = (pq.read_table(f"{folder}/{t}.parquet").to_pandas() for t in ("documents", "benchmark"))
    said = [(i, tokens(t)) for i, t in zip(items.item_id, items.text, strict=True)]
    want = []
    for book, part in docs.groupby("source"):
        pages = sorted((d, tokens(t)) for d, t in zip(part.doc_id, part.text, strict=True))
        want += rows_of_book(book, one_book.match_book(one_book.Book([d for d, _ in pages], [t for _, t in pages]), said))
    assert folded(catalogue.QUERIES["ordered_match_fold"](spark, folder)) == sorted(want, key=str)


def test_fold_over_many_pages(spark):
    """Books whose transcripts run over pages, skip back, share passages, and open with short pages."""
    rng = random.Random(12)
    books, said = {}, {}
    for b in ("x", "y", "z"):
        pages = [[f"{b}word{rng.randrange(900)}" for _ in range(rng.choice([3, 8, 15, 40, 170, 400]))] for _ in range(14)]
        pages[5] = list(pages[2])
        books[b] = pages
        line = [t for p in pages for t in p]
        cuts = sorted(rng.randrange(len(line)) for _ in range(7))
        said[b] = [(k, [t if rng.random() > 0.08 else f"noise{rng.randrange(99)}" for t in line[x:y]]) for k, (x, y) in enumerate(zip([0, *cuts], [*cuts, len(line)], strict=True))]
        said[b] += [(20, line[:90]), (21, pages[3] + [f"other{i}" for i in range(30)]), (22, ["a", "b"]), (23, [])]
    want = [r for b in books for r in rows_of_book(b, one_book.match_book(one_book.Book(list(range(14)), books[b]), said[b]))]
    pages = spark.createDataFrame([(b, i, " ".join(p)) for b in books for i, p in enumerate(books[b])], "book string, html_order long, text string")
    transcripts = spark.createDataFrame([(b, c, " ".join(t)) for b in said for c, t in said[b]], "book string, chunk long, text string")
    got = folded(matching.match_books(pages, transcripts))
    assert got == sorted(want, key=str)
    assert max(r[3] or 0 for r in got) >= 2 and {"short", "ok"} <= {r[2] for r in got}
