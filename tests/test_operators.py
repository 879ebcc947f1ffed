import random
from collections import Counter

import one_book
import pytest
from pyspark.sql import functions as F

from lectern.functions import clock, text
from lectern.operators import alignment, audits, lineage, matching, timeline, windows
from lectern.operators import retrieval as R


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "value, tokens",
    [
        ("well-known fact", ["well", "known", "fact"]), ("a–b—c", ["a", "b", "c"]), ("don't stop", ["dont", "stop"]), ("U.S. now", ["us", "now"]), ("— -", []), ("", []), ("-lead trail-", ["lead", "trail"]),
        ("ÉTÉ_1 x", ["été_1", "x"]), (None, []),
    ],
)
def test_tokens(spark, value, tokens):
    assert one(spark, text.text_tokens(F.lit(value).cast("string"))) == tokens


def test_scalar_functions(spark):
    assert [one(spark, text.identifier(F.lit(v))) for v in ("Ch 1/a.b", "__", "9x")] == ["ch_1_a_b", "item", "item_9x"]
    assert one(spark, text.segment_prefix(F.lit("t/Ch-1.xhtml"))) == "seg_t_ch_1"
    assert one(spark, text.sentence_language(F.lit("de_AT"))) == "german" and one(spark, text.sentence_language(F.lit("xx"))) == "xx"
    assert [one(spark, clock.media_duration(F.lit(v))) for v in (0.0005, 3661.5, -2.0, 0.0015)] == ["0:00:00.000", "1:01:01.500", "0:00:00.000", "0:00:00.002"]
    assert [one(spark, clock.clip_seconds(F.lit(v))) for v in ("1.5s", " 2 ", "1.5ss", "1.5d", "")] == [1.5, 2.0, None, None, None]
    assert one(spark, clock.lenient_seconds(F.lit("1.5ss"))) == 1.5
    assert one(spark, clock.audio_media_type(F.lit("A.MP3"))) == "audio/mpeg" and one(spark, clock.audio_media_type(F.lit("a"))) == "audio/mp4"


@pytest.mark.parametrize("n, spans", [(4, []), (5, [(0, 5)]), (159, [(0, 159)]), (160, [(0, 160)]), (200, [(0, 160), (40, 200)]), (240, [(0, 160), (80, 240)]), (250, [(0, 160), (80, 240), (90, 250)])])
def test_windows(spark, n, spans):
    tokens = spark.createDataFrame([(1, [f"tok{i}" for i in range(n)])], "k int, tokens array<string>").withColumn("n_tokens", F.size("tokens"))
    got = windows.window_spans(tokens, "k").orderBy("window_index").collect()
    assert [(r.window_start, r.window_end) for r in got] == spans == matching.spans_of(n)
    counts = {(r.window_index, r.token): r.n for r in windows.window_multiset(tokens, "k").collect()}
    assert counts == {(i, f"tok{j}"): 1 for i, (a, b) in enumerate(spans) for j in range(a, b)}


def test_global_index_is_the_order(spark):
    rows = spark.createDataFrame([(k, w) for k in (3, 5000, 9000, 9001) for w in range(3)], "k long, w int")
    got = windows.global_index(rows, "k", "w").orderBy("k", "w").collect()
    assert [r.global_index for r in got] == list(range(12))


@pytest.mark.parametrize(
    "probe, page, expected",
    [
        ("a b c d e f", "a b c d e", True), ("x a b c d e f", "a b c d e", True), ("x y z a b c d e", "a b c d e", False), ("c d e f g", "h1 h2 c d e", True), ("a b c", "a b c d e", False), ("d e f", "a b c d e f", False),
    ],
)
def test_page_prefix(spark, probe, page, expected):
    pages = spark.createDataFrame([(1, page.split())], "p int, tokens array<string>")
    probes = spark.createDataFrame([(2, probe.split())], "q int, probe array<string>")
    assert bool(R.page_prefixes(pages, "p", probes, "q").count()) is expected
    assert matching.opens_with(probe.split(), page.split()) is expected


def test_gap_fill_and_closing(spark):
    rows = spark.createDataFrame([("a", 1, 10.0, 12.0), ("a", 4, 18.0, 19.0), ("a", 6, 18.5, 20.0)], "g string, seg_index long, start double, end double")
    filled = timeline.fill_gaps(rows, "g").orderBy("seg_index").collect()
    assert [(r.seg_index, r.start, r.interpolated) for r in filled] == [(1, 10.0, False), (2, 14.0, True), (3, 16.0, True), (4, 18.0, False), (6, 18.5, False)]
    closed = timeline.close_timeline(timeline.fill_gaps(rows, "g").withColumn("total", F.lit(30.0)), "g", "seg_index", "total").orderBy("seg_index").collect()
    assert closed[0].start == 0.0 and closed[-1].end == 30.0
    assert all(a.end == b.start for a, b in zip(closed, closed[1:], strict=False))


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(3)
    clips = [(rng.randint(0, 2), i, b := rng.random() * 50, b + rng.random() * 20) for i in range(120)]
    frame = spark.createDataFrame(clips, "k int, id int, begin double, end double")
    got = {(r.a, r.b) for r in audits.overlapping_clips(frame, "k", "id", 7.0).collect()}
    order = sorted(clips, key=lambda c: (c[2], c[3], c[1]))
    want = {(x[1], y[1]) for i, x in enumerate(order) for y in order[i + 1 :] if x[0] == y[0] and min(x[3], y[3]) - y[2] >= 0.5}
    assert got == want


def test_covered_once(spark):
    frame = spark.createDataFrame([(1, 0.0, 10.0), (1, 5.0, 8.0), (1, 9.0, 12.0), (1, 20.0, 21.0)], "k int, begin double, end double")
    assert audits.covered_union(frame, "k").first().covered_once == 13.0


def test_empty_checks_pass(spark):
    none = spark.createDataFrame([], "x int")
    rows = {r.name: (r.ok, r.findings) for r in audits.roll_up([("a", none, False), ("b", spark.range(2), True), ("c", spark.range(1), False)]).collect()}
    assert rows == {"a": (True, 0), "b": (True, 2), "c": (False, 1), "total": (False, 1)}


def test_work_list(spark):
    want = spark.createDataFrame([(1, ("m", "en")), (2, ("m", None)), (3, ("m", "en")), (4, ("m", "en"))], "k int, stamp struct<model:string,lang:string>")
    have = spark.createDataFrame([(1, ("m", "en")), (2, ("m", None)), (3, ("n", "en")), (5, None)], "k int, stamp struct<model:string,lang:string>")
    assert {r.k: r.action for r in lineage.work_list(want, have, "k").collect()} == {1: "reuse", 2: "reuse", 3: "regenerate", 4: "create"}
    assert lineage.same_names(want.select("k"), want.select("k")) and not lineage.same_names(want.select("k"), have.select("k"))


def test_stages_resume():
    saved, ran = [], []
    stages = {n: (lambda s, n=n: n == "split", lambda s, n=n: ran.append(n) or {"n": n}) for n in lineage.STAGES[:3]}
    state = lineage.run_stages({}, stages, lambda s: saved.append(1), lambda: "now")
    assert ran == ["prepare", "transcribe"] and state["stages"]["split"]["reused"]
    broken = {"prepare": (lambda s: False, lambda s: 1 / 0)}
    state = {}
    with pytest.raises(ZeroDivisionError):
        lineage.run_stages(state, broken, lambda s: None, lambda: "now")
    assert state["stages"]["prepare"]["status"] == "failed"


def _book():
    rng = random.Random(8)
    vocabulary = [f"word{i:04d}" for i in range(4000)]
    return [[rng.choice(vocabulary) for _ in range(n)] for n in (300, 12, 400, 350)]


def test_fold_walks_forward():
    pages = _book()
    book = one_book.Book([0, 1, 2, 3], pages)
    spans = one_book.match_book(book, [(1, pages[0][:200]), (2, pages[2][200:] + pages[3][:150]), (3, pages[1] + ["tail"] * 30), (4, ["none"] * 9), (5, ["a", "b"])])
    by_chunk = {c: [s for s in spans if s["chunk"] == c] for c in range(1, 6)}
    assert [s["html_order"] for s in by_chunk[1]] == [0]
    assert [s["html_order"] for s in by_chunk[2]] == [2, 3]
    first, second = by_chunk[2]
    assert first["audio_end"] == second["audio_start"] - 1 and second["audio_end"] == 349
    assert by_chunk[3][0]["reason"] in ("below threshold", "no overlap")  # page 1 lies behind page 3
    assert by_chunk[4][0]["reason"] == "no overlap" and by_chunk[5][0]["reason"] == "short"


def test_fold_takes_short_pages():
    pages = _book()
    spans = one_book.match_book(one_book.Book([0, 1, 2, 3], pages), [(1, pages[1] + [f"other{i}" for i in range(200)])])
    assert [(s["reason"], s["html_order"]) for s in spans] == [("short page", 1)]


def test_match_books(spark):
    pages = _book()
    rows = spark.createDataFrame([("b", i, " ".join(p)) for i, p in enumerate(pages)], "book string, html_order long, text string")
    said = spark.createDataFrame([("b", 7, " ".join(pages[2][:100])), ("c", 1, "nothing there at all today")], "book string, chunk long, text string")
    got = {(r.book, r.chunk): (r.reason, r.html_order) for r in matching.match_books(rows, said).collect()}
    assert got == {("b", 7): ("ok", 2), ("c", 1): ("no overlap", None)}


def test_alignment_of_spans(spark):
    page = [("s0", ["one", "two"]), ("s1", ["three"]), ("s2", ["four", "five"])]
    words = [w for _, ws in page for w in ws if w != "three"]
    audio = spark.createDataFrame([("b", 1, i, w, w.upper(), float(i), i + 0.5) for i, w in enumerate(words)], "book string, chunk long, idx int, token string, word string, start double, end double")
    segments = spark.createDataFrame([("b", 0, i, ws) for i, (_, ws) in enumerate(page)], "book string, html_order long, seg_index int, tokens array<string>")
    spans = spark.createDataFrame([("b", 1, 0, 0, 0, 5, 0, 3)], "book string, chunk long, span_index int, html_order long, window_start int, window_end int, audio_start int, audio_end int")
    got = alignment.align_spans(spans, audio, segments).orderBy("seg_index").collect()
    assert [(r.seg_index, r.start, r.end, r.audio_text) for r in got] == [(0, 0.0, 1.5, "ONE TWO"), (2, 2.0, 3.5, "FOUR FIVE")]


def test_equal_runs_cover_common_tokens():
    rng = random.Random(1)
    a = [rng.choice("abcd") for _ in range(60)]
    b = [rng.choice("abcd") for _ in range(50)]
    for x, y, n in alignment.equal_runs(a, b):
        assert a[x : x + n] == b[y : y + n]
    assert sum(n for _, _, n in alignment.equal_runs(a, b)) <= sum((Counter(a) & Counter(b)).values())


def test_few_small_files_are_spread(spark, sf_dir):
    from lectern.functions.frames import spread

    rows = spark.read.parquet(f"{sf_dir}/pages.parquet")
    assert spread(rows).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(spark.range(10)).rdd.getNumPartitions() == spark.range(10).rdd.getNumPartitions()
    assert sorted(r.page_id for r in spread(rows).collect()) == sorted(r.page_id for r in rows.collect())
