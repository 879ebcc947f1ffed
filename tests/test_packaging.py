import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.operators import overlays, packages
from lectern.plans import config
from lectern.sources import packaging

OPF = """<package xmlns="http://www.idpf.org/2007/opf" version="2.0"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>T</dc:title><meta property="media:duration">9</meta></metadata>
<manifest><item id="a" href="t/a.xhtml" media-type="application/xhtml+xml" media-overlay="old"/><item id="audio_001.m4a" href="old"/><item id="x" href="toc.ncx" media-type="application/x-dtbncx+xml"/></manifest></package>"""
NCX = '<ncx><navMap><navPoint><navLabel><text>One</text></navLabel><content src="t/a.xhtml"/></navPoint></navMap></ncx>'


def test_adapter_and_order(spark):
    rows = spark.createDataFrame([("", "a.json", "p", 1), ("b.json", None, "q", None)], "json_file string, audio_file string, file_name string, window_index int")
    got = [(r.json_file, r.html_file, r.candidate_index, r.audio_end_index, r.window_end) for r in overlays.spans_adapter(rows).orderBy("json_file").collect()]
    assert got == [("a.json", "p", 1, -1, 0), ("b.json", "q", 0, -1, 0)]
    spans = spark.createDataFrame([("k", 1, 0, 0), ("k", 0, 5, 9), ("k", 0, 5, 2)], "json_file string, span_index int, html_order int, candidate_index int")
    assert [(r.place, r.candidate_index) for r in overlays.span_order(spans).orderBy("place").collect()] == [(0, 2), (1, 9), (2, 0)]


def test_clip_plan(spark):
    audio = spark.createDataFrame([("b", c, i, t, t, float(i), i + 0.5) for c in (1, 2) for i, t in enumerate("one two four five".split())], "book string, chunk long, idx int, token string, word string, start double, end double")
    segments = spark.createDataFrame([("b", 0, i, [t]) for i, t in enumerate("one two three four five".split())], "book string, html_order long, seg_index int, tokens array<string>")
    spans = spark.createDataFrame([("b", c, 0, 0, 0, 5, 0, 3) for c in (1, 2)], "book string, chunk long, span_index int, html_order long, window_start int, window_end int, audio_start int, audio_end int")
    durations = spark.createDataFrame([("b", 1, 9.0), ("b", 2, 9.0)], "book string, chunk long, duration double")
    got = overlays.clip_plan(spans, audio, segments, durations).orderBy("seg_index").collect()
    assert [(r.chunk, r.seg_index, r.start, r.end, r.interpolated) for r in got] == [(1, 0, 0.0, 1.0, False), (1, 1, 1.0, 1.75, False), (1, 2, 1.75, 2.0, True), (1, 3, 2.0, 3.0, False), (1, 4, 3.0, 9.0, False)]


def test_package(spark, tmp_path):
    manifest = spark.createDataFrame([("b", "a", "t/a.xhtml", "application/xhtml+xml", "OPS/t/a.xhtml"), ("b", "audio_001.m4a", "old", None, "OPS/old"), ("b", "x", "toc.ncx", "application/x-dtbncx+xml", "OPS/toc.ncx")], "book string, id string, href string, media_type string, path string")
    pages = spark.createDataFrame([("b", "OPS/t/a.xhtml")], "book string, path string")
    chunks = spark.createDataFrame([("b", "002.mp3")], "book string, chunk_file string")
    clips = spark.createDataFrame([("b", "OPS/t/a.xhtml", 0.0, 61.5)], "book string, path string, start double, end double")
    rows = [r.asDict() for r in overlays.package_rows(manifest, pages, chunks, clips).collect()]
    document, extra = packaging.finish_document(OPF, "OPS/book.opf", rows, {"OPS/toc.ncx": NCX})
    for part in ('version="3.0"', 'media-overlay="html_overlay.ops_t_a"', 'href="../audio/002.mp3"', 'href="../smil/ops_t_a.smil"', 'refines="#html_overlay.ops_t_a">0:01:01.500<', 'id="generated_nav"', 'href="readaloud.css"'):
        assert part in document, part
    assert "audio_001" not in document and document.count("media:duration") == 2 and "One" in extra["OPS/nav.xhtml"]
    path = tmp_path / "b.epub"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("OPS/book.opf", OPF)
    packaging.assemble(str(path), {"audio/002.mp3": b"x"}, {"OPS/book.opf": document} | extra)
    with zipfile.ZipFile(path) as z:
        assert sorted(z.namelist()) == ["OPS/book.opf", "OPS/nav.xhtml", "audio/002.mp3"]


def test_joins_on_names(spark):
    used = spark.createDataFrame([("class", "a"), ("class", "b"), ("id", "q")], "kind string, name string")
    known = spark.createDataFrame([("class", "a")], "kind string, name string")
    assert [tuple(r) for r in overlays.unused_names(used, known).collect()] == [("class", "b")]
    assert overlays.missing_entries(used, known, ["kind", "name"]).count() == 2
    pages = spark.createDataFrame([(1, '<span id="c1-segment2">'), (1, "<p>"), (2, "<i id='cx-segment1'>")], "book int, html string")
    assert {r.book: r.marked for r in overlays.all_marked(pages, "book", "html").collect()} == {1: False, 2: True}


@pytest.mark.parametrize("bad", [{"audio_bitrate": "64k"}, {"chunk_seconds": 0}, {"audio_codec": "aac", "audio_channels": -1}, {"audio_codec": "x"}, {"split_jobs": 0}])
def test_settings_are_checked(bad):
    with pytest.raises(ValueError):
        config.RunConfig(**bad)


def test_settings_and_state(tmp_path):
    aac, copy = config.RunConfig(audio_codec="aac").resolved(), config.RunConfig().resolved()
    assert aac["audio_channels"] == config.AAC_CHANNELS and copy["audio_bitrate"] is None and copy["split_jobs"] == 1
    audio = tmp_path / "a.m4a"
    audio.write_bytes(b"x")
    run = config.RunConfig(audio=str(audio))
    state, mode = config.initial_state(run, None)
    assert mode == "new" and config.initial_state(run, state) == (state, "resume")
    audio.write_bytes(b"xy")
    assert config.initial_state(run, state)[1] == "reset"
    assert config.file_digest(audio)["size"] == 2 and config.file_fingerprint(tmp_path / "none") is None


def test_run_paths_and_preflight(tmp_path):
    audio, book = tmp_path / "a.mp3", tmp_path / "b.epub"
    run = config.RunConfig(audio=str(audio), book=str(book))
    paths = config.paths_of(run, tmp_path / "w", tmp_path / "out.epub")
    assert paths.package.name == "b.epub" and paths.state.name == "state.json" and paths.work == tmp_path / "w" / "run"
    with pytest.raises(FileNotFoundError):
        config.preflight(run)
    audio.write_bytes(b"x")
    book.write_bytes(b"x")
    config.preflight(run)
    with pytest.raises(ValueError):
        config.preflight(config.RunConfig(audio=str(audio), book=str(audio)))
    with pytest.raises(ValueError):
        config.preflight(config.RunConfig(audio=str(audio), book=str(book), backend="nobody"))
    assert "kept" in config.describe_mode("reset") and config.describe_mode("x") == "new run"


def test_recovered_books(spark):
    books = spark.createDataFrame([("a", "a.mp3", "a.epub"), ("b", "b.mp3", "b.epub"), ("c", "c.mp3", "c.epub")], "book string, audio string, epub string")
    files = spark.createDataFrame([("a", "a.mp3"), ("a", "a.epub"), ("b", "b.mp3"), ("c", "c.mp3"), ("c", "c.epub"), ("c", "001.json"), ("c", "000.json")], "book string, name string")
    copies = spark.createDataFrame([("a", "a.epub3", "OPS/x.opf", 1), ("b", "b.epub3", "x.opf", 0), ("c", "c.epub3", None, None)], "book string, name string, opf string, depth int")
    assert [tuple(r) for r in packages.recovered(books, files, copies).collect()] == [("a", "a.mp3", "a.epub", "a.epub3", "OPS/x.opf", "OPS", 1)]
    assert [(r.name, r.position) for r in packages.transcript_files(files, "book", "name").orderBy("position").collect()] == [("000.json", 0), ("001.json", 1)]


def test_recognisers(spark):
    import pandas as pd

    def shout(frames):
        for f in frames:
            yield pd.DataFrame({"chunk": f["chunk"], "word": f["content"].str.upper(), "start": 0.0, "end": 1.0})

    config.register_recogniser("shout", shout)
    chunks = spark.createDataFrame([(1, "hi")], "chunk long, content string")
    assert config.transcribe(chunks, "shout").select("word").first().word == "HI" and "shout" in config.recognisers()
    with pytest.raises(ValueError):
        config.transcribe(chunks, "none")
    assert chunks.select(F.lit(1)).count() == 1
