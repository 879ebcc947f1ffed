"""A set of books from source packages to finished ones, and what of an earlier run can be kept."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.operators import lineage, reuse
from lectern.plans import stages
from lectern.sources import archives

OPF = """<package xmlns="http://www.idpf.org/2007/opf" version="2.0"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>Two pages</dc:title></metadata>
<manifest><item id="b" href="two.xhtml" media-type="application/xhtml+xml"/><item id="a" href="one.xhtml" media-type="application/xhtml+xml"/><item id="x" href="toc.ncx" media-type="application/x-dtbncx+xml"/></manifest>
<spine><itemref idref="a"/><itemref idref="b"/></spine></package>"""
NCX = '<ncx><navMap><navPoint><navLabel><text>One</text></navLabel><content src="one.xhtml"/></navPoint></navMap></ncx>'
SETTINGS = "book string, settings struct<audio_extension:string,audio_codec:string,audio_bitrate:string,audio_sample_rate:int,audio_channels:int,chunk_seconds:int,backend:string,model:string,language:string>"


def page(words):
    text = "".join(f"<p>{' '.join(words[i:i + 20])}.</p>" for i in range(0, len(words), 20))
    return f"<html><head><title>t</title></head><body>{text}</body></html>"


@pytest.fixture(scope="module")
def books():
    rng = random.Random(8)
    return {b: [[f"word{rng.randrange(4000)}" for _ in range(200)] for _ in range(2)] for b in ("alpha.epub", "beta.epub")}


@pytest.fixture(scope="module")
def done(spark, books, tmp_path_factory):
    folder = tmp_path_factory.mktemp("packages")
    members, words = [], []
    for book, pages in books.items():
        entries = [("mimetype", "application/epub+zip"), ("OPS/book.opf", OPF), ("OPS/one.xhtml", page(pages[0])), ("OPS/two.xhtml", page(pages[1])), ("OPS/toc.ncx", NCX)]
        members += [(book, i, name, bytearray(text.encode())) for i, (name, text) in enumerate(entries)]
        for chunk, spoken in enumerate(pages):
            words += [(book, chunk, i, w, i * 0.5, i * 0.5 + 0.4) for i, w in enumerate(spoken)]
    tables = {
        "members": spark.createDataFrame(members, "book string, pos int, entry string, content binary"),
        "settings": spark.createDataFrame([(b, (".mp3", "copy", None, None, None, 100, "x", "m", "en")) for b in books], SETTINGS),
        "durations": spark.createDataFrame([(b, 200.0) for b in books], "book string, seconds double"),
        "chapters": spark.createDataFrame([], "book string, start double, end double"),
        "audio": spark.createDataFrame([(b, f"00{k}.mp3", bytearray(b"sound")) for b in books for k in (1, 2)], "book string, name string, content binary"),
        "words": spark.createDataFrame(words, "book string, chunk int, idx int, word string, start double, end double"),
    }
    work = tmp_path_factory.mktemp("work")

    def keep(frame, name):
        frame.write.parquet(f"{work}/{name}")
        return spark.read.schema(frame.schema).parquet(f"{work}/{name}")

    return folder, stages.run(**tables, folder=f"file://{folder}", keep=keep)


def test_pages_in_reading_order(done):
    assert [(r.book, r.html_order, r.path) for r in done[1]["pages"].orderBy("book", "html_order").collect()][:2] == [("alpha.epub", 0, "OPS/one.xhtml"), ("alpha.epub", 1, "OPS/two.xhtml")]


def test_every_chunk_finds_its_page(done):
    spans = done[1]["spans"].orderBy("book", "chunk").collect()
    assert [(r.book, r.chunk, r.html_order, r.reason) for r in spans if r.span_index == 0] == [(b, c, c, "ok") for b in ("alpha.epub", "beta.epub") for c in (0, 1)]


def test_clips_cover_every_segment(done, books):
    clips = done[1]["clips"]
    assert clips.groupBy("book", "path").count().where("count = 10").count() == 4
    totals = clips.groupBy("book", "chunk").agg(F.sum(F.col("end") - F.col("start")).alias("s")).collect()
    assert all(r.s == pytest.approx(100.0) for r in totals)


def test_finished_packages(done):
    folder, tables = done
    assert tables["written"].count() == 2
    with zipfile.ZipFile(folder / "alpha.epub") as z:
        names = z.namelist()
        assert names[0] == "mimetype" and z.getinfo("mimetype").compress_type == zipfile.ZIP_STORED
        assert {"audio/001.mp3", "audio/002.mp3", "smil/ops_one.smil", "smil/ops_two.smil", "OPS/readaloud.css", "OPS/nav.xhtml"} <= set(names)
        opf, html, overlay = (z.read(n).decode() for n in ("OPS/book.opf", "OPS/one.xhtml", "smil/ops_one.smil"))
    assert opf.index('id="a"') > opf.index('id="b"') and opf.count("media-overlay=") == 2 and ">0:03:20.000<" in opf
    assert 'id="cseg_ops_one-segment1"' in html.replace("'", '"') and 'rel="stylesheet"' in html
    assert overlay.count("<par ") == 10 and "../audio/001.mp3" in overlay and "../OPS/one.xhtml#" in overlay


def test_checks_pass(done):
    assert done[1]["checks"].where("NOT ok").count() == 0


def test_plan_and_reuse(spark, done):
    settings = spark.createDataFrame([("a", (".m4a", "aac", "64k", 24000, 1, 60, "x", "m", "en"))], SETTINGS)
    durations = spark.createDataFrame([("a", 130.0)], "book string, seconds double")
    chapters = spark.createDataFrame([], "book string, start double, end double")
    plan = stages.split(settings, durations, chapters)
    assert [(r.name, r.start, r.end, r.action) for r in plan.orderBy("chunk").collect()] == [("001.m4a", 0.0, 60.0, "create"), ("002.m4a", 60.0, 120.0, "create"), ("003.m4a", 120.0, 130.0, "create")]
    cut = plan.where("chunk < 2").select("book", "name", "stamp")
    assert [r.action for r in stages.split(settings, durations, chapters, cut).orderBy("chunk").collect()] == ["reuse", "reuse", "create"]
    other = settings.withColumn("settings", F.col("settings").withField("audio_bitrate", F.lit("96k")))
    assert [r.action for r in stages.split(other, durations, chapters, cut).orderBy("chunk").collect()] == ["regenerate", "regenerate", "create"]
    made = plan.join(settings, "book").select("book", "chunk", lineage.transcript_stamp(F.col("stamp")).alias("stamp"))
    words = spark.createDataFrame([("a", k, 0, f"w{k}", 0.0, 1.0) for k in range(3)], "book string, chunk int, idx int, word string, start double, end double")
    recognise = lambda rows: rows.select("book", "chunk", F.lit(0).alias("idx"), F.lit("new").alias("word"), F.lit(0.0).alias("start"), F.lit(1.0).alias("end"))
    heard = lambda plan_, settings_: {r.chunk: r.word for r in stages.transcribe(plan_, settings_, made, words, recognise).collect()}
    assert heard(plan, settings) == {0: "w0", 1: "w1", 2: "w2"}
    assert heard(plan, settings.withColumn("settings", F.col("settings").withField("model", F.lit("n")))) == {0: "new", 1: "new", 2: "new"}
    assert set(heard(stages.split(other, durations, chapters, cut), other).values()) == {"new"}  # the parent's stamp is inside


def verdicts(frame):
    return {r.book: r.valid for r in frame.collect()}


def test_verdicts(spark):
    books = spark.createDataFrame([("a",), ("b",), ("c",)], "book string")
    rows = lambda data, schema: spark.createDataFrame(data, schema)
    wanted = rows([("a", "1"), ("a", "2"), ("b", "1")], "book string, name string")
    assert verdicts(reuse.all_present(books, wanted, rows([("a", "1"), ("a", "2"), ("a", "3")], "book string, name string"), "name")) == {"a": True, "b": False, "c": False}
    assert verdicts(reuse.all_hold(books, rows([("a", True), ("b", True), ("b", None)], "book string, ok boolean"), F.col("ok"))) == {"a": True, "b": False, "c": False}
    found = rows([("a", "x"), ("a", "x"), ("a", "y"), ("b", "x")], "book string, json_file string")
    assert verdicts(reuse.matches_valid(books, found, rows([("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")], "book string, json_file string"))) == {"a": True, "b": False, "c": False}
    pages = rows([("a", "p"), ("b", "p")], "book string, path string")
    mark, bare = '<i id="cp-segment1">', "<p>"
    working = rows([("a", "p", bare), ("b", "p", bare)], "book string, path string, html string")
    assert verdicts(reuse.segments_valid(books, pages, working, rows([("a", "p", mark)], "book string, path string, html string"))) == {"a": True, "b": False, "c": False}
    chunks, drawn = rows([("a", "1"), ("b", "1")], "book string, name string"), rows([("a", "s")], "book string, name string")
    entries = rows([("a", "audio/1"), ("a", "smil/s"), ("b", "audio/1")], "book string, entry string")
    whole = reuse.package_valid(books, chunks, drawn, entries, rows([("a", True), ("b", False)], "book string, processed boolean"))
    assert verdicts(whole) == {"a": True, "b": False, "c": False}
    seen = reuse.validation_valid(books, rows([("a", "f"), ("b", "f")], "book string, fingerprint string"), rows([("a", "f"), ("b", "g"), ("c", "h")], "book string, fingerprint string"))
    assert verdicts(seen) == {"a": True, "b": False, "c": False}
    plan = {(r.book, r.stage): r.action for r in reuse.reconcile({"prepare": reuse.all_present(books, books.withColumn("name", F.lit("x")), books.withColumn("name", F.lit("x")), "name"), "match": seen, "package": whole}).collect()}
    assert plan["a", "package"] == "reuse" and plan["b", "prepare"] == "reuse" and plan["b", "match"] == plan["b", "package"] == "run"


def test_archives_read_back(spark, done):
    folder, _ = done
    archives.register(spark)
    rows = spark.read.format("zip_members").load(f"{folder}/alpha.epub,{folder}/beta.epub")
    assert rows.where("entry = 'mimetype'").count() == 2
    raw = (folder / "beta.epub").read_bytes()
    assert zipfile.ZipFile(io.BytesIO(raw)).testzip() is None
