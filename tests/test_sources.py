import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.operators import audits
from lectern.sources import archives, navigation, smil, transcripts
from lectern.streaming import arrivals

OPF = """<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="a" href="t/a.xhtml" media-type="application/xhtml+xml"/><item id="n" href="nav.xhtml" properties="nav"/></manifest>
<spine><itemref idref="a"/></spine><guide><reference type="toc" href="t/a.xhtml#x"/></guide></package>"""
NCX = """<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap><navPoint><navLabel><text>One</text></navLabel><content src="a.xhtml"/>
<navPoint><navLabel><text>Inner &amp; more</text></navLabel><content src="a.xhtml#i"/></navPoint></navPoint><navPoint><content src="lost.xhtml"/></navPoint></navMap></ncx>"""


@pytest.fixture
def package(tmp_path):
    path = tmp_path / "book.epub"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("OPS/x/book.opf", OPF)
        z.writestr("OPS/a.xhtml", "<p>a</p>")
    return path


def test_zip_source(spark, package):
    archives.register(spark)
    rows = spark.read.format("zip_members").load(str(package))
    assert [(r.pos, r.entry) for r in rows.orderBy("pos").collect()] == [(0, "mimetype"), (1, "OPS/x/book.opf"), (2, "OPS/a.xhtml")]
    assert archives.package_document(rows).select("opf", "depth").first() == ("OPS/x/book.opf", 2)
    again = archives.members_of(spark.read.format("binaryFile").load(str(package)))
    assert again.select(archives.member_text(F.col("content"))).count() == 3


def test_rewriting(package, tmp_path):
    archives.rewrite_archive(package, {"OPS/a.xhtml": b"new", "OPS/b": b"b"}, {"OPS/x/book.opf"})
    with zipfile.ZipFile(package) as z:
        assert z.namelist() == ["mimetype", "OPS/a.xhtml", "OPS/b"] and z.read("OPS/a.xhtml") == b"new"
    archives.write_json(tmp_path / "s.json", {"b": "é", "a": 1})
    assert (tmp_path / "s.json").read_text() == '{\n  "a": 1,\n  "b": "é"\n}'
    assert archives.read_json(tmp_path / "none.json", {}) == {}
    assert archives.reset_derived(tmp_path, {"book.epub"}) == ["s.json"]
    assert archives.decoded(b"\xe9") == "é" and archives.relative_href("OPS/x/a", "OPS/b") == "../b"


def test_navigation(spark):
    assert [r[6] for r in navigation.manifest_rows(OPF, "OPS")] == ["OPS/t/a.xhtml", "OPS/nav.xhtml"]
    assert navigation.spine_rows(OPF) == [(0, "a")]
    assert navigation.guide_paths(OPF, "OPS") == {"OPS/t/a.xhtml", "OPS/nav.xhtml"}
    rows = navigation.nav_rows(NCX)
    assert [(r[0], r[1], r[2], r[4]) for r in rows] == [(0, None, 0, "One"), (1, 0, 1, "Inner & more")]
    assert '<li><a href="a.xhtml">One</a><ol><li><a href="a.xhtml#i">Inner &amp; more</a></li></ol></li>' in navigation.render_nav(rows)
    frame = spark.createDataFrame([(1, NCX), (2, "<broken")], "k int, ncx string")
    assert navigation.parse_navigation(frame, "k", "ncx").count() == 2


def test_contents_pages(spark):
    documents = spark.createDataFrame([("b", "OPS/x.opf", OPF), ("c", "x.opf", "<broken"), ("d", "x.opf", None)], "book string, opf string, xml string")
    assert sorted(tuple(r) for r in navigation.contents_pages(documents).collect()) == [("b", "OPS/nav.xhtml"), ("b", "OPS/t/a.xhtml")]


def test_overlays_round_trip(spark):
    clips = spark.createDataFrame([("k", 0, "t.xhtml", "s1", "a.mp3", 0.0, 1.25), ("k", 1, "t.xhtml", "s2", "a.mp3", 1.25, 1.25)], "k string, o int, href string, seg_id string, audio_file string, start double, end double")
    xml = smil.render_overlays(clips, "k", "href", "o")
    assert [(r.par_id, r.audio_file, r.begin_raw, r.end_raw) for r in smil.clip_rows(xml, "k", "xml").collect()] == [("par0", "a.mp3", "0.000s", "1.250s")]
    odd = spark.createDataFrame([("k", '<smil><body><seq><par id="p"><audio src="x/a.mp3" clipEnd="1s"/></par></seq></body></smil>')], "k string, xml string")
    got = audits.parse_clips(smil.clip_rows(odd, "k", "xml")).first()
    assert (got.audio_file, got.problem) == ("a.mp3", "begin")


def test_transcripts(spark, tmp_path):
    rows = spark.createDataFrame(
        [
            (1, '{"word_segments":[{"word":"Well-known","start":1,"end":2},{"word":"x"}]}'),
            (2, '{"segments":[{"words":[{"word":"a","start":0,"end":1}]},{"words":null}]}'),
            (3, '{"word_segments":[],"segments":[{"words":[{"word":"a","start":0,"end":1}]}]}'),
            (4, "{broken"),
        ],
        "k int, j string",
    )
    got = transcripts.audio_tokens(transcripts.parse_transcripts(rows, "k", "j"), "k").orderBy("k", "idx").collect()
    assert [(r.k, r.idx, r.token, r.word, r.start) for r in got] == [(1, 0, "well", "Well-known", 1.0), (1, 1, "known", "Well-known", 1.0), (2, 0, "a", "a", 0.0)]
    (tmp_path / "t.json").write_text('{"word_segments":[{"word":"a","start":0,"end":1}]}')
    assert transcripts.read_transcripts(spark, str(tmp_path / "t.json")).count() == 1


def test_forward_gate_over_batches(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "book string, chunk long, html_order long"
    spark.createDataFrame([("b", 1, 5), ("b", 2, 3), ("c", 1, 0)], schema).coalesce(1).write.parquet(source)
    for rows in (None, [("b", 3, 6)]):
        if rows:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        query = arrivals.forward_gate(spark.readStream.schema(schema).parquet(source)).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
    got = {(r.book, r.chunk): r.forward for r in spark.read.parquet(out).collect()}
    assert got == {("b", 1): True, ("b", 2): False, ("b", 3): True, ("c", 1): True}
