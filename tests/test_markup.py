import pytest

from lectern.operators import references as R
from lectern.operators.markup import cleaned, first_difference, marked, parse, serialise, visible_text

NONE = frozenset()


@pytest.mark.parametrize(
    "markup, classes, ids, expected",
    [
        ('<p class="x">a</p>', NONE, NONE, "<p>a</p>"),
        ('<p class="x y">a</p>', frozenset({"y"}), NONE, '<p class="y">a</p>'),
        ('<p><span class="x">a</span></p>', NONE, NONE, "<p>a</p>"),
        ('<p id="q">a</p>', NONE, frozenset({"q"}), '<p id="q">a</p>'),
        ('<p id="q">a</p>', NONE, NONE, "<p>a</p>"),
        ('<p>a<b></b></p>', NONE, NONE, "<p>a</p>"),
        ('<p class="x" style="color:red">a</p>', NONE, NONE, '<p class="x" style="color:red">a</p>'),
        ('<p><a id="n"></a>a</p>', NONE, NONE, "<p><a></a>a</p>"),
        ("<table><tr><td></td><td>a</td></tr></table>", NONE, NONE, "<table><tr><td></td><td>a</td></tr></table>"),
        ("<p>a<br>b</p>", NONE, NONE, "<p>a<br/>b</p>"),
        ('<p class="x" id="q">a</p>', None, None, '<p class="x" id="q">a</p>'),
        ("<p>a &amp; b &lt; c</p>", NONE, NONE, "<p>a &amp; b &lt; c</p>"),
        ("", NONE, NONE, ""),
    ],
)
def test_cleaner(markup, classes, ids, expected):
    assert cleaned(markup, classes, ids) == expected


def test_open_elements_are_closed():
    assert serialise(parse("<p>a<p>b<ul><li>c<li>d</ul></b>")) == "<p>a</p><p>b</p><ul><li>c</li><li>d</li></ul>"


def test_visible_text_skips_scripts():
    assert visible_text("<style>p{}</style><p> a <b>b</b></p><script>x()</script>c") == "a b c"


def test_segments_keep_text_and_inline_markup():
    markup = "<div><p>One <em>two, three</em> four. Five<br/>six.</p><p> </p></div>"
    out, found = marked(markup, "k", NONE, NONE)
    assert [t for _, t in found] == ["One two, ", "three four. ", "Five\nsix."]
    assert [n for n, _ in found] == ["ck-segment1", "ck-segment2", "ck-segment3"]
    assert out.count("<em>") == 2 and out.count("<br/>") == 1
    assert first_difference(parse(markup), parse(out)) is None


def test_anchor_keeps_its_place():
    out, _ = marked('<p>One. <a id="n"></a>Two.</p>', "k", NONE, frozenset({"n"}))
    assert out.count('<a id="n"></a>') == 1


@pytest.mark.parametrize(
    "css, expected",
    [
        (".a{color:red}", {("class", "a")}),
        ("p.a#b > .c:not(.d) {margin:0}", {("class", "a"), ("id", "b"), ("class", "c")}),
        (".a{-webkit-text-combine:inherit}", set()),
        (".a{-webkit-text-combine:inherit;color:red}", {("class", "a")}),
        (".a{}", set()),
        ("@media x{.a{color:red} #b{top:0}}", {("class", "a"), ("id", "b")}),
        ('[class~="t"]{top:0}', {("class", "class"), ("id", "class"), ("class", "t"), ("id", "t")}),
        ("/* .z{top:0} */ @import 'u'; .a, .b{content:'}'}", {("class", "a"), ("class", "b")}),
    ],
)
def test_css_names(css, expected):
    assert R.css_names(css) == expected


def test_html_names():
    names = R.html_names('<a href="#f">x</a><label for="g">y</label><td headers="h i"></td><script>ab(c)</script><style>.s{top:0}</style>')
    assert {("id", "f"), ("id", "g"), ("id", "h"), ("id", "i"), ("class", "s"), ("id", "ab"), ("class", "ab")} <= names
    assert ("id", "c") not in names


def test_page_functions(spark):
    from lectern.operators.markup import clean_pages, mark_pages, page_texts

    pages = spark.createDataFrame([(1, "<p class='z'>One. Two.</p>"), (2, None)], "page_id long, html string")
    assert {r.page_id: r.text for r in page_texts(pages, "page_id").collect()} == {1: "One. Two.", 2: ""}
    assert {r.page_id: r.html for r in clean_pages(pages, "page_id", R.own_names).collect()} == {1: "<p>One. Two.</p>", 2: ""}
    assert [(r.seg_index, r.text) for r in mark_pages(pages, "page_id", {"class": None, "id": None}).collect()] == [(0, "One. "), (1, "Two.")]
    assert R.reference_names(pages.selectExpr("'html' AS kind", "html AS content")).count() == 0
