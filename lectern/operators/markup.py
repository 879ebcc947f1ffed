"""A small HTML tree on the standard parser: text, cleaning, segment marking.

Broken markup is repaired by implied end tags for paragraphs, list items, table
parts, definition lists and options; stray end tags are dropped and what stays
open is closed at the end.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

from lectern.functions.frames import bounded_batches, in_frames

from .segmentation import segment_spans

# Element groups.
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ATOMIC = frozenset("br img hr wbr area col embed input link meta param source track script style svg math object iframe".split())
INLINE = frozenset("a abbr b bdi bdo big button cite code data del dfn em font i ins kbd label mark output q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
POSITIONAL = frozenset("td th tr li dt dd option colgroup thead tbody tfoot".split())
MARKED = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote div dd dt figcaption".split())
BLOCKS = frozenset("div p h1 h2 h3 h4 h5 h6 ul ol li blockquote table tr td dl dd dt section article nav aside header footer figure figcaption".split())
_CLOSED_BY = {
    "p": BLOCKS | {"pre", "form", "fieldset", "hr", "main", "address"},
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"},
    "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "tr": {"tr", "tbody", "tfoot"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"},
}
_SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}, "thead": {"table"}, "tbody": {"table"}, "option": {"select"}, "p": {"table", "td", "th", "body", "html", "button"}}

#: By start tag: the open elements that it ends, and those that shield what lies outside them.
_ENDS = {tag: tuple(k for k, tags in _CLOSED_BY.items() if tag in tags) for tag in set().union(*_CLOSED_BY.values())}
_SHIELDS = {tag: tuple(set().union(*(_SCOPE.get(k, set()) for k in ended))) for tag, ended in _ENDS.items()}


@dataclass(eq=False)
class Node:
    """An element, or with an empty name a text, comment or declaration."""

    name: str = ""
    attrs: dict[str, str | None] = field(default_factory=dict)
    children: list[Node] = field(default_factory=list)
    text: str = ""
    kind: str = "element"

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.children))

    def elements(self) -> Iterator[Node]:
        return (n for n in self.walk() if n.kind == "element" and n is not self)

    def strings(self) -> Iterator[str]:
        return (n.text for n in self.walk() if n.kind == "text")


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.open = [self.root]
        self.depths: dict[str, list[int]] = {}  # of the open elements, by name

    def _add(self, node: Node) -> Node:
        self.open[-1].children.append(node)
        return node

    def _innermost(self, names: tuple[str, ...]) -> int:
        """Depth of the innermost open element of these names, 0 without one."""
        return max((self.depths[n][-1] for n in names if self.depths.get(n)), default=0)

    def _close(self, depth: int) -> None:
        while len(self.open) > depth:
            self.depths[self.open.pop().name].pop()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        ended = self._innermost(_ENDS.get(tag, ()))
        if ended and ended >= self._innermost(_SHIELDS[tag]):
            self._close(ended)
        node = self._add(Node(tag, dict(attrs)))
        if tag not in EMPTY:
            self.depths.setdefault(tag, []).append(len(self.open))
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self._add(Node(tag, dict(attrs)))

    def handle_endtag(self, tag: str) -> None:
        depth = self._innermost((tag,))
        if depth:
            self._close(depth)

    def handle_data(self, data: str) -> None:
        self._add(Node(text=data, kind="text"))

    def handle_comment(self, data: str) -> None:
        self._add(Node(text=data, kind="comment"))

    def handle_decl(self, decl: str) -> None:
        self._add(Node(text=decl, kind="decl"))

    def handle_pi(self, data: str) -> None:
        self._add(Node(text=data, kind="pi"))


def parse(markup: str) -> Node:
    builder = _Builder()
    builder.feed(markup)
    builder.close()
    return builder.root


def _tag(node: Node) -> str:
    return "<" + node.name + "".join(f" {k}" if v is None else f' {k}="{html.escape(v)}"' for k, v in node.attrs.items())


_WRAP = {"comment": ("<!--", "-->"), "decl": ("<!", ">"), "pi": ("<?", ">")}


def serialise(root: Node) -> str:
    out: list[str] = []
    stack: list[Node | str] = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            out.append(node)
        elif node.kind == "text":
            out.append(html.escape(node.text, quote=False))
        elif node.kind != "element":
            out.append(node.text.join(_WRAP[node.kind]))
        elif not node.name:
            stack.extend(reversed(node.children))
        elif node.name in EMPTY:
            out.append(_tag(node) + "/>")
        else:
            raw = node.name in ("script", "style")
            out.append(_tag(node) + ">")
            stack.append(f"</{node.name}>")
            stack.extend((c.text if raw and c.kind == "text" else c) for c in reversed(node.children))
    return "".join(out)


def visible_text(markup: str) -> str:
    """Texts outside scripts and styles, trimmed and joined by a space."""
    root = parse(markup)
    _drop(root, lambda n: n.name in ("script", "style"))
    return " ".join(t.strip() for t in root.strings() if t.strip())


def _drop(root: Node, test) -> None:
    for node in list(root.walk()):
        node.children = [c for c in node.children if c.kind != "element" or not test(c)]


def clean(root: Node, classes: frozenset | None, ids: frozenset | None) -> None:
    """Strip class and id names nothing refers to, unwrap bare spans, remove empty bare elements.

    None for a set means that it is not known, so nothing of that kind is stripped.
    Elements with an inline style keep their attributes; void and positional
    elements and anchors stay even when empty.
    """
    for node in root.elements():
        if "style" in node.attrs:
            continue
        if classes is not None and node.attrs.get("class"):
            names = node.attrs["class"].split()
            used = [n for n in names if n in classes]
            if not used:
                del node.attrs["class"]
            elif len(used) < len(names):
                node.attrs["class"] = " ".join(used)
        if ids is not None and node.attrs.get("id") and node.attrs["id"] not in ids:
            del node.attrs["id"]
    for node in list(root.walk())[::-1]:
        node.children = [g for c in node.children for g in (c.children if c.kind == "element" and c.name == "span" and not c.attrs else [c])]

    def inert(n: Node) -> bool:
        if n.name in ATOMIC or n.name == "a" or n.name in POSITIONAL or n.attrs:
            return False
        return not any(c.kind == "element" or (c.kind == "text" and c.text.strip()) for c in n.children)

    for node in list(root.walk()):  # from the outside in: a parent is judged before its children go
        node.children = [c for c in node.children if c.kind != "element" or not inert(c)]


@dataclass
class _Piece:
    """One character, or one atomic element at a placeholder character."""

    char: str
    node: Node | None
    around: _Around | None


@dataclass(eq=False)
class _Around:
    """An inline element and, further out, those around it; siblings share the chain."""

    node: Node
    outer: _Around | None


def _linear(block: Node) -> tuple[list[_Piece], dict[int, list[_Piece]]]:
    """The block's characters with their inline elements, and empty anchors by position."""
    pieces: list[_Piece] = []
    anchors: dict[int, list[_Piece]] = {}
    stack: list[tuple[Node, _Around | None]] = [(c, None) for c in reversed(block.children)]
    while stack:
        node, around = stack.pop()
        if node.kind == "text":
            pieces.extend(_Piece(c, None, around) for c in node.text)
        elif node.kind != "element":
            continue
        elif node.name in ATOMIC:
            pieces.append(_Piece("\n" if node.name == "br" else " ", node, around))
        elif node.name == "a" and not node.children and (node.attrs.get("id") or node.attrs.get("name")):
            anchors.setdefault(len(pieces), []).append(_Piece("", Node("a", dict(node.attrs)), around))
        else:
            inner = _Around(node, around) if node.name in INLINE else around
            stack.extend((c, inner) for c in reversed(node.children))
    return pieces, anchors


def _wrapped(node: Node, around: _Around | None) -> Node:
    while around:
        node = Node(around.node.name, dict(around.node.attrs), [node])
        around = around.outer
    return node


def _segment(pieces: list[_Piece], anchors: dict[int, list[_Piece]], a: int, b: int, name: str) -> Node:
    out = Node("span", {"id": name})
    put = lambda position: out.children.extend(_wrapped(p.node, p.around) for p in anchors.pop(position, ()))
    i = a
    while i < b:
        put(i)
        piece = pieces[i]
        if piece.node is not None:
            out.children.append(_wrapped(piece.node, piece.around))
            i += 1
            continue
        j = i + 1
        while j < b and pieces[j].node is None and pieces[j].around is piece.around and j not in anchors:
            j += 1
        run = Node(text="".join(p.char for p in pieces[i:j]), kind="text")
        out.children.append(_wrapped(run, piece.around) if run.text.strip() else run)
        i = j
    put(b)
    return out


def mark(root: Node, prefix: str, min_words: int = 1) -> list[tuple[str, str]]:
    """Wrap the segments of every block without inner blocks in numbered spans; (id, text) of each in order."""
    found: list[tuple[str, str]] = []
    for block in [n for n in root.elements() if n.name in MARKED]:
        if any(c.kind == "element" and c.name in BLOCKS for c in block.children):
            continue
        pieces, anchors = _linear(block)
        text = "".join(p.char for p in pieces)
        if not text.strip():
            continue
        spans = []
        for a, b in segment_spans(text, min_words):
            name = f"c{prefix}-segment{len(found) + 1}"
            spans.append(_segment(pieces, anchors, a, b, name))
            found.append((name, text[a:b]))
        block.children = spans
    return found


def _settled(text: str) -> str:
    return "\n".join(x for x in (re.sub(r"\s+", " ", line).strip() for line in text.splitlines()) if x)


def first_difference(before: Node, after: Node) -> int | None:
    """Position where the visible texts of two trees part, None if they agree up to white space."""
    a, b = (_settled("".join(n.strings())) for n in (before, after))
    if a == b:
        return None
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def cleaned(markup: str, classes: frozenset | None = None, ids: frozenset | None = None) -> str:
    root = parse(markup)
    clean(root, classes, ids)
    return serialise(root)


def marked(markup: str, prefix: str, classes: frozenset | None = None, ids: frozenset | None = None, min_words: int = 1) -> tuple[str, list[tuple[str, str]]]:
    """Cleaned and marked markup and its segments; raises if the visible text changed."""
    markup = cleaned(markup, classes, ids)
    root = parse(markup)
    found = mark(root, prefix, min_words)
    if (at := first_difference(parse(markup), root)) is not None:
        raise ValueError(f"text of {prefix} changed at character {at}")
    return serialise(root), found


def add_stylesheet(root: Node, href: str) -> None:
    """A link to the stylesheet at the end of the head, unless it is there or the page has no head."""
    head = next((n for n in root.elements() if n.name == "head"), None)
    if head is None:
        return
    linked = (n for n in head.elements() if n.name == "link" and n.attrs.get("href") == href)
    if not any("stylesheet" in (n.attrs.get("rel") or "").split() for n in linked):
        head.children.append(Node("link", {"rel": "stylesheet", "href": href, "type": "text/css"}))


def marked_segments(markup: str) -> list[tuple[str, str]]:
    """(id, text) of the elements of a marked page whose id names a segment, in their order."""
    return [(n.attrs["id"], "".join(n.strings())) for n in parse(markup).elements() if "-segment" in (n.attrs.get("id") or "")]


def page_texts(pages: DataFrame, key: str, markup: str = "html") -> DataFrame:
    """(key, text): visible text of each page."""
    kind = pages.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((k, visible_text(m or "")) for f in frames for k, m in zip(f[key], f[markup], strict=True))
        yield from in_frames(rows, [key, "text"])

    return bounded_batches(pages.select(key, markup)).mapInPandas(run, f"{key} {kind}, text string")


#: The names that a page's package refers to: by kind, or worked out from the page itself.
Known = dict[str, frozenset | None] | Callable[[str], dict[str, frozenset | None]]


def _names(known: Known, markup: str) -> tuple[frozenset | None, frozenset | None]:
    names = known(markup) if callable(known) else known
    return names.get("class"), names.get("id")


def clean_pages(pages: DataFrame, key: str, known: Known, markup: str = "html") -> DataFrame:
    """(key, html) cleaned against the referenced names."""
    kind = pages.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((k, cleaned(m or "", *_names(known, m or ""))) for f in frames for k, m in zip(f[key], f[markup], strict=True))
        yield from in_frames(rows, [key, "html"])

    return bounded_batches(pages.select(key, markup)).mapInPandas(run, f"{key} {kind}, html string")


def mark_pages(pages: DataFrame, key: str, known: Known, markup: str = "html") -> DataFrame:
    """(key, seg_index, seg_id, text, error) of every page's segments; a page that fails gives one row with its error."""
    kind = pages.schema[key].dataType.simpleString()

    def one(k: object, m: str) -> list[tuple]:
        try:
            return [(k, i, name, text, None) for i, (name, text) in enumerate(marked(m, str(k), *_names(known, m))[1])]
        except ValueError as error:
            return [(k, None, None, None, str(error))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for f in frames for k, m in zip(f[key], f[markup], strict=True) for r in one(k, m or ""))
        for out in in_frames(rows, [key, "seg_index", "seg_id", "text", "error"]):
            yield out.astype({"seg_index": "Int32"})

    return bounded_batches(pages.select(key, markup)).mapInPandas(run, f"{key} {kind}, seg_index int, seg_id string, text string, error string")


def mark_documents(pages: DataFrame, keys: list[str], prefix: str, known: Known, stylesheet: str, markup: str = "html") -> DataFrame:
    """(keys, html, error): every page cleaned, marked and linked to the stylesheet; a page whose text would change keeps its markup and says so.

    `prefix` and `stylesheet` name the columns with a page's segment prefix and
    its link to the stylesheet.
    """
    kinds = ", ".join(f"{k} {pages.schema[k].dataType.simpleString()}" for k in keys)

    def one(text: str, name: str, href: str) -> tuple[str, str | None]:
        try:
            root = parse(marked(text, name, *_names(known, text))[0])
        except ValueError as error:
            return text, str(error)
        add_stylesheet(root, href)
        return serialise(root), None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((*key, *one(m or "", n, h)) for f in frames for *key, n, h, m in f[[*keys, prefix, stylesheet, markup]].itertuples(index=False))
        yield from in_frames(rows, [*keys, "html", "error"])

    return bounded_batches(pages.select(*keys, prefix, stylesheet, markup)).mapInPandas(run, f"{kinds}, html string, error string")


def read_segments(pages: DataFrame, keys: list[str], markup: str = "html") -> DataFrame:
    """(keys, seg_index, seg_id, text) of the segments that marked pages carry."""
    kinds = ", ".join(f"{k} {pages.schema[k].dataType.simpleString()}" for k in keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((*key, i, *s) for f in frames for *key, m in f[[*keys, markup]].itertuples(index=False) for i, s in enumerate(marked_segments(m or "")))
        yield from in_frames(rows, [*keys, "seg_index", "seg_id", "text"])

    return bounded_batches(pages.select(*keys, markup)).mapInPandas(run, f"{kinds}, seg_index int, seg_id string, text string")
