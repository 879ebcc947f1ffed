"""Class and id names that stylesheets, scripts, links and relations refer to."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from lectern.functions.frames import spread

from .markup import Node, parse

# Properties without effect in horizontal text, and attributes that list ids.
INERT = frozenset({"-webkit-text-combine", "text-combine-upright"})
ID_LISTS = ("aria-labelledby", "aria-describedby", "aria-owns", "headers")

_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_STRING = r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'"
_NAME = r"-?(?:[A-Za-z_]|[^\x00-\x7F]|\\.)(?:[\w-]|[^\x00-\x7F]|\\.)*|--[\w-]*"
_PART = re.compile(rf"(?P<string>{_STRING})|#(?P<id>[\w-]+|[^\x00-\x7F]+)|\.(?P<cls>{_NAME})|(?P<box>\[)|(?P<call>\()|.", re.S)
_INNER = re.compile(rf"(?P<string>{_STRING})|(?P<name>{_NAME})", re.S)
_SCAN = re.compile(rf"{_STRING}|[{{}};]", re.S)
_DECLARATION = re.compile(r"(?:[^;\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))+")
_FRAGMENT = re.compile(r"#([^#\s\"']+)")
_WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_-]+")

Names = set[tuple[str, str]]


def rules(css: str) -> Iterator[tuple[str, str]]:
    """(prelude, block) of the top-level rules; statements without a block are skipped."""
    css = _COMMENT.sub(" ", css)
    depth, start, opened = 0, 0, 0
    for m in _SCAN.finditer(css):
        c = m.group()
        if c == "{":
            if not depth:
                opened = m.end()
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                yield css[start : opened - 1].strip(), css[opened : m.start()]
                start = m.end()
        elif c in ";}" and not depth:
            start = m.end()
    if depth:
        yield css[start : opened - 1].strip(), css[opened:]


def styles_something(block: str) -> bool:
    """Whether a declaration block has a property that shows."""
    names = (d.partition(":") for d in _DECLARATION.findall(block))
    return any(colon and name.strip() and name.strip().lower() not in INERT for name, colon, _ in names)


def selector_names(selector: str) -> Names:
    """Classes and ids of a selector; words and strings of an attribute test count as both, arguments of pseudo-classes as neither."""
    out: Names = set()
    at = 0
    while m := _PART.match(selector, at):
        at = m.end()
        if m["id"]:
            out.add(("id", m["id"]))
        elif m["cls"]:
            out.add(("class", m["cls"].replace("\\", "")))
        elif m["box"] or m["call"]:
            close = "]" if m["box"] else ")"
            end, depth = at, 1
            while end < len(selector) and depth:
                depth += (selector[end] == m.group()) - (selector[end] == close)
                end += 1
            if m["box"]:
                for inner in _INNER.finditer(selector, at, end):
                    word = inner["name"] or inner["string"][1:-1]
                    out |= {("class", word), ("id", word)}
            at = end
    return out


def css_names(css: str) -> Names:
    out: Names = set()
    for prelude, block in rules(css):
        if prelude.startswith("@"):
            out |= css_names(block)
        elif styles_something(block):
            out |= selector_names(prelude)
    return out


def script_names(script: str) -> Names:
    return {(kind, word) for word in _WORD.findall(script) for kind in ("class", "id")}


def fragment_names(markup: str) -> Names:
    return {("id", name) for name in _FRAGMENT.findall(markup)}


def _inner_text(node: Node) -> str:
    return "".join(node.strings())


def html_names(markup: str) -> Names:
    out = fragment_names(markup)
    for node in parse(markup).elements():
        if node.name == "style":
            out |= css_names(_inner_text(node))
        elif node.name == "script":
            out |= script_names(_inner_text(node))
        for attr in ID_LISTS:
            out |= {("id", name) for name in (node.attrs.get(attr) or "").split()}
        if node.name == "label" and node.attrs.get("for"):
            out.add(("id", node.attrs["for"]))
    return out


def own_names(markup: str) -> dict[str, frozenset]:
    """Names a page refers to itself, for pages that stand alone."""
    found = html_names(markup)
    return {kind: frozenset(name for k, name in found if k == kind) for kind in ("class", "id")}


_BY_KIND = {"css": css_names, "js": script_names, "html": html_names, "ncx": fragment_names}


def reference_names(sources: DataFrame, kind: str = "kind", content: str = "content") -> DataFrame:
    """Distinct (kind, name) that the sources (kind css, js, html or ncx, and content) refer to."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found: Names = set()
            for k, c in zip(f[kind], f[content], strict=True):
                if c and k in _BY_KIND:
                    found |= _BY_KIND[k](c)
            yield pd.DataFrame(sorted(found), columns=["kind", "name"])

    return spread(sources.select(kind, content)).mapInPandas(run, "kind string, name string").distinct()
