"""Package documents and navigation trees as rows, and their rendering."""

from __future__ import annotations

import html
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .archives import joined_href, relative_href


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def manifest_rows(opf: str, folder: str) -> list[tuple]:
    """(pos, id, href, media_type, properties, media_overlay, resolved_path) of a package document's items."""
    items = [e for e in ET.fromstring(opf).iter() if _local(e.tag) == "item"]
    return [(i, e.get("id"), e.get("href"), e.get("media-type"), e.get("properties"), e.get("media-overlay"), joined_href(folder, e.get("href")) if e.get("href") else None) for i, e in enumerate(items)]


def spine_rows(opf: str) -> list[tuple[int, str]]:
    refs = [e.get("idref") for e in ET.fromstring(opf).iter() if _local(e.tag) == "itemref"]
    return [(i, r) for i, r in enumerate(refs) if r]


def guide_paths(opf: str, folder: str) -> set[str]:
    """Pages that the package names as a table of contents: guide references without their fragment, and nav items."""
    root = ET.fromstring(opf)
    out = {joined_href(folder, e.get("href").split("#")[0]) for e in root.iter() if _local(e.tag) == "reference" and (e.get("type") or "").lower() == "toc" and e.get("href")}
    return out | {r[6] for r in manifest_rows(opf, folder) if r[6] and "nav" in (r[4] or "").split()}


def nav_rows(ncx: str) -> list[tuple]:
    """(id, parent_id, depth, pos, label, href) of a navigation map; a point without label or target goes with all below it."""
    root = ET.fromstring(ncx)
    start = next((e for e in root.iter() if _local(e.tag) == "navMap"), None)
    out: list[tuple] = []

    def visit(parent: ET.Element, parent_id: int | None, depth: int) -> None:
        pos = 0
        for point in (e for e in parent if _local(e.tag) == "navPoint"):
            label = next((t.text for e in point if _local(e.tag) == "navLabel" for t in e if _local(t.tag) == "text"), None)
            href = next((e.get("src") for e in point if _local(e.tag) == "content"), None)
            if not label or not label.strip() or not href:
                continue
            number = len(out)
            out.append((number, parent_id, depth, pos, label.strip(), href))
            pos += 1
            visit(point, number, depth + 1)

    if start is not None:
        visit(start, None, 0)
    return out


def render_nav(rows: list[tuple], source: str | None = None, title: str = "Contents") -> str:
    """A navigation page with nested ordered lists; links are made relative to `source` if it is given."""
    below: dict[int | None, list[tuple]] = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[3])):
        below.setdefault(r[1], []).append(r)

    def items(parent: int | None) -> str:
        if parent not in below:
            return ""
        links = (f'<li><a href="{html.escape(relative_href(source, r[5]) if source else r[5])}">{html.escape(r[4])}</a>{items(r[0])}</li>' for r in below[parent])
        return "<ol>" + "".join(links) + "</ol>"

    return (
        '<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>'
        f'{html.escape(title)}</title></head><body><nav epub:type="toc"><h1>{html.escape(title)}</h1>{items(None)}</nav></body></html>'
    )


def parse_navigation(documents: DataFrame, key: str, ncx: str) -> DataFrame:
    """(key, id, parent_id, depth, pos, label, href) of many documents; one that does not parse has no rows."""
    kind = documents.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for k, text in zip(f[key], f[ncx], strict=True):
                try:
                    rows += [(k, *r) for r in nav_rows(text or "")]
                except ET.ParseError:
                    continue
            out = pd.DataFrame(rows, columns=[key, "id", "parent_id", "depth", "pos", "label", "href"])
            yield out.astype({"parent_id": "Int32"})

    return documents.select(key, ncx).mapInPandas(run, f"{key} {kind}, id int, parent_id int, depth int, pos int, label string, href string")


def contents_pages(documents: DataFrame) -> DataFrame:
    """(book, path) of the pages that package documents (book, opf, xml) name as a table of contents; one that does not parse names none."""
    kind = documents.schema["book"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for book, opf, xml in zip(f["book"], f["opf"], f["xml"], strict=True):
                try:
                    rows += [(book, p) for p in sorted(guide_paths(xml or "", opf.rpartition("/")[0] or "."))]
                except ET.ParseError:
                    continue
            yield pd.DataFrame(rows, columns=["book", "path"])

    return documents.select("book", "opf", "xml").mapInPandas(run, f"book {kind}, path string")
