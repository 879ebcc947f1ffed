"""Finished package documents from the rows that describe them, and archives written one a task."""

from __future__ import annotations

import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.overlays import GENERATED

from .archives import joined_href, relative_href, rewrite_archive
from .navigation import nav_rows, render_nav

PREFIX = "media: http://www.idpf.org/epub/vocab/overlays/#"
_OPF = "http://www.idpf.org/2007/opf"
# How the namespaces of a package document are written.
_NAMESPACES = {"": _OPF, "dc": "http://purl.org/dc/elements/1.1/", "opf": _OPF + "#"}
_GENERATED = re.compile(GENERATED)
STYLESHEET = "readaloud.css"
STYLE = ".-epub-media-overlay-active { background-color: #ffe9a8; }\n"
NAV = {"id": "generated_nav", "href": "nav.xhtml", "media-type": "application/xhtml+xml", "properties": "nav"}


def _local(element: ET.Element) -> str:
    return element.tag.rsplit("}", 1)[-1]


class PackageDocument:
    """A package document whose manifest and durations can be set from rows."""

    def __init__(self, opf: str, path: str):
        for prefix, uri in _NAMESPACES.items():
            ET.register_namespace(prefix, uri)
        self.root, self.path = ET.fromstring(opf), path
        self.folder = posixpath.dirname(path) or "."
        self.space = self.root.tag.removesuffix("package")
        self.metadata, self.manifest = (next(e for e in self.root.iter() if _local(e) == name) for name in ("metadata", "manifest"))

    def items(self) -> dict[str, ET.Element]:
        return {e.get("id", ""): e for e in self.manifest}

    def declare(self, rows: list[dict]) -> None:
        """The manifest that the rows of `package_rows` say: their items in order, with the attributes that kept ones have.

        Paths of generated items are given from the archive's root, but for the
        stylesheet's, which lies beside the document.
        """
        old = self.items()
        new = []
        for row in rows:
            if row["id"] is None:
                continue
            attributes = {k: v for k, v in (old[row["id"]].attrib if row["id"] in old else {}).items() if k != "media-overlay"}
            if _GENERATED.search(row["id"]):
                target = row["href"] if "/" in row["href"] else joined_href(self.folder, row["href"])
                attributes = {"id": row["id"], "href": relative_href(self.path, target), "media-type": row["media_type"]}
            elif not attributes:
                continue
            if row.get("media_overlay"):
                attributes["media-overlay"] = row["media_overlay"]
            new.append(ET.Element(self.space + "item", attributes))
        new.sort(key=lambda e: list(old).index(e.get("id")) if e.get("id") in old and not _GENERATED.search(e.get("id")) else len(old))
        self.manifest[:] = new

    def time(self, rows: list[dict]) -> None:
        """One duration for each row that has one; a row without id gives the whole book's."""
        self.metadata[:] = [e for e in self.metadata if e.get("property") != "media:duration"]
        for row in rows:
            if row.get("duration"):
                of = {"refines": f"#{row['id']}"} if row["id"] else {}
                ET.SubElement(self.metadata, self.space + "meta", {"property": "media:duration"} | of).text = row["duration"]
        self.root.set("version", "3.0")
        self.root.set("prefix", " ".join(dict.fromkeys(filter(None, [self.root.get("prefix"), None if PREFIX in self.root.get("prefix", "") else PREFIX]))))

    def navigate(self, ncx: dict[str, str]) -> dict[str, str]:
        """A navigation page from the NCX, declared and returned by its path, if the package has none."""
        declared = any("nav" in e.get("properties", "").split() for e in self.manifest)
        tables = [joined_href(self.folder, e.get("href", "")) for e in self.manifest if e.get("media-type") == "application/x-dtbncx+xml"]
        source = next((t for t in tables if t in ncx), None)
        if declared or source is None:
            return {}
        title = next((e.text for e in self.metadata if _local(e) == "title" and e.text), "Contents")
        self.manifest.insert(0, ET.Element(self.space + "item", NAV))
        return {joined_href(self.folder, NAV["href"]): render_nav(nav_rows(ncx[source]), title=title)}

    def text(self) -> str:
        return '<?xml version="1.0" encoding="utf-8"?>\n' + ET.tostring(self.root, encoding="unicode")


def finish_document(opf: str, path: str, rows: list[dict], ncx: dict[str, str]) -> tuple[str, dict[str, str]]:
    """The package document that the rows of `package_rows` describe, and other members to write."""
    document = PackageDocument(opf, path)
    document.declare(rows)
    document.time(rows)
    extra = document.navigate(ncx)
    return document.text(), extra


def assemble(package: str, files: dict[str, bytes], documents: dict[str, str]) -> None:
    """Add chunk, overlay and style files and replace documents in a package."""
    rewrite_archive(package, files | {k: v.encode() for k, v in documents.items()})


def merged_members(members: DataFrame, changes: DataFrame) -> DataFrame:
    """(archive, pos, entry, content) of archives after changes (archive, entry, content): replaced and new members come last by name, those changed to null go."""
    last = changes.select("archive", "entry", F.col("content").alias("_new"), F.lit(True).alias("_changed"))
    kept = members.join(last.select("archive", "entry"), ["archive", "entry"], "left_anti").select("archive", "pos", "entry", "content")
    return kept.unionByName(last.where("_new IS NOT NULL").select("archive", F.lit(2**31 - 1).alias("pos"), "entry", F.col("_new").alias("content")))


def write_archives(members: DataFrame, folder: str) -> DataFrame:
    """Write each archive's members as a zip into a folder that all machines see; (archive, path, size) of each.

    A task writes its archives one after the other, each under a temporary name
    first; a task that runs again writes the same files.  The mimetype comes
    first and unpacked.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pafs.FileSystem.from_uri(folder)
        attempt = TaskContext.get().taskAttemptId()
        done: list[tuple[str, str, int]] = []
        name, held, packed = None, io.BytesIO(), None

        def close() -> None:
            if packed is None:
                return
            packed.close()
            path = f"{base}/{posixpath.basename(name)}"
            with fs.open_output_stream(f"{path}.{attempt}") as out:
                out.write(held.getvalue())
            if fs.get_file_info(path).type != pafs.FileType.NotFound:
                fs.delete_file(path)
            fs.move(f"{path}.{attempt}", path)
            done.append((name, path, len(held.getvalue())))

        for f in frames:
            for archive, entry, content in zip(f["archive"], f["entry"], f["content"], strict=True):
                if archive != name:
                    close()
                    name, held = archive, io.BytesIO()
                    packed = zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED)
                info = zipfile.ZipInfo(entry)
                info.compress_type = zipfile.ZIP_STORED if entry == "mimetype" else zipfile.ZIP_DEFLATED
                packed.writestr(info, bytes(content))
        close()
        yield pd.DataFrame(done, columns=["archive", "path", "size"])

    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base)
    first = F.col("entry") != "mimetype"
    dealt = members.repartition("archive").sortWithinPartitions("archive", first, "pos", "entry")
    return dealt.select("archive", "entry", "content").mapInPandas(run, "archive string, path string, size long")
