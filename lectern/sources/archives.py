"""Zip packages: a Spark data source for their members, and driver-side writers."""

from __future__ import annotations

import json
import os
import posixpath
import shutil
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, IntegerType, StringType, StructField, StructType

SCHEMA = StructType([StructField("archive", StringType()), StructField("pos", IntegerType()), StructField("entry", StringType()), StructField("content", BinaryType())])


class _Archive(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[_Archive]:
        return [_Archive(p) for p in self.paths]

    def read(self, partition: _Archive) -> Iterator[tuple]:
        with zipfile.ZipFile(partition.path) as z:
            for pos, info in enumerate(z.infolist()):
                if not info.is_dir():
                    yield partition.path, pos, info.filename, z.read(info)


class ZipDataSource(DataSource):
    """spark.read.format("zip_members").load(path): one row a member, one task an archive; paths part at commas."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> StructType:
        return SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        return _Reader([p for p in self.options["path"].split(",") if p])


def members_of(files: DataFrame) -> DataFrame:
    """Members (archive, pos, entry, content) of `binaryFile` rows, for stores that only Spark reads."""

    def run(frames):
        import io

        import pandas as pd

        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    rows += [(path, pos, i.filename, z.read(i)) for pos, i in enumerate(z.infolist()) if not i.is_dir()]
            yield pd.DataFrame(rows, columns=SCHEMA.names)

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def decoded(content: bytes) -> str:
    """UTF-8, else Latin-1, which reads any bytes."""
    try:
        return content.decode()
    except UnicodeDecodeError:
        return content.decode("latin-1")


def member_text(content: Column) -> Column:
    """A member as UTF-8 text; wrong bytes are replaced, null stays null."""
    return F.make_valid_utf8(content.cast("string"))


def package_document(members: DataFrame) -> DataFrame:
    """(archive, opf, depth): the first package document of each archive and how many folders deep it lies."""
    opf = members.where(F.lower("entry").endswith(".opf")).groupBy("archive").agg(F.min_by("entry", "pos").alias("opf"))
    return opf.withColumn("depth", F.size(F.split("opf", "/")) - 1)


def relative_href(source: str, target: str) -> str:
    """Link from one member to another."""
    return posixpath.relpath(target, posixpath.dirname(source) or ".")


def joined_href(base: str, href: str) -> str:
    return posixpath.normpath(posixpath.join(base, href))


def write_atomic(path: str | Path, data: bytes | str) -> None:
    """Write beside the target, then rename, so that no reader sees half a file."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data.encode() if isinstance(data, str) else data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, path)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def write_json(path: str | Path, value: object) -> None:
    write_atomic(path, json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True))


def read_json(path: str | Path, default: object = None) -> object:
    """The value of a JSON file; the default if there is none."""
    path = Path(path)
    return json.loads(path.read_text(encoding="utf-8")) if path.exists() else default


def copy_atomic(source: str | Path, target: str | Path) -> None:
    write_atomic(target, Path(source).read_bytes())


def rewrite_archive(path: str | Path, replace: dict[str, bytes] | None = None, delete: set[str] | None = None) -> None:
    """Replace members (new ones come last) and delete others; the mimetype stays first and unpacked."""
    replace, delete = dict(replace or {}), set(delete or ())
    path = Path(path)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    os.close(handle)
    try:
        with zipfile.ZipFile(path) as old, zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as new:
            for info in old.infolist():
                if info.filename not in delete and info.filename not in replace:
                    new.writestr(info, old.read(info))
            for entry, content in replace.items():
                new.writestr(entry, content)
        os.replace(name, path)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def reset_derived(folder: str | Path, keep: set[str]) -> list[str]:
    """Delete everything in a folder but the kept names; what went."""
    gone = []
    for item in sorted(Path(folder).iterdir()):
        if item.name not in keep:
            shutil.rmtree(item) if item.is_dir() else item.unlink()
            gone.append(item.name)
    return gone


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ZipDataSource)
