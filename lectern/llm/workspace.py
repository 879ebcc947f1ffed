"""Written intermediate tables, shared sketches and connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.functions.frames import BATCH, BATCH_BYTES, bounded_batches, spread  # noqa: F401

from .bytekit import Kernel, tidy

#: Bytes of a row group of a table that tasks write themselves.
GROUP_BYTES = 8 << 20


def _written(folder: str, kernel: Kernel | None) -> Kernel:
    """Writes each partition's rows, as the kernel gives them, to one Parquet file of a folder; gives no rows.

    A file takes its name when it is whole, so of several attempts of a task one
    counts; names of files in the making begin with a dot, which readers skip.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}.parquet"
        own = f"{folder}/.{name}.{task.taskAttemptId()}"
        writer: pq.ParquetWriter | None = None
        held: list[pa.RecordBatch] = []

        def flush() -> None:
            nonlocal writer
            if writer is None:
                writer = pq.ParquetWriter(own, held[0].schema)
            writer.write_table(pa.Table.from_batches(held))
            held.clear()

        size = 0
        for batch in kernel(batches) if kernel else batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size >= GROUP_BYTES:
                flush()
                size = 0
        if held:
            flush()
        if writer is not None:
            writer.close()
            os.replace(own, f"{folder}/{name}")
        yield from ()

    return run


class Workspace:
    """A folder for intermediate tables under the cluster's shared checkpoint folder.

    A table that is written and read again cuts the lineage: losing an executor
    costs only the running stage.  The folder goes when the application ends.
    Where ``spark.checkpoint.dir`` is unset a temporary folder stands in, and only
    if driver and executors are one process; other masters raise an error, as
    their machines share no such folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not root:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
            root = "file://" + tempfile.gettempdir() + "/lectern-work"
            spark.conf.set("spark.checkpoint.dir", root)
        self.spark = spark
        self.path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(folder)
        fs.deleteOnExit(folder)
        self._fs, self._n, self.latest = fs, 0, ""
        uri = fs.makeQualified(folder).toUri()
        #: The folder's plain path, if it is one of the machine's or a mounted file system.
        self.plain = str(uri.getPath()) if uri.getScheme() == "file" else ""

    def table(self, frame: DataFrame, name: str = "t", *, kernel: Kernel | None = None, schema: str = "", direct: bool = False, **options: str) -> DataFrame:
        """Write a frame, or what a kernel makes of it, with options for Spark's writer, and return it read back.

        Hadoop's file system for plain files starts a process, chmod, for every
        file, its checksum file and its folder: thousands in a query of many
        tables.  A new process of the JVM shares all of the JVM's memory until it
        runs its program, and what counts memory by process then counts it twice.
        With `direct`, or a kernel, tasks write plain files themselves, a kernel's
        rows without a way through the JVM.  Columns then have to be of types
        that Arrow and Parquet share: numbers, texts, bytes, lists and records.
        """
        self._n += 1
        path = f"{self.path}/{self._n:03d}-{name}"
        kind = StructType.fromDDL(schema) if schema else frame.schema
        if self.plain and (direct or kernel):
            folder = f"{self.plain}/{path.rsplit('/', 1)[1]}"
            os.makedirs(folder)
            frame.mapInArrow(_written(folder, kernel), "nothing int").write.format("noop").mode("overwrite").save()
        else:
            made = frame.mapInArrow(kernel, schema) if kernel else frame
            made.write.options(**options).parquet(path)
        self.latest = path
        return self.spark.read.schema(kind).parquet(path)

    def remove(self, path: str) -> None:
        """Delete a table that nothing reads any more."""
        self._fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), True)


CHUNK_BITS = 12
#: Partitions in which the driver fetches pieces of sketches; it runs a job for each, one after another.
FETCHES = 8


def sketch_bits(frame: DataFrame, least: int = 20, most: int = 25) -> int:
    """log2 of the counters of a frequency sketch over a frame's texts: one for each 128 bytes the scan is estimated at.

    2**most counters (32 MB when sent out) is the largest; past that, each
    counter holds more neighbours and only more frequent entries stand out.
    """
    size = int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(most, max(least, (size // 128).bit_length()))


def bucket_levels(frame: DataFrame, counter: Callable[[pa.RecordBatch, int], np.ndarray], bits: int) -> np.ndarray:
    """How full 2**bits buckets are over all rows: four times the binary logarithm of 1 + count, a byte each.

    `counter(batch, 2**bits)` gives one batch's bucket numbers.  Each task sends
    its sums as pieces of 4,096 buckets; pieces are added up per piece number, so
    the driver gets 2**bits bytes whatever the size of the input.
    """
    size = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.uint32)
        some = False
        for batch in batches:
            got = counter(batch, size)
            if len(got):
                at, many = np.unique(got, return_counts=True)
                total[at] += many.astype(np.uint32)
                some = True
        if some:
            pieces = total.reshape(-1, 1 << min(bits, CHUNK_BITS))
            used = np.flatnonzero(pieces.any(axis=1))
            for lo in range(0, len(used), 1024):
                part = used[lo : lo + 1024]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([_pack(pieces[i]) for i in part], pa.binary())], ["piece", "counts"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column("counts"):
                got = _unpack(x.as_py())
                total = got if total is None else total + got
        level = np.round(4 * np.log2(1.0 + total)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["piece", "counts"])

    schema = "piece int, counts binary"
    out = np.zeros(size, dtype=np.uint8)
    step = 1 << min(bits, CHUNK_BITS)
    for piece, levels in frame.mapInArrow(tidy(count), schema).groupBy("piece").applyInArrow(add, schema).coalesce(FETCHES).toLocalIterator():
        out[piece * step : (piece + 1) * step] = np.frombuffer(levels, dtype=np.uint8)
    return out


def filter_bits(n: int, per_entry: int = 16, most: int = 29) -> int:
    """log2 of the bits of a membership filter over n entries: about `per_entry` each, and 2**most (64 MB) at the largest.

    Past that size a filter lets more through; what it lets through is always
    judged exactly afterwards.
    """
    return min(most, max(12, (max(1, n) * per_entry - 1).bit_length()))


def bitmaps(frame: DataFrame, numbers: Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray]]], bits: dict[int, int]) -> dict[int, np.ndarray]:
    """For each key a packed bitmap of 2**bits[key] bits, with the bits that `numbers(batch)` names as (key, bit numbers).

    Each task sends the pieces of its bitmaps that hold a bit; pieces are united
    per number, so the driver gets the bitmaps whatever the size of the input.
    """
    sizes = {k: 1 << max(0, b - 3) for k, b in bits.items()}
    step = 512

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, at in numbers(batch):
                if key not in own:
                    own[key] = np.zeros(sizes[key], dtype=np.uint8)
                at = np.unique(at)
                np.bitwise_or.at(own[key], at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        for key, total in own.items():
            used = np.flatnonzero(np.add.reduceat(total, np.arange(0, len(total), step), dtype=np.int64))
            for lo in range(0, len(used), 4096):
                some = used[lo : lo + 4096]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(some), key), pa.int32()), pa.array(some, pa.int32()), pa.array([total[i * step : (i + 1) * step].tobytes() for i in some], pa.binary())], ["key", "piece", "bits"]
                )

    def unite(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column("bits"):
                got = np.frombuffer(x.as_buffer(), dtype=np.uint8)
                total = got if total is None else total | got
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["key", "piece", "bits"])

    schema = "key int, piece int, bits binary"
    out = {k: np.zeros(n, dtype=np.uint8) for k, n in sizes.items()}
    for key, piece, held in frame.mapInArrow(tidy(mark), schema).groupBy("key", "piece").applyInArrow(unite, schema).coalesce(FETCHES).toLocalIterator():
        out[key][piece * step : piece * step + len(held)] = np.frombuffer(held, dtype=np.uint8)
    return out


def among(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether these bits are set."""
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _pack(counts: np.ndarray) -> bytes:
    """Width code, then the counts in the narrowest unsigned type that holds them."""
    top = int(counts.max())
    for code, kind in enumerate((np.uint8, np.uint16, np.uint32, np.uint64)):
        if top <= np.iinfo(kind).max:
            return bytes([code]) + counts.astype(kind).tobytes()
    raise OverflowError(top)


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=(np.uint8, np.uint16, np.uint32, np.uint64)[data[0]], offset=1).astype(np.int64)


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of one partition as stars around each local component's least node."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    out = [(x, root(x)) for x in parent if parent[x] != x]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([r for _, r in out], pa.int64())], ["u", "v"])


#: So few edges are united by one task, in some 60 MB.
ONE_TASK = 1 << 17


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """(node, component) of every node on an edge (u, v) but each component's least node, which names it.

    Edges are first contracted inside each partition.  If no more than ONE_TASK
    are left, one task contracts these; else large-star and small-star steps
    alternate (Kiveris et al., 2014) until nothing changes.  Each round is
    written out and the one before removed; the driver sees one checksum a round.
    """
    stars = work.table(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u != v"), "edges", kernel=_contract, schema="u long, v long")
    held, before = work.latest, None
    if stars.count() <= ONE_TASK:
        return work.table(stars.coalesce(1), "stars", kernel=_contract, schema="u long, v long").select(F.col("u").alias("node"), F.col("v").alias("component"))
    while True:
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        stars = work.table(small, "stars", direct=True)
        work.remove(held)
        held = work.latest
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return stars.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").select("node", "component")
        before = now
