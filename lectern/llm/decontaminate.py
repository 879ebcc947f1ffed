"""Benchmark decontamination: prefix-filtered set join and exact windows.

A window is `width` consecutive words of a benchmark item (all of a shorter
item).  A document holds a window only where all of the window's word shingles
stand in a row, so

* filter: one scan keeps the runs of document words whose shingles all belong
  to windows, if a run is as long as the windows of some size need (length
  bound); membership is a bitmap sized by the number of distinct shingles;
* prefix: a window's shingles are ordered by how often the runs hold them; the
  rarest one is prefix enough, and is joined with the runs' shingles, salted so
  that a passage of very many documents is spread;
* verification: the window's place around the shingle must lie inside the run
  (positional bound), and its words must equal the run's, byte by byte.

What moves is runs, so the volume follows the contamination, not the corpus or
the benchmark.

Defined results: null texts have no words; an item without words has no window;
items that share an id count once; an item without id marks words but is not
counted among the items; documents are rows, so repeated rows and ids are
answered one by one; empty tables give no rows or no hits; further columns are
ignored, or kept as they are by keep_uncontaminated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytekit as bk
from .workspace import Workspace, among, bitmaps, bounded_batches, filter_bits

WIDTH = 10
SHINGLE = 3
SALTS = 16

_RUNS = "array<struct<start:int,words:binary>>"


def _shingle(size: int) -> int:
    """Words of a shingle of windows of this size."""
    return min(SHINGLE, size)


def _bit(values: np.ndarray, bits: int) -> np.ndarray:
    return (values >> np.uint64(64 - bits)).astype(np.int64)


def _words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, folded bytes, word starts, word ends, first word of each row, word hashes) of slices of rows."""
    for lo, hi, buf, offsets in bk.text_slices(column):
        starts, ends, first = bk.word_spans(buf, offsets, bk.ALNUM)
        yield lo, hi, buf, starts, ends, first, bk.word_hashes(buf, starts, ends)


def _joined(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, a: int, b: int) -> bytes:
    """Words a to b, A-Z as a-z, with a space between."""
    return b" ".join(bk.FOLD[buf[s:e]].tobytes() for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True))


def _windows(width: int):
    """(item_id, words, size, shingles) of every window of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("item_id").to_pylist()
            out: list[tuple] = []
            for lo, hi, buf, starts, ends, first, words in _words(batch.column("text")):
                for row in range(hi - lo):
                    a, b = int(first[row]), int(first[row + 1])
                    size = min(width, b - a)
                    if not size:
                        continue
                    shingles = bk.window_hashes(words[a:b], _shingle(size)).view(np.int64).tolist()
                    many = size - _shingle(size) + 1
                    out += [(ids[lo + row], _joined(buf, starts, ends, k, k + size), size, shingles[k - a : k - a + many]) for k in range(a, b - size + 1)]
            kinds = (pa.string(), pa.binary(), pa.int32(), pa.list_(pa.int64()))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["item_id", "words", "size", "shingles"])

    return run


Filters = dict[int, tuple[int, np.ndarray]]


def _filters(windows: DataFrame) -> Filters:
    """By window size, the bits and the bitmap of the shingles of all windows of that size."""
    counts = windows.select("size", F.explode("shingles").alias("shingle")).groupBy("size").agg(F.approx_count_distinct("shingle").alias("n")).collect()
    bits = {r["size"]: filter_bits(r["n"]) for r in counts}  # `width` sizes at most
    if not bits:
        return {}

    def numbers(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        sizes = np.asarray(batch.column("size"))
        for size in np.unique(sizes).tolist():
            some = batch.column("shingles").filter(pa.array(sizes == size)).flatten()
            yield size, _bit(np.asarray(some).astype(np.int64).view(np.uint64), bits[size])

    maps = bitmaps(windows.select("size", "shingles"), numbers, bits)
    return {size: (bits[size], maps[size]) for size in sorted(bits)}


def candidate_runs(filters: Filters, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the runs of words that may hold a window, merged where they meet; no run leaves its row."""
    mark = np.zeros(len(words) + 1, dtype=np.int64)
    for size, (bits, bitmap) in filters.items():
        g = _shingle(size)
        at = bk.within_rows(first, g)
        if not len(at):
            continue
        at = at[among(bitmap, _bit(bk.window_hashes(words, g)[at], bits))]
        if not len(at):
            continue
        row = np.searchsorted(first, at, "right")
        begins = np.flatnonzero(np.append(True, (np.diff(at) != 1) | (np.diff(row) != 0)))
        many = np.diff(np.append(begins, len(at)))
        begins, many = begins[many >= size - g + 1], many[many >= size - g + 1]
        np.add.at(mark, at[begins], 1)
        np.add.at(mark, at[begins] + many + g - 1, -1)
    inside = np.cumsum(mark[:-1]) > 0
    begin, end = inside.copy(), inside.copy()
    edge = first[1:-1]
    edge = edge[(edge > 0) & (edge < len(inside))]
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    begin[edge], end[edge - 1] = inside[edge], inside[edge - 1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def _runs_of(column: pa.Array, filters: Filters) -> Iterator[tuple[int, list[list[dict]], np.ndarray]]:
    """(first row, runs of each row, words of each row) of slices of rows."""
    for lo, hi, buf, starts, ends, first, words in _words(column):
        out: list[list[dict]] = [[] for _ in range(hi - lo)]
        for a, b in zip(*(x.tolist() for x in candidate_runs(filters, words, first)), strict=True):
            row = int(np.searchsorted(first, a, "right")) - 1
            out[row].append({"start": a - int(first[row]), "words": _joined(buf, starts, ends, a, b)})
        yield lo, out, np.diff(first)


def _scan(filters: Filters):
    """(doc_id, row, n_words, runs) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.binary())]))
        for batch in batches:
            runs, counts = [], []
            for _, some, n in _runs_of(batch.column("text"), filters):
                runs += some
                counts += n.tolist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(counts, pa.int64()), pa.array(runs, kind)], ["doc_id", "row", "n_words", "runs"])

    return run


def _postings(grams: list[int], width: int):
    """(gram, shingle, row, at, before, context) of every shingle of every run; the context is all that a window around it can take."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        names = ["gram", "shingle", "row", "at", "before", "context"]
        for batch in batches:
            rows, at = batch.column("row").to_pylist(), batch.column("start").to_pylist()
            for lo, hi, buf, starts, ends, first, hashes in _words(batch.column("words")):
                out: list[tuple] = []
                for i in range(hi - lo):
                    a, b = int(first[i]), int(first[i + 1])
                    text = [buf[s:e].tobytes() for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)]
                    for g in grams:
                        for p, shingle in enumerate(bk.window_hashes(hashes[a:b], g).view(np.int64).tolist()):
                            before = min(p, width - 1)
                            out.append((g, shingle, rows[lo + i], at[lo + i] + p, before, b" ".join(text[p - before : p + width])))
                columns = list(zip(*out, strict=True)) if out else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, start, stop, window) of the candidates whose words are the window's."""
    for batch in batches:
        out = []
        for row, at, before, context, offset, size, words, window in zip(*(batch.column(c).to_pylist() for c in ("row", "at", "before", "context", "offset", "size", "words", "window")), strict=True):
            if offset <= before:
                held = context.split(b" ")[before - offset : before - offset + size]
                if len(held) == size and b" ".join(held) == words:
                    out.append((row, at - offset, at - offset + size, window))
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["row", "start", "stop", "window"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, hits): the union of each row's spans, as packed 64-bit pairs."""
    for batch in batches:
        out = []
        for spans in batch.column("spans").to_pylist():
            merged: list[list[int]] = []
            for a, b in sorted((s["start"], s["stop"]) for s in spans):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            out.append(np.array(merged, dtype=np.int64).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.binary())], ["row", "hits"])


def _salted(small: DataFrame) -> DataFrame:
    return small.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))


def benchmark_windows(benchmark: DataFrame, work: Workspace, width: int = WIDTH) -> DataFrame:
    """(item_id, words, size, shingles, window) of every distinct window of every item; `window` names its words."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    rows = items.mapInArrow(bk.tidy(_windows(width)), "item_id string, words binary, size int, shingles array<long>")
    return work.table(rows.dropDuplicates(["item_id", "words"]).withColumn("window", F.sha2("words", 256)), "windows")


def _occurrences(runs: DataFrame, windows: DataFrame, work: Workspace, sizes: list[int], width: int) -> DataFrame:
    """(row, start, stop, window) of every window in the runs (row, start, words)."""
    grams = sorted({_shingle(s) for s in sizes})
    postings = runs.mapInArrow(bk.tidy(_postings(grams, width)), "gram int, shingle long, row long, at int, before int, context binary")
    postings = work.table(postings, "postings")
    rarity = postings.groupBy("gram", "shingle").agg(F.count("*").alias("n"))
    gram = F.least(F.lit(SHINGLE), F.col("size")).alias("gram")
    distinct = windows.dropDuplicates(["window"])
    tokens = distinct.select("window", "size", gram, F.posexplode("shingles").alias("offset", "shingle")).join(rarity, ["gram", "shingle"], "left")
    # A window with a shingle that no run holds stands nowhere.
    rarest = tokens.groupBy("window", "size", "gram").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "offset")).alias("t")).where("t.n > 0")
    prefixes = rarest.select("window", "size", "gram", F.col("t.shingle").alias("shingle"), F.col("t.offset").alias("offset")).join(distinct.select("window", "words"), "window")
    met = postings.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(_salted(prefixes), ["gram", "shingle", "salt"])
    return work.table(met.mapInArrow(_verify, "row long, start int, stop int, window string").distinct(), "occurrences")


def find_contamination(docs: DataFrame, benchmark: DataFrame, work: Workspace, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_words, hits, items) of every row: hits packs (start, end) word intervals as 64-bit pairs."""
    windows = benchmark_windows(benchmark, work, width)
    filters = _filters(windows)
    docs = bounded_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).withColumn("row", F.monotonically_increasing_id())
    found = work.table(docs.mapInArrow(bk.tidy(_scan(filters)), f"doc_id long, row long, n_words long, runs {_RUNS}"), "found")
    runs = found.select("row", F.explode("runs").alias("r")).select("row", "r.start", "r.words")
    hits = _occurrences(runs, windows, work, list(filters), width)
    spans = hits.groupBy("row").agg(F.collect_set(F.struct("start", "stop")).alias("spans")).mapInArrow(_merge, "row long, hits binary")
    named = _salted(windows.where("item_id IS NOT NULL").select("window", "item_id"))
    items = hits.select("row", "window").distinct().withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(named, ["window", "salt"])
    items = items.groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    none = [F.lit(b"").alias("hits"), F.array().cast("array<string>").alias("items")]
    plain = found.where("size(runs) = 0").select("doc_id", "n_words", *none)
    open_ = found.where("size(runs) > 0").select("doc_id", "row", "n_words").join(spans, "row", "left").join(items, "row", "left")
    return plain.unionByName(open_.select("doc_id", "n_words", F.coalesce("hits", F.lit(b"")).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items")))


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, work: Workspace, width: int = WIDTH) -> DataFrame:
    """The rows, unchanged, whose text holds no window.

    Rows without a run that may hold one stay where they lie; only the others
    are written with a number and judged.
    """
    windows = benchmark_windows(benchmark, work, width)
    filters = _filters(windows)
    docs = bounded_batches(docs)

    def side(with_runs: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                some = [bool(r) for _, rows, _ in _runs_of(batch.column("text"), filters) for r in rows]
                yield batch.filter(pa.array([x == with_runs for x in some], pa.bool_()))

        return run

    plain, open_ = (docs.mapInArrow(bk.tidy(side(x)), docs.schema) for x in (False, True))
    number = "_row"
    while number in docs.columns:
        number += "_"
    open_ = work.table(open_.withColumn(number, F.monotonically_increasing_id()), "open")
    scanned = open_.select(F.lit(0).cast("long").alias("doc_id"), "text", F.col(number).alias("row")).mapInArrow(bk.tidy(_scan(filters)), f"doc_id long, row long, n_words long, runs {_RUNS}")
    scanned = work.table(scanned, "found")  # one Python worker a task at a time
    runs = scanned.select("row", F.explode("runs").alias("r")).select("row", "r.start", "r.words")
    hit = _occurrences(runs, windows, work, list(filters), width).select(F.col("row").alias(number)).distinct()
    return plain.unionByName(open_.join(hit, number, "left_anti").drop(number))


def contamination_digest(found: DataFrame) -> DataFrame:
    """One digest row per document of find_contamination's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_hit, n_items, digest = [], [], []
            for hits, items in zip(batch.column("hits").to_pylist(), batch.column("items").to_pylist(), strict=True):
                spans = np.frombuffer(hits, dtype=np.int64).reshape(-1, 2)
                n_hit.append(int((spans[:, 1] - spans[:, 0]).sum()))
                n_items.append(len(items))
                digest.append(hashlib.sha256(",".join(sorted(items)).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_words"), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digest, pa.string()), pa.array([x > 0 for x in n_hit], pa.bool_())],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return found.mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
