"""Exact top-k inner products through multi-resolution segment statistics.

A vector is cut into equal segments at several resolutions; means m and
deviations d of the segments bound the inner product of x and y from above by
sum(n * (m_x * m_y + d_x * d_y)) (Cauchy-Schwarz on the centred segments), which
is the lower-bound distance of the same statistics said for products.  A query
starts with the k-th best score against a bounded set of seed rows, a true lower
bound of its final k-th score; candidates go through the bounds from coarse to
fine, and only survivors get exact scores.

Candidates travel as packed blocks on lanes, and each query block is sent to
every lane; a task holds one block of each at a time.  Components are integers
floor(scale * x); products are exact in float64 below 2**53, beyond that they
are computed with Python integers and clipped to 64 bits.

Defined results: vectors that are null or hold null or non-finite components
take no part; only vectors of equal length meet; a query never meets rows of its
own id; repeated candidate rows each take a rank; a query id with several rows
keeps its least vector; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytekit as bk

BLOCK = 2048
QUERY_BLOCK = 512
SEEDS = 2048
LEVELS = (1, 4, 16)
_EXACT = 2.0**53


def _vectors(batch: pa.RecordBatch, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, integer-valued float64 matrix) for each vector length."""
    ids = batch.column("vec_id")
    column = batch.column("embedding")
    lists = column.cast(pa.large_list(pa.float64()))
    flat = lists.flatten()
    sizes = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
    values = np.asarray(flat.fill_null(np.nan), dtype=np.float64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    usable = (sizes > 0) & (bad[first[1:]] == bad[first[:-1]]) & np.asarray(ids.is_valid())
    numbers = np.asarray(ids.fill_null(0)).astype(np.int64)
    for dim in np.unique(sizes[usable]).tolist():
        rows = np.flatnonzero(usable & (sizes == dim))
        yield numbers[rows], np.floor(scale * values[(first[rows][:, None] + np.arange(dim))])


def _pack(scale: int, block: int, lanes: int | None):
    """Blocks of candidate rows in id order, each on the lane of its first id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def out(dim: int, ids: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
            order = np.argsort(ids, kind="stable")
            ids, m = ids[order], m[order]
            small = not m.size or np.abs(m).max() < 2**31
            lane = int(bk.mix(ids[:1].view(np.uint64))[0] % np.uint64(lanes)) if lanes else 0
            return pa.RecordBatch.from_arrays([pa.array([lane], pa.int32()), pa.array([dim], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([(b"i" + m.astype(np.int32).tobytes()) if small else b"d" + m.tobytes()], pa.binary())], ["lane", "dim", "ids", "vals"])

        for batch in batches:
            for ids, m in _vectors(batch, scale):
                dim = m.shape[1]
                if dim in held:
                    ids, m = np.concatenate([held[dim][0], ids]), np.concatenate([held[dim][1], m])
                while len(ids) >= block:
                    yield out(dim, ids[:block], m[:block])
                    ids, m = ids[block:], m[block:]
                held[dim] = ids, m
        for dim, (ids, m) in held.items():
            if len(ids):
                yield out(dim, ids, m)

    return run


def _unpack(ids: bytes, vals: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    m = np.frombuffer(vals, dtype=np.int32 if vals[:1] == b"i" else np.float64, offset=1).reshape(-1, dim).astype(np.float64)
    return np.frombuffer(ids, dtype=np.int64), m


def segment_features(m: np.ndarray, parts: int) -> np.ndarray:
    """Segment means and deviations, weighted so that a dot product of two rows is the bound."""
    edges = np.linspace(0, m.shape[1], min(parts, m.shape[1]) + 1).astype(int)
    n = np.diff(edges)
    mean = np.add.reduceat(m, edges[:-1], axis=1) / n
    square = np.add.reduceat((m - np.repeat(mean, n, axis=1)) ** 2, edges[:-1], axis=1) / n
    return np.concatenate([mean, np.sqrt(square)], axis=1) * np.sqrt(np.concatenate([n, n]))


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact products of all rows, as int64."""
    if not q.size or not c.size or q.shape[1] * np.abs(q).max() * np.abs(c).max() < _EXACT:
        return (q @ c.T).astype(np.int64)
    whole = np.array([[sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for y in c] for x in q], dtype=object)
    return np.clip(whole, -(2**63), 2**63 - 1).astype(np.int64).reshape(len(q), len(c))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best, score falling, then id rising; ids must rise."""
    if len(scores) > k:
        limit = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= limit)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some].astype(object) if scores.size and scores.min() == -(2**63) else -scores[some]))][:k]


def search_blocks(q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[list, list, list]:
    """Per query the k best of this block that reach its floor."""
    alive = c_ids[None, :] != q_ids[:, None]
    known = floor > -(2**63)
    slack = 1e-6 * (1 + np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(c, axis=1)[None, :])
    for parts in LEVELS:
        if 2 * parts >= c.shape[1] or not known.any():
            break
        fq, fc = segment_features(q, parts), segment_features(c, parts)
        share = alive.mean()
        if share > 0.2:
            alive &= ~known[:, None] | (fq @ fc.T + slack >= floor[:, None])
        else:
            row, col = np.nonzero(alive)
            keep = ~known[row] | (np.einsum("ij,ij->i", fq[row], fc[col]) + slack[row, col] >= floor[row])
            alive[row[~keep], col[~keep]] = False
    out_q: list = []
    out_c: list = []
    out_s: list = []
    for i in np.flatnonzero(alive.any(axis=1)):
        some = np.flatnonzero(alive[i])
        s = _scores(q[i : i + 1], c[some])[0]
        top = _best(s, c_ids[some], k)
        top = top[s[top] >= floor[i]]
        out_q += [int(q_ids[i])] * len(top)
        out_c += c_ids[some[top]].tolist()
        out_s += s[top].tolist()
    return out_q, out_c, out_s


def _floors(seeds: list[tuple[int, bytes, bytes]], k: int):
    """Query blocks with each query's k-th best score against the seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for dim, ids, vals in zip(*(batch.column(n).to_pylist() for n in ("dim", "ids", "vals")), strict=True):
                q_ids, q = _unpack(ids, vals, dim)
                floor = np.full(len(q_ids), -(2**63), dtype=np.int64)
                found = [_unpack(i, v, d) for d, i, v in seeds if d == dim]
                if found:
                    c_ids, c = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
                    scores = _scores(q, c)
                    for row in range(len(q_ids)):
                        s = scores[row][c_ids != q_ids[row]]
                        if len(s) >= k:
                            floor[row] = np.partition(s, len(s) - k)[len(s) - k]
                out.append(floor.tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("dim", "ids", "vals")), pa.array(out, pa.binary())], ["dim", "q_ids", "q_vals", "floors"])

    return run


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                dim, q_i, q_v, floor, c_i, c_v = (batch.column(n)[row].as_py() for n in ("dim", "q_ids", "q_vals", "floors", "ids", "vals"))
                out = search_blocks(*_unpack(q_i, q_v, dim), np.frombuffer(floor, dtype=np.int64), *_unpack(c_i, c_v, dim), k)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, lanes: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best rows.

    Without a number of lanes there is one for each candidate block, up to four
    for each core.
    """
    if lanes is None:
        lanes = max(1, min(-(-vectors.count() // BLOCK), 4 * vectors.sparkSession.sparkContext.defaultParallelism))
    vectors, queries = (x.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding") for x in (vectors, queries))
    schema = "lane int, dim int, ids binary, vals binary"
    blocks = vectors.mapInArrow(_pack(scale, BLOCK, lanes), schema)
    once = queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = once.mapInArrow(_pack(scale, QUERY_BLOCK, None), schema)
    # A bounded set of rows; any rows would do, they only raise the floors.
    first = vectors.where("embedding IS NOT NULL").limit(SEEDS).mapInArrow(_pack(scale, SEEDS, None), schema)
    seeds = [(r.dim, bytes(r.ids), bytes(r.vals)) for r in first.collect()]
    floors = asked.mapInArrow(_floors(seeds, k), "dim int, q_ids binary, q_vals binary, floors binary")
    sent = floors.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    found = blocks.join(sent, ["lane", "dim"]).mapInArrow(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
