"""Quality: a factorisation machine over hashed words, structure and metadata.

A text's features are its words hashed to BUCKETS numbers (log counts, scaled to
unit length), statistics of its structure in bins, and its stated length against
its own.  The score is

    w0 + sum(w x) + 1/2 sum_f [ (sum_i v_if x_i)**2 - sum_i v_if**2 x_i**2 ]

where the last sum is all pairwise interactions in linear time (Rendle, 2010).
Words are hashed and counted for a whole batch at once.

Training reads at most SAMPLE labelled texts of each class, picked by a hash,
and at most SAMPLE_CHARS characters of them; scoring reads whole texts.  Defined
results: null and empty texts get the score of a text without words; without
labelled rows of both classes every score is the share of good labels (0 without
any); a null n_chars counts as the text's own length; null labels are left out
and repeated label rows taken once; rows are answered one by one; an empty table
gives no rows; further columns are ignored.  Features that no training text has
count nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytekit as bk
from .toxicity import labelled_sample, train_in_task
from .workspace import bounded_batches

BUCKETS = 1 << 14
RANK = 8
BINS = 16
SAMPLE = 3000
SAMPLE_CHARS = 12_000_000
EPOCHS = 12

_CLASSES = {
    "upper": [*range(65, 91)],
    "lower": [*range(97, 123)],
    "digit": [*range(48, 58)],
    "blank": [32, 9],
    "line": [10],
    "mark": [ord(c) for c in ".,;:"],
    "shout": [ord(c) for c in "!?"],
    "sign": [b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:!?'\"-()"],
    "other": [*range(128, 256)],
}
STATISTICS = (*_CLASSES, "length", "word length", "distinct words", "repeats", "lines", "line repeats", "common", "stated length")


def _share_tables() -> np.ndarray:
    t = np.zeros((len(_CLASSES), 256), dtype=bool)
    for i, members in enumerate(_CLASSES.values()):
        t[i, members] = True
    return t


_TABLES = _share_tables()


def _row_sums(flags: np.ndarray, borders: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[borders[1:]] - total[borders[:-1]]


def _distinct(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct values of each row; rows rise."""
    order = np.lexsort((values, rows))
    r, v = rows[order], values[order]
    fresh = np.ones(len(r), dtype=bool)
    fresh[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
    return np.bincount(r[fresh], minlength=n)


def featurise(column: pa.Array, stated: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row borders, feature numbers, values) of slices of rows.

    Words are features 0 to BUCKETS - 1; statistic k in bin j is BUCKETS + k * BINS + j.
    """
    for lo, hi, buf, offsets in bk.text_slices(column):
        n = hi - lo
        size = np.maximum(np.diff(offsets), 1)
        starts, ends, first = bk.word_spans(buf, offsets, bk.NONSPACE)
        hashes = bk.word_hashes(buf, starts, ends)
        counts = np.diff(first)
        row = np.repeat(np.arange(n), counts)
        bucket = (hashes >> np.uint64(64 - 14)).astype(np.int64)

        stats = np.zeros((n, len(STATISTICS)))
        for k in range(len(_CLASSES)):
            stats[:, k] = np.sqrt(_row_sums(_TABLES[k][buf], offsets) / size)
        k = len(_CLASSES)
        letters = np.diff(offsets) - _row_sums((buf >= 128) & (buf < 192), offsets)  # characters
        many = np.maximum(counts, 1)
        stats[:, k] = np.log1p(np.diff(offsets)) / 12
        stats[:, k + 1] = np.bincount(row, ends - starts, minlength=n) / many / 16
        stats[:, k + 2] = _distinct(row, hashes, n) / many
        same = np.zeros(len(hashes), dtype=bool)
        same[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
        stats[:, k + 3] = np.bincount(row[same], minlength=n) / many
        newline = np.flatnonzero(buf == 10)
        edges = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], newline + 1]))
        edges = edges[edges < len(buf)] if len(buf) else edges[:0]
        if len(edges):
            owner = np.searchsorted(offsets, edges, "right") - 1
            stop = np.minimum(np.append(edges[1:], len(buf)), offsets[owner + 1])
            lines = bk.word_hashes(buf, edges, stop)
            n_lines = np.bincount(owner, minlength=n)
            stats[:, k + 4] = np.log1p(n_lines) / 8
            stats[:, k + 5] = 1 - _distinct(owner, lines, n) / np.maximum(n_lines, 1)
        stats[:, k + 6] = np.bincount(row[(ends - starts) <= 4], minlength=n) / many
        given = stated[lo:hi]
        stats[:, k + 7] = np.clip(np.log((1 + np.where(np.isfinite(given), given, letters)) / (1 + letters)) / 8 + 0.5, 0, 1)

        # log counts of hashed words, unit length per row
        key = row * BUCKETS + bucket
        key, count = np.unique(key, return_counts=True)
        w_row, w_feature = key // BUCKETS, key % BUCKETS
        value = np.log1p(count)
        norm = np.sqrt(np.bincount(w_row, value * value, minlength=n))
        value = value / np.maximum(norm, 1e-12)[w_row]
        bins = np.clip((stats * BINS).astype(np.int64), 0, BINS - 1)
        s_feature = (BUCKETS + np.arange(len(STATISTICS)) * BINS + bins).ravel()
        s_row = np.repeat(np.arange(n), len(STATISTICS))
        rows = np.concatenate([w_row, s_row])
        order = np.argsort(rows, kind="stable")
        yield lo, np.searchsorted(rows[order], np.arange(n + 1)), np.concatenate([w_feature, s_feature])[order], np.concatenate([value, np.full(len(s_row), 0.5)])[order]


N_FEATURES = BUCKETS + len(STATISTICS) * BINS


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    constant: float | None = None


def _segments(x: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Sums of rows' runs; every run has the statistics, so none is empty."""
    return np.add.reduceat(x, borders[:-1], axis=0)


def raw_scores(m: Machine, borders: np.ndarray, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
    v = m.factors[feature] * value[:, None]
    sums = _segments(v, borders)
    return m.bias + _segments(m.linear[feature] * value, borders) + 0.5 * ((sums * sums).sum(axis=1) - _segments((v * v).sum(axis=1), borders))


def train(column: pa.Array, stated: np.ndarray, good: list[int]) -> Machine:
    y = np.array(good, dtype=np.float64)
    zero = np.zeros(N_FEATURES), np.zeros((N_FEATURES, RANK))
    if not len(y) or y.min() == y.max():
        return Machine(0.0, *zero, float(y.mean()) if len(y) else 0.0)
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    for _, borders, feature, value in featurise(column, stated):
        rows += [(feature[a:b], value[a:b]) for a, b in zip(borders[:-1], borders[1:], strict=True)]
    rng = np.random.default_rng(11)
    m = Machine(0.0, zero[0], rng.normal(0, 0.01, (N_FEATURES, RANK)))
    g_bias, g_linear, g_factors = 1e-3, np.full(N_FEATURES, 1e-3), np.full((N_FEATURES, RANK), 1e-3)
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    rate, decay = 0.1, 1e-4
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), 64):
            some = order[lo : lo + 64]
            feature = np.concatenate([rows[i][0] for i in some])
            value = np.concatenate([rows[i][1] for i in some])
            borders = np.concatenate([[0], np.cumsum([len(rows[i][0]) for i in some])])
            error = (1 / (1 + np.exp(-np.clip(raw_scores(m, borders, feature, value), -30, 30))) - y[some]) * weight[some] / len(some)
            v = m.factors[feature]
            each = np.repeat(np.arange(len(some)), np.diff(borders))
            sums = _segments(v * value[:, None], borders)
            used, place = np.unique(feature, return_inverse=True)
            d_linear = np.bincount(place, error[each] * value, minlength=len(used)) + decay * m.linear[used]
            grad = error[each][:, None] * value[:, None] * (sums[each] - v * value[:, None])
            d_factors = np.stack([np.bincount(place, grad[:, f], minlength=len(used)) for f in range(RANK)], axis=1) + decay * m.factors[used]
            d_bias = error.sum()
            # Adagrad steps
            g_bias += d_bias**2
            g_linear[used] += d_linear**2
            g_factors[used] += d_factors**2
            m.bias -= rate * d_bias / np.sqrt(g_bias)
            m.linear[used] -= rate * d_linear / np.sqrt(g_linear[used])
            m.factors[used] -= rate * d_factors / np.sqrt(g_factors[used])
    seen = np.zeros(N_FEATURES, dtype=bool)
    for feature, _ in rows:
        seen[feature] = True
    m.linear[~seen] = 0
    m.factors[~seen] = 0
    return m


def score_rows(m: Machine, column: pa.Array, stated: np.ndarray) -> np.ndarray:
    if m.constant is not None:
        return np.full(len(column), m.constant)
    out = np.zeros(len(column))
    for lo, borders, feature, value in featurise(column, stated):
        out[lo : lo + len(borders) - 1] = raw_scores(m, borders, feature, value)
    return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def _stated(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("n_chars").cast(pa.float64()).fill_null(np.nan))


def fit(docs: DataFrame, labels: DataFrame, allowed: Column) -> Machine:
    stated = F.col("n_chars").cast("double").alias("n_chars")
    sample = labelled_sample(bounded_batches(docs), labels, "quality", allowed, SAMPLE, SAMPLE_CHARS, stated)

    def trainer(texts: list[str], good: list[int], chars: list[float | None]) -> Machine:
        return train(pa.array(texts, pa.string()), np.array([np.nan if c is None else c for c in chars], dtype=np.float64), good)

    return train_in_task(sample, trainer, "n_chars")


def score_documents(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score_rows(machine, batch.column("text"), _stated(batch)))], ["doc_id", "score"])

    return bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("n_chars").cast("double").alias("n_chars")).mapInArrow(bk.tidy(run), "doc_id long, score double")
