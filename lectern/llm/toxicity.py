"""Toxicity: a subsequence string-kernel SVM with Nyström landmarks.

The kernel counts common subsequences of four letters or word edges, each
weighted by DECAY ** (letters it spans) and spanning at most seven, so "idxiot"
keeps much of the weight of "idiot"; signs put between letters span nothing.
Texts are cut into sentences, at a terminator after a word or at an empty line
(sentences shorter than a window join the one before), and no subsequence or window reaches over a sentence's end; a sentence's windows
have at most WINDOW characters.  Landmarks are words and beginnings of words of
the labelled sentences: those most tied to the toxic label, and common ones.
With the landmarks' kernel matrix K, a window x maps to K**(-1/2) k(x, landmarks),
and a squared-hinge linear SVM is trained on these maps.  Only texts carry
labels, so each round takes the top-scoring window of every toxic text as its
positive one (mi-SVM), against windows of clean texts.

A trained machine is sum(alpha * k(x, landmark)), and the kernel's feature space
is explicit: the same sum is one weight per four-letter subsequence.  Scoring
looks these weights up for all texts of a batch at once, in time linear in the
text; a text's score is calibrated on its TOP worst windows, with MISS_COST for
a toxic text that is missed.

Training reads at most SAMPLE labelled texts of each class, picked by a hash,
and at most SAMPLE_CHARS / 2 characters of each class in the same order, so a
text longer than that never trains; scoring reads whole texts.  Defined results:
null and empty texts get the score of a text without any subsequence; without
labelled rows of both classes every score is the share of toxic labels (0
without any); rows are answered one by one; null labels are left out and
repeated label rows taken once; an empty table gives no rows; further columns
are ignored, or kept as they are by keep_clean.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytekit as bk
from .workspace import bounded_batches

DECAY = 0.8
LENGTH = 4
SPAN = 7
WINDOW = 24
LANDMARKS = 384
MIN_TIE = 2.5
LEAST = 3
#: Characters that training and scoring work on at a time, so that temporaries stay small; a longer text is one part.
_PART = 1 << 18
TOP = 3
FOLDS = 3
SAMPLE = 3000
SAMPLE_CHARS = 12_000_000
ROUNDS = 3
#: A missed toxic text counts as this many clean texts marked, when scores are calibrated.
MISS_COST = 3.0

#: Letters by code from 2 on; 0 is a text's end and 1 the edge of a word.
_LETTERS = "abcdefghijklmnopqrstuvwxyzäöüßàâáèéêëíìîïòóôùúûñç"
ALPHABET = 2 + len(_LETTERS)
EDGE = 1
# Signs that stand in for letters.
_STAND_INS = (("0", "o"), ("1", "i"), ("3", "e"), ("4", "a"), ("5", "s"), ("7", "t"), ("@", "a"), ("$", "s"))


def _code_table() -> np.ndarray:
    """Codes of the characters below U+0180."""
    t = np.full(0x180, EDGE, dtype=np.uint8)
    for i, c in enumerate(_LETTERS):
        t[ord(c)] = 2 + i
        if len(c.upper()) == 1:
            t[ord(c.upper())] = 2 + i
    for sign, letter in _STAND_INS:
        t[ord(sign)] = t[ord(letter)]
    t[0] = 0
    return t


_CODES = _code_table()
_GAPS = [(a, b, c) for a in range(1, SPAN) for b in range(a + 1, SPAN) for c in range(b + 1, SPAN)]
_POWER = {span: np.float32(DECAY**span) for span in range(LENGTH, SPAN + 1)}


def text_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes of all texts, WINDOW ends after each, and the texts' borders.

    Signs between two letters ("i.d-iot") and spaces between lone letters
    ("i d i o t") are left out, so that they cost no gap; other runs of
    characters that are no letters are one edge, as are a text's two ends.  An
    edge that ends a sentence becomes an edge, SPAN - 1 ends and an edge.
    """
    joined = "".join(f" {t} " + "\0" * WINDOW for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = _CODES[np.minimum(points, 0x17F)]
    codes[points >= 0x180] = EDGE
    n = len(codes)
    lengths = np.array([len(t) for t in texts], dtype=np.int64) + WINDOW + 2
    borders = np.concatenate([[0], np.cumsum(lengths)])
    if not n:
        return codes, borders
    blank = (points == 32) | ((points >= 9) & (points <= 13)) | (points == 0)
    letter = codes > EDGE
    sign = ~letter & ~blank
    stop = _sentence_ends(points, letter, blank)
    at = np.arange(n, dtype=np.int32)
    before = np.maximum.accumulate(np.where(sign, -1, at))
    after = np.minimum.accumulate(np.where(sign, n, at)[::-1])[::-1]
    keep = ~sign | ~(letter[before] & (before >= 0) & letter[np.minimum(after, n - 1)] & (after < n))
    kept = np.concatenate([[0], np.cumsum(keep)])
    codes, blank, letter, stop, borders = codes[keep], blank[keep], letter[keep], stop[keep], kept[borders]
    alone = letter.copy()
    alone[1:] &= ~letter[:-1]
    alone[:-1] &= ~letter[1:]
    keep = np.ones(len(codes), dtype=bool)
    keep[1:-1] = ~((codes[1:-1] == EDGE) & blank[1:-1] & alone[:-2] & alone[2:])
    kept = np.concatenate([[0], np.cumsum(keep)])
    codes, stop, borders = codes[keep], stop[keep], kept[borders]
    # A run of edges is one, and ends a sentence if any of its characters does and a letter follows.
    first = np.ones(len(codes), dtype=bool)
    first[1:] = (codes[1:] != EDGE) | (codes[:-1] != EDGE)
    run = np.flatnonzero(first)
    ends = np.add.reduceat(stop.astype(np.int64), run) > 0
    codes, borders = codes[run], np.concatenate([[0], np.cumsum(first)])[borders]
    ends &= codes == EDGE
    ends[:-1] &= codes[1:] > EDGE
    ends[0] = ends[-1] = False
    ends[1:] &= codes[:-1] > EDGE
    stops = np.flatnonzero(ends)
    since = np.maximum(np.append(-WINDOW, stops[:-1]), borders[np.searchsorted(borders, stops, "right") - 1]) if len(stops) else stops
    ends[stops[stops - since < WINDOW]] = False
    many = np.where(ends, SPAN + 1, 1)
    place = np.concatenate([[0], np.cumsum(many)])
    codes = np.repeat(codes, many)
    gaps = place[:-1][ends]
    codes[(gaps[:, None] + np.arange(1, SPAN)).ravel()] = 0
    return codes, place[borders]


def _sentence_ends(points: np.ndarray, letter: np.ndarray, blank: np.ndarray) -> np.ndarray:
    """Terminators before white space whose word has two letters at least ("i. d. i. o. t." is no five sentences), and empty lines."""
    out = np.zeros(len(points), dtype=bool)
    mark = (points == 33) | (points == 46) | (points == 63) | (points == 0x2026) | (points == 0x3002)
    word = np.zeros(len(points), dtype=bool)  # the two characters before are letters, or a terminator of that kind
    word[2:] = letter[1:-1] & letter[:-2]
    out[:-1] = mark[:-1] & word[:-1] & blank[1:]
    out[1:] |= mark[1:] & mark[:-1] & np.append(blank[2:], True)
    line = points == 10
    out[1:] |= line[1:] & line[:-1]
    return out


def _subsequences(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.float32]]:
    """(feature number at each start, weight) for each gap pattern.

    Subsequences take letters and edges; one that runs over a text's end holds a
    code of 0, and no feature that is used does.
    """
    n = len(codes) - SPAN + 1
    if n <= 0:
        return
    codes = codes.astype(np.int32)
    pair = {d: codes[: len(codes) - d] * ALPHABET + codes[d:] for d in range(1, SPAN)}
    for a, b, c in _GAPS:
        yield pair[a][:n] * (ALPHABET * ALPHABET) + pair[c - b][b : n + b], _POWER[c + 1]


def response(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """At each position, the weights of the subsequences that start there; long texts go in parts."""
    out = np.zeros(len(codes), dtype=np.float32)
    for lo in range(0, len(codes), bk.SLICE_BYTES):
        for feature, power in _subsequences(codes[lo : lo + bk.SLICE_BYTES + SPAN - 1]):
            out[lo : lo + len(feature)] += weights[feature] * power
    return out


def window_scores(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Score of the window that starts at each position and ends with its sentence at the latest."""
    sums = np.concatenate([[0.0], np.cumsum(response(codes, weights), dtype=np.float64)])
    at = np.arange(len(codes))
    end = np.minimum.accumulate(np.where(codes == 0, at, len(codes))[::-1])[::-1]
    return sums[np.minimum(at + WINDOW - SPAN + 1, end)] - sums[:-1]


def _profile(landmark: str) -> dict[int, float]:
    """A landmark's subsequence weights; a space is an edge."""
    codes = np.concatenate([[EDGE if c == " " else _CODES[ord(c)] if ord(c) < 0x180 else EDGE for c in landmark], np.zeros(SPAN, np.int64)]).astype(np.uint8)
    out: dict[int, float] = {}
    for feature, power in _subsequences(codes):
        for f in feature.tolist():
            if all(f // ALPHABET**k % ALPHABET for k in range(LENGTH)):
                out[f] = out.get(f, 0.0) + float(power)
    return out


@dataclass
class Machine:
    """Weight of each four-letter subsequence, and the calibration of a text's top windows."""

    features: np.ndarray
    values: np.ndarray
    slopes: np.ndarray
    shift: float
    constant: float | None = None

    def table(self) -> np.ndarray:
        return _table(self.features, self.values)


def _top(codes: np.ndarray, borders: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores (0 at least, falling) and starts of each text's TOP best windows that do not overlap."""
    best = np.zeros((len(borders) - 1, TOP))
    at = np.repeat(borders[:-1, None], TOP, axis=1)
    lo = 0
    while lo < len(best):  # whole texts, some at a time
        hi = max(lo + 1, int(np.searchsorted(borders, borders[lo] + _PART, "right")) - 1)
        base = int(borders[lo])
        scores = window_scores(codes[base : borders[hi]], weights)
        for i in range(lo, hi):
            a, b = int(borders[i]) - base, int(borders[i + 1]) - base - WINDOW
            for k in range(TOP if b > a else 0):
                j = a + int(scores[a:b].argmax())
                if scores[j] <= 0:
                    break
                best[i, k], at[i, k] = scores[j], base + j
                scores[max(a, j - WINDOW) : j + WINDOW] = 0
        lo = hi
    return best, at


def _strings(text: str) -> set[str]:
    """A text's words with their edges, and the beginnings of long words."""
    out = set()
    for w in text.lower().split():
        w = "".join(c for c in w if c.isalpha())
        if LENGTH <= len(w) <= WINDOW - 2:
            out.add(f" {w} ")
            out.update(f" {w[:k]}" for k in range(LENGTH, min(len(w), 8)))
    return out


def _string_numbers(texts: list[str]) -> tuple[list[np.ndarray], dict[int, str]]:
    """Each text's strings as hashes, and the strings of those that at least LEAST texts hold.

    Most strings are rare and are never kept as strings.
    """
    numbers = [np.unique(np.array([crc32(w.encode()) for w in _strings(t)], dtype=np.uint32)) for t in texts]
    found, many = np.unique(np.concatenate(numbers), return_counts=True)
    often = set(found[many >= min(LEAST, many.max(initial=1))].tolist())
    names: dict[int, str] = {}
    for t in texts:
        for w in _strings(t):
            if (h := crc32(w.encode())) in often:
                names[h] = min(w, names.get(h, w))
    return numbers, names


def _counts(numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate(numbers) if numbers else np.zeros(0, np.uint32), return_counts=True)


def _pick_landmarks(numbers: list[np.ndarray], toxic: np.ndarray, names: dict[int, str]) -> tuple[list[str], np.ndarray]:
    """Landmark strings, and how strongly each is tied to the toxic label (standard deviations over chance, 0 for common ones)."""
    bad, n = _counts([x for x, y in zip(numbers, toxic, strict=True) if y])
    bad, n = bad[n >= LEAST], n[n >= LEAST]
    every, seen = _counts(numbers)
    seen = seen[np.searchsorted(every, bad)]
    base = toxic.mean()
    tie = dict(zip(bad.tolist(), ((n - base * seen) / np.sqrt(base * (1 - base) * seen + 1)).tolist(), strict=True))
    tied = sorted((h for h, t in tie.items() if t > MIN_TIE), key=lambda h: (-tie[h], names[h]))[: LANDMARKS * 3 // 4]
    most = min(LANDMARKS - len(tied), max(32, len(tied)))
    clean, m = _counts([x for x, y in zip(numbers, toxic, strict=True) if not y])
    floor = np.sort(m)[-min(len(m), most + len(tied))] if len(m) else 0
    have = set(tied)
    common = sorted(((-k, names[h]) for h, k in zip(clean[m >= floor].tolist(), m[m >= floor].tolist(), strict=True) if h in names and h not in have))[:most]
    return [names[h] for h in tied] + [w for _, w in common], np.array([tie[h] for h in tied] + [0.0] * len(common))


def _svm(maps: np.ndarray, pick: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1.0, steps: int = 12, block: int = 4096) -> np.ndarray:
    """Squared-hinge linear SVM on the picked rows by Newton steps on the violated ones; the last weight is the bias.

    Rows are taken in blocks, so nothing of the size of `maps` is held beside it.
    """
    size = maps.shape[1] + 1
    w = np.zeros(size)
    penalty = np.full(size, ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        active = np.flatnonzero(y * ((maps @ w[:-1].astype(np.float32))[pick] + w[-1]) < 1)
        left, right = np.diag(penalty), np.zeros(size)
        for lo in range(0, len(active), block):
            some = active[lo : lo + block]
            x = np.concatenate([maps[pick[some]].astype(np.float64), np.ones((len(some), 1))], axis=1)
            weighted = x * cost[some, None]
            left += weighted.T @ x
            right += weighted.T @ y[some]
        new = np.linalg.solve(left, right)
        if np.allclose(new, w, rtol=1e-6, atol=1e-9):
            break
        w = new
    return w


def _logistic(scores: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Platt's slopes and shift of the top windows' scores; slopes are kept from falling below 0."""
    scale = float(np.abs(scores[:, 0]).mean()) or 1.0
    cost = np.where(y > 0, MISS_COST, 1.0)
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    use = list(range(scores.shape[1]))
    while True:
        x = np.concatenate([scores[:, use] / scale, np.ones((len(y), 1))], axis=1)
        penalty = np.diag([0.1] * len(use) + [1e-6])
        w = np.zeros(len(use) + 1)
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (cost * p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (cost * (p - target)) + penalty @ w)
            w -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
            if np.abs(step).max() < 1e-8:
                break
        low = [k for k, v in zip(use, w, strict=False) if v < 0]
        if not low or len(use) == 1:
            break
        use = [k for k in use if k not in low] or [0]
    slopes = np.zeros(scores.shape[1])
    slopes[use] = np.maximum(w[:-1], 0) / scale
    return slopes, float(w[-1])


def _codes_in_parts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """text_codes of some texts at a time."""
    parts, borders, lo, size = [], [np.zeros(1, dtype=np.int64)], 0, 0
    for hi, text in enumerate(texts, 1):
        size += len(text)
        if size >= _PART or hi == len(texts):
            codes, some = text_codes(texts[lo:hi])
            parts.append(codes)
            borders.append(some[1:] + borders[-1][-1])
            lo, size = hi, 0
    return np.concatenate(parts), np.concatenate(borders)


def train(texts: list[str], toxic: list[int]) -> Machine:
    """A machine on all texts, calibrated on its scores and on those each third gets from a machine on the others."""
    y = np.array(toxic, dtype=np.float64)
    none = np.zeros(0, np.int64), np.zeros(0, np.float32)
    if not len(y) or y.min() == y.max():
        return Machine(*none, np.zeros(TOP), 0.0, float(y.mean()) if len(y) else 0.0)
    numbers, names = _string_numbers(texts)
    fold = np.zeros(len(y), dtype=np.int64)
    for label in (0, 1):
        rows = np.flatnonzero(y == label)
        fold[rows] = np.arange(len(rows)) % FOLDS
    unseen = np.zeros((len(y), TOP))
    for k in range(FOLDS):
        inside, outside = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if not len(outside) or y[inside].min() == y[inside].max():
            continue
        table = _table(*_fit([texts[i] for i in inside], y[inside], [numbers[i] for i in inside], names))
        unseen[outside], _ = _top(*_codes_in_parts([texts[i] for i in outside]), table)
    features, values = _fit(texts, y, numbers, names)
    # Scores of texts left out are a little low, as their machines saw less; those of texts learnt from are high.
    seen, _ = _top(*_codes_in_parts(texts), _table(features, values))
    return Machine(features, values, *_logistic(np.concatenate([unseen, seen]), np.concatenate([y, y])))


def _table(features: np.ndarray, values: np.ndarray) -> np.ndarray:
    t = np.zeros(ALPHABET**LENGTH, dtype=np.float32)
    t[features] = values
    return t


def _fit(texts: list[str], y: np.ndarray, numbers: list[np.ndarray], names: dict[int, str]) -> tuple[np.ndarray, np.ndarray]:
    """Subsequence numbers and weights of the machine trained on these texts."""
    landmarks, tie = _pick_landmarks(numbers, y, names)
    if not landmarks:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    profiles = [_profile(w) for w in landmarks]
    features = np.array(sorted({f for p in profiles for f in p}), dtype=np.int64)
    place = {int(f): i for i, f in enumerate(features)}
    rows = np.zeros((len(landmarks), len(features)))
    for i, p in enumerate(profiles):
        for f, v in p.items():
            rows[i, place[f]] = v
    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
    kernel = rows @ rows.T
    value, vector = np.linalg.eigh(kernel)
    keep = value > 1e-6 * value.max()
    nystrom = (rows.T @ (vector[:, keep] / np.sqrt(value[keep]))).astype(np.float32)  # features -> K**(-1/2) k(x, landmarks), up to a rotation

    number = np.zeros(ALPHABET**LENGTH, dtype=np.int32)
    number[features] = np.arange(1, len(features) + 1)
    codes, borders = _codes_in_parts(texts)

    def maps(starts: np.ndarray) -> np.ndarray:
        """Nyström maps of the windows at these positions."""
        out = np.zeros((len(starts), nystrom.shape[1]), dtype=np.float32)
        for lo in range(0, len(starts), 256):
            part = starts[lo : lo + 256]
            at = np.minimum(part[:, None] + np.arange(WINDOW), len(codes) - 1)
            windows = codes[at].astype(np.int32)
            windows[np.maximum.accumulate(windows == 0, axis=1)] = 0  # nothing after the sentence's end
            count = np.zeros((len(part), len(features) + 1), dtype=np.float32)
            row = np.arange(len(part))[:, None]
            n = WINDOW - SPAN + 1
            for a, b, c in _GAPS:
                f = ((windows[:, :n] * ALPHABET + windows[:, a : n + a]) * ALPHABET + windows[:, b : n + b]) * ALPHABET + windows[:, c : n + c]
                np.add.at(count, (np.broadcast_to(row, f.shape), number[f]), float(_POWER[c + 1]))
            out[lo : lo + 256] = count[:, 1:] @ nystrom
        return out

    # Round 0 scores with the landmarks' own ties to the label.
    table = np.zeros(ALPHABET**LENGTH, dtype=np.float32)
    table[features] = tie**3 @ rows
    rng = np.random.default_rng(7)
    clean = np.flatnonzero(y == 0)
    pool = np.array([], dtype=np.int64)
    mapped, vectors = np.array([], dtype=np.int64), np.zeros((0, nystrom.shape[1]), dtype=np.float32)
    for _ in range(ROUNDS):
        best, at = _top(codes, borders, table)
        positive = at[y == 1, 0]
        lengths = np.maximum(borders[clean + 1] - borders[clean] - WINDOW, 1)
        # the worst windows of every clean text so far, and one at random
        pool = np.unique(np.concatenate([pool, at[clean].ravel(), borders[clean] + (rng.random(len(clean)) * lengths).astype(np.int64)]))
        starts = np.concatenate([positive, pool])
        sign = np.concatenate([np.ones(len(positive)), -np.ones(len(pool))])
        cost = np.where(sign > 0, len(pool) / max(1, len(positive)), 1.0) * 0.5
        fresh = np.setdiff1d(starts, mapped)  # windows of earlier rounds keep their maps
        mapped, vectors = np.concatenate([mapped, fresh]), np.concatenate([vectors, maps(fresh)])
        order = np.argsort(mapped)
        w = _svm(vectors, order[np.searchsorted(mapped, starts, sorter=order)], sign, cost)
        table[:] = 0
        table[features] = nystrom @ w[:-1]
    return features, table[features]


def score_texts(machine: Machine, column: pa.Array) -> np.ndarray:
    if machine.constant is not None:
        return np.full(len(column), machine.constant)
    weights = machine.table()
    out = np.zeros(len(column))
    for lo, hi, buf, offsets in bk.text_slices(column):
        raw = buf.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        best, _ = _top(*text_codes(texts), weights)
        out[lo:hi] = best @ machine.slopes + machine.shift
    return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, most: int, most_chars: int, *more: Column) -> DataFrame:
    """(doc_id, y, text, more) of at most `most` allowed texts of each class, picked by a hash of the id.

    The labelled ids are picked first, so only the picked texts move; each class
    keeps at most half of `most_chars` characters, whole texts only.
    """
    ids = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y")).where(allowed)
    order = F.xxhash64("doc_id")
    picked = None
    for y in (0, 1):
        some = ids.where(F.col("y") == y).orderBy(order, "doc_id").limit(most)
        picked = some if picked is None else picked.union(some)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more).join(F.broadcast(picked), "doc_id")
    # Whole texts in hash order while they fit; lengths decide before any text moves.
    sizes = rows.select("doc_id", "y", F.length("text").alias("n")).groupBy("doc_id", "y").agg(F.sum("n").alias("n")).orderBy(order, "doc_id").collect()
    room, keep = {0: most_chars // 2, 1: most_chars // 2}, []
    for r in sizes:
        if r.n <= room[r.y]:
            room[r.y] -= r.n
            keep.append(r.doc_id)
    return rows.where(F.col("doc_id").isin(keep)) if keep else rows.where("false")


def train_in_task(sample: DataFrame, trainer: Callable[..., object], *more: str) -> object:
    """The machine that `trainer` makes of a bounded sample's texts, labels and further columns.

    Only the sample goes to the one task that trains, by a shuffle, so the scan
    behind it runs in parallel; the driver gets only the machine.
    """
    names = ["doc_id", "text", "y", *more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True)), key=lambda r: r[:3])
        machine = trainer(*([r[k] for r in rows] for k in range(1, len(names))))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(machine)], pa.binary())], ["machine"])

    got = sample.select(*names).repartition(1).mapInArrow(bk.tidy(run), "machine binary").collect()
    return pickle.loads(got[0].machine) if got else trainer(*([] for _ in names[1:]))


def fold_of(doc_id: Column, folds: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def fit(docs: DataFrame, labels: DataFrame, allowed: Column) -> Machine:
    return train_in_task(labelled_sample(bounded_batches(docs), labels, "toxic", allowed, SAMPLE, SAMPLE_CHARS), train)


def score_documents(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score) of every row: 0 to 1, higher where the text is likelier toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score_texts(machine, batch.column("text")))], ["doc_id", "score"])

    return bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(bk.tidy(run), "doc_id long, score double")


def keep_clean(docs: DataFrame, machine: Machine, limit: float = 0.5) -> DataFrame:
    """The rows, unchanged, whose text scores below the limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(score_texts(machine, batch.column("text")) < limit))

    return bounded_batches(docs).mapInArrow(bk.tidy(run), docs.schema)
