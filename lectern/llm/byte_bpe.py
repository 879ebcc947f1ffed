"""Byte-level BPE with a hierarchical-bitmap rank queue.

A pre-token is a linked list of token ids.  Every adjacent pair that merges sits
in the bucket of its merge rank; a bitmap over the ranks, under a bitmap over
its leaves, gives the least rank with a waiting pair by find-first-set, in
constant time whatever the pre-token's length.  A bucket yields its leftmost position first.
Entries are never removed early: one whose pair has since changed is stale and
skipped when it comes up.  A pre-token of n bytes takes O(n log n) steps, so
one of a million bytes is no special case.

Texts are split by the pattern as the tiktoken library splits them.  The pattern
engine here knows newer Unicode tables than that library; a character that the
two put into different classes is read as a stand-in of the library's class
while the text is split, and as itself in the pieces.

Defined results: null is the empty text, which has no ids; long texts are split
into pre-tokens piece by piece; rows keep their repeats; an empty table gives no
rows; further columns stay as they are, but one named like the result is
replaced by it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Callable, Iterator
from functools import cache
from heapq import heappop, heappush
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .bytekit import tidy
from .workspace import bounded_batches

#: Pre-tokens kept per generation of a worker's memo; two generations are held.
MEMO_ENTRIES = 250_000
_LONG = 1 << 20
#: Ranks of one leaf bitmap: 2**LEAF.
LEAF = 8
LEAF_MASK = (1 << LEAF) - 1
_BIT = [1 << k for k in range(1 << 12)]


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Token bytes and ids of a rank file."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}


def _token_bytes(ranks: dict[bytes, int]) -> list[bytes]:
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def decode_ids(table: list[bytes], packed: bytes) -> bytes:
    return b"".join(map(table.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@cache
def stand_ins(pattern: str) -> dict[int, str]:
    """By code point, a character to split by in its place: one whose classes are those that tiktoken sees.

    Every code point is asked for each class that the pattern names, once by
    each engine.  Stand-ins are no ASCII, so that no literal of the pattern
    takes them.
    """
    import tiktoken

    text = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    single = {bytes([b]): b for b in range(256)}
    classes = np.zeros((2, 0x110000), dtype=np.uint32)  # bit k: in the k-th class

    def mark(engine: int, k: int, members: str) -> None:
        classes[engine, np.frombuffer(members.encode("utf-32-le"), dtype=np.uint32)] |= np.uint32(1 << k)

    for k, name in enumerate(sorted(set(re.findall(r"\\p\{[^}]*\}|\\s", pattern)))):
        asked = tiktoken.Encoding(name, pat_str=name, mergeable_ranks=single, special_tokens={})
        mark(0, k, "".join(regex.findall(name, text)))
        mark(1, k, bytes(asked.encode_ordinary(text)).decode())
    ours, theirs = classes
    alike = np.flatnonzero((ours == theirs) & (np.arange(0x110000) >= 0x80))
    alike = alike[(alike < 0xD800) | (alike >= 0xE000)]
    kinds, first = np.unique(ours[alike], return_index=True)
    usable = {int(k): chr(alike[i]) for k, i in zip(kinds, first, strict=True)}
    return {int(c): usable[int(theirs[c])] for c in np.flatnonzero(ours != theirs)}


def _ranges(points: list[int]) -> str:
    """A character class of these code points."""
    out: list[list[int]] = []
    for c in sorted(points):
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out) + "]"


class Tokenizer:
    """Encoder and decoder over a table of token bytes and ids (the ids are merge ranks)."""

    def __init__(self, content: bytes, pattern: str, memo: int = MEMO_ENTRIES, instead: dict[int, str] | None = None):
        ranks = self.ranks = read_ranks(content)
        self.vocab = _token_bytes(ranks)
        self.size = len(self.vocab)
        self.byte_id = [ranks[bytes([b])] for b in range(256)]
        # Merge rank by the ids of both halves, for every split of every token.
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left * self.size + right] = rank
        self.pattern = regex.compile(pattern)
        self.instead = stand_ins(pattern) if instead is None else instead
        self.odd = re.compile(_ranges(list(self.instead))) if self.instead else None
        self.latin = min(self.instead, default=0x110000) > 0xFF  # no Latin-1 character needs a stand-in
        self.leaf = [0] * ((self.size >> LEAF) + 1)
        self.memo = _Memo(self, memo)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token.

        The queue's steps stand in line, as a call each would cost more than they
        do.  `leaf[a]` has a bit for each waiting rank from a << LEAF on, `summary`
        a bit for each leaf that has one; both are empty between pre-tokens.
        """
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        ids = [self.byte_id[b] for b in piece]
        n, size, find, leaf, bit = len(ids), self.size, self.pairs.get, self.leaf, _BIT
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # rank at which a position's pair merges now; None if it does not
        waiting = [find(a * size + b) for a, b in pairwise(ids)]
        waiting.append(None)
        summary, bucket = 0, {}
        for i, rank in enumerate(waiting):
            if rank is None:
                continue
            if rank in bucket:
                bucket[rank].append(i)  # positions rise, so a list is a heap
            else:
                bucket[rank] = [i]
                a = rank >> LEAF
                summary |= bit[a]
                leaf[a] |= bit[rank & LEAF_MASK]
        while summary:
            # find first set: the least rank that waits, then its leftmost position
            a = (summary & -summary).bit_length() - 1
            w = leaf[a]
            rank = (a << LEAF) + (w & -w).bit_length() - 1
            held = bucket[rank]
            if len(held) > 1:
                i = heappop(held)
            else:
                i = held[0]
                del bucket[rank]
                w &= w - 1
                leaf[a] = w
                if not w:
                    summary &= summary - 1
            if waiting[i] != rank:
                continue  # stale
            ids[i] = rank
            gone = after[i]
            waiting[gone] = None
            j = after[i] = after[gone]
            h = before[i]
            if j < n:
                before[j] = i
                new = waiting[i] = find(rank * size + ids[j])
                if new is not None:
                    if new in bucket:
                        heappush(bucket[new], i)
                    else:
                        bucket[new] = [i]
                        a = new >> LEAF
                        summary |= bit[a]
                        leaf[a] |= bit[new & LEAF_MASK]
            else:
                waiting[i] = None
            if h >= 0:
                new = waiting[h] = find(ids[h] * size + rank)
                if new is not None:
                    if new in bucket:
                        heappush(bucket[new], h)
                    else:
                        bucket[new] = [h]
                        a = new >> LEAF
                        summary |= bit[a]
                        leaf[a] |= bit[new & LEAF_MASK]
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def plain(self, text: str) -> bool:
        """Whether no character needs a stand-in."""
        if self.odd is None or text.isascii():
            return True
        if self.latin:
            try:
                text.encode("latin-1")
                return True
            except UnicodeEncodeError:
                pass
        return not self.odd.search(text)

    def pieces(self, text: str) -> Iterator[str]:
        """The text's pre-tokens."""
        if self.plain(text):
            return (m.group() for m in self.pattern.finditer(text))
        return (text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.instead)))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if len(text) <= _LONG and self.plain(text):
            return b"".join(map(self.memo.__getitem__, self.pattern.findall(text)))
        found, parts = self.pieces(text), []
        while some := list(islice(found, 1 << 16)):
            parts.append(b"".join(map(self.memo.__getitem__, some)))
        return b"".join(parts)

    def decode(self, packed: bytes) -> bytes:
        return decode_ids(self.vocab, packed)


class _Memo(dict):
    """Packed ids by pre-token, in two bounded generations."""

    def __init__(self, owner: Tokenizer, limit: int):
        self.owner, self.limit, self.old = owner, limit, {}

    def __missing__(self, token: str) -> bytes:
        value = self.old.get(token)
        if value is None:
            value = _pack(self.owner.merge(token.encode()))
        if len(token) <= 64:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[token] = value
        return value


_loaded: dict[tuple[bytes, str], Tokenizer] = {}


def tokenizer(content: bytes, pattern: str, instead: dict[int, str] | None = None) -> Tokenizer:
    """One tokenizer per worker process and vocabulary."""
    key = (hashlib.sha256(content).digest(), pattern)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Tokenizer(content, pattern, instead=instead)
    return _loaded[key]


def _with(frame: DataFrame, name: str, made: Callable[[], Callable[[pa.RecordBatch], pa.Array]]) -> DataFrame:
    """The rows with a binary column of what `made()` gives for each batch, in place of any column of that name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = made()
        for batch in batches:
            kept = [c for c in batch.schema.names if c != name]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), one(batch)], [*kept, name])

    schema = StructType([*(f for f in frame.schema if f.name != name), StructField(name, BinaryType())])
    return bounded_batches(frame).mapInArrow(tidy(run), schema)


def encode_column(docs: DataFrame, vocabulary: bytes, pattern: str, text: str = "text") -> DataFrame:
    """The rows with `ids`: the text's token ids as packed little-endian unsigned 32-bit integers."""
    instead = stand_ins(pattern)

    def made() -> Callable[[pa.RecordBatch], pa.Array]:
        t = tokenizer(vocabulary, pattern, instead)
        return lambda batch: pa.array([t.encode(x.as_py() or "") for x in batch.column(text)], pa.binary())

    return _with(docs, "ids", made)


def decode_column(rows: DataFrame, vocabulary: bytes, ids: str = "ids") -> DataFrame:
    """The rows with `decoded`: the bytes that the packed ids stand for."""

    def made() -> Callable[[pa.RecordBatch], pa.Array]:
        table = _token_bytes(read_ranks(vocabulary))  # a decoder needs neither merges nor memo
        return lambda batch: pa.array([decode_ids(table, x.as_py() or b"") for x in batch.column(ids)], pa.binary())

    return _with(rows, "decoded", made)


def round_trip_digest(docs: DataFrame, vocabulary: bytes, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every text encoded, the ids decoded again."""
    rows = decode_column(encode_column(docs.select("doc_id", "text"), vocabulary, pattern).drop("text"), vocabulary)
    return rows.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
