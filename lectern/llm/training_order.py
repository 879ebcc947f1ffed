"""Training-order materialisation of token ids in fixed-stride binary shards.

Texts become token ids with an end mark after each and are packed into sequences
of LENGTH ids, partition by partition.  Sequence i of n goes to global slot
P(i), where P is a keyed Feistel permutation on the least even number of bits
that holds n, walked until it falls below n; no table of the permutation exists
anywhere, and P can be inverted to find the sequence of a slot.  Slots are dealt
to tasks by ranges of whole shards and written in slot order: slot s is at byte
(s % PER_SHARD) * stride of shard s // PER_SHARD, so a reader seeks to any slot
and reads on sequentially from there.

A shard is written under a temporary name and then takes its own; a task that
runs again writes the same bytes over it.  Temporary files of attempts that died
are removed at the end.  Sequence numbers follow the scan's partitions and are
fixed once the packed table is written.  Ids come from the tiktoken library; a
text with a run of white space too long for it goes through this package's own
encoder, which gives the same ids.  Defined results: null and empty texts give no
ids; a partition's last sequence is padded with end marks and its true length
kept; repeated rows are packed each; an empty table gives no slots and a manifest
of 0; texts longer than a sequence run over several; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import byte_bpe
from . import bytekit as bk
from .workspace import Workspace, bounded_batches

LENGTH = 1024
PER_SHARD = 8192
ROUNDS = 6
DICTIONARY_BYTES, DICTIONARY_TEXTS, DICTIONARY_CHARS = 1 << 16, 400, 8_000


class Feistel:
    """A keyed permutation of 0 .. n - 1."""

    def __init__(self, n: int, key: bytes):
        self.n = n
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = [np.uint64(int.from_bytes(hashlib.sha256(key + bytes([r])).digest()[:8], "little")) for r in range(ROUNDS)]

    def _step(self, x: np.ndarray, keys: list) -> np.ndarray:
        shift = np.uint64(self.half)
        left, right = x >> shift, x & self.mask
        for k in keys:
            left, right = right, left ^ (bk.mix(right ^ k) & self.mask)
        return (right << shift) | left  # halves swapped, so that the same steps in reverse key order undo it

    def _walk(self, x: np.ndarray, keys: list) -> np.ndarray:
        out = self._step(x.astype(np.uint64), keys)
        while (over := np.flatnonzero(out >= np.uint64(self.n))).size:
            out[over] = self._step(out[over], keys)
        return out.astype(np.int64)

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, self.keys)

    def numbers(self, slots: np.ndarray) -> np.ndarray:
        return self._walk(slots, self.keys[::-1])


#: The library's pattern engine keeps a stack over white space, which overflows in runs of some hundred thousand.
_LONG_BLANK = re.compile(r"(?<!\s)\s{10000}")


def encoder(content: bytes, pattern: str, instead: dict[int, str]) -> Callable[[str], Sequence[int]]:
    """A function from a text to its ids."""
    import tiktoken

    ranks = byte_bpe.read_ranks(content)
    quick = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(text: str) -> Sequence[int]:
        if len(text) < 10_000 or not _LONG_BLANK.search(text):
            return quick(text)
        return np.frombuffer(byte_bpe.tokenizer(content, pattern, instead).encode(text), dtype="<u4").tolist()

    return encode


def _kind(end: int) -> type:
    """Ids are stored in two bytes if the end mark, the highest, fits."""
    return np.uint16 if end < 65536 else np.uint32


def _dictionary(docs: DataFrame, content: bytes, pattern: str, end: int, length: int) -> bytes:
    """A compression dictionary from the beginnings of some texts; it changes sizes in flight, never a result."""
    some = docs.where("length(text) > 0").select(F.substring("text", 1, DICTIONARY_CHARS).alias("text")).limit(DICTIONARY_TEXTS).collect()
    encode = encoder(content, pattern, byte_bpe.stand_ins(pattern))
    ids = np.array([i for r in some for i in [*encode(r.text), end]], dtype=_kind(end))
    rows = [ids[k : k + length].tobytes() for k in range(0, len(ids), length)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, rows).as_bytes()
    except zstandard.ZstdError:  # too little text for one
        return b""


def _compression(dictionary: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}


def _pack(content: bytes, pattern: str, end: int, length: int, dictionary: bytes):
    instead = byte_bpe.stand_ins(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(content, pattern, instead)
        small = zstandard.ZstdCompressor(level=9, **_compression(dictionary))
        part, local = TaskContext.get().partitionId(), 0
        held = np.zeros(0, dtype=np.uint32)

        def out(rows: np.ndarray, sizes: list[int]) -> pa.RecordBatch:
            nonlocal local
            number = np.arange(local, local + len(rows))
            local += len(rows)
            data = [small.compress(r.tobytes()) for r in rows]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), part, np.int32)), pa.array(number), pa.array(sizes, pa.int32()), pa.array(data, pa.binary())], ["part", "local", "n_ids", "ids"])

        kind = _kind(end)
        for batch in batches:
            new = [held]
            for value in batch.column("text"):
                text = value.as_py()
                if text:
                    new.append(np.array([*encode(text), end], dtype=np.uint32))
            ids = np.concatenate(new)
            whole = len(ids) // length
            held = ids[whole * length :]
            if whole:
                yield out(ids[: whole * length].astype(kind).reshape(whole, length), [length] * whole)
        if len(held):
            row = np.full(length, end, dtype=kind)
            row[: len(held)] = held
            yield out(row[None, :], [len(held)])

    return run


def _assign(permutation: Feistel, per_shard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = np.asarray(batch.column("first")) + np.asarray(batch.column("local"))
            slot = permutation.slots(number)
            yield pa.RecordBatch.from_arrays([pa.array(slot // per_shard), pa.array(slot), pa.array(number), batch.column("n_ids"), batch.column("ids")], ["shard", "slot", "number", "n_ids", "ids"])

    return run


def shard_name(shard: int) -> str:
    return f"shard-{shard:06d}.bin"


def _write(folder: str, per_shard: int, stride: int, dictionary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        attempt = TaskContext.get().taskAttemptId()
        plain = zstandard.ZstdDecompressor(**_compression(dictionary))
        file, open_shard, path = None, -1, ""

        def close() -> None:
            if file is not None:
                file.close()
                if fs.get_file_info(path).type != pafs.FileType.NotFound:
                    fs.delete_file(path)  # of an earlier attempt; not every store moves onto a file
                fs.move(f"{path}.{attempt}", path)

        for batch in batches:
            shards, slots = (np.asarray(batch.column(c)) for c in ("shard", "slot"))
            crc = []
            for i, packed in enumerate(batch.column("ids").to_pylist()):
                if shards[i] != open_shard:
                    close()
                    open_shard = int(shards[i])
                    path = f"{base}/{shard_name(open_shard)}"
                    file = fs.open_output_stream(f"{path}.{attempt}")
                data = plain.decompress(packed)
                file.write(data)
                crc.append(zlib.crc32(data))
            yield pa.RecordBatch.from_arrays(
                [batch.column("slot"), batch.column("number"), batch.column("shard"), pa.array((slots % per_shard) * stride), batch.column("n_ids"), pa.array(crc, pa.int64())],
                ["slot", "number", "shard", "byte_offset", "n_ids", "crc32"],
            )
        close()

    return run


def materialise(docs: DataFrame, work: Workspace, folder: str, vocabulary: bytes, pattern: str, end: int, key: bytes, length: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """Write the shards and a manifest to a folder all machines see; one row a sequence comes back.

    Columns: slot, number (of the sequence before the permutation), shard,
    byte_offset, n_ids and crc32 of the slot's bytes.
    """
    docs = bounded_batches(docs.select("text"))
    dictionary = _dictionary(docs, vocabulary, pattern, end, length)
    # Ids are compressed once, and stay so in the packed table and in the shuffle.
    packed = work.table(docs, "packed", kernel=_pack(vocabulary, pattern, end, length, dictionary), schema="part int, local long, n_ids int, ids binary")
    counts = packed.groupBy("part").count().orderBy("part").collect()  # one row a scan task
    first, n = [], 0
    for r in counts:
        first.append((r["part"], n))
        n += r["count"]
    stride = length * np.dtype(_kind(end)).itemsize
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base)
    shards = -(-n // per_shard)
    with fs.open_output_stream(f"{base}/manifest.json") as f:
        f.write(json.dumps({"slots": n, "length": length, "stride": stride, "per_shard": per_shard, "shards": shards, "end": end}, sort_keys=True).encode())
    starts = docs.sparkSession.createDataFrame(first, "part int, first long")
    placed = packed.join(F.broadcast(starts), "part").mapInArrow(_assign(Feistel(n, key), per_shard), "shard long, slot long, number long, n_ids int, ids binary")
    ordered = placed.repartitionByRange(max(1, shards), "shard").sortWithinPartitions("slot")
    index = work.table(ordered, "index", kernel=_write(folder, per_shard, stride, dictionary), schema="slot long, number long, shard long, byte_offset long, n_ids int, crc32 long")
    for file in fs.get_file_info(pafs.FileSelector(base)):
        if re.search(r"\.bin\.[0-9]+$", file.path):
            fs.delete_file(file.path)
    return index


def read_slots(folder: str, start: int, count: int) -> Iterator[np.ndarray]:
    """Ids of `count` slots from `start` on, read sequentially; a reader resumes at any slot."""
    fs, base = pafs.FileSystem.from_uri(folder)
    with fs.open_input_stream(f"{base}/manifest.json") as f:
        m = json.loads(f.read())
    kind = np.dtype("<u2") if m["stride"] == 2 * m["length"] else np.dtype("<u4")
    slot, stop = start, min(start + count, m["slots"])
    while slot < stop:
        shard, at = divmod(slot, m["per_shard"])
        many = min(stop - slot, m["per_shard"] - at)
        with fs.open_input_file(f"{base}/{shard_name(shard)}") as f:
            f.seek(at * m["stride"])
            for _ in range(many):
                yield np.frombuffer(f.read(m["stride"]), dtype=kind)
        slot += many
