"""Token ids against the tiktoken library over all of Unicode and very long runs; training order against a plain rerun."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import tiktoken

from lectern.llm import byte_bpe, training_order
from lectern.llm import queries as Q
from lectern.llm.workspace import Workspace

CONTENT, PATTERN = Q.vocabulary()


@pytest.fixture(scope="module")
def ours():
    return byte_bpe.Tokenizer(CONTENT, PATTERN)


@pytest.fixture(scope="module")
def theirs(ours):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ours.ranks, special_tokens={})


def ids(ours, text):
    return np.frombuffer(ours.encode(text), "<u4").tolist()


def test_every_code_point(ours, theirs):
    points = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x110000))]
    for lo in range(0, len(points), 4096):
        text = "".join(f"a{c}b 1{c}2 !{c}? {c} x  {c}'s" for c in points[lo : lo + 4096])
        assert ids(ours, text) == theirs.encode_ordinary(text)


def test_random_unicode(ours, theirs):
    rng = random.Random(6)
    odd = list(byte_bpe.stand_ins(PATTERN))
    for _ in range(400):
        text = "".join(chr(rng.choice([rng.choice(odd), rng.randrange(0x20, 0x3000), rng.randrange(0x10000, 0x20000), 32, 97, 39, 115])) for _ in range(rng.randint(1, 80)))
        assert ids(ours, text) == theirs.encode_ordinary(text)
        assert ours.decode(ours.encode(text)).decode() == text


@pytest.mark.parametrize("text", ["a" * 2_000_000, "!" * 2_000_000, "中" * 300_000, "x" + " " * 100_000 + "y", "\n" * 90_000])
def test_very_long_pre_tokens(ours, theirs, text):
    assert ids(ours, text) == theirs.encode_ordinary(text)


def test_white_space_too_long_for_the_library(ours):
    text = " " * 2_000_000 + "x"
    encode = training_order.encoder(CONTENT, PATTERN, byte_bpe.stand_ins(PATTERN))
    got = encode(text)
    assert got == ids(ours, text) and ours.decode(ours.encode(text)).decode() == text


def test_columns_of_odd_tables(spark):
    rows = spark.createDataFrame([(1, None, "a", 2), (2, "", "b", 3), (3, "two words", "c", 4), (3, "two words", "c", 4)], "doc_id long, text string, ids string, decoded int")
    out = byte_bpe.decode_column(byte_bpe.encode_column(rows, CONTENT, PATTERN), CONTENT)
    assert sorted(out.columns) == ["decoded", "doc_id", "ids", "text"]
    assert sorted((r.doc_id, bytes(r.decoded).decode()) for r in out.collect()) == [(1, ""), (2, ""), (3, "two words"), (3, "two words")]
    assert byte_bpe.encode_column(rows.limit(0), CONTENT, PATTERN).count() == 0
    assert byte_bpe.round_trip_digest(rows.limit(0), CONTENT, PATTERN).count() == 0


def shuffled_by_hand(parts, length, end, key):
    """Slot -> (number, ids) of partitions of texts: packed one after the other, then permuted."""
    sequences = []
    for texts in parts:
        stream = [i for t in texts if t for i in [*t, end]]
        sequences += [stream[k : k + length] for k in range(0, len(stream), length)]
    slots = training_order.Feistel(len(sequences), key).slots(np.arange(len(sequences)))
    return {int(s): (n, sequences[n] + [end] * (length - len(sequences[n])), len(sequences[n])) for n, s in enumerate(slots)}


def test_op2_whole_output(spark, sf_dir, theirs):
    """Every slot's ids, numbers and checksums of the query's operator over a whole table."""
    work = Workspace(spark, "t")
    docs = work.table(spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(6))  # as many files as cores at least, so they stay as they lie
    parts = [[theirs.encode_ordinary(r.text or "") for r in part] for part in docs.select("text").rdd.glom().collect()]
    folder = f"{work.path}/shards"
    index = training_order.materialise(docs.withColumn("slot", docs.doc_id), work, folder, CONTENT, PATTERN, Q.END_OF_TEXT, b"epoch-0", per_shard=50).collect()
    want = shuffled_by_hand(parts, training_order.LENGTH, Q.END_OF_TEXT, b"epoch-0")
    stored = list(training_order.read_slots(folder, 0, 10**9))
    assert len(index) == len(want) == len(stored)
    for r in index:
        number, row, n = want[r.slot]
        assert (r.number, r.n_ids, r.shard, r.byte_offset) == (number, n, r.slot // 50, r.slot % 50 * 2048)
        assert stored[r.slot].tolist() == row and zlib.crc32(np.array(row, "<u2").tobytes()) == r.crc32


def test_a_shard_is_written_again(tmp_path):
    """A task that runs again finds its shard there and writes the same bytes."""
    import zstandard

    rows = [zstandard.compress(np.full(4, k, np.uint16).tobytes()) for k in range(3)]
    batch = pa.RecordBatch.from_arrays([pa.array([0, 0, 1]), pa.array([0, 1, 2]), pa.array([5, 6, 7]), pa.array([4, 4, 4], pa.int32()), pa.array(rows, pa.binary())], ["shard", "slot", "number", "n_ids", "ids"])

    class Context:
        @staticmethod
        def get():
            return Context()

        def taskAttemptId(self):
            return 7

    old, training_order.TaskContext = training_order.TaskContext, Context
    try:
        for _ in range(2):
            list(training_order._write(f"file://{tmp_path}", 2, 8, b"")(iter([batch])))
            assert sorted(p.name for p in tmp_path.iterdir()) == ["shard-000000.bin", "shard-000001.bin"]
            assert (tmp_path / "shard-000000.bin").read_bytes() == np.array([0] * 4 + [1] * 4, "<u2").tobytes()
    finally:
        training_order.TaskContext = old
