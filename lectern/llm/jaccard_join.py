"""N-gram Jaccard self-join by set-relation skipping.

Sets of word shingles are joined through index lists over rare-first prefixes
(Wang et al., "Leveraging Set Relations in Exact Set Similarity Join", 2017):

* index level: a list's entries lie in order of position and form blocks of
  sizes that can link; a block pair whose sizes or positions cannot reach the
  wanted overlap is skipped whole;
* answer level: the first set of a block, its leader, is computed first.  A set
  that links with a leader takes the leader's answers and corrects them by its
  difference to the leader: with the overlap of two leaders A and B computed
  once, sets r of A and x of B overlap in |A and B| + |r - A| + |x - B| at most.
  Pairs that this leaves below the wanted overlap are answered by it; only the
  others are compared.  Pairs inside one component need no answer, as the result
  names components.

Sets that are equal are one class from the start.  Rarity comes from a sketch
sized by the input that counts every shingle of every document; any total order
gives the same links, the sketch only keeps lists short.

Defined results: a null text or one without words has an empty set and links
with nothing; fewer words than a shingle make one shingle; rows that share a
doc_id are one document whose links are those of all its rows; a row without
doc_id is its own and gets a null component; an empty table gives no rows;
further columns are ignored, or kept as they are by keep_one_of_each.  Shingles
are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bytekit as bk
from .workspace import Workspace, among, bitmaps, bounded_batches, bucket_levels, components, filter_bits, sketch_bits

WIDTH, PERCENT = 5, 80
SIGNATURE = 64
SALTS = 16


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sorted distinct shingle hashes, borders) of slices of rows."""
    for lo, hi, buf, offsets in bk.text_slices(column):
        starts, ends, first = bk.word_spans(buf, offsets, bk.NONSPACE)
        words = bk.word_hashes(buf, starts, ends)
        at = bk.within_rows(first, width)
        rows = np.searchsorted(first, at, "right") - 1
        values = bk.window_hashes(words, width)[at]
        counts = np.diff(first)
        for row in np.flatnonzero((counts > 0) & (counts < width)):
            short = words[first[row] : first[row + 1]]
            values = np.append(values, bk.window_hashes(short, len(short)) ^ np.uint64(len(short)))
            rows = np.append(rows, row)
        order = np.argsort(rows, kind="stable")
        yield lo, *bk.segment_unique(rows[order], values[order], hi - lo)


def _overlap_needed(percent: int, a, b):
    """Least intersection of sets of sizes a and b that link."""
    return -(-percent * (a + b) // (100 + percent))


def _prefix_sizes(percent: int, n: np.ndarray) -> np.ndarray:
    """Entries a set needs in the index; none where only an equal set could link."""
    kept = n - -(-percent * n // 100) + 1
    alone = (100 * n < percent * (n + 1)) & (100 * (n - 1) < percent * n)
    return np.where(alone | (n == 0), 0, kept)


def _describe(width: int, percent: int, rarity: np.ndarray):
    shift = np.uint64(65 - len(rarity).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, key, prefix, signature = [], [], [], []
            for _, values, borders in shingle_sets(batch.column("text"), width):
                sizes = np.diff(borders)
                want = _prefix_sizes(percent, sizes)
                rank = rarity[(values >> shift).astype(np.int64)]
                fold = bk.mix(values + np.uint64(0x51ED270B))
                for i, (a, b) in enumerate(zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True)):
                    v = values[a:b]
                    n.append(b - a)
                    key.append((int(v.sum(dtype=np.uint64)) ^ (b - a), int(fold[a:b].sum(dtype=np.uint64))))
                    if not want[i]:
                        prefix.append(b"")
                        signature.append(b"")
                        continue
                    order = np.lexsort((v, rank[a:b]))[: want[i]]
                    prefix.append(v[order].tobytes())
                    signature.append(np.bincount((v & np.uint64(SIGNATURE - 1)).astype(np.int64), minlength=SIGNATURE).astype(np.uint32).clip(0, 65535).astype(np.uint16).tobytes())
            keys = np.array(key, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(prefix, pa.binary()), pa.array(signature, pa.binary())],
                ["doc_id", "n", "k1", "k2", "prefix", "signature"],
            )

    return run


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prefixes = [np.frombuffer(p, dtype=np.int64) for p in batch.column("prefix").to_pylist()]
        sizes = np.array([len(p) for p in prefixes], dtype=np.int64)
        if not sizes.sum():
            continue
        rep, n = (np.repeat(np.asarray(batch.column(c)), sizes) for c in ("rep", "n"))
        pos = np.concatenate([np.arange(s) for s in sizes])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(prefixes)), pa.array(rep), pa.array(n), pa.array(pos, pa.int32())], ["token", "rep", "n", "pos"])


def _lists(percent: int):
    """Entries of lists that hold more than one set, each with the leaders it starts from.

    Rows come sorted by (token, pos, n, rep).  An edited copy has rare shingles
    of its own before the shared ones, so a list's first entry is the set with
    the fewest of them, the middle of its group; it leads the sets of its size
    block, and a set that no leader's size fits leads a block of its own.  The
    first and the last list of a partition may go on in another one, so they are
    kept whatever their length, and every entry says in which partition it lies.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: tuple | None = None
        token_before: int | None = None
        leaders: list[tuple] = []
        first: int | None = None

        def batch_of(rows: list) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.list_(pa.int64()))
            made = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*made, pa.array([part] * len(rows), pa.int32())], ["token", "rep", "n", "pos", "leader", "leads", "part"])

        def led(row: tuple) -> tuple:
            token, rep, n, pos = row
            if leaders and leaders[0][0] != token:
                leaders.clear()
            fit = [x for x in leaders if 100 * min(x[2], n) >= percent * max(x[2], n)]
            if not fit:
                leaders.append(row)
            return (*row, not fit, [x[1] for x in fit if x[1] != rep and min(x[2] - x[3], n - pos) >= _overlap_needed(percent, x[2], n)])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [np.asarray(batch.column(c)) for c in ("token", "rep", "n", "pos")]
            if held is not None:
                cols = [np.concatenate([[h], c]) for h, c in zip(held, cols, strict=True)]
            t = cols[0]
            if first is None:
                first = int(t[0])
            same = np.empty(len(t), dtype=bool)
            same[0] = token_before is not None and int(t[0]) == token_before
            same[1:] = t[1:] == t[:-1]
            after = np.append(t[1:] == t[:-1], False)
            use = (same | after | (t == first))[:-1]
            out = [led(tuple(int(c[i]) for c in cols)) for i in np.flatnonzero(use)]
            held = tuple(int(c[-1]) for c in cols)
            if len(t) > 1:
                token_before = int(t[-2])
            if out:
                yield batch_of(out)
        if held is not None:
            yield batch_of([led(held)])

    return run


def _flag(ids: pa.Array, bits: int) -> np.ndarray:
    """Bit number of each id."""
    v = np.asarray(ids.fill_null(0)).astype(np.int64).view(np.uint64)
    return (bk.mix(v) >> np.uint64(64 - bits)).astype(np.int64)


def _id_filter(ids: DataFrame) -> tuple[int, np.ndarray]:
    """Bits and bitmap of a membership filter over a column of ids, sized by their number."""
    name = ids.columns[0]
    bits = filter_bits(ids.count())
    return bits, bitmaps(ids, lambda batch: iter([(0, _flag(batch.column(name), bits))]), {0: bits})[0]


def _sets_of(width: int, bits: int, wanted: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = among(wanted, _flag(batch.column("doc_id"), bits))
            if not hit.any():
                continue
            batch = batch.filter(pa.array(hit))
            out = [values[a:b].tobytes() for _, values, borders in shingle_sets(batch.column("text"), width) for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "values"])

    return run


def _bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, n_a, n_b, most): an upper bound of the overlap, from counts of shingles by their last bits."""
    for batch in batches:
        n_a, n_b = (np.asarray(batch.column(c)) for c in ("n_a", "n_b"))
        s_a, s_b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(-1, SIGNATURE) for c in ("s_a", "s_b"))
        both = np.minimum(s_a, s_b)
        full = (both == 65535).any(axis=1)  # a clipped counter bounds nothing
        small = np.minimum(n_a, n_b)
        most = np.where(full, small, np.minimum(small, both.sum(axis=1, dtype=np.int64)))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "n_a", "n_b")), pa.array(most, pa.int64())], ["a", "b", "n_a", "n_b", "most"])


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, n_a, n_b, common) of pairs of sets."""
    for batch in batches:
        out = []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
            out.append((len(x), len(y), len(x) + len(y) - len(np.unique(np.concatenate([x, y])))))
        columns = list(zip(*out, strict=True)) if out else [[]] * 3
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *(pa.array(c, pa.int64()) for c in columns)], ["a", "b", "n_a", "n_b", "common"])


def jaccard_components(docs: DataFrame, work: Workspace, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; see the module's docstring."""
    table = partial(work.table, direct=True)
    docs = bounded_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    bits = sketch_bits(docs)
    shift = np.uint64(64 - bits)

    def buckets(batch: pa.RecordBatch, size: int) -> np.ndarray:
        got = [(values >> shift).astype(np.int64) for _, values, _ in shingle_sets(batch.column("text"), width)]
        return np.concatenate(got) if got else np.zeros(0, dtype=np.int64)

    rarity = bucket_levels(docs.select("text"), buckets, bits)
    described = table(docs, "sets", kernel=bk.tidy(_describe(width, percent, rarity)), schema="doc_id long, n long, k1 long, k2 long, prefix binary, signature binary")

    real = "n > 0 AND doc_id IS NOT NULL"
    classes = table(described.where(real).groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")), "classes")
    reps = table(described.where("length(prefix) > 0").withColumnRenamed("doc_id", "rep").join(classes, ["rep", "k1", "k2"]).select("rep", "n", "prefix", "signature"), "reps")

    entries = reps.mapInArrow(_entries, "token long, rep long, n long, pos int")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = entries.repartitionByRange(parts, "token", "pos", "n", "rep").sortWithinPartitions("token", "pos", "n", "rep")
    lists = table(lists, "lists", kernel=bk.tidy(_lists(percent)), schema="token long, rep long, n long, pos int, leader boolean, leads array<long>, part int")

    def reach(overlap: str, a: str = "n_a", b: str = "n_b") -> Column:
        """Whether an overlap is enough for sets of these sizes."""
        return F.expr(f"{100 + percent} * ({overlap}) >= {percent} * ({a} + {b})")

    def bounded(pairs: DataFrame) -> DataFrame:
        left = reps.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("signature").alias("s_a"))
        right = reps.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("signature").alias("s_b"))
        return pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(_bounds, "a long, b long, n_a long, n_b long, most long")

    def sets_for(pairs: DataFrame, *columns: str) -> DataFrame:
        """The sets of all ids in these columns."""
        ids = table(pairs.select(F.explode(F.array(*columns)).alias("id")).distinct(), "ids")
        rows = docs.mapInArrow(bk.tidy(_sets_of(width, *_id_filter(ids))), "doc_id long, values binary")
        return table(rows.join(ids, F.col("doc_id") == F.col("id"), "left_semi").distinct(), "verify")

    def computed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """(a, b, n_a, n_b, common) of every pair; an id whose rows hold several sets has a row for each."""
        x = sets.select(F.col("doc_id").alias("a"), F.col("values").alias("x"))
        y = sets.select(F.col("doc_id").alias("b"), F.col("values").alias("y"))
        return table(pairs.select("a", "b").distinct().join(x, "a").join(y, "b"), "answers", kernel=_overlaps, schema="a long, b long, n_a long, n_b long, common long")

    def links_of(answers: DataFrame) -> DataFrame:
        return answers.where(reach("common")).select(F.col("a").alias("u"), F.col("b").alias("v")).where("u != v")

    # The answers of each block's leader, and the components they give.  A list that runs over partitions
    # has leaders in each; its later parts also ask those of its first one, of which there are few a partition.
    spans = lists.groupBy("token").agg(F.min("part").alias("first_part"), F.max("part").alias("last_part")).where("first_part < last_part")
    cut = lists.join(F.broadcast(spans.select("token", "first_part")), "token")
    heads = cut.where("part = first_part AND leader").select("token", F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("pos").alias("pos_a"))
    later = cut.where("part > first_part").select("token", F.col("rep").alias("b"), F.col("n").alias("n_b"), "pos")
    fits = f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b) AND {100 + percent} * least(n_a - {{0}}, n_b - {{1}}) >= {percent} * (n_a + n_b)"
    across = later.join(F.broadcast(heads), "token").where("a <> b AND " + fits.format("pos_a", "pos")).select("a", "b")
    led = table(lists.select(F.explode("leads").alias("a"), F.col("rep").alias("b")).union(across).distinct(), "led")
    likely = table(bounded(led).where(reach("most")).select("a", "b").distinct(), "likely")
    answers = computed(likely, sets_for(likely, "a", "b"))
    # A document whose rows lie in several classes ties them together.
    twice = described.where(real).groupBy("doc_id").agg(F.min(F.struct("k1", "k2")).alias("x"), F.max(F.struct("k1", "k2")).alias("y")).where("x != y").select("doc_id")
    tied = described.where(real).join(twice, "doc_id", "left_semi").select("doc_id", "k1", "k2").distinct().join(classes, ["k1", "k2"]).select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    first = table(components(links_of(answers).union(tied.where("u != v")), work), "first")

    # What is left: blocks of one list that lie in different components.
    placed = table(lists.select("token", "rep", "n", "pos").join(first, F.col("rep") == F.col("node"), "left").select("token", "rep", "n", "pos", F.coalesce("component", "rep").alias("c")), "placed")
    blocks = placed.groupBy("token", "c").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("n") - F.col("pos")).alias("rem"))
    # Most lists lie in one component; only the blocks of the others are kept.
    met = placed.groupBy("token").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 < c2").select("token")
    blocks = table(blocks.join(met, "token", "left_semi"), "blocks")
    # The larger of two sizes that link lies in the class of the smaller or the next, so a list meets itself class by class.
    step = np.log(100 / percent) if percent < 100 else 1.0
    kind = lambda c: F.floor(F.log(F.col(c)) / F.lit(float(step)))
    near_sizes = blocks.select("token", "c", "lo", "hi", "rem", F.explode(F.sequence(kind("lo"), kind("hi"))).alias("size_class"))
    far = blocks.select("token", F.col("c").alias("d"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("rem").alias("rem2"), F.explode(F.sequence(kind("lo") - 1, kind("hi"))).alias("size_class"))
    can = f"100 * hi2 >= {percent} * lo AND 100 * hi >= {percent} * lo2 AND {100 + percent} * least(rem, rem2) >= {percent} * (lo + lo2)"
    touch = near_sizes.join(far, ["token", "size_class"]).where(f"c <> d AND {can}").select("token", F.least("c", "d").alias("c"), F.greatest("c", "d").alias("d")).distinct()
    other = placed.select("token", F.col("c").alias("d"), F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("pos").alias("pos_b"))
    mine = placed.select("token", "c", F.col("rep").alias("a"), F.col("n").alias("n_a"), "pos")
    asked_before = led.union(led.select("b", "a"))
    rest = touch.join(mine, ["token", "c"]).join(other, ["token", "d"]).where(fits.format("pos", "pos_b")).select("a", "b", "n_a", "n_b").distinct()
    rest = table(rest.join(asked_before, ["a", "b"], "left_anti"), "rest")

    more = None
    if not rest.isEmpty():
        # Each set's leader and its difference to it; sets without a linked leader lead themselves.
        once = reps.groupBy("rep").agg(F.count("*").alias("k")).where("k = 1").select(F.col("rep").alias("b"))
        anchors = answers.where(reach("common")).where("a != b").join(once, "b", "left_semi").groupBy("b").agg(F.min(F.struct((F.col("n_b") - F.col("common")).alias("differs"), F.col("a").alias("leader"))).alias("t"))
        anchors = table(anchors.select(F.col("b").alias("rep"), "t.leader", "t.differs"), "anchors")

        def side(column: str) -> DataFrame:
            return anchors.select(F.col("rep").alias(column), F.col("leader").alias(f"leader_{column}"), F.col("differs").alias(f"differs_{column}"))

        asked = rest.join(side("a"), "a", "left").join(side("b"), "b", "left").select(
            "a", "b", "n_a", "n_b", F.coalesce("leader_a", "a").alias("leader_a"), F.coalesce("leader_b", "b").alias("leader_b"),
            (F.coalesce("differs_a", F.lit(0)) + F.coalesce("differs_b", F.lit(0))).alias("slack"),
        )
        pairs = asked.select(F.col("leader_a").alias("a"), F.col("leader_b").alias("b")).distinct()
        leaders = bounded(pairs).groupBy("a", "b").agg(F.max("most").alias("most")).select(F.col("a").alias("leader_a"), F.col("b").alias("leader_b"), "most")
        asked = table(asked.join(leaders, ["leader_a", "leader_b"]).where(reach("most + slack")), "asked")
        sets = sets_for(asked, "a", "b", "leader_a", "leader_b")
        led_answers = computed(asked.select(F.col("leader_a").alias("a"), F.col("leader_b").alias("b")), sets)
        known = led_answers.groupBy("a", "b").agg(F.max("common").alias("common")).select(F.col("a").alias("leader_a"), F.col("b").alias("leader_b"), "common")
        open_ = asked.join(known, ["leader_a", "leader_b"]).where(reach("common + slack")).where("a != leader_a OR b != leader_b")
        likely = table(bounded(open_.select("a", "b").distinct()).where(reach("most")).select("a", "b").distinct(), "likely")
        more = links_of(led_answers).union(links_of(computed(likely, sets)))

    def lifted(frame: DataFrame, to: DataFrame, column: str, into: str, salt: Column) -> DataFrame:
        """With the component of a column; one component may hold very many rows, so they meet its name in parts."""
        names = to.select(F.col("node").alias(column), F.col("component").alias("_c"), F.explode(F.array(*map(F.lit, range(SALTS)))).alias("_s"))
        return frame.withColumn("_s", salt).join(names, [column, "_s"], "left").withColumn(into, F.coalesce("_c", column)).drop("_c", "_s")

    named = lifted(classes, first, "rep", "c1", F.lit(0))
    if more is not None:
        zero = F.lit(0)
        second = table(components(lifted(lifted(more, first, "u", "x", zero), first, "v", "y", zero).select(F.col("x").alias("u"), F.col("y").alias("v")), work), "second")
        named = lifted(named, second, "c1", "component", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int"))
    else:
        named = named.withColumn("component", F.col("c1"))

    # A class may hold a third of all rows, so its rows meet its name in parts, by a salt from their ids.
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt")
    rows = described.where(real).select("doc_id", "n", "k1", "k2", salt)
    parts_of = rows.select("k1", "k2", "salt").distinct().join(named.select("k1", "k2", "component"), ["k1", "k2"])
    linked = rows.join(parts_of, ["k1", "k2", "salt"]).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    alone = described.where(f"NOT ({real})").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def keep_one_of_each(docs: DataFrame, work: Workspace, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows, unchanged, of each component's least doc_id; of rows that share it, one.  Rows without doc_id stay.

    Most rows are neither linked to a lesser id nor repeated.  A bitmap over the
    ids that are, sized by their number, tells them apart where they lie, so only
    rows that it marks are shuffled to be judged.
    """
    found = work.table(jaccard_components(docs, work, width, percent).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count("*").alias("copies")), "found", direct=True)
    bits, marked = _id_filter(found.where("doc_id <> component_id OR copies > 1").select("doc_id"))

    def side(keep_marked: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("doc_id").cast(pa.int64())
                hit = among(marked, _flag(ids, bits)) & np.asarray(ids.is_valid())
                yield batch.filter(pa.array(hit == keep_marked))

        return run

    plain, open_ = (docs.mapInArrow(bk.tidy(side(x)), docs.schema) for x in (False, True))
    mark = "_jaccard_keep"
    while mark in docs.columns:
        mark += "_"
    chosen = found.where("doc_id = component_id").select(F.col("doc_id").alias(mark))
    kept = open_.join(chosen, F.col("doc_id") == F.col(mark), "left_semi")
    # Rows of one doc_id now lie together; the one whose columns hash least stays.
    order = [F.xxhash64(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in docs.columns]
    kept = kept.withColumn(mark, F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))).where(F.col(mark) == 1).drop(mark)
    return plain.union(kept)
