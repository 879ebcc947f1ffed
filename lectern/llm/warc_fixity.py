"""WARC records and a Merkle fixity audit of replicas.

Pages become WARC 1.1 resource records, laid end to end in archives of
PER_ARCHIVE page ids, in the order of their ids.  A leaf of an archive's tree is
an id's records, an inner node FAN neighbouring children: it hashes them in
order with the bytes that each covers, so every range is bound relative to the
start of its node.  A record that grows or gets lost changes its own branch and
the node sizes above it, not the branches beside it.  Two replicas first compare
roots; only below a differing node are its children compared.  What the descent
ends at is judged by record id and digest.

States: "ok" (same id and digest, wherever the record now starts), "corrupt"
(same id, other digest), "missing" and "extra" (in the second replica).

Defined results: null urls and payloads are empty; equal records are hashed once
and counted, and each gets its row; of several records with one id and url equal
digests meet first and the rest in the order of their digests; pages without id
go to archives of their own with negative numbers, dealt by their url (by their
digest without one); empty tables give no rows; further columns are ignored.
Records that share one id but differ in content are laid out by one task, which
sorts them on disk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace

FAN = 16
PER_ARCHIVE = 1024
_OWN_ARCHIVES = 1 << 20


def record_bytes(url: Column, payload: Column, record_id: Column) -> Column:
    """A WARC resource record as text; its lengths are in bytes."""
    payload = F.coalesce(payload, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:sha256:"), record_id,
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, payload, F.lit("\r\n\r\n"))


def read_record(record: Column) -> Column:
    """(url, payload) of a record as record_bytes writes it."""
    body = F.locate("\r\n\r\n", record)
    return F.struct(
        F.regexp_extract(record, r"\r\nWARC-Target-URI: ([^\r\n]*)\r\n", 1).alias("url"),
        F.substring(record, body + 4, F.length(record) - body - 7).alias("payload"),
    )


def lay_out(pages: DataFrame, per_archive: int = PER_ARCHIVE) -> DataFrame:
    """(archive, slot, place, page_id, record_id, offset, length, digest, copies) of every page's record.

    Records are hashed before anything moves, so only digests and lengths are
    shuffled; equal records are counted before they are put in order.  `place`
    and `offset` are those of the first copy.
    """
    key = F.sha2(F.concat_ws("\n", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit(""))), 256)
    record = record_bytes(F.col("url"), F.col("html"), F.col("record_id"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), "html", key.alias("record_id"))
    rows = rows.select("page_id", "url", "record_id", record.alias("record"))
    rows = rows.select("page_id", "url", "record_id", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"))
    rows = rows.groupBy("page_id", "url", "record_id", "length", "digest").agg(F.count("*").alias("copies"))

    def number(start: int) -> Column:
        """A number from five hex digits of what tells pages without id apart."""
        name = F.when(F.col("url") == "", F.col("digest")).otherwise(F.col("record_id"))
        return F.conv(F.substring(name, start, 5), 16, 10).cast("long")

    own = F.col("page_id").isNull()
    rows = rows.withColumn("archive", F.when(own, -1 - number(1) % _OWN_ARCHIVES).otherwise(F.floor(F.col("page_id") / per_archive)).cast("long"))
    rows = rows.withColumn("slot", F.when(own, number(6) % per_archive).otherwise(F.pmod("page_id", F.lit(per_archive))).cast("int"))
    order = Window.partitionBy("archive").orderBy("slot", "page_id", "url", "digest").rowsBetween(Window.unboundedPreceding, 0)
    size = F.col("length") * F.col("copies")
    return rows.select(
        "archive", "slot", (F.sum("copies").over(order) - F.col("copies")).alias("place"), "page_id", "record_id",
        (F.sum(size).over(order) - size).alias("offset"), "length", "digest", "copies",
    )


def trees(records: DataFrame, per_archive: int = PER_ARCHIVE, fan: int = FAN) -> DataFrame:
    """(archive, hash, kids): a root and its nested nodes (node, hash, kids), leaves (slot, hash) innermost.

    All levels are built where the archive's leaves meet.  A leaf sums the
    hashes of its id's records, so that many of them are combined before they
    move.
    """
    one = F.sha2(F.concat_ws(":", F.lit("record"), "record_id", "length", "digest", "copies"), 256)
    limbs = [F.sum(F.conv(F.substring("one", k, 15), 16, 10).cast("decimal(38,0)")).alias(f"limb{k}") for k in (1, 16, 31, 46)]
    size = F.sum(F.col("length") * F.col("copies")).alias("size")
    leaves = records.select("archive", "slot", "length", "copies", one.alias("one")).groupBy("archive", "slot").agg(size, *limbs)
    leaf = F.sha2(F.concat_ws(":", F.lit("leaf"), "slot", "size", *(f"limb{k}" for k in (1, 16, 31, 46))), 256)
    level = leaves.repartition("archive").select("archive", F.col("slot").alias("node"), "size", leaf.alias("hash"))
    fields, span = ["node", "size", "hash"], 1
    while span < per_archive:
        span *= fan
        up = [F.floor(F.col("node") / fan).cast("int").alias("up")] if span < per_archive else []
        level = level.groupBy("archive", *up).agg(F.sum("size").alias("total"), F.array_sort(F.collect_list(F.struct(*fields))).alias("kids"))
        said = F.array_join(F.transform("kids", lambda k: F.concat_ws(":", k.node, k.size, k.hash)), ",")
        node = F.col("up") if up else F.lit(0)
        level = level.select("archive", node.alias("node"), F.col("total").alias("size"), F.sha2(F.concat_ws(":", F.lit("node"), node, "total", said), 256).alias("hash"), "kids")
        fields = ["node", "size", "hash", "kids"]
    return level.select("archive", "hash", "kids")


def depth(per_archive: int = PER_ARCHIVE, fan: int = FAN) -> int:
    """Levels of nodes below the root."""
    levels = 1
    while fan**levels < per_archive:
        levels += 1
    return levels


def differing(ours: DataFrame, theirs: DataFrame, levels: int) -> DataFrame:
    """(archive, slot) of leaves that differ: roots first, then only the children of nodes that differ.

    The roots are joined without their trees, and only the trees of differing
    roots are joined then.
    """
    roots = [t.select("archive", F.col("hash").alias(h)) for t, h in ((ours, "mine"), (theirs, "other"))]
    bad = roots[0].join(roots[1], "archive", "full_outer").where(~F.col("mine").eqNullSafe(F.col("other"))).select("archive")
    a, b = (bad.join(t.select("archive", F.col("kids").alias(k)), "archive", "left") for t, k in ((ours, "a"), (theirs, "b")))
    met = a.join(b, "archive")

    def named(kids: str) -> Column:
        return F.coalesce(F.transform(kids, lambda k: F.struct(k.node.alias("node"), k.hash.alias("hash"))), F.array().cast("array<struct<node:int,hash:string>>"))

    for level in range(levels):
        odd = F.array_union(F.array_except(named("a"), named("b")), F.array_except(named("b"), named("a")))
        met = met.select("archive", "a", "b", F.explode(F.array_distinct(F.transform(odd, lambda k: k.node))).alias("node"))
        if level < levels - 1:
            below = [F.get(F.filter(side, lambda k: k.node == F.col("node")), F.lit(0)).kids.alias(side) for side in ("a", "b")]
            met = met.select("archive", *below)
    return met.select("archive", F.col("node").alias("slot"))


def audit(ours: DataFrame, theirs: DataFrame, work: Workspace, per_archive: int = PER_ARCHIVE) -> DataFrame:
    """(archive, place, page_id, offset, length, digest, state) of every record of two replicas as lay_out gives them.

    Rows show the first replica's record, or the second's if it is "extra".
    """
    ours, theirs = work.table(ours, "ours"), work.table(theirs, "theirs")
    both = [work.table(trees(x, per_archive), name) for x, name in ((ours, "our-trees"), (theirs, "their-trees"))]
    bad = work.table(differing(*both, depth(per_archive)), "suspects")
    shown = ["archive", "place", "page_id", "offset", "length", "digest"]

    def each(rows: DataFrame, first: Column, last: Column) -> DataFrame:
        """One row a copy, of the copies numbered first to last."""
        rows = rows.withColumn("copy", F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
        return rows.withColumn("place", F.col("place") + F.col("copy")).withColumn("offset", F.col("offset") + F.col("copy") * F.col("length"))

    whole = each(ours.join(bad, ["archive", "slot"], "left_anti"), F.lit(0).cast("long"), F.col("copies") - 1).select(*shown, F.lit("ok").alias("state"))
    identity = ["archive", "record_id", "digest"]
    a, b = (x.join(bad, ["archive", "slot"], "left_semi") for x in (ours, theirs))
    # Equal digests meet first; `met` copies of each are whole.
    a, b = (
        x.join(y.select(*identity, F.col("copies").alias("copies_there")), identity, "left").withColumn("met", F.least("copies", F.coalesce("copies_there", F.lit(0))))
        for x, y in ((a, b), (b, a))
    )
    found = each(a, F.lit(0).cast("long"), F.col("met") - 1).select(*shown, F.lit("ok").alias("state"))
    rank = F.row_number().over(Window.partitionBy("archive", "record_id").orderBy("digest", "copy"))
    left, right = (each(x, F.col("met"), F.col("copies") - 1).withColumn("rank", rank).select(*shown, "record_id", "rank") for x in (a, b))
    other = right.select(*(F.col(c).alias(f"{c}_b") for c in shown), "record_id", "rank")
    rest = left.join(other, (left.archive == other.archive_b) & (left.record_id == other.record_id) & (left["rank"] == other["rank"]), "full_outer")
    state = F.when(F.col("archive").isNull(), "extra").when(F.col("archive_b").isNull(), "missing").otherwise("corrupt")
    side = [F.when(F.col("archive").isNull(), F.col(f"{c}_b")).otherwise(F.col(c)).alias(c) for c in shown]
    return whole.unionByName(found).unionByName(rest.select(*side, state.alias("state")))
