"""Event-sourced chat reconstruction and formatting, in DataFrame functions only.

A log row is (conv_id, seq, message_id, role, kind, text).  Kinds are "message",
"edit" and "regenerate", which set a message's text anew, and "delta", which
appends to it.  Rows are partitioned by conversation and sorted by sequence; a
message's text is what its last setting row and the deltas after it say, its
place is that of its first row, its role the first one named.

The template writes each turn as ``### role:`` line, text and ``</turn>`` line.
Texts are escaped so that no control string can come from a text: a backslash
becomes ``\\b``, ``<`` becomes ``\\l`` and ``#`` becomes ``\\h`` (in roles also
``:`` as ``\\c``).  Each escape is two characters that start with the only kind
of backslash left, so it reads back exactly.

Defined results: null texts and roles are empty; null kinds are "message"; rows
with equal sequence go by kind, role and text; repeated rows count each, a
repeated delta appends twice; a null message_id makes a row its own message;
rows without conv_id form one conversation; an empty log gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD, NAME_END, TURN_END = "### ", ":\n", "</turn>\n"
LEARNED_ROLE = "assistant"
_TEXT_ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
_ROLE_ESCAPES = (*_TEXT_ESCAPES, (":", "\\c"))


def escape(c: Column, pairs: tuple = _TEXT_ESCAPES) -> Column:
    for plain, code in pairs:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: Column, pairs: tuple = _TEXT_ESCAPES) -> Column:
    for plain, code in reversed(pairs):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, place, role, text) of every message of the log."""
    kind = F.coalesce("kind", F.lit("message"))
    rows = events.select("conv_id", "seq", "message_id", F.coalesce("role", F.lit("")).alias("role"), kind.alias("kind"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("seq", "kind", "role", "text")))
    message = F.coalesce(F.concat(F.lit("m"), F.col("message_id").cast("string")), F.concat(F.lit("r"), F.col("place").cast("string")))
    grouped = rows.groupBy("conv_id", message.alias("message")).agg(
        F.min("place").alias("place"),
        F.array_sort(F.collect_list(F.struct("place", "kind", "role", "text"))).alias("log"),
    )
    tail = F.coalesce(F.array_position(F.reverse(F.transform("log", lambda e: e.kind != "delta")), True), F.lit(0))
    kept = F.when(tail > 0, F.slice("log", F.size("log") - tail.cast("int") + 1, tail.cast("int"))).otherwise(F.col("log"))
    named = F.filter("log", lambda e: e.role != "")
    return grouped.select(
        "conv_id", "place",
        F.when(F.size(named) > 0, named[0].role).otherwise("").alias("role"),
        F.array_join(F.transform(kept, lambda e: e.text), "").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): loss lists (turn, start, length) of learned text, in code points from the turn's start."""
    head = F.concat(F.lit(HEAD), escape(F.col("role"), _ROLE_ESCAPES), F.lit(NAME_END))
    turn = messages.select("conv_id", "place", (F.col("role") == LEARNED_ROLE).alias("learn"), head.alias("head"), escape(F.col("text")).alias("body"))
    turn = turn.select("conv_id", "place", "learn", F.length("head").alias("start"), F.length("body").alias("length"), F.concat("head", "body", F.lit(TURN_END)).alias("block"))
    whole = turn.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "learn", "start", "length", "block"))).alias("turns"))
    spans = F.transform("turns", lambda t, i: F.struct(i.alias("turn"), t.start.alias("start"), t.length.alias("length"), t.learn.alias("learn")))
    return whole.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t.block), "").alias("formatted"),
        F.transform(F.filter(spans, lambda s: s.learn), lambda s: F.struct(s.turn.alias("turn"), s.start.alias("start"), s.length.alias("length"))).alias("loss"),
    )


def read_back(rendered: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns, learned): turns as (role, text) and the learned texts, parsed from the output."""
    blocks = F.split("formatted", TURN_END)
    parsed = rendered.select("conv_id", "formatted", "loss", F.slice(blocks, 1, F.size(blocks) - 1).alias("blocks"))

    def turn(b: Column) -> Column:
        at = F.locate(NAME_END, b)
        role = F.substring(b, len(HEAD) + 1, at - len(HEAD) - 1)
        return F.struct(unescape(role, _ROLE_ESCAPES).alias("role"), unescape(F.substring(b, at + len(NAME_END), F.length(b))).alias("text"))

    return parsed.select(
        "conv_id", "formatted",
        F.transform("blocks", turn).alias("turns"),
        F.transform("loss", lambda s: unescape(F.substring(F.get("blocks", s.turn), s.start + 1, s.length))).alias("learned"),
    )


def turns_as_events(turns: DataFrame) -> DataFrame:
    """A table of whole turns (conv_id, turn, role, text) as the log that a client would have streamed.

    Every turn starts as a message.  By its number, every third one is then
    regenerated in two deltas and every third one edited; each ends as the
    turn's text.  Rows of one turn keep the order of their roles and texts.
    """
    half = F.floor(F.length("text") / 2).cast("int")

    def event(part: int, kind: str, text: Column) -> Column:
        return F.struct(F.lit(part).alias("part"), F.lit(kind).alias("kind"), text.alias("text"))

    whole = event(0, "message", F.col("text"))
    streamed = [event(1, "regenerate", F.lit(None).cast("string")), event(2, "delta", F.substring("text", 1, half)), event(3, "delta", F.substring("text", half + 1, F.length("text")))]
    third = F.pmod("turn", F.lit(3))
    log = F.when(third == 1, F.array(whole, *streamed)).when(third == 2, F.array(whole, event(1, "edit", F.col("text")))).otherwise(F.array(whole))
    rows = turns.select("conv_id", "turn", "role", "text").withColumn("message_id", F.monotonically_increasing_id().cast("string"))
    rows = rows.select("conv_id", "turn", "message_id", "role", F.explode(log).alias("e"))
    return rows.select("conv_id", (F.col("turn") * 4 + F.col("e.part")).alias("seq"), "message_id", F.when(F.col("e.part") == 0, F.col("role")).alias("role"), F.col("e.kind").alias("kind"), F.col("e.text").alias("text"))


def format_digest(back: DataFrame) -> DataFrame:
    """Counts and digests of read_back's rows."""
    learned = F.array_join("learned", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
