"""Personal data in whole texts: plain detectors and offset-preserving deobfuscation.

Plain detectors find emails, IPv4 addresses, payment cards and phone numbers
as written.  Three transducers then rewrite the text (homoglyphs and invisible
characters, at/dot disguises, spelled digits); each output character carries
the source range it came from, the same detectors run on the output, and their
spans are mapped back.  A mapped span that meets a plain span of its kind is
dropped, so plain spans always stay as they are.

Offsets are code points, ends exclusive.  Defined results: null is the empty
text, which has no spans; spans of different kinds may overlap; rows are
answered one by one; an empty table gives no rows; further columns are ignored.
All detectors and transducers run in time linear in the text.

The at/dot transducer takes "at" as a sign only before a domain with a spelled
dot ("look at example.com" is no address), a spaced "@" before any domain, and a
spelled dot only inside an address or between two numbers.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytekit as bk
from .workspace import bounded_batches

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, str]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if i & 1:
            x = x * 2 - 9 * (x > 4)
        total += x
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From sign to sign: the local part reaches back to the last match at most."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        end = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = done = m.end()
            yield start, end
        else:
            done = max(done, at + 1)
        at = text.find("@", end)


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Of a longer chain of dotted numbers, four parts at a time."""
    for chain in _DOTTED.finditer(text):
        parts = list(_DIGITS.finditer(text, chain.start(), chain.end()))
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            if all(len(p := m.group().lstrip("0")) <= 3 and int(p or 0) <= 255 for m in four):
                yield four[0].start(), four[3].end()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := m.group().replace(" ", "").replace("-", "")) <= 19 and _luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(map(len, _DIGITS.findall(m.group()))) <= 15:
                yield m.span()


_DETECTORS = dict(zip(KINDS, (_emails, _addresses, _cards, _phones), strict=True))


def plain_spans(text: str) -> list[Span]:
    return [(a, b, kind) for kind, find in _DETECTORS.items() for a, b in find(text)]


# Letters of other scripts that look like ASCII ones.
_LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "ԁ": "d", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "υ": "u", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "χ": "x", "γ": "y", "ε": "e", "τ": "t", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "İ": "I", "ſ": "s", "ɑ": "a", "ɡ": "g", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "․": ".", "。": ".", "·": ".", "∙": ".", "＋": "+", " ": " ", " ": " ", " ": " ", " ": " ",
}
# Characters that show nothing.
_INVISIBLE = "­​‌‍⁠﻿᠎‎‏"
# The digits' names, and other words of spoken numbers.
_DIGIT_NAMES = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}

_names = "|".join(sorted(_DIGIT_NAMES, key=len, reverse=True))
_LABEL = "[a-z0-9-]{1,63}"
# All of these read folded texts, so none ignores case.
_SPOKEN = re.compile(rf"(?<![^\W_])(?:(?:plus|\+)[\s-]*)?(?:{_names}|[0-9]+)(?:[\s,.-]{{1,3}}(?:(?:dot|point)[\s-]+)?(?:{_names}|[0-9]+))+(?![^\W_])")
_SPOKEN_HINT = re.compile(rf"(?:{_names})[\s,.-]{{1,3}}(?:(?:dot|point)[\s-]+)?(?:{_names}|[0-9])")
_SPOKEN_PART = re.compile(rf"(?P<plus>plus|\+)|(?P<name>{_names})|(?P<digits>[0-9]+)|(?P<dot>dot|point)")
_OPEN, _CLOSE = r"[\[({<]\s{0,3}", r"\s{0,3}[\])}>]"
_MARKED = re.compile(rf"\s{{0,3}}{_OPEN}(?:(?P<at>at|@|arroba|arobase)|(?P<dot>dot|\.|punto|point|punkt)){_CLOSE}\s{{0,3}}")
_SPACED = re.compile(
    rf"(?<=[a-z0-9])(?:\s++at\s++(?={_LABEL}(?:\.{_LABEL})*\s++dot\s++[a-z0-9])|(?:\s++@\s*+|@\s++)(?={_LABEL}(?:\.|\s++dot\s++)[a-z0-9]))"
)
_SPACED_DOT = re.compile(r"(?<=[a-z0-9])\s++dot\s++(?=[a-z0-9])")
_LOCAL_RUN = re.compile(r"[a-z0-9._%+-]+")


def _fold(text: str) -> str:
    """Lower case, character by character; the one letter whose lower case is two characters becomes i."""
    return text.replace("İ", "i").lower()


def _odd_characters() -> str:
    """Characters whose compatibility form is one ASCII character, and the fixed ones."""
    got = set(_LOOKALIKES) | set(_INVISIBLE)
    for c in [*range(0x2070, 0x20A0), *range(0x2460, 0x2500), *range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800), *range(0x0660, 0x066A), *range(0x06F0, 0x06FA), *range(0x0966, 0x0970)]:
        if _ascii_of(chr(c)):
            got.add(chr(c))
    return "".join(sorted(got))


def _ascii_of(c: str) -> str:
    if c in _LOOKALIKES:
        return _LOOKALIKES[c]
    if (d := unicodedata.digit(c, None)) is not None:
        return str(d)
    form = unicodedata.normalize("NFKC", c)
    return form if len(form) == 1 and form.isascii() else ""


_ODD = re.compile("[" + re.escape(_odd_characters()) + "]")


class Traced:
    """A text with the source range of each character."""

    def __init__(self, text: str, starts: array | range, ends: array | range):
        self.text, self.starts, self.ends = text, starts, ends

    def rewrite(self, edits: list[tuple[int, int, list[tuple[str, int, int]]]]) -> Traced:
        """Replace (start, end) by pieces (character, start, end), all in this text's offsets."""
        if not edits:
            return self
        out, starts, ends, at = [], array("Q"), array("Q"), 0  # no object a character
        for a, b, pieces in [*edits, (len(self.text), len(self.text), [])]:
            out.append(self.text[at:a])
            starts.extend(self.starts[at:a])
            ends.extend(self.ends[at:a])
            for c, s, e in pieces:
                out.append(c)
                starts.append(self.starts[s])
                ends.append(self.ends[e - 1])
            at = b
        return Traced("".join(out), starts, ends)


def _unmask_characters(t: Traced) -> Traced:
    if t.text.isascii():
        return t
    return t.rewrite([(m.start(), m.end(), [(c, m.start(), m.end())] if (c := _ascii_of(m.group())) else []) for m in _ODD.finditer(t.text)])


def _address_dots(low: str) -> Iterator[re.Match]:
    """Spelled dots between two numbers, or between a sign and the end of its address, or in a run of them up to a sign.

    Every run of address characters is read once from its front and once from its
    back, as the space beside a spelled dot ends it.
    """
    found = list(_SPACED_DOT.finditer(low))
    leads = [False] * len(found)  # to a sign, over address characters and spelled dots
    for i in range(len(found) - 1, -1, -1):
        run = _LOCAL_RUN.match(low, found[i].end())
        end = run.end() if run else found[i].end()
        leads[i] = low[end : end + 1] == "@" or (i + 1 < len(found) and found[i + 1].start() == end and leads[i + 1])
    inside = -1  # end of the last dot of an address whose sign is behind
    for m, lead in zip(found, leads, strict=True):
        k = m.start()
        while k > inside and low[k - 1] in _LOCAL:
            k -= 1
        follows = k == inside or (k > 0 and low[k - 1] == "@")
        if follows:
            inside = m.end()
        if follows or lead or (low[m.start() - 1].isdigit() and low[m.end()].isdigit()):
            yield m


def _unmask_signs(t: Traced) -> Traced:
    low = _fold(t.text)
    if any(x in low for x in ("[", "(", "{", "<")):
        t = t.rewrite([(m.start(), m.end(), [("@" if m["at"] else ".", m.start(), m.end())]) for m in _MARKED.finditer(low)])
        low = _fold(t.text)
    if "dot" in low or "@" in low:
        t = t.rewrite([(m.start(), m.end(), [("@", m.start(), m.end())]) for m in _SPACED.finditer(low)])
    if "dot" in low:
        t = t.rewrite([(m.start(), m.end(), [(".", m.start(), m.end())]) for m in _address_dots(_fold(t.text))])
    return t


def _unmask_digits(t: Traced) -> Traced:
    low = _fold(t.text)
    if not _SPOKEN_HINT.search(low):
        return t
    edits = []
    for run in _SPOKEN.finditer(low):
        pieces: list[tuple[str, int, int]] = []
        named = 0
        for m in _SPOKEN_PART.finditer(low, run.start(), run.end()):
            if m["name"]:
                named += 1
                pieces.append((_DIGIT_NAMES[m["name"]], m.start(), m.end()))
            elif m["digits"]:
                pieces.extend((c, m.start() + i, m.start() + i + 1) for i, c in enumerate(m["digits"]))
            else:
                pieces.append(("+" if m["plus"] else ".", m.start(), m.end()))
        if named >= 2:
            edits.append((run.start(), run.end(), pieces))
    return t.rewrite(edits)


def hidden_spans(text: str, plain: list[Span]) -> list[Span]:
    """Spans that only the rewritten text shows, in source offsets."""
    t = Traced(text, range(len(text)), range(1, len(text) + 1))
    seen = t
    for step in (_unmask_characters, _unmask_signs, _unmask_digits):
        t = step(t)
    if t is seen:
        return []
    taken = {kind: [(a, b) for a, b, k in plain if k == kind] for kind in KINDS}
    out = []
    for a, b, kind in plain_spans(t.text):
        a, b = t.starts[a], t.ends[b - 1]
        known = taken[kind]
        i = bisect_left(known, (a, a))
        if (i < len(known) and known[i][0] < b) or (i and known[i - 1][1] > a):
            continue
        out.append((a, b, kind))
    return out


def _hashes(words: list[str]) -> np.ndarray:
    out = []
    for w in words:
        raw = np.frombuffer(w.encode(), dtype=np.uint8)
        out.append(bk.word_hashes(raw, np.array([0]), np.array([len(raw)]))[0])
    return np.sort(np.array(out, dtype=np.uint64))


_NAME_HASHES = _hashes(sorted({*_DIGIT_NAMES, *(x.replace("ü", "Ü").replace("é", "É") for x in _DIGIT_NAMES)}))
_DOT_HASHES = _hashes(["dot"])
_LINK_HASHES = _hashes(["dot", "point", "plus"])
_DIGIT_BYTE = np.zeros(256, dtype=bool)
_DIGIT_BYTE[48:58] = True
#: Brackets, and lead bytes of characters outside the plain Latin letters.
_SIGN_BYTE = np.zeros(256, dtype=bool)
_SIGN_BYTE[[ord(c) for c in "[({<"] + [0xC2] + list(range(0xC4, 0x100))] = True


def _among(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    return wanted[np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)] == values


def may_hide(column: pa.Array) -> np.ndarray:
    """Rows that a transducer could change, found on the bytes of all rows at once.

    A row passes with a bracket, a character outside the plain Latin letters, an
    "@" beside a space, the word "dot", or a digit's name next to another name, a number or a link word;
    each rewriting needs one of these.
    """
    out = np.zeros(len(column), dtype=bool)
    for lo, hi, buf, offsets in bk.text_slices(column):
        starts, ends, first = bk.word_spans(buf, offsets, bk.ALNUM)
        words = bk.word_hashes(buf, starts, ends)
        name = _among(words, _NAME_HASHES)
        part = name | _among(words, _LINK_HASHES) | _DIGIT_BYTE[buf[starts]]
        use = _among(words, _DOT_HASHES)
        if len(words) > 1:
            use[1:] |= (name[1:] & part[:-1]) | (part[1:] & name[:-1])
        rows = np.searchsorted(first, np.flatnonzero(use), "right") - 1
        rows = np.append(rows, np.searchsorted(offsets, np.flatnonzero(_SIGN_BYTE[buf]), "right") - 1)
        at = np.flatnonzero(buf == 64)
        beside = (~bk.NONSPACE[buf[np.maximum(at - 1, 0)]]) | (~bk.NONSPACE[buf[np.minimum(at + 1, len(buf) - 1)]])
        rows = np.append(rows, np.searchsorted(offsets, at[beside], "right") - 1)
        out[lo + np.unique(rows)] = True
    return out


def spans_of(column: pa.Array) -> Iterator[tuple[str, list[Span], list[Span]]]:
    """(text, plain spans, hidden spans) of each row."""
    for value, maybe in zip(column, may_hide(column).tolist(), strict=True):
        text = value.as_py() or ""
        plain = plain_spans(text)
        yield text, plain, hidden_spans(text, plain) if maybe else []


def render_spans(spans: list[Span]) -> str:
    order = {kind: i for i, kind in enumerate(KINDS)}
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(spans, key=lambda s: (s[0], order[s[2]], s[1])))


def mask(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind; overlapping spans become one."""
    out, at, i = [], 0, 0
    spans = sorted(spans)
    while i < len(spans):
        a, b, kind = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < b:
            b = max(b, spans[i][1])
            i += 1
        out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_hidden) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {kind: [] for kind in KINDS}
            digest, spans, hidden = [], [], []
            for _, plain, more in spans_of(batch.column(text)):
                for kind in KINDS:
                    counts[kind].append(sum(s[2] == kind for s in plain))
                digest.append(hashlib.sha256(render_spans(plain).encode()).hexdigest())
                spans.append(render_spans(plain + more))
                hidden.append(len(more))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array(hidden, pa.int64())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_hidden"],
            )

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_hidden long"
    return bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias(text)).mapInArrow(bk.tidy(run), schema)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with every span in the text replaced by its kind, such as <EMAIL>; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index(text)
            out = [mask(value, plain + more) for value, plain, more in spans_of(batch.column(at))]
            columns = list(batch.columns)
            columns[at] = pa.array(out, batch.schema.types[at], mask=np.asarray(batch.column(at).is_null()))
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return bounded_batches(docs).mapInArrow(bk.tidy(run), docs.schema)
