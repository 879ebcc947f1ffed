"""Token, identifier and markup expressions. All are column expressions that Catalyst compiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space (Unicode, and the four ASCII separators) and the dashes that split words.
SPACES = r"(?U)[\s\x1c-\x1f]+"
DASHES = "[-‐-―]"
DASH_CHARACTERS = "-‐‑‒–—―"
NOT_WORD = r"[^\p{L}\p{N}_]"

MIN_LONG = 4


def words(text: Column) -> Column:
    """White-space separated words of a text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def clean_token(c: Column) -> Column:
    """Lower case, with everything but letters, digits and underscores gone."""
    return F.regexp_replace(F.lower(c), NOT_WORD, "")


def match_tokens(word: Column) -> Column:
    """Normal tokens of one displayed word: its parts between dashes, cleaned, without empty ones."""
    return F.filter(F.transform(F.split(word, DASHES), clean_token), lambda t: t != "")


def text_tokens(text: Column) -> Column:
    """All normal tokens of a text in order; the whole text is cleaned once and split once."""
    apart = F.lower(F.translate(F.coalesce(text, F.lit("")), DASH_CHARACTERS, " " * len(DASH_CHARACTERS)))
    bare = F.regexp_replace(apart, r"(?U)[^\p{L}\p{N}_\s\x1c-\x1f]+", "")
    return F.array_remove(F.split(bare, SPACES), "")


def displayed_tokens(text: Column) -> Column:
    """Structs (display, token) in order; each token keeps the word it came from.

    Words are parted by one space in the text and in its cleaned form alike, so
    the two split into the same number of words.
    """
    shown = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "))
    bare = F.regexp_replace(F.lower(F.translate(shown, DASH_CHARACTERS, "-" * len(DASH_CHARACTERS))), r"[^\p{L}\p{N}_ -]+", "")
    both = F.arrays_zip(F.split(shown, " ").alias("display"), F.split(bare, " ").alias("parts"))
    return F.flatten(F.transform(both, lambda w: F.transform(F.array_remove(F.split(w.parts, "-"), ""), lambda t: F.struct(w.display.alias("display"), t.alias("token")))))


def letters_only(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L} ]", "")


def identifier(c: Column) -> Column:
    """ASCII identifier: runs of other characters become one underscore."""
    c = F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9A-Za-z]+", "_"), "^_+|_+$", ""))
    return F.when(c == "", "item").when(c.rlike("^[0-9]"), F.concat(F.lit("item_"), c)).otherwise(c)


def without_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", "")


def transcript_name(path: Column) -> Column:
    """The transcript's file name of an audio file."""
    return F.concat(without_extension(F.regexp_extract(path, "([^/]*)$", 1)), F.lit(".json"))


def segment_prefix(path: Column) -> Column:
    return F.concat(F.lit("seg_"), identifier(without_extension(path)))


def overlay_name(path: Column) -> Column:
    return F.concat(identifier(without_extension(path)), F.lit(".smil"))


def overlay_id(path: Column) -> Column:
    return F.concat(F.lit("html_overlay."), identifier(without_extension(path)))


def fragment_names(markup: Column) -> Column:
    """Everything after a # up to a space, quote or further #, wherever it stands."""
    return F.regexp_extract_all(F.coalesce(markup, F.lit("")), F.lit("#([^#\\s\"']+)"), F.lit(1))


def script_names(script: Column) -> Column:
    """Identifier-like words of at least two characters."""
    return F.regexp_extract_all(F.coalesce(script, F.lit("")), F.lit("[A-Za-z_][A-Za-z0-9_-]+"), F.lit(0))


#: Sentence models by language code.
LANGUAGES = {
    "cs": "czech", "da": "danish", "de": "german", "el": "greek", "en": "english", "es": "spanish", "et": "estonian", "fi": "finnish", "fr": "french",
    "it": "italian", "nl": "dutch", "no": "norwegian", "pl": "polish", "pt": "portuguese", "ru": "russian", "sl": "slovene", "sv": "swedish", "tr": "turkish",
}


def sentence_language(code: Column) -> Column:
    """Sentence model of a language code: english if none is given, the base subtag if the code is unknown."""
    clean = F.lower(F.replace(F.trim(F.coalesce(code, F.lit(""))), F.lit("_"), F.lit("-")))
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    base = F.substring_index(clean, "-", 1)
    return F.when(clean == "", "english").otherwise(F.coalesce(table[clean], table[base], base))
