"""Overlay documents as clip rows, and clip rows as overlay documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_AUDIO = "struct<_src:string,_clipBegin:string,_clipEnd:string>"
_PAR = f"array<struct<_id:string,audio:array<{_AUDIO}>>>"
SCHEMA = f"body struct<par:{_PAR},seq:array<struct<par:{_PAR}>>>"


def clip_rows(documents: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, par_id, audio_file, begin_raw, end_raw) of every audio reference; missing attributes are null."""
    parsed = documents.select(key, F.from_xml(F.col(xml), SCHEMA).alias("d"))
    none = F.array().cast(_PAR)
    pars = F.concat(F.coalesce("d.body.par", none), F.flatten(F.transform(F.coalesce("d.body.seq", F.array().cast(f"array<struct<par:{_PAR}>>")), lambda s: F.coalesce(s.par, none))))
    rows = parsed.select(key, F.explode(pars).alias("p")).select(key, F.col("p._id").alias("par_id"), F.explode("p.audio").alias("a"))
    return rows.select(key, "par_id", F.substring_index("a._src", "/", -1).alias("audio_file"), F.col("a._clipBegin").alias("begin_raw"), F.col("a._clipEnd").alias("end_raw"))


def _escaped(c: Column) -> Column:
    for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def render_overlays(clips: DataFrame, key: str, text_href: str, order: str) -> DataFrame:
    """(key, xml): one par a clip that has length, in order, times with three decimals."""
    clock = lambda c: F.concat(F.format_string("%.3f", F.col(c)), F.lit("s"))
    par = F.concat(
        F.lit('<par id="par'), F.col(order).cast("string"), F.lit('"><text src="'), _escaped(F.col(text_href)), F.lit("#"), _escaped(F.col("seg_id")),
        F.lit('"/><audio src="'), _escaped(F.col("audio_file")), F.lit('" clipBegin="'), clock("start"), F.lit('" clipEnd="'), clock("end"), F.lit('"/></par>'),
    )
    rows = clips.where("end > start").select(key, order, par.alias("par")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "par"))).alias("p"))
    body = F.array_join(F.transform("p", lambda x: x.par), "")
    return rows.select(key, F.concat(F.lit('<smil xmlns="http://www.w3.org/ns/SMIL" version="3.0"><body>'), body, F.lit("</body></smil>")).alias("xml"))
