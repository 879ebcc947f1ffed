"""Page queries; trees and boundary automata have no SQL form but for a page's reference rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import sentence_language
from lectern.operators import markup, references, segmentation

from .base import table


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.page_texts(table(spark, sf_dir, "pages"), "page_id")


def clean_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages cleaned against the names they refer to themselves."""
    return markup.clean_pages(table(spark, sf_dir, "pages"), "page_id", references.own_names)


def mark_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.mark_pages(table(spark, sf_dir, "pages"), "page_id", references.own_names)


def segment_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("model", sentence_language(F.col("lang")))
    return segmentation.segments(docs, "doc_id", language="model")


def reference_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.lit("html").alias("kind"), F.col("html").alias("content"))
    return references.reference_names(pages)


QUERIES = {f.__name__: f for f in (html_text, clean_html, mark_segments, segment_boundaries, reference_index)}
ORACLES: dict[str, str] = {}
