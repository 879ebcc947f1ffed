"""The corpus pipeline: toxic documents go, near copies and benchmark leaks go, personal data is masked, texts become ids.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept; all but the last return the columns they got.  run() writes each
stage's rows as Parquet in the shared work folder and reads them for the next.

Defined results: a null text has no words, no personal data and no ids, is scored
like an empty one and stays null until it is encoded; a row without doc_id is
linked with no other and stays; of rows that share a doc_id the near-copy stage keeps one; an empty table gives
an empty table; further columns stay as they are, whatever their names, up to the
last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import byte_bpe, decontaminate, jaccard_join, pii, toxicity
from lectern.llm.queries import vocabulary
from lectern.llm.workspace import Workspace


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5, learnt from the labelled documents outside the held-out fifth."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = toxicity.fit(docs, labels, toxicity.fold_of(F.col("doc_id"), 5) != 0)
    return toxicity.keep_clean(docs, machine)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 0.8 of its five-word shingles, the document with the least id."""
    return jaccard_join.keep_one_of_each(docs, Workspace(spark, "stage-copies"), width=5, percent=80)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of a benchmark item."""
    return decontaminate.keep_uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), Workspace(spark, "stage-leaks"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind, and their new lengths."""
    out = pii.redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out


def encode_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids): token ids as packed little-endian unsigned 32-bit integers."""
    rows = byte_bpe.encode_column(docs.select("doc_id", "text"), *vocabulary())
    return rows.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("pii", mask_personal_data),
    ("byte_bpe", encode_ids),
]

#: Neither learnt scores nor token ids can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = work.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
