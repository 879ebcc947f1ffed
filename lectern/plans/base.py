"""What the query modules share: tables by role, and SQL fragments for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(column: str):
    """Seconds since 2000 of a timestamp without zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '2000-01-01 00:00:00'"), F.col(column)) / F.lit(1e6)


SQL_SECONDS = "(date_diff('microsecond', TIMESTAMP '2000-01-01', {0}) / 1e6)"

#: White space as the engine splits it, for RE2.
SQL_SPACE = r"[\t-\r\x1c-\x20\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
SQL_TOKENS = (
    "list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce({0}, ''), '[-‐-―]', ' ', 'g'), '"
    + SQL_SPACE
    + r"'), lambda w: regexp_replace(lower(w), '[^\p{{L}}\p{{N}}_]', '', 'g')), lambda t: t <> '')"
)


def sql_tokens(column: str) -> str:
    space = SQL_SPACE.replace("{", "{{").replace("}", "}}")
    return SQL_TOKENS.replace(SQL_SPACE, space).format(column)


SQL_WINDOWS = """
    spans AS (SELECT doc_id, n_tokens, unnest(CASE WHEN n_tokens < 5 THEN []
                     WHEN n_tokens <= 160 THEN [0]
                     ELSE list_sort(list_distinct(list_append(range(0, n_tokens - 159, 80), n_tokens - 160))) END) AS window_start FROM toks),
    wins AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY window_start) - 1 AS INTEGER) AS window_index,
                    CAST(window_start AS INTEGER) AS window_start, CAST(least(window_start + 160, n_tokens) AS INTEGER) AS window_end FROM spans)
"""


def sql_toks(source: str = "documents", key: str = "doc_id") -> str:
    return f"toks0 AS (SELECT {key}, {sql_tokens('text')} AS tokens FROM {source}), toks AS (SELECT *, len(tokens) AS n_tokens FROM toks0)"
