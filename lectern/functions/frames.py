"""Physical helpers: frames of few small files, batches to and from Python."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20
#: About what a row takes in Python beside its strings.
ROW_BYTES = 200


def spread(frame: DataFrame) -> DataFrame:
    """The frame, dealt to all cores if its few small files would keep most of them idle.

    Only metadata is read, and file names only of an input that would not give
    each core a scan partition; any larger one, or one with as many files as
    cores, stays where it lies.
    """
    spark = frame.sparkSession
    cores = spark.sparkContext.defaultParallelism
    conf = spark._jsparkSession.sessionState().conf()
    size = int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= cores * conf.filesMaxPartitionBytes():
        return frame
    return frame.repartition(cores) if 0 < len(frame.inputFiles()) < cores else frame


#: Bytes of input files that one task counts windows of; their counts take about 100 times as much.
KEYED_BYTES = 2 << 20


def by_key(frame: DataFrame, key: str) -> DataFrame:
    """The frame, parted by a key into so many tasks that each gets about KEYED_BYTES of its files.

    Whatever is counted by that key afterwards stays in its task: rows are moved
    once, before they are exploded.
    """
    spark = frame.sparkSession
    size = int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 50:  # not known
        return frame.repartition(key)
    return frame.repartition(max(spark.sparkContext.defaultParallelism, -(-size // KEYED_BYTES)), key)


def bounded_batches(frame: DataFrame) -> DataFrame:
    """The frame, spread over the cores if it is a few small files; batches sent to Python hold BATCH_BYTES at most, or one row.

    By default a batch may hold 64 MB of rows, and a kernel's temporaries are a
    multiple of its batch.
    """
    conf = frame.sparkSession.conf
    if int(frame.sparkSession._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) > BATCH_BYTES:
        conf.set(BATCH, str(BATCH_BYTES))
    return spread(frame)


def in_frames(rows: Iterable[tuple], columns: list[str], most: int = BATCH_BYTES) -> Iterator[pd.DataFrame]:
    """The rows as frames of about `most` bytes, however many rows a batch of the input gives; rows are drawn as they are needed."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += ROW_BYTES + sum(len(x) for x in row if isinstance(x, str))
        if size >= most:
            yield pd.DataFrame(held, columns=columns)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns)
