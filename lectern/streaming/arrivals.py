"""Arriving transcripts: a stateful forward gate, and batches that land once.

The batch engine has no streams; these are for transcripts that come in while a
book is still being read out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "book string, chunk long, html_order long, forward boolean, last_order long"
STATE = "last_order long, last_chunk long"


def forward_gate(matches: DataFrame) -> DataFrame:
    """(book, chunk, html_order) matches with whether each keeps the reading order, by book and across batches.

    Within a batch a book's matches go in chunk order; the furthest place reached
    is kept as state.
    """

    def gate(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, newest = state.get if state.exists else (-1, -1)
        rows = []
        for r in pd.concat(list(frames)).sort_values("chunk").itertuples(index=False):
            forward = bool(r.html_order >= last)
            last, newest = max(last, int(r.html_order)), max(newest, int(r.chunk))
            rows.append((key[0], int(r.chunk), int(r.html_order), forward, last))
        state.update((last, newest))
        yield pd.DataFrame(rows, columns=["book", "chunk", "html_order", "forward", "last_order"])

    return matches.groupBy("book").applyInPandasWithState(gate, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def land(stream: DataFrame, path: str, checkpoint: str, process: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Process each micro-batch and write it under its number, so that a batch that runs again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
