"""A check suite over every batch of a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.suite import run_checks


def check_stream(stream: DataFrame, name: str, suite: list[dict], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each batch is the table of that name in the suite's checks; its rows go to sink(rows, batch number).

    A batch that is run again has its number again, so that an idempotent sink stays exact.
    """

    def run(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            sink(run_checks(suite, tables={name: batch}), number)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()
