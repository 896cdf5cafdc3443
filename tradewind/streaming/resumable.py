"""Exports that continue where the last run stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tradewind.sinks.csvfiles import CsvOptions, write_csv


def resume_export(
    arriving: DataFrame,
    select: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    options: CsvOptions = CsvOptions(),
) -> StreamingQuery:
    """Export what arrived since the last run, then stop.

    ``arriving`` is a streaming DataFrame and ``select`` any selection on one
    of its batches.  The checkpoint holds the progress.  A batch is written to
    a folder of its own number and replaced when it runs again, so a restart
    neither loses nor repeats rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        write_csv(select(batch), f"{path}/batch={number}", options, mode="overwrite")

    return (
        arriving.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
