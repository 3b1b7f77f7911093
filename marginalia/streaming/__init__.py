"""Incremental forms of operators for tables that grow by batches.

The batch operators are the reference for results; nothing here changes them. ``relink`` runs a linkage step on each
micro-batch of new editions against the books as they are, and appends the links; ``first_seen`` keeps the first row of
each record id within a watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter


def first_seen(rows: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """A stream without rows whose keys were seen before, as far back as ``delay``."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def relink(editions: DataFrame, books: DataFrame, link: Callable[[DataFrame, DataFrame], DataFrame], path: str, checkpoint: str) -> DataStreamWriter:
    """A writer that links each micro-batch and writes its links below ``path``, in a folder for each batch.

    A batch that runs again after a failure overwrites its own folder, so each link is there once.
    """

    def write(batch: DataFrame, number: int) -> None:
        link(batch, books).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return editions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
