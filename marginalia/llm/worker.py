"""What a Python worker keeps between tasks: one large object at a time.

Workers are reused by later stages, beside a JVM that needs the memory. A table or an encoder that a stage has built is
kept for its next tasks, and goes when another stage builds its own.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Hashable
from typing import TypeVar

from pyspark.sql import SparkSession

T = TypeVar("T")
_LOCK = threading.Lock()
_KEPT: dict[Hashable, object] = {}


def kept(key: Hashable, build: Callable[[], T]) -> T:
    """The object of this key, built if it is not the one that is kept."""
    with _LOCK:
        if key not in _KEPT:
            _KEPT.clear()
            _KEPT[key] = build()
        return _KEPT[key]


def forget() -> None:
    """Keep nothing: for stages that need no such object."""
    with _LOCK:
        _KEPT.clear()


def short_batches(spark: SparkSession, *, rows: int = 1000, size: str = "8m") -> None:
    """Arrow batches of at most so many rows and bytes in this session from now on: texts can be long, and what a stage
    returns is run later than its function."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, rows + 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
