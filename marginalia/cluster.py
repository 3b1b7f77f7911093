"""What every part of the package needs from a cluster: shipped code, shared scratch tables, distributed ranks.

Executors may run on other machines than the driver. Python workers therefore get the package as a zip through
``SparkContext.addPyFile``, and intermediate tables are written as Parquet below the folder that
``spark.checkpoint.dir`` names, which all executors share. A written table cuts the lineage: after the loss of an
executor, only the tasks since the last table run again.
"""

from __future__ import annotations

import atexit
import contextlib
import io
import math
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_PACKAGE = Path(__file__).resolve().parent
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of ``spark``; once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(_PACKAGE.rglob("*.py")):
            archive.write(path, path.relative_to(_PACKAGE.parent).as_posix())
    folder = tempfile.mkdtemp(prefix="marginalia-")
    target = os.path.join(folder, f"marginalia_{uuid.uuid4().hex[:8]}.zip")
    Path(target).write_bytes(buffer.getvalue())
    context.addPyFile(target)  # the driver's file server hands it out
    _SHIPPED.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, else the context's own, else, on one machine, one for tests."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    own = context._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get()
    if not context.master.startswith("local"):  # a folder of one machine would lose tables on the others
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="marginalia-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


class Scratch:
    """Parquet tables of one operator run below the shared folder.

    ``table`` writes a frame and returns it as read back, so that later plans start from files with known sizes.
    ``drop`` deletes tables that no result reads any more; the rest go when the driver's process ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        atexit.register(self._remove, self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, frame: DataFrame, name: str) -> DataFrame:
        frame.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(frame.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            self._remove(self.path(name))

    def _remove(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the context has ended; the folder is scratch
            pass


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt over all cores by ``keys``, for work that costs much a row: a file of few row groups is read by as many
    tasks, whatever its size. Tables that are read in many tasks stay as they are."""
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= tasks else rows.repartition(tasks, *keys)


@contextlib.contextmanager
def small_batches(spark: SparkSession, *, rows: int = 1000, size: str = "8m") -> Iterator[None]:
    """Arrow batches of at most so many rows and bytes for what runs inside: texts and arrays can be long."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {key: spark.conf.get(key, None) for key in wanted}  # None where the session does not set it
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def give_back() -> None:
    """Return a Python worker's free memory to the system: workers stay for later tasks, beside a JVM that needs it."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def then_give_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The function of a ``mapInArrow``, with ``give_back`` when a task ends."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def row_order(frame: DataFrame, within: list[str], order: list[str], bits: Column, *, sums: dict[str, str] | None = None, total: int | None = None, per_task: int = 200_000) -> DataFrame:
    """Rank every row inside its group without gathering a group in one task.

    ``bits`` is a non-negative long below 2**60 which starts the order; ``order`` names further columns that make it
    total. Rows are cut into ranges of ``bits``; each range is ranked alone, and counts of the ranges before are added.
    Adds ``rank`` (from 0) and, for each ``sums`` entry (new name -> column), the sum over the rows before.
    """
    sums = sums or {}
    total = frame.count() if total is None else total
    cut = max(0, math.ceil(math.log2(max(1, total) / per_task)))
    ranged = frame.withColumn("_bits", bits).withColumn("_range", F.shiftright("_bits", 60 - cut).cast("int") if cut else F.lit(0))
    if not cut:
        groups = Window.partitionBy(*within).orderBy("_bits", *order) if within else Window.partitionBy("_range").orderBy("_bits", *order)
        out = ranged.withColumn("rank", F.row_number().over(groups).cast("long") - 1)
        for name, column in sums.items():
            out = out.withColumn(name, F.sum(column).over(groups.rowsBetween(Window.unboundedPreceding, 0)) - F.col(column))
        return out.drop("_bits", "_range")
    keys = [*within, "_range"]
    parts = ranged.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *(F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()))
    before = (Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))).orderBy("_range")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"), *(F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_base_{n}") for n in sums))
    inner = Window.partitionBy(*keys).orderBy("_bits", *order)
    out = ranged.withColumn("rank", F.row_number().over(inner).cast("long") - 1)
    for name, column in sums.items():
        out = out.withColumn(name, F.sum(column).over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col(column))
    match = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    out = out.join(parts, match, "left").withColumn("rank", F.col("rank") + F.col("_base"))
    for name in sums:
        out = out.withColumn(name, F.col(name) + F.col(f"_base_{name}"))
    return out.drop("_bits", "_range", "_base", *(f"_k{i}" for i in range(len(keys))), *(f"_base_{n}" for n in sums))
