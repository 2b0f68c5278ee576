"""Shared scratch storage: every lineage cut goes to the folder that the cluster names."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch: whole texts have no fixed size, so Spark's 10,000 rows or 64 MB would be too much for several workers.
TEXT_ROWS, TEXT_BYTES = 1000, 16 << 20


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where it is unset on a local master (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            return current
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="wayfold-")
        spark.sparkContext.setCheckpointDir(root)
    return root


_made: dict[str, list[str]] = {}


def fresh_dir(spark: SparkSession, name: str) -> str:
    path = f"{shared_root(spark).rstrip('/')}/wayfold-{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear(spark: SparkSession) -> None:
    """Delete what this application wrote to the shared folder; results that still read it end here."""
    for path in _made.pop(spark.sparkContext.applicationId, []):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def materialize(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Unlike an executor-local checkpoint the table survives lost executors, and its
    statistics let the planner choose a join by the size that was really written.
    ``narrow`` tables (a few ids in each row) are written by an eighth of the shuffle's
    tasks, so that a loop does not leave thousands of tiny files.
    """
    spark = df.sparkSession
    if narrow:
        df = df.coalesce(max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    path = fresh_dir(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: What operators remember in a Python worker from task to task, by the operator's name.
REMEMBERED_BY: dict[str, dict] = {}


def forget_others(name: str) -> None:
    for other, held in REMEMBERED_BY.items():
        if other != name:
            held.clear()


def map_texts(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, name: str = "") -> DataFrame:
    """``mapInArrow`` over texts in batches of at most ``TEXT_ROWS`` rows and about ``TEXT_BYTES`` (a longer text is a batch of its own).

    A task's memory goes back when it ends; what other operators than ``name`` have remembered
    in the worker goes when it begins.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= TEXT_ROWS:
        conf.set(key, TEXT_ROWS)
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{TEXT_BYTES}b")

    def trimmed(batches):
        forget_others(name)
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(trimmed, schema)


#: Arrays that one task adds up.
FAN_IN = 16


def sum_arrays(parts: DataFrame, kind: str) -> dict[int, np.ndarray]:
    """Sums of the tasks' zlib-packed arrays, by ``part``; ``parts`` has ``part, task, body``.

    A tree: no task holds more than ``FAN_IN`` arrays, however many tasks made one.
    """

    def add(table: pa.Table) -> pa.Table:
        table, total = table.sort_by("task"), None  # sums of floats keep one order
        for body in table.column("body"):
            own = np.frombuffer(zlib.decompress(body.as_buffer()), kind)
            total = own.copy() if total is None else np.add(total, own, out=total)
        return pa.table({"part": table.column("part").slice(0, 1), "task": pa.array([table.column("task")[0].as_py() // FAN_IN], pa.int32()), "body": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    level = materialize(parts.select("part", "task", "body"), "sums")
    most = level.agg(F.max("task")).first()[0]
    while most is not None and most > 0:
        grouped = level.groupBy("part", F.floor(F.col("task") / FAN_IN).alias("group")).applyInArrow(add, "part int, task int, body binary")
        most //= FAN_IN
        level = materialize(grouped, "sums") if most > 0 else grouped
    return {r["part"]: np.frombuffer(zlib.decompress(r["body"]), kind) for r in level.toArrow().to_pylist()}  # one row for each part


def packed_row(part: int, body: np.ndarray) -> pa.RecordBatch:
    """One row of ``sum_arrays``' input from the running task."""
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([zlib.compress(body.tobytes(), 1)], pa.binary())], ["part", "task", "body"])


def give_back() -> None:
    """Return free memory of this worker to the system: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library; the allocator keeps its pages
