"""What the operators of this subpackage share: reading tables, the shared folder, Python stages over Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: The white space that separates words in every operator here.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. One of our own only where none is named and all run on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="glossa-")
    atexit.register(shutil.rmtree, own, True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


#: Spark removes the shuffle files of a query at its end where this is set.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: computed once, read by every later use, safe from lost executors.

    The shuffle files behind it go when it is written; nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/glossa-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables that written() gave, once nothing reads them any more."""
    for df in tables:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.written_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _libc(name: str, *args: int) -> None:
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have their own ways
        getattr(ctypes.CDLL(None), name)(*args)


def over_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow(fn, schema) in a worker that gives memory back: large blocks when they are freed, the rest after each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _libc("mallopt", -3, 16 << 20)  # M_MMAP_THRESHOLD: larger blocks go back when they are freed
        _libc("mallopt", -1, 64 << 20)  # M_TRIM_THRESHOLD: so much may wait for its next use
        yield from fn(batches)
        pa.default_memory_pool().release_unused()
        _libc("malloc_trim", 0)

    return df.mapInArrow(run, schema)


def by_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """fn over Arrow batches. A batch ends after a bounded number of rows and of bytes, so memory doesn't follow a partition's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return over_batches(df, run, schema)


def slices(batch: pa.RecordBatch, column: str, limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """batch in parts whose strings in column take about limit bytes at most (a single longer row stays whole)."""
    sizes = np.array(pc.binary_length(batch.column(column)).fill_null(0), dtype=np.int64)
    part = np.cumsum(sizes) // limit
    starts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
    for a, b in zip(starts, starts[1:], strict=False):
        yield batch.slice(a, b - a)
