"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only where the session names none (tests, local runs) is a folder of our
    own set; a cluster that names none is an error, since its machines share no
    temporary folder.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="gleaner-"))
        base = sc.getCheckpointDir()
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/gleaner-{name}-{uuid.uuid4().hex}"
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    return path


def remove(spark: SparkSession, path: str) -> None:
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hpath, True)


def stash(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back.

    The files survive a lost executor, unlike a local checkpoint, and keep
    column pruning, unlike an RDD checkpoint.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.partitionBy(*by) if by else df.write
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def drop(*stashed: DataFrame) -> None:
    """Remove the files of stashed tables that nothing reads any more."""
    for df in stashed:
        remove(df.sparkSession, df._stash_path)


def slices(batch: pa.RecordBatch, column: int, most_bytes: int = 1 << 20, most_rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``most_bytes`` of text; a longer text is a piece of its own.

    An Arrow batch holds thousands of rows; what is made of it, row by row, should not be held for all of them.
    """
    sizes = np.diff(np.frombuffer(offsets_of(batch.column(column)), np.int64))
    i, n = 0, batch.num_rows
    total = np.concatenate([[0], np.cumsum(sizes)])
    while i < n:
        j = min(max(i + 1, int(np.searchsorted(total, total[i] + most_bytes, side="right")) - 1), i + most_rows, n)
        yield batch.slice(i, j - i)
        i = j


def offsets_of(column: pa.Array) -> bytes:
    """Offsets of a string or binary column's rows, as 64-bit integers."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return bytes(8)
    raw = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    return raw[column.offset : column.offset + len(column) + 1].astype(np.int64).tobytes()


def trimmed(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``f``, and behind its last batch what the worker has freed goes back to the machine: idle workers stay, and count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not glibc
            pass

    return run


_WORKER: dict[str, object] = {}


class Shared:
    """A broadcast value and what a worker process builds of it, once; another one takes its place, so that stages don't add up."""

    def __init__(self, spark: SparkSession, value, build: Callable):
        self.key, self.value, self.build = uuid.uuid4().hex, spark.sparkContext.broadcast(value), build

    def get(self):
        if self.key not in _WORKER:
            _WORKER.clear()
            _WORKER[self.key] = self.build(self.value.value)
        return _WORKER[self.key]


def held_out(doc_id) -> F.Column:
    """Rows that no classifier here learns from: crc32 of the id's digits, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
