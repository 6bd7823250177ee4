"""What the operators of this package share: inputs, checkpoints, bounded settings."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nounspan.session import scratch_path
from nounspan.sources.storage import delete

# The white space that the contracts of this package name.
SPACES = "[\\x20\\x09-\\x0D]"
NO_ID = -(2**63)
# What a worker makes of a batch is held for so many of its bytes at a time.
PIECE_BYTES = 8 * 1024 * 1024


def release_memory() -> None:
    """Return to the system what a finished batch has left free.

    Spark keeps Python workers for later stages, and what their allocators hold
    back counts against the executor all that time.
    """
    pa.default_memory_pool().release_unused()
    # Looked up here: this function travels to the workers by value.
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def pieces(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch as slices that hold about ``PIECE_BYTES`` of one column, or one row.

    Spark bounds a batch by its rows alone.  A slice shares the memory of the batch.
    """
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // PIECE_BYTES)) + 1
    edges = [0, *cuts.tolist(), batch.num_rows]
    for start, end in zip(edges, edges[1:]):
        yield batch.slice(start, end - start)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_open: list[list[str]] = []


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Delete the checkpoints that are made inside when the block ends.

    What is needed after that must have been written on from them.
    """
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            delete(spark, path)


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """Checkpoint of what ``make`` returns; those that it made on the way are deleted.

    Spark deletes the shuffle files of a step when the driver's garbage
    collector finds that nothing refers to them.  It is asked to look now, for a
    long chain of steps would fill the disks before it does by itself.
    """
    with intermediates(spark):
        out = checkpointed(make())
        kept = _open[-1].pop()
    if _open:
        _open[-1].append(kept)
    spark._jvm.System.gc()
    return out


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of a slim intermediate result, reliably.

    The files go to the folder that the cluster names in
    ``spark.checkpoint.dir``.  Inside ``intermediates`` they are deleted at its
    end; elsewhere Spark removes them when nothing refers to them any more, if
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.  Only a local
    session without a named folder gets one of its own.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="nounspan-checkpoint-"))
    out = df.checkpoint(eager=True)
    if _open:
        _open[-1].append(out._jdf.queryExecution().logical().rdd().getCheckpointFile().get())
    return out


class Scratch:
    """A folder of written intermediate tables in the shared scratch folder.

    ``close``, or the end of a ``with`` block, deletes them: only what has been
    written on from them may be read after that.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.path = spark, scratch_path(spark, label)

    def store(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        delete(self.spark, self.path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *failed) -> None:
        self.close()


def shuffle_width(spark: SparkSession) -> int:
    """Number of shuffle partitions that the session is set to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(name: str) -> Column:
    """The text of a row; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def id_key(name: str) -> Column:
    """Order of ids: a row without an id comes before all others."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))
