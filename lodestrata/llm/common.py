"""Shared folders, table checkpoints and size checks used by the operators."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of at most this many narrow rows (two longs) may be broadcast: some 32 MB.
BROADCAST_ROWS = 2_000_000


_MADE: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("made", default=None)


def shared_root(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or the directory given to setCheckpointDir.

    Where neither is set, a local master (one machine, one process) gets a temporary folder, as in tests; a cluster is an error, as no
    folder is known to be shared there.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="lodestrata-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder URI for one run of an operator under the shared root."""
    root = shared_root(spark)
    if "://" not in root and not root.startswith("file:"):
        root = f"file://{root}"
    path = f"{root}/lodestrata/{name}-{uuid.uuid4().hex[:12]}"
    if (made := _MADE.get()) is not None:
        made.append(path)
    return path


@contextlib.contextmanager
def tracked() -> Iterator[list[str]]:
    """The workspaces made inside the block, for a caller that has stored its result and removes them."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield made
    finally:
        _MADE.reset(token)


def remove_all(spark: SparkSession) -> None:
    """Delete every workspace under the shared root; results that weren't stored elsewhere go with them."""
    root = shared_root(spark)
    remove(spark, f"{root}/lodestrata")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop, so that any shared store works."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, path: str, large_cells: bool = False) -> DataFrame:
    """Write df and read it back: a cut in the lineage that outlives lost executors.

    large_cells: cells of megabytes that don't compress, such as hashes; their pages are then bounded by size from the first row on.
    """
    writer = df.write.mode("overwrite")
    if large_cells:
        writer = writer.options(**{"compression": "none", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.enable.dictionary": "false"})
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast df if its counted rows fit the bound, else leave the join to shuffle."""
    return F.broadcast(df) if rows <= limit else df


def open_store(uri: str):
    """(filesystem, path) of a URI for Python workers; plain paths are local."""
    from pyarrow import fs

    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = f"file://{uri[5:]}"
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after whose last batch the worker gives its free memory back: workers live on, and the next stage needs the room."""

    @functools.wraps(run)
    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
        if trim:
            trim(0)

    return out


def input_splits(df: DataFrame) -> int:
    """Planned scan partitions of df: grows with the bytes read, costs no job."""
    return df.rdd.getNumPartitions()
