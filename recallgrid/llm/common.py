"""Helpers that the operators of this subpackage share: sizes, shared tables and word rules."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INT64_MIN = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the checkpoint folder set on the context.

    Where both are unset, a new folder of this machine serves a session that runs on it alone; on a cluster that is an error.
    """
    sc = spark.sparkContext
    if set_in_session := spark.conf.get("spark.checkpoint.dir", None):
        return set_in_session.rstrip("/")
    own = sc._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get().rsplit("/", 1)[0]
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = "file://" + tempfile.mkdtemp(prefix="recallgrid-")
    sc.setCheckpointDir(made)
    return made


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/recallgrid/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def write_shared(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def size_in_bytes(df: DataFrame) -> int:
    """Catalyst's estimate; for a scan, the size of the files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def count_for(df: DataFrame, bytes_each: int, least: int, most: int) -> int:
    """Groups to deal df out to, so that each holds about bytes_each of input."""
    return max(least, min(most, -(-size_in_bytes(df) // bytes_each)))


def block_of(n_blocks: int, *cols: str) -> Column:
    """A row's block: by a hash of its content, so that a recomputed row falls into the same block."""
    return F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in cols]), F.lit(n_blocks)).cast("int")


def freeing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, giving what it no longer uses back to the system at its end: idle workers live on beside the next stage."""

    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return freed


def release_memory() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other systems' C libraries do without
        ctypes.CDLL(None).malloc_trim(0)


def unused_name(df: DataFrame, name: str) -> str:
    """name, or the first longer one that no column of df has in any case."""
    taken = {c.lower() for c in df.columns}
    name = f"__{name}"
    while name.lower() in taken:
        name += "_"
    return name


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def words_of(text: str) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ in UTF-8: bytes.split() splits at exactly these six bytes."""
    return text.encode("utf-8", "surrogatepass").split()
