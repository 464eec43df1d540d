"""Helpers that the operators of this subpackage have in common."""

from __future__ import annotations

import ctypes
import os
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes, that Spark hands to a Python worker at once. Texts can be long, so that rows alone could be gigabytes.
ARROW_ROWS, ARROW_BYTES = 4000, 8 << 20
#: Bytes of UTF-8 text after which a Python operator hands its results on.
CHUNK_BYTES = 4 << 20
#: Words are runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: How Python workers allocate, for what is freed to go back to the system at once: large arrays by pages of their own.
WORKER_MEMORY = {"MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": "1048576", "MALLOC_TRIM_THRESHOLD_": "1048576", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches and let executors that share the code's folder import the package."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH", ""), root) if x)
    for name, value in WORKER_MEMORY.items():
        env.setdefault(name, value)
    return spark


def shared_dir(spark: SparkSession, prefix: str) -> str:
    """A new folder's URI under spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent a temporary folder takes its place, on one machine alone: elsewhere executors wouldn't see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="braidflow-")
        spark.conf.set("spark.checkpoint.dir", base)
    if "://" not in base and not base.startswith("file:"):
        base = "file://" + base
    return f"{base.rstrip('/')}/{prefix}-{uuid.uuid4().hex}"


#: Whether an execution's shuffle files go as it ends. Else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, prefix: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there and survives lost executors. Nothing
    reads what the write has shuffled again, so that it goes at once."""
    conf = df.sparkSession.conf
    path = shared_dir(df.sparkSession, prefix)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The pyarrow file system of a URI (file, hdfs, s3, gs and so on) and the path in it."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def put_file(uri: str, write) -> None:
    """Create a file whole or not at all: write(stream) fills a file of another name, which is then renamed.

    A task that runs again writes the same bytes, so that either attempt's file serves.
    """
    system, path = filesystem(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(temporary) as stream:
        write(stream)
    system.move(temporary, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialised tables that no later step reads."""
    for path in {f.rsplit("/", 1)[0] for t in tables for f in t.inputFiles()}:
        system, folder = filesystem(path)
        system.delete_dir(folder)


def give_back() -> None:
    """Hand memory that Python and Arrow have freed back to the system: a worker lives on beside those of later operators."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def tidied(run: Callable) -> Callable:
    """run, an operator on batches, with what it has freed given back at the task's end."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


_OWNER: dict = {"name": None, "clear": None}


def take_memory(name: str, clear: Callable[[], object]) -> None:
    """Called where an operator starts in a worker: what another one remembered there is let go, as workers live on."""
    if _OWNER["name"] not in (None, name):
        _OWNER["clear"]()
        give_back()
    _OWNER.update(name=name, clear=clear)


def own(name: str) -> str:
    """A column name that doesn't clash with those of a caller's table."""
    return f"__{name}"


def text_or_empty(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def crc32_mod(column: str, k: int) -> Column:
    """crc32 of the value as text, modulo k. Null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(k))


def pieces(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES):
    """Row ranges of a batch whose texts hold about limit bytes."""
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        total += n
        if total >= limit:
            yield batch.slice(start, i + 1 - start)
            start, total = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)
