"""Helpers that the training-data operators share.

Every intermediate table goes to the folder named by ``spark.checkpoint.dir``,
which driver and executors share; losing an executor then costs one task.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import sys
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; a local one only where none is set."""
    global _own_dir
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own_dir:
            _own_dir = tempfile.mkdtemp(prefix="formulaspark-")
            atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
        base = f"file://{_own_dir}"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Arrow batches of at most ``rows`` rows, or fewer where the session says so, and 4 MB."""
    ours = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
    before = {name: spark.conf.get(name) for name in ours}
    if 0 < int(before["spark.sql.execution.arrow.maxRecordsPerBatch"]) < rows:
        ours.pop("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for name, value in ours.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def stored(df: DataFrame, label: str, **options) -> DataFrame:
    """``df`` written once to the shared folder and read back, which cuts its lineage.

    ``options`` are those of the Parquet writer.
    """
    spark = df.sparkSession
    path = shared_dir(spark, label)
    with arrow_rows(spark, 1000):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """Any store that Arrow knows by its URI; a bare path is a local one."""
    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    return pafs.FileSystem.from_uri(uri)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone; a null text counts as empty."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def rows_of(batches, *columns):
    """The rows of Arrow batches, one by one, as tuples of Python values."""
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns), strict=True)


def batched(rows, schema: pa.Schema, size: int = 4096):
    """Arrow batches of at most ``size`` rows from an iterator of tuples."""
    held: list[tuple] = []

    def batch():
        columns = list(zip(*held, strict=True)) if held else [[] for _ in schema]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
        )

    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield batch()
            held = []
    if held:
        yield batch()


def release() -> None:
    """Gives a Python worker's free memory back to the system, with the encoders that other stages left there."""
    codec = sys.modules.get(f"{__package__}.codec")
    if codec:
        codec.encoder.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


def lean(work):
    """``work`` over batches, in a worker without the leavings of earlier stages; workers live on between stages."""

    def run(batches):
        release()
        yield from work(batches)
        release()

    return run


class WordCache(dict):
    """word -> value of ``make(word)``; forgets everything at ``limit`` entries."""

    def __init__(self, make, limit: int = 200_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, word):
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.make(word)
        return value


def hash64(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data)
