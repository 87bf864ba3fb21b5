"""Tables written once to the shared folder, which cuts lineage and plan size."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame

_own: list[str] = []


def kept(df: DataFrame, label: str) -> DataFrame:
    """``df`` written below ``spark.checkpoint.dir`` (a local folder only where none is set) and read back."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            folder = tempfile.mkdtemp(prefix="formulaspark-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            _own.append(f"file://{folder}")
        base = _own[0]
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
