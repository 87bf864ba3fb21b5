"""Formulas that arrive as a stream: the same stateless expressions, and image folders by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from formulaspark.plans.pipelines import process_semantic


def stream_semantics(spark: SparkSession, path: str, schema: str = "formula_id long, latex string") -> DataFrame:
    """Semantic records of new files of a folder; no state, so no watermark."""
    return process_semantic(spark.readStream.schema(schema).parquet(path))


def each_batch(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Runs ``work`` on every micro-batch and writes its result below ``out``, each batch as a partition
    ``batch`` of its own, once: a batch that runs again after a failure replaces what it left."""

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)

