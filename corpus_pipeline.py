"""From raw documents to packed training sequences, in stages.

Rows are told apart by a number of our own, ``ROW``, that the first stage adds to the columns of
documents whatever these are, so that documents without a doc_id, or with one that others have
too, are judged each by itself.  No other column of documents, of any name, is taken for it.
Up to ``BROADCAST_IDS`` ids are broadcast and more are shuffled; the result is the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formulaspark.llm.common import read_table, stored
from formulaspark.llm.decontaminate import find_leaks
from formulaspark.llm.jaccard import JaccardConfig, similar_groups
from formulaspark.llm.packing import pack
from formulaspark.llm.quality import score_quality
from formulaspark.llm.records import public_tokenizer
from formulaspark.llm.secrets import redact

#: Up to so many ids (eight bytes each) go to every task; more are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: The column by which rows are told apart between the stages.
ROW = "__corpus_pipeline_row"


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``ROW`` after its own columns: the doc_id where each row has its own, else the
    stored place in the order of doc_id (nulls last) and the other columns."""
    docs = docs.drop(ROW)
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        return docs.withColumn(ROW, F.col("doc_id").cast("long"))
    plain = [c for c, kind in docs.dtypes if c != "doc_id" and "map" not in kind and "variant" not in kind]
    ordered = docs.orderBy(F.col("doc_id").asc_nulls_last(), *(F.col(f"`{c}`") for c in plain))
    return stored(ordered.withColumn(ROW, F.monotonically_increasing_id()), "pipeline-rows")


def told_apart(docs: DataFrame) -> DataFrame:
    """``docs`` of the first stage as they are; a stage that is called by itself numbers its rows."""
    return docs if ROW in docs.columns else numbered(docs)


def by_row(docs: DataFrame) -> DataFrame:
    """Rows as documents of their own, for operators that know a document by its doc_id."""
    return docs.select(F.col(ROW).alias("doc_id"), "text")


def without(docs: DataFrame, ids: DataFrame, label: str) -> DataFrame:
    """``docs`` but for those whose ``ROW`` is in ``ids``."""
    ids = stored(ids.select(ROW).distinct(), label)
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, ROW, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; the others stay as they are."""
    docs = numbered(docs)
    scored = score_quality(docs, read_table(spark, sf_dir, "labels"), ids=(ROW, "doc_id"))
    return without(docs, scored.where("predicted = 0"), "pipeline-rejected")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard 0.8 or more)
    stays, that with the smallest number (so the smallest doc_id); of rows with equal doc_id
    and text, even a text without words, that with the smallest number."""
    docs = told_apart(docs)
    groups = similar_groups(by_row(docs), JaccardConfig(width=5, num=80, den=100))
    kept = without(docs, groups.where("doc_id <> component_id").select(F.col("doc_id").alias(ROW)), "pipeline-copies")
    repeated = docs.groupBy("doc_id").count().where("count > 1")
    if repeated.isEmpty():
        return kept
    return kept.join(docs.groupBy("doc_id", "text").agg(F.min(ROW).alias(ROW)).select(ROW), ROW, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; the others stay as they are."""
    docs = told_apart(docs)
    leaks = find_leaks(by_row(docs), read_table(spark, sf_dir, "benchmark"))
    return without(docs, leaks.select(F.col("doc_id").alias(ROW)), "pipeline-leaks")


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts become a mark, and n_chars, if there is one, follows."""
    clean = redact(told_apart(docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most 2048 tokens."""
    return pack(docs, public_tokenizer("byte_bpe_50k.json"), with_ids=False).drop("ids")


STAGES = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("leaks", drop_leaks),
    ("secrets", hide_secrets),
    ("packing", pack_sequences),
]

#: SQL cannot state the stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
