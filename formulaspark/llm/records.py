"""Operator 7: token ids in length-delimited binary record files.

File format.  ``part-<bucket>.rec`` is a run of frames

    uint64 length | uint32 masked crc32 of the length | payload | uint32 masked crc32 of the payload

all little-endian; a masked checksum is the crc rotated right by 15 bits plus
0xA282EAD8, so that checksums stored inside records do not disturb checksums of
records.  A payload is ``uint8 flags | int64 doc_id | ids``, where flag 1 marks a
null doc_id and flag 2 says that ids take two bytes (vocabularies of at most
65,536 entries) instead of four.  ``part-<bucket>.idx`` holds one uint64 per frame,
its place in the record file, so that readers can fetch records in any order.

Buckets are ranges of doc_id and a hash of the text, with splitters that Spark samples, so
that rows without a doc_id, or with one that many share, spread too.  Each task sorts the
documents of its bucket, encodes them and writes their file under a temporary name that is
renamed at the end, so that a task which runs again after a loss replaces what it left.
Numbers of ids before a bucket come from the manifest, one row per file.

Defined results: a null or empty text is the end id alone; a null doc_id sorts
first; rows that share a doc_id keep one record each, ordered by a hash of the text; an
empty table writes no file and gives no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .codec import encoder, text_runs
from .common import batched, file_system, read_table, rows_of, shared_dir, stored, texts_of


def public_tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return size + struct.pack("<I", masked_crc(size)) + payload + struct.pack("<I", masked_crc(payload))


def read_frame(stream) -> bytes | None:
    """The next payload of an open file, None at its end; a wrong checksum is an error."""
    head = stream.read(12)
    if not head:
        return None
    if len(head) < 12 or masked_crc(head[:8]) != struct.unpack("<I", head[8:])[0]:
        raise ValueError("damaged record length")
    (size,) = struct.unpack("<Q", head[:8])
    body = stream.read(size + 4)
    if len(body) < size + 4 or masked_crc(body[:size]) != struct.unpack("<I", body[size:])[0]:
        raise ValueError("damaged record")
    return bytes(body[:size])


@dataclass(frozen=True)
class Record:
    doc_id: int | None
    ids: np.ndarray  # uint32

    def payload(self, short: bool) -> bytes:
        flags = (self.doc_id is None) + 2 * short
        return struct.pack("<Bq", flags, self.doc_id or 0) + self.ids.astype("<u2" if short else "<u4").tobytes()

    @staticmethod
    def parse(payload: bytes) -> Record:
        flags, doc_id = struct.unpack_from("<Bq", payload)
        return Record(None if flags & 1 else doc_id, np.frombuffer(payload, "<u2" if flags & 2 else "<u4", offset=9).astype("<u4"))


_MANIFEST = pa.schema([("bucket", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, bucket_chars: int = 32_000_000) -> DataFrame:
    """Writes the files below ``path``; the manifest: ``bucket, path, n_docs, n_ids, base``."""
    texts = texts_of(docs).withColumn("h", F.xxhash64("text"))
    buckets = max(1, -(-(texts.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0) // bucket_chars))

    def write(batches):
        coder, end = encoder(tokenizer, 600_000), np.array([end_id], "<u4").tobytes()
        short = len(coder.four) <= 65_536
        bucket, store, data, n_docs, n_ids, place = TaskContext.get().partitionId(), None, None, 0, 0, 0
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for start, run in text_runs(batch.column("text")):
                for doc_id, raw in zip(doc_ids[start:], coder.encode(run), strict=False):
                    if data is None:
                        store, root = file_system(path)
                        store.create_dir(root, recursive=True)
                        name, temp = f"{root}/part-{bucket:08d}", f"{root}/.{bucket:08d}-{uuid.uuid4().hex}"
                        data, index = store.open_output_stream(f"{temp}.rec"), store.open_output_stream(f"{temp}.idx")
                    ids = np.frombuffer(raw + end, "<u4")
                    framed = frame(Record(doc_id, ids).payload(short))
                    index.write(struct.pack("<Q", place))
                    data.write(framed)
                    n_docs, n_ids, place = n_docs + 1, n_ids + len(ids), place + len(framed)
        if data is not None:
            data.close()
            index.close()
            for kind in ("rec", "idx"):
                store.move(f"{temp}.{kind}", f"{name}.{kind}")
            yield bucket, f"{path}/part-{bucket:08d}", n_docs, n_ids

    order = [F.col("doc_id").asc_nulls_first(), F.col("h")]
    rows = texts.repartitionByRange(buckets, *order).sortWithinPartitions(*order).select("doc_id", "text")
    manifest = stored(rows.mapInArrow(lambda b: batched(write(b), _MANIFEST), "bucket long, path string, n_docs long, n_ids long"), "records-manifest")
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("ids_crc32", pa.int64())])


def read_records(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids, ids_crc32`` of every record; ids as uint32 bytes, or null."""

    def read(batches):
        for path, base in rows_of(batches, "path", "base"):
            store, name = file_system(path)
            with store.open_input_stream(f"{name}.rec") as stream:
                while (payload := read_frame(stream)) is not None:
                    record = Record.parse(payload)
                    raw = record.ids.tobytes()
                    yield record.doc_id, base, len(record.ids), raw if with_ids else None, zlib.crc32(raw)
                    base += len(record.ids)

    kind = "doc_id long, start long, n_tokens long, ids binary, ids_crc32 long"
    files = max(1, manifest.count())
    return manifest.select("path", "base").repartition(files).mapInArrow(lambda b: batched(read(b), _READ, 512), kind)


def read_shuffled(path: str, seed: int):
    """The records of one file in an order that ``seed`` fixes, by the offset index."""
    store, name = file_system(path)
    with store.open_input_stream(f"{name}.idx") as stream:
        offsets = np.frombuffer(stream.read(), "<u8")
    with store.open_input_file(f"{name}.rec") as file:
        for at in np.random.default_rng(seed).permutation(offsets):
            file.seek(int(at))
            yield Record.parse(read_frame(file))


def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    manifest = write_records(docs, shared_dir(spark, "token-records"), public_tokenizer("word_bpe_49k.json"))
    return read_records(manifest, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")
