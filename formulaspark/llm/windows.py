"""Operator 12: removal of repeated word windows behind a count-min prefilter.

A window is ``width`` consecutive words of one document; it is repeated if an equal one starts in a
document with a smaller doc_id, and every word that a repeated window covers goes.  Windows
are judged on the input.

Texts are stored once as *blocks* of whole documents, words parted by one blank each.  A task reads a
block in each of three passes, so nothing but sketches and digests is shuffled:

1. *Sketch.*  Each block is a count-min sketch of ``depth`` rows: the cells that its windows
   hit, sorted, as gaps in variable bytes with a bit for cells hit more than once (about two bytes
   a window and row).  Rows are cut into shards by the window's hash, so that a merged sketch
   grows with the corpus (``cells_per_window`` cells for each window) while a task holds one row of one
   shard.  A task adds up the counts of all blocks there and answers each block with one bit
   per cell: whether two windows or more fell into it.  Counts only overestimate: a window
   with a twin has its bit in every row, so none is lost.
2. *Exact.*  Windows whose bits are set in every row are estimated repeated.  A block sends
   their 128-bit digests, each once with its smallest doc_id, to shards by digest; the answer is
   one bit: whether another block has the window in a smaller document.
3. *Removal.*  A block knows from these bits and its own documents which windows are repeated.

What a shard gets of one window is at most one entry a block, however often documents repeat it.
Answers are written by block to the shared folder, where the block's task reads them; a
task that is run again reads the same stored block and the same answers.

Defined results: a null or empty text has no words; documents with fewer words than ``width`` keep
all; a null doc_id counts as smaller than all others; rows that share a doc_id do not repeat each
other, and each has its row; an empty table gives no rows.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, batched, file_system, lean, read_table, shared_dir, stored, texts_of
from .hashing import mixed, span_hashes, spans, window_hashes

_NULL = np.iinfo(np.int64).min
_SALTS = np.random.default_rng(12).integers(1, 1 << 63, 16, dtype=np.uint64)
_32 = np.uint64(32)


@dataclass(frozen=True)
class WindowConfig:
    width: int = 13
    depth: int = 2
    cells_per_window: int = 8
    shard_windows: int = 1 << 22
    block_bytes: int = 8 << 20


@dataclass(frozen=True)
class Sketch:
    """``depth`` rows of ``shards`` x ``cells`` counters."""

    shards: int
    cells: int
    depth: int

    @staticmethod
    def of(windows: int, cfg: WindowConfig) -> Sketch:
        shards = max(1, -(-windows // cfg.shard_windows))
        least = max(1, -(-windows * cfg.cells_per_window // shards))
        return Sketch(shards, 1 << (least - 1).bit_length(), cfg.depth)

    def cells_of(self, hashes: np.ndarray, row: int) -> np.ndarray:
        """Places of windows in a row; those of a shard follow each other."""
        shard = ((hashes >> _32) * np.uint64(self.shards)) >> _32
        cell = mixed(hashes ^ _SALTS[row]) & np.uint64(self.cells - 1)
        return (shard * np.uint64(self.cells) + cell).view(np.int64)


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 on in variable bytes, seven bits each, and where each number ends."""
    size = np.ones(len(values), np.int64)
    for bits in range(7, 63, 7):
        size += values >= 1 << bits
    ends = np.cumsum(size)
    out = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
    for k in range(size.max(initial=0)):
        own = size > k
        out[(ends - size)[own] + k] = (values[own] >> 7 * k & 127) | (size[own] > k + 1) << 7
    return out, ends


def unpacked(data: bytes) -> np.ndarray:
    codes = np.frombuffer(data, np.uint8)
    if not len(codes):
        return np.empty(0, np.int64)
    ends = np.flatnonzero(codes < 128) + 1
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    step = np.arange(len(codes)) - np.repeat(starts, ends - starts)
    return np.add.reduceat((codes & 127).astype(np.int64) << 7 * step, starts)


class Block:
    """The windows of a stored block."""

    def __init__(self, block: int, doc_ids: list[int | None], words: bytes, width: int):
        self.block, self.doc_ids, self.words, self.width = block, doc_ids, words, width
        self.keys = np.array([_NULL if i is None else i for i in doc_ids], np.int64)
        data = b" " + words + b" " * 9
        self.starts, self.sizes = spans(data)
        ends = 1 + np.flatnonzero(np.frombuffer(words, np.uint8) == 10)
        self.doc = np.searchsorted(ends, self.starts)
        h = window_hashes(span_hashes(data, self.starts, self.sizes), width)
        self.at = np.flatnonzero(self.doc[: len(h)] == self.doc[len(self.doc) - len(h) :]) if len(h) else np.empty(0, np.int64)
        self.hashes = h[self.at]

    def digests(self, at: np.ndarray) -> np.ndarray:
        """128-bit digests of the windows that start at the words ``at``."""
        words, digest, last = self.words, xxhash.xxh3_128_digest, at + self.width - 1
        begins, ends = self.starts[at] - 1, self.starts[last] + self.sizes[last] - 1
        return np.frombuffer(b"".join([digest(words[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]), ">u8").astype(np.uint64).reshape(-1, 2)

    def repeated_in(self, sketch: Sketch, answers: dict) -> np.ndarray:
        """Starts of the windows that the merged sketch estimates repeated."""
        may = np.ones(len(self.at), bool)
        for row in range(sketch.depth):
            code = sketch.cells_of(self.hashes, row)
            own, inverse = np.unique(code, return_inverse=True)
            bits = answers[row]
            if len(bits) != len(own):
                raise ValueError("answers of another sketch")
            may &= bits[inverse]
        return self.at[may]

    def exact_keys(self, sketch: Sketch, answers: dict):
        """Starts of windows that may repeat, the row of each among the different digests, these, and their least doc_ids."""
        at = self.repeated_in(sketch, answers)
        digests, doc = self.digests(at), self.keys[self.doc[at]]
        order = np.lexsort((doc, digests[:, 1], digests[:, 0]))
        sorted_ = digests[order]
        new = np.ones(len(at), bool)
        new[1:] = (sorted_[1:] != sorted_[:-1]).any(1)
        row = np.empty(len(at), np.int64)
        row[order] = np.cumsum(new) - 1
        return at, row, sorted_[new], doc[order][new]


_BLOCK = pa.schema([("block", pa.int64()), ("windows", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("words", pa.binary())])


def blocks_of(cfg: WindowConfig):
    """Blocks of whole documents of about ``block_bytes``, words parted by one blank."""

    def run(batches):
        part, n = TaskContext.get().partitionId(), 0
        doc_ids, texts, size, windows = [], [], 0, 0
        for batch in batches:
            raws = batch.column("text").cast(pa.binary())
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), raws, strict=True):
                words = raw.as_py().split()
                texts.append(b" ".join(words))
                doc_ids.append(doc_id)
                size, windows = size + len(texts[-1]) + 1, windows + max(0, len(words) - cfg.width + 1)
                if size >= cfg.block_bytes:
                    yield (part << 33) + n, windows, doc_ids, b"\n".join(texts)
                    doc_ids, texts, size, windows, n = [], [], 0, 0, n + 1
        if doc_ids:
            yield (part << 33) + n, windows, doc_ids, b"\n".join(texts)

    return lean(lambda batches: batched(run(batches), _BLOCK, 1))


def opened(batches, width: int):
    for batch in batches:
        for i in range(batch.num_rows):
            block, doc_ids, words = (batch.column(c)[i].as_py() for c in ("block", "doc_ids", "words"))
            yield Block(block, doc_ids, words, width)


_MESSAGE = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("docs", pa.binary())])
_ANSWER = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("n", pa.int64()), ("bits", pa.binary())])
_MESSAGE_KIND, _ANSWER_KIND = "part int, block long, keys binary, docs binary", "block long, part int, n long, bits binary"


def sketched(cfg: WindowConfig, sketch: Sketch):
    """A block's own sketch: for each row and shard the gaps between the cells that it hits."""

    def run(batches):
        for block in opened(batches, cfg.width):
            for row in range(sketch.depth if len(block.at) else 0):
                code = np.sort(sketch.cells_of(block.hashes, row))
                first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
                many, code = np.diff(np.append(first, len(code))) > 1, code[first]
                shard, cell = code // sketch.cells, code % sketch.cells
                edges = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
                gap = np.diff(cell, prepend=0)
                gap[edges] = cell[edges]
                data, ends = packed(gap * 2 + many)
                ends = np.concatenate([[0], ends])
                for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(code)], strict=True):
                    yield int(shard[a]) * sketch.depth + row, block.block, data[ends[a] : ends[b]].tobytes(), None

    return lean(lambda batches: batched(run(batches), _MESSAGE, 64))


def merged(sketch: Sketch):
    """All blocks' counts of a row of a shard, and whether each block's cells have two or more."""

    def run(batches):
        held = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("part", "block", "keys")), strict=True)]
        if not held:
            return
        counts = np.zeros(sketch.cells, np.uint8)

        def cells(keys: bytes):
            values = unpacked(keys)
            return np.cumsum(values >> 1), values & 1

        for _, _, keys in held:
            cell, many = cells(keys)
            counts[cell] = np.minimum(counts[cell] + 1 + many.astype(np.uint8), 2)
        for part, block, keys in held:
            bits = counts[cells(keys)[0]] > 1
            yield block, part, len(bits), np.packbits(bits).tobytes()

    return lean(lambda batches: batched(run(batches), _ANSWER, 64))


def suspected(cfg: WindowConfig, sketch: Sketch, folder: str, parts: int):
    """Digests of the windows of a block that are estimated repeated, with their least doc_ids."""

    def run(batches):
        for block in opened(batches, cfg.width):
            _, _, digests, docs = block.exact_keys(sketch, sketch_answers(folder, block, sketch))
            part = ((digests[:, 0] >> _32) * np.uint64(parts)) >> _32
            edges = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
            for k in np.flatnonzero(np.diff(edges)).tolist():
                a, b = edges[k], edges[k + 1]
                yield k, block.block, digests[a:b].tobytes(), docs[a:b].tobytes()

    return lean(lambda batches: batched(run(batches), _MESSAGE, 64))


def compared(batches):
    """Whether a smaller document of any block has the window, for each window that a block sent."""

    def run(batches):
        held = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("part", "block", "keys", "docs")), strict=True)]
        if not held:
            return
        docs = np.frombuffer(b"".join(r[3] for r in held), np.int64)
        high, low = np.frombuffer(b"".join(r[2] for r in held), np.uint64).reshape(-1, 2).T
        order = np.lexsort((docs, low, high))
        high, low, sorted_ = high[order], low[order], docs[order]
        new = np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])])
        least = sorted_[new][np.cumsum(new) - 1]
        earlier = np.empty(len(docs), bool)
        earlier[order] = least < sorted_
        at = 0
        for part, block, _, own in held:
            n = len(own) // 8
            yield block, part, n, np.packbits(earlier[at : at + n]).tobytes()
            at += n

    return batched(run(batches), _ANSWER, 64)


def answered(messages: DataFrame, parts: int, answer, label: str) -> str:
    """The folder of the answers to ``messages``, by block; part k of these is dealt to task k."""
    spark = messages.sparkSession
    path = shared_dir(spark, label)
    answers = messages.repartitionById(parts, "part").mapInArrow(answer, _ANSWER_KIND)
    with arrow_rows(spark, 64):
        answers.repartition("block").write.partitionBy("block").parquet(path)
    return path


def answers_of(folder: str, block: Block):
    """``part, n, bits`` of a block's answers, by part."""
    store, root = file_system(f"{folder}/block={block.block}")
    table = pq.read_table(root, filesystem=store, columns=["part", "n", "bits"], partitioning=None)
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("part", "n", "bits")), strict=True))
    return [(part, np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)) for part, n, bits in rows]


def sketch_answers(folder: str, block: Block, sketch: Sketch) -> dict[int, np.ndarray]:
    found = answers_of(folder, block) if len(block.at) else []
    return {row: np.concatenate([np.empty(0, bool), *(bits for part, bits in found if part % sketch.depth == row)]) for row in range(sketch.depth)}


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])
_KEPT_KIND = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def removed(cfg: WindowConfig, sketch: Sketch, sketches: str, exact: str, with_text: bool):
    """The words of a block's documents that no repeated window covers."""

    def run(batches):
        for block in opened(batches, cfg.width):
            at, row, digests, docs = block.exact_keys(sketch, sketch_answers(sketches, block, sketch))
            earlier = np.concatenate([bits for _, bits in answers_of(exact, block)]) if len(digests) else np.empty(0, bool)
            again = at[earlier[row] | (block.keys[block.doc[at]] > docs[row])]
            covers = np.zeros(len(block.starts) + 1, np.int64)
            np.add.at(covers, again, 1)
            np.add.at(covers, again + cfg.width, -1)
            own = np.cumsum(covers)[:-1] == 0
            past = np.cumsum(np.bincount(block.doc, minlength=len(block.doc_ids)))
            start = 0
            for doc_id, words, end in zip(block.doc_ids, block.words.split(b"\n"), past.tolist(), strict=True):
                n, kept = int(np.count_nonzero(own[start:end])), words
                if n < end - start:
                    kept = b" ".join(compress(words.split(b" "), own[start:end].tolist()))
                yield doc_id, end - start, end - start - n, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass") if with_text else None
                start = end

    return lean(lambda batches: batched(run(batches), _KEPT, 512))


def remove_windows(docs: DataFrame, cfg: WindowConfig = WindowConfig(), with_text: bool = True) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept`` of every row."""
    # pages and row groups of few rows, as a row is a whole block
    small = {"compression": "zstd", "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1, "parquet.block.size": 2 * cfg.block_bytes}
    kind = "block long, windows long, doc_ids array<long>, words binary"
    blocks = stored(texts_of(docs).mapInArrow(blocks_of(cfg), kind), "window-blocks", **small)
    sketch = Sketch.of(blocks.agg(F.sum("windows").alias("n")).first()["n"] or 0, cfg)
    blocks = blocks.drop("windows")
    sketches = answered(blocks.mapInArrow(sketched(cfg, sketch), _MESSAGE_KIND), sketch.shards * sketch.depth, merged(sketch), "window-sketches")
    parts = 2 * sketch.shards
    exact = answered(blocks.mapInArrow(suspected(cfg, sketch, sketches, parts), _MESSAGE_KIND), parts, lean(compared), "window-digests")
    return stored(blocks.mapInArrow(removed(cfg, sketch, sketches, exact, with_text), _KEPT_KIND), "window-removed")


def op12_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_windows(read_table(spark, sf_dir, "documents"), with_text=False).drop("kept")


SQL = r"""
with docs as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
starts as (select r, doc_id, unnest(range(1, len(words) - 11)) as i, words from docs where len(words) >= 13),
wins as materialized (select r, doc_id, i, array_to_string(words[i:i + 12], ' ') as w from starts),
least as (select w, min(doc_id) as least from wins group by w),
hit as (select r, i from wins join least using (w) where least < doc_id),
gone as (select distinct r, unnest(range(i, i + 13)) as p from hit),
each_word as (select r, unnest(range(1, len(words) + 1)) as p, unnest(words) as word from docs),
kept as (select r, string_agg(word, ' ' order by p) as t, count(*) as n from each_word anti join gone using (r, p) group by r)
select doc_id, cast(len(words) as bigint) as n_words, cast(len(words) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from docs left join kept using (r)
"""
