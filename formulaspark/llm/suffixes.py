"""Operator 9: removal of repeated byte strings by a distributed, sampled suffix array.

A string of ``length`` bytes that starts at ``i`` is repeated if an equal one starts
earlier (in a smaller doc_id, or before it in the same document); every byte that a
repeated string covers goes.  Matches never cross documents and are judged on the input.

All starts of all strings are far too many suffixes to shuffle, so suffixes are sampled by
content: each string's *anchor* is the place of the smallest hash among the 32-byte grams
inside it.  Equal strings have their anchor at the same offset, so it is enough to bring
together suffixes that start at anchors, about one in 35 bytes, each of which stands for
the run of strings (its *context*) that chose it; contexts part all strings of a text.

0. A first pass samples suffixes for splitters, pairs of a suffix's leading eight bytes and
   the hash of its leading 32 (the *gram*), and counts the different contexts of each gram.  A
   gram with many (one inside a short line that many documents share) is *hot*.
1. Tasks cut texts into contexts.  Contexts of hot grams go on as single strings, each a context
   of its own with the hash of the whole string for its gram, so that they spread over buckets.
   Each task sorts its contexts by multikey quicksort, eight bytes at a time, where only ties go
   on to the next eight; what stays tied to the end is equal.  Of equal contexts the first goes
   on; all strings of the others are repeated.
2. The splitters deal suffixes to buckets; those whose gram occurs once go no further.
3. The others go to their buckets with their bytes.  A bucket again sorts contexts, and then the
   strings of grams that have different ones, by multikey quicksort, in runs of whole grams.  As
   the gram is part of the splitters, a bucket's last suffix and the next one's first differ in
   their leading 32 bytes: no equal strings lie across a boundary.
4. Documents are joined with what is repeated in them.

Grams only say what may be equal; equality is of all bytes.

Defined results: a null text is empty; texts shorter than ``length`` keep all bytes; rows
that share a doc_id, or have none, count as documents in the order of doc_id (nulls first)
and text; an empty table gives no rows.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batched, read_table, rows_of, stored, texts_of

GRAM = 32
_TABLE = np.random.default_rng(9).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]
_PLACE = 24  # low bits of a sliding minimum that hold the place


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the 32 bytes from each place on, by doubling."""
    h, width = _TABLE[data], 1
    for odd in _ODD:
        h = h[:-width] * odd + h[width:]
        h ^= h >> np.uint64(29)
        width *= 2
    return h


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    out, have = values, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if width > have else out


def contexts(data: np.ndarray, ends: np.ndarray, length: int):
    """``owner, low, anchor, n, gram`` of the texts that end at ``ends`` in ``data``.

    A context is the strings from ``low`` on, ``n`` in number; its bytes end at
    ``low + n - 1 + length``.  Places are in ``data``.
    """
    if len(data) < length:
        return (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),)
    h = gram_hashes(data)
    low_bits = np.uint64((1 << _PLACE) - 1)
    least = sliding_min((h & ~low_bits) | np.arange(len(h), dtype=np.uint64), length - GRAM + 1)
    begins = np.concatenate([[0], ends[:-1]])
    valid = np.maximum(ends - begins - length + 1, 0)
    owner = np.repeat(np.arange(len(ends)), valid)
    start = np.arange(valid.sum()) - np.repeat(np.cumsum(valid) - valid, valid) + np.repeat(begins, valid)
    anchor = (least[start] & low_bits).astype(np.int64)
    if not len(start):
        return (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),)
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])]))
    n = np.diff(np.append(first, len(start)))
    low, anchor, owner = start[first], anchor[first], owner[first]
    return owner, low, anchor, n, h[anchor]


def merged_runs(doc: np.ndarray, low: np.ndarray, n: np.ndarray):
    """Runs of string starts, joined where one follows or overlaps another, by document."""
    if not len(doc):
        return doc, low, n
    order = np.lexsort((low, doc))
    doc, low, past = doc[order], low[order], (low + n)[order]
    # ends only grow within a document: shift each document's places beyond those before
    lift = np.cumsum(np.concatenate([[0], np.where(doc[1:] != doc[:-1], past.max() + 2, 0)]))
    reach = np.maximum.accumulate(past + lift)
    first = np.flatnonzero(np.concatenate([[True], (low + lift)[1:] > reach[:-1]]))
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], low[first], (reach - lift)[last] - low[first]


_ROWS = ["bucket", "gram", "doc", "low", "off", "n", "done"]
_ROWS_KIND = "bucket int, gram long, doc long, low long, off int, n long, done boolean"
_RUN_KIND = "doc long, low long, n long"


def _batches(columns: list[np.ndarray], names, size: int = 50_000):
    for at in range(0, len(columns[0]), size):
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + size]) for c in columns], names)


def _rows_out(bucket, gram, doc, low, off, n):
    yield from _batches([bucket.astype(np.int32), gram, doc, low, off.astype(np.int32), n, np.zeros(len(gram), bool)], _ROWS)


def _runs_out(doc, low, n, tasks: int):
    """Finished runs in the same table, dealt by document."""
    zero = np.zeros(len(doc), np.int64)
    yield from _batches([(doc % tasks).astype(np.int32), zero, doc, low, zero.astype(np.int32), n, np.ones(len(doc), bool)], _ROWS)


def leads(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as numbers in the order of the bytes."""
    eights = np.ndarray(len(data) - 7, ">u8", data.tobytes(), strides=(1,))
    return (eights[at].astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


def bucket_of(splitters: np.ndarray, lead: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """How many of the sorted pairs of ``splitters`` are at most each (lead, gram)."""
    first, past = (np.searchsorted(splitters[:, 0], lead, side) for side in ("left", "right"))
    out = past.copy()
    for i in np.unique(first[first < past]).tolist():
        rows = np.flatnonzero((first == i) & (past > i))
        own = splitters[i : past[rows[0]], 1]
        out[rows] = i + np.searchsorted(own, gram[rows], "right")
    return out


def equal_strings(groups: np.ndarray, places: np.ndarray, sizes: np.ndarray, data: np.ndarray):
    """Classes of equal strings of ``sizes`` at ``places`` of ``data``, within each group: multikey
    quicksort by eight-byte characters, where only ties are sorted further.  Gives the
    indices of strings in classes of two or more, and their classes."""
    eights = np.ndarray(max(0, len(data) - 7), ">u8", data.tobytes(), strides=(1,))
    active, char = np.arange(len(places)), sizes.astype(np.uint64)
    cls, at = groups, -8
    while len(active):
        order = np.lexsort((char, cls))
        active, cls, char = active[order], cls[order], char[order]
        new = np.concatenate([[True], (cls[1:] != cls[:-1]) | (char[1:] != char[:-1])])
        cls = np.cumsum(new)
        tied = np.bincount(cls)[cls] > 1
        active, cls, at = active[tied], cls[tied], at + 8
        if not len(active) or at >= sizes[active].max():
            break
        char = eights[places[active] + np.minimum(at, sizes[active] - 8)].astype(np.uint64)
    return active, cls


def later_of_equal(found: np.ndarray, cls: np.ndarray, doc: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The indices ``found`` without the first, by ``doc`` and ``low``, of each class."""
    order = np.lexsort((low[found], doc[found], cls))
    return found[order[np.flatnonzero(cls[order][1:] == cls[order][:-1]) + 1]]


def _pieces(batches, length: int, chars: int):
    """Texts as lists of pieces (document, place of the piece in it, bytes) of about ``chars`` in all."""
    parts, size = [], 0
    for doc, text in rows_of(batches, "doc", "text"):
        raw = text.encode("utf-8", "surrogatepass")
        # a long text goes in pieces that overlap by one byte less than a string
        for at in range(0, max(1, len(raw) - length + 1), chars):
            piece = raw[at : at + chars + length - 1]
            parts.append((doc, at, piece))
            size += len(piece)
            if size >= chars:
                yield parts
                parts, size = [], 0
    if parts:
        yield parts


def _joined(parts):
    """Bytes of pieces in one array, and where each ends."""
    return np.frombuffer(b"".join(p[2] for p in parts), np.uint8), np.cumsum([len(p[2]) for p in parts])


def _count(length: int, size: int, hot_rows: int, keep: int, chars: int = 1_000_000, flush: int = 1_000_000):
    """``gram, lead, n``: different contexts by gram, and with ``n`` 0 a sample of suffixes.

    A part of the corpus leaves out grams with less than half of its share of ``hot_rows``; so
    of a gram with ``hot_rows`` half at least is counted.  Contexts count as different if their
    first or last eight bytes are.
    """

    def count(batches):
        held: list[tuple] = []
        seen = kept = 0

        def flushed():
            gram, mark, lead = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            # different contexts in the order of a hash
            own = np.unique((gram ^ (mark.view(np.uint64) * _ODD[1])) * _ODD[3], return_index=True)[1]
            grams, n = np.unique(gram[own], return_counts=True)
            many = n >= hot_rows * seen / size / 2
            yield from _batches([grams[many].view(np.int64), np.zeros(many.sum(), np.int64), n[many]], ["gram", "lead", "n"])
            some = own[: max(1, keep * seen // size)]
            yield from _batches([gram[some].view(np.int64), lead[some], np.zeros(len(some), np.int64)], ["gram", "lead", "n"])

        for parts in _pieces(batches, length, chars):
            data, ends = _joined(parts)
            _, low, anchor, n, gram = contexts(data, ends, length)
            if len(gram):
                held.append((gram, leads(data, low) * np.int64(31) + leads(data, low + n + length - 9) + n * 977, leads(data, anchor)))
            seen += len(data)
            kept += len(gram)
            if kept >= flush:
                yield from flushed()
                seen = kept = 0
        if held:
            yield from flushed()

    return count


def sampled(docs: DataFrame, length: int, size: int, hot_rows: int, tasks: int, each: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Hot grams, sorted: those with ``hot_rows`` different contexts or more, and perhaps some with
    fewer; and ``tasks - 1`` splitters from a sample of about ``each`` suffixes a bucket."""
    least = max(hot_rows, size // GRAM >> 18)  # at most about 2**19 grams are hot
    counts = stored(docs.select("doc", "text").mapInArrow(_count(length, max(size, 1), least, each * tasks), "gram long, lead long, n long"), "suffix-sample")
    found = counts.where("n > 0").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least / 2).select("gram")
    hot = np.sort(np.array([r["gram"] for r in found.collect()], np.int64))
    some = counts.where("n = 0").orderBy(F.xxhash64("gram", "lead")).limit(each * tasks).select("lead", "gram").collect()
    pairs = np.array(sorted((r["lead"], r["gram"]) for r in some), np.int64).reshape(-1, 2)
    return hot, pairs[[len(pairs) * i // tasks for i in range(1, tasks)]] if len(pairs) else pairs


def _cut(length: int, hot: np.ndarray, splitters: np.ndarray, tasks: int, chars: int = 1_000_000, flush: int = 1_000_000):
    def cut(batches):
        held: list[tuple] = []
        raw: list[np.ndarray] = []
        count = base = 0

        def flushed():
            nonlocal count, base
            if held:
                lead, gram, doc, low, off, n, place = (np.concatenate(c) for c in zip(*held, strict=True))
                found, cls = equal_strings(np.unique(gram, return_inverse=True)[1] * 256 + off, place, n - 1 + length, np.concatenate(raw))
                held.clear()
                raw.clear()
                count = base = 0
                again = np.zeros(len(gram), bool)
                again[later_of_equal(found, cls, doc, low)] = True
                own = ~again
                yield from _rows_out(bucket_of(splitters, lead[own], gram[own]), gram[own], doc[own], low[own], off[own], n[own])
                yield from _runs_out(*merged_runs(doc[again], low[again], n[again]), tasks)

        def add(parts: list[tuple[int, int, bytes]]):
            nonlocal count, base
            data, ends = _joined(parts)
            owner, low, anchor, n, gram = contexts(data, ends, length)
            gram, off = gram.view(np.int64), anchor - low
            many = np.isin(gram, hot)
            if many.any():
                each = n[many]
                at = np.repeat(low[many], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                bytes_ = data.tobytes()
                whole = np.array([xxhash.xxh3_64_intdigest(bytes_[i : i + length]) for i in at.tolist()], np.uint64).view(np.int64)
                owner = np.concatenate([owner[~many], np.repeat(owner[many], each)])
                low, gram = np.concatenate([low[~many], at]), np.concatenate([gram[~many], whole])
                off, n = np.concatenate([off[~many], np.zeros(len(at), np.int64)]), np.concatenate([n[~many], np.ones(len(at), np.int64)])
            if len(low):
                shift = np.array([p[1] for p in parts]) - np.concatenate([[0], ends[:-1]])
                held.append((leads(data, low + off), gram, np.array([p[0] for p in parts])[owner], low + shift[owner], off, n, low + base))
                raw.append(data)
                count, base = count + len(owner), base + len(data)

        for parts in _pieces(batches, length, chars):
            add(parts)
            if count >= flush:
                yield from flushed()
        yield from flushed()

    return cut


def _several(batches):
    """Rows, sorted by gram, whose gram the row before or after has too, and finished runs."""
    held, known = None, False  # the last row waits for the next batch
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        gram, done = batch.column("gram").to_numpy(), batch.column("done").to_numpy(zero_copy_only=False)
        same = (gram[1:] == gram[:-1]) & ~done[1:] & ~done[:-1]
        keep = np.concatenate([[known], same]) | np.concatenate([same, [False]]) | done
        yield batch.slice(0, len(gram) - 1).filter(pa.array(keep[:-1]))
        held, known = batch.slice(len(gram) - 1), bool(keep[-1])
    if held is not None and known:
        yield held


_SUFFIX = pa.schema([("bucket", pa.int32()), ("gram", pa.int64()), ("doc", pa.int64()), ("low", pa.int64()), ("off", pa.int32()), ("n", pa.int64()), ("bytes", pa.binary())])
_SUFFIX_KIND = "bucket int, gram long, doc long, low long, off int, n long, bytes binary"


def _extract(length: int):
    def extract(batches):
        for doc, text, wanted in rows_of(batches, "doc", "text", "wanted"):
            raw = text.encode("utf-8", "surrogatepass")
            for w in wanted:
                yield w["bucket"], w["gram"], doc, w["low"], w["off"], w["n"], raw[w["low"] : w["low"] + w["n"] - 1 + length]

    return extract


def _compare(length: int, strings: int = 300_000, most_rows: int = 50_000):
    """Repeated strings of a bucket's rows, sorted by gram and document, as runs."""

    def distinct(rows: list[tuple]):
        """Rows that are first of their context, and the runs of all others."""
        gram, doc, low, off, n = (np.array([r[k] for r in rows], np.int64) for k in range(5))
        sizes = n - 1 + length
        data = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
        found, cls = equal_strings(np.unique(gram, return_inverse=True)[1] * 256 + off, np.cumsum(sizes) - sizes, sizes, data)
        again = later_of_equal(found, cls, doc, low)
        own = np.ones(len(rows), bool)
        own[again] = False
        return [rows[i] for i in np.flatnonzero(own)], (doc[again], low[again], n[again])

    def repeated(rows: list[tuple]):
        gram, doc, low, _, n = (np.array([r[k] for r in rows], np.int64) for k in range(5))
        groups = np.unique(gram, return_inverse=True)[1]
        several = np.flatnonzero(np.bincount(groups)[groups] > 1)
        rows, groups, doc, low, n = [rows[i] for i in several], groups[several], doc[several], low[several], n[several]
        sizes = n - 1 + length
        row = np.repeat(np.arange(len(rows)), n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        data = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
        found, cls = equal_strings(groups[row], (np.cumsum(sizes) - sizes)[row] + step, np.full(len(row), length), data)
        doc, low = doc[row], low[row] + step
        again = later_of_equal(found, cls, doc, low)
        return doc[again], low[again], np.ones(len(again), np.int64)

    def compare(batches):
        held, count, limit = [], 0, most_rows

        def flushed(whole: bool):
            nonlocal held, count, limit
            held, runs = distinct(held)
            yield from _batches(list(merged_runs(*runs)), ["doc", "low", "n"])
            if whole:
                yield from _batches(list(merged_runs(*repeated(held))), ["doc", "low", "n"])
                held = []
            count, limit = sum(r[4] for r in held), max(most_rows, 2 * len(held))

        for row in rows_of(batches, "gram", "doc", "low", "off", "n", "bytes"):
            if count >= strings and row[0] != held[-1][0]:
                yield from flushed(whole=True)
            elif len(held) >= limit:  # one gram with many copies: only the first of each context stays
                yield from flushed(whole=False)
            held.append(row)
            count += row[4]
        if held:
            yield from flushed(whole=True)

    return compare


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _remove(length: int, with_text: bool):
    def remove(batches):
        for doc_id, text, runs in rows_of(batches, "doc_id", "text", "runs"):
            raw = text.encode("utf-8", "surrogatepass")
            spans: list[list[int]] = []
            for low, past in sorted((r["low"], r["low"] + r["n"] - 1 + length) for r in runs or ()):
                if spans and low <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], past)
                else:
                    spans.append([low, past])
            edges = [0, *(x for s in spans for x in s), len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            yield doc_id, len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept if with_text else None

    return remove


def numbered(docs: DataFrame) -> DataFrame:
    """``doc`` (order of documents), ``doc_id`` and ``text``; doc is doc_id where that is unique."""
    texts = texts_of(docs)
    odd = texts.groupBy("doc_id").count().where("count > 1 or doc_id is null")
    if odd.isEmpty():
        return texts.withColumn("doc", F.col("doc_id"))
    ordered = texts.orderBy(F.col("doc_id").asc_nulls_first(), "text")
    return stored(ordered.withColumn("doc", F.monotonically_increasing_id()), "suffix-numbered")


def remove_repeats(docs: DataFrame, length: int = 100, with_text: bool = True, task_bytes: int = 24_000_000, hot_rows: int = 4096, most_buckets: int = 65_536) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` of every row."""
    if not 2 * GRAM <= length <= 255:
        raise ValueError("length is from 64 to 255")
    docs = numbered(docs).where("doc is not null").select("doc", "doc_id", "text")  # no doc is null
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    tasks = min(max(8, -(-size // task_bytes)), most_buckets)
    hot, splitters = sampled(docs, length, size, hot_rows, tasks)
    cut = docs.select("doc", "text").mapInArrow(_cut(length, hot, splitters, tasks), _ROWS_KIND)
    rows = stored(cut.repartitionById(tasks, "bucket").sortWithinPartitions("done", "gram").mapInArrow(_several, _ROWS_KIND), "suffix-contexts")
    wanted = rows.where("not done").groupBy("doc").agg(F.collect_list(F.struct("bucket", "gram", "low", "off", "n")).alias("wanted"))
    # the same columns as in the last join, so that one exchange of the texts serves both
    suffixes = docs.join(wanted, "doc").mapInArrow(lambda b: batched(_extract(length)(b), _SUFFIX), _SUFFIX_KIND)
    compared = suffixes.repartitionById(tasks, "bucket").sortWithinPartitions("gram", "doc", "low").mapInArrow(_compare(length), _RUN_KIND)
    runs = rows.where("done").select("doc", "low", "n").union(compared)
    runs = runs.groupBy("doc").agg(F.collect_list(F.struct("low", "n")).alias("runs"))
    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return docs.join(runs, "doc", "left").mapInArrow(lambda b: batched(_remove(length, with_text)(b), _KEPT, 512), kind)


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"), with_text=False).drop("kept")
