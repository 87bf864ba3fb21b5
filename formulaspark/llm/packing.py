"""Operator 3: packing documents into sequences by bin completion.

Tasks tokenise documents and cut long ones into pieces.  Only the histogram of
piece lengths, at most ``capacity`` rows whatever the corpus, reaches the driver,
where branch and bound plans the bins: around the largest remaining length it
goes through all fillings that no other filling dominates, least waste first, searches
depth-first with backtracking, and cuts branches whose waste, or whose lower bound for
the rest, can no longer beat the incumbent.  The problem is NP-hard: the search ends at
``nodes`` nodes with the incumbent and a warning if that is not proven least by then.
A plan says how often each combination of lengths is used, so that it has at most about
as many rows as there are lengths.  Spark then gives each piece its place: pieces are numbered within
their length in salted groups (no length is handled by one task) and joined to the
plan's ranges.

Defined results: a null or empty text is the end id alone; null and repeated
doc_ids are pieces like others; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import warnings
import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .codec import encoder, text_runs
from .common import batched, read_table, stored, texts_of
from .records import public_tokenizer

_PIECES = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])


_PLAN = pa.schema([("length", pa.int64()), ("first", pa.int64()), ("past", pa.int64()), ("each", pa.int32()), ("sequence", pa.int64()), ("at", pa.int64())])


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    """One row per piece: the first takes what does not fill ``capacity``; ids as uint32 bytes, or null."""

    def cut(batches):
        coder, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids, rows = batch.column("doc_id").to_pylist(), batch.column("row").to_pylist()
            for at, texts in text_runs(batch.column("text")):
                for row, doc_id, raw in zip(rows[at:], ids[at:], coder.encode(texts), strict=False):
                    raw += end
                    n = len(raw) // 4
                    start, stop = 0, n % capacity or capacity
                    for piece in range(-(-n // capacity)):
                        own = raw[4 * start : 4 * stop]
                        yield row, doc_id, piece, start, stop - start, zlib.crc32(own), own if with_ids else None
                        start, stop = stop, stop + capacity

    kind = "row long, doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
    return texts_of(docs).withColumn("row", F.monotonically_increasing_id()).mapInArrow(lambda b: batched(cut(b), _PIECES), kind)


def _smear(bits: int, width: int) -> int:
    """``bits`` and their copies moved up by 1 to ``width``."""
    have = 0
    while have < width:
        step = min(have + 1, width - have)
        bits |= bits << step
        have += step
    return bits


def dominated(members: tuple[int, ...], waste: int, free: int) -> bool:
    """Whether one length among the bits of ``free`` can take the place of some members, or the
    waste, of a filling: a longer one of one member, or one as long or longer of several."""
    one, several = 0, 0
    for m in members:
        several |= several << m | one << m
        one |= 1 << m
    better = _smear(several, waste)
    if waste:
        better |= _smear((one | 1) << 1, waste - 1)
    return bool(better & free)


def candidates(counts: dict[int, int], room: int):
    """All fillings (waste, members, dominated) of ``room`` by lengths with ``counts`` left, least waste
    first; the first of all is never dominated.

    ``sums[k]`` has a bit for each sum that the first k lengths reach, so that the walk over
    the members of one sum never meets a dead end.
    """
    sizes, full = sorted(s for s, n in counts.items() if n > 0 and s <= room), (1 << room + 1) - 1
    sums = [1]
    for s in sizes:
        bits, left, step = sums[-1], min(counts[s], room // s), 1
        while left and bits != full:
            take = min(step, left)
            bits = (bits | bits << take * s) & full
            left -= take
            step *= 2
        sums.append(bits)
    free = 0
    for s in sizes:
        free |= 1 << s

    def members_of(total: int):
        stack = [(len(sizes), total, ())]
        while stack:
            k, left, members = stack.pop()
            if not left:
                yield members
                continue
            while not sums[k - 1] >> left & 1 and sizes[k - 1] > left:
                k -= 1
            s = sizes[k - 1]
            # the most of the largest length first
            for n in range(min(counts[s], left // s) + 1):
                if sums[k - 1] >> left - n * s & 1:
                    stack.append((k - 1, left - n * s, (*members, *[s] * n)))

    for waste in range(room + 1):
        if sums[-1] >> room - waste & 1:
            for members in members_of(room - waste):
                still = free
                for m in set(members):
                    if counts[m] == members.count(m):
                        still &= ~(1 << m)
                yield waste, members, dominated(members, waste, still)


def fillings(counts: dict[int, int], room: int):
    """The undominated ones (waste, members) of all fillings."""
    return ((waste, members) for waste, members, worse in candidates(counts, room) if not worse)


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """Lower bound: pieces over half a bin are alone with each other, and the smaller ones,
    from some length on, go into the room that these leave or into bins of their own."""
    sizes = sorted((s for s, n in counts.items() if n > 0), reverse=True)
    large = [s for s in sizes if 2 * s > capacity]
    alone = sum(counts[s] for s in large)
    best, small, room, at = max(alone, -(-sum(s * counts[s] for s in sizes) // capacity)), 0, 0, len(large)
    for s in sizes[len(large) :]:
        small += s * counts[s]
        # there is only room beside pieces of at most capacity - s
        while at and large[at - 1] <= capacity - s:
            at -= 1
            room += counts[large[at]] * (capacity - large[at])
        best = max(best, alone + max(0, -(-(small - room) // capacity)))
    return best


def descent(histogram: dict[int, int], capacity: int, turn: int) -> list[tuple[int, tuple[int, ...]]]:
    """A first plan: the bits of ``turn`` say where the first bins leave the least waste for the second or third filling."""
    counts, plan, depth = dict(histogram), [], 0
    while counts:
        large = max(counts)
        counts[large] -= 1
        wanted = (turn >> depth) % 3
        choices = list(islice((f for _, f, worse in islice(candidates(counts, capacity - large), 200 if wanted else 1) if not worse), wanted + 1))
        counts[large] += 1
        depth += 1
        members = (large, *choices[-1])
        times = min(counts[m] // members.count(m) for m in set(members))
        plan.append((times, members))
        for m in set(members):
            counts[m] -= times * members.count(m)
            if not counts[m]:
                del counts[m]
    return plan


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best fit decreasing; equal bins are kept as one with a count."""
    bins: dict[int, dict[tuple[int, ...], int]] = {}

    def take(room: int, members: tuple[int, ...], times: int, size: int, each: int) -> None:
        if times:
            own = bins.setdefault(room - size * each, {})
            more = members + (size,) * each
            own[more] = own.get(more, 0) + times

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        for room in sorted(r for r in bins if r >= size):
            for members, times in list(bins[room].items()):
                each = room // size
                full = min(times, left // each)
                rest = left - full * each if full < times else 0
                left -= full * each + rest
                bins[room].pop(members)
                take(room, members, full, size, each)
                take(room, members, int(rest > 0), size, rest)
                if times - full - (rest > 0):
                    bins[room][members] = times - full - (rest > 0)
                if not left:
                    break
            if not bins[room]:
                del bins[room]
            if not left:
                break
        each = capacity // size
        take(capacity, (), left // each, size, each)
        take(capacity, (), int(left % each > 0), size, left % each)
    return [(times, members) for own in bins.values() for members, times in own.items()]


def plan_bins(histogram: dict[int, int], capacity: int, nodes: int = 50_000) -> list[tuple[int, tuple[int, ...]]]:
    """(times, lengths) of the least number of bins: depth-first branch and bound that ends once
    the incumbent meets the lower bound, the tree is done, or after ``nodes`` nodes (with a warning).
    Best fit and a few descents with other first choices give the incumbent that the search starts from.  Dominated fillings that are passed over count as nodes."""
    counts = {s: n for s, n in histogram.items() if n > 0}
    total, least = sum(s * n for s, n in counts.items()), least_bins(counts, capacity)
    incumbent: list[tuple[int, tuple[int, ...]]] = []
    most = sum(counts.values()) + 1
    for turn in range(-1, 8):
        if most > least and (found := best_fit(counts, capacity) if turn < 0 else descent(counts, capacity, turn)) and (n := sum(t for t, _ in found)) < most:
            incumbent, most = found, n
    plan, bins, waste, seen = [], 0, 0, {}
    visited = 0

    def children():
        """(times, members, waste) around the largest length; fewer times after the most; None for a dominated
        filling.  Fillings come in lists that are made again where more are needed, so that a level of the
        search holds a few of them only."""
        done, size = 0, 8
        while True:
            large = max(counts)
            counts[large] -= 1
            part = list(islice(candidates(dict(counts), capacity - large), done, done + size))
            counts[large] += 1
            for gone, pick, worse in part:
                if waste + gone > (most - 1) * capacity - total:
                    return
                if worse:
                    yield None
                    continue
                members = (large, *pick)
                times = min(counts[s] // members.count(s) for s in set(members))
                while times:
                    yield times, members, gone
                    times //= 2
            if len(part) < size:
                return
            done, size = done + size, 4 * size

    def state() -> bytes:
        return hashlib.blake2b(np.array(sorted(counts.items()), np.int64).tobytes(), digest_size=16).digest()

    def put(times: int, members: tuple[int, ...]) -> None:
        for s in set(members):
            left = counts.get(s, 0) - times * members.count(s)
            if left:
                counts[s] = left
            else:
                counts.pop(s, None)

    stack = [children()] if counts else []
    while stack and most > least:
        step = next(stack[-1], ())
        if incumbent and visited >= nodes:
            warnings.warn(f"packing: {most} bins after {nodes} nodes, not proven least; lower bound {least}", stacklevel=2)
            break
        if step is None:
            visited += 1
            continue
        if not step:
            stack.pop()
            if plan:
                times, members, gone = plan.pop()
                put(-times, members)
                bins, waste = bins - times, waste - times * gone
            continue
        times, members, gone = step
        # waste of all bins that still beats the incumbent
        if waste + times * gone > (most - 1) * capacity - total:
            continue
        visited += bool(incumbent)
        put(times, members)
        plan.append(step)
        bins, waste = bins + times, waste + times * gone
        if not counts:
            incumbent, most = [(t, m) for t, m, _ in plan], bins
            stack.append(iter(()))
        elif incumbent and (bins + least_bins(counts, capacity) >= most or seen.get(key := state(), most) <= bins):
            stack.append(iter(()))
        else:
            if incumbent:
                seen[key] = bins
            stack.append(children())
    return incumbent


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = True, group: int = 200_000) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset`` per piece."""
    spark = docs.sparkSession
    pieces = stored(token_pieces(docs, tokenizer, capacity, end_id, with_ids), "packing-pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    ranges, sequence, taken = [], 0, dict.fromkeys(histogram, 0)
    for times, members in plan_bins(histogram, capacity):
        offset = 0
        for size in dict.fromkeys(members):
            each = members.count(size)
            ranges.append((size, taken[size], taken[size] + times * each, each, sequence, offset))
            taken[size] += times * each
            offset += size * each
        sequence += times
    columns = zip(*ranges, strict=True) if ranges else [[]] * len(_PLAN)
    plan = spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, _PLAN, strict=True)], schema=_PLAN))
    salts = max(8, sum(histogram.values()) // group)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("row", "piece"), F.lit(salts)))
    sums = salted.groupBy("length", "salt").count()
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "salt").orderBy("row", "piece")
    ranked = salted.withColumn("own", F.row_number().over(own) - 1).join(sums, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("own"))
    # the plan has at most a few rows per length, so its size is bounded by the capacity
    placed = ranked.join(F.broadcast(plan), "length").where("rank >= first and rank < past")
    return placed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        "ids",
        (F.col("sequence") + F.expr("(rank - first) div each")).alias("sequence_id"),
        (F.col("at") + F.expr("(rank - first) % each") * F.col("length")).cast("long").alias("offset"),
    )


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), public_tokenizer("byte_bpe_50k.json"), with_ids=False).drop("ids")
