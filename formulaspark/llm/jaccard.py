"""Operator 10: exact Jaccard self-join of word-shingle sets, size-aware.

Sets of words' shingles are compared by Jaccard similarity ``num / den`` or more.
Sets with equal content are one *class*; joins run between classes.

Light sets (at most ``boundary`` shingles) enumerate fixed-size subsets: two sets of
``s`` and ``m`` shingles are similar only if they share ``ceil(num (s + m) / (num +
den))`` of them, so both list their subsets of just that size and meet in one.
Heavy sets scan inverted lists: with all shingles in one global order, common ones
last, similar sets share a shingle among the first ``n - ceil(num n / den) + 1``.
The boundary is the size at which listing subsets starts to cost more rows than
reading lists, by the corpus' own sizes and list lengths.

Lists are never expanded to all pairs.  A pair leaves a list only if its sizes and the
places of the shingle in both sets allow the similarity, and if links found so far do not
connect it; then a sketch of 256 counts excludes most pairs that are unlike.  In the first round each member meets one pivot of its list: the set whose lists
are the longest in all, as the common original of many copies is, so that one comparison a
member links most of them.  Later rounds take 32 times as many pivots, at last all members,
and only compare members outside the part of a list that is connected already.  Each pair is
then compared in full.  Shingles and classes are 64-bit hashes.  The order of rounds, and
whether a small table of checked size is broadcast, change no result.

Defined results: a null text is empty; documents without shingles are alone; repeated
rows share a class; a null doc_id has a null component and takes part in no link;
an empty table gives no rows.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .codec import text_runs
from .common import arrow_rows, lean, read_table, stored, texts_of
from .graph import components
from .hashing import mixed, word_sets


@dataclass(frozen=True)
class JaccardConfig:
    width: int = 3
    num: int = 90
    den: int = 100
    counters: int = 1 << 20
    most_light: int = 24
    broadcast_rows: int = 500_000

    def least(self, n: int) -> int:
        """The fewest shingles of a set that can be similar to one of ``n``."""
        return -(-self.num * n // self.den)

    def shared(self, s: int, m: int) -> int:
        return -(-self.num * (s + m) // (self.num + self.den))

    def prefix(self, n: int) -> int:
        return n - self.least(n) + 1

    def classes(self, n: int) -> list[tuple[int, int]]:
        """(smaller, larger) sizes of the pairs that a set of ``n`` can be in."""
        larger = [(n, m) for m in range(n, self.den * n // self.num + 1)]
        return [(s, n) for s in range(self.least(n), n)] + larger

    def subsets(self, n: int) -> int:
        return sum(comb(n, self.shared(s, m)) for s, m in self.classes(n))


_SALT = np.uint64(0x9E3779B97F4A7C15)


def set_id(h: np.ndarray) -> int:
    return int(np.bitwise_xor.reduce(mixed(h + _SALT))) ^ int(h.sum(dtype=np.uint64)) * 3 & (1 << 64) - 1


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


_BINS = 256


def sketch(h: np.ndarray) -> bytes:
    return np.bincount((h >> np.uint64(7)).astype(np.int64) & (_BINS - 1), minlength=_BINS).astype(np.uint8).tobytes()


def sketch_gap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A lower bound of the size of the symmetric difference; counts are modulo 256."""
    d = a - b
    return np.minimum(d, 0 - d).astype(np.int64).sum(1)


def _statistics(docs: DataFrame, cfg: JaccardConfig) -> tuple[np.ndarray, dict[int, int]]:
    """Counters of shingles that are common, by hash, and how many sets have each small size.

    A task counts what occurs three times or more among about two million of its
    shingles; the counters only order shingles, so leaving rare ones out changes no result.
    """
    mask = np.uint64(cfg.counters - 1)

    def count(batches):
        total, sizes, held, n_held = np.zeros(cfg.counters, np.int64), np.zeros(cfg.most_light + 1, np.int64), [], 0

        def flush():
            found, times = np.unique(np.concatenate(held), return_counts=True)
            often = times >= 3
            np.add.at(total, (found[often] & mask).astype(np.int64), times[often])
            held.clear()

        for batch in batches:
            for _, texts in text_runs(batch.column("text")):
                for h in word_sets(texts, cfg.width):
                    if len(h) <= cfg.most_light:
                        sizes[len(h)] += 1
                    held.append(h)
                    n_held += len(h)
                    if n_held > 2_000_000:
                        flush()
                        n_held = 0
        if held:
            flush()
        at = np.flatnonzero(total)
        small = np.flatnonzero(sizes)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([at, -1 - small])), pa.array(np.concatenate([total[at], sizes[small]]))], ["slot", "n"])

    with arrow_rows(docs.sparkSession, 1000):
        sums = texts_of(docs).select("text").mapInArrow(lean(count), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    counters = np.zeros(cfg.counters, np.int64)
    common = sums[sums.slot >= 0]
    counters[common.slot.to_numpy()] = common.n.to_numpy()
    return counters, {-1 - int(s): int(n) for s, n in zip(sums.slot, sums.n, strict=True) if s < 0}


def light_boundary(cfg: JaccardConfig, sizes: dict[int, int], counters: np.ndarray) -> int:
    """The size up to which subsets cost less than lists.

    A set of ``n`` costs its number of subsets if light.  If heavy, each shingle of its
    prefix costs a row and a read of its list, whose expected length comes from the
    counters (a shingle that was not counted has a list of one).
    """
    slots = counters[counters > 0]
    length = 1 + float((slots.astype(float) ** 2).sum() / max(1.0, float(slots.sum()))) * len(slots) / len(counters)
    best, cost, found = 0, 0.0, 0.0
    for n in range(1, cfg.most_light + 1):
        cost += sizes.get(n, 0) * (cfg.subsets(n) - cfg.prefix(n) * (1 + length))
        if cost <= found:
            best, found = n, cost
    return best


def _subsets(h: np.ndarray, cfg: JaccardConfig, boundary: int) -> np.ndarray:
    """Hashes of the subsets of a light set, each with the size of the smaller set that it is for."""
    n, out = len(h), []
    if 0 < n <= boundary:
        whole = h.sum(dtype=np.uint64)
        for s, m in cfg.classes(n):
            if m > boundary or cfg.shared(s, m) == s == m:
                continue  # equal sets are one class already
            gone = n - cfg.shared(s, m)
            dropped = np.array([sum(int(x) for x in c) & (1 << 64) - 1 for c in combinations(h, gone)], np.uint64)
            out.append(mixed(whole - dropped + np.uint64(s * 1009 + m)))
    return np.unique(np.concatenate(out)) if out else h[:0]


def _prefix(h: np.ndarray, cfg: JaccardConfig, counters: np.ndarray, boundary: int) -> np.ndarray:
    """The shingles of a set that can meet a heavy one, in the global order."""
    n = len(h)
    if n < max(1, cfg.least(boundary + 1)):
        return h[:0]
    often = counters[(h & np.uint64(cfg.counters - 1)).astype(np.int64)]
    return h[np.argsort(often, kind="stable")[: cfg.prefix(n)]]


def _described(docs: DataFrame, cfg: JaccardConfig, counters: np.ndarray, boundary: int) -> DataFrame:
    """``doc_id, n, sid, light, keys, sketch``; of rows with one set a task gives the first its keys, of which
    the first ``light`` are subsets and the others the prefix in order."""
    shared = docs.sparkSession.sparkContext.broadcast(counters.astype(np.int32))

    def describe(batches):
        seen: set[int] = set()
        for batch in batches:
            for start, texts in text_runs(batch.column("text")):
                n, ids, light, keys, sketches = [], [], [], [], []
                for h in word_sets(texts, cfg.width):
                    sid = signed(set_id(h)) if len(h) else 0
                    few = _subsets(h, cfg, boundary) if sid not in seen else h[:0]
                    own = np.concatenate([few, _prefix(h, cfg, shared.value, boundary)]) if sid not in seen else few
                    if len(seen) >= 500_000:
                        seen.clear()
                    seen.add(sid)
                    n.append(len(h))
                    ids.append(sid)
                    light.append(len(few))
                    keys.append(own.view(np.int64))
                    sketches.append(sketch(h))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(start, len(texts)), pa.array(n, pa.int32()), pa.array(ids, pa.int64()), pa.array(light, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                    ["doc_id", "n", "sid", "light", "keys", "sketch"],
                )

    return stored(texts_of(docs).mapInArrow(lean(describe), "doc_id long, n int, sid long, light int, keys array<long>, sketch binary"), "jaccard-sets")


def _fits(n: F.Column, m: F.Column, rest: F.Column, cfg: JaccardConfig) -> F.Column:
    """Whether sets of ``n`` and ``m`` shingles that have ``rest`` at most in common may be similar."""
    return (F.least(n, m) * cfg.den >= F.greatest(n, m) * cfg.num) & (rest * (cfg.num + cfg.den) >= (n + m) * cfg.num)


def _lists(named: DataFrame, cfg: JaccardConfig) -> DataFrame:
    """``key, sid, n, pos, members, pop`` of lists that may hold a similar pair; ``pos`` is a shingle's place
    in its set's prefix (below 0 for subsets), ``members`` counts a list's rows before copies go, ``pop`` is
    the sum of the lengths of a set's lists."""
    keys = named.select("sid", "n", "light", F.posexplode("keys").alias("at", "key")).select("key", "sid", "n", (F.col("at") - F.col("light")).alias("pos"))
    rest = F.when(F.col("pos") < 0, F.col("n")).otherwise(F.col("n") - F.col("pos"))
    met = keys.groupBy("key").agg(
        F.count("*").alias("members"), F.min("sid").alias("low"), F.max("sid").alias("high"), F.min("n").alias("n0"), F.max("n").alias("n1"), F.min(rest).alias("rest")
    )
    # most lists are of two sets that share a shingle by chance: these are settled here
    met = met.where((F.col("low") != F.col("high")) & ((F.col("members") > 2) | _fits(F.col("n0"), F.col("n1"), F.col("rest"), cfg))).select("key", "members")
    lists = stored(keys.join(met, "key").distinct(), "jaccard-met")
    pop = lists.groupBy("sid").agg(F.sum("members").alias("pop"))
    return stored(lists.join(pop, "sid"), "jaccard-lists")


def _sets(docs: DataFrame, need: DataFrame, cfg: JaccardConfig) -> DataFrame:
    """``sid, body`` for the classes of ``need`` (``sid, doc``): the sorted hashes as bytes."""

    def rebuild(batches):
        for batch in batches:
            for start, texts in text_runs(batch.column("text")):
                sets = list(word_sets(texts, cfg.width))
                ids = [signed(set_id(h)) if len(h) else 0 for h in sets]
                wanted = batch.column("sid").slice(start, len(texts)).to_pylist()
                kept = [(i, h.tobytes()) for i, w, h in zip(ids, wanted, sets, strict=True) if i == w]
                if kept:
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in kept], pa.int64()), pa.array([b for _, b in kept], pa.binary())], ["sid", "body"])

    few = need.select(F.col("sid"), F.col("doc").alias("doc_id"))
    if few.count() <= cfg.broadcast_rows:  # two longs a row
        few = F.broadcast(few)
    return texts_of(docs).join(few, "doc_id").select("sid", "text").mapInArrow(lean(rebuild), "sid long, body binary").dropDuplicates(["sid"])


def _close(cfg: JaccardConfig):
    """Keeps pairs whose sketches allow the similarity."""

    def keep(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, _BINS) for c in ("sa", "sb"))
            sizes = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            # similar sets differ in at most (den - num) / (den + num) of their summed sizes
            ok = sketch_gap(a, b) * (cfg.den + cfg.num) <= (cfg.den - cfg.num) * sizes
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return keep


def _similar(cfg: JaccardConfig):
    def keep(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("xa"), batch.column("xb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(cfg.den * both >= cfg.num * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return keep


def _candidates(open_lists: DataFrame, pivots: int, cfg: JaccardConfig) -> DataFrame:
    """Pairs ``a, b`` of members and pivots of one list that may be similar: one pivot, the set with the
    longest lists, or about ``pivots`` chosen by hash, or all members if there are no more."""
    head = ["key", F.col("sid").alias("p"), F.col("n").alias("np"), F.col("pos").alias("pp"), F.col("label").alias("lp")]
    if pivots == 1:
        first = open_lists.groupBy("key").agg(F.max(F.struct("pop", "sid", "n", "pos", "label")).alias("hub"))
        chosen, outside = first.select("key", "hub.*").select(*head), open_lists
    else:
        share = F.pmod(F.xxhash64("sid", F.lit(pivots)), F.lit(1 << 20)) * F.col("members")
        # of two members in different components one at least is outside the list's main one
        chosen, outside = open_lists.where(share < F.lit(pivots << 20)).select(*head), open_lists.where("label <> main")
    # of two prefixes' first common shingle: no more than what follows in both can be common too
    rest = F.when(F.col("pos") < 0, F.least("n", "np")).otherwise(F.least(F.col("n") - F.col("pos"), F.col("np") - F.col("pp")))
    fits = (F.col("label") != F.col("lp")) & _fits(F.col("n"), F.col("np"), rest, cfg)
    return outside.join(chosen, "key").where(fits).select(F.least("p", "sid").alias("a"), F.greatest("p", "sid").alias("b")).distinct()


def _links(docs: DataFrame, lists: DataFrame, classes: DataFrame, cfg: JaccardConfig) -> DataFrame | None:
    """``node, label`` of the sets that links connect, None without any."""
    spark = docs.sparkSession
    links, labels, sets, pivots, rows = None, None, None, 1, lists.count()
    while rows:
        if pivots == 1:
            open_lists = lists.withColumn("label", F.col("sid"))  # all are open, and all members meet the pivot
            sums = lists.agg(F.max("members").alias("longest")).first()
        else:
            named = lists.withColumn("label", F.col("sid"))
            if labels is not None:
                named = lists.join(labels.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
            # a list is done when its members are connected, or when the last round compared all of them
            tested = 2 if pivots == 32 else pivots // 32
            each = named.where(F.col("members") > tested).groupBy("key", "label").agg(F.count("*").alias("own"))
            heads = each.groupBy("key").agg(F.count("*").alias("labels"), F.max(F.struct("own", "label")).alias("top")).where("labels > 1")
            open_lists = stored(named.join(heads.select("key", F.col("top.label").alias("main")), "key"), "jaccard-open")
            sums = open_lists.agg(F.max("members").alias("longest"), F.sum(F.when(F.col("label") != F.col("main"), F.col("members"))).alias("pairs")).first()
        if sums["longest"] is None:
            break
        if pivots > 1 and sums["pairs"] <= 8 * rows:
            pivots = max(pivots, sums["longest"])
        left, right = (classes.select(F.col("sid").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab")
        pairs = _candidates(open_lists, pivots, cfg).join(left, "a").join(right, "b")
        near = stored(pairs.mapInArrow(_close(cfg), "a long, b long"), "jaccard-near")
        if not near.isEmpty():
            asked = stored(near.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), "jaccard-asked")
            few = F.broadcast(asked) if asked.count() <= cfg.broadcast_rows else asked  # a long a row
            need = asked if sets is None else asked.join(sets.select("sid"), "sid", "left_anti")
            need = stored(classes.join(need, "sid", "left_semi").select("sid", "doc"), "jaccard-need")
            if not need.isEmpty():
                with arrow_rows(spark, 500):
                    more = stored(_sets(docs, need, cfg), "jaccard-bodies")
                sets = more if sets is None else sets.union(more)
            own = sets.join(few, "sid", "left_semi")
            bodies = near.join(own.select(F.col("sid").alias("a"), F.col("body").alias("xa")), "a").join(own.select(F.col("sid").alias("b"), F.col("body").alias("xb")), "b")
            with arrow_rows(spark, 64):
                found = stored(bodies.mapInArrow(_similar(cfg), "a long, b long"), "jaccard-links")
            if not found.isEmpty():
                links = found if links is None else links.union(found)
                labels = components(links)
        if pivots >= sums["longest"]:
            break
        pivots *= 32
    return labels


def similar_groups(docs: DataFrame, cfg: JaccardConfig = JaccardConfig()) -> DataFrame:
    """``doc_id, n_shingles, component_id``: the smallest doc_id that links reach."""
    counters, sizes = _statistics(docs, cfg)
    boundary = light_boundary(cfg, sizes, counters)
    described = _described(docs, cfg, counters, boundary)
    named = described.where("n > 0 and doc_id is not null")
    lists = _lists(named, cfg)
    classes = stored(named.groupBy("sid").agg(F.min("doc_id").alias("doc"), F.count("*").alias("docs"), F.min("n").alias("n"), F.min("sketch").alias("sketch")), "jaccard-classes")
    labels = _links(docs, lists, classes, cfg)
    least = classes.where("docs > 1").select("sid", F.col("doc").alias("least"))
    if labels is not None:
        linked = stored(labels.withColumnRenamed("node", "sid").join(classes.select("sid", "doc"), "sid"), "jaccard-linked")
        first = linked.groupBy("label").agg(F.min("doc").alias("least"))
        if first.count() <= cfg.broadcast_rows:  # two longs a row
            first = F.broadcast(first)
        alone = least.join(linked.select("sid"), "sid", "left_anti")
        least = linked.join(first, "label").select("sid", "least").union(alone)
    ids = described.select("doc_id", "n", "sid").join(least, "sid", "left")
    known = F.when((F.col("n") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.coalesce("least", "doc_id"))
    return ids.select("doc_id", F.col("n").cast("long").alias("n_shingles"), known.alias("component_id"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(read_table(spark, sf_dir, "documents"))
