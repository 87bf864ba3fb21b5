"""Operator 8: nearest neighbours by vantage-point trees, one per shard.

Vectors are scaled to unit length, where Euclidean distance orders pairs as cosine does
and obeys the triangle inequality.  Rows go to the nearest of a few *centres* (rows themselves,
one for about ``shard_rows`` rows, ``most_centres`` at most), and the rows of a centre are dealt
to shards of about ``shard_rows`` by a hash of the row.  A task holds one shard at a time: it
builds the shard's tree once and streams the queries that are routed there past it.  Routing
has two passes.  In the first a query visits one shard of its own centre, which gives it a
radius; in the second it visits every other shard whose ball (centre, greatest distance of a
row) may hold vectors within the radius: ``(distance to the centre - ball) * factor <= radius``.
So a row is shuffled twice and a query once for each shard that it cannot exclude.

A node of a tree parts its vectors at the median distance ``mu`` from a vantage point.  Queries
first go straight down to the leaf that they fall into, which gives a first radius; then the
tree is walked with whole sets of queries at once, and a query enters a side only if it may
hold vectors within the radius: ``|d - mu| * factor <= radius``.  Factor 1 is exact search;
larger factors prune more and may miss neighbours.  Recall of the default factor is measured
against brute force in the tests.

Scores are cosines of the original vectors in double precision.  Vectors that are null,
zero, or hold null or non-finite components take no part, neither as query nor as
candidate; vectors of another length than the query's do not match it.  Rows that share
a vec_id are candidates each, but not of a query with that id.  Empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, stored


@dataclass(frozen=True)
class TreeConfig:
    k: int = 5
    factor: float = 2.0
    leaf: int = 128
    shard_rows: int = 16_384
    most_centres: int = 1_024
    seed: int = 3


class VantageTree:
    """Nodes as ``(vantage row, mu, inner, outer)`` and leaves as arrays of rows."""

    def __init__(self, unit: np.ndarray, leaf: int, seed: int):
        self.unit, self.leaf = unit, leaf
        self.rng = np.random.default_rng(seed)
        self.root = self._grow(np.arange(len(unit)))

    def _grow(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        # of a few rows, that from which distances to a sample spread most
        tries, sample = self.rng.choice(rows, 8), self.rng.choice(rows, 64)
        vantage = tries[distances(self.unit[tries], self.unit[sample]).std(1).argmax()]
        d = distances(self.unit[vantage][None], self.unit[rows])[0]
        mu = float(np.median(d))
        inner, outer = rows[d <= mu], rows[d > mu]
        if not len(outer):  # at least half lie at the greatest distance: part them from the rest
            inner, outer = rows[d < mu], rows[d >= mu]
            if not len(inner):
                return rows  # all at one distance, as copies are
            mu = float(d[d < mu].max())
        return vantage, mu, self._grow(inner), self._grow(outer)

    def search(self, queries: np.ndarray, skip: np.ndarray, ids: np.ndarray, k: int, factor: float, within: np.ndarray) -> list[np.ndarray]:
        """Rows that hold each query's ``k`` nearest (ties at the radius all stay) at distances up to
        ``within``; ``skip``: ids left out."""
        self.q, self.skip, self.ids, self.k, self.factor = queries, skip, ids, k, factor
        self.best = np.full((len(queries), k), np.inf)
        self.found: list[list[np.ndarray]] = [[] for _ in queries]
        everyone = np.arange(len(queries))
        self._descend(self.root, everyone)
        self.radius = np.minimum(self.best[:, -1], within)
        self.best[:] = np.inf  # the walk meets those leaves again
        self._walk(self.root, everyone)
        return [np.unique(np.concatenate(f)) if f else np.empty(0, np.int64) for f in self.found]

    def _leaf(self, rows: np.ndarray, who: np.ndarray, keep: bool) -> None:
        for at in range(0, len(rows), 4096):
            part = rows[at : at + 4096]
            d = distances(self.q[who], self.unit[part])
            d[self.ids[part][None] == self.skip[who][:, None]] = np.inf
            near = np.sort(np.concatenate([self.best[who], np.partition(d, min(self.k, d.shape[1]) - 1, axis=1)[:, : self.k]], axis=1), axis=1)[:, : self.k]
            self.best[who] = near
            if keep:
                self.radius[who] = np.minimum(self.radius[who], near[:, -1])
                hit = (d <= self.radius[who][:, None] + 1e-7) & (d < np.inf)
                for i in np.flatnonzero(hit.any(1)):
                    self.found[who[i]].append(part[hit[i]])

    def _descend(self, node, who: np.ndarray) -> None:
        if isinstance(node, np.ndarray):
            self._leaf(node, who, keep=False)
            return
        if len(who):
            vantage, mu, inner, outer = node
            d = distances(self.q[who], self.unit[vantage][None])[:, 0]
            self._descend(inner, who[d <= mu])
            self._descend(outer, who[d > mu])

    def _walk(self, node, who: np.ndarray) -> None:
        if not len(who):
            return
        if isinstance(node, np.ndarray):
            self._leaf(node, who, keep=True)
            return
        vantage, mu, inner, outer = node
        d = distances(self.q[who], self.unit[vantage][None])[:, 0]
        near_inner = d <= mu
        # the side a query lies in comes first for it, so that its radius shrinks before the other
        for first in (True, False):
            for side, lies in ((inner, near_inner), (outer, ~near_inner)):
                chosen = lies if first else ~lies & (np.abs(d - mu) * self.factor <= self.radius[who] + 1e-7)
                self._walk(side, who[chosen])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, each summed in the same order wherever the row stands."""
    dot, aa, bb = ((x * y).sum(-1) for x, y in ((a, b), (a, a), (b, b)))
    return dot / (np.sqrt(aa) * np.sqrt(bb))


_OUT = "query_id long, vec_id long, score double"
_SHARDS = "shard int, asks boolean, vec_id long, vector array<double>, radius double"


def unit_rows(batch) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of an Arrow batch, and the same with unit length."""
    column = batch.column("vector")
    v = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return v, v / np.linalg.norm(v, axis=1, keepdims=True)


@dataclass(frozen=True)
class Centres:
    """Unit vectors, the radius of each one's ball, and the first of its shards and their number."""

    unit: np.ndarray
    ball: np.ndarray
    first: np.ndarray
    shards: np.ndarray

    def spread(self, centre: np.ndarray, ids: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The shard of each row of a centre, by its id and first component."""
        h = (ids.astype(np.uint64) ^ np.ascontiguousarray(v[:, 0]).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        return (self.first[centre] + (h >> np.uint64(33)).astype(np.int64) % self.shards[centre]).astype(np.int32)


def _placed(centres: Centres):
    """Rows with their shard."""

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                v, unit = unit_rows(batch)
                shard = centres.spread(distances(unit, centres.unit).argmin(1), batch.column("vec_id").to_numpy(), v)
                yield _out(shard, False, batch, np.zeros(len(shard)))

    return place


def _out(shard: np.ndarray, asks: bool, batch, radius: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(shard, pa.int32()), pa.array(np.full(len(shard), asks)), batch.column("vec_id"), batch.column("vector"), pa.array(radius, pa.float64())]
    return pa.RecordBatch.from_arrays(columns, ["shard", "asks", "vec_id", "vector", "radius"])


def _routed(centres: Centres, factor: float, own: bool):
    """Queries with a shard each that they visit: one of their own centre, or all others that they cannot exclude."""

    def route(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                v, unit = unit_rows(part)
                ids, d = part.column("vec_id").to_numpy(), distances(unit, centres.unit)
                nearest_one = d.argmin(1)
                mine = centres.spread(nearest_one, ids, v)
                if own:
                    yield _out(mine, True, part, np.full(len(ids), np.inf))
                    continue
                radius = part.column("radius").to_numpy()
                query, centre = np.nonzero((d - centres.ball) * factor <= radius[:, None] + 1e-7)
                each = centres.shards[centre]
                query, shard = np.repeat(query, each), np.repeat(centres.first[centre] - np.cumsum(each) + each, each) + np.arange(each.sum())
                other = shard != mine[query]
                query, shard = query[other], shard[other]
                for k in range(0, len(query), 4096):
                    take = query[k : k + 4096]
                    yield _out(shard[k : k + 4096], True, part.take(pa.array(take)), radius[take])

    return route


def _visit(cfg: TreeConfig):
    """Rows and then queries of one shard after another: each query's nearest there."""

    def found(tree, ids, vectors, batch):
        queries, unit = unit_rows(batch)
        asked = batch.column("vec_id").to_numpy()
        out = []
        for q, rows in enumerate(tree.search(unit, asked, ids, cfg.k, cfg.factor, batch.column("radius").to_numpy())):
            scores = cosine(queries[q][None], vectors[rows])
            best = np.lexsort((ids[rows], -scores))[: cfg.k]
            out.append((np.full(len(best), asked[q]), ids[rows][best], scores[best]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    def visit(batches):
        held, shard, tree, ids, vectors = [], None, None, None, None
        for batch in batches:
            key = batch.column("shard").to_numpy().astype(np.int64) * 2 + batch.column("asks").to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)] if len(key) else []
            for a, b in zip(edges, edges[1:], strict=False):
                part = batch.slice(a, b - a)
                if key[a] // 2 != shard:
                    held, shard, tree = [], key[a] // 2, None
                if not key[a] % 2:
                    held.append(part)
                    continue
                if tree is None and held:
                    ids = np.concatenate([h.column("vec_id").to_numpy() for h in held])
                    vectors, unit = (np.concatenate(x) for x in zip(*map(unit_rows, held), strict=True))
                    tree, held = VantageTree(unit, cfg.leaf, cfg.seed), []
                if tree is not None:
                    for at in range(0, len(part), 1024):
                        yield found(tree, ids, vectors, part.slice(at, 1024))

    return visit


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, vector`` of the rows that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0))


def _of_width(rows: DataFrame, every: int, cfg: TreeConfig) -> DataFrame:
    """``query_id, vec_id, score`` candidates among the vectors of one length."""
    n = rows.count()
    chosen = rows.orderBy(F.xxhash64("vec_id", F.lit(cfg.seed)), "vec_id").limit(min(max(1, n // cfg.shard_rows), cfg.most_centres)).select("vector").collect()
    unit = np.array([r["vector"] for r in chosen], np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)

    def measure(batches):
        for batch in batches:
            if batch.num_rows:
                d = distances(unit_rows(batch)[1], unit)
                at = d.argmin(1)
                ball = np.zeros(len(unit))
                np.maximum.at(ball, at, d[np.arange(len(at)), at])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(unit))), pa.array(ball), pa.array(np.bincount(at, minlength=len(unit)))], ["centre", "ball", "n"])

    balls = {r["centre"]: r for r in rows.mapInArrow(measure, "centre long, ball double, n long").groupBy("centre").agg(F.max("ball").alias("ball"), F.sum("n").alias("n")).collect()}
    shards = np.array([max(1, -(-balls[c]["n"] // cfg.shard_rows)) for c in range(len(unit))])
    centres = Centres(unit, np.array([balls[c]["ball"] for c in range(len(unit))]), np.cumsum(shards) - shards, shards)
    tasks = int(shards.sum())
    placed = rows.mapInArrow(_placed(centres), _SHARDS)

    def search(asked: DataFrame) -> DataFrame:
        both = placed.union(asked).repartitionById(tasks, "shard").sortWithinPartitions("shard", "asks")
        return both.mapInArrow(_visit(cfg), _OUT)

    asked = rows.where(F.col("vec_id") % every == 0)
    first = search(asked.mapInArrow(_routed(centres, cfg.factor, own=True), _SHARDS))
    if tasks == 1:
        return first
    first = stored(first, "neighbours-first")
    # the k-th score of the first pass bounds the distance of what can still be nearer
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc())
    worst = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == cfg.k).groupBy("query_id").agg(F.min("score").alias("score"))
    radius = F.coalesce(F.sqrt(F.greatest(2 - 2 * F.col("score"), F.lit(0.0))) + 1e-9, F.lit(float("inf")))
    again = asked.join(worst, asked["vec_id"] == worst["query_id"], "left").select("vec_id", "vector", radius.alias("radius"))
    return first.union(search(again.mapInArrow(_routed(centres, cfg.factor, own=False), _SHARDS)))


def nearest(vectors: DataFrame, every: int = 50, cfg: TreeConfig = TreeConfig()) -> DataFrame:
    """``query_id, rank, vec_id, score``: each row with ``vec_id % every = 0`` against all rows."""
    rows = usable(vectors)
    widths = [r["width"] for r in rows.select(F.size("vector").alias("width")).distinct().collect()]  # most tables have one
    found = None
    for width in sorted(widths):
        own = _of_width(rows.where(F.size("vector") == width), every, cfg)
        found = own if found is None else found.union(own)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], _OUT)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cfg.k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"))
