"""Operator 11: centroid clustering with scalar lookup tables.

Components become integers, so few different values occur per dimension.  Vectors are stored
once as blocks of at most ``block_rows``: per dimension the block's different values and, per
vector, a 16-bit code into them (half the size of the floats).  In each round a task tabulates,
for every dimension, value of the block and centroid, the squared difference; the distances of a
vector are sums of rows gathered from these tables.  The same codes, counted per centroid, give
exact sums of values.  A task hands on one row per centroid and dimension (1,024 rows), which
Spark adds up; only the centroids (16 x 64 integers) go through the driver.

Defined results: vectors that are null, of another length than ``width``, or hold null or
non-finite components take no part.  A null vec_id is clustered as any other, but seeds only
where fewer than ``k`` others are kept; rows that share a vec_id are vectors each, and as
seeds follow each other in the order of their components.  Fewer than ``k`` vectors give so many
centroids; an empty table gives no rows.  Only ``vec_id`` and ``embedding`` are read.  Integers of
2**27 and beyond would overflow the distances: they end the job with an error.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, stored

_MOST = 1 << 27
_BLOCK_KIND = "vec_ids array<long>, codes binary, sizes binary, values binary"
_SUM_KIND = "cluster int, dim int, n long, total long"
_ASSIGNED = "vec_id long, cluster int, distance long"
_RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


@dataclass(frozen=True)
class ClusterConfig:
    k: int = 16
    width: int = 64
    scale: int = 64
    rounds: int = 3
    seed: int = 1
    block_rows: int = 8_192


@dataclass(frozen=True)
class Block:
    """``codes[j, i]`` is the place of vector i's component j among ``values[j]``."""

    vec_ids: pa.Array
    codes: np.ndarray
    values: list[np.ndarray]

    @staticmethod
    def of(vec_ids: pa.Array, numbers: np.ndarray) -> Block:
        pairs = [np.unique(column, return_inverse=True) for column in numbers.T]
        return Block(vec_ids, np.stack([p[1] for p in pairs]).astype(np.uint16), [p[0] for p in pairs])

    def row(self) -> pa.RecordBatch:
        sizes = np.array([len(v) for v in self.values], np.int32)
        cells = [self.vec_ids.to_pylist(), self.codes.tobytes(), sizes.tobytes(), np.concatenate(self.values).tobytes()]
        kinds = [pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], ["vec_ids", "codes", "sizes", "values"])

    def distances(self, centroids: np.ndarray) -> np.ndarray:
        """Squared distances, vectors x centroids, as sums of gathered table rows."""
        out = np.zeros((self.codes.shape[1], len(centroids)), np.int64)
        for codes, values, own in zip(self.codes, self.values, centroids.T, strict=True):
            table = (values[:, None] - own[None, :]) ** 2
            out += table[codes]
        return out

    def sums(self, cluster: np.ndarray, k: int) -> np.ndarray:
        """Sums of components, clusters x dimensions, from counts of codes."""
        out = np.empty((k, len(self.values)), np.int64)
        for j, (codes, values) in enumerate(zip(self.codes, self.values, strict=True)):
            counts = np.bincount(cluster * len(values) + codes, minlength=k * len(values))
            out[:, j] = counts.reshape(k, -1) @ values
        return out


def blocks_in(batches):
    """The stored blocks in Arrow batches."""
    for batch in batches:
        ids = batch.column("vec_ids")
        for i in range(batch.num_rows):
            codes, sizes, values = (batch.column(c)[i].as_py() for c in ("codes", "sizes", "values"))
            sizes = np.frombuffer(sizes, np.int32)
            values = np.split(np.frombuffer(values, np.int64), np.cumsum(sizes)[:-1])
            yield Block(ids[i].values, np.frombuffer(codes, np.uint16).reshape(len(sizes), -1), values)


def kept_vectors(vectors: DataFrame, cfg: ClusterConfig) -> DataFrame:
    """``vec_id, embedding`` of vectors with ``width`` finite components."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return kept.where((F.size("embedding") == cfg.width) & ~bad)


def encode(cfg: ClusterConfig):
    """Arrow batches of ``vec_id, embedding`` as blocks."""

    def run(batches):
        ids, numbers, count = [], [], 0

        def block():
            return Block.of(pa.concat_arrays(ids), np.concatenate(numbers)).row()

        for batch in batches:
            for at in range(0, batch.num_rows, cfg.block_rows):
                part = batch.slice(at, cfg.block_rows)
                whole = np.floor(part.column("embedding").flatten().to_numpy(zero_copy_only=False) * cfg.scale).reshape(-1, cfg.width)
                if (np.abs(whole) >= _MOST).any():
                    raise ValueError("a component is too large: its squared distances would not fit a long")
                if count + len(whole) > cfg.block_rows:
                    yield block()
                    ids, numbers, count = [], [], 0
                ids.append(part.column("vec_id"))
                numbers.append(whole.astype(np.int64))
                count += len(whole)
        if count:
            yield block()

    return run


def first_centroids(kept: DataFrame, cfg: ClusterConfig) -> np.ndarray:
    """The ``k`` vectors with the smallest hashes of their ids."""
    key = F.sha2(F.concat(F.lit(f"{cfg.seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.orderBy(key.asc_nulls_last(), "embedding").limit(cfg.k).collect()
    return np.floor(np.array([r["embedding"] for r in rows], float).reshape(-1, cfg.width) * cfg.scale).astype(np.int64)


def round_of(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The next centroids: exact floors of means, empty clusters as they were."""
    k, width = centroids.shape

    def partial(batches):
        n, totals = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for block in blocks_in(batches):
            cluster = block.distances(centroids).argmin(1)
            n += np.bincount(cluster, minlength=k)
            totals += block.sums(cluster, k)
        some = np.flatnonzero(n)
        cluster, dim = np.repeat(some, width), np.tile(np.arange(width), len(some))
        columns = [cluster.astype(np.int32), dim.astype(np.int32), n[cluster], totals[cluster, dim]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["cluster", "dim", "n", "total"])

    summed = blocks.mapInArrow(partial, _SUM_KIND).groupBy("cluster", "dim")
    rows = summed.agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    out = centroids.copy()
    for r in rows:
        out[r["cluster"], r["dim"]] = int(r["total"]) // r["n"]
    return out


def assigned(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vec_id, cluster, distance`` of every vector."""

    def assign(batches):
        for block in blocks_in(batches):
            distances = block.distances(centroids)
            cluster = distances.argmin(1)
            least = distances[np.arange(len(cluster)), cluster]
            yield pa.RecordBatch.from_arrays([block.vec_ids, pa.array(cluster.astype(np.int32)), pa.array(least)], ["vec_id", "cluster", "distance"])

    return blocks.mapInArrow(assign, _ASSIGNED)


def cluster_vectors(vectors: DataFrame, cfg: ClusterConfig = ClusterConfig()) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every kept vector."""
    spark = vectors.sparkSession
    kept = kept_vectors(vectors, cfg)
    centroids = first_centroids(kept, cfg)
    if not len(centroids):
        return spark.createDataFrame([], _RESULT)
    blocks = stored(kept.mapInArrow(encode(cfg), _BLOCK_KIND), "centroid-blocks")
    for _ in range(cfg.rounds):
        centroids = round_of(blocks, centroids)
    found = stored(assigned(blocks, centroids), "centroid-vectors")
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    # one row per centroid
    about = spark.createDataFrame([(c, s, sum(sums.values()), digests[c]) for c, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(read_table(spark, sf_dir, "embeddings"))


#: The rounds as SQL, one common table each.
_ROUND = """
d{r} as materialized (select v.vec_id, c.c, sum((v.x - c.x) * (v.x - c.x)) as d from vecs v join c{r} c using (dim) group by v.vec_id, c.c),
a{r} as materialized (select vec_id, arg_min(c, d * 16 + c) as c, min(d) as d from d{r} group by vec_id)"""
_NEXT = """,
c{n} as materialized (select c.c, c.dim, coalesce(m.x, c.x) as x from c{r} c left join (
  select a.c, v.dim, cast((sum(v.x) - ((sum(v.x) % count(*)) + count(*)) % count(*)) // count(*) as bigint) as x from a{r} a join vecs v using (vec_id) group by a.c, v.dim) m using (c, dim)),"""

SQL = (
    "with kept as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as e from embeddings"
    " where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),\n"
    "vecs as materialized (select vec_id, unnest(range(64)) as dim, unnest(e) as x from kept),\n"
    "seeds as (select vec_id, row_number() over (order by sha256('1:' || vec_id)) - 1 as c from kept),\n"
    "c0 as materialized (select s.c, v.dim, v.x from seeds s join vecs v using (vec_id) where s.c < 16),"
    + "".join(_ROUND.format(r=r) + (_NEXT.format(r=r, n=r + 1) if r < 3 else "") for r in range(4))
    + ",\nshas as (select c, sha256(string_agg(cast(x as varchar), ',' order by dim)) as sha from c3 group by c)\n"
    "select a.vec_id, cast(a.c as integer) as cluster, cast(a.d as bigint) as distance, cast(sum(a.d) over (partition by a.c) as bigint) as cluster_inertia,"
    " cast(sum(a.d) over () as bigint) as inertia, s.sha as centroid_sha256 from a3 a join shas s using (c)"
)
