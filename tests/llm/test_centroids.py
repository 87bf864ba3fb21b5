"""Centroid clustering against plain loops over Python integers."""

import hashlib
import math

import numpy as np
import pytest

from formulaspark.llm.centroids import Block, ClusterConfig, cluster_vectors

KIND = "vec_id long, embedding array<double>, cluster string, distance string"


def by_hand(rows, cfg):
    kept = [(i, [math.floor(cfg.scale * x) for x in e]) for i, e in rows if e is not None and len(e) == cfg.width and all(x is not None and math.isfinite(x) for x in e)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{cfg.seed}:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [list(e) for _, e in sorted(kept, key=key)[: cfg.k]]
    near = lambda e: min((sum((a - b) ** 2 for a, b in zip(e, c)), n) for n, c in enumerate(centroids))
    for _ in range(cfg.rounds):
        own = [near(e)[1] for _, e in kept]
        for n in range(len(centroids)):
            members = [e for (_, e), c in zip(kept, own) if c == n]
            if members:
                centroids[n] = [sum(x) // len(members) for x in zip(*members)]
    found = [(i, *near(e)) for i, e in kept]
    total = sum(d for _, d, _ in found)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, sum(x for _, x, y in found if y == c), total, sha[c]) for i, d, c in found), key=str)


def vectors(n, width, seed):
    rng = np.random.default_rng(seed)
    return [(i, rng.normal(size=width).round(3).tolist()) for i in range(n)]


@pytest.mark.parametrize("n, k, block_rows", [(60, 16, 7), (5, 16, 64), (40, 3, 8192)])
def test_clusters(spark, n, k, block_rows):
    cfg = ClusterConfig(k=k, width=6, block_rows=block_rows)
    rows = vectors(n, 6, n)
    rows += [(900, rows[0][1]), (900, rows[1][1]), (3, rows[2][1])]  # ties and repeated ids
    rows += [(None, rows[1][1]), (901, None), (902, [0.0] * 5), (903, [math.nan] + [0.0] * 5), (904, [None] + [0.0] * 5), (905, [math.inf] + [0.0] * 5), (906, [-1e4, 1e4, -0.001, 0.0, 3.0, -2.5])]
    table = spark.createDataFrame([(i, e, "x", "y") for i, e in rows], KIND)
    assert sorted(map(tuple, cluster_vectors(table, cfg).collect()), key=str) == by_hand(rows, cfg)


def test_empty_and_unfit_tables(spark):
    assert cluster_vectors(spark.createDataFrame([], KIND)).count() == 0
    assert cluster_vectors(spark.createDataFrame([(1, [1.0, 2.0], "", "")], KIND)).count() == 0
    assert {(r.vec_id, r.cluster, r.distance) for r in cluster_vectors(spark.createDataFrame([(i, [0.5] * 64, "", "") for i in range(20)], KIND)).collect()} == {(i, 0, 0) for i in range(20)}


def test_too_large_components(spark):
    with pytest.raises(Exception, match="too large"):
        cluster_vectors(spark.createDataFrame([(1, [1e30] * 64, "", "")], KIND)).count()


def test_tables_hold_only_values_that_occur():
    import pyarrow as pa

    block = Block.of(pa.array([1, 2, 3]), np.array([[5, -1], [5, 2], [7, -1]]))
    assert [v.tolist() for v in block.values] == [[5, 7], [-1, 2]]
    assert block.distances(np.array([[5, 0], [0, 0]])).tolist() == [[1, 26], [4, 29], [5, 50]]
    assert block.sums(np.array([1, 1, 0]), 2).tolist() == [[7, -1], [10, 1]]
