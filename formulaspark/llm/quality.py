"""Operator 4: document quality by random indexing and a small network.

Method.  Each word owns a sparse random *index vector* (a few +1/-1 entries that
its hash chooses).  A pass over the whole corpus adds to each word's *context
vector* the index vectors of its neighbours.  Words are folded into ``buckets``
rows by hash, so the table has a size fixed by parameters (``buckets * dims``
floats) however large the vocabulary is; no word is left out.  A document is the
pooled context vectors of its words (mean, deviation, mean step between
neighbours) and of their shapes (letters, capitals, digits and signs; mean).  A two-layer
network in numpy is fitted on at most ``max_train`` labelled rows, chosen by
hash, and its logits are divided by a temperature fitted on rows that the
weights did not see.

Defined results: a null or empty text pools to the zero vector and still gets a
score; documents without a label are scored too; repeated doc_ids give one row
each; an empty table gives no rows; with no usable labels (none, or one class)
every score is the share of label 1 among them, 0.5 if there are none.  Only
``doc_id`` and ``text`` are read, so further columns do not matter.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .codec import text_runs
from .common import WordCache, arrow_rows, hash64, lean, read_table, stored, texts_of


@dataclass(frozen=True)
class QualityConfig:
    buckets: int = 1 << 14
    dims: int = 16
    nonzero: int = 2
    window: int = 2
    block: int = 256
    hidden: int = 48
    max_train: int = 24_000
    epochs: int = 60
    seed: int = 7


#: Letters become a, capitals A, digits 0; other signs stay.
_SHAPE = {**{c: "a" for c in range(97, 123)}, **{c: "A" for c in range(65, 91)}, **{c: "0" for c in range(48, 58)}}


def _shape(word: str) -> str:
    if word.isalpha():
        return "s:a" if word.islower() else "s:A" if word.isupper() else "s:Aa"
    flat = "".join(c if ord(c) < 128 else "A" if c.isupper() else "a" for c in word.translate(_SHAPE))
    # runs of letters and digits become one, runs of other signs two; as a list, for a word may be very long
    out = ["s", ":"]
    for c in flat:
        if out[-1] != c or out[-2] != c and c not in "aA0":
            out.append(c)
    return "".join(out)


def _word_cache(cfg: QualityConfig) -> WordCache:
    def make(word: str) -> int:
        a = hash64(word.encode("utf-8", "surrogatepass")) % cfg.buckets
        b = hash64(_shape(word).encode("utf-8", "surrogatepass")) % cfg.buckets
        return a << 32 | b

    return WordCache(make)


def index_vectors(cfg: QualityConfig) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of each bucket's index vector."""
    rng = np.random.default_rng(cfg.seed)
    return rng.integers(0, cfg.dims, (cfg.buckets, cfg.nonzero)), rng.choice([-1.0, 1.0], (cfg.buckets, cfg.nonzero))


def _ids(texts: list[str], cache: WordCache) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the words, buckets of their shapes, and words per text."""
    words, counts = [], []
    for text in texts:
        own = text.split()
        words += own
        counts.append(len(own))
    both = np.fromiter(map(cache.__getitem__, words), np.int64, len(words))
    return both >> 32, both & 0xFFFFFFFF, np.array(counts, np.int64)


def context_vectors(docs: DataFrame, cfg: QualityConfig) -> np.ndarray:
    """The corpus' context vectors, ``buckets`` x ``dims``; rows have unit length.

    Tasks add up their share in a fixed-size table and send it on in blocks of
    ``block`` rows; one task per block adds those as a stream.
    """

    def local(batches):
        place, sign = index_vectors(cfg)
        cache, total = _word_cache(cfg), np.zeros(cfg.buckets * cfg.dims)
        for batch in batches:
            for _, texts in text_runs(batch.column("text"), 1_000_000):
                words, shapes, counts = _ids(texts, cache)
                owner = np.repeat(np.arange(len(counts)), counts)
                for step in range(1, cfg.window + 1):
                    same = np.flatnonzero(owner[step:] == owner[:-step])
                    for target, near in ((same, same + step), (same + step, same)):
                        for ids in (words, shapes):
                            at, of = ids[target] * cfg.dims, words[near] if ids is words else shapes[near]
                            for k in range(cfg.nonzero):
                                np.add.at(total, at + place[of, k], sign[of, k])
        table = total.astype(np.float32).reshape(-1, cfg.block, cfg.dims)
        used = np.flatnonzero(np.abs(table).sum((1, 2)))
        for at in range(0, len(used), 16):
            part = used[at : at + 16]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int64()), pa.array([table[i].tobytes() for i in part], pa.binary())], ["block", "vectors"]
            )

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column("block").to_pylist(), batch.column("vectors").to_pylist(), strict=True):
                vectors = np.frombuffer(raw, np.float32).astype(np.float64)
                sums[block] = sums[block] + vectors if block in sums else vectors
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int64()), pa.array([v.astype(np.float32).tobytes() for v in sums.values()], pa.binary())],
                ["block", "vectors"],
            )

    blocks = cfg.buckets // cfg.block
    parts = texts_of(docs).select("text").mapInArrow(lean(local), "block long, vectors binary").repartition(blocks, "block").mapInArrow(add, "block long, vectors binary")
    table = np.zeros((cfg.buckets, cfg.dims), np.float32)
    with arrow_rows(docs.sparkSession, 1000):
        rows = parts.collect()  # at most one row a block: a table of fixed size
    for block, raw in rows:
        table[block * cfg.block : (block + 1) * cfg.block] = np.frombuffer(bytes(raw), np.float32).reshape(-1, cfg.dims)
    return table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)


def pooled(docs: DataFrame, table: np.ndarray, cfg: QualityConfig, names: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``names`` and ``pooled``, little-endian float32 values of the document."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def pool(batches):
        vectors, cache, dims = shared.value, _word_cache(cfg), cfg.dims
        for batch in batches:
            out = []
            for _, texts in text_runs(batch.column("text"), 250_000):
                words, shapes, counts = _ids(texts, cache)
                owner = np.repeat(np.arange(len(counts)), counts)
                sums = np.zeros((len(counts), 4 * dims))
                # slices of a fixed number of words: a long text takes no more memory than a short one
                for at in range(0, len(words), 16_384):
                    own = owner[at : at + 16_384]
                    first = np.flatnonzero(np.diff(own, prepend=-1))
                    v = vectors[words[at : at + len(own) + 1]]
                    step = np.zeros((len(own), dims), np.float32)
                    np.abs(v[1:] - v[:-1], out=step[: len(v) - 1])
                    after = owner[at + 1 : at + len(own) + 1]
                    step[np.flatnonzero(own[: len(after)] != after)] = 0
                    v = v[: len(own)]
                    for j, part in enumerate((v, v * v, step, vectors[shapes[at : at + len(own)]])):
                        sums[own[first], j * dims : (j + 1) * dims] += np.add.reduceat(part, first, axis=0)
                means = sums / np.maximum(counts, 1)[:, None]
                mean = means[:, :dims]
                means[:, dims : 2 * dims] = np.sqrt(np.maximum(means[:, dims : 2 * dims] - mean * mean, 0))
                # lengths of the two mean vectors: how alike the words' surroundings are
                lengths = [np.linalg.norm(means[:, k : k + dims], axis=1, keepdims=True) for k in (0, 3 * dims)]
                means = np.hstack([means, *lengths])
                out += [r.tobytes() for r in means.astype(np.float32)]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(out, pa.binary())], [*names, "pooled"])

    texts = docs.select(*[F.col(n).cast("long").alias(n) for n in names], F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(lean(pool), "".join(f"{n} long, " for n in names) + "pooled binary")


@dataclass
class Network:
    """Two layers, tanh between; inputs are standardised, logits divided by ``temperature``."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def constant_network(width: int, share: float) -> Network:
    share = min(max(share, 1e-6), 1 - 1e-6)
    return Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))


def fit_network(x: np.ndarray, y: np.ndarray, cfg: QualityConfig) -> Network:
    """Adam on logistic loss; every tenth row only serves to fit the temperature."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    if len(np.unique(y)) < 2:
        return constant_network(x.shape[1] if x.ndim == 2 else 1, float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(cfg.seed)
    order = rng.permutation(len(y))
    aside = order[: len(y) // 10]
    rows = order[len(aside) :]
    mean, scale = x[rows].mean(0), x[rows].std(0) + 1e-4
    z = (x - mean) / scale
    width = x.shape[1]
    p = [rng.normal(0, 1 / np.sqrt(width), (width, cfg.hidden)), np.zeros(cfg.hidden), rng.normal(0, 1 / np.sqrt(cfg.hidden), cfg.hidden), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    step, size = 0, 256
    epochs = min(400, max(cfg.epochs, 2000 * size // max(len(rows), 1)))
    for epoch in range(epochs):
        rate = 3e-3 * (1 - epoch / epochs) + 1e-5
        rng.shuffle(rows)
        for at in range(0, len(rows), size):
            take = rows[at : at + size]
            h = np.tanh(z[take] @ p[0] + p[1])
            miss = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[take]) / len(take)
            back = np.outer(miss, p[2]) * (1 - h * h)
            step += 1
            for i, g in enumerate((z[take].T @ back + 1e-4 * p[0], back.sum(0), h.T @ miss + 1e-4 * p[2], np.array([miss.sum()]))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))
    if len(np.unique(y[aside])) == 2:
        logits, truth = net.logits(x[aside]), 2 * y[aside] - 1
        grid = np.geomspace(0.25, 8, 61)
        net.temperature = float(grid[np.argmin([np.logaddexp(0, -truth * logits / t).mean() for t in grid])])
    return net


def remainder() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def score_quality(docs: DataFrame, labels: DataFrame, cfg: QualityConfig = QualityConfig(), threshold: float = 0.3, ids: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``ids`` (whole numbers, doc_id among them), then ``held_out, score, predicted``, for every row of ``docs``.

    Where labels of a document differ, the larger one counts.
    """
    names = list(ids)
    vectors = context_vectors(docs, cfg)
    features = stored(pooled(docs, vectors, cfg, names), "quality-pooled")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where(F.col("quality").isin(0, 1) & (remainder() != 0)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    # at most max_train rows, the first in the order of a hash
    sample = (
        features.where(remainder() != 0).join(known, "doc_id").select("quality", "pooled", F.xxhash64("doc_id", "pooled").alias("h")).orderBy("h").limit(cfg.max_train).toPandas()
    )
    width = 4 * cfg.dims + 2
    x = np.frombuffer(b"".join(map(bytes, sample["pooled"])), np.float32).reshape(-1, width)
    net = fit_network(x, sample["quality"].to_numpy(), cfg)

    def score(batches):
        for batch in batches:
            raw = b"".join(batch.column("pooled").to_pylist())
            found = net.scores(np.frombuffer(raw, np.float32).reshape(-1, width).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(found, pa.float64())], [*names, "score"])

    scored = features.mapInArrow(score, "".join(f"{n} long, " for n in names) + "score double")
    return scored.select(*names, (F.coalesce(remainder(), F.lit(1)) == 0).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
