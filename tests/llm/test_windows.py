"""Removal of repeated windows against plain loops; the sketch by itself."""

import hashlib
import random
import re

import numpy as np
import pytest

from formulaspark.llm.hashing import window_hashes
from formulaspark.llm.windows import Sketch, WindowConfig, packed, remove_windows, unpacked


def by_hand(rows, width):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    key = [(i is not None, i or 0) for i, _ in rows]
    first: dict = {}
    for k, w in zip(key, words):
        for at in range(len(w) - width + 1):
            run = tuple(w[at : at + width])
            first[run] = min(first.get(run, k), k)
    out = []
    for (i, _), k, w in zip(rows, key, words):
        gone = {p for at in range(len(w) - width + 1) if first[tuple(w[at : at + width])] < k for p in range(at, at + width)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)] + ["é", "日本", "x" * 300, "a\x00b", "\xa0", "W1"]
    shared = rng.choices(words, k=60)
    rows = []
    for i in range(80):
        own = rng.choices(words, k=rng.choice([0, 1, 4, 12, 13, 14, 40, 200]))
        if i % 3 == 0:  # a third of the documents hold a passage, some twice
            at = rng.randrange(len(own) + 1)
            own[at:at] = shared[i % 20 : 40 + i % 20] * (1 + i % 2)
        rows.append((i, rng.choice([" ", "\n", "  \t"]).join(own)))
    rows += [(100 + i, rows[i][1]) for i in range(0, 80, 7)]
    rows += [(5, rows[6][1]), (5, rows[5][1]), (None, rows[9][1]), (None, rows[9][1]), (-7, rows[12][1]), (200, None), (201, ""), (202, " \n ")]
    rows += [(203, " ".join(rng.choices(words, k=5000)))]
    rows += [(204, rows[-1][1] + " end"), (205, "z " * 50), (206, "z " * 40)]
    return rows


@pytest.mark.parametrize("cfg", [WindowConfig(), WindowConfig(width=3, depth=3, cells_per_window=1, shard_windows=500, block_bytes=2000), WindowConfig(width=5, depth=1, shard_windows=100, block_bytes=50)])
def test_removal(spark, make_docs, cfg):
    rows = corpus()
    docs = make_docs(rows).withColumnRenamed("source", "words").withColumnRenamed("lang", "block").repartition(3)
    got = [tuple(r) for r in remove_windows(docs, cfg).collect()]
    assert sorted(got, key=str) == by_hand(rows, cfg.width)


def test_empty_tables(make_docs):
    assert remove_windows(make_docs([])).count() == 0
    assert sorted(tuple(r)[:3] for r in remove_windows(make_docs([(1, None), (2, "a b")])).collect()) == [(1, 0, 0), (2, 2, 0)]


def test_variable_bytes():
    values = np.array([0, 1, 127, 128, 16_383, 16_384, 1 << 31, (1 << 40) + 5])
    data, ends = packed(values)
    assert unpacked(data.tobytes()).tolist() == values.tolist() and len(data) == ends[-1]
    assert unpacked(data[ends[2] : ends[5]].tobytes()).tolist() == [128, 16_383, 16_384]
    assert unpacked(b"").tolist() == [] and len(packed(values[:0])[0]) == 0


@pytest.mark.parametrize("width", [1, 2, 5, 8, 13])
def test_window_hashes(width):
    words = np.random.default_rng(1).integers(0, 4, 3000).astype(np.uint64)
    runs = [tuple(words[i : i + width].tolist()) for i in range(len(words) - width + 1)]
    h = window_hashes(words, width).tolist()
    assert len(h) == len(runs) and len(set(h)) == len(set(runs)) == len(set(zip(h, runs)))
    assert len(window_hashes(words[: width - 1], width)) == 0


def test_sketch_shards_keep_their_own_cells():
    sketch = Sketch.of(1_000_000, WindowConfig(shard_windows=300_000))
    h = np.random.default_rng(0).integers(0, 1 << 63, 10_000, dtype=np.uint64) * np.uint64(2)
    assert sketch.shards == 4 and sketch.cells >= 2_000_000
    shards = {row: sketch.cells_of(h, row) // sketch.cells for row in range(2)}
    assert (shards[0] == shards[1]).all() and set(shards[0].tolist()) == {0, 1, 2, 3}
