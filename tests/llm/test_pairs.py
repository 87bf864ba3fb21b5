"""Joins, repeats and neighbours against brute force."""

import hashlib

import numpy as np
import pytest

from formulaspark.llm.common import stored
from formulaspark.llm.hashing import word_hashes, word_sets
from formulaspark.llm.jaccard import JaccardConfig, similar_groups, sketch, sketch_gap
from formulaspark.llm.neighbours import TreeConfig, VantageTree, nearest
from formulaspark.llm.suffixes import remove_repeats


def groups_by_hand(rows, width, num, den):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    ids = sorted(sets)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                both = len(sets[a] & sets[b])
                if both and den * both >= num * len(sets[a] | sets[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {i: (len(sets[i]), label[i]) for i in ids}


@pytest.mark.parametrize("width, num", [(3, 90), (5, 80), (2, 50)])
def test_groups(spark, make_docs, prose, width, num):
    cfg = JaccardConfig(width=width, num=num)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_groups(make_docs(prose), cfg).collect()}
    assert got == groups_by_hand(prose, width, num, 100)


def test_groups_of_empty_table(make_docs):
    assert similar_groups(make_docs([])).count() == 0


@pytest.mark.parametrize("texts", [["a B c", "", "  \n", "A b C", "x", "x" * 300 + " y", "x" * 301 + " y", "éà ÉÀ éà", "1234567 12345678 123456789 1234567"]])
def test_word_hashes(texts):
    h, counts = word_hashes(texts)
    words = [w for t in texts for w in t.encode().lower().split()]
    assert counts.tolist() == [len(t.encode().split()) for t in texts]
    assert len(dict(zip(words, h.tolist()))) == len(set(h.tolist())) and len(h) == len(words)
    for width in (1, 3):
        for t, own in zip(texts, word_sets(texts, width)):
            w = t.encode().lower().split()
            assert len(own) == (len({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))}) if w else 0)


def star(n: int, changes: int) -> list[tuple[int, str]]:
    """An original of 200 words, with the largest id, and copies with ``changes`` words of their own."""
    rng = np.random.default_rng(4)
    base = [f"b{i}" for i in range(200)]
    out = []
    for i in range(n):
        own = list(base)
        for at in rng.choice(np.arange(5, 195), changes, replace=False):
            own[at] = f"c{i}.{at}"
        out.append((i, " ".join(own)))
    return [*out, (n, " ".join(base))]


@pytest.mark.parametrize("changes, linked", [(3, True), (12, False)])
def test_a_large_group_of_near_copies_takes_few_comparisons(spark, make_docs, monkeypatch, changes, linked):
    """Copies that are like the original alone are found through it, one comparison each; without
    links between them, no pair is left out."""
    from formulaspark.llm import jaccard

    rows, kept = star(120, changes), []
    monkeypatch.setattr(jaccard, "stored", lambda df, label: kept.append((label, out := stored(df, label))) or out)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_groups(make_docs(rows)).collect()}
    assert got == groups_by_hand(rows, 3, 90, 100)
    assert len({c for _, c in got.values()}) == (1 if linked else 121)
    near = sum(df.count() for label, df in kept if label == "jaccard-near")
    assert near <= 250 if linked else near <= 121 * 120 / 2


def test_groups_with_null_and_repeated_ids_and_clashing_columns(spark):
    text = "one two three four five"
    rows = [(None, text, 1, 2), (7, text, 3, 4), (7, "other words of this text", 5, 6), (9, text + " ", 7, 8), (8, None, 9, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sid long, keys long")
    got = sorted(map(str, similar_groups(docs).collect()))
    want = [(None, 3, None), (7, 3, 7), (7, 3, 7), (9, 3, 7), (8, 0, 8)]
    assert got == sorted(f"Row(doc_id={a}, n_shingles={b}, component_id={c})" for a, b, c in want)


def test_sketch_is_a_lower_bound():
    rng = np.random.default_rng(1)
    for n in (5, 300, 40_000):
        a, b = (np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for _ in range(2))
        gap = sketch_gap(np.frombuffer(sketch(a), np.uint8)[None], np.frombuffer(sketch(b), np.uint8)[None])[0]
        assert gap <= len(np.setxor1d(a, b))


def repeats_by_hand(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = [False] * len(b)
        for s in range(len(b) - length + 1):
            if b[s : s + length] in seen:
                gone[s : s + length] = [True] * length
            seen.add(b[s : s + length])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("length", [64, 100])
def test_repeats(spark, make_docs, prose, length):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(make_docs(prose), length).collect()}
    assert got == repeats_by_hand(prose, length)


def test_repeats_of_rows_without_own_id(make_docs):
    text = "abcdefghij" * 30
    got = remove_repeats(make_docs([(None, text), (1, text), (1, text)])).collect()
    assert sorted((r.doc_id is not None, r.n_removed) for r in got)[1:] == [(True, 300), (True, 300)]
    assert remove_repeats(make_docs([])).count() == 0


def test_repeats_of_a_line_that_many_documents_share(spark, make_docs, monkeypatch):
    from formulaspark.llm import suffixes

    rng = np.random.default_rng(6)
    line = "".join(rng.choice(list("abcdefgh"), 120))
    around = ["".join(x) for x in rng.choice(list("ijklmnop"), (20_000, 60))]
    docs = [(i, around[2 * i] + line + around[2 * i + 1]) for i in range(10_000)] + [(20_000, around[0] + line + around[3])]
    kept = {}
    monkeypatch.setattr(suffixes, "stored", lambda df, label: kept.setdefault(label, stored(df, label)))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(make_docs(docs)).collect()}
    assert got == repeats_by_hand(docs, 100)
    most = max((r["count"] for r in kept["suffix-contexts"].where("not done").groupBy("gram").count().collect()), default=0)
    assert most < 5_000  # 10,000 contexts of one gram do not meet in one task


def test_repeats_in_long_texts_and_many_copies(spark, make_docs, monkeypatch):
    from formulaspark.llm import suffixes

    rng = np.random.default_rng(7)
    words = ["".join(x) for x in rng.choice(list("abcdefgh"), (300, 5))]
    long = " ".join(rng.choice(words, 3000))
    docs = [(1, long), (2, long[500:9000] + "é" + long[:4000]), (3, None), (4, "")] + [(10 + i, long[7000:7300] + str(i)) for i in range(60)]
    cut, compare = suffixes._cut, suffixes._compare
    monkeypatch.setattr(suffixes, "_cut", lambda *a: cut(*a, chars=3000, flush=200))
    monkeypatch.setattr(suffixes, "_compare", lambda length: compare(length, strings=100, most_rows=8))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(make_docs(docs), task_bytes=2000).collect()}
    assert got == repeats_by_hand(docs, 100)


def test_buckets_by_pairs():
    from formulaspark.llm.suffixes import bucket_of

    rng = np.random.default_rng(3)
    splitters = np.array(sorted(map(tuple, rng.integers(0, 4, (9, 2)).tolist())), np.int64)
    lead, gram = rng.integers(-1, 5, (2, 200))
    want = [sum(tuple(s) <= (x, y) for s in splitters.tolist()) for x, y in zip(lead.tolist(), gram.tolist())]
    assert bucket_of(splitters, lead, gram).tolist() == want


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(0, 1, (600, 16))
    v[50:90] = v[49]
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)] + [(1000, None, 0), (1050, [0.0] * 16, 0), (1100, [float("nan")] * 16, 0), (1150, [None] * 16, 0)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for factor, least in ((1.0, 1.0), (TreeConfig().factor, 0.9)):
        got = nearest(d, 50, TreeConfig(factor=factor, shard_rows=200, leaf=16)).collect()
        found = {}
        for r in got:
            found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        assert sorted(found) == list(range(0, 600, 50))
        hits = 0
        for q, own in found.items():
            s = unit @ unit[q]
            s[q] = -9
            want = np.lexsort((np.arange(600), -np.round(s, 12)))[:5].tolist()
            hits += len({x[1] for x in own} & set(want))
            assert all(abs(x[2] - s[x[1]]) < 1e-12 for x in own)
            if factor == 1:
                assert [x[1] for x in sorted(own)] == want
        assert hits >= least * 60


def test_neighbours_of_odd_tables(spark):
    kind = "vec_id long, embedding array<float>, score double, shard string"
    assert nearest(spark.createDataFrame([], kind)).count() == 0
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (50, [0.0, 1.0]), (50, [0.0, 2.0]), (None, [1.0, 0.0]), (100, [1.0, 2.0, 3.0]), (101, [3.0, 2.0, 1.0]), (150, [5.0])]
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in nearest(spark.createDataFrame([(*r, 0.0, "x") for r in rows], kind), cfg=TreeConfig(k=2, shard_rows=2)).collect()]
    assert sorted(got) == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (50, 1, 0, 0.0), (50, 2, 0, 0.0), (100, 1, 101, round(10 / 14, 9))]


def test_tree_of_copies():
    tree = VantageTree(np.ones((500, 4)) / 2, 16, 1)
    assert isinstance(tree.root, np.ndarray)


@pytest.mark.parametrize("task_edges", [1_000, 7])
def test_components(spark, task_edges):
    from formulaspark.llm.graph import components

    rng = np.random.default_rng(5)
    ids = rng.integers(-(1 << 60), 1 << 60, 60).tolist()
    edges = [(ids[i], ids[i + 1]) for i in range(20)] + [(ids[30], ids[j]) for j in range(31, 40)] + [(ids[50], ids[50]), (ids[51], ids[52])]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long"), task_edges).collect()}
    for group in (ids[:21], ids[30:40], ids[51:53]):
        assert len({got[i] for i in group}) == 1
    assert len(set(got.values())) == 3 and ids[50] not in got
    assert components(spark.createDataFrame([], "a long, b long"), task_edges).count() == 0
