"""Tokens, packing and archives: exact round trips."""

import base64
import hashlib
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from formulaspark.llm import packing as P
from formulaspark.llm import records as R
from formulaspark.llm import warc as W
from formulaspark.llm.codec import ChunkEncoder
from formulaspark.llm.common import shared_dir

ODD = ["", " ", "  a", "a  b", "a \n b", "x<|endoftext|>y z <|endoftext|>", "it's don't 'll   x​ b", "日本 語 a b", "á b é", "ẞ İ A ſ K ", "a.\nB c", "a\n\nb", "Foo$$$ x!!\ny_ _z a_b", "x\r\ny z", "word " * 300, "a <|startoftext|>b <|endoftext|> c<|ENDOFTEXT|> <|endoftext", "word<|endoftext|>\nx <|endoftext|><|endoftext|>", "a" * 5000 + " b"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_give_the_library_s_ids(name, prose):
    path = R.public_tokenizer(name)
    whole = Tokenizer.from_file(path)
    texts = [*ODD, *(t or "" for _, t in prose)]
    want = [np.array(e.ids, "<u4").tobytes() for e in whole.encode_batch(texts, add_special_tokens=False)]
    coder = ChunkEncoder(path, limit=20)
    assert coder.encode(texts) == want and coder.encode(texts[::-1]) == want[::-1]


def test_records(spark, make_docs, prose):
    path = R.public_tokenizer("word_bpe_49k.json")
    manifest = R.write_records(make_docs([*prose, (None, "no id")]), shared_dir(spark, "test-records"), path, bucket_chars=2000)
    assert manifest.count() > 1
    rows = R.read_records(manifest).orderBy("start").collect()
    texts = dict(prose)
    coder, start = Tokenizer.from_file(path), 0
    assert [r.doc_id for r in rows] == [None, *sorted(texts)]
    for r in rows:
        ids = np.array([*coder.encode(texts.get(r.doc_id, "no id") or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        assert (r.start, r.n_tokens, bytes(r.ids), r.ids_crc32) == (start, len(ids) // 4, ids, zlib.crc32(ids))
        start += r.n_tokens
    one = manifest.first()
    assert sorted(x.doc_id or -1 for x in R.read_shuffled(one["path"], 4)) == sorted(r.doc_id or -1 for r in R.read_records(manifest.where(f"bucket = {one['bucket']}")).collect())
    empty = R.write_records(make_docs([]), shared_dir(spark, "test-records"), path)
    assert R.read_records(empty).count() == 0


def test_records_of_rows_without_an_id_of_their_own(spark):
    path = R.public_tokenizer("word_bpe_49k.json")
    rows = [(None, f"text {i}", i, "a") for i in range(50)] + [(7, f"more {i % 9}", i, "b") for i in range(60)] + [(1, None, 0, "c"), (9, "word " * 40_000, 0, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bucket int, ids string")
    manifest = R.write_records(docs, shared_dir(spark, "test-records"), path, bucket_chars=100)
    got = R.read_records(manifest).orderBy("start").collect()
    coder = Tokenizer.from_file(path)
    assert [r.doc_id for r in got] == [None] * 50 + [1] + [7] * 60 + [9]
    assert len(manifest.where("n_docs > 0").collect()) > 8  # rows that share an id, or have none, spread
    want = sorted(((i, [*coder.encode(t or "", add_special_tokens=False).ids, 1]) for i, t, _, _ in rows), key=str)
    assert sorted(((r.doc_id, np.frombuffer(bytes(r.ids), "<u4").tolist()) for r in got), key=str) == want


def test_damage_is_seen(tmp_path):
    import io

    raw = bytearray(R.frame(b"payload"))
    assert R.read_frame(io.BytesIO(bytes(raw))) == b"payload"
    raw[14] ^= 1
    with pytest.raises(ValueError):
        R.read_frame(io.BytesIO(bytes(raw)))


def test_packing(spark, make_docs, prose):
    capacity = 64
    rows = P.pack(make_docs(prose), R.public_tokenizer("byte_bpe_50k.json"), capacity, group=10).collect()
    coder = Tokenizer.from_file(R.public_tokenizer("byte_bpe_50k.json"))
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_bin.setdefault(r.sequence_id, []).append(r)
    for i, text in prose:
        own = sorted(by_doc[i], key=lambda r: r.piece)
        ids = np.array([*coder.encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        assert b"".join(bytes(r.ids) for r in own) == ids and all(r.length == capacity for r in own[1:])
    for own in by_bin.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    assert len(by_bin) <= -(-sum(r.length for r in rows) // capacity) + 2


def test_plans_reach_the_bound():
    rng = np.random.default_rng(3)
    for capacity in (20, 100):
        for _ in range(10):
            sizes, counts = np.unique(rng.integers(1, capacity + 1, 200), return_counts=True)
            histogram = dict(zip(sizes.tolist(), counts.tolist()))
            plan, left = P.plan_bins(histogram, capacity), dict(histogram)
            for times, members in plan:
                assert sum(members) <= capacity
                for m in members:
                    left[m] -= times
            assert not any(left.values())
            # best fit decreasing is never better
            bins = []
            for s in sorted((s for s, n in histogram.items() for _ in range(n)), reverse=True):
                fits = [k for k, room in enumerate(bins) if room >= s]
                if fits:
                    bins[min(fits, key=lambda k: bins[k])] -= s
                else:
                    bins.append(capacity - s)
            assert sum(t for t, _ in plan) <= len(bins)
    assert P.plan_bins({}, 10) == []


def test_undominated_fillings():
    assert list(P.fillings({500: 1, 400: 1, 200: 1, 100: 1}, 600)) == [(0, (500, 100)), (0, (400, 200))]
    assert list(P.fillings({600: 1, 400: 1, 200: 1}, 600)) == [(0, (600,))]


def least_by_hand(sizes, capacity):
    """Each piece in turn into each different bin, by sets of rooms."""
    states = {()}
    for s in sorted(sizes, reverse=True):
        states = {tuple(sorted((*b[:i], b[i] - s, *b[i + 1 :]))) for b in states for i in range(len(b)) if b[i] >= s} | {tuple(sorted((*b, capacity - s))) for b in states}
    return min(map(len, states))


def test_plans_are_least():
    rng = np.random.default_rng(8)
    for _ in range(150):
        capacity = int(rng.integers(20, 60))
        pieces = rng.integers(capacity // 6, capacity * 2 // 3, 9).tolist()
        histogram = {s: pieces.count(s) for s in pieces}
        plan = P.plan_bins(histogram, capacity)
        assert sum(t for t, _ in plan) == least_by_hand(pieces, capacity)
        used = [m for t, members in plan for m in members * t]
        assert sorted(used) == sorted(pieces) and all(sum(m) <= capacity for _, m in plan)


def test_plans_backtrack():
    # the first descents take four bins where three do
    for capacity, pieces in ((51, [24, 22, 21, 18, 18, 13, 13, 9, 8, 6]), (22, [10, 10, 9, 9, 7, 7, 5, 5, 2, 2])):
        assert sum(t for t, _ in P.plan_bins({s: pieces.count(s) for s in pieces}, capacity)) == least_by_hand(pieces, capacity)


def test_archives(spark):
    rows = [(i, f"https://www.example.com/p{i % 4}?b=2&a=1", None if i % 5 == 0 else f"<p>page {i % 7}\r\n\r\nWARC/1.0</p>é") for i in range(30)]
    pages = spark.createDataFrame([*rows, (99, None, "")], "page_id long, url string, html string")
    manifest = W.write_archives(pages.repartition(3), shared_dir(spark, "test-warc"))
    index = W.merged_index(W.capture_runs(manifest), bucket_rows=10).collect()
    got = {r.page_id: r for r in index}
    first = {}
    for i, _, html in [*rows, (99, None, "")]:
        raw = (html or "").encode()
        head = first.setdefault(raw, i)
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if head == i else ("revisit", head))
    order = [(r.urlkey, r.time, r.page_id) for r in sorted(index, key=lambda r: (r.bucket, r.place))]
    assert order == sorted(order) and len(order) == 31
    assert W.merged_index(W.capture_runs(W.write_archives(pages.where("false"), shared_dir(spark, "test-warc")))).count() == 0


def test_archives_of_any_page_id(spark):
    ids = [10**12, -(10**12), (1 << 63) - 1, -(1 << 63), 0, None, None, 7, 7]
    pages = spark.createDataFrame([(i, "http://a.b/", "same", 1, "x") for i in ids], "page_id long, url string, html string, time long, digest string")
    index = W.merged_index(W.capture_runs(W.write_archives(pages, shared_dir(spark, "test-warc")))).collect()
    assert sorted(map(str, ids)) == sorted(str(r.page_id) for r in index)
    assert sorted({r.refers_to for r in index if r.record_type == "revisit"}) == [-(1 << 63)]
    assert [r.page_id for r in index if r.record_type == "response"] == [-(1 << 63)]
    assert W.stamp(W.FIRST) == "0001-01-01T00:00:00Z" and W.stamp(W.LAST) == "9999-12-31T23:59:59Z"


def test_loser_tree():
    rng = np.random.default_rng(1)
    for k in (0, 1, 2, 5, 8):
        runs = [sorted((("r", f"k{int(v)}", "t", int(v), "", 0, "", "", None, j, 0) for j, v in enumerate(rng.integers(0, 50, n))), key=W.order_key) for n in rng.integers(0, 20, k)]
        merged = list(W.LoserTree(runs))
        assert merged == sorted((x for r in runs for x in r), key=W.order_key)
