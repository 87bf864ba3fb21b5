"""The audit of sources against dense loops over all kept terms; runs and their merge."""

import random
import re
from collections import Counter

import pytest

from formulaspark.llm.divergence import AuditConfig, audit, merged_runs, packed_run, unpacked_run

KIND = "doc_id long, text string, lang string, source string, term string, rank int"


def by_hand(rows, cfg):
    docs = [(lang or "", source or "", [t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        seen, whole, groups = Counter(), Counter(), {}
        for _, source, terms in (d for d in docs if d[0] == lang):
            seen.update(set(terms))
            whole.update(terms)
            groups.setdefault(source, Counter()).update(terms)
        kept = [t for t in whole if seen[t] >= cfg.least_docs]

        def shares(counts):
            n = sum(counts[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 2) // n for t in kept}

        f = lambda p, q: (p - q) * (p - q) // (p + q)
        q = shares(whole)
        p = {s: shares(c) for s, c in groups.items()}
        for s in groups:
            pair = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in groups if o != s]
            term = [(f(p[s][t], q[t]), t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pair, len(pair)), ("term", term, cfg.top)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, at + 1) for at, (value, item) in enumerate(items[:most])]
    return sorted(out)


def corpus():
    rng = random.Random(4)
    words = ["Alpha", "alpha", "bêta", "BÊTA", "日本", "x1y", "don't", "\xa0", "z"] + [f"w{chr(97 + i)}" for i in range(26)] + [f"r{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    weights = [1 / (1 + i) for i in range(len(words))]
    rows = []
    for i in range(300):
        lang = rng.choice(["en", "de", None, ""])
        source = "hot" if i % 3 == 0 else rng.choice(["a", "B", "é", None, "", "rare"])
        rows.append((" ".join(rng.choices(words, weights, k=rng.choice([0, 1, 5, 30, 100]))), lang, source))
    rows += [rows[0]] * 5 + [(None, "en", "silent"), ("", "de", "silent"), ("lonely words", "xx", "one"), ("few words", "yy", "one"), ("", "yy", "two"), (None, "zz", None)]
    return rows


@pytest.mark.parametrize("cfg", [AuditConfig(), AuditConfig(least_docs=3, top=4, block_postings=50, merge_postings=20, pair_sums=10), AuditConfig(least_docs=1)])
def test_audit(spark, cfg):
    rows = corpus()
    table = spark.createDataFrame([(i, *r, "x", 1) for i, r in enumerate(rows)], KIND).repartition(3)
    assert sorted(map(tuple, audit(table, cfg).collect())) == by_hand(rows, cfg)


def test_many_sources(spark):
    rng = random.Random(1)
    rows = [(" ".join(rng.choices("a b c d e f g h i j k l m n o p".split(), k=6)), "en", f"s{i % 45}") for i in range(400)]
    table = spark.createDataFrame([(i, *r, "x", 1) for i, r in enumerate(rows)], KIND)
    assert sorted(map(tuple, audit(table, AuditConfig(pair_sums=100)).collect())) == by_hand(rows, AuditConfig())


def test_empty_table(spark):
    assert audit(spark.createDataFrame([], KIND)).count() == 0


def test_runs():
    one = [(b"a", 2, [("s", 3), ("t", 1)]), (b"\xc3\xa9", 1, [("t", 9)])]
    two = [(b"a", 1, [("r", 5), ("t", 2)]), (b"b", 1, [("s", 1)])]
    runs = [packed_run(r) for r in (one, two)]
    assert [r[0] for r in runs] == [3, 3] and [list(unpacked_run(*r[1:])) for r in runs] == [one, two]
    assert list(merged_runs(unpacked_run(*r[1:]) for r in runs)) == [(b"a", 3, [("r", 5), ("s", 3), ("t", 3)]), (b"b", 1, [("s", 1)]), (b"\xc3\xa9", 1, [("t", 9)])]
