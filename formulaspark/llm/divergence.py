"""Operator 13: divergence of sources from their language, by single-pass in-memory indexing.

Terms are runs of letters A-Z (as a-z) and characters beyond ASCII.  Each task reads its documents once
and counts postings in memory: by language, term and source the occurrences, by language
and term the documents.  When ``block_postings`` are held the block is spilled as *runs*, one for each
language and hash shard, sorted by term.  A shard's task merges its runs by a heap into
frequencies and drops terms in fewer than ``least_docs`` documents.  Runs wait in compressed form; where they
grow beyond ``merge_postings`` they are merged into one, which holds each posting of the shard once.

With ``N`` the sum of a group's counts and ``V`` the number of kept terms of its language, a term
that occurs ``c`` times there has ``p = 1 + floor(1000000000 * (c + 2) / (N + 2 * V))``, also where c is 0.
The divergence of two values is ``f = floor((p - q) * (p - q) / (p + q))``.  For a pair of
sources ``f`` is summed over all V terms without visiting those that are in neither source:

    V * f(p0, q0)                                      as if both held no term,
  + sum of f(p, q0) - f(p0, q0)  over terms of one,    from a histogram of its values p,
  + the same for the other,
  + f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)          streamed, over terms that both hold.

The last part reads postings in order of term and adds up pairs in memory, at most ``pair_sums``
sums at a time; only these sums are handed on.  ``f`` is the same both ways, so each pair is summed once.  A histogram has at most
``sqrt(2 * N)`` different values.

Defined results: null text, lang and source are ''; a group without terms, and a language without
kept terms (its pairs have value 0), count as any other; a source that is alone in its language has no
pairs; an empty table gives no rows.  Only ``text``, ``lang`` and ``source`` are read.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batched, lean, read_table, rows_of, stored

_A_Z = bytes(range(65, 91))
#: ASCII letters as a-z, bytes of other characters as they are, all else blank.
_FOLD = bytes(c + 32 if c in _A_Z else c if c >= 128 or 97 <= c < 123 else 32 for c in range(256))


@dataclass(frozen=True)
class AuditConfig:
    least_docs: int = 10
    top: int = 10
    block_postings: int = 400_000
    merge_postings: int = 2_000_000
    pair_sums: int = 1_000_000


_RUN = pa.schema([("shard", pa.int32()), ("lang", pa.string()), ("n", pa.int64()), ("terms", pa.binary()), ("sources", pa.list_(pa.string())), ("numbers", pa.binary())])
_RUN_KIND = "shard int, lang string, n long, terms binary, sources array<string>, numbers binary"
_FREQUENCY = pa.schema([("lang", pa.string()), ("term", pa.string()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
_FREQUENCY_KIND = "lang string, term string, sources array<string>, counts array<long>"


def packed_run(postings: list[tuple[bytes, int, list[tuple[str, int]]]]) -> tuple[int, bytes, list[str], bytes]:
    """A run of ``(term, documents, [(source, count)])``, sorted by term, as columns."""
    sources = sorted({s for _, _, own in postings for s, _ in own})
    code = {s: i for i, s in enumerate(sources)}
    documents, sizes = [p[1] for p in postings], [len(p[2]) for p in postings]
    flat = [x for _, _, own in postings for s, c in own for x in (code[s], c)]
    numbers = np.array([len(postings), *documents, *sizes, *flat], np.int64)
    return sum(sizes), b" ".join(p[0] for p in postings), sources, zlib.compress(numbers.tobytes(), 1)


def unpacked_run(terms: bytes, sources: list[str], numbers: bytes):
    """The postings of a run, one by one."""
    values = np.frombuffer(zlib.decompress(numbers), np.int64)
    n = int(values[0])
    flat, at = values[1 + 2 * n :].tolist(), 0
    for term, documents, size in zip(terms.split(b" "), values[1 : 1 + n].tolist(), values[1 + n : 1 + 2 * n].tolist(), strict=True):
        yield term, documents, [(sources[flat[k]], flat[k + 1]) for k in range(at, at + 2 * size, 2)]
        at += 2 * size


def merged_runs(runs):
    """One run of several: equal terms add up, by a heap over the heads of the runs."""
    for term, same in groupby(heapq.merge(*runs, key=itemgetter(0)), itemgetter(0)):
        documents, counts = 0, Counter()
        for _, n, own in same:
            documents += n
            for source, count in own:
                counts[source] += count
        yield term, documents, sorted(counts.items())


def index(shards: int, cfg: AuditConfig):
    """Runs of a task's documents."""

    def spilled(documents: dict[str, Counter], counts: dict[tuple[str, str], Counter]):
        postings: dict[str, dict[bytes, list]] = {lang: {term: [] for term in own} for lang, own in documents.items()}
        for (lang, source), own in sorted(counts.items()):
            by_term = postings[lang]
            for term, count in own.items():
                by_term[term].append((source, count))
        for lang, own_documents in documents.items():
            parts: dict[int, list] = {}
            for term in sorted(own_documents):
                parts.setdefault(zlib.crc32(term) % shards, []).append((term, own_documents[term], postings[lang].pop(term)))
            for shard, own in parts.items():
                yield shard, lang, *packed_run(own)

    def run(batches):
        documents: dict[str, Counter] = {}
        counts: dict[tuple[str, str], Counter] = {}
        held = 0
        for lang, source, text in rows_of(batches, "lang", "source", "text"):
            terms = text.encode("utf-8", "surrogatepass").translate(_FOLD).split()
            if not terms:
                continue
            own, own_documents = counts.setdefault((lang, source), Counter()), documents.setdefault(lang, Counter())
            held -= len(own) + len(own_documents)
            own.update(terms)
            own_documents.update(set(terms))
            held += len(own) + len(own_documents)
            if held >= cfg.block_postings:
                yield from spilled(documents, counts)
                documents, counts, held = {}, {}, 0
        yield from spilled(documents, counts)

    return lean(lambda batches: batched(run(batches), _RUN, 256))


def frequencies(cfg: AuditConfig):
    """Kept terms of a shard's runs, which come by language."""

    def run(batches):
        for lang, own in groupby(rows_of(batches, "lang", "n", "terms", "sources", "numbers"), itemgetter(0)):
            held, size, limit = [], 0, cfg.merge_postings
            for _, n, *packed in own:
                held.append(packed)
                size += n
                if size >= limit:
                    size, *packed = packed_run(list(merged_runs(unpacked_run(*p) for p in held)))
                    held, limit = [packed], max(limit, 2 * size)
            for term, documents, counts in merged_runs(unpacked_run(*p) for p in held):
                if documents >= cfg.least_docs:
                    yield lang, term.decode("utf-8", "surrogatepass"), [s for s, _ in counts], [c for _, c in counts]

    return lean(lambda batches: batched(run(batches), _FREQUENCY, 1024))


def kept_terms(docs: DataFrame, cfg: AuditConfig) -> DataFrame:
    """``lang, term, sources, counts`` of the terms that each language keeps."""
    shards = max(16, docs.rdd.getNumPartitions())
    runs = docs.mapInArrow(index(shards, cfg), _RUN_KIND)
    return stored(runs.repartitionById(shards, "shard").sortWithinPartitions("lang").mapInArrow(frequencies(cfg), _FREQUENCY_KIND), "audit-terms")


def share(count, total, terms):
    """p of a term with ``count`` occurrences of ``total`` among ``terms``; null if there are no terms."""
    return F.expr(f"cast(1 + cast(1000000000 as decimal(12,0)) * cast({count} + 2 as decimal(20,0)) div nullif(cast({total} as decimal(20,0)) + 2 * {terms}, 0) as long)")


def difference(p, q):
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q}))")


def _f(p, q):
    d = p - q
    return d * d // (p + q)


_PAIRS = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("value", pa.int64())])
_PAIRS_KIND = "lang string, a string, b string, value long"


def corrections(cfg: AuditConfig, rows: int = 1024):
    """Sums over the terms that both of two sources hold, from postings in order of language and term."""

    def run(batches):
        for lang, own in groupby(rows_of(batches, "lang", "term", "source", "p", "p0"), itemgetter(0)):
            names: dict[str, int] = {}
            pairs, values, size = [], [], 0

            def summed():
                code, inverse = np.unique(np.concatenate(pairs), return_inverse=True)
                total = np.zeros(len(code), np.int64)
                np.add.at(total, inverse, np.concatenate(values))
                return code, total

            def out(code, total):
                by = list(names)
                for c, t in zip(code.tolist(), total.tolist(), strict=True):
                    yield lang, by[c >> 32], by[c & 0xFFFFFFFF], t

            for _, same in groupby(own, itemgetter(1)):
                held = [(names.setdefault(source, len(names)), p, p0) for _, _, source, p, p0 in same]
                held.sort()
                who, p, p0 = np.array(held, np.int64).T
                for at in range(0, len(who), rows):
                    # the pairs of some sources with all later ones
                    i, j = np.nonzero(np.arange(at, min(at + rows, len(who)))[:, None] < np.arange(len(who))[None, :])
                    i += at
                    pairs.append(who[i] << 32 | who[j])
                    values.append(_f(p[i], p[j]) - _f(p[i], p0[j]) - _f(p0[i], p[j]) + _f(p0[i], p0[j]))
                    size += len(i)
                    if size >= cfg.pair_sums:
                        code, total = summed()
                        if len(code) * 2 >= cfg.pair_sums:
                            yield from out(code, total)
                            pairs, values, size = [], [], 0
                        else:
                            pairs, values, size = [code], [total], len(code)
            if size:
                yield from out(*summed())

    return lean(lambda batches: batched(run(batches), _PAIRS, 4096))


def audit(docs: DataFrame, cfg: AuditConfig = AuditConfig(), salts: int = 8) -> DataFrame:
    """``lang, source, part, item, value, rank``: pairs of sources, and the terms that a source has most in excess."""
    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    terms = kept_terms(plain, cfg)
    each = terms.select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("x")).select("lang", "term", F.col("x.sources").alias("source"), F.col("x.counts").alias("c"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum(F.expr("aggregate(counts, 0L, (s, x) -> s + x)")).alias("n_lang"))
    sums = each.groupBy("lang", "source").agg(F.sum("c").alias("n"))
    groups = plain.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["n", "v", "n_lang"])
    groups = stored(groups.withColumn("p0", share("0", "n", "v")), "audit-groups")

    # postings with p in the group and q in the language
    whole = terms.select("lang", "term", "sources", "counts", F.expr("aggregate(counts, 0L, (s, x) -> s + x)").alias("c_lang"))
    postings = whole.select("lang", "term", "c_lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).select("lang", "term", "c_lang", F.col("x.sources").alias("source"), F.col("x.counts").alias("c"))
    postings = postings.join(groups, ["lang", "source"]).select("lang", "source", "term", share("c", "n", "v").alias("p"), share("c_lang", "n_lang", "v").alias("q"), "p0")
    postings = stored(postings, "audit-postings")

    over = postings.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), difference("p", "q").alias("value"))
    ranked = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    top = over.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= cfg.top)

    # what a source's own terms add to a pair with any other: its values p, each with its number of terms
    marks = postings.groupBy("lang", "source", "p").agg(F.count("*").alias("m")).groupBy("lang", "source").agg(F.collect_list(F.struct("p", "m")).alias("marks"))
    one = groups.join(marks, ["lang", "source"], "left").withColumn("salt", F.pmod(F.xxhash64("source"), F.lit(salts)).cast("int"))
    other = groups.select("lang", F.col("source").alias("b"), F.col("p0").alias("q0"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    both = one.join(other, ["lang", "salt"]).where("source <> b")
    base = F.when(F.col("source") < F.col("b"), F.col("v") * difference("p0", "q0")).otherwise(F.lit(0))
    step = "aggregate(marks, 0L, (s, x) -> s + x.m * ((x.p - q0) * (x.p - q0) div (x.p + q0) - (p0 - q0) * (p0 - q0) div (p0 + q0)))"
    a, b = F.least("source", "b").alias("a"), F.greatest("source", "b").alias("b")
    singles = both.select("lang", a, b, (F.coalesce(base, F.lit(0)) + F.coalesce(F.expr(step), F.lit(0))).alias("value"))
    ordered = postings.select("lang", "term", "source", "p", "p0").repartition("lang", "term").sortWithinPartitions("lang", "term")
    joint = ordered.mapInArrow(corrections(cfg), _PAIRS_KIND).select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "value")
    pairs = singles.union(joint).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    sides = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x")
    pairs = pairs.select("lang", "value", sides).select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    return pairs.withColumn("rank", F.row_number().over(ranked)).union(top)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read_table(spark, sf_dir, "documents"))


SQL = r"""
with docs as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents),
toks as (select r, lang, source, unnest(ts) as term from docs),
cnt as materialized (select r, lang, source, term, count(*) as c from toks group by all),
kept as materialized (select lang, term, sum(c) as c from cnt group by lang, term having count(*) >= 10),
by_group as materialized (select lang, source, term, sum(c) as c from cnt semi join kept using (lang, term) group by all),
langs as (select lang, count(*) as v, sum(c) as n from kept group by lang),
groups as materialized (select g.lang, g.source, coalesce(l.v, 0) as v, coalesce(l.n, 0) as n_lang, coalesce((select sum(c) from by_group b where b.lang = g.lang and b.source = g.source), 0) as n
  from (select distinct lang, source from docs) g left join langs l using (lang)),
full_ as materialized (select g.lang, g.source, k.term, coalesce(b.c, 0) as c,
  cast(1 + (1000000000::hugeint * (coalesce(b.c, 0) + 2)) // (g.n + 2 * g.v) as bigint) as p,
  cast(1 + (1000000000::hugeint * (k.c + 2)) // (g.n_lang + 2 * g.v) as bigint) as q
  from groups g join kept k using (lang) left join by_group b using (lang, source, term)),
pairs as (select x.lang, x.source, y.source as item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) as value from full_ x join full_ y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all),
all_pairs as (select x.lang, x.source, 'pair' as part, y.source as item, coalesce(p.value, 0) as value from groups x join groups y on x.lang = y.lang and x.source <> y.source
  left join pairs p on p.lang = x.lang and p.source = x.source and p.item = y.source),
terms as (select lang, source, 'term' as part, term as item, (p - q) * (p - q) // (p + q) as value from full_ where c > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from all_pairs union all select * from terms))
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank from ranked where part = 'pair' or rank <= 10
"""
