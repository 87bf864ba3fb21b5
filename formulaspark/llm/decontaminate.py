"""Operator 1: benchmark decontamination by BM25 and block-max WAND.

Benchmark items, cut into entries of at most ``entry_words`` words, form an inverted
index whose impacts are BM25 weights divided by the entry's own BM25 score, so that
a passage with all words of an entry scores 1 or more whatever the entry's length.
Training documents are read as overlapping passages of ``2 * entry_words`` words, so
that each run of ``entry_words`` words stands whole in one of them.  Every passage is a
query: a numpy pass over many passages adds up their distinct words' greatest impacts in
each of ``coarse`` blocks of entries, and passages for which some block reaches
``threshold`` go through block-max WAND, which retrieves every entry at or above it (no
top k).  A retrieved item is a leak if enough
of the word n-grams of its question and of its answer stand in the passage and as many
words around it as the item has.  The answer is an item's last sentence, or the last
third of its words if it is one sentence.

The index is broadcast in shards of at most ``shard_chars`` characters of benchmark
text; a larger benchmark takes several passes over the documents.  Document
frequencies count all shards, so results do not depend on their number.

Items under ``short`` words are too short to be told from ordinary language within other
text: they are no entries, and leak where a document consists of their words alone.  Where their
words stand within other text, ``find_short_runs`` gives every place, so that the caller decides.

Defined results: null and empty texts have no passages, items without words no
entries; equal items each give a row; repeated documents give a row each; empty
tables give no rows.  Only ``doc_id`` and ``text``, ``item_id`` and ``text`` are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .codec import text_runs
from .common import WordCache, batched, lean, read_table, rows_of, stored, texts_of


@dataclass(frozen=True)
class LeakConfig:
    entry_words: int = 64
    threshold: float = 0.6
    overlap: float = 0.5
    gram: int = 3
    short: int = 8
    k1: float = 1.2
    b: float = 0.75
    block: int = 4
    coarse: int = 64
    shard_chars: int = 2_000_000


_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of the item up to its last sentence, and of that sentence."""
    parts = [w for w in (words_of(s) for s in re.split(r"(?<=[.!?])\s+", text)) if w]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = parts[0] if parts else []
    cut = len(words) - len(words) // 3
    return words[:cut], words[cut:]


def grams(words: list[str], n: int) -> set[tuple[str, ...]]:
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def overlap(part: list[str], seen: list[str], n: int) -> float:
    """Share of the n-grams of ``part`` that ``seen`` has too; items that are searched have some in both parts."""
    own = grams(part, n)
    n = min(n, len(part))
    return len(own & {tuple(seen[i : i + n]) for i in range(len(seen) - n + 1)}) / len(own) if own else 0.0


class Index:
    """Postings by term, in entry order, in blocks with their greatest impact."""

    def __init__(self, entries: list[tuple[int, int, list[str]]], texts: dict[int, str], items: dict[int, int], df: dict[str, int], n: int, mean: float, cfg: LeakConfig):
        # entries with the same common words stand together, which keeps block bounds low
        common = [w for w, _ in sorted(df.items(), key=lambda x: (-x[1], x[0]))[:16]]
        entries = sorted(entries, key=lambda e: ([w in e[2] for w in common], e[1]))
        self.entries, self.texts, self.items, self.cfg = entries, texts, items, cfg
        self.term: dict[str, int] = {}
        self.lists: list[list[tuple[int, float]]] = []
        for at, (_, _, words) in enumerate(entries):
            weights = {}
            for w, tf in Counter(words).items():
                idf = math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
                weights[w] = idf * tf * (cfg.k1 + 1) / (tf + cfg.k1 * (1 - cfg.b + cfg.b * len(words) / mean))
            own = sum(weights.values())
            for w, x in weights.items():
                if w not in self.term:
                    self.term[w] = len(self.lists)
                    self.lists.append([])
                self.lists[self.term[w]].append((at, x / own))
        self.most = [max(x for _, x in p) for p in self.lists]
        wide = max(1, -(-len(entries) // cfg.coarse))
        # the last row: words that no entry has
        self.bounds = np.zeros((len(self.lists) + 1, max(1, -(-len(entries) // wide))), np.float32)
        for t, postings in enumerate(self.lists):
            for at, x in postings:
                self.bounds[t, at // wide] = max(self.bounds[t, at // wide], x)
        self.whole: dict[tuple[str, ...], list[int]] = {}
        for key, text in texts.items():
            if 0 < len(words := words_of(text)) < cfg.short:
                self.whole.setdefault(tuple(words), []).append(key)
        self.blocks = [[(p[i : i + cfg.block][-1][0], max(x for _, x in p[i : i + cfg.block])) for i in range(0, len(p), cfg.block)] for p in self.lists]

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """Entries whose score over the distinct ``terms`` is at least the threshold: block-max WAND."""
        least, size, end = self.cfg.threshold - 1e-9, self.cfg.block, len(self.entries)
        at = dict.fromkeys(terms, 0)
        found = []

        def entry(t: int) -> int:
            return self.lists[t][at[t]][0] if at[t] < len(self.lists[t]) else end

        def move(t: int, target: int) -> None:
            """To the first posting at or after ``target``, block by block."""
            block = at[t] // size
            while block < len(self.blocks[t]) and self.blocks[t][block][0] < target:
                block += 1
            at[t] = max(at[t], block * size)
            while at[t] < len(self.lists[t]) and self.lists[t][at[t]][0] < target:
                at[t] += 1

        order = list(at)
        while True:
            order = sorted((t for t in order if entry(t) < end), key=entry)
            bound, pivot = 0.0, None
            for k, t in enumerate(order):
                bound += self.most[t]
                if bound >= least:
                    pivot = k
                    break
            if pivot is None:
                return found
            target = entry(order[pivot])
            while pivot + 1 < len(order) and entry(order[pivot + 1]) == target:
                pivot += 1
            bound, after = 0.0, entry(order[pivot + 1]) if pivot + 1 < len(order) else end
            for t in order[: pivot + 1]:
                block = at[t] // size
                while block < len(self.blocks[t]) and self.blocks[t][block][0] < target:
                    block += 1
                if block < len(self.blocks[t]):
                    bound += self.blocks[t][block][1]
                    after = min(after, self.blocks[t][block][0] + 1)
            if bound < least:  # no entry of these blocks can reach the threshold
                for t in order[: pivot + 1]:
                    move(t, max(after, target + 1))
                continue
            score = 0.0
            for t in order[: pivot + 1]:
                move(t, target)
                if entry(t) == target:
                    score += self.lists[t][at[t]][1]
                    at[t] += 1
            if score >= least:
                found.append((target, score))


_LEAKS = pa.schema(
    [("doc_id", pa.int64()), ("item_id", pa.int64()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())]
)
_KIND = "doc_id long, item_id long, first_word long, n_words long, score double, question_overlap double, answer_overlap double"


def passages(lengths: list[int], half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, first and past-last words (within the document) of all passages."""
    lengths = np.array(lengths, np.int64)
    each = np.where(lengths > 0, np.maximum(1, -(-(lengths - half) // half)), 0)
    doc = np.repeat(np.arange(len(lengths)), each)
    first = (np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)) * half
    return doc, first, np.minimum(first + 2 * half, lengths[doc])


def hopeful(terms: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, least: float) -> np.ndarray:
    """Which of the passages [start, end) of ``terms`` have a block bound of ``least`` or more."""
    none, out = len(bounds) - 1, np.zeros(len(starts), bool)
    for at in range(0, len(starts), 512):
        size = (ends - starts)[at : at + 512]
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts[at : at + 512], size)
        own = terms[place]
        pairs = np.unique((np.repeat(np.arange(len(size)), size) * (none + 1) + own)[own < none])
        if len(pairs):
            passage = pairs // (none + 1)
            first = np.flatnonzero(np.diff(passage, prepend=-1))
            sums = np.add.reduceat(bounds[pairs % (none + 1)], first, axis=0)
            out[at + passage[first]] = sums.max(1) >= least - 1e-3
    return out


def _scan(shared, cfg: LeakConfig):
    def scan(batches):
        index: Index = shared.value
        none, parts = len(index.lists), {}
        known = WordCache(lambda w: index.term.get(w, none))
        searched: dict[tuple[int, ...], list[tuple[int, float]]] = {}
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for start, texts in text_runs(batch.column("text")):
                words = [words_of(t) for t in texts]
                lengths = [len(w) for w in words]
                terms = np.fromiter((known[w] for own in words for w in own), np.int64, sum(lengths))
                begins = np.cumsum(lengths) - lengths
                doc, first, last = passages(lengths, cfg.entry_words)
                best: dict[tuple[int, int], tuple] = {}
                for p in np.flatnonzero(hopeful(terms, begins[doc] + first, begins[doc] + last, index.bounds, cfg.threshold)):
                    d, a, b = int(doc[p]), int(first[p]), int(last[p])
                    own = tuple(np.unique(terms[begins[d] + a : begins[d] + b]).tolist())
                    own = own[:-1] if own[-1] == none else own
                    if own not in searched:
                        if len(searched) > 20_000:
                            searched.clear()
                        searched[own] = index.search(list(own))
                    for entry, score in searched[own]:
                        item, key, _ = index.entries[entry]
                        if key not in parts:
                            parts[key] = question_answer(index.texts[key])
                        question, answer = parts[key]
                        size = len(question) + len(answer)
                        around = words[d][max(0, a - size) : b + size]
                        q, s = overlap(question, around, cfg.gram), overlap(answer, around, cfg.gram)
                        if q >= cfg.overlap and s >= cfg.overlap and ((d, key) not in best or score > best[d, key][4]):
                            best[d, key] = (ids[start + d], item, a, b - a, score, q, s)
                for d, own in enumerate(words):
                    if 0 < len(own) < cfg.short:
                        for key in index.whole.get(tuple(own), ()):
                            best[d, key] = (ids[start + d], index.items[key], 0, len(own), 1.0, 1.0, 1.0)
                yield from best.values()

    return scan


def find_leaks(docs: DataFrame, items: DataFrame, cfg: LeakConfig = LeakConfig()) -> DataFrame:
    """One row per document and leaked item, with the best passage's place, score and overlaps."""
    spark = docs.sparkSession

    def cut(batches):
        for item, key, text in rows_of(batches, "item_id", "key", "text"):
            words = words_of(text)
            for at in range(0, len(words) if len(words) >= cfg.short else 0, cfg.entry_words):
                yield item, key, words[at : at + cfg.entry_words]

    kept = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kept = stored(kept.withColumn("key", F.monotonically_increasing_id()), "leak-items")
    schema = pa.schema([("item_id", pa.int64()), ("key", pa.int64()), ("words", pa.list_(pa.string()))])
    entries = stored(kept.mapInArrow(lambda b: batched(cut(b), schema), "item_id long, key long, words array<string>"), "leak-entries")
    total = entries.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean")).first()
    size = kept.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    frequency = entries.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    shards, found = max(1, -(-size // cfg.shard_chars)), None
    for shard in range(shards):
        mine = F.pmod(F.xxhash64("key"), F.lit(shards)) == shard
        own = entries.where(mine).collect()  # at most about shard_chars characters
        used = entries.where(mine).select(F.explode("words").alias("word")).distinct()
        df = {r["word"]: r["df"] for r in frequency.join(used, "word", "left_semi").collect()}
        held = kept.where(mine).collect()
        texts, names = {r["key"]: r["text"] for r in held}, {r["key"]: r["item_id"] for r in held}
        index = Index([(r["item_id"], r["key"], r["words"]) for r in own], texts, names, df, total["n"], total["mean"] or 1.0, cfg)
        scan = _scan(spark.sparkContext.broadcast(index), cfg)
        leaks = texts_of(docs).mapInArrow(lean(lambda b, scan=scan: batched(scan(b), _LEAKS)), _KIND)
        found = leaks if found is None else found.union(leaks)
    return found


_RUNS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("first_word", pa.int64()), ("n_words", pa.int64())])


def find_short_runs(docs: DataFrame, items: DataFrame, cfg: LeakConfig = LeakConfig()) -> DataFrame:
    """``doc_id, item_id, first_word, n_words``: every run of a document's words that equals all words
    of an item under ``short`` words.  Such items are broadcast in shards as those of ``find_leaks`` are."""
    spark = docs.sparkSession
    kept = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def brief(batches):
        for item, text in rows_of(batches, "item_id", "text"):
            if 0 < len(words := words_of(text)) < cfg.short:
                yield item, words

    schema = pa.schema([("item_id", pa.int64()), ("words", pa.list_(pa.string()))])
    kept = stored(kept.mapInArrow(lambda b: batched(brief(b), schema), "item_id long, words array<string>"), "leak-short")
    size = kept.agg(F.sum(F.length(F.array_join("words", " "))).alias("n")).first()["n"] or 0
    shards, found = max(1, -(-size // cfg.shard_chars)), None
    for shard in range(shards):
        held: dict[str, dict[tuple[str, ...], list]] = {}
        for r in kept.where(F.pmod(F.xxhash64("words"), F.lit(shards)) == shard).collect():  # at most about shard_chars characters
            held.setdefault(r["words"][0], {}).setdefault(tuple(r["words"]), []).append(r["item_id"])
        shared = spark.sparkContext.broadcast(held)

        def scan(batches, shared=shared):
            starts = shared.value
            for doc_id, text in rows_of(batches, "doc_id", "text"):
                words = words_of(text)
                for at, word in enumerate(words):
                    for run, ids in starts.get(word, {}).items():
                        if len(run) == 1 or tuple(words[at : at + len(run)]) == run:
                            for item in ids:
                                yield doc_id, item, at, len(run)

        runs = texts_of(docs).mapInArrow(lambda b, scan=scan: batched(scan(b), _RUNS), "doc_id long, item_id long, first_word long, n_words long")
        found = runs if found is None else found.union(runs)
    return found


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
