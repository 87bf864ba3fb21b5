"""Operator 2: secrets by fixed patterns and by two character Markov models.

Base spans come from three patterns: assignments of 12 or more value characters,
access keys of 18 or more and hexadecimal runs of 16 or more.  The method adds spans
of kind ``markov``: runs of ``shortest`` or more token characters, apart from base spans
and not inside a longer word, whose log-likelihood under a model of random strings
exceeds that under a model of ordinary identifiers by ``evidence`` nats in all and
``per_char`` a character.  Both are first-order Markov models over ASCII, trained on labelled
samples from the whole corpus (``samples``).  Labelled random are the secret values of base
spans and, for each document, a string drawn from one of four alphabets.  Labelled ordinary
are other runs of ``shortest_sample`` or more token characters and, for each document, an
identifier with digits that is composed of such runs as programs name things: snake, camel
or kebab case, or a path.  Runs that have digits and could be spans themselves carry no label.
Tasks send on their transition counts, at most (alphabet squared) rows; random strings
start from a prior of ``prior`` uniform transitions between letters and digits, so that
a corpus without documents still has a model.

Places are code points, ends are exclusive.  Defined results: null and empty texts
have no spans; repeated rows give a row each; an empty table gives no rows.  Only
``doc_id`` and ``text`` are read; ``redact`` keeps all columns.
"""

from __future__ import annotations

import random
import re
import string
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, batched, lean, read_table, rows_of, texts_of


@dataclass(frozen=True)
class SecretConfig:
    shortest: int = 20
    shortest_sample: int = 8
    evidence: float = 14.0
    per_char: float = 0.5
    prior: float = 2.0
    smooth: float = 0.1


KINDS = ("assign", "access", "hex", "markov")


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_ASSIGN = re.compile(
    "(" + "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|" + _either("api") + "_?" + _either("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
#: A run fails only as a whole, so asking for the least length finds the same ones.
_HEX = re.compile(r"[0-9a-f]{16,}")
_DIGIT = re.compile(rb"[0-9]")
_TOKEN = string.ascii_letters + string.digits + "+/_=-"
_HEX_ONLY = bytes(120 if chr(i) in "0123456789abcdef" else 32 for i in range(256))
_TOKEN_ONLY = bytes(i if chr(i) in _TOKEN else 32 for i in range(256))


def base_spans(text: str, raw: bytes | None = None) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted.  Patterns only run where a plain search allows a match."""
    raw = text.encode("utf-8", "surrogatepass") if raw is None else raw
    low, found = raw.lower(), []
    if any(hint in low for hint in (b"passw", b"secret", b"token", b"apikey", b"api_key")):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    if b"x" * 16 in raw.translate(_HEX_ONLY):
        found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def free_runs(raw: bytes, least: int) -> list[bytes]:
    """Runs of at least ``least`` token characters."""
    return [w for w in raw.translate(_TOKEN_ONLY).split() if len(w) >= least]


def _codes(strings: list[bytes]) -> np.ndarray:
    """ASCII codes, with 0 before, between and after the strings."""
    return np.frombuffer(b"\0" + b"\0".join(strings) + b"\0", np.uint8).astype(np.int64)


#: What random strings consist of: base 62, 64 for URLs, 32 and upper-case hexadecimal.
ALPHABETS = (string.ascii_letters + string.digits, string.ascii_letters + string.digits + "-_", string.ascii_uppercase + "234567", "0123456789ABCDEF")


def random_string(seed: int) -> str:
    draw = random.Random(seed)
    return "".join(draw.choices(ALPHABETS[seed & 3], k=draw.randint(20, 64)))


def composed(runs: list[bytes], seed: int) -> str:
    """An identifier of three of the runs, with a count, a date or a version."""
    a, b, c = (runs[(seed >> k) % len(runs)].decode().strip("+/_=-").lower() for k in (0, 7, 13))
    n = seed >> 5 & 0xFFFF
    forms = (f"{a}_{b}_{n}", f"{a}{b.title()}{c.title()}{n % 100}", f"{a}-{b}-{1970 + n % 80}-{n % 12 + 1:02}-{n % 28 + 1:02}", f"/{a}/{b}/v{n % 10}/{c}{n % 1000}")
    return forms[seed >> 3 & 3]


def samples(text: str, raw: bytes, cfg: SecretConfig) -> tuple[list[bytes], list[bytes]]:
    """The ordinary and the random samples of a text."""
    seed, spans, drawn = zlib.crc32(raw), base_spans(text, raw), []
    if spans:
        drawn = [(_ASSIGN.match(text, s)[2] if k == 0 else text[s:e]).encode() for s, k, e in spans]
        raw = covered(text, spans, " ").encode("utf-8", "surrogatepass")
    runs = free_runs(raw, cfg.shortest_sample)
    plain = [w for w in runs if not _DIGIT.search(w)]
    usual = [w for w in runs if len(w) < cfg.shortest or not _DIGIT.search(w)]
    return [*usual, composed(plain, seed).encode()] if plain else usual, [*drawn, random_string(seed).encode()]


def transition_counts(docs: DataFrame, cfg: SecretConfig) -> dict[int, np.ndarray]:
    """Transitions of ordinary (0) and random (1) strings over the whole corpus."""

    def count(batches):
        totals = np.zeros((2, 128 * 128), np.int64)
        for batch in batches:
            held: tuple[list[bytes], list[bytes]] = ([], [])
            n = 0

            def flush(held=held):
                for k, strings in enumerate(held):
                    if strings:
                        c = _codes(strings)
                        totals[k] += np.bincount(c[:-1] * 128 + c[1:], minlength=128 * 128)
                        strings.clear()

            for text in batch.column("text").to_pylist():
                if text:
                    ordinary, drawn = samples(text, text.encode("utf-8", "surrogatepass"), cfg)
                    held[0].extend(ordinary)
                    held[1].extend(drawn)
                n += len(text)
                if n > 1_000_000:
                    flush()
                    n = 0
            flush()
        for k in (0, 1):
            at = np.flatnonzero(totals[k])
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(totals[k][at])], ["k", "at", "n"])

    with arrow_rows(docs.sparkSession, 1000):
        sums = texts_of(docs).select("text").mapInArrow(lean(count), "k long, at long, n long").groupBy("k", "at").agg(F.sum("n").alias("n")).collect()
    out = {k: np.zeros(128 * 128) for k in (0, 1)}
    for r in sums:
        out[r["k"]][r["at"]] = r["n"]
    return out


def log_ratios(counts: dict[int, np.ndarray], cfg: SecretConfig) -> np.ndarray:
    """log P(next | character) of random strings less that of ordinary ones, 128 x 128."""
    prior = np.zeros((128, 128))
    usual = [0, *map(ord, string.ascii_letters + string.digits)]
    prior[np.ix_(usual, usual)] = cfg.prior
    logs = []
    for k in (0, 1):
        table = counts[k].reshape(128, 128) + cfg.smooth + (prior if k else 0)
        logs.append(np.log(table / table.sum(1, keepdims=True)))
    return logs[1] - logs[0]


def markov_spans(text: str, raw: bytes, spans: list[tuple[int, int, int]], ratios: np.ndarray, cfg: SecretConfig):
    if not free_runs(raw, cfg.shortest):
        return
    for m in re.finditer(f"[{re.escape(_TOKEN)}]{{{cfg.shortest},}}", text):
        inside = text[max(0, m.start() - 1) : m.start()].isalnum() or text[m.end() : m.end() + 1].isalnum()
        if inside or any(s < m.end() and m.start() < e for s, _, e in spans):
            continue
        c = _codes([m[0].encode()])
        ratio = float(ratios[c[:-1], c[1:]].sum())
        if ratio >= cfg.evidence and ratio >= cfg.per_char * len(m[0]):
            yield m.start(), 3, m.end()


def all_spans(text: str, ratios: np.ndarray, cfg: SecretConfig):
    """Base spans, and those with the method's added, both sorted."""
    raw = text.encode("utf-8", "surrogatepass")
    base = base_spans(text, raw)
    return base, sorted([*base, *markov_spans(text, raw, base, ratios, cfg)])


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


_FOUND = pa.schema([("doc_id", pa.int64()), ("base", pa.string()), ("spans", pa.string()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("clean", pa.string())])


def find_secrets(docs: DataFrame, cfg: SecretConfig = SecretConfig(), mark: str | None = None) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base, spans`` of each row of ``docs``, and in ``clean``
    the text with ``mark`` in the place of all that spans cover (null without ``mark``)."""
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(transition_counts(docs, cfg), cfg))

    def find(batches):
        for doc_id, text in rows_of(batches, "doc_id", "text"):
            base, spans = all_spans(text, ratios.value, cfg)
            kinds = [k for _, k, _ in base]
            yield doc_id, joined(base), joined(spans), kinds.count(0), kinds.count(1), kinds.count(2), None if mark is None else covered(text, spans, mark)

    kind = "doc_id long, base string, spans string, n_assign long, n_access long, n_hex long, clean string"
    return texts_of(docs).mapInArrow(lean(lambda b: batched(find(b), _FOUND, 1024)), kind)


def covered(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """``text`` with ``mark`` for each run that spans cover."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, cfg: SecretConfig = SecretConfig(), mark: str = "[secret]") -> DataFrame:
    """``docs`` with secrets in ``text`` replaced; texts without any stay as they are, as do all other columns."""
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))  # names of any kind, dots included
    at = names.index("text")
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(transition_counts(docs, cfg), cfg))

    def clean(batches):
        for batch in batches:
            out = []
            for text in batch.column(at).to_pylist():
                if text:
                    _, spans = all_spans(text, ratios.value, cfg)
                    text = covered(text, spans, mark) if spans else text
                out.append(text)
            yield batch.set_column(at, f"c{at}", pa.array(out, pa.string()))

    return plain.mapInArrow(lean(clean), plain.schema).toDF(*names)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base"), 256).alias("base_sha256"), "spans")
