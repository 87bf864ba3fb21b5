"""Texts to token ids with the ``tokenizers`` library, each distinct chunk once.

A text is cut before every single blank or line end that stands between two
printable ASCII or Latin characters.  No pre-token of the tokenizers used here
crosses such a place, so the ids of a text are those of its chunks in order.  Chunks that were
met before come from a cache of bounded size.  A new chunk that is one Latin
word, perhaps with signs after it, goes to the tokenizer's model directly, with
the letters that its own byte-level step gives; any other new chunk goes through
the whole tokenizer, as do whole texts if the tokenizer is of another kind than these.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

_SIDE = "!-~À-ɏ"
#: A blank or line end that is not safe to cut at, and a blank that is.
_UNSAFE = re.compile(rf"[ \n](?:(?<![{_SIDE}][ \n])|(?![{_SIDE}]))")
_SAFE = re.compile(rf"(?<=[{_SIDE}]) (?=[{_SIDE}])")
#: Letters of words that need no more than the model.
_LETTERS = "".join(c for c in map(chr, [*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]) if c.isalpha())
#: Such a word with signs after it; the tokenizers take a run of signs for itself.
_WORD = re.compile(rf"(\n?)([{_LETTERS}]{{1,48}})([!-&(-/:-@\[-`{{-~]{{0,8}})")


class _Known(dict):
    """chunk -> ids; what is not there comes from ``older`` or is learned, and stays unless it is long."""

    def __init__(self, learn, older: dict, longest: int):
        super().__init__()
        self.learn, self.older, self.longest = learn, older, longest

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.pop(chunk, None) or self.learn(chunk)
        if len(chunk) <= self.longest:
            self[chunk] = ids
        return ids


class ChunkEncoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, limit: int = 300_000, longest: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        self.limit, self.longest = limit, longest
        self.known = _Known(self._learn, {}, longest)
        self.signs: dict[str, bytes] = {}
        self.model = self.plain.model
        self.four = [np.array([i], "<u4").tobytes() for i in range(self.plain.get_vocab_size(with_added_tokens=True))]
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.line = self._alone("\n")
        # how a letter looks to the model, and what stands for the blank before a word
        self.letters = {ord(c): "".join(p for p, _ in self.plain.pre_tokenizer.pre_tokenize_str(c)) for c in _LETTERS}
        normal = {n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])}
        if not spec["normalizer"] and spec["pre_tokenizer"]["type"] == "ByteLevel" and not spec["pre_tokenizer"]["add_prefix_space"]:
            self.lead, self.lower = self.plain.pre_tokenizer.pre_tokenize_str(" a")[0][0][:-1], False
        elif normal == {"NFC", "Replace", "Lowercase"} and spec["model"]["end_of_word_suffix"]:
            self.lead, self.lower = "", True
        else:
            self.lead, self.lower = None, False

    @staticmethod
    def chunks(text: str) -> list[str]:
        """The first as it stands; others without the blank before them, or from a line end on."""
        return _SAFE.split(text) if _UNSAFE.search(text) else text.replace("\n", " \n").split(" ")

    def _alone(self, text: str) -> bytes:
        return np.array(self.plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, chunk: str) -> bytes:
        m = _WORD.fullmatch(chunk) if self.lead is not None else None
        if not m:
            return self._alone(chunk if chunk[0] == "\n" else " " + chunk)
        line, word, signs = m.groups()
        seen = (word.lower() if self.lower else word).translate(self.letters)
        ids = b"".join([self.four[t.id] for t in self.model.tokenize(seen if line else self.lead + seen)])
        if line:
            ids = self.line + ids
        if signs:
            if signs not in self.signs:
                self.signs[signs] = self._alone(signs)
            ids += self.signs[signs]
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.lead is None:  # a tokenizer of another kind: nothing is known of where it may be cut
            return [np.array(e.ids, "<u4").tobytes() for e in self.plain.encode_batch(texts, add_special_tokens=False)]
        split = [self.chunks(t) for t in texts]
        if len(self.known) > self.limit:  # what is not met again before the next time goes
            self.known = _Known(self._learn, dict(self.known), self.longest)
        get = self.known.__getitem__
        heads = [e.ids for e in self.plain.encode_batch([p[0] for p in split], add_special_tokens=False)]
        return [np.array(h, "<u4").tobytes() + b"".join(map(get, p[1:])) for h, p in zip(heads, split, strict=True)]


@lru_cache(maxsize=2)
def encoder(path: str, limit: int = 300_000) -> ChunkEncoder:
    """One encoder for all tasks of a worker, so that its cache lives on."""
    return ChunkEncoder(path, limit)


def text_runs(column, chars: int = 500_000):
    """Runs of a column of texts with about ``chars`` characters each: start and texts."""
    start, held, size = 0, [], 0
    for at in range(0, len(column), 256):
        for text in column.slice(at, 256).to_pylist():
            held.append(text)
            size += len(text)
            if size >= chars:
                yield start, held
                start, held, size = start + len(held), [], 0
    if held:
        yield start, held
