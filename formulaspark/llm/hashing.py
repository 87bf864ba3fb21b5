"""Word hashes of many texts at once."""

from __future__ import annotations

import numpy as np

from .common import hash64

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: The low ``k`` bytes of a word of eight.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Longer words are hashed one by one.
_LONG = 256


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _B
    return (h ^ (h >> np.uint64(29))) * _A


def spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the words of ``data``, which begins and ends with a blank."""
    blank = _BLANK[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    return edges[::2], edges[1::2] - edges[::2]


def span_hashes(data: bytes, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of the words of ``data``, which ends with nine blanks."""
    eights = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    h = mixed(size.astype(np.uint64) * _A ^ (eights[starts] & _LOW[np.minimum(size, 8)]))
    at = 8
    active = np.flatnonzero((size > at) & (size <= _LONG))
    while len(active):
        part = eights[starts[active] + at] & _LOW[np.minimum(size[active] - at, 8)]
        h[active] = mixed(h[active] * _B ^ part)
        at += 8
        active = active[size[active] > at]
    for i in np.flatnonzero(size > _LONG).tolist():
        h[i] = hash64(data[starts[i] : starts[i] + size[i]])
    return h


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words, joined from runs of powers of two."""
    out, have, power, size = words[:0], 0, words, 1
    while size <= width <= len(words):
        if width & size:
            n = len(words) - have - size + 1
            out = mixed(out[:n] * _B + power[have : have + n]) if have else power
            have += size
        power, size = mixed(power[:-size] * _B + power[size:]), 2 * size
    return out


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and the number of words of each text.

    A-Z count as a-z; words end at ASCII white space.  Words are read eight bytes at a time.
    """
    raws = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = b" " + b" ".join(raws).lower() + b" " * 9
    starts, size = spans(data)
    sizes = np.array([len(r) + 1 for r in raws], np.int64)
    ends = np.searchsorted(starts, 1 + np.cumsum(sizes))
    h = span_hashes(data, starts, size)
    return h, np.diff(ends, prepend=0)


def word_sets(texts: list[str], width: int):
    """The distinct hashes, sorted, of each text's runs of ``width`` words; of all its words, if there are fewer."""
    words, counts = word_hashes(texts)
    h = np.full(max(0, len(words) - width + 1), width, np.uint64)
    for j in range(width):
        h = mixed(h * _B + words[j : j + len(h)])
    past = np.cumsum(counts)
    spans = list(zip((past - counts).tolist(), (past - width + 1).tolist(), strict=True))
    for start, stop in spans:
        if stop > start:
            h[start:stop].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[np.minimum(past - counts, len(h) - 1)[counts >= width]] = True
    for (start, stop), n in zip(spans, counts.tolist(), strict=True):
        if n >= width:
            yield h[start:stop][new[start:stop]]
        else:
            whole = np.full(min(n, 1), n, np.uint64)
            for j in range(n):
                whole = mixed(whole * _B + words[start + j : start + j + 1])
            yield whole
