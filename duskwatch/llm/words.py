"""Vectorised word hashes for use inside tasks.

Words are runs of bytes other than space and 0x09-0x0D. A word's hash is a polynomial
over random 64-bit values of its bytes, followed by a mixing step; all words of a batch
are hashed by one running sum, so the cost is a few nanoseconds a byte. Hashes depend on
the word and a seed alone, never on the process.
"""

from __future__ import annotations

import hashlib

import numpy as np

#: Bytes hashed in one go; bounds the memory of a task, not the length of a text.
PIECE = 1 << 19
#: Longer words, in bytes, are hashed by themselves with BLAKE2. A polynomial modulo 2^64 maps some words of equal length to one
#: value whatever its base, from 1,024 letters on; none is used on so many.
LONG_WORD = 1 << 8

_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E6C63D0876A9A47
_INVERSE = pow(_BASE, -1, 1 << 64)
_cache: dict = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _table(seed: int) -> np.ndarray:
    if ("t", seed) not in _cache:
        start = np.arange(1, 257, dtype=np.uint64) + np.uint64(1000 * (seed + 1))
        _cache["t", seed] = mix(mix(start * np.uint64(0x9E3779B97F4A7C15)) + np.uint64(seed))
    return _cache["t", seed]


def _powers(n: int, base: int) -> np.ndarray:
    got = _cache.get(("p", base))
    if got is None or len(got) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        got = _cache["p", base] = np.multiply.accumulate(steps)
    return got[:n]


def _sums(values: np.ndarray) -> np.ndarray:
    total = np.empty(len(values) + 1, np.uint64)
    total[0] = 0
    np.cumsum(values * _powers(len(values), _BASE), out=total[1:])
    return total


class Sequence:
    """Hashes of all subsequences of a sequence of hashes."""

    def __init__(self, hashes: np.ndarray):
        self.total = _sums(hashes)
        self.back = _powers(len(self.total), _INVERSE)

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the elements from ``start`` up to, not including, ``end``."""
        value = (self.total[end] - self.total[start]) * self.back[start]
        return mix(value + (end - start).astype(np.uint64))


def _cut(data: bytes):
    """Pieces of a text that end at white space, of PIECE bytes unless a word is longer."""
    while len(data) > PIECE:
        at = max(data.rfind(c, 0, PIECE) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if at <= 0:
            later = [x for x in (data.find(c, PIECE) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if x >= 0]
            at = min(later, default=len(data))
        yield data[:at]
        data = data[at:]
    yield data


def _long(word: bytes, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")


def _flush(pieces, docs, counts, out, seeds, lower):
    data = b" ".join(pieces)
    raw = np.frombuffer(data, np.uint8)
    if lower:
        raw = _LOWER[raw]
    blank = _WS[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    begins = np.cumsum([0] + [len(p) + 1 for p in pieces[:-1]])
    owner = np.asarray(docs)[np.searchsorted(begins, starts, "right") - 1]
    counts += np.bincount(owner, minlength=len(counts)).astype(np.int64)
    long = np.flatnonzero(ends - starts > LONG_WORD)
    for seed, parts in zip(seeds, out, strict=True):
        if len(raw) > 4 * PIECE:  # one word of many megabytes
            found = np.zeros(len(starts), np.uint64)
            short = np.flatnonzero(ends - starts <= LONG_WORD)
            for i in short:
                at = Sequence(_table(seed)[raw[starts[i] : ends[i]]])
                found[i] = at.span(np.array([0]), np.array([ends[i] - starts[i]]))[0]
        else:
            found = Sequence(_table(seed)[raw]).span(starts, ends)
        for i in long:
            found[i] = _long(raw[starts[i] : ends[i]].tobytes(), seed)
        parts.append(found)


def word_hashes(texts, lower: bool = False, seeds: tuple[int, ...] = (0,)):
    """Number of words of each text, and the hashes of all words in order, one array per seed."""
    counts, out = np.zeros(len(texts), np.int64), [[] for _ in seeds]
    pieces, docs, size = [], [], 0
    for i, text in enumerate(texts):
        if text is None or text == "":
            continue
        for piece in _cut(text.encode("utf-8", "surrogatepass")):
            if pieces and size + len(piece) > PIECE:
                _flush(pieces, docs, counts, out, seeds, lower)
                pieces, docs, size = [], [], 0
            pieces.append(piece)
            docs.append(i)
            size += len(piece) + 1
    if pieces:
        _flush(pieces, docs, counts, out, seeds, lower)
    return counts, [np.concatenate(p) if p else np.zeros(0, np.uint64) for p in out]


def slices(texts, limit: int = 1 << 20):
    """Ranges of consecutive texts of about ``limit`` characters, at least one text each."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text) if text is not None else 0
        if i > begin and size + n > limit:
            yield begin, i
            begin, size = i, 0
        size += n
    if len(texts) > begin:
        yield begin, len(texts)


def inside(counts: np.ndarray, k: int) -> np.ndarray:
    """Starts, in the sequence of all words, of the windows of ``k`` words that lie within one text."""
    n = int(counts.sum())
    if n < k:
        return np.zeros(0, np.int64)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(n)
    return np.flatnonzero(left >= k)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
