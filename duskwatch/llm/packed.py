"""Arrays of numbers as compressed binary values, and index helpers."""

from __future__ import annotations

import numpy as np
import zstandard


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes, so that their empty high bytes cost nothing."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()
        body = zstandard.ZstdCompressor(level=3).compress(planes)
        out.append(np.array([len(a), a.itemsize, len(body)], np.int64).tobytes() + body)
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        n, width, size = np.frombuffer(data, np.int64, 3, at).tolist()
        raw = zstandard.ZstdDecompressor().decompress(data[at + 24 : at + 24 + size], max_output_size=max(1, n * width))
        out.append(np.frombuffer(raw, np.uint8).reshape(width, n).T.copy().view(f"i{width}" if n else np.int64).reshape(-1))
        at += 24 + size
    return out


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of ranges that follow each other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)
