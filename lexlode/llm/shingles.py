"""Character shingles of a batch of texts as 64-bit hashes, computed in one numpy pass."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_MIX2 = np.uint64(0xC4CEB9FE1A85EC53)


def normal(text: str | None) -> str:
    """Lower case, runs of Unicode white space as one space, trimmed; null counts as empty."""
    return " ".join(text.lower().split()) if text else ""


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _MIX2
    return h ^ (h >> np.uint64(32))


def hashes(joined: str, width: int) -> np.ndarray:
    """Hash of the ``width`` characters that start at each position of ``joined``."""
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = len(c) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    h = c[:n].copy()
    for j in range(1, width):
        h *= BASE
        h += c[j : j + n]
    return mix(h)


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a normalised text; a shorter text is its own one shingle."""
    if not text:
        return np.empty(0, dtype=np.uint64)
    return np.unique(hashes(text if len(text) >= width else text.ljust(width, "\0"), width))


def pieces(texts: list[str], most: int):
    """Runs (first, last) of texts whose lengths add up to about ``most`` characters."""
    first = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= most:
            yield first, i + 1
            first, total = i + 1, 0
    if first < len(texts):
        yield first, len(texts)
