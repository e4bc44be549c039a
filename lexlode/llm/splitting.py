"""Splitting oversized texts at natural boundaries, with pointer doubling.

Every position of a text is joined to its farthest legal successor: the end of the
piece that starts ``overlap`` characters before it, at the best boundary in reach
(paragraph, line, sentence, clause, word, any). The table of successors is then
squared again and again; each squaring doubles the known run of cuts, so all cuts
follow after as many table look-ups as the logarithm of their number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_END = np.array([ord(c) for c in ".!?…。！？।؟॥"], dtype=np.uint32)
_CLAUSE = np.array([ord(c) for c in ",;:、，；：،؛—"], dtype=np.uint32)
_CLOSE = np.array([ord(c) for c in "\"'”’»)]」』）"], dtype=np.uint32)
_SPACE = np.array([9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], dtype=np.uint32)


def boundaries(text: str) -> list[np.ndarray]:
    """For each kind of boundary, best first, whether a piece may end before each position 0..n."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = len(c)
    newline, space = c == 10, np.isin(c, _SPACE)
    paragraph, line, sentence, clause, word, mark = (np.zeros(n + 1, dtype=bool) for _ in range(6))
    line[1:] = newline
    paragraph[2:] = newline[1:] & newline[:-1]
    paragraph[1:-1] &= ~newline[1:]
    ends, wide = np.isin(c, _END), c >= 0x2E80
    if n > 2:
        closed = np.isin(c, _CLOSE)
        sentence[2:] |= ends[:-1] & space[1:]
        sentence[3:] |= ends[:-2] & closed[1:-1] & space[2:]
    sentence[1:] |= ends & wide
    if n > 1:
        sentence[2:] |= ends[:-1] & wide[:-1] & np.isin(c[1:], _CLOSE)
        sentence[1:-1] &= ~(ends[:-1] & np.isin(c[1:], _CLOSE))
    clause[1:] = np.isin(c, _CLAUSE)
    word[1:] = space
    mark[:-1] = ((c >= 0x300) & (c < 0x370)) | ((c >= 0x200B) & (c < 0x2010)) | ((c >= 0xFE00) & (c < 0xFE10)) | ((c >= 0x900) & (c < 0xD80) & _marks(c)) | ((c >= 0xE31) & (c < 0xE4F) & _marks(c))
    return [paragraph, line, sentence, clause, word, ~mark]


def _marks(c: np.ndarray) -> np.ndarray:
    import unicodedata

    unique, at = np.unique(c, return_inverse=True)
    return np.array([unicodedata.category(chr(u))[0] == "M" for u in unique.tolist()], dtype=bool)[at]


def successors(text: str, size: int, overlap: int) -> np.ndarray:
    """succ[e]: end of the piece after one that ends at e. succ[n] = n."""
    n = len(text)
    e = np.arange(n + 1)
    high = np.minimum(n, np.maximum(e - overlap, 0) + size)
    low = np.minimum(e + max(1, (size - overlap) // 2), n)
    succ = np.zeros(n + 1, dtype=np.int64)
    open_ = np.ones(n + 1, dtype=bool)
    for legal in boundaries(text):
        last = np.maximum.accumulate(np.where(legal, np.arange(n + 1), 0))
        got = open_ & (last[high] >= low)
        succ[got] = last[high][got]
        open_ &= ~got
    succ[open_] = high[open_]
    succ[high == n] = n
    return np.maximum(succ, np.minimum(e + 1, n))


def cuts(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text, all greedy cuts found by squaring the successor table."""
    n = len(text)
    if n <= size:
        return [(0, n)]
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be less than the size")
    table = successors(text, size, overlap)
    path = np.array([_first(text, size)])
    while path[-1] < n:
        path = np.concatenate([path, table[path]])
        table = table[table]
    ends = np.unique(path)
    starts = np.concatenate([[0], np.maximum(ends[:-1] - overlap, 0)])
    return list(zip(starts.tolist(), ends.tolist()))


def _first(text: str, size: int) -> int:
    """End of the first piece, which has no piece before it to overlap."""
    low = max(1, size // 2)
    for legal in boundaries(text[: size + 1]):
        at = np.flatnonzero(legal[low : size + 1])
        if len(at):
            return int(at[-1]) + low
    return size


def _pieces(batches):
    for b in batches:
        rows: list[tuple] = []
        for i, (text, size, overlap) in enumerate(zip(*(b.column(k).to_pylist() for k in (2, 3, 4)))):
            rows += [(i, k, s, e, text[s:e]) for k, (s, e) in enumerate(cuts(text, size, overlap))]
        at = pa.array([r[0] for r in rows], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(at), b.column(1).take(at), *(pa.array([r[k] for r in rows], t) for k, t in ((1, pa.int32()), (2, pa.int32()), (3, pa.int32()), (4, pa.string())))],
            names=["item_kind", "item_id", "piece_no", "start_char", "end_char", "text"])


def split_oversized(items: DataFrame, limits: DataFrame) -> DataFrame:
    """Pieces of every text of ``items`` that is longer than the limit of its kind.

    ``items``: item_kind, item_id (string), text. ``limits``: item_kind, unit,
    max_size, overlap; one row per kind, a fixed table that is broadcast. Lengths
    count code points; kinds measured in another unit or without a limit are left out.
    Pieces are numbered from 0, none is longer than max_size, each begins
    ``overlap`` characters before the end of the one before it, and without the
    overlaps they add up to the text. Null texts and texts within the limit give no
    rows, an item stored twice gives its pieces once, other columns are not read.
    Only oversized texts are shuffled and reach Python.
    """
    most = limits.where("unit = 'chars'").select("item_kind", "max_size", F.least("overlap", F.col("max_size") - 1).alias("overlap")).dropDuplicates(["item_kind"])
    long = (
        items.select("item_kind", "item_id", "text").where("item_id is not null and text is not null").join(F.broadcast(most), "item_kind")
        .where(F.length("text") > F.col("max_size")).dropDuplicates(["item_kind", "item_id"])
    )
    return long.select("item_kind", "item_id", "text", "max_size", "overlap").mapInArrow(
        _pieces, "item_kind string, item_id string, piece_no int, start_char int, end_char int, text string")
