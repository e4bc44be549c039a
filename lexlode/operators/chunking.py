"""Semantic chunking of documents with parent windows, one pass and no shuffle.

A document's sentences, their vectors, the chunk starts, the offsets and the parent
windows depend on each other in sequence, so a document is cut by one Arrow pass;
what needs no sequence stays in column functions.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexlode.config import Settings
from lexlode.functions.text import STOP_WORDS

Embedder = Callable[[list[str]], np.ndarray]
CHARS_PER_TOKEN = 4
OUT_CHARS = 4_000_000
_BREAK = re.compile(r"(?<=[.!?])\s+(?=[A-Z])")
_SPACED = re.compile(r"[^\w\-]+")
_END = re.compile(r"[.!?\n]")
_STOP = frozenset(STOP_WORDS)


def split_sentences(text: str) -> list[str]:
    return [s for s in (p.strip() for p in _BREAK.split(text)) if s]


@lru_cache(maxsize=200_000)
def bucket(term: str, dim: int) -> int:
    return int(hashlib.md5(term.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16) % dim


def hashing_embedder(dim: int) -> Embedder:
    """Vectors of term counts in hashed buckets: deterministic, offline, reproducible in SQL."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in _SPACED.sub(" ", t.lower()).split():
                if len(w) > 1 and w not in _STOP:
                    out[i, bucket(w, dim)] += 1
        return out

    return embed


def estimate(text: str) -> int:
    return max(1, len(text) // CHARS_PER_TOKEN)


def adjacent_similarity(vectors: np.ndarray) -> list[float]:
    """Cosine of each vector with the one before it; the first has none."""
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    dots = (vectors[1:] * vectors[:-1]).sum(axis=1)
    return [float("nan"), *(dots / (norms[1:] * norms[:-1] + 1e-8)).tolist()] if len(vectors) else []


def chunk_starts(tokens: list[int], similarity: list[float], threshold: float, budget: int) -> list[int]:
    """Sentence indexes at which a chunk begins: dissimilar to the one before, or over the budget."""
    starts, running = [], 0
    for i, n in enumerate(tokens):
        if i == 0 or similarity[i] < threshold or running + n > budget:
            starts.append(i)
            running = n
        else:
            running += n
    return starts


def snap_left(text: str, pos: int) -> int:
    """Behind the last end mark in characters 1 to ``pos``, or the start of the text."""
    return max(text.rfind(mark, 1, pos + 1) for mark in ".!?\n") + 1


def snap_right(text: str, pos: int) -> int:
    m = _END.search(text, pos)
    return m.end() if m else len(text)


def chunk_text(text: str, embed: Embedder, cfg: Settings) -> list[tuple[int, int, int, str, str]]:
    """(first sentence, start, end, chunk, parent) of the chunks of one text."""
    return list(_each_chunk(text, embed, cfg))


def _each_chunk(text: str, embed: Embedder, cfg: Settings, parents: bool = True) -> Iterator[tuple[int, int, int, str, str]]:
    parts = split_sentences(text)
    if not parts:
        return
    starts = chunk_starts([estimate(p) for p in parts], adjacent_similarity(embed(parts)), cfg.semantic_similarity_threshold, cfg.chunk_size_tokens)
    half, back = cfg.parent_chunk_size_tokens * CHARS_PER_TOKEN // 2, cfg.chunk_overlap_tokens * CHARS_PER_TOKEN
    cursor = 0
    for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(parts)])):
        body = " ".join(parts[a:b])
        found = text.find(parts[a], cursor)
        end = found + len(body)
        start = max(0, found)
        cursor = max(0, end - back)
        if k == len(starts) - 1:
            end = min(end, len(text))
        if not parents:
            yield a, start, end, body, ""
            continue
        left = snap_left(text, max(0, min(start - half, len(text) - 1)))
        right = snap_right(text, min(len(text), max(0, end + half)))
        yield a, start, end, body, text[left:right].strip()


def _chunker(cfg: Settings, make: Callable[[int], Embedder], parents: bool = True):
    """Chunks in batches of about OUT_CHARS characters: parent windows overlap, so a batch of documents may give many times its own size."""
    names = [c for c in ("chunk_id", "doc_id", "source", "title", "text", "parent_text", "chunk_index", "start_char", "end_char", "metadata", "first_sentence") if parents or c != "parent_text"]

    def batch(b: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        at = pa.array([r[0] for r in rows], pa.int64())
        ids = b.column("doc_id").take(at).to_pylist()
        keys = [hashlib.sha256(f"{d}:{r[1]}".encode()).hexdigest()[:16] for d, r in zip(ids, rows)]
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), b.column("doc_id").take(at), b.column("source").take(at), b.column("title").take(at),
             pa.array([r[5] for r in rows], pa.string()), *([pa.array([r[6] for r in rows], pa.string())] if parents else []),
             *(pa.array([r[k] for r in rows], pa.int32()) for k in (1, 3, 4)), b.column("metadata").take(at), pa.array([r[2] for r in rows], pa.int32())],
            names=names)

    def run(batches: Iterator[pa.RecordBatch]):
        embed = make(cfg.embed_dim)
        for b in batches:
            rows, chars = [], 0
            for i, text in enumerate(b.column("text")):
                for k, c in enumerate(_each_chunk(text.as_py(), embed, cfg, parents)):
                    rows.append((i, k, *c))
                    chars += len(c[3]) + len(c[4])
                    if chars >= OUT_CHARS:
                        yield batch(b, rows)
                        rows, chars = [], 0
            if rows:
                yield batch(b, rows)
    return run


def chunk_documents(docs: DataFrame, cfg: Settings = Settings(), make: Callable[[int], Embedder] = hashing_embedder, parents: bool = True, also: tuple | None = None) -> DataFrame:
    """Chunks of a document table (doc_id, source, doc_type, title, text, metadata).

    A chunk never splits a sentence; a sentence over the budget is a chunk of its
    own; documents without text give none. The document's type joins the metadata.
    Without ``parents`` no windows are made, and the chunks have no column of them. ``also`` is a
    function of the batches of chunks that adds columns to them, and the kinds of these columns.
    """
    from lexlode.schemas import CHUNK

    src = docs.where("text is not null").select(
        "doc_id", "source", "title", "text",
        F.map_concat(F.map_filter(F.coalesce("metadata", F.expr("map()").cast("map<string,string>")), lambda k, v: k != "doc_type"),
                     F.create_map(F.lit("doc_type"), F.col("doc_type"))).alias("metadata"))
    kinds = CHUNK if parents else CHUNK.replace("parent_text string, ", "")
    run = _chunker(cfg, make, parents)
    if also is None:
        return src.mapInArrow(run, f"{kinds}, first_sentence int")
    add, more = also
    return src.mapInArrow(lambda batches: add(run(batches)), f"{kinds}, first_sentence int, {more}")


def _similarity(cfg: Settings, make: Callable[[int], Embedder]):
    def run(batches):
        embed = make(cfg.embed_dim)
        for b in batches:
            at, pos, tokens, sims, starts = [], [], [], [], []
            for i, t in enumerate(b.column("text").to_pylist()):
                parts = split_sentences(t)
                n, s = [estimate(p) for p in parts], adjacent_similarity(embed(parts)) if parts else []
                first = set(chunk_starts(n, s, cfg.semantic_similarity_threshold, cfg.chunk_size_tokens))
                at += [i] * len(parts)
                pos += range(len(parts))
                tokens += n
                sims += [None if v != v else v for v in s]
                starts += [k in first for k in range(len(parts))]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(at, pa.int64())), pa.array(pos, pa.int64()), pa.array(tokens, pa.int64()), pa.array(sims, pa.float64()), pa.array(starts, pa.bool_())],
                names=["doc_id", "pos", "tokens", "similarity", "starts"])
    return run


def sentence_boundaries(docs: DataFrame, cfg: Settings = Settings(), make: Callable[[int], Embedder] = hashing_embedder) -> DataFrame:
    """One row per sentence: doc_id, pos, tokens, similarity to the one before, and whether it starts a chunk."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.where("text is not null").select("doc_id", "text").mapInArrow(_similarity(cfg, make), f"doc_id {kind}, pos long, tokens long, similarity double, starts boolean")
