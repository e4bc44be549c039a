"""Settings of the engine; every field is read by an operator or a source."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields


def _flag(text: str) -> bool:
    return text.strip().lower() not in ("", "0", "false", "no", "off")


@dataclass(frozen=True)
class Settings:
    # vectors
    embed_model_name: str = "hashing"
    embed_dim: int = 64
    embed_batch_size: int = 64
    nlist: int = 16
    nprobe: int = 12
    # chunking
    chunk_size_tokens: int = 256
    parent_chunk_size_tokens: int = 1024
    semantic_similarity_threshold: float = 0.82
    chunk_overlap_tokens: int = 32
    # retrieval
    retrieval_top_k: int = 15
    final_top_k: int = 5
    rrf_k: int = 60
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25
    # gate
    crag_enabled: bool = True
    crag_relevance_threshold: float = 0.5
    crag_max_retries: int = 1
    web_max_results: int = 3
    # graph
    graph_enabled: bool = True
    graph_max_hops: int = 2
    graph_extractor: str = "rule-filtered"
    # lengths that models are fed with and the vector table holds; 0 is no limit
    ner_chars: int = 0
    density_chars: int = 0
    extractor_chars: int = 0
    tagged_cap: int = 8
    json_cap: int = 5
    field_chars: int = 512
    text_chars: int = 4096
    web_chars: int = 1500
    density_top_fraction: float = 0.30
    density_min_entities: int = 2
    # answers
    default_provider: str = "offline"
    default_model: str = "extractive"
    temperature: float = 0.1
    max_tokens: int = 1024
    llm_timeout: int = 30
    # cache and evaluation
    cache_ttl_seconds: int = 3600
    cache_key_has_candidates: bool = False
    eval_enabled: bool = True
    log_streamed: bool = False
    # paths
    data_dir: str = "data"
    vectors_path: str = "vectors"
    bm25_path: str = "bm25"
    graph_path: str = "graph"
    log_path: str = "logs"

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> "Settings":
        """Fields overridden by upper-case variables of the same names; unknown variables are ignored."""
        env = os.environ if env is None else env
        given = {}
        for f in fields(cls):
            raw = env.get(f.name.upper())
            if raw is not None:
                kind = type(f.default)
                given[f.name] = _flag(raw) if kind is bool else kind(raw)
        return cls(**given)


@dataclass(frozen=True)
class Provider:
    """One entry of the catalogue of answer models."""

    id: str
    label: str
    base_url: str
    models: tuple[str, ...] = field(default=())
    needs_key: bool = True
