"""Retrieval settings and the schemas of the engine's tables."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class RetrievalConfig:
    """Fixed values that results depend on."""

    beam_root: int = 3
    beam_child: int = 2
    beam_leaf: int = 2
    min_embedded: int = 3
    flat_k: int = 20
    w_semantic: float = 0.5
    w_bm25: float = 0.3
    w_meta: float = 0.2
    k1: float = 1.5
    b: float = 0.75
    rerank_pool: int = 20
    rerank_chars: int = 1500
    top_k: int = 5
    near_duplicate: float = 0.92
    context_chars: int = 8000
    summary_chars: int = 5000
    meaningful_chars: int = 20
    variants: int = 3
    min_rewrite: int = 5
    max_query: int = 2000
    cache_ttl_s: int = 7 * 24 * 3600
    cache_size: int = 1000
    max_upload_bytes: int = 50 * 1024 * 1024
    max_images: int = 50
    min_image_px: int = 100
    eta_alpha: float = 0.3
    eta_prior_s: float = 15.0
    history: int = 50


CONFIG = RetrievalConfig()

META = "doc_id string, filename string, nodes int"

#: What is said without an answer, and without documents.
NOT_FOUND = "I could not find this information in the available documents."
NO_DOCUMENTS = "No documents have been ingested yet. Please upload a document first."
