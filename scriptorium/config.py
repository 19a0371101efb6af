"""Thresholds of corpus preparation, retrieval and routing."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Limits:
    max_bytes: int = 100_000_000
    max_pages: int = 300
    min_letters: int = 60
    chunk_max: int = 2400
    chunk_overlap: int = 300
    chunk_min: int = 200
    window_chars: int = 24_000
    top_k: int = 8
    candidates: int = 20
    per_document: int = 3
    rrf_k: int = 60
    k1: float = 1.5
    b: float = 0.75
    context_chars: int = 12_000
    context_floor: int = 8
    full_read_chars: int = 16_000
    score_floor: float = 0.35
    score_sure: float = 0.60
    rescue: float = 0.50
    fewshot: float = 0.55
    run_cost: float = 0.05
    run_seconds: float = 90.0
    context_tokens: int = 2500
    difficulty: int = 4


LIMITS = Limits()
