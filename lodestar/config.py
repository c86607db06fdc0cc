"""Settings of the engine, checked when made and passed explicitly."""

from __future__ import annotations

from dataclasses import dataclass
from enum import StrEnum


class Choice(StrEnum):
    """How a paused search goes on."""

    ABANDON = "abandon"
    DIRECT_LLM = "direct_llm"
    RAG = "rag"


@dataclass(frozen=True)
class Config:
    chunk_soft_max: int = 3000
    chunk_hard_max: int = 5000
    chapter_scan_chars: int = 100_000
    chapter_density_rules: int = 6_000
    chapter_density_model: int = 10_000
    pages_per_batch: int = 3
    fetch_page_limit: int = 10
    chapter_map_mode: str = "off"
    retries: int = 2
    retry_delay: float = 3.0
    coverage_retries: int = 2
    direct_fix_lines: int = 2
    embedding_dim: int = 1024
    embedding_batch: int = 16
    hybrid_top_k: int = 42
    rerank_top_k: int = 15
    score_tiers: tuple[int, ...] = (8, 7, 6, 5)
    low_confidence_keep: int = 5
    gap_fill_width: int = 5
    neighbor_width: int = 1
    gap_fill_ratio: float = 1.2
    gap_tokens: int = 20_000
    context_tokens: int = 60_000
    history_turns: int = 5
    audit_rows: int = 10_000
    audit_page: int = 50
    max_file_bytes: int = 200 * 1024 * 1024
    score_batch: int = 10
    preview_chars: int = 1_200
    min_confidence: int = 30
    row_overlap: float = 0.35
    min_column_gap: int = 8
    gap_row_ratio: float = 0.25
    rrf_k: int = 60
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    vector_index_rows: int = 256

    def __post_init__(self) -> None:
        tiers = self.score_tiers
        if not tiers or any(isinstance(t, bool) or not isinstance(t, int) or not 0 <= t <= 10 for t in tiers):
            raise ValueError("score_tiers: whole numbers from 0 to 10")
        if any(a <= b for a, b in zip(tiers, tiers[1:])):
            raise ValueError("score_tiers must fall strictly")
        if isinstance(self.audit_rows, bool) or not isinstance(self.audit_rows, int) or self.audit_rows < 1:
            raise ValueError("audit_rows must be 1 or more")
        for name in ("gap_fill_width", "neighbor_width"):
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, int) or value < 0:
                raise ValueError(f"{name} must be a whole number, 0 or more")


def tokens_to_chars(tokens: int) -> int:
    """Characters that a token budget allows: the budget over 0.6."""
    return int(tokens / 0.6)


#: What may be chosen when a search has paused.
OPTIONS = {"zero_results": (Choice.DIRECT_LLM, Choice.ABANDON), "low_confidence": (Choice.RAG, Choice.DIRECT_LLM)}
