"""One explicit configuration object; nothing is read from the process environment."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class EngineConfig:
    """Thresholds and name sets of the engine. ``as_of`` is the clock of everything that depends on dates."""

    k1: float = 1.5
    b: float = 0.75
    chunk_chars: int = 3000
    chunk_overlap: int = 300
    decay: tuple[float, float, float] = (1.0, 0.8, 0.5)
    weights: tuple[float, float] = (0.6, 0.4)
    escalation_weights: tuple[float, float] = (0.3, 0.7)
    escalation_below: float = 0.6
    gray_zone: tuple[float, float] = (0.5, 0.7)
    gray_zone_years: float = 1.0
    escalation_recall: int = 20
    semantic_edge: float = 0.75
    semantic_inferred: float = 0.85
    related_least: float = 0.70
    related_top: int = 8
    large_bytes: int = 1_000_000
    sparse_category: int = 3
    inbox: str = "(inbox)"
    archive_markers: tuple[str, ...] = ("archive",)
    journal_markers: tuple[str, ...] = ("journal", "diary")
    memory_prefix: str = "memory/"
    extracts_prefix: str = "extracts/"
    exclude_dirs: frozenset[str] = field(default_factory=lambda: frozenset({".git", ".obsidian", ".index", "__pycache__", "node_modules", "venv", ".venv"}))
    exclude_top_files: frozenset[str] = field(default_factory=lambda: frozenset({"README.md", "AGENTS.md"}))
    as_of: str = "2026-01-01 00:00:00"

    def __post_init__(self) -> None:
        if len(self.decay) != 3 or any(x < 0 for x in self.decay) or not self.decay[0] >= self.decay[1] >= self.decay[2]:
            object.__setattr__(self, "decay", (1.0, 0.8, 0.5))
        if len(self.weights) != 2:
            raise ValueError("weights are two numbers: dense and sparse")
