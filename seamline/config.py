"""Every retrieval weight, cap and threshold, in one place."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

# Fixed values.
SIGNALS = ("symbol", "lexical", "path", "dependency", "test", "proximity")
K1, B = 1.2, 0.75
PARTIAL_NAME_CEILING, BASENAME_BONUS = 0.9, 0.5
DEPENDENCY = {"exact": 1.0, "heuristic": 0.6}
SAME_DIRECTORY, SAME_TOP_LEVEL = 1.0, 0.5
MIN_RELEVANCE = 0.5
BATCH_MAX_CHARS, BATCH_MAX_QUESTIONS, CANDIDATE_MAX_CHARS, CONCURRENCY = 24_000, 16, 6_000, 4
MAX_FILE_BYTES, MAX_SCAN_FILES, MAX_SCAN_DEPTH, MAX_SCAN_BYTES = 1_000_000, 10_000, 32, 50_000_000
SCHEMA_VERSION, QUESTION_VERSION = 5, "relevance-v1"


class ConfigError(ValueError):
    """A setting outside its range."""


@dataclass(frozen=True)
class Expansion:
    seed_count: int = 5
    max_neighbors_per_seed: int = 4
    max_expanded: int = 10


@dataclass(frozen=True)
class RetrievalConfig:
    version: str = "retrieval-v6"
    weights: dict[str, float] = field(default_factory=lambda: dict(zip(SIGNALS, (0.3, 0.2, 0.15, 0.2, 0.1, 0.05), strict=True)))
    test_demotion: float = 0.2
    shortlist_size: int = 40
    weak_shortlist_total: float = 0.1
    expansion: Expansion = Expansion()


def resolve(weights: dict[str, float] | None = None, expansion: dict[str, int] | None = None, **overrides) -> RetrievalConfig:
    """The defaults with overrides, checked."""
    base = RetrievalConfig()
    config = replace(base, weights={**base.weights, **(weights or {})}, expansion=replace(base.expansion, **(expansion or {})), **overrides)
    def need(ok: bool, what: str) -> None:
        if not ok:
            raise ConfigError(what)

    need(bool(config.version.strip()), "version must not be empty")
    for name, w in config.weights.items():
        need(name in SIGNALS and math.isfinite(w) and w >= 0, f"weights.{name} must be a finite, non-negative number: {w}")
    need(any(w > 0 for w in config.weights.values()), "one weight at least must be positive")
    need(0 <= config.weak_shortlist_total <= 1, "weak_shortlist_total must be in [0, 1]")
    need(0 < config.test_demotion <= 1, "test_demotion must be in (0, 1]")
    sizes = {"shortlist_size": config.shortlist_size, **vars(config.expansion)}
    for name, n in sizes.items():
        need(isinstance(n, int) and n >= 1, f"{name} must be a positive integer: {n}")
    for name in ("seed_count", "max_expanded"):
        need(sizes[name] <= config.shortlist_size, f"expansion.{name} must not exceed shortlist_size")
    return config
