"""Tunable parameters with the bounds a caller may set them to."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CacheConfig:
    """Parameters of lookup, calibration, retention and sessions."""

    capacity: int = 10_000
    default_threshold: float = 0.70
    min_threshold: float = 0.60
    max_threshold: float = 0.99
    target_error: float = 0.05
    min_scores: int = 3
    max_scores: int = 200
    top_k: int = 10
    window_fraction: float = 0.01
    protected_fraction: float = 0.80
    lsh_tables: int = 4
    lsh_bits: int = 8
    lsh_seed: int = 42
    session_alpha: float = 0.85
    session_decay: float = 0.5
    session_timeout_s: int = 1800
    ttl_s: int = 86_400
    drift_delta: float = 0.002
    drift_window: int = 5000
    arms: int = 10
    arm_low: float = 0.65
    arm_high: float = 0.95
    breaker_failures: int = 5
    breaker_reset_s: float = 30.0
    tenant_scoped: bool = True
    exact_checks_ttl: bool = True
    admission_shards: int = 1

    def __post_init__(self) -> None:
        unit = (
            "default_threshold", "min_threshold", "max_threshold", "target_error",
            "window_fraction", "protected_fraction", "session_alpha", "session_decay",
        )
        for name in unit:
            if not 0.0 <= getattr(self, name) <= 1.0:
                raise ValueError(f"{name} must lie in [0, 1]")
        for name in ("capacity", "min_scores", "max_scores", "top_k", "lsh_tables", "lsh_bits", "arms", "admission_shards"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")
        if self.min_threshold > self.max_threshold:
            raise ValueError("min_threshold exceeds max_threshold")
        if self.ttl_s < 0 or self.session_timeout_s <= 0:
            raise ValueError("ttl_s must be >= 0 and session_timeout_s > 0")


DEFAULT = CacheConfig()
