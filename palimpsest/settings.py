"""Ranking settings, their validation, and bounds on request scalars."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, fields, replace


@dataclass(frozen=True)
class FusionWeights:
    semantic: float = 0.50
    keyword: float = 0.22
    entity: float = 0.13
    reinforcement: float = 0.08
    recency: float = 0.05
    level: float = 0.02

    def __post_init__(self) -> None:
        values = [getattr(self, f.name) for f in fields(self)]
        if any(not math.isfinite(v) or v < 0 for v in values):
            raise ValueError("weights must be finite and not negative")
        if abs(sum(values) - 1) > 1e-9:
            raise ValueError(f"weights must sum to 1, not {sum(values)}")


@dataclass(frozen=True)
class RecallSettings:
    half_life_days: float = 180.0
    threshold: float = 0.0
    oversample: int = 4
    entity_top_k: int = 10
    entity_cut: float = 0.5
    weights: FusionWeights = field(default_factory=FusionWeights)

    def candidates(self, limit: int) -> int:
        """Rows that each candidate path may return for a limit."""
        return min(1000, limit * max(1, self.oversample))


# Allowed ranges of workspace overrides.
OVERRIDES = {"half_life_days": (0.0, 36500.0), "threshold": (0.0, 1.0), "oversample": (1, 50), "entity_top_k": (1, 100), "entity_cut": (0.0, 1.0)}


def workspace_settings(overrides: dict | None, strict: bool = False) -> RecallSettings:
    """Defaults with a workspace's overrides. Out-of-range or unknown ones are errors when written (strict), ignored when read."""
    out = RecallSettings()
    for key, value in (overrides or {}).items():
        try:
            if key == "weights":
                out = replace(out, weights=FusionWeights(**value))
                continue
            low, high = OVERRIDES[key]
            if isinstance(value, bool) or not low <= value <= high:
                raise ValueError(f"{key} must lie from {low} to {high}")
            out = replace(out, **{key: type(getattr(out, key))(value)})
        except (KeyError, TypeError, ValueError) as e:
            if strict:
                raise ValueError(f"bad setting {key}: {e}") from e
    return out


def _bounded(value: int | None, default: int, most: int) -> int:
    return default if value is None or value <= 0 else min(value, most)


def page_number(page: int | None) -> int:
    return max(0, min(10_000, page or 0))


def page_size(size: int | None) -> int:
    return _bounded(size, 50, 200)


def result_limit(limit: int | None) -> int:
    return _bounded(limit, 10, 100)


def history_limit(limit: int | None) -> int:
    return _bounded(limit, 100, 500)


def token_budget(tokens: int | None) -> int:
    return _bounded(tokens, 4000, 128_000)


def tool_limit(limit: int | None) -> int:
    return 10 if limit is None else max(1, min(50, limit))
