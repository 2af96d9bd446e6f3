"""Small numbers on the driver: identities of configurations, quantiles, paired statistics."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Sequence
from typing import Any


def canonical_sha(value: Any) -> str:
    """sha256 of JSON with sorted keys and no spaces."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def differing_paths(a: dict, b: dict, ignore: frozenset[str] = frozenset()) -> list[str]:
    """Dotted paths at which two nested maps differ; lists compare as wholes, ignore holds top-level keys."""
    out: list[str] = []
    stack = [((), a, b)]
    while stack:
        path, x, y = stack.pop()
        for k in {*x, *y} - (ignore if not path else frozenset()):
            if isinstance(x.get(k), dict) and isinstance(y.get(k), dict):
                stack.append(((*path, k), x[k], y[k]))
            elif (k in x) != (k in y) or x.get(k) != y.get(k):
                out.append(".".join((*path, k)))
    return sorted(out)


def has_placeholder(value: Any) -> bool:
    """Whether any text in a nested value is unresolved."""
    if isinstance(value, dict):
        return any(map(has_placeholder, value.values()))
    if isinstance(value, list | tuple):
        return any(map(has_placeholder, value))
    return isinstance(value, str) and (value == "unknown" or value.startswith("pending"))


def t_inside(t: float, df: int) -> float:
    """P(|T| <= t) for whole degrees of freedom, by the finite trigonometric sums."""
    angle = math.atan2(t, math.sqrt(df))
    square = math.cos(angle) ** 2
    term, total = 1.0, 0.0
    if df % 2:
        if df > 1:
            term = math.cos(angle)
            total = term
            for k in range(3, df - 1, 2):
                term *= square * (k - 1) / k
                total += term
        return 2 / math.pi * (angle + math.sin(angle) * total)
    total = 1.0
    for k in range(2, df - 1, 2):
        term *= square * (k - 1) / k
        total += term
    return math.sin(angle) * total


def t_quantile(p: float, df: int) -> float:
    """Student's t below which a share p lies."""
    if not isinstance(df, int) or df < 1:
        raise ValueError(f"degrees of freedom must be a positive whole number, got {df!r}")
    if not 0 < p < 1:
        raise ValueError(f"a share lies between 0 and 1, got {p!r}")
    if p < 0.5:
        return -t_quantile(1 - p, df)
    inside = 2 * p - 1
    low, high = 0.0, 1.0
    while t_inside(high, df) < inside:
        high *= 2
    while high - low > 1e-12 * max(1.0, high):
        middle = (low + high) / 2
        low, high = (middle, high) if t_inside(middle, df) < inside else (low, middle)
    return (low + high) / 2


def paired(a: Sequence[float], b: Sequence[float]) -> tuple[float, float]:
    """Mean difference and its standard error; 0 for a single pair."""
    d = [x - y for x, y in zip(a, b, strict=True)]
    mean = sum(d) / len(d)
    return mean, math.sqrt(sum((x - mean) ** 2 for x in d) / (len(d) - 1) / len(d)) if len(d) > 1 else 0.0


def rank_quantile(ordered: Sequence[float], share: float) -> float:
    """The value at place int(share * n) of sorted values, the last at most."""
    return ordered[min(int(share * len(ordered)), len(ordered) - 1)]


def envelope(point: float, low: float, high: float, corners: Sequence[float] = (), floor: float = 0.003) -> tuple[float, float]:
    """The interval that covers a parameter interval, structural corners and a least half-width, within 0 and 1."""
    return max(0.0, min([low, point - floor, *corners])), min(1.0, max([high, point + floor, *corners]))
