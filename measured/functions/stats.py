"""Middle and spread of figures; a figure that is no number is refused."""

from __future__ import annotations

import math
from collections.abc import Sequence


def _sorted(x: Sequence[float]) -> list[float]:
    if not x or not all(math.isfinite(v) for v in x):
        raise ValueError("figures must be finite, and there must be some")
    return sorted(x)


def median(x: Sequence[float]) -> float:
    s = _sorted(x)
    n = len(s)
    return s[n // 2] if n % 2 else (s[n // 2 - 1] + s[n // 2]) / 2


def spread(x: Sequence[float]) -> float:
    s = _sorted(x)
    return s[-1] - s[0]


def deviation(x: Sequence[float]) -> float:
    """Median absolute deviation from the median."""
    m = median(x)
    return median([abs(v - m) for v in x])


def constant(x: Sequence[float]) -> bool:
    return spread(x) == 0
