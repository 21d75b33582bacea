"""Places on a sphere as points in space, boxes around them and distances."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 6378168.0


def xyz(lat: Column, lon: Column, radius: float = RADIUS) -> tuple[Column, Column, Column]:
    a, o = F.radians(lat), F.radians(lon)
    return radius * F.cos(a) * F.cos(o), radius * F.cos(a) * F.sin(o), radius * F.sin(a)


def point(lat: float, lon: float, radius: float = RADIUS) -> tuple[float, float, float]:
    a, o = math.radians(lat), math.radians(lon)
    return radius * math.cos(a) * math.cos(o), radius * math.cos(a) * math.sin(o), radius * math.sin(a)


def chord(metres: float, radius: float = RADIUS) -> float:
    """Straight-line length of a great-circle distance."""
    return 2 * radius * math.sin(min(metres / (2 * radius), math.pi / 2))


def in_box(at: tuple[Column, Column, Column], lat: float, lon: float, metres: float, radius: float = RADIUS) -> Column:
    """Inside the axis-aligned box around a place whose half side is the chord
    of the distance: three ranges, which a scan can push down where x, y and z
    are stored columns."""
    half = chord(metres, radius)
    out = F.lit(True)
    for c, p in zip(at, point(lat, lon, radius), strict=True):
        out = out & c.between(p - half, p + half)
    return out


def within(at: tuple[Column, Column, Column], lat: float, lon: float, metres: float, radius: float = RADIUS) -> Column:
    """Nearer than a great-circle distance, compared by squared chords."""
    parts = [(c - F.lit(p)) * (c - F.lit(p)) for c, p in zip(at, point(lat, lon, radius), strict=True)]
    return parts[0] + parts[1] + parts[2] < chord(metres, radius) ** 2


def box(low: Column, high: Column) -> Column:
    """An axis-aligned box from arrays of its low and high sides."""
    return F.struct(low.alias("low"), high.alias("high"))


def _sides(a: Column, b: Column, holds) -> Column:
    """Whether something holds of each two sides, missing ones counting as 0."""
    side = lambda c, end, i: F.coalesce(F.get(c[end], i), F.lit(0.0))
    n = F.greatest(F.size(a["low"]), F.size(b["low"]), F.lit(1))
    return F.forall(F.sequence(F.lit(0), n - 1), lambda i: holds(side(a, "low", i), side(a, "high", i), side(b, "low", i), side(b, "high", i)))


def overlap(a: Column, b: Column) -> Column:
    """Whether two boxes have a point in common."""
    return _sides(a, b, lambda l, h, m, k: (l <= k) & (m <= h))


def contains(a: Column, b: Column) -> Column:
    """Whether box a holds all of box b."""
    return _sides(a, b, lambda l, h, m, k: (l <= m) & (k <= h))


def same(a: Column, b: Column) -> Column:
    return _sides(a, b, lambda l, h, m, k: (l == m) & (k == h))


def straight(a: Column, b: Column) -> Column:
    """Distance of two points given as arrays, missing coordinates being 0."""
    size = F.greatest(F.size(a), F.size(b), F.lit(1))
    gap = lambda i: F.coalesce(F.get(a, i), F.lit(0.0)) - F.coalesce(F.get(b, i), F.lit(0.0))
    return F.sqrt(F.aggregate(F.sequence(F.lit(0), size - 1), F.lit(0.0), lambda total, i: total + gap(i) * gap(i)))


def along(chords: Column, radius: float = RADIUS) -> Column:
    """Great-circle length of a straight one."""
    return 2 * radius * F.asin(F.least(F.lit(1.0), chords / (2 * radius)))


def through(arcs: Column, radius: float = RADIUS) -> Column:
    """Straight length of a great-circle one."""
    return 2 * radius * F.sin(F.least(arcs / (2 * radius), F.lit(math.pi / 2)))
