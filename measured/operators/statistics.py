"""Statistics that follow from other ones: of grouped subqueries, of values a
recursion reaches, of members, and of tables whose every row was analyzed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .footers import groups
from .measure import Stats, fit


def grouped_distinct(df: DataFrame, column: str, by: list[str], over_sets: bool = False) -> int | None:
    """Distinct values of a column that a grouped subquery passes through: those
    of the table itself. None (ask the planner) where it is grouped by that
    column alone, whose count is the number of groups, by sets of columns, or
    not by that column."""
    if over_sets or column not in by or len(by) == 1:
        return None
    return df.agg(F.count_distinct(column)).first()[0]


def every_row_analyzed(df: DataFrame, analyzed_rows: int | None, target: int = 100) -> bool:
    """Whether statistics of ``analyzed_rows`` rows were made of every row: no
    more than 300 for each of the target's values, and as many as the files'
    footers count now."""
    found = groups(df)
    return analyzed_rows is not None and found is not None and analyzed_rows <= 300 * target and sum(g.rows for g in found) == analyzed_rows


def with_walked_values(df: DataFrame, column: str, have: Stats, values: DataFrame, most: int = 10_000) -> Stats:
    """Statistics with the measured shares of values that a recursion reaches
    (a column named as ``column``): counted by a join with those values, at most
    ``most`` of them; other shares shrink if all would pass 1."""
    few = values.select(column).distinct().limit(most + 1)
    if few.count() > most:
        return have
    total = df.count()
    found = df.join(F.broadcast(few), column, "left_semi").groupBy(column).count().collect()
    measured = {r[0]: r["count"] / total for r in found} if total else {}
    kept = {k: v for k, v in have.values.items() if k not in measured}
    room = max(0.0, 1.0 - have.nulls - sum(measured.values()))
    if sum(kept.values()) > room:
        scale = room / sum(kept.values())
        kept = {k: v * scale for k, v in kept.items()}
    return Stats(have.nulls, max(have.distinct, len(measured) + len(kept)), fit(kept | measured, have.nulls))


def spans_distinct(spans: list[tuple[int, int]], points: set[int] = frozenset()) -> int:
    """Distinct values of members whose values fill spans, or are points: the
    size of their union."""
    total, end = 0, None
    inside = set()
    for a, b in sorted(spans):
        if end is None or a > end:
            total += b - a + 1
            end = b
        elif b > end:
            total += b - end
            end = b
        inside |= {p for p in points if a <= p <= b}
    return total + len(set(points) - inside)
