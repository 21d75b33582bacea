"""Row counts, overlaps and column statistics, measured before a query is
planned and within a budget of bytes read. Measures alter plans, never rows.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..features import on
from ..functions import region, words

log = logging.getLogger("measured")


@dataclass
class Budget:
    """Bytes that measuring may read: each table's once by default. Statistics
    may use half. 0 turns measuring off."""

    total: int
    used: int = 0
    used_for_stats: int = 0
    noted: set[tuple[str, str]] = field(default_factory=set)

    def left(self, stats: bool = False) -> int:
        free = self.total - self.used
        return min(free, self.total // 2 - self.used_for_stats) if stats else free

    def fits(self, size: int, stats: bool = False) -> bool:
        return 0 < self.total and size <= self.left(stats)

    def draw(self, what: str, size: int, stats: bool = False) -> bool:
        if not self.fits(size, stats):
            if (what, "skip") not in self.noted:
                self.noted.add((what, "skip"))
                log.debug("skipped: %s would read %d bytes of %d left", what, size, self.left(stats))
            return False
        self.used += size
        self.used_for_stats += size * stats
        if self.left() == 0 and (what, "stop") not in self.noted:
            self.noted.add((what, "stop"))
            log.debug("stopped: %s took the last of %d bytes", what, self.total)
        return True


@dataclass
class Round:
    """Measures of one query: a memo and a budget. Nested rounds share the
    outermost one."""

    budget: Budget
    memo: dict = field(default_factory=dict)


_round: ContextVar[Round | None] = ContextVar("round", default=None)


def measuring() -> bool:
    """Whether a round is on that may read."""
    return (r := _round.get()) is not None and r.budget.total > 0


@contextmanager
def planning(total: int) -> Iterator[Round]:
    """A round with a budget; inside another it is that one, and an error
    gives back its memo and budget as they were."""
    outer = _round.get()
    now = outer or Round(Budget(total))
    was = (dict(now.memo), now.budget.used, now.budget.used_for_stats)
    token = _round.set(now)
    try:
        yield now
    except BaseException:
        now.memo, now.budget.used, now.budget.used_for_stats = was
        raise
    finally:
        _round.reset(token)


@dataclass(frozen=True)
class Condition:
    """A conjunct: kind is equal, range, list, null, notnull or other; sql is
    its text; column the expression that it compares with constants; op how
    (=, <, <=, >, >=, in) and against the constants' texts."""

    kind: str
    column: str
    sql: str
    op: str = ""
    against: tuple[str, ...] = ()

    def values(self, spark: SparkSession) -> list:
        """The constants, folded: expressions of constants are worked out."""
        return list(spark.sql("SELECT " + ", ".join(self.against)).first()) if self.against else []


OPS = {"EqualTo": "=", "LessThan": "<", "LessThanOrEqual": "<=", "GreaterThan": ">", "GreaterThanOrEqual": ">="}
MIRROR = str.maketrans("<>", "><")


def conditions(spark: SparkSession, text: str) -> list[Condition]:
    """The conjuncts of a predicate. Those that compare one expression with
    constants can be held by an index of it; a comparison written the other
    way round counts as its mirror. Anything else is 'other'."""

    def constant(e) -> bool:
        return e.references().isEmpty() and not any(k in e.getClass().getName() for k in ("Unresolved", "Subquery"))

    def children(e) -> list:
        c = e.children()
        return [c.apply(i) for i in range(c.size())]

    def free(e) -> bool:
        """No column below: constants and operations on them."""
        name = e.getClass().getSimpleName()
        return not name.startswith("UnresolvedAttribute") and "Subquery" not in name and "Parameter" not in name and all(free(x) for x in children(e))

    def walk(e) -> Iterator[Condition]:
        name, own = e.getClass().getSimpleName(), children(e)
        if name == "And":
            for c in own:
                yield from walk(c)
            return
        kind, column, op, against = "other", "", "", ()
        if name in ("EqualTo", "LessThan", "LessThanOrEqual", "GreaterThan", "GreaterThanOrEqual") and free(own[0]) != free(own[1]):
            kind, column = ("equal" if name == "EqualTo" else "range"), own[1 if free(own[0]) else 0].sql()
            op = OPS[name].translate(MIRROR) if free(own[0]) else OPS[name]
            against = (own[0 if free(own[0]) else 1].sql(),)
        elif name == "In" and not free(own[0]) and all(free(x) for x in own[1:]):
            kind, column, op, against = "list", own[0].sql(), "in", tuple(x.sql() for x in own[1:])
        elif name == "IsNull":
            kind, column = "null", own[0].sql()
        elif name == "IsNotNull":
            kind, column = "notnull", own[0].sql()
        yield Condition(kind, column, e.sql(), op, against)

    return list(walk(spark._jsparkSession.sessionState().sqlParser().parseExpression(text)))


@dataclass(frozen=True)
class Measure:
    rows: int
    of: int
    exact: bool
    note: str
    alone: tuple[tuple[str, int], ...] = ()


class Watched:
    """A table whose conditions are measured; with ``where``, only queries
    whose own conditions include it."""

    def __init__(self, name: str, df: DataFrame, where: str | None = None, size: int | None = None):
        self.name, self.df, self.where = name, df, where
        self.spark = df.sparkSession
        self.size = size if size is not None else self.bytes()

    def bytes(self) -> int:
        """Bytes of the files a scan reads, by the optimizer's statistics."""
        return int(str(self.df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))

    def identity(self) -> tuple:
        """A table's name and plan: two tables of one name are told apart."""
        return self.name, self.df.semanticHash()

    def covers(self, text: str) -> bool:
        if self.where is None:
            return True
        have = {c.sql for c in conditions(self.spark, text)}
        return all(c.sql in have for c in conditions(self.spark, self.where))

    def rows(self, text: str) -> Measure | None:
        """How many rows a predicate selects, and each of its conjuncts alone:
        one pass over the columns it names. None where it is not covered or
        over budget."""
        round_ = _round.get()
        if round_ is None or not on("row_counts") or not self.covers(text):
            return None
        key = (*self.identity(), "rows", text)
        if key not in round_.memo:
            if not round_.budget.draw(f"{self.name}: {text}", self.size):
                return None
            parts = conditions(self.spark, text)
            got = self.df.agg(F.count("*"), F.count_if(F.expr(text)), *[F.count_if(F.expr(c.sql)) for c in parts]).first()
            alone = ", ".join(f"{c.sql}: {n}" for c, n in zip(parts, got[2:], strict=True))
            round_.memo[key] = Measure(got[1], got[0], True, f"{self.name} measured at {got[1]} rows of {got[0]} ({alone})", tuple((c.sql, n) for c, n in zip(parts, got[2:], strict=True)))
            log.debug(round_.memo[key].note)
        return round_.memo[key]

    def estimated(self, counted: str, rest: list[float]) -> float | None:
        """Rows of a predicate of which a part is counted, each condition once,
        and the rest known only by the planner's shares, taken as independent."""
        m = self.rows(counted)
        return None if m is None else m.rows * math.prod(rest)

    def stats(self, column: str, most: int = 100) -> Stats | None:
        """Null share, distinct values and, if there are at most ``most``, how
        often each occurs. None over budget."""
        round_ = _round.get()
        key = (*self.identity(), "stats", column)
        if round_ is None or not on("column_statistics"):
            return None
        if key not in round_.memo:
            if not round_.budget.draw(f"{self.name}.{column}", self.size, stats=True):
                return None
            n, held, distinct = self.df.agg(F.count("*"), F.count(column), F.approx_count_distinct(column, 0.02)).first()
            values: dict = {}
            if distinct <= 1.2 * most:
                found = self.df.where(F.col(column).isNotNull()).groupBy(column).count().limit(most + 1).collect()
                values = {r[0]: r[1] / n for r in found} if len(found) <= most else {}
                distinct = len(found) if len(found) <= most else distinct
            if not values:
                low, high = self.df.agg(F.min(column), F.max(column)).first()
                if isinstance(self.df.schema[column].dataType, (T.IntegralType, T.DateType)) and held and (d := high - low):
                    gap = (d if isinstance(d, int) else d.days) + 1
                    distinct = gap if gap <= held else distinct
            round_.memo[key] = Stats((n - held) / n if n else 0.0, distinct, values)
        return round_.memo[key]

    def word_rows(self, column: str, q: words.Query) -> float | None:
        """Rows a word query holds: each word's rows counted, shares combined."""
        round_ = _round.get()
        if round_ is None or not on("word_counts") or not round_.budget.draw(f"{self.name}.{column} words", self.size):
            return None
        found: list[str] = []

        def gather(x: words.Query) -> None:
            for y in x.of:
                found.append(y) if isinstance(y, str) else gather(y)

        gather(q)
        toks = words.tokens(F.col(column))
        got = self.df.agg(F.count(column), *[F.count_if(F.array_contains(toks, w)) for w in found]).first()
        at = {w: n / got[0] if got[0] else 0.0 for w, n in zip(found, got[1:], strict=True)}
        return got[0] * words.share(q, at.__getitem__)

    def pattern_rows(self, column: str, pattern: str, cased: bool = False) -> int | None:
        """An upper bound of the rows that match a LIKE pattern: the fewest rows
        any trigram it requires is in. A cased pattern with letters is not
        measured, nor one that requires no trigram."""
        need = words.required(pattern)
        round_ = _round.get()
        if cased and not words.caseless(pattern) or not need or round_ is None or not on("word_counts") or not round_.budget.draw(f"{self.name}.{column} trigrams", self.size):
            return None
        grams = words.trigrams(F.col(column))
        return min(self.df.agg(*[F.count_if(F.array_contains(grams, g)) for g in need]).first())


@dataclass(frozen=True)
class Stats:
    nulls: float
    distinct: int
    values: dict


def cell_table(df: DataFrame, at: list[str], size: float) -> DataFrame:
    """Rows per cell of a grid over point columns: cell0, cell1, .. and n."""
    cells = [F.floor(F.col(c) / size).alias(f"cell{i}") for i, c in enumerate(at)]
    return df.where(" and ".join(f"`{c}` is not null" for c in at)).groupBy(*cells).agg(F.count("*").alias("n"))


def region_rows(cells: DataFrame, size: float, centre: list[float], radius: float, box: bool = False, most: int = 100_000, sphere: float | None = None, coarsen: bool = False) -> float | None:
    """Rows in a ball (or box of half side radius) by its cells: whole ones
    count in full, those on the edge by the share of their extent inside; of
    places on a ``sphere`` around the origin, by the share of its surface. Only
    cells the region touches are read, ``most`` of them at most, else None; or,
    with ``coarsen``, they are added up to cells twice as wide until they fit.
    """
    while True:
        near = F.lit(True)
        for i, c in enumerate(centre):
            near = near & F.col(f"cell{i}").between(math.floor((c - radius) / size), math.floor((c + radius) / size))
        found = cells.where(near).limit(most + 1).collect()
        if len(found) <= most:
            break
        if not coarsen or len(found) <= 2 ** len(centre):
            return None
        cells = cells.groupBy(*[F.floor(F.col(f"cell{i}") / 2).alias(f"cell{i}") for i in range(len(centre))]).agg(F.sum("n").alias("n"))
        size *= 2
    total, ball = 0.0, region.Cube.around(centre, radius)
    for r in found:
        key = region.Cube(tuple(float(x) * size for x in r[:-1]), tuple((float(x) + 1) * size for x in r[:-1]))
        if region.contains(ball, key) and (box or region.farthest(key, centre) < radius):
            share = 1.0
        elif not region.overlaps(ball, key) or not box and region.nearest(key, centre) >= radius:
            share = 0.0
        elif sphere is not None:
            share = region.sphere_box(centre, radius, key, sphere, also_ball=False) if box else region.sphere_share(key, centre, radius, sphere)
        else:
            share = region.box_share(key, ball) if box else region.ball_share(key, centre, radius)
        total += r["n"] * share
    return total


def one_value(spark: SparkSession, text: str, by: list[str], joined_on: list[tuple[str, str]] = ()) -> bool:
    """Whether all rows a predicate selects lie in one group: every grouping
    column is fixed by an equality, itself or through equated columns."""
    fixed = {c.column.strip("`") for c in conditions(spark, text) if c.kind == "equal"}
    while more := {b for a, b in [*joined_on, *((b, a) for a, b in joined_on)] if a in fixed and b not in fixed}:
        fixed |= more
    return set(by) <= fixed


def whole(shares: dict, nulls: float) -> dict:
    """Shares scaled so that they and the nulls make 1."""
    total = sum(shares.values())
    return {k: v * (1 - nulls) / total for k, v in shares.items()} if total else shares


def fit(shares: dict, nulls: float) -> dict:
    """Shares scaled down only if with the nulls they exceed 1."""
    total = sum(shares.values())
    return whole(shares, nulls) if total + nulls > 1 else shares


def members(all_: list[tuple[int, Stats]]) -> Stats:
    """Statistics of a table from those of its members, given with their rows."""
    n = sum(r for r, _ in all_)
    if not n:
        return Stats(0.0, 0, {})
    values: dict = {}
    for r, s in all_:
        for k, v in s.values.items():
            values[k] = values.get(k, 0.0) + v * r / n
    known = all(s.values or not s.distinct for _, s in all_)
    return Stats(sum(r * s.nulls for r, s in all_) / n, len(values) if known else max(s.distinct for _, s in all_), values if known else {})


def at_most_one(df: DataFrame, keys: list[str], text: str) -> bool:
    """Whether equalities fix every column of a unique key."""
    fixed = {c.column.strip("`") for c in conditions(df.sparkSession, text) if c.kind == "equal"}
    return set(keys) <= fixed


def sized(left: DataFrame, right: Watched, text: str, on, how: str = "inner", most_bytes: int = 32 << 20) -> DataFrame:
    """left joined with right's rows that a predicate selects: broadcast if
    the measured rows are few by bytes, shuffled else or if not measured."""
    m = right.rows(text)
    few = m is not None and m.of and right.size * m.rows / m.of <= most_bytes
    side = right.df.where(text)
    return left.join(F.broadcast(side) if few else side, on, how)
