"""Cheaper spellings that return the same rows.

``union_join`` makes a join that every arm of a union shares once. ``TwoSided``
groups both sides of a join before it, and groups the second side only at keys
that the first holds. What can't be proved equal is refused, and the caller
keeps the query as written.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..features import on as on_
from .measure import measuring


class Refused(ValueError):
    """A rewrite whose conditions don't hold."""


def union_join(shared: DataFrame, arms: list[DataFrame], on: list[str]) -> DataFrame:
    """(X join a) union all (X join b) as X join (a union all b): shared is
    read and shuffled once. Arms need the same columns."""
    if len({tuple(a.columns) for a in arms}) != 1:
        raise Refused("the arms' columns differ")
    if set(shared.columns) & set(arms[0].columns) != set(on):
        raise Refused("a column outside the key is on both sides")
    if not on_("union_join"):
        return reduce(DataFrame.unionByName, [shared.join(a, on) for a in arms])
    return shared.join(reduce(DataFrame.unionByName, arms), on)


@dataclass(frozen=True)
class Agg:
    """count_rows, count_distinct, sum, min or max of a column of a side ('a' or 'b')."""

    kind: str
    alias: str
    side: str = "a"
    column: str | None = None


@dataclass
class TwoSided:
    """A grouping over the inner equi-join of sides a and b on ``key``.

    ``unique`` names the columns of a of which each value lies under one key:
    only those can be counted distinct after grouping by key.
    """

    a: DataFrame
    b: DataFrame
    key: list[str]
    by_a: list[str]
    by_b: list[str]
    aggs: list[Agg]
    unique: set[str] = field(default_factory=set)

    def check(self) -> None:
        both = set(self.a.columns) & set(self.b.columns)
        if both != set(self.key):
            raise Refused(f"columns {sorted(both - set(self.key))} are on both sides")
        if not set(self.by_a) <= set(self.a.columns) or not set(self.by_b) <= set(self.b.columns) - set(self.key):
            raise Refused("a group column is not of its side")
        for g in self.aggs:
            kinds = {f.name: f.dataType for f in (self.a if g.side == "a" else self.b).schema}
            if g.kind == "count_rows":
                continue
            if g.column not in kinds:
                raise Refused(f"{g.column} is not of side {g.side}")
            if g.kind == "count_distinct" and (g.side != "a" or g.column not in self.unique):
                raise Refused(f"{g.column} may lie under several keys: its distinct values can't be added up")
            if g.kind == "sum" and not isinstance(kinds[g.column], (T.IntegralType, T.DecimalType)):
                raise Refused(f"a sum over {kinds[g.column].simpleString()} depends on its order")
            if g.kind not in ("count_distinct", "sum", "min", "max"):
                raise Refused(f"{g.kind} can't be split")

    def written(self) -> DataFrame:
        """The query as it stands: join, then group."""
        made = {"count_rows": lambda g: F.count("*"), "count_distinct": lambda g: F.count_distinct(g.column), "sum": lambda g: F.sum(F.col(g.column).cast("decimal(38,0)") if self._whole(g) else F.col(g.column)), "min": lambda g: F.min(g.column), "max": lambda g: F.max(g.column)}
        return self.a.join(self.b, self.key).groupBy(*self.by_a, *self.by_b).agg(*[made[g.kind](g).alias(g.alias) for g in self.aggs])

    def _whole(self, g: Agg) -> bool:
        return isinstance((self.a if g.side == "a" else self.b).schema[g.column].dataType, T.IntegralType)

    def regrouped(self) -> DataFrame:
        """Grouped on each side first; side b only at keys that side a holds."""
        self.check()

        def grouped(df: DataFrame, side: str, by: list[str]) -> DataFrame:
            own = [g for g in self.aggs if g.side == side and g.kind != "count_rows"]
            made = {"count_distinct": F.count_distinct, "sum": F.sum, "min": F.min, "max": F.max}
            return df.groupBy(*dict.fromkeys(self.key + by)).agg(F.count("*").alias(f"_n_{side}"), *[made[g.kind](g.column).alias(f"_{g.alias}") for g in own])

        side_a = grouped(self.a, "a", self.by_a)
        b = self.b.join(side_a.select(*self.key), self.key, "left_semi") if on_("key_limited") else self.b
        side_b = grouped(b, "b", self.by_b)
        n = {s: F.col(f"_n_{s}").cast("decimal(38,0)") for s in "ab"}
        part = lambda g: F.col(f"_{g.alias}")

        def total(g: Agg):
            if g.kind == "count_rows":
                return F.sum(n["a"] * n["b"]).cast("bigint")
            if g.kind == "count_distinct":
                return F.sum(part(g)).cast("bigint")
            if g.kind == "sum":
                out = F.sum(part(g).cast("decimal(38,0)") * n["b" if g.side == "a" else "a"]) if self._whole(g) else F.sum(part(g) * n["b" if g.side == "a" else "a"])
                return out
            return (F.min if g.kind == "min" else F.max)(part(g))

        return side_a.join(side_b, self.key).groupBy(*self.by_a, *self.by_b).agg(*[total(g).alias(g.alias) for g in self.aggs])

    def reduction(self, side: str) -> float:
        """Rows left of each row of a side when it is grouped first, by the rows
        of one key in 64, which are counted whole; by all if no key is among them."""
        df, by = (self.a, self.by_a) if side == "a" else (self.b, self.by_b)
        keys = [F.col(f"`{k}`") for k in dict.fromkeys(self.key + by)]
        some = df.where(F.pmod(F.xxhash64(*self.key), F.lit(64)) == 0)
        for rows in (some, df):
            n, left = rows.agg(F.count("*"), F.count_distinct(F.struct(*keys))).first()
            if n:
                return left / n
        return 1.0

    def best(self) -> DataFrame:
        """The regrouped query, or the written one where that is refused, where
        the feature is off, or where a round of measures finds that grouping
        first leaves more than nine rows in ten of both sides."""
        if not on_("two_sided"):
            return self.written()
        try:
            out = self.regrouped()
        except Refused:
            return self.written()
        if measuring() and on_("row_counts") and min(self.reduction("a"), self.reduction("b")) > 0.9:
            return self.written()
        return out
