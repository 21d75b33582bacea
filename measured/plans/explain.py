"""What ran: executed plans as trees that compare, and figures of their scans."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NUMBERS = re.compile(r"#\d+L?|\[plan_id=\d+\]|\[id=#?\d+\]|, \[plan_id.*?\]|\(\d+\)|Location: \S+ ?\[[^\]]*\]")


@dataclass(frozen=True)
class Node:
    depth: int
    text: str


def tree(df: DataFrame) -> list[Node]:
    """The physical plan, a node a line, without numbers that differ from one
    planning to the next."""
    out = []
    for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
        m = re.match(r"^([\s:|+*()\d-]*)(.*)$", line)
        if m and m[2]:
            out.append(Node(len(m[1]), NUMBERS.sub("", m[2]).strip()))
    return out


def parting(a: DataFrame, b: DataFrame) -> tuple[Node | None, Node | None] | None:
    """The first nodes in which two plans differ; None if they are equal."""
    x, y = tree(a), tree(b)
    for p, q in zip(x, y, strict=False):
        if p != q:
            return p, q
    if len(x) == len(y):
        return None
    return (x[len(y)], None) if len(x) > len(y) else (None, y[len(x)])


@dataclass(frozen=True)
class Leaf:
    relation: str
    figures: dict[str, int]


def leaves(df: DataFrame) -> list[Leaf]:
    """Runs a query without keeping its rows and gives its scans' figures: rows
    out, files, bytes and time, from Spark's own metrics."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.execute().count()
    out: list[Leaf] = []

    def walk(node) -> None:
        kids = node.children()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        if kids.isEmpty() and "Scan" in name:
            metrics = node.metrics()
            it, found = metrics.iterator(), {}
            while it.hasNext():
                kv = it.next()
                found[kv._1()] = kv._2().value()
            out.append(Leaf(node.nodeName(), found))
        for i in range(kids.size()):
            walk(kids.apply(i))
        return None

    walk(plan)
    return out


def agreement(estimated: float, actual: float, slack: float = 0.5) -> bool:
    """Whether an estimate is right but for rounding: within slack rows, or a
    thousandth."""
    return abs(estimated - actual) <= max(slack, abs(actual) / 1000)


def counted(df: DataFrame) -> tuple[DataFrame, object]:
    """df with a witness that counts its rows as they pass."""
    from pyspark.sql import Observation

    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen
