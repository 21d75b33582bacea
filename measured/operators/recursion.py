"""Walks of parent-child tables, and the size of a recursive closure.

A walk goes level by level: the children of a frontier are the next one. Where
the two columns of the edges are small, by their count, the levels are arrays on
the driver; beyond that each is a table written to the shared folder, joined
with the edges, and read by the next. Both give the same rows.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..features import on

#: Edges, and rows of a walk, that are held as arrays on the driver at most.
SMALL = 500_000


class TooLarge(Exception):
    """A walk with more rows than are held on the driver."""


def folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one where none
    is set and both are one process."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="measured-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def tables(spark: SparkSession) -> Iterator:
    """A function that writes a table to the shared folder and reads it back;
    tables are deleted if the block fails."""
    made: list[str] = []

    def write(df: DataFrame) -> DataFrame:
        made.append(f"{folder(spark)}/level-{uuid.uuid4().hex}")
        df.write.parquet(made[-1])
        return spark.read.schema(df.schema).parquet(made[-1])

    try:
        yield write
    except BaseException:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for x in made:
            p(x).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p(x), True)
        raise


def _pairs(df: DataFrame, *columns: str) -> pd.DataFrame | None:
    """Columns on the driver, or None if they are more than SMALL rows."""
    got = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)]).limit(SMALL + 1).toArrow()
    return None if got.num_rows > SMALL else got.to_pandas(types_mapper=pd.ArrowDtype)


class Edges:
    """Children of each node, as arrays: nodes are numbered, children lie
    together by parent."""

    def __init__(self, edges: pd.DataFrame, start: pd.Series):
        both = pd.concat([edges["c0"], edges["c1"], start], ignore_index=True)
        code, self.names = pd.factorize(both, use_na_sentinel=True)
        n = len(edges)
        child, parent, self.start = code[:n], code[n : 2 * n], code[2 * n :]
        order = np.argsort(parent, kind="stable")
        self.child, self.parent = child[order], parent[order]

    def below(self, front: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Children of each node of a frontier, and the place of their parent in it."""
        low, high = np.searchsorted(self.parent, front, "left"), np.searchsorted(self.parent, front, "right")
        low = np.where(front < 0, high, low)
        n = high - low
        of = np.repeat(np.arange(len(front)), n)
        return self.child[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)], of


def _small_walk(nodes: DataFrame, start: DataFrame, node: str, parent: str, levels: int | None) -> DataFrame | None:
    """_root and _node of a walk, or None if it is large."""
    first = _pairs(start, node)
    edges = _pairs(nodes, node, parent) if first is not None else None
    if edges is None:
        return None
    e = Edges(edges, first["c0"])
    front = root = e.start
    out, rows, level = [(root, front)], len(front), 0
    while len(front):
        front, of = e.below(front)
        root = root[of]
        level += len(front) > 0
        rows += len(front)
        if level > (levels if levels is not None else len(e.names)):
            raise RecursionError(f"more than {level - 1} levels")
        if rows > SMALL:
            return None
        out.append((root, front))
    roots, found = (np.concatenate([x[i] for x in out]) for i in (0, 1))
    kind = start.schema[node].dataType
    name = lambda codes: pa.array(pd.Series(e.names).take(np.maximum(codes, 0)).where(codes >= 0) if len(e.names) else pd.Series([None] * len(codes)), from_pandas=True)
    made = pa.table({"_root": name(roots), "_node": name(found)})
    return start.sparkSession.createDataFrame(made).select(F.col("_root").cast(kind), F.col("_node").cast(nodes.schema[node].dataType))


def walk(nodes: DataFrame, start: DataFrame, node: str = "id", parent: str = "parent_id", levels: int | None = None) -> DataFrame:
    """Rows of start with all their descendants: every column of start is
    carried along from each root, as WITH RECURSIVE .. UNION ALL does, so a node
    comes once for each way to it. On a cycle, or below more than ``levels``
    levels, RecursionError is raised. No null is anyone's parent."""
    rest = [c for c in start.columns if c != node]
    own = [F.col(f"`{c}`") for c in rest]
    small = _small_walk(nodes, start.select(f"`{node}`").distinct() if rest else start, node, parent, levels)
    if small is not None:
        if not rest:
            return small.select(F.col("_node").alias(node))
        roots = start.withColumnRenamed(node, "_root")
        return roots.join(F.broadcast(small), roots["_root"].eqNullSafe(small["_root"])).select(F.col("_node").alias(node), *own).select(*[F.col(f"`{c}`") for c in start.columns])
    edges = nodes.select(F.col(f"`{node}`").alias("_n"), F.col(f"`{parent}`").alias("_p"))
    with tables(nodes.sparkSession) as write:
        edges = write(edges.where("_p is not null"))
        most = levels if levels is not None else edges.count() + 1
        front = write(start)
        all_ = [front]
        while True:
            step = edges.join(front, edges["_p"] == front[node]).select(F.col("_n").alias(node), *own).select(*[F.col(f"`{c}`") for c in start.columns])
            front = write(step)
            if front.isEmpty():
                return reduce(DataFrame.unionByName, all_)
            if len(all_) > most:
                raise RecursionError(f"more than {most} levels")
            all_.append(front)


def counting(spark: SparkSession, first: int, below: int, step: int) -> DataFrame:
    """id: first, first + step, .. while less than ``below``: a recursion whose
    step reads no table is a range, dealt over all tasks."""
    return spark.range(first, max(below, first + 1), step)


@dataclass
class Closure:
    """rows of the closure (distinct), whole unless a limit stopped it."""

    rows: int
    whole: bool
    tallies: dict[object, int] | None


def reached(edges: DataFrame, start: DataFrame, node: str = "id", parent: str = "parent_id", levels: int | None = None) -> DataFrame:
    """Nodes reached from start as UNION (distinct) finds them: a frontier that
    loses the known nodes each round, so cycles end."""
    first = _pairs(start, node)
    small = _pairs(edges, node, parent) if first is not None else None
    kind = start.schema[node].dataType
    if small is not None:
        e = Edges(small, first["c0"])
        seen = np.zeros(len(e.names) + 1, bool)
        front, level = np.unique(e.start), 0
        while len(front):
            seen[front] = True
            front = np.unique(e.below(front)[0])
            front = front[~seen[front]]
            level += len(front) > 0
            if levels is not None and level > levels:
                raise RecursionError(f"more than {levels} levels")
        #: The last place stands for null.
        found = [*pd.Series(e.names)[np.flatnonzero(seen[:-1])], *[None] * bool(seen[-1])]
        return start.sparkSession.createDataFrame(pa.table({"_node": pa.array(found, from_pandas=True)}) if found else pa.table({"_node": pa.array([], pa.int64())})).select(F.col("_node").cast(kind).alias(node))
    with tables(edges.sparkSession) as write:
        both = write(edges.select(F.col(f"`{node}`").alias("_n"), F.col(f"`{parent}`").alias("_p")).where("_p is not null"))
        front = write(start.select(F.col(f"`{node}`").alias("_p")).distinct())
        seen, level = front, 0
        while True:
            step = both.join(front, "_p").select(F.col("_n").alias("_p")).distinct()
            front = write(step.join(seen.withColumnRenamed("_p", "_s"), F.col("_p").eqNullSafe(F.col("_s")), "left_anti"))
            if front.isEmpty():
                return seen.withColumnRenamed("_p", node)
            level += 1
            if levels is not None and level > levels:
                raise RecursionError(f"more than {levels} levels")
            seen = seen.unionByName(front)


def closure_size(edges: DataFrame, start: DataFrame, most: int, node: str = "id", parent: str = "parent_id", tally: int = 10_000) -> Closure | None:
    """Counts a closure (UNION ALL) before a query is planned, up to ``most``
    rows. Keeps the number of rows of each value while there are at most
    ``tally``. Only counts leave: nothing of it is put into the plan.

    A level is the values of the one before with how often each is reached, so
    work is that of the distinct values, and none is counted again. None where
    the feature is off.
    """
    if not on("closures"):
        return None
    first = _pairs(start, node)
    small = _pairs(edges, node, parent) if first is not None else None
    if small is not None:
        return _small_closure(Edges(small, first["c0"]), most, tally)
    both = edges.select(F.col(f"`{node}`").alias("_n"), F.col(f"`{parent}`").alias("_p"))
    with tables(edges.sparkSession) as write:
        both = write(both)
        front = start.groupBy(F.col(f"`{node}`").alias("_n")).agg(F.count("*").alias("times"))
        rows, per = 0, {}
        while True:
            front = write(front)
            n, values = front.agg(F.sum("times"), F.count("*")).first()
            if not n:
                return Closure(rows, True, per)
            rows += n
            if per is not None and values <= tally:
                for v, k in front.collect():
                    per[v] = per.get(v, 0) + k
            if values > tally or per is not None and len(per) > tally:
                per = None
            if rows > most:
                return Closure(rows, False, None)
            front = both.join(front.withColumnRenamed("_n", "_p"), "_p").groupBy("_n").agg(F.sum("times").alias("times"))


def _small_closure(e: Edges, most: int, tally: int) -> Closure:
    """closure_size() by arrays; times are Python's whole numbers, which on a
    cycle grow past 64 bits."""
    front, n = np.unique(e.start, return_counts=True)
    times, rows, per = n.astype(object), 0, {}
    while len(front):
        rows += int(times.sum())
        if per is not None and len(front) <= tally:
            for v, k in zip(front, times, strict=True):
                name = None if v < 0 else e.names[v]
                per[name] = per.get(name, 0) + int(k)
        if len(front) > tally or per is not None and len(per) > tally:
            per = None
        if rows > most:
            return Closure(rows, False, None)
        below, of = e.below(front)
        front, place = np.unique(below, return_inverse=True)
        reached_ = np.zeros(len(front), object)
        np.add.at(reached_, place, times[of])
        times = reached_
    return Closure(rows, True, per)


def self_contained(spark: SparkSession, text: str) -> bool:
    """Whether a recursive query can be run before the query it is part of: it
    has no parameter, no function that changes from call to call, and every
    table and column it names is its own or the session's."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    if "Parameter" in plan.toString():
        return False
    try:
        done = spark._jsparkSession.sessionState().executePlan(plan, spark._jvm.org.apache.spark.sql.execution.CommandExecutionMode.SKIP()).analyzed()
    except Exception as e:  # a name that isn't there belongs to a query around it
        if "AnalysisException" in str(e) or "AnalysisException" in type(e).__name__:
            return False
        raise
    return done.deterministic() and "rand(" not in done.toString()
