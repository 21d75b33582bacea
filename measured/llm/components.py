"""Connected components of a table of links, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """node and label (the smallest node reachable) of every node in ``links``
    (a, b), by alternating large and small stars; a written table.

    Each round turns every node's links to the smallest node it knows, until
    only stars are left, after a number of rounds that grows with the log of
    the longest path. Minima are taken before the shuffle, so a node with very
    many links is no large group. Self-links and repeated links do no harm; no
    links give an empty table.
    """
    e = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    was = None
    while (now := mark(e)) != was:
        was = now
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
        large = written(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large")
        #: Large stars link each node to smaller ones only, so few rows share a node.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.greatest("b", "m").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        new = written(small.where("a <> b").distinct(), "links")
        for t in (e, low, large):
            drop_written(t)
        e = new
    return written(e.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()), "labels")
