"""Feature sets: which measures and rewrites are on, by name; and a watch
that ends what takes too long or too much.

Rewrites and measures ask on() before they act; what is off leaves the query as
it is written, and a measure unknown, so rows are the same with any set.
"""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import SparkSession

FEATURES = ("union_join", "two_sided", "key_limited", "row_counts", "column_statistics", "word_counts", "closures")


def resolved(name: str, declared: dict[str, list[str]] | None = None) -> frozenset[str]:
    """The features of a set: all, none, only:x, without:x or a declared one;
    what isn't known is refused."""
    own = declared or {}
    if name == "all":
        return frozenset(FEATURES)
    if name == "none":
        return frozenset()
    kind, _, one = name.partition(":")
    if kind in ("without", "only") and one in FEATURES:
        return frozenset(FEATURES) - {one} if kind == "without" else frozenset({one})
    if name in own:
        if unknown := set(own[name]) - set(FEATURES):
            raise ValueError(f"{name}: unknown features {sorted(unknown)}")
        return frozenset(own[name])
    raise ValueError(f"no feature set {name}")


def read_sets(path: str | Path) -> dict[str, list[str]]:
    """Declared sets from JSON: {"sets": {name: [feature, ...]}}; other keys
    are refused."""
    found = json.loads(Path(path).read_text())
    if set(found) != {"sets"}:
        raise ValueError(f"unknown keys {sorted(set(found) - {'sets'})}")
    for name in found["sets"]:
        resolved(name, found["sets"])
    return found["sets"]


_active: ContextVar[frozenset[str]] = ContextVar("features", default=frozenset(FEATURES))


def on(feature: str) -> bool:
    """Whether a feature is on here."""
    if feature not in FEATURES:
        raise ValueError(f"no feature {feature}")
    return feature in _active.get()


@contextmanager
def using(name: str, declared: dict[str, list[str]] | None = None) -> Iterator[frozenset[str]]:
    """A feature set for a block; errors put the one before back too."""
    token = _active.set(resolved(name, declared))
    try:
        yield _active.get()
    finally:
        _active.reset(token)


class TimedOut(Exception):
    pass


def resident() -> int:
    """Bytes of memory of this process."""
    return int(Path("/proc/self/statm").read_text().split()[1]) * 4096


@contextmanager
def watched(spark: SparkSession, seconds: float, most_bytes: int | None = None) -> Iterator[None]:
    """Cancels the block's Spark jobs after some seconds or above a size of
    this process; the block then ends with TimedOut."""
    group, over, done = f"watched-{time.time_ns()}", [], threading.Event()
    spark.sparkContext.setJobGroup(group, "watched", interruptOnCancel=True)

    def watch() -> None:
        end = time.monotonic() + seconds
        while not done.wait(0.05):
            if time.monotonic() > end or most_bytes is not None and resident() > most_bytes:
                over.append(True)
                spark.sparkContext.cancelJobGroup(group)

    t = threading.Thread(target=watch, daemon=True)
    t.start()
    try:
        yield
    except Exception as e:
        if over:
            raise TimedOut(f"timed out after {seconds} s or above {most_bytes} bytes") from e
        raise
    finally:
        done.set()
        t.join()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    if over:
        raise TimedOut(f"timed out after {seconds} s or above {most_bytes} bytes")
