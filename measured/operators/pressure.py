"""How busy the drive is, and how much memory may hold, while a query is planned."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

from ..session import settings

MOST_BUSY = 0.99


def weight(busy: float) -> float:
    """How much dearer a read is on a drive that is busy for a share of the time."""
    return 1 / (1 - min(max(busy, 0.0), MOST_BUSY))


def busy_share(device: str, stats: str = "/proc/diskstats", uptime: str = "/proc/uptime") -> float | None:
    """Share of the time since the start that a device has worked: the tenth
    figure after its name, in ms, of the uptime. None if it isn't listed."""
    for line in Path(stats).read_text().splitlines():
        f = line.split()
        if len(f) > 12 and f[2] == device:
            return int(f[12]) / 1000 / float(Path(uptime).read_text().split()[0])
    return None


@contextmanager
def weighted(spark: SparkSession, *busy: float | None) -> Iterator[float]:
    """Prices of opening files multiplied by the weight of the busiest drive of a
    statement while it is planned, and put back after, errors included."""
    w = max((weight(b) for b in busy if b is not None), default=1.0)
    was = spark.conf.get("spark.sql.files.openCostInBytes")
    with settings(spark, spark__sql__files__openCostInBytes=str(int(_bytes(was) * w))):
        yield w


@contextmanager
def clamped(spark: SparkSession) -> Iterator[int]:
    """The size up to which a side is broadcast held to the storage memory that
    is free on the fullest executor, while a query is planned."""
    status = spark.sparkContext._jsc.sc().getExecutorMemoryStatus()
    free = min(v._2() for v in _values(status))
    asked = _bytes(spark.conf.get("spark.sql.autoBroadcastJoinThreshold"))
    with settings(spark, spark__sql__autoBroadcastJoinThreshold=str(min(asked, free))):
        yield min(asked, free)


def _values(mapping) -> list:
    it, out = mapping.valuesIterator(), []
    while it.hasNext():
        out.append(it.next())
    return out


def _bytes(text: str) -> int:
    """Bytes of a setting such as 10MB or 4194304b."""
    text = text.strip().lower().removesuffix("ib").removesuffix("b")
    unit = {"k": 10, "m": 20, "g": 30, "t": 40}.get(text[-1:], 0)
    return int(text[:-1] if unit else text) << unit
