"""Sessions and settings that hold for a while."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession


def session(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the settings every query here takes for granted."""
    b = SparkSession.builder.master(master)
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.cbo.enabled": "true", "spark.sql.cbo.joinReorder.enabled": "true", "spark.ui.enabled": "false"}
    for k, v in (fixed | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def reach(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver did, for
    sessions that were started without it on their path."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH", "")]))


@contextmanager
def settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Settings (dots written as __) for a block, put back after it, errors
    included."""
    names = {k.replace("__", "."): v for k, v in conf.items()}
    was = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in was.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
