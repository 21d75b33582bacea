"""Reports over certified runs and their scans, declared quick checks, what a
target is, and the choice of each table's key."""

from __future__ import annotations

import fcntl
import json
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.digest import fingerprint
from .sources.tables import declared

SCANS = declared(question="Text", target="Text", relation="Text", filter="Text", estimated="Float", actual="Float", loops="Int", read="Int", witnessed="Int")


def rows_report(scans: DataFrame, answers: DataFrame) -> DataFrame:
    """For each question and target: rows answered, rows its scans were thought
    to give and rows they read, and rows read for each one answered."""
    g = scans.groupBy("question", "target").agg(F.sum(F.col("estimated") * F.col("loops")).alias("estimated"), F.sum("read").alias("read"))
    per = F.when(F.col("rows") > 0, F.round(F.col("read") / F.col("rows"), 2))
    return g.join(answers.select("question", F.col("rows").alias("rows")), "question").select("question", "target", F.col("rows").alias("answered"), "estimated", "read", per.alias("read_per_answer"))


def scans_report(scans: DataFrame) -> DataFrame:
    """Each scan's estimate and rows a loop, worst first: by how many times one
    is the other."""
    times = lambda a, b: F.greatest(a, F.lit(1.0)) / F.greatest(b, F.lit(1.0))
    off = F.greatest(times(F.col("estimated"), F.col("actual")), times(F.col("actual"), F.col("estimated")))
    return scans.select("question", "target", "relation", "filter", "estimated", "actual", F.round(off, 3).alias("off")).orderBy(F.desc("off"), "question", "target", "relation", "filter")


def disagreements(scans: DataFrame, slack: float = 0.5) -> DataFrame:
    """Scans whose rows differ from target to target by more than rounding."""
    g = scans.groupBy("question", "relation", "filter").agg(F.min("actual").alias("least"), F.max("actual").alias("most"), F.count("*").alias("targets"))
    return g.where(F.col("most") - F.col("least") > F.greatest(F.lit(slack), F.col("most") / 1000))


def moved(scans: DataFrame, one: str, other: str) -> DataFrame:
    """Scans that two targets estimate differently."""
    keys = ["question", "relation", "filter"]
    of = lambda t, name: scans.where(F.col("target") == t).select(*keys, F.col("estimated").alias(name))
    return of(one, "was").join(of(other, "is"), keys).where("not was <=> is")


def unwitnessed(scans: DataFrame) -> DataFrame:
    """Filtered scans whose rows no counter saw."""
    return scans.where("filter is not null and witnessed is null").select("question", "target", "relation", "filter")


def samples(path: str | Path) -> dict[str, dict]:
    """Declared quick checks from JSON: {"samples": {name: {"questions": [..],
    "folder": ..}}}. Anything else is refused."""
    found = json.loads(Path(path).read_text())
    if set(found) != {"samples"}:
        raise ValueError(f"unknown keys {sorted(set(found) - {'samples'})}")
    for name, s in found["samples"].items():
        if set(s) != {"questions", "folder"} or not s["questions"]:
            raise ValueError(f"{name}: a sample has questions and a folder")
    return found["samples"]


@contextmanager
def alone(path: str | Path) -> Iterator[None]:
    """Holds a lock file for a block, so that one quick check runs at a time;
    another is refused."""
    with open(path, "w") as f:
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except BlockingIOError as e:
            raise RuntimeError(f"{path} is held by another check") from e
        yield


# Settings that answers or times may hang on.
SETTINGS = ("spark.master", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.ansi.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.files.maxPartitionBytes", "spark.sql.session.timeZone", "spark.driver.memory", "spark.executor.memory")


def target(spark: SparkSession, tables: dict[str, DataFrame]) -> dict[str, str]:
    """What a target is: version, settings, each table's files and bytes, and a
    fingerprint of all that; alike for two targets that are set up alike."""
    out = {"version": spark.version} | {k: str(spark.conf.get(k, None) or spark.sparkContext.getConf().get(k)) for k in SETTINGS}
    for name, df in sorted(tables.items()):
        out[f"table {name}"] = f"{len(df.inputFiles())} files, {int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))} bytes"
    return out | {"fingerprint": fingerprint(*[x.encode() for k in sorted(out) for x in (k, out[k])])}


@dataclass(frozen=True)
class Registered:
    table: str
    key: str | None
    refused: str | None


def register_all(tables: dict[str, DataFrame], keys: dict[str, list[tuple[str, ...]]], primary: dict[str, tuple[str, ...]] | None = None, root_of: dict[str, str] | None = None, apply=None) -> list[Registered]:
    """Chooses each table's key: the primary one, else of the declared unique
    ones that which has the fewest columns; a partition takes its root's. Every
    table is named, with why it is refused: no key, null or repeated keys.
    Nothing is done but reported, unless ``apply`` is given: then it is called
    with each table and key, and what it registered is checked again."""
    out = []
    for name, df in tables.items():
        of = (root_of or {}).get(name, name)
        chosen = (primary or {}).get(of) or min(keys.get(of, []), key=lambda k: (len(k), k), default=None)
        if chosen is None:
            out.append(Registered(name, None, "no key"))
            continue
        if missing := [c for c in chosen if c not in df.columns]:
            out.append(Registered(name, None, f"no column {', '.join(missing)}"))
            continue
        n, held, nulls = df.agg(F.count("*"), F.count_distinct(F.struct(*chosen)), F.count_if(F.greatest(*[F.col(c).isNull().cast("int") for c in chosen], F.lit(0)) > 0)).first()
        why = "null keys" if nulls else "repeated keys" if held != n else None
        out.append(Registered(name, None if why else ",".join(chosen), why))
        if apply and not why:
            apply(name, chosen)
    return out
