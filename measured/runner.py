"""Runs a question set: reference answers, checks, timed runs and summaries."""

from __future__ import annotations

import time
from collections.abc import Callable
from contextlib import nullcontext

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .features import using, watched
from .functions.digest import digest
from .sources.tables import declared

Question = Callable[[SparkSession, str], DataFrame]

EXPECTED = declared(question="Text", rows="Int", digest="Text")
RESULTS = declared(question="Text", target="Text", phase="Text", rep="Int", verdict="Text", rows="Int", digest="Text", ms="Float", error="Text")

# Verdicts from worst to best, and exit statuses.
LADDER = ["WRONG", "TIMEOUT", "CANCELLED", "ERROR", "NOT RUN", "EXPLAIN FAILED", "RIGHT"]
STATUS = {"RIGHT": 0, "ERROR": 1, "WRONG": 2, "TIMEOUT": 3, "NOT RUN": 4, "EXPLAIN FAILED": 5, "CANCELLED": 130}


class Unsteady(Exception):
    """A question that answers differently twice has no reference answer."""


def truth(spark: SparkSession, folder: str, questions: dict[str, Question]) -> DataFrame:
    """Each question answered twice; both answers must agree."""
    rows = []
    for name, q in questions.items():
        one, two = digest(q(spark, folder)), digest(q(spark.newSession(), folder))
        if one != two:
            raise Unsteady(name)
        rows.append((name, *one))
    return spark.createDataFrame(rows, EXPECTED)


def verdict(found: tuple[int, str] | None, expected: tuple[int, str] | None, error: str | None) -> str:
    if error is not None:
        return "TIMEOUT" if "timed out" in error else "CANCELLED" if "cancelled" in error.lower() else "ERROR"
    if found is None or expected is None:
        return "NOT RUN"
    return "RIGHT" if found == expected else "WRONG"


def derived(spark: SparkSession, folder: str, question: Question, spellings: dict[str, Question]) -> dict[str, str]:
    """The verdict of each other spelling of a question: it answers as that one
    if its rows are the same."""
    want = digest(question(spark, folder))
    out = {}
    for name, q in spellings.items():
        found, error = None, None
        try:
            found = digest(q(spark, folder))
        except Exception as e:  # a spelling that fails has a verdict too
            error = str(e)[:500] or type(e).__name__
        out[name] = verdict(found, want, error)
    return out


def run(spark: SparkSession, folder: str, targets: dict[str, dict[str, Question]], expected: DataFrame, cold: int = 1, warm: int = 3, seconds: float | None = None, sets: dict[str, str] | None = None) -> DataFrame:
    """Answers every question on every target (a way to answer it) and holds
    each against the reference: first cold, in a new session with nothing
    cached, then warm. The targets' order turns by one from question to
    question. ``seconds`` ends an answer that takes longer; ``sets`` names the
    feature set that a target is answered with."""
    right = {r["question"]: (r["rows"], r["digest"]) for r in expected.collect()}
    rows, names = [], list(targets)
    for i, name in enumerate(dict.fromkeys(n for t in targets.values() for n in t)):
        for phase, reps in (("cold", cold), ("warm", warm)):
            for rep in range(reps):
                for target in names[i % len(names) :] + names[: i % len(names)]:
                    q = targets[target].get(name)
                    found, error, began = None, None, time.perf_counter()
                    if q is not None:
                        own = spark.newSession() if phase == "cold" else spark
                        if phase == "cold":
                            spark.catalog.clearCache()
                        try:
                            with using((sets or {}).get(target, "all")), watched(own, seconds) if seconds else nullcontext():
                                found = digest(q(own, folder))
                        except Exception as e:  # an answer that fails is a result too
                            error = str(e)[:500]
                    ms = (time.perf_counter() - began) * 1000
                    rows.append((name, target, phase, rep, verdict(found, right.get(name), error), *(found or (None, None)), ms if found else None, error))
    return spark.createDataFrame(rows, RESULTS)


def check(spark: SparkSession, folder: str, questions: dict[str, Question], expected: DataFrame) -> DataFrame:
    """Each question once, without timing."""
    return run(spark, folder, {"check": questions}, expected, cold=0, warm=1).drop("ms")


def summarise(results: DataFrame) -> DataFrame:
    """Per question, target and phase: the worst verdict, how many repetitions
    were right, and the middle and spread of the right ones' times; null if
    any repetition was not right."""
    rank = F.array_position(F.array(*map(F.lit, LADDER)), F.col("verdict"))
    g = results.groupBy("question", "target", "phase").agg(F.count("*").alias("reps"), F.count_if(F.col("verdict") == "RIGHT").alias("right"), F.min(rank).alias("worst"), F.median("ms").alias("ms"), F.min("ms").alias("low"), F.max("ms").alias("high"))
    all_ = F.col("right") == F.col("reps")
    text = F.when(F.round("low", 2) == F.round("high", 2), F.round("low", 2).cast("string")).otherwise(F.concat(F.round("low", 2).cast("string"), F.lit(".."), F.round("high", 2).cast("string")))
    return g.select("question", "target", "phase", "reps", "right", F.element_at(F.array(*map(F.lit, LADDER)), F.col("worst").cast("int")).alias("verdict"), F.when(all_, F.col("ms")).alias("ms"), F.when(all_, text).alias("range"))


def grid(summary: DataFrame) -> DataFrame:
    """Middle warm times, a row per question and a column per target."""
    return summary.where("phase = 'warm'").groupBy("question").pivot("target").agg(F.first("ms")).orderBy("question")


def status(summary: DataFrame) -> int:
    """An exit status: that of the worst verdict."""
    found = {r[0] for r in summary.select("verdict").distinct().collect()}
    return STATUS[next(v for v in LADDER if v in found)] if found else STATUS["NOT RUN"]
