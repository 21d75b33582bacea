"""Rows in all of several conditions, by one covering pass or by addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .measure import Condition, Watched, conditions

#: Bytes an address takes.
ADDRESS = 8


def testable(c: Condition, stored: set[str]) -> bool:
    """Whether a condition compares a stored column itself, nothing computed of
    it, with constants, or tests it for null; so that values kept beside
    another condition's decide it."""
    return c.kind in ("equal", "range", "list", "null", "notnull") and c.column.strip("`") in stored


def on_entries(table: Watched, text: str, stored: set[str]) -> int | None:
    """Rows in all conditions by one pass over the stored columns alone; None if
    one of them can't be tested there."""
    parts = conditions(table.spark, text)
    if not all(testable(c, stored) for c in parts):
        return None
    need = sorted({c.column.strip("`") for c in parts})
    return table.df.select(*need).agg(F.count_if(F.expr(" AND ".join(f"({c.sql})" for c in parts)))).first()[0]


def addresses(df: DataFrame, c: Condition) -> DataFrame:
    """Where the rows of a condition lie: file and place, for tables read from
    Parquet files."""
    return df.where(c.sql).select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))


def by_addresses(table: Watched, text: str, room: int) -> int | None:
    """Rows in all conditions by meeting their addresses, the fewest first. Lists
    that are larger than an eighth of ``room`` bytes are left out if another is
    kept: what they'd take away is unknown, so None is given then."""
    parts = conditions(table.spark, text)
    sizes = table.df.agg(*[F.count_if(F.expr(c.sql)) for c in parts]).first()
    order = sorted(zip(sizes, parts, strict=True), key=lambda x: x[0])
    if order[0][0] * ADDRESS > room // 8:
        return None
    met = addresses(table.df, order[0][1])
    for _, c in order[1:]:
        met = met.join(addresses(table.df, c), ["file", "place"], "left_semi")
    return met.count()
