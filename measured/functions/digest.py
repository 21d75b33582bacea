"""Canonical text of values, and a digest of a table that doesn't depend on
the order of its rows.

A row is its values one after another: 00 for null, else 01, the length in
four bytes (little-endian) and the canonical text. Rows are hashed twice by
FNV-1a from two starts, each finished by splitmix64, and the hashes are added
up modulo 2^64.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import reach

# The hash's starts and prime.
START_A, START_B, PRIME = 0xCBF29CE484222325, 0x6C62272E07BB0142, 0x100000001B3
FULL = (1 << 64) - 1


def float_text(x: float, single: bool = False) -> str:
    """Shortest text that reads back as the same number, without exponent."""
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "inf" if x > 0 else "-inf"
    return np.format_float_positional(np.float32(x) if single else np.float64(x), unique=True, trim="-")



def canonical(c: Column, kind: T.DataType) -> Column:
    """One text per value: integers plain, booleans t or f, decimals without
    trailing zeros, floats shortest, times to the microsecond where needed."""
    if isinstance(kind, T.BooleanType):
        return F.when(c, "t").when(~c, "f")
    if isinstance(kind, T.DecimalType):
        text = c.cast("string")
        return F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")).otherwise(text)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return _of_floats(c, isinstance(kind, T.FloatType))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        text = F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")
        return F.concat(text, F.lit("+00")) if isinstance(kind, T.TimestampType) else text
    return c.cast("string")


def _of_floats(c: Column, single: bool) -> Column:
    @F.pandas_udf("string")
    def text(a: pd.Series, null: pd.Series) -> pd.Series:
        return pd.Series([None if n else float_text(v, single) for v, n in zip(a, null, strict=True)])

    return text(c, c.isNull())


def encoded(df: DataFrame) -> Column:
    """Each row's bytes."""
    parts = []
    for f in df.schema:
        v = canonical(F.col(f"`{f.name}`"), f.dataType)
        raw = v.cast("binary")
        size = F.lpad(F.hex(F.octet_length(raw)), 8, "0")
        little = F.unhex(F.concat(*[F.substring(size, i, 2) for i in (7, 5, 3, 1)]))
        parts.append(F.coalesce(F.concat(F.unhex(F.lit("01")), little, raw), F.unhex(F.lit("00"))))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def fnv(start: int, data: bytes) -> int:
    h = start
    for b in data:
        h = (h ^ b) * PRIME & FULL
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & FULL
    h = (h ^ h >> 27) * 0x94D049BB133111EB & FULL
    return h ^ h >> 31


def digest(df: DataFrame) -> tuple[int, str]:
    """Number of rows, and 32 hexadecimal digits. Hashes are taken on the
    executors a column of bytes at a time, over all rows of a batch at once,
    and only sums of them travel."""
    reach(df.sparkSession)

    @F.pandas_udf("a decimal(20,0), b decimal(20,0)")
    def hashed(rows: pd.Series) -> pd.DataFrame:
        from decimal import Decimal

        sizes = rows.map(len).to_numpy()
        order = np.argsort(-sizes, kind="stable")
        flat = np.frombuffer(b"".join(rows), np.uint8).astype(np.uint64)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])[order] if len(sizes) else np.zeros(0, np.int64)
        left = sizes[order]
        out = []
        for start in (START_A, START_B):
            h = np.full(len(rows), start, np.uint64)
            for i in range(int(left[0]) if len(left) else 0):
                n = int(np.searchsorted(-left, -i, side="left"))
                h[:n] = (h[:n] ^ flat[starts[:n] + i]) * np.uint64(PRIME)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(31)
            back = np.empty_like(h)
            back[order] = h
            out.append([Decimal(int(v)) for v in back])
        return pd.DataFrame({"a": out[0], "b": out[1]})

    sums = df.select(hashed(encoded(df)).alias("h")).agg(F.count("*"), F.sum(F.col("h.a").cast("decimal(38,0)")), F.sum(F.col("h.b").cast("decimal(38,0)"))).first()
    return sums[0], f"{int(sums[1] or 0) & FULL:016x}{int(sums[2] or 0) & FULL:016x}"


def fingerprint(*parts: bytes) -> str:
    """A short name for some texts: the first sum of one row of them."""
    return f"{fnv(START_A, b''.join(b'\x01' + len(p).to_bytes(4, 'little') + p for p in parts)):016x}"
