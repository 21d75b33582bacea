"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import reach, settings

#: Bytes up to which the right side of a join is sent to every executor. They
#: are summed over that side, a written table; larger sides are shuffled.
BROADCAST_BYTES = 8 << 20

LOWER_AZ = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *wanted: tuple[str, str]) -> DataFrame:
    """The wanted columns, given as (name, type), and no others.

    Names are matched exactly and by position, so extra columns whose names
    differ in case only, or occur twice, do no harm: the first exact match is
    taken.
    """
    reach(df.sparkSession)
    flat = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"_{df.columns.index(n)}").cast(t).alias(n) for n, t in wanted])


def numbered(df: DataFrame) -> tuple[DataFrame, Callable[[str], Column]]:
    """df with columns named by number, which no extra column can clash with,
    and a function from an original name to its column. toDF(*df.columns) of
    what is made of it has the names again."""
    reach(df.sparkSession)
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))]), lambda n: F.col(f"_{df.columns.index(n)}")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where the session names none a temporary folder is used and the setting is
    made, if driver and executors are one process; on a cluster that is refused.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="measured-")
        atexit.register(shutil.rmtree, found.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends here and a
    lost executor costs nothing that was finished."""
    spark = df.sparkSession
    path = new_path(spark, name)
    #: Rows may be wide; a batch for Python holds few of them.
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="1000"):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._measured_path = path
    if _scopes:
        _scopes[-1].append(out)
    return out


_scopes: list[list[DataFrame]] = []


@contextmanager
def scope() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes what written() made inside the block, at its end or after an
    error, but for tables given to the function it yields: those a lazy result
    still reads. They belong to the scope around it, if there is one."""
    own: list[DataFrame] = []
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    _scopes.append(own)
    try:
        yield keep
    finally:
        _scopes.pop()
        stay = {x._measured_path for x in kept}
        drop_written(*[x for x in own if x._measured_path not in stay])
        if _scopes:
            _scopes[-1].extend(kept)


def drop_written(*tables: DataFrame) -> None:
    """Deletes tables made by written() that nothing will read again."""
    for df in tables:
        remove(df.sparkSession, df._measured_path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def width(c: Column, kind: T.DataType) -> Column:
    """Bytes of a value, about, and not less than Spark's own rows take."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        each = 16 * len(kind.elementType.fields) + 24 if isinstance(kind.elementType, T.StructType) else 16
        return F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)) * each + 24
    return F.lit(16)


def joined(left: DataFrame, right: DataFrame, on, how: str, most: int = BROADCAST_BYTES) -> DataFrame:
    """left joined with right, a written table: right is broadcast if its values
    have at most ``most`` bytes, by a sum over all of them, else both are
    shuffled."""
    size = right.agg(F.sum(sum((width(F.col(f"`{f.name}`"), f.dataType) for f in right.schema), F.lit(0)).cast("bigint"))).first()[0] or 0
    return left.join(F.broadcast(right) if size <= most else right.hint("merge"), on, how)


ODD = np.uint64(0x9E3779B97F4A7C15)


FIRST, SECOND = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
S27, S30, S31 = np.uint64(27), np.uint64(30), np.uint64(31)


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer, which spreads every bit."""
    y = x >> S30
    y ^= x
    y *= FIRST
    z = y >> S27
    y ^= z
    y *= SECOND
    np.right_shift(y, S31, out=z)
    y ^= z
    return y


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes that are spread already, in order. No linear function
    of them, so no arrangement of words cancels out, as one in a polynomial can."""
    c = a * ODD
    c += b
    return mixed(c)


#: Places of a word whose hashes are looked up; the rest are reckoned.
PLACES = 64


def spread(at: np.ndarray, salt: int) -> np.ndarray:
    """A number for each byte of a word at its place (place * 256 + byte)."""
    return mixed(mixed(at.astype(np.uint64) + np.uint64(salt)) * ODD + at.astype(np.uint64))


TABLES = [spread(np.arange(PLACES * 256), salt << 40) for salt in (1, 2)]
IN_WORD = np.array([b not in b" \t\n\v\f\r" for b in range(256)], np.int8)
#: Bytes of text hashed at once; a longer text is cut between words.
PART = 1 << 22


def word_hashes(text: bytes, lower: bool = False, both: bool = False) -> np.ndarray:
    """64-bit hashes of the words of a text, parted by white space of ASCII; of
    their form with A-Z as a-z if ``lower``. With ``both`` two rows, of hashes
    that have nothing to do with each other.

    A hash is a sum of numbers that stand for each byte at its place in the word
    (tabulation), so that two words meet by chance alone, whatever their letters
    and length. All words of a text are hashed together.
    """
    text = text.translate(LOWER_AZ) if lower else text
    parts, at = [], 0
    while at < len(text) or not parts:
        end = at + PART
        while end < len(text) and IN_WORD[text[end]]:
            end += 1
        parts.append(_hashes(np.frombuffer(text, np.uint8, min(end, len(text)) - at, at) if text else np.zeros(0, np.uint8), both))
        at = end
    out = parts[0] if len(parts) == 1 else np.concatenate(parts, 1)
    return out if both else out[0]


def _hashes(a: np.ndarray, both: bool) -> np.ndarray:
    inside = np.zeros(len(a) + 2, np.int8)
    np.take(IN_WORD, a, out=inside[1:-1])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    if not len(edge):
        return np.zeros((1 + both, 0), np.uint64)
    size = edge[1::2] - edge[::2]
    first = np.cumsum(size) - size
    letters = a[inside[1:-1].view(bool)]
    at = np.arange(len(letters), dtype=np.int64 if size.max() >= 1 << 22 else np.int32)
    at -= np.repeat(first.astype(at.dtype), size)
    at <<= 8
    at |= letters
    far = np.flatnonzero(at >= PLACES * 256) if size.max() > PLACES else []
    out = []
    for k in range(1 + both):
        values = np.take(TABLES[k], at, mode="clip")
        if len(far):
            values[far] = spread(at[far], (k + 1) << 40)
        out.append(mixed(np.add.reduceat(values, first) + size.astype(np.uint64)))
    return np.stack(out)


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches cut to few rows each, so that what is made of one stays small."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def per_row(df: DataFrame, schema: str, rows: Callable[[pa.RecordBatch], Iterable], arrow: pa.Schema) -> DataFrame:
    """Each Arrow batch of df mapped to columns of ``arrow``, without a shuffle.

    ``rows`` gets a batch and returns one list or array per column.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c for c, f in zip(rows(b), arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


