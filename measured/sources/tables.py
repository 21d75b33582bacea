"""Tables: those of a folder, and typed files that are written whole or not
at all and read only if their columns are the declared ones."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAMES = "region nation customer supplier part orders lineitem events".split()


class Tables:
    """Tables of a folder of Parquet files, as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        path = f"{self.folder}/{name}.parquet"
        fs, p = _files(self.spark, path)
        status = fs.getFileStatus(p)
        stamp = (status.getModificationTime(), status.getLen())
        #: Columns are read once from the files, by a job, and again if these change.
        if _schemas.get(path, (None, None))[0] != stamp:
            _schemas[path] = stamp, self.spark.read.parquet(path).schema
        return self.spark.read.schema(_schemas[path][1]).parquet(path)


_schemas: dict[str, tuple[tuple[int, int], T.StructType]] = {}


@dataclass(frozen=True)
class Parent:
    """A table made of members that hold the rows of one value of a column
    each, and rows of its own."""

    own: DataFrame
    members: dict[object, DataFrame]

    def only(self) -> DataFrame:
        """The parent's own rows."""
        return self.own

    def all(self) -> DataFrame:
        """Its rows and its members'. A member is a filtered read, so a filter
        on the column leaves out the members that can't match."""
        return reduce(DataFrame.unionByName, self.members.values(), self.own)


def parent(df: DataFrame, column: str, values: list) -> Parent:
    """A table's rows as members by the values of a column; rows of other
    values, and of none, are the parent's own."""
    c = F.col(f"`{column}`")
    return Parent(df.where(c.isNull() | ~c.isin(*values)), {v: df.where(c == F.lit(v)) for v in values})


def sampled(df: DataFrame, key: str, percent: float, seed: int = 0) -> DataFrame:
    """About so many percent of the rows, chosen by a hash of a key: the same
    ones at every read, whatever the partitions, unlike TABLESAMPLE."""
    at = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(f"`{key}`").cast("string"))), 1, 8), 16, 10).cast("bigint")
    return df.where(at % 10_000 < int(percent * 100))


KINDS = {"Text": T.StringType(), "Int": T.LongType(), "Float": T.DoubleType(), "Bool": T.BooleanType()}


def declared(**columns: str) -> T.StructType:
    """A file's columns by kind: Text, Int, Float or Bool; all may be null."""
    return T.StructType([T.StructField(n, KINDS[k], True) for n, k in columns.items()])


def _files(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_typed(df: DataFrame, schema: T.StructType, path: str) -> None:
    """Writes df with exactly these columns; a value that does not fit its
    type stops the job (ANSI casts), and a part-written folder is never seen
    under the path: it is renamed when complete."""
    if df.columns != schema.names:
        raise ValueError(f"columns {df.columns} are not {schema.names}")
    beside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    df.select(*[F.col(f.name).cast(f.dataType) for f in schema]).write.option("compression", "snappy").parquet(beside)
    fs, old = _files(df.sparkSession, path)
    aside = _files(df.sparkSession, f"{beside}.old")[1]
    had = fs.exists(old)
    #: What was there is put aside and deleted last, so no failure loses both.
    if had and not fs.rename(old, aside):
        raise OSError(f"can't put {path} aside")
    if not fs.rename(_files(df.sparkSession, beside)[1], old):
        if had:
            fs.rename(aside, old)
        raise OSError(f"can't rename to {path}")
    if had:
        fs.delete(aside, True)


def read_typed(spark: SparkSession, schema: T.StructType, path: str) -> DataFrame:
    """Reads a file or folder whose columns are the declared ones in name,
    order and type, and refuses any other."""
    df = spark.read.parquet(path)
    if [(f.name, f.dataType) for f in df.schema] != [(f.name, f.dataType) for f in schema]:
        raise ValueError(f"{path}: columns {df.dtypes} are not {[(f.name, f.dataType.simpleString()) for f in schema]}")
    return df


def _escaped(c: F.Column) -> F.Column:
    for a, b in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def export_tsv(df: DataFrame, keys: list[str], path: str) -> None:
    """Tab-separated text in order of the keys and then all columns; null is
    empty, so an empty text is refused; tab, line ends and backslash escaped."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if texts and df.where(" or ".join(f"`{t}` = ''" for t in texts)).limit(1).count():
        raise ValueError("an empty text can't be told from null")
    order = keys + [c for c in df.columns if c not in keys]
    df = df.orderBy(*[F.col(c).asc_nulls_first() for c in order])
    line = F.concat_ws("\t", *[F.coalesce(_escaped(F.col(c).cast("string")), F.lit("")) for c in df.columns])
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def import_tsv(spark: SparkSession, schema: T.StructType, path: str) -> DataFrame:
    """The inverse of export_tsv()."""
    parts = F.split(F.col("value"), "\t", -1)

    def plain(c: F.Column) -> F.Column:
        """Between two escaped backslashes every other escape is itself."""

        def other(x: F.Column) -> F.Column:
            for a, b in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r")):
                x = F.replace(x, F.lit(a), F.lit(b))
            return x

        return F.array_join(F.transform(F.split(c, r"\\\\", -1), other), "\\")

    cell = lambda i: F.when(parts[i] != "", plain(parts[i]))
    return spark.read.text(path).select(*[cell(i).cast(f.dataType).alias(f.name) for i, f in enumerate(schema)])
