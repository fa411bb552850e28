"""Small helpers that the operators share."""

from __future__ import annotations

import ctypes
import tempfile
import time
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as regular-expression class content: space, tab to carriage return.
SPACE = r"\x20\x09-\x0D"

#: A table of at most so many rows may be broadcast; a larger one is joined by shuffling.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (on one machine, as in tests) one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="ledgerloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small intermediate table by a reliable checkpoint."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage of a larger table: Parquet in the shared folder, read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ledgerloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables in the shared folder that one operator needs on its way; what its result doesn't read goes by clear()."""

    def __init__(self, spark: SparkSession):
        self.spark, self.kept = spark, []

    def stored(self, df: DataFrame) -> DataFrame:
        path = f"{shared_dir(self.spark)}/ledgerloom/{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.kept.append((out, path))
        return out

    cut = staticmethod(cut)

    def clear(self, keep=()) -> None:
        """Delete all tables but those in ``keep``."""
        for df, path in self.kept:
            if not any(df is x for x in keep):
                at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self.kept = [(df, path) for df, path in self.kept if any(df is x for x in keep)]


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, with a broadcast hint if (and only if) it has at most ``rows`` rows. df should be cheap to count."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def whole_row(docs: DataFrame) -> Column:
    """All columns as one struct, whatever their names."""
    return F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns])


def row_digest(docs: DataFrame) -> Column:
    """A 128-bit digest of a whole row, equal for equal rows only; maps, which can't be hashed, count as JSON."""
    columns = [F.to_json(F.struct(F.col(f"`{f.name}`").alias("v"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema]
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *columns).alias("b"))


_GIVEN = [0.0]


def give_back(every: float = 0.0) -> None:
    """Free memory of a Python process goes back to the system, at most once in ``every`` seconds. A process outlives its tasks:
    what malloc keeps for it is missing to the stages that follow."""
    if time.monotonic() - _GIVEN[0] < every:
        return
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)
    _GIVEN[0] = time.monotonic()


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    """Number of runs of characters other than white space; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")
