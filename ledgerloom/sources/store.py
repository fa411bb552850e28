"""A table kept as batches of replaced keys: append-only files, a log of committed batches, merge on read, compaction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.files import listed, mark, remove


class Batches:
    """Rows by key(s). A batch names keys and gives all their rows; keys without rows are gone from then on.

    A batch is there once its mark is in the log; one that is written again before that replaces its own files, one that is
    committed already changes nothing, so writers may be run again after any loss. Reads see committed batches only. A compacted
    batch holds all rows; the files of batches before it are no longer read and may be dropped by ``vacuum``."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str):
        self.spark, self.path, self.key, self.schema = spark, path, key, schema
        self.key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.createDataFrame([], schema).select(key).schema)

    def batches(self) -> tuple[int, list[int]]:
        """The last compacted batch (0: none), and the committed batches after it."""
        names = listed(self.spark, f"{self.path}/log")
        base = max([int(n.split("-")[0]) for n in names if n.endswith("-all")], default=0)
        return base, sorted(n for x in names if x.endswith("-part") and (n := int(x.split("-")[0])) > base)

    def commit(self, batch: int, rows: DataFrame, keys: DataFrame) -> bool:
        """Replace the rows of keys by rows, whose keys are among them; False if the batch is there already."""
        base, parts = self.batches()
        if batch <= base or batch in parts:
            return False
        self._write("rows", batch, rows, self.schema)
        self._write("keys", batch, keys.select(self.key).distinct(), self.key_schema)
        mark(self.spark, f"{self.path}/log/{batch:09d}-part")
        return True

    def _write(self, kind: str, batch: int, df: DataFrame, schema: str) -> None:
        names = self.spark.createDataFrame([], schema).columns
        df.select(*[F.col(f"`{c}`") for c in names]).write.mode("overwrite").parquet(f"{self.path}/{kind}/{batch:09d}")

    def _of(self, kind: str, batches: list[int], schema: str) -> DataFrame:
        """The batches' rows with their number; batch folders hold nothing but committed files."""
        if not batches:
            return self.spark.createDataFrame([], schema).withColumn("_batch", F.lit(0))
        paths = [f"{self.path}/{kind}/{b:09d}" for b in batches]
        at = F.regexp_extract(F.col("_metadata.file_path"), f"/{kind}/([0-9]{{9}})/", 1).cast("int")
        return self.spark.read.schema(schema).parquet(*paths).withColumn("_batch", at)

    def read(self, as_of: int | None = None) -> DataFrame:
        """The rows after the last batch, or after batch ``as_of`` (one that is not before the last compacted one)."""
        base, parts = self.batches()
        if as_of is not None:
            if as_of < base:
                raise ValueError(f"batch {as_of} was compacted into {base}")
            parts = [b for b in parts if b <= as_of]
        known = ([("all", base)] if base else []) + [("rows", b) for b in parts]
        if not known:
            return self._of("rows", [], self.schema).drop("_batch")
        rows = reduce(DataFrame.unionByName, [self._of(kind, [b], self.schema).withColumn("_batch", F.lit(b)) for kind, b in known]).filter(F.col(self.key).isNotNull())
        if len(known) > 1:  # what no later batch has named; their keys are few beside the rows of the first
            last = self._of("keys", [b for _, b in known[1:]], self.key_schema).groupBy(F.col(self.key).alias("_key")).agg(F.max("_batch").alias("_last"))
            rows = rows.join(last, (F.col(self.key) == F.col("_key")) & (F.col("_batch") < F.col("_last")), "left_anti")
        return rows.drop("_batch")

    def history(self) -> DataFrame:
        """Every committed row since the last compaction with the number of its batch."""
        return self._of("rows", self.batches()[1], self.schema).withColumnRenamed("_batch", "batch")

    def compact(self) -> None:
        """Write the rows of all batches as one; reads go on from either side at any time."""
        base, parts = self.batches()
        if parts:
            self._write("all", parts[-1], self.read(), self.schema)
            mark(self.spark, f"{self.path}/log/{parts[-1]:09d}-all")

    def vacuum(self) -> None:
        """Delete the files of batches that a compacted one holds; no reader of an older state may be left."""
        base, _ = self.batches()
        for kind in ("rows", "keys", "all"):
            for name in listed(self.spark, f"{self.path}/{kind}"):
                if int(name) < base or (int(name) == base and kind != "all"):
                    remove(self.spark, f"{self.path}/{kind}/{name}")
