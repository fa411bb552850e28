"""Change feeds as streams: decisions kept up to date batch by batch, version heads, duplicate deliveries, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import maintained
from ledgerloom.plans import ledger as v
from ledgerloom.plans.graph import Room
from ledgerloom.registry import query
from ledgerloom.sources.files import scratch


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream."""
    path = f"{sf_dir}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")  # one file or a folder of files


def drain(df: DataFrame, batch) -> None:
    """Run a stream over all that is there, batch by batch."""
    q = df.writeStream.foreachBatch(batch).option("checkpointLocation", scratch(df.sparkSession)).trigger(availableNow=True).start()
    q.awaitTermination()


def version_heads(changes: DataFrame, spark: SparkSession) -> DataFrame:
    """(document, head): the greatest version that has arrived. Each batch is reduced to one row a document and appended;
    a late version lies below the head and never replaces it."""
    path = scratch(spark)
    drain(changes, lambda df, _: df.groupBy("document").agg(F.max("version").alias("head")).write.mode("append").parquet(path))
    return spark.read.parquet(path).groupBy("document").agg(F.max("head").alias("head"))


def windowed_counts(events: DataFrame, spark: SparkSession, late="1 hour", width="6 hours") -> DataFrame:
    """(start, event_type, n) of all event-time windows; rows later than the watermark allows are left out, repeated deliveries
    of an event within it are counted once. Each batch appends the windows it changed, with its number; the last one counts,
    so windows that are still open at the end are there too, and a batch that is run again changes nothing."""
    path = scratch(spark)
    x = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])
    x = x.groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
    put = lambda df, batch: df.withColumn("batch", F.lit(batch).cast("long")).write.mode("append").parquet(path)
    q = x.writeStream.foreachBatch(put).option("checkpointLocation", scratch(spark)).trigger(availableNow=True).outputMode("update").start()
    q.awaitTermination()
    found = spark.read.schema("start timestamp, event_type string, n long, batch long").parquet(path)
    return found.groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n"))


def incremental(changes: DataFrame, spark: SparkSession, compute) -> DataFrame:
    """Partial results of each batch, appended; compute maps a batch to (key, sums), which add up over batches."""
    path = scratch(spark)
    drain(changes, lambda df, _: compute(df).write.mode("append").parquet(path))
    return spark.read.parquet(path)


@query("k01_change_stream", "SELECT o_custkey AS k, count(*) AS n, CAST(sum(CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT)) AS BIGINT) AS amount FROM orders GROUP BY o_custkey")
def q_changes(spark, d):
    one = lambda df: df.groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"), F.sum(v.cents("o_totalprice")).alias("amount"))
    return incremental(stream(spark, d, "orders"), spark, one).groupBy("k").agg(F.sum("n").alias("n"), F.sum("amount").cast("long").alias("amount"))


def maintain(changes: DataFrame, kept: maintained.Maintained, snapshot_at) -> None:
    """Follow a stream of changes(entity, id): each micro-batch brings the stores to snapshot_at(batch), recomputing what it
    touched. Stores and their log outlive the stream; a micro-batch that is delivered again changes nothing."""
    drain(changes, lambda df, batch: kept.apply(batch + 2, df, snapshot_at(batch)) and None)


@query("k01_maintained_stream", v.with_views(*maintained.VIEWS, maintained.snapshot_sql(maintained.STEPS)) + "SELECT * FROM dec")
def q_maintained(spark, d):
    """The change feed as a stream of one file a batch; the SQL computes the last state in full."""
    path, kept, none, room = scratch(spark), maintained.Maintained(spark), maintained.feed(spark, d, 1).limit(0), Room(spark)
    known = maintained.ledger(spark, d, room)
    for step in range(1, maintained.STEPS + 1):
        maintained.feed(spark, d, step).coalesce(1).write.mode("append").parquet(path)
    kept.apply(1, none, maintained.snapshot(spark, d, 0, known))
    changes = spark.readStream.schema(none.schema).option("maxFilesPerTrigger", 1).parquet(path)
    maintain(changes, kept, lambda batch: maintained.snapshot(spark, d, batch + 1, known))
    room.close()
    return kept.decisions.read().drop("inputs")


@query("k02_stream_heads", "SELECT o_custkey AS document, max(o_orderkey) AS head FROM orders GROUP BY o_custkey")
def q_heads(spark, d):
    return version_heads(stream(spark, d, "orders").select(F.col("o_custkey").alias("document"), F.col("o_orderkey").alias("version")), spark)


@query("k04_stream_windows", """
SELECT strftime(make_timestamp(CAST(floor(epoch(CAST(ts AS TIMESTAMP)) / 21600) AS BIGINT) * 21600000000), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM (SELECT event_id, any_value(ts) AS ts, any_value(event_type) AS event_type FROM events GROUP BY event_id) GROUP BY ALL""")
def q_windows(spark, d):
    x = windowed_counts(stream(spark, d, "events"), spark)
    return x.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")
