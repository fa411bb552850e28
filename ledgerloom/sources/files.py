"""File sources and sinks: JSON lines, CSV reports, event logs in XML."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ledgerloom.functions.values import escape_formula
from ledgerloom.plans import ledger as v
from ledgerloom.registry import query


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share; on one machine a local one where no shared folder is set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="ledgerloom-")
    return f"{root}/ledgerloom/{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str):
    """A path and its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    at, fs = _at(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def sizes(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path, bytes) of all files below a folder, or of one file; names that Spark's readers pass over are left out."""
    at, fs = _at(spark, path)
    found, out = fs.listFiles(at, True), []
    while found.hasNext():
        x = found.next()
        if not x.getPath().getName().startswith(("_", ".")):
            out.append((x.getPath().toString(), x.getLen()))
    return sorted(out)


def remove(spark: SparkSession, path: str) -> None:
    at, fs = _at(spark, path)
    fs.delete(at, True)


def mark(spark: SparkSession, path: str) -> None:
    """An empty file; one that is there already stays."""
    at, fs = _at(spark, path)
    fs.createNewFile(at)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path, compression="gzip")


def read_jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_report(df: DataFrame, path: str) -> None:
    """CSV with formula-safe text cells."""
    safe = [escape_formula(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    df.select(*safe).write.csv(path, header=True, escape='"', quote='"')


#: About as many events go into a file of a log.
FILE_EVENTS = 200_000
#: An event log's layout: attributes are elements named by their type, with a key and a value.
_PAIR = "array<struct<_key: string, _value: string>>"
_LOG = f"string {_PAIR}, event array<struct<string: {_PAIR}, date: {_PAIR}>>"


def _events(x: DataFrame) -> DataFrame:
    get = lambda pairs, key: F.get(F.filter(pairs, lambda p: p["_key"] == key), F.lit(0))["_value"]
    x = x.select(get(F.col("string"), "concept:name").alias("trace"), F.posexplode("event").alias("no", "e"))
    return x.select("trace", "no", get(F.col("e.string"), "concept:name").alias("activity"), get(F.col("e.date"), "time:timestamp").alias("at"), get(F.col("e.string"), "Cumulative net worth (EUR)").alias("amount"))


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """(trace, no, activity, at, amount) of an XES log, a row a trace at a time; values stay text."""
    return _events(spark.read.format("xml").option("rowTag", "trace").schema(_LOG).load(path))


def stream_event_log(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """The same as a stream of the files of a folder, ``files`` a batch."""
    return _events(spark.readStream.format("xml").option("rowTag", "trace").schema(_LOG).option("maxFilesPerTrigger", files).load(path))


def write_event_log(events: DataFrame, path: str) -> None:
    """events(trace, no, activity, at, amount) as XES, one trace a line; values are escaped."""
    safe = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(c).cast("string"), "&", "&amp;"), "<", "&lt;"), ">", "&gt;"), '"', "&quot;")
    pair = lambda kind, key, value: F.concat(F.lit(f'<{kind} key="{key}" value="'), value, F.lit('"/>'))
    event = F.concat(F.lit("<event>"), pair("string", "concept:name", safe("activity")), F.coalesce(pair("string", "Cumulative net worth (EUR)", safe("amount")), F.lit("")), pair("date", "time:timestamp", safe("at")), F.lit("</event>"))
    x = events.groupBy("trace").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", event.alias("e")))), lambda s: s["e"]), "").alias("events"))
    x = x.select(F.concat(F.lit("<trace>"), pair("string", "concept:name", safe("trace")), "events", F.lit("</trace>")).alias("value"))

    def whole(batches):  # each file is a document
        yield pa.RecordBatch.from_pydict({"value": ["<log>"]})
        yield from batches
        yield pa.RecordBatch.from_pydict({"value": ["</log>"]})

    x.mapInArrow(whole, "value string").write.mode("append").text(path)


EVENT_LOG = """SELECT CAST(user_id AS VARCHAR) AS trace, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS no, event_type || ' <' || event_id || '> & "' || props || '"' AS activity, strftime(ts, '%Y-%m-%d %H:%M') AS at,
  CASE WHEN event_id % 5 <> 0 THEN CAST(event_id % 1000 AS VARCHAR) END AS amount FROM events"""


def _user_events(spark: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    name = F.concat("event_type", F.lit(" <"), "event_id", F.lit('> & "'), "props", F.lit('"'))
    amount = F.when(F.col("event_id") % 5 != 0, (F.col("event_id") % 1000).cast("string"))
    return v.read(spark, d, "events").select(F.col("user_id").alias("trace"), n.alias("no"), name.alias("activity"), F.date_format("ts", "yyyy-MM-dd HH:mm").alias("at"), amount.alias("amount"))


@query("a10_event_log", EVENT_LOG)
def q_event_log(spark, d):
    """Events of each user as a trace, written as XES and read back."""
    path = scratch(spark)
    write_event_log(_user_events(spark, d), path)
    return read_event_log(spark, path)


@query("k05_event_log_stream", EVENT_LOG)
def q_event_log_stream(spark, d):
    """The same read as a stream of files; what each batch brings is appended."""
    path, out = scratch(spark), scratch(spark)
    n = max(3, v.read(spark, d, "events").count() // FILE_EVENTS)  # files, read in about three batches
    write_event_log(_user_events(spark, d).repartition(n, "trace"), path)
    q = stream_event_log(spark, path, -(-n // 3)).writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)


@query("a11_jsonl_round_trip", "SELECT event_id, event_type, CAST(value AS VARCHAR) AS value FROM events")
def q_jsonl(spark, d):
    x = v.read(spark, d, "events").select("event_id", "event_type", F.col("value").cast("string").alias("value"))
    path = scratch(spark)
    write_jsonl(x, path)
    return read_jsonl(spark, path, x.schema)


@query("a14_a17_report_round_trip", """
SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN '''=' || c_name ELSE c_name END AS name FROM customer""")
def q_report(spark, d):
    k = F.col("c_custkey")
    x = v.read(spark, d, "customer").select(k.alias("k"), F.when(k % 2 == 0, F.concat(F.lit("="), "c_name")).otherwise(F.col("c_name")).alias("name"))
    path = scratch(spark)
    write_report(x, path)
    return spark.read.csv(path, header=True, schema="k long, name string", escape='"')
