"""Uploads of documents: which are new versions, which version is the head after each, and what a version changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ledgerloom.functions.values import canonical
from ledgerloom.plans import ledger as v
from ledgerloom.registry import query


def fingerprint(*columns: str):
    """A digest of a parse's output; equal outputs only, nulls told apart."""
    return F.sha2(canonical(*columns), 256)


def numbered(uploads: DataFrame) -> DataFrame:
    """uploads(document, arrival, content, ...) with version (null: the content is that of the upload before it). Only the latest
    upload is compared, so a return to older content is a version of its own."""
    here = W.partitionBy("document").orderBy("arrival")
    x = uploads.withColumn("new", ~F.col("content").eqNullSafe(F.lag("content").over(here)) | (F.row_number().over(here) == 1))
    return x.withColumn("version", F.when(F.col("new"), F.sum(F.col("new").cast("int")).over(here))).drop("new")


def applied(versions: DataFrame) -> DataFrame:
    """versions(document, arrival, effective, parsed, print) with state and head (arrival of the head after it).

    A version that could not be parsed is failed, one that is effective before the head is late; neither becomes the head. One that
    reads like the head is unchanged: it becomes the head, and nothing has to be computed again."""
    before = W.partitionBy("document").orderBy("arrival").rowsBetween(W.unboundedPreceding, -1)
    me = F.when(F.col("parsed"), F.struct("effective", "arrival", "print"))
    x = versions.withColumn("me", me).withColumn("was", F.max("me").over(before))
    ahead = F.col("was").isNull() | (F.col("me") >= F.col("was"))
    state = F.when(~F.col("parsed"), "failed").when(~ahead, "late").when(F.col("print") == F.col("was.print"), "unchanged").otherwise("applied")
    head = F.when(F.col("parsed") & ahead, F.col("arrival")).otherwise(F.col("was.arrival"))
    return x.select(*versions.columns, state.alias("state"), head.alias("head"))


def version_diff(owned: DataFrame, new: DataFrame, whole: DataFrame) -> DataFrame:
    """(document, record, change) between the records owned(document, record, print) and those of new versions: ADD, UPDATE, REMOVE. Of a
    document whose new version isn't complete (not in whole(document)) records that it doesn't hold are carried over: CARRY."""
    a = owned.select("document", "record", F.col("print").alias("a"))
    b = new.select("document", "record", F.col("print").alias("b"))
    x = a.join(b, ["document", "record"], "full_outer").join(new.select("document").distinct().withColumn("seen", F.lit(True)), "document", "left").filter("seen")
    x = x.join(whole.select("document").distinct().withColumn("complete", F.lit(True)), "document", "left")
    change = F.when(F.col("a").isNull(), "ADD").when(F.col("b").isNull() & F.col("complete"), "REMOVE").when(F.col("b").isNull(), "CARRY").when(F.col("a") != F.col("b"), "UPDATE")
    return x.select("document", "record", change.alias("change")).filter("change IS NOT NULL")


@query("f32_upload_versions", """
SELECT document, arrival, CASE WHEN new THEN sum(CAST(new AS INTEGER)) OVER (PARTITION BY document ORDER BY arrival) END AS version FROM (
  SELECT o_custkey AS document, o_orderkey AS arrival, row_number() OVER w = 1 OR o_orderstatus IS DISTINCT FROM lag(o_orderstatus) OVER w AS new FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))""")
def q_versions(spark, d):
    """Orders of a customer as uploads of one document, their status as content."""
    x = v.read(spark, d, "orders").select(F.col("o_custkey").alias("document"), F.col("o_orderkey").alias("arrival"), F.col("o_orderstatus").alias("content"))
    return numbered(x).select("document", "arrival", "version")


@query("f30_f33_version_states", """
WITH x AS (SELECT o_custkey AS document, o_orderkey AS arrival, o_orderdate AS effective, o_orderkey % 11 <> 0 AS parsed, o_orderstatus || o_orderkey % 2 AS print FROM orders),
w AS (SELECT *, max(CASE WHEN parsed THEN {'e': effective, 'a': arrival, 'p': print} END) OVER (PARTITION BY document ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM x)
SELECT document, arrival, CASE WHEN NOT parsed THEN 'failed' WHEN NOT ahead THEN 'late' WHEN print = was.p THEN 'unchanged' ELSE 'applied' END AS state, CASE WHEN parsed AND ahead THEN arrival ELSE was.a END AS head
FROM (SELECT *, was IS NULL OR effective > was.e OR (effective = was.e AND arrival >= was.a) AS ahead FROM w)""")
def q_states(spark, d):
    k = F.col("o_orderkey")
    x = v.read(spark, d, "orders").select(F.col("o_custkey").alias("document"), k.alias("arrival"), F.col("o_orderdate").alias("effective"), (k % 11 != 0).alias("parsed"), "o_orderstatus", (k % 2).alias("odd"))
    return applied(x.withColumn("print", fingerprint("o_orderstatus", "odd")).drop("o_orderstatus", "odd")).select("document", "arrival", "state", "head")


@query("f31_version_diff", """
WITH x AS (SELECT l_suppkey AS document, l_partkey AS record, l_orderkey % 2 AS side, sum(CAST(l_quantity AS BIGINT)) AS print FROM lineitem GROUP BY ALL), a AS (SELECT * FROM x WHERE side = 0), b AS (SELECT * FROM x WHERE side = 1)
SELECT coalesce(a.document, b.document) AS document, coalesce(a.record, b.record) AS record, CASE WHEN a.record IS NULL THEN 'ADD' WHEN b.record IS NOT NULL THEN 'UPDATE' WHEN a.document % 3 <> 0 THEN 'REMOVE' ELSE 'CARRY' END AS change
FROM a FULL OUTER JOIN b ON a.document = b.document AND a.record = b.record WHERE coalesce(a.document, b.document) IN (SELECT document FROM b) AND a.print IS DISTINCT FROM b.print""")
def q_diff(spark, d):
    """Records of a supplier in even orders against those in odd ones; every third supplier's new version is incomplete."""
    x = v.read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("document"), F.col("l_partkey").alias("record"), (F.col("l_orderkey") % 2).alias("side")).agg(F.sum(F.col("l_quantity").cast("long")).alias("print"))
    new = x.filter("side = 1")
    return version_diff(x.filter("side = 0"), new, new.filter("document % 3 <> 0"))
