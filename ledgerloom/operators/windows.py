"""Windows, sorts, limits and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ledgerloom.plans import ledger as v
from ledgerloom.registry import query


@query("h01_h06_keyset_page", "SELECT o_orderkey AS k, o_orderdate AS day FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 51")
def keyset_page(spark, d):
    """A page after a cursor, and one row more to tell whether there is a next page."""
    return v.read(spark, d, "orders").filter("o_orderkey > 100").orderBy("o_orderkey").limit(51).select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("day"))


@query("h02_h08_sequence", "SELECT o_orderkey AS k, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) + o_custkey % 10 AS INTEGER) AS seq FROM orders")
def sequence(spark, d):
    """Numbers that go on from each group's previous maximum."""
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return v.read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.row_number().over(w) + F.col("o_custkey") % 10).cast("int").alias("seq"))


@query("h04_c09_carry_forward", """
SELECT event_id AS k, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS header FROM events""")
def carry_forward(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    return v.read(spark, d, "events").select(F.col("event_id").alias("k"), F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(w).alias("header"))


@query("h09_set_operations", """
WITH f AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), p AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P')
SELECT 'both' AS part, k FROM (SELECT k FROM f INTERSECT SELECT k FROM p) UNION ALL SELECT 'only_f', k FROM (SELECT k FROM f EXCEPT SELECT k FROM p)""")
def set_operations(spark, d):
    o = v.read(spark, d, "orders")
    f, p = (o.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k")).distinct() for s in "FP")
    return f.intersect(p).select(F.lit("both").alias("part"), "k").unionByName(f.subtract(p).select(F.lit("only_f").alias("part"), "k"))


@query("h10_ordered_distinct", """
SELECT conv_id AS k, string_agg(role, '>' ORDER BY first) AS roles FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY conv_id, role) GROUP BY conv_id""")
def ordered_distinct(spark, d):
    firsts = v.read(spark, d, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("first"))
    return firsts.groupBy(F.col("conv_id").alias("k")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "role"))), lambda x: x["role"]), ">").alias("roles"))


@query("h12_sliding_limit", """
SELECT event_id AS k, n > 3 AS refused FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS n FROM events)""")
def sliding_limit(spark, d):
    """More than three events of a user within six hours."""
    w = W.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-6 * 3600 * 1_000_000, 0)
    return v.read(spark, d, "events").select(F.col("event_id").alias("k"), (F.count("*").over(w) > 3).alias("refused"))
