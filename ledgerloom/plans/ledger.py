"""Ledger views over the star-schema tables, as DataFrames and as the same SQL text.

Dates are moved by a fixed number of days so that they meet the effective dates of the built-in rules. Money is in
integer minor units. Some dates and trade types are missing by fixed residues of keys, so that abstention is exercised."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

SHIFT = 9600
AS_OF = "2025-06-30"
#: About as many rows of an input table are dealt to one task.
TASK_ROWS = 200_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(rows: int, each: int = TASK_ROWS) -> int:
    """Tasks for so many rows of an input, each with about as many whatever the input's size."""
    return -(-rows // each)


def dealt(df: DataFrame, n: int | None, *keys: str) -> DataFrame:
    """df dealt by keys to n tasks; as it is where the session has cores for all of them at once, or n isn't given.

    A shuffle that Spark plans has a fixed number of tasks, or coalesces them to as many as there are cores: their share grows
    with the input. Groups and windows by keys, and joins by exactly these keys with a side dealt likewise, stay in place."""
    return df if n is None or n <= df.sparkSession.sparkContext.defaultParallelism else df.repartition(n, *keys)


def day(col: str):
    return F.date_add(F.col(col).cast("date"), SHIFT)


def cents(col: str):
    """Exact cents of a double amount, by decimals."""
    return (F.col(col).cast("decimal(18,2)") * 100).cast("long")


def lines(spark, d) -> DataFrame:
    """Settlement lines; ids number the rows of an order in a total order, since natural keys repeat."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]
    n = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*order))
    line, o = read(spark, d, "lineitem"), read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    parts, few = tasks(line.count()), tasks(o.count())
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    o = dealt(dealt(o, few, "o_custkey").join(dealt(c, few, "o_custkey"), "o_custkey"), parts, "l_orderkey")
    x = dealt(line, parts, "l_orderkey").withColumn("n", n).join(o, "l_orderkey")
    sign = F.when(F.col("l_returnflag") == "R", -1).otherwise(1)
    kind = F.col("l_suppkey") % 4
    return x.select(
        F.concat(F.lit("L"), F.col("l_orderkey"), F.lit("-"), F.col("n")).alias("id"),
        F.col("l_orderkey").alias("orderkey"),
        F.col("c_name").alias("counterparty"),
        (cents("l_extendedprice") * sign).alias("amount"),
        F.when(F.col("l_returnflag") == "R", "return").otherwise("sale").alias("line_kind"),
        F.when(F.col("l_partkey") % 50 != 0, day("l_shipdate")).alias("received"),
        F.when(F.col("l_partkey") % 50 != 1, F.last_day(day("l_shipdate"))).alias("closed"),
        F.concat(F.lit("ORD"), F.col("l_orderkey")).alias("reference"),
        F.when(kind == 0, "direct").when(kind == 1, "consignment").when(kind == 2, "subcontract").alias("trade_type"),
        F.when(F.col("l_quantity") % 3 == 0, True).when(F.col("l_quantity") % 3 == 1, False).alias("rollover"),
        F.when(F.col("l_partkey") % 3 != 0, F.date_add(day("l_shipdate"), (F.col("l_partkey") % 150).cast("int"))).alias("paid"),
    )


LINES = f"""v_line AS (
  SELECT 'L' || l_orderkey || '-' || n AS id, l_orderkey AS orderkey, c_name AS counterparty,
    CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT) * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS amount,
    CASE WHEN l_returnflag = 'R' THEN 'return' ELSE 'sale' END AS line_kind,
    CASE WHEN l_partkey % 50 <> 0 THEN CAST(l_shipdate AS DATE) + {SHIFT} END AS received,
    CASE WHEN l_partkey % 50 <> 1 THEN last_day(CAST(l_shipdate AS DATE) + {SHIFT}) END AS closed,
    'ORD' || l_orderkey AS reference,
    CASE l_suppkey % 4 WHEN 0 THEN 'direct' WHEN 1 THEN 'consignment' WHEN 2 THEN 'subcontract' END AS trade_type,
    CASE l_quantity % 3 WHEN 0 THEN true WHEN 1 THEN false END AS rollover,
    CASE WHEN l_partkey % 3 <> 0 THEN CAST(l_shipdate AS DATE) + {SHIFT} + CAST(l_partkey % 150 AS INTEGER) END AS paid
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax) AS n FROM lineitem) l
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


def invoices(spark, d) -> DataFrame:
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    key, o = F.col("o_orderkey"), read(spark, d, "orders")
    parts = tasks(o.count())
    return dealt(o, parts, "o_custkey").join(dealt(c, parts, "o_custkey"), "o_custkey").select(
        F.concat(F.lit("I"), key).alias("id"), key.alias("orderkey"), F.col("c_name").alias("counterparty"),
        cents("o_totalprice").alias("amount"), day("o_orderdate").alias("issued"), F.concat(F.lit("ORD"), key).alias("reference"),
    )


INVOICES = f"""v_invoice AS (
  SELECT 'I' || o_orderkey AS id, o_orderkey AS orderkey, c_name AS counterparty,
    CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS amount, CAST(o_orderdate AS DATE) + {SHIFT} AS issued, 'ORD' || o_orderkey AS reference
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def payments(spark, d) -> DataFrame:
    """Bank transactions: full, part and missing references; a few reversals of a deposit a week later."""
    i = invoices(spark, d).join(read(spark, d, "orders").select(F.col("o_orderkey").alias("orderkey"), "o_orderstatus"), "orderkey")
    k = F.col("orderkey")
    base = i.select(
        F.concat(F.lit("P"), k).alias("id"), "orderkey", F.when(k % 7 == 0, "").otherwise(F.col("counterparty")).alias("counterparty"),
        F.when(F.col("o_orderstatus") == "P", F.expr("amount div 2")).otherwise(F.col("amount")).alias("amount"),
        F.date_add("issued", (k % 120).cast("int")).alias("booked"),
        F.when(k % 3 == 0, F.concat(F.lit("payment for "), F.col("reference"))).otherwise("").alias("memo"),
        F.when(k % 3 == 1, F.col("reference")).otherwise("").alias("reference"),
    )
    back = base.filter("orderkey % 40 = 5").select(
        F.concat(F.lit("R"), F.col("orderkey")).alias("id"), "orderkey", "counterparty", (-F.col("amount")).alias("amount"),
        F.date_add("booked", 7).alias("booked"), F.lit("").alias("memo"), F.lit("").alias("reference"),
    )
    return base.unionByName(back)


PAYMENTS = f"""v_payment AS (
  WITH base AS (SELECT 'P' || orderkey AS id, orderkey, CASE WHEN orderkey % 7 = 0 THEN '' ELSE counterparty END AS counterparty,
      CASE WHEN o_orderstatus = 'P' THEN amount // 2 ELSE amount END AS amount, issued + CAST(orderkey % 120 AS INTEGER) AS booked,
      CASE WHEN orderkey % 3 = 0 THEN 'payment for ' || reference ELSE '' END AS memo,
      CASE WHEN orderkey % 3 = 1 THEN reference ELSE '' END AS reference
    FROM v_invoice JOIN orders ON orderkey = o_orderkey)
  SELECT * FROM base UNION ALL
  SELECT 'R' || orderkey, orderkey, counterparty, -amount, booked + 7, '', '' FROM base WHERE orderkey % 40 = 5)"""


def agreements(spark, d) -> DataFrame:
    """Two agreements a customer, with open and closed ends and unconfirmed terms."""
    c = read(spark, d, "customer").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    key, k = F.col("c_custkey"), F.col("k")
    return c.select(
        F.concat(F.lit("A"), key, F.lit("-"), k).alias("id"), F.col("c_name").alias("counterparty"),
        F.when(k == 0, F.lit("2021-01-01").cast("date")).when(key % 5 != 0, F.lit("2024-01-01").cast("date")).alias("valid_from"),
        F.when(k == 0, F.lit("2023-12-31").cast("date")).alias("valid_to"),
        F.when(key % 3 == 0, (30 + 15 * k).cast("int")).when(key % 3 == 1, F.lit(45)).alias("term_days"),
        F.when(key % 4 == 0, True).when(key % 4 == 1, False).alias("agreed_rollover"),
    )


AGREEMENTS = """v_agreement AS (
  SELECT 'A' || c_custkey || '-' || k AS id, c_name AS counterparty,
    CASE WHEN k = 0 THEN DATE '2021-01-01' WHEN c_custkey % 5 <> 0 THEN DATE '2024-01-01' END AS valid_from,
    CASE WHEN k = 0 THEN DATE '2023-12-31' END AS valid_to,
    CASE c_custkey % 3 WHEN 0 THEN 30 + 15 * k WHEN 1 THEN 45 END AS term_days,
    CASE c_custkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS agreed_rollover
  FROM customer, (VALUES (0), (1)) t(k))"""


def with_views(*names: str) -> str:
    """A WITH clause of the views' SQL, in order of need."""
    known = {"line": LINES, "invoice": INVOICES, "payment": PAYMENTS, "agreement": AGREEMENTS}
    return "WITH " + ",\n".join(known.get(n, n) for n in names) + "\n"
