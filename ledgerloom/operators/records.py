"""Records over time: a store of batches with history, and reservations that are admitted while a budget lasts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.plans import ledger as v
from ledgerloom.registry import query
from ledgerloom.sources.files import scratch
from ledgerloom.sources.store import Batches

PARTS = 3


def stored_orders(spark, d, writes: int = PARTS) -> Batches:
    """Customers' latest orders, written by batches; each replaces the records of the customers that it brings. The second one
    is delivered twice, and the first two are compacted."""
    store = Batches(spark, scratch(spark), "k", "k long, id long, status string, price double")
    o = v.read(spark, d, "orders")
    for n in range(1, writes + 1):
        x = o.filter(F.col("o_orderkey") % PARTS == n - 1).groupBy(F.col("o_custkey").alias("k")).agg(F.max(F.struct("o_orderkey", "o_orderstatus", "o_totalprice")).alias("r"))
        x = x.select("k", F.col("r.o_orderkey").alias("id"), F.col("r.o_orderstatus").alias("status"), F.col("r.o_totalprice").alias("price"))
        for _ in range(1 + (n == 2)):
            store.commit(n, x, x)
        if n == 2:
            store.compact()
    return store


def _store_sql(n: int) -> str:
    return f"""SELECT o_custkey AS k, arg_max(o_orderkey, o_orderkey % {PARTS} * 100000000000 + o_orderkey) AS id, arg_max(o_orderstatus, o_orderkey % {PARTS} * 100000000000 + o_orderkey) AS status,
  arg_max(o_totalprice, o_orderkey % {PARTS} * 100000000000 + o_orderkey) AS price FROM orders WHERE o_orderkey % {PARTS} < {n} GROUP BY o_custkey"""


@query("a19_f26_record_store", _store_sql(PARTS))
def q_store(spark, d):
    return stored_orders(spark, d).read()


@query("a20_f30_record_store_as_of", _store_sql(2))
def q_store_as_of(spark, d):
    """The state before the last write, read after it."""
    return stored_orders(spark, d).read(as_of=2)


def admitted(requests: DataFrame, budgets: DataFrame) -> DataFrame:
    """(key, at, id, amount, admitted, used) of requests(key, at, id, amount), one after the other by (at, id): a request is
    admitted if what was admitted before leaves room for it in its key's budgets(key, room). Keys without a budget admit none.

    Each depends on all before it, so a key's requests pass in order through one task, which holds one number a key: rows
    are sorted with spilling and streamed, never gathered."""

    def run(batches):
        key, used = None, 0
        for b in batches:
            good, after = [], []
            for k, amount, room in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                if k != key:
                    key, used = k, 0
                fits = room is not None and amount is not None and used + amount <= room
                used += amount if fits else 0
                good.append(fits), after.append(used)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(good, pa.bool_()), pa.array(after, pa.int64())], names=["key", "at", "id", "amount", "admitted", "used"])

    x = requests.select("key", "at", "id", F.col("amount").cast("long").alias("amount")).filter("key IS NOT NULL").join(budgets.select("key", F.col("room").cast("long").alias("room")), "key", "left")
    x = x.repartition("key").sortWithinPartitions("key", "at", "id")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema.fields[:4])
    return x.select("key", "at", "id", "amount", "room").mapInArrow(run, f"{schema}, admitted boolean, used long")


@query("g22_budget_admission", """
WITH RECURSIVE r AS MATERIALIZED (SELECT o_custkey AS key, o_orderkey AS id, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS amount, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n, o_custkey % 7 * 20000000 AS room FROM orders),
f AS (SELECT key, id, amount, n, room, amount <= room AS admitted, CASE WHEN amount <= room THEN amount ELSE 0 END AS used FROM r WHERE n = 1
  UNION ALL SELECT r.key, r.id, r.amount, r.n, r.room, f.used + r.amount <= r.room, f.used + CASE WHEN f.used + r.amount <= r.room THEN r.amount ELSE 0 END FROM f JOIN r ON r.key = f.key AND r.n = f.n + 1)
SELECT key, id, amount, admitted, CAST(used AS BIGINT) AS used FROM f""")
def q_admission(spark, d):
    """Orders as requests against a budget of each customer; every seventh has none to spend."""
    o = v.read(spark, d, "orders")
    x = o.select(F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("id"), v.cents("o_totalprice").alias("amount"))
    return admitted(x, o.select(F.col("o_custkey").alias("key"), (F.col("o_custkey") % 7 * 20_000_000).alias("room")).distinct()).drop("at")
