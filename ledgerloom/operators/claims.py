"""Receivables from documents: user confirmations, repeated lines, unknown directions, decision parts, approval guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.plans import ledger as v
from ledgerloom.plans.graph import Room
from ledgerloom.registry import query

SEPARATE, SAME = "separate_sale", "same_sale"


def confirmed(links: DataFrame) -> DataFrame:
    """(doc, relation, target, n_links, conflicting): what the links (doc, relation, target) of each document say together."""
    said = F.struct("relation", "target")
    x = links.groupBy("doc").agg(F.min(said).alias("one"), F.max(said).alias("other"), F.count("*").alias("n_links"))
    return x.select("doc", "one.relation", "one.target", "n_links", (F.col("one") != F.col("other")).alias("conflicting"))


def resolve_duplicates(sales: DataFrame, duplicates: DataFrame, links: DataFrame, parts: int | None = None) -> DataFrame:
    """(id, state, target) of sale lines (id): own, attached to an earlier line, or pending. duplicates(id): the lines that
    repeat one of another document; a confirmation attaches only to a sale line that is no duplicate itself. Only what was
    confirmed is looked up by its target, so lines without one meet in no task. parts: tasks for the lines."""
    deal = lambda df, key: v.dealt(df, parts, key)
    sales, duplicates, c = deal(sales.select("id"), "id"), deal(duplicates.select("id"), "id"), confirmed(deal(links, "doc")).withColumnRenamed("doc", "id")
    target = deal(sales.join(duplicates, "id", "left_anti").select(F.col("id").alias("target")), "target")
    good = deal(c.filter(F.col("relation") == SAME).select("id", "target"), "target").join(target, "target", "left_semi").select("id", F.lit(True).alias("good"))
    x = sales.join(duplicates.withColumn("dup", F.lit(True)), "id", "left").join(c, "id", "left").join(deal(good, "id"), "id", "left")
    attached = (F.col("relation") == SAME) & F.coalesce("good", F.lit(False))
    state = F.when(F.col("dup").isNull(), "own").when(F.col("n_links").isNull() | F.col("conflicting"), "pending").when(F.col("relation") == SEPARATE, "own").when(attached, "attached").otherwise("pending")
    return x.select("id", state.alias("state"), F.when(state == "attached", F.col("target")).alias("target"))


def resolve_invoices(invoices: DataFrame, own_sales: DataFrame, links: DataFrame, parts: int | None = None) -> DataFrame:
    """(id, state, why) of invoices(id, counterparty, reference, direction) against own_sales(id, counterparty, reference).

    In this order: an unknown direction or counterparty is pending, whatever was confirmed; confirmations that contradict each
    other are pending, separate ones make it its own, others attach it to that line or leave it pending; then the reference:
    one line of it attaches, several are pending; without one it is pending if its counterparty has sale lines, else its own.
    Only what was confirmed is looked up by its target. parts: tasks for the tables."""
    deal = lambda df, *keys: v.dealt(df, parts, *keys)
    c = confirmed(deal(links, "doc")).withColumnRenamed("doc", "id")
    target = deal(own_sales.select(F.col("id").alias("target"), F.col("counterparty").alias("target_of")), "target")
    hits = deal(own_sales.filter("reference <> ''").select("counterparty", "reference"), "counterparty", "reference").groupBy("counterparty", "reference").agg(F.count("*").alias("hits"))
    some = deal(own_sales.select("counterparty").distinct(), "counterparty").distinct().withColumn("some", F.lit(True))
    of = deal(c.filter("relation <> '%s'" % SEPARATE).select("id", "target"), "target").join(target, "target").select("id", "target_of")
    x = deal(invoices, "id").join(c, "id", "left").join(deal(of, "id"), "id", "left")
    x = deal(deal(x, "counterparty", "reference").join(hits, ["counterparty", "reference"], "left"), "counterparty").join(some, "counterparty", "left")
    said, fits = F.col("n_links").isNotNull(), F.coalesce(F.col("target_of") == F.col("counterparty"), F.lit(False))
    n = F.coalesce("hits", F.lit(0))
    out = [
        ((F.col("direction") == "unknown") | (F.col("counterparty") == ""), "pending", "direction"), (said & F.col("conflicting"), "pending", "confirmations"),
        (said & (F.col("relation") == SEPARATE), "own", "confirmed"), (said & fits, "attached", "confirmed"), (said, "pending", "target"),
        (n == 1, "attached", "reference"), (n > 1, "pending", "reference"), (F.coalesce("some", F.lit(False)), "pending", "candidates"),
    ]
    state, why = F.lit("own"), F.lit("no_line")
    for cond, a, b in reversed(out):
        state, why = F.when(cond, a).otherwise(state), F.when(cond, b).otherwise(why)
    return x.select("id", state.alias("state"), why.alias("why"))


def _sales(spark, d) -> DataFrame:
    return v.lines(spark, d).filter("line_kind = 'sale'").select("id", "orderkey", "counterparty", "reference", "amount")


def _line_links(x: DataFrame) -> DataFrame:
    """Confirmations of sale lines x: separate, the same as the order's first line, or both."""
    k, first = F.col("orderkey"), F.concat(F.lit("L"), F.col("orderkey"), F.lit("-1"))
    same = x.filter(k % 5 < 3).select(F.col("id").alias("doc"), F.lit(SAME).alias("relation"), first.alias("target"))
    return same.unionByName(x.filter(k % 5 == 2).select(F.col("id").alias("doc"), F.lit(SEPARATE).alias("relation"), F.lit("").alias("target"))).unionByName(
        x.filter(k % 5 == 3).select(F.col("id").alias("doc"), F.lit(SEPARATE).alias("relation"), F.lit("").alias("target"))
    )


CLAIMS = """sales AS (SELECT id, orderkey, counterparty, reference, amount FROM v_line WHERE line_kind = 'sale'),
dup AS (SELECT id FROM sales WHERE amount % 3 = 0),
state AS (SELECT s.id, s.counterparty, s.reference, CASE WHEN s.id NOT IN (SELECT id FROM dup) THEN 'own' WHEN orderkey % 5 IN (2, 4) THEN 'pending' WHEN orderkey % 5 = 3 THEN 'own'
  WHEN 'L' || orderkey || '-1' IN (SELECT id FROM sales WHERE id NOT IN (SELECT id FROM dup)) THEN 'attached' ELSE 'pending' END AS state, orderkey FROM sales s)"""


@query("d08_duplicate_resolution", v.with_views("line", CLAIMS) + "SELECT id, state, CASE WHEN state = 'attached' THEN 'L' || orderkey || '-1' END AS target FROM state")
def q_duplicate_resolution(spark, d):
    x, parts = Room(spark).cut(_sales(spark, d)), v.tasks(v.read(spark, d, "lineitem").count())
    return resolve_duplicates(x, x.filter("amount % 3 = 0").select("id"), _line_links(x), parts)


@query("d06_d09_d11_invoice_links", v.with_views("line", "invoice", CLAIMS) + """, own AS (SELECT * FROM state WHERE state = 'own'),
h AS (SELECT counterparty, reference, count(*) AS n FROM own GROUP BY ALL),
x AS (SELECT i.id, i.orderkey AS k, coalesce(n, 0) AS n, i.counterparty IN (SELECT counterparty FROM own) AS has_own, CASE WHEN i.orderkey % 11 = 0 THEN 'L' || (i.orderkey) || '-1' IN (SELECT id FROM own) ELSE false END AS fits
  FROM v_invoice i LEFT JOIN h ON h.counterparty = i.counterparty AND h.reference = i.reference)
SELECT id, CASE WHEN k % 13 = 0 THEN 'pending' WHEN k % 11 = 1 THEN 'pending' WHEN k % 11 = 2 THEN 'own' WHEN k % 11 = 0 AND fits THEN 'attached' WHEN k % 11 = 0 THEN 'pending' WHEN n = 1 THEN 'attached' WHEN n > 1 OR has_own THEN 'pending' ELSE 'own' END AS state,
  CASE WHEN k % 13 = 0 THEN 'direction' WHEN k % 11 = 1 THEN 'confirmations' WHEN k % 11 = 2 THEN 'confirmed' WHEN k % 11 = 0 AND fits THEN 'confirmed' WHEN k % 11 = 0 THEN 'target' WHEN n > 0 THEN 'reference' WHEN has_own THEN 'candidates' ELSE 'no_line' END AS why FROM x""")
def q_invoice_links(spark, d):
    room, k, parts = Room(spark), F.col("orderkey"), v.tasks(v.read(spark, d, "lineitem").count())
    x = room.cut(_sales(spark, d))
    own = room.cut(resolve_duplicates(x, x.filter("amount % 3 = 0").select("id"), _line_links(x), parts).filter("state = 'own'").select("id").join(v.dealt(x, parts, "id"), "id"))
    i = room.cut(v.invoices(spark, d)).withColumn("direction", F.when(k % 13 == 0, "unknown").otherwise("sales"))
    first = F.concat(F.lit("L"), k, F.lit("-1"))
    link = lambda cond, relation, target: i.filter(cond).select(F.col("id").alias("doc"), F.lit(relation).alias("relation"), target.alias("target"))
    links = link(k % 11 < 2, SAME, first).unionByName(link(k % 11 == 1, SEPARATE, F.lit(""))).unionByName(link(k % 11 == 2, SEPARATE, F.lit("")))
    return resolve_invoices(i, own, links, parts)


def decision_parts(receivables: DataFrame) -> DataFrame:
    """(id, counted, allocated, open, status, amount_conflict) of receivables(id, amount, state, why, allocated, fee, documents):
    one that isn't counted has nothing allocated or open; a linked document of another amount, or one override, is a conflict."""
    counted = F.col("state") == "own"
    conflict = F.exists("documents", lambda x: x != F.col("amount"))
    left = F.col("amount") - F.col("allocated") - F.col("fee")
    status = (
        F.when(~counted & (F.col("why") == "direction"), "INSUFFICIENT_EVIDENCE").when(~counted, "AMBIGUOUS").when(conflict, "CONFLICT")
        .when(left == 0, "MATCHED").when((F.col("allocated") != 0) | (F.col("fee") != 0), "PARTIAL").otherwise("UNMATCHED")
    )
    none = F.lit(0).cast("long")
    return receivables.select("id", counted.alias("counted"), F.when(counted, F.col("allocated")).otherwise(none).alias("allocated"), F.when(counted, left).otherwise(none).alias("open"), status.alias("status"), conflict.alias("amount_conflict"))


@query("f11_f12_decision_parts", v.with_views("invoice") + """, x AS (SELECT id, orderkey AS k, amount, CASE WHEN orderkey % 7 < 2 THEN 'pending' ELSE 'own' END AS state, CASE orderkey % 3 WHEN 0 THEN amount WHEN 1 THEN amount // 2 ELSE 0 END AS a, CASE WHEN orderkey % 6 = 1 THEN 500 ELSE 0 END AS fee FROM v_invoice)
SELECT id, state = 'own' AS counted, CASE WHEN state = 'own' THEN a ELSE 0 END AS allocated, CASE WHEN state = 'own' THEN amount - a - fee ELSE 0 END AS open, k % 5 = 0 AS amount_conflict,
  CASE WHEN k % 7 = 0 THEN 'INSUFFICIENT_EVIDENCE' WHEN k % 7 = 1 THEN 'AMBIGUOUS' WHEN k % 5 = 0 THEN 'CONFLICT' WHEN amount - a - fee = 0 THEN 'MATCHED' WHEN a <> 0 OR fee <> 0 THEN 'PARTIAL' ELSE 'UNMATCHED' END AS status FROM x""")
def q_decision_parts(spark, d):
    k, amount = F.col("orderkey"), F.col("amount")
    documents = F.when(k % 5 == 0, F.array(amount, amount + 1)).when(k % 5 == 1, F.array(amount)).otherwise(F.array().cast("array<long>"))
    allocated = F.when(k % 3 == 0, amount).when(k % 3 == 1, F.expr("amount div 2")).otherwise(0).cast("long")
    return decision_parts(v.invoices(spark, d).select(
        "id", "amount", F.when(k % 7 < 2, "pending").otherwise("own").alias("state"), F.when(k % 7 == 0, "direction").otherwise("evidence").alias("why"),
        allocated.alias("allocated"), F.when(k % 6 == 1, 500).otherwise(0).cast("long").alias("fee"), documents.alias("documents"),
    ))


def guard_approvals(requests: DataFrame, decisions: DataFrame, blockers: DataFrame) -> DataFrame:
    """(decision, accepted, why): a request (decision, expected_hash) is accepted if the decision exists, has that hash still,
    and nothing blocks it; blockers(decision, document)."""
    b = blockers.groupBy("decision").agg(F.count_distinct("document").alias("blocking"))
    x = requests.join(decisions, "decision", "left").join(b, "decision", "left")
    why = F.when(F.col("hash").isNull(), "unknown").when(F.col("hash") != F.col("expected_hash"), "stale").when(F.col("blocking") > 0, "blocked")
    return x.select("decision", why.isNull().alias("accepted"), why.alias("why"))


def approval_blockers(facts: DataFrame, heads: DataFrame) -> DataFrame:
    """(decision, document): documents behind a decision's facts (decision, document) whose newest version, heads(document,
    needs_ack, acked), waits for an acknowledgement."""
    return facts.join(heads.filter("needs_ack AND NOT acked"), "document", "left_semi").select("decision", "document").distinct()


@query("d18_f25_approval_guards", """
WITH b AS (SELECT l_orderkey AS decision, count(DISTINCT l_suppkey) AS n FROM lineitem WHERE l_suppkey % 10 = 3 AND l_suppkey % 4 <> 1 GROUP BY ALL),
r AS (SELECT o_orderkey AS k FROM orders UNION ALL SELECT -o_orderkey - 1 FROM orders WHERE o_orderkey % 50 = 0)
SELECT k AS decision, k >= 0 AND k % 9 <> 0 AND n IS NULL AS accepted, CASE WHEN k < 0 THEN 'unknown' WHEN k % 9 = 0 THEN 'stale' WHEN n IS NOT NULL THEN 'blocked' END AS why FROM r LEFT JOIN b ON decision = k""")
def q_guards(spark, d):
    k = F.col("o_orderkey")
    orders = v.read(spark, d, "orders").select("o_orderkey", F.sha2(k.cast("string"), 256).alias("hash"))
    requests = orders.select(k.alias("decision"), F.when(k % 9 == 0, "old").otherwise(F.col("hash")).alias("expected_hash"))
    requests = requests.unionByName(orders.filter(k % 50 == 0).select((-k - 1).alias("decision"), F.col("hash").alias("expected_hash")))
    facts = v.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("decision"), F.col("l_suppkey").alias("document"))
    s = F.col("document")
    heads = v.read(spark, d, "supplier").select(F.col("s_suppkey").alias("document")).select("document", (s % 10 == 3).alias("needs_ack"), (s % 4 == 1).alias("acked"))
    return guard_approvals(requests, orders.select(k.alias("decision"), "hash"), approval_blockers(facts, heads))


def interest_fits(computed: Column, printed: Column, multiplier: Column) -> Column:
    """Null if either is missing; else whether the printed value, in units of the multiplier, is met within one unit."""
    return F.abs(computed - printed * multiplier) <= F.greatest(multiplier, F.lit(1))


def stated_rate_interest(principal: Column, percent: Column, days: Column, rounding: str) -> Column:
    """Interest of a year of 365 days at a rate that a text states, in whole units."""
    exact = principal.cast("decimal(20,0)") * percent.cast("decimal(7,4)") * days.cast("decimal(6,0)") / F.lit(36500).cast("decimal(6,0)")
    return (F.floor(exact) if rounding == "floor" else F.round(exact, 0)).cast("long")


@query("g08_g09_stated_rate", """
WITH x AS (SELECT o_orderkey AS k, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS p, 10 + o_orderkey % 11 AS pct, o_orderkey % 200 AS days, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 1000 END AS m FROM orders),
y AS (SELECT *, (CAST(p AS HUGEINT) * pct * days) // 36500 AS lo, (CAST(p AS HUGEINT) * pct * days * 2 + 36500) // 73000 AS up FROM x)
SELECT k, CAST(lo AS BIGINT) AS floor, CAST(up AS BIGINT) AS half_up, CASE WHEN k % 7 = 0 THEN NULL ELSE abs(lo - (lo // m + k % 3) * m) <= m END AS floor_ok FROM y""")
def q_stated(spark, d):
    k = F.col("o_orderkey")
    m = F.when(k % 2 == 0, 1).otherwise(1000)
    x = v.read(spark, d, "orders").select(k.alias("k"), v.cents("o_totalprice").alias("p"), (k % 11 + 10).alias("pct"), (k % 200).alias("days"), m.alias("m"))
    x = x.select("k", "m", *[stated_rate_interest(F.col("p"), F.col("pct"), F.col("days"), r).alias(r) for r in ("floor", "half_up")])
    printed = F.when(F.col("k") % 7 != 0, F.expr("floor div m") + F.col("k") % 3)
    return x.select("k", "floor", "half_up", interest_fits(F.col("floor"), printed, F.col("m")).alias("floor_ok"))
