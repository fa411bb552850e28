"""Hashes, scopes, dependency closure, invalidation, incremental recompute, history and review states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ledgerloom.functions.values import canonical
from ledgerloom.operators import rules
from ledgerloom.plans import ledger as v
from ledgerloom.registry import query


def scope_hash(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """(key, n, hash): a hash of each key's rows, in any order. 60-bit hashes of rows are added as decimals, which no number
    of rows overflows, so no group is gathered or sorted."""
    h = F.conv(F.substring(F.sha2(canonical(*columns), 256), 1, 15), 16, 10).cast("decimal(20,0)")
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.sum(h).cast("decimal(38,0)").cast("string").alias("hash"))


SCOPE = """scope AS (SELECT counterparty, count(*) AS n, CAST(sum(CAST(CAST('0x' || substr(sha256(length(id) || ':' || id || '|' || coalesce(length(CAST(amount AS VARCHAR)) || ':' || amount, '-')), 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS hash
  FROM {0} GROUP BY counterparty)"""


@query("f15_f16_scope_hash", v.with_views("invoice", SCOPE.format("v_invoice")) + "SELECT * FROM scope")
def q_scope(spark, d):
    return scope_hash(v.invoices(spark, d), "counterparty", "id", "amount")


def snapshot_hash(scopes: DataFrame, key: str) -> DataFrame:
    """(groups, rows, hash): one hash of all scopes' hashes, in any order; equal for equal snapshots only."""
    h = F.conv(F.substring(F.sha2(canonical(key, "n", "hash"), 256), 1, 15), 16, 10).cast("decimal(20,0)")
    return scopes.agg(F.count("*").alias("groups"), F.sum("n").alias("rows"), F.sha2(F.sum(h).cast("decimal(38,0)").cast("string"), 256).alias("hash"))


@query("f16_snapshot_hash", v.with_views("invoice", SCOPE.format("v_invoice")) + """SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS rows,
  sha256(CAST(sum(CAST(CAST('0x' || substr(sha256(length(counterparty) || ':' || counterparty || '|' || length(CAST(n AS VARCHAR)) || ':' || n || '|' || length(hash) || ':' || hash), 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR)) AS hash FROM scope""")
def q_snapshot(spark, d):
    return snapshot_hash(scope_hash(v.invoices(spark, d), "counterparty", "id", "amount"), "counterparty")


CHANGED = """new_invoice AS (SELECT id, counterparty, CASE WHEN orderkey % 97 = 0 THEN amount + 1 ELSE amount END AS amount, issued FROM v_invoice WHERE orderkey % 101 <> 0
  UNION ALL SELECT id || 'n', counterparty, amount, issued FROM v_invoice WHERE orderkey % 103 = 0)"""


def changed_invoices(spark, d) -> DataFrame:
    """A later state: some amounts changed, some invoices removed, some added."""
    i, k = v.invoices(spark, d), F.col("orderkey")
    kept = i.filter(k % 101 != 0).withColumn("amount", F.when(k % 97 == 0, F.col("amount") + 1).otherwise(F.col("amount")))
    return kept.unionByName(i.filter(k % 103 == 0).withColumn("id", F.concat("id", F.lit("n")))).select("id", "counterparty", "amount", "issued")


def diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change) of rows that were added, removed or updated."""
    a, b = old.select(key, F.col(value).alias("_a"), F.lit(1).alias("_old")), new.select(key, F.col(value).alias("_b"), F.lit(1).alias("_new"))
    x = a.join(b, key, "full_outer")
    change = F.when(F.col("_old").isNull(), "add").when(F.col("_new").isNull(), "remove").when(~F.col("_a").eqNullSafe(F.col("_b")), "update")
    return x.select(key, change.alias("change")).filter("change IS NOT NULL")


@query("f22_f23_f31_a15_diff", v.with_views("invoice", CHANGED) + """
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'add' WHEN b.id IS NULL THEN 'remove' ELSE 'update' END AS change FROM v_invoice a FULL OUTER JOIN new_invoice b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.amount <> b.amount""")
def q_diff(spark, d):
    return diff(v.invoices(spark, d), changed_invoices(spark, d), "id", "amount")


def affected(old: DataFrame, new: DataFrame) -> DataFrame:
    """Groups whose scope hash differs, appeared or vanished."""
    a = scope_hash(old, "counterparty", "id", "amount").select("counterparty", F.struct("n", "hash").alias("h"))
    b = scope_hash(new, "counterparty", "id", "amount").select("counterparty", F.struct("n", "hash").alias("h"))
    return diff(a, b, "counterparty", "h")


@query("f19_invalidation", v.with_views("invoice", CHANGED, SCOPE.format("v_invoice"), SCOPE.format("new_invoice").replace("scope AS", "scope2 AS")) + """
SELECT coalesce(a.counterparty, b.counterparty) AS counterparty, CASE WHEN a.counterparty IS NULL THEN 'add' WHEN b.counterparty IS NULL THEN 'remove' ELSE 'update' END AS change
FROM scope a FULL OUTER JOIN scope2 b ON a.counterparty = b.counterparty WHERE a.n IS DISTINCT FROM b.n OR a.hash IS DISTINCT FROM b.hash""")
def q_affected(spark, d):
    return affected(v.invoices(spark, d), changed_invoices(spark, d))


def summarize(i: DataFrame) -> DataFrame:
    """A group computation: open amount and oldest invoice of each counterparty."""
    return i.groupBy("counterparty").agg(F.sum("amount").cast("long").alias("open"), F.min("issued").alias("oldest"), F.count("*").alias("n"))


def recompute(previous: DataFrame, old: DataFrame, new: DataFrame, compute=summarize) -> DataFrame:
    """The computation over the new state: affected groups anew, the others as they were."""
    touched = affected(old, new).select("counterparty")
    fresh = compute(new.join(touched, "counterparty", "left_semi"))
    return previous.join(touched, "counterparty", "left_anti").unionByName(fresh)


@query("f20_f21_incremental", v.with_views("invoice", CHANGED) + "SELECT counterparty, CAST(sum(amount) AS BIGINT) AS open, min(issued) AS oldest, count(*) AS n FROM new_invoice GROUP BY counterparty")
def q_recompute(spark, d):
    """Incremental result; the SQL recomputes everything."""
    old = v.invoices(spark, d).select("id", "counterparty", "amount", "issued")
    return recompute(summarize(old), old, changed_invoices(spark, d))


@query("f24_f25_review_status", """
SELECT o_orderkey AS k, CASE WHEN o_orderkey % 17 = 0 THEN 'SUPERSEDED' WHEN good THEN 'APPROVED' WHEN n > 0 THEN 'REVIEW_REQUIRED' WHEN o_orderkey % 2 = 0 THEN 'VERIFIED' ELSE 'DRAFT' END AS status
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, bool_or(l_partkey % 7 = l_orderkey % 7) AS good FROM lineitem WHERE l_linenumber = 1 GROUP BY l_orderkey) ON l_orderkey = o_orderkey""")
def review(spark, d):
    """Approvals are rows with the hash they approved; an approval of an older hash asks for a review."""
    a = v.read(spark, d, "lineitem").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_partkey") % 7 == F.col("l_orderkey") % 7).alias("same"))
    x = v.read(spark, d, "orders").join(a.groupBy("o_orderkey").agg(F.bool_or("same").alias("good")), "o_orderkey", "left")
    k = F.col("o_orderkey")
    status = F.when(k % 17 == 0, "SUPERSEDED").when(F.col("good"), "APPROVED").when(F.col("good").isNotNull(), "REVIEW_REQUIRED").when(k % 2 == 0, "VERIFIED").otherwise("DRAFT")
    return x.select(k.alias("k"), status.alias("status"))


@query("f26_history", """
SELECT document, version, status FROM (SELECT o_custkey AS document, o_orderkey AS version, o_orderstatus AS status, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders) WHERE before IS DISTINCT FROM status""")
def history(spark, d):
    """Append-only history: a row wherever the state differs from the one before."""
    w = W.partitionBy("o_custkey").orderBy("o_orderkey")
    x = v.read(spark, d, "orders").withColumn("before", F.lag("o_orderstatus").over(w)).filter(~F.col("before").eqNullSafe(F.col("o_orderstatus")))
    return x.select(F.col("o_custkey").alias("document"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("status"))


@query("f30_f32_k02_version_heads", """
SELECT o_orderkey AS k, max(o_orderkey) OVER w AS head, o_orderkey < max(o_orderkey) OVER w AS late FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_totalprice, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def version_heads(spark, d):
    """The head after each arrival: a version that comes late never replaces a newer one."""
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_totalprice", "o_orderkey").rowsBetween(W.unboundedPreceding, W.currentRow)
    head = F.max("o_orderkey").over(w)
    return v.read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), head.alias("head"), (F.col("o_orderkey") < head).alias("late"))


@query("f10_f11_f12_f13_decisions", rules.DUE_VIEWS[:-1] + """, d AS (SELECT id, counterparty, amount, line_kind, bool_or(unresolved_rollover) AS open_rule, min(missing) AS missing FROM interests GROUP BY ALL)
SELECT status, count(*) AS n, CAST(sum(CASE WHEN status <> 'SKIPPED' THEN amount ELSE 0 END) AS BIGINT) AS counted FROM (
  SELECT *, CASE WHEN line_kind <> 'sale' OR amount <= 0 THEN 'SKIPPED' WHEN missing IS NOT NULL THEN 'INSUFFICIENT' WHEN open_rule THEN 'AMBIGUOUS' ELSE 'DECIDED' END AS status FROM d) GROUP BY status""")
def decisions(spark, d):
    """A status for each line, by priority, and the total that counts."""
    x = rules._dues(spark, d).groupBy("id", "counterparty", "amount", "line_kind").agg(F.bool_or("unresolved_rollover").alias("open_rule"), F.min("missing").alias("missing"))
    status = F.when((F.col("line_kind") != "sale") | (F.col("amount") <= 0), "SKIPPED").when(F.col("missing").isNotNull(), "INSUFFICIENT").when(F.col("open_rule"), "AMBIGUOUS").otherwise("DECIDED")
    x = x.withColumn("status", status)
    return x.groupBy("status").agg(F.count("*").alias("n"), F.sum(F.when(F.col("status") != "SKIPPED", F.col("amount")).otherwise(0)).cast("long").alias("counted"))


@query("f29_findings", rules.DUE_VIEWS + """SELECT id, variant, array_to_string(list_filter([CASE WHEN missing IS NOT NULL THEN 'needs ' || missing END, CASE WHEN unresolved_rollover THEN 'rollover open' END, CASE WHEN delay_days > 0 THEN 'late ' || delay_days END], lambda x: x IS NOT NULL), '; ') AS findings FROM interests""")
def findings(spark, d):
    late = F.when(F.col("delay_days") > 0, F.concat(F.lit("late "), "delay_days"))
    rows = F.array_compact(F.array(F.concat(F.lit("needs "), "missing"), F.when(F.col("unresolved_rollover"), F.lit("rollover open")), late))
    return rules._dues(spark, d).select("id", "variant", F.array_join(rows, "; ").alias("findings"))
