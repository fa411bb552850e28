"""Aggregations, distributions and evaluation metrics. Percentiles are nearest-rank; checks are three-valued."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.rules import DUE_VIEWS, _dues
from ledgerloom.plans import ledger as v
from ledgerloom.registry import query


def distribution(df: DataFrame, value: str, *by: str) -> DataFrame:
    """n, min, nearest-rank p10 .. p90, max, mean (2 decimals, halves away from zero) and negatives of an integer column."""
    p = [F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})").alias(f"p{int(q * 100)}") for q in (0.1, 0.25, 0.5, 0.75, 0.9)]
    mean = F.round(F.sum(F.col(value).cast("decimal(28,4)")) / F.count(value), 2).cast("double").alias("mean")
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("min"), *p, F.max(value).alias("max"), mean, F.count_if(F.col(value) < 0).alias("negatives"))


def ratio(n, d):
    """n / d with four decimals, halves up; null for a zero denominator."""
    return F.round(n.cast("decimal(28,10)") / F.nullif(d, F.lit(0)).cast("decimal(18,0)"), 4).cast("double")


EVENTS = "ev AS (SELECT event_id, user_id AS item, event_type AS activity, CAST(CAST(value AS DECIMAL(18,2)) * 100 AS BIGINT) AS amount, ts, CAST(ts AS DATE) AS day FROM events)"


def events(spark, d) -> DataFrame:
    return v.read(spark, d, "events").select("event_id", F.col("user_id").alias("item"), F.col("event_type").alias("activity"), v.cents("value").alias("amount"), "ts", F.col("ts").cast("date").alias("day"))


@query("g01_g06_event_profile", "WITH " + EVENTS + " SELECT activity, count(*) AS n, CAST(sum(amount) AS BIGINT) AS amount, min(day) AS first, max(day) AS last, count(DISTINCT item) AS items FROM ev GROUP BY activity")
def profile(spark, d):
    return events(spark, d).groupBy("activity").agg(F.count("*").alias("n"), F.sum("amount").cast("long").alias("amount"), F.min("day").alias("first"), F.max("day").alias("last"), F.count_distinct("item").alias("items"))


@query("g02_overall_and_category", "WITH " + EVENTS + " SELECT CASE WHEN grouping(activity) = 1 THEN '(all)' ELSE activity END AS category, count(*) AS n, CAST(sum(amount) AS BIGINT) AS amount FROM ev GROUP BY GROUPING SETS ((), (activity))")
def overall(spark, d):
    x = events(spark, d).rollup("activity").agg(F.count("*").alias("n"), F.sum("amount").cast("long").alias("amount"), F.grouping("activity").alias("g"))
    return x.select(F.when(F.col("g") == 1, "(all)").otherwise(F.col("activity")).alias("category"), "n", "amount")


@query("g03_distribution", "WITH " + EVENTS + """ SELECT activity, count(amount) AS n, min(amount) AS min, quantile_disc(amount, 0.1) AS p10, quantile_disc(amount, 0.25) AS p25, quantile_disc(amount, 0.5) AS p50, quantile_disc(amount, 0.75) AS p75,
  quantile_disc(amount, 0.9) AS p90, max(amount) AS max, CAST(round(CAST(sum(amount) AS DECIMAL(28,4)) / count(amount), 2) AS DOUBLE) AS mean, count(*) FILTER (WHERE amount < 0) AS negatives FROM ev GROUP BY activity""")
def q_distribution(spark, d):
    return distribution(events(spark, d), "amount", "activity")


@query("g04_ratios", """
SELECT o_custkey AS k, count(*) FILTER (WHERE o_orderstatus = 'F') AS n, count(*) AS of, CAST(round(CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE) / count(*) + 1e-12, 4) AS DOUBLE) AS rate FROM orders GROUP BY o_custkey""")
def q_ratio(spark, d):
    x = v.read(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("n"), F.count("*").alias("of"))
    return x.withColumn("rate", ratio(F.col("n"), F.col("of")))


@query("g05_item_totals", "WITH " + EVENTS + """ SELECT item, CAST(sum(CASE WHEN activity = 'signup' THEN amount WHEN activity = 'error' THEN -amount ELSE 0 END) AS BIGINT) AS received,
  CAST(sum(CASE WHEN activity = 'purchase' THEN amount ELSE 0 END) AS BIGINT) AS invoiced, CAST(sum(CASE WHEN activity = 'signup' THEN amount WHEN activity IN ('error', 'purchase') THEN -amount ELSE 0 END) AS BIGINT) AS diff,
  datediff('day', min(day) FILTER (WHERE activity = 'signup'), min(day) FILTER (WHERE activity = 'purchase')) AS days FROM ev GROUP BY item""")
def item_totals(spark, d):
    """Received net of cancellations, invoiced, their difference, and days between the first of each."""
    amount = lambda plus, minus=(): F.sum(F.when(F.col("activity").isin(*plus), F.col("amount")).when(F.col("activity").isin(*(minus or ("-",))), -F.col("amount")).otherwise(0)).cast("long")
    first = lambda a: F.min(F.when(F.col("activity") == a, F.col("day")))
    return events(spark, d).groupBy("item").agg(amount(["signup"], ["error"]).alias("received"), amount(["purchase"]).alias("invoiced"), amount(["signup"], ["error", "purchase"]).alias("diff"), F.datediff(first("purchase"), first("signup")).cast("long").alias("days"))


CHECKS = DUE_VIEWS[:-1] + """, checked AS (SELECT id, variant, orderkey, trade_type, CASE WHEN orderkey % 5 <> 0 THEN coalesce(due = received + 60, false) END AS due_ok,
  CASE WHEN orderkey % 7 <> 0 THEN delay_days <= 30 END AS days_ok, CASE WHEN orderkey % 3 <> 0 THEN interest <= 100000 END AS interest_ok FROM interests WHERE variant IS NOT NULL)"""


def checks(spark, d) -> DataFrame:
    """Rows with checks that are true, false, or null where they can't be evaluated."""
    k = F.col("orderkey")
    x = _dues(spark, d).filter("variant IS NOT NULL")
    same = F.coalesce(F.col("due") == F.date_add("received", 60), F.lit(False))
    return x.select("id", "variant", "orderkey", "trade_type", F.when(k % 5 != 0, same).alias("due_ok"), F.when(k % 7 != 0, F.col("delay_days") <= 30).alias("days_ok"), F.when(k % 3 != 0, F.col("interest") <= 100000).alias("interest_ok"))


@query("g07_g08_g11_variant_metrics", CHECKS + """ SELECT variant, count(*) AS rows, count(due_ok) AS due_of, count(*) FILTER (WHERE due_ok) AS due_n, count(days_ok) AS days_of, count(*) FILTER (WHERE days_ok) AS days_n,
  count(interest_ok) AS interest_of, count(*) FILTER (WHERE interest_ok) AS interest_n, count(*) FILTER (WHERE due_ok AND days_ok AND interest_ok) AS all_n,
  count(*) FILTER (WHERE coalesce(due_ok, true) AND coalesce(days_ok, true) AND coalesce(interest_ok, true)) AS available_n, count(*) FILTER (WHERE due_ok IS NOT NULL AND days_ok IS NOT NULL AND interest_ok IS NOT NULL) AS full_of FROM checked GROUP BY variant""")
def variant_metrics(spark, d):
    x, names = checks(spark, d), ("due_ok", "days_ok", "interest_ok")
    every, some, full = F.lit(True), F.lit(True), F.lit(True)
    for c in names:
        every, some, full = every & F.col(c), some & F.coalesce(c, F.lit(True)), full & F.col(c).isNotNull()
    per = [a for c in names for a in (F.count(c).alias(c[:-3] + "_of"), F.count_if(F.col(c)).alias(c[:-3] + "_n"))]
    return x.groupBy("variant").agg(F.count("*").alias("rows"), *per, F.count_if(every).alias("all_n"), F.count_if(some).alias("available_n"), F.count_if(full).alias("full_of"))


@query("g12_any_variant", CHECKS + """, per AS (SELECT id, trade_type, bool_or(coalesce(due_ok, false)) AS any_ok, string_agg(DISTINCT variant, ',' ORDER BY variant) FILTER (WHERE due_ok) AS matched FROM checked GROUP BY id, trade_type)
SELECT trade_type, coalesce(matched, '') AS matched, count(*) AS n, count(*) FILTER (WHERE any_ok) AS any_n FROM per GROUP BY ALL""")
def any_variant(spark, d):
    """Two levels: whether any variant of a row matches, then counts by the set of variants that do."""
    hit = F.coalesce("due_ok", F.lit(False))
    per = checks(spark, d).groupBy("id", "trade_type").agg(F.bool_or(hit).alias("any_ok"), F.array_join(F.array_sort(F.collect_set(F.when(hit, F.col("variant")))), ",").alias("matched"))
    return per.groupBy("trade_type", "matched").agg(F.count("*").alias("n"), F.count_if(F.col("any_ok")).alias("any_n"))


@query("g13_f28_abstentions", DUE_VIEWS + "SELECT missing, trade_type, count(*) AS n, count(DISTINCT counterparty) AS counterparties FROM interests WHERE missing IS NOT NULL GROUP BY missing, trade_type")
def abstentions(spark, d):
    return _dues(spark, d).filter("missing IS NOT NULL").groupBy("missing", "trade_type").agg(F.count("*").alias("n"), F.count_distinct("counterparty").alias("counterparties"))


@query("g14_g15_totals_check", v.with_views("line", "invoice") + """
SELECT i.id, i.amount AS printed, CAST(coalesce(sum(l.amount), 0) AS BIGINT) AS summed, count(l.id) AS n, coalesce(sum(l.amount) = i.amount, false) AS equal FROM v_invoice i LEFT JOIN v_line l USING (orderkey) GROUP BY i.id, i.amount""")
def totals_check(spark, d):
    """Printed totals against sums of rows (also the total check of extracted tables)."""
    s = v.lines(spark, d).groupBy("orderkey").agg(F.sum("amount").alias("s"), F.count("*").alias("n"))
    x = v.invoices(spark, d).join(s, "orderkey", "left")
    return x.select("id", F.col("amount").alias("printed"), F.coalesce("s", F.lit(0)).cast("long").alias("summed"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.col("s") == F.col("amount"), F.lit(False)).alias("equal"))


@query("g18_clause_consistency", """
SELECT source, count(*) AS documents, bool_and(n_chars > 100) AS all_long, bool_or(lang = 'de') AS any_de, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM documents GROUP BY source""")
def consistency(spark, d):
    return v.read(spark, d, "documents").groupBy("source").agg(F.count("*").alias("documents"), F.bool_and(F.col("n_chars") > 100).alias("all_long"), F.bool_or(F.col("lang") == "de").alias("any_de"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))


@query("g20_g24_fact_summary", "SELECT l_returnflag AS kind, count(*) AS n, count(*) FILTER (WHERE l_discount = 0) AS masked, count(*) FILTER (WHERE l_tax > 0.05) AS low, count(DISTINCT l_suppkey) AS serials FROM lineitem GROUP BY l_returnflag")
def fact_summary(spark, d):
    return v.read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("kind")).agg(F.count("*").alias("n"), F.count_if(F.col("l_discount") == 0).alias("masked"), F.count_if(F.col("l_tax") > 0.05).alias("low"), F.count_distinct("l_suppkey").alias("serials"))


@query("g21_cellwise_agreement", """
WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS cell FROM orders WHERE o_orderkey % 10 <> 0), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 13 = 0 THEN 'X' ELSE o_orderstatus END AS cell FROM orders WHERE o_orderkey % 11 <> 0)
SELECT CASE WHEN a.k IS NULL THEN 'right only' WHEN b.k IS NULL THEN 'left only' WHEN a.cell = b.cell THEN 'equal' ELSE 'different' END AS outcome, count(*) AS n FROM a FULL OUTER JOIN b ON a.k = b.k GROUP BY outcome""")
def agreement(spark, d):
    """Full outer comparison of two transcriptions by cell."""
    o = v.read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("cell"))
    a = o.filter("k % 10 <> 0").withColumnRenamed("cell", "left_cell")
    b = o.filter("k % 11 <> 0").withColumn("right_cell", F.when(F.col("k") % 13 == 0, "X").otherwise(F.col("cell"))).drop("cell")
    x = a.join(b, "k", "full_outer")
    outcome = F.when(F.col("left_cell").isNull(), "right only").when(F.col("right_cell").isNull(), "left only").when(F.col("left_cell") == F.col("right_cell"), "equal").otherwise("different")
    return x.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("g22_g23_budget_totals", """
SELECT o_custkey AS k, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN c ELSE 0 END) AS BIGINT) AS open, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN c ELSE 0 END) AS BIGINT) AS settled, count(*) FILTER (WHERE o_orderstatus = 'P') AS pending
FROM (SELECT *, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS c FROM orders) GROUP BY o_custkey""")
def budget(spark, d):
    when = lambda s: F.sum(F.when(F.col("o_orderstatus") == s, v.cents("o_totalprice")).otherwise(0)).cast("long")
    return v.read(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(when("O").alias("open"), when("F").alias("settled"), F.count_if(F.col("o_orderstatus") == "P").alias("pending"))
