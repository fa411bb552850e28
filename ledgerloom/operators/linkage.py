"""Joins and record linkage: documents, lines, payments, versions, facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ledgerloom.plans import ledger as v
from ledgerloom.registry import query


def attribute(payments: DataFrame, groups: DataFrame, references: DataFrame, as_of: str) -> DataFrame:
    """(id, grp, reason): a payment's own counterparty if that is a group, else the one group its reference hits.

    groups(counterparty), references(reference, counterparty). Reasons: after_as_of, several_groups, no_group."""
    own = groups.select(F.col("counterparty").alias("own")).distinct()
    refs = references.select(F.col("reference").alias("word"), F.col("counterparty").alias("ref_group")).distinct()
    words = payments.select("id", F.explode(F.array_union(F.split("memo", " "), F.array("reference"))).alias("word")).filter("word <> ''")
    hit = words.join(refs, "word").groupBy("id").agg(F.count_distinct("ref_group").alias("n"), F.min("ref_group").alias("one"))
    x = payments.join(own, payments["counterparty"] == own["own"], "left").join(hit, "id", "left")
    late = F.col("booked") > F.lit(as_of).cast("date")
    grp = F.when(late, None).when(F.col("own").isNotNull(), F.col("own")).when(F.col("n") == 1, F.col("one"))
    reason = F.when(late, "after_as_of").when(grp.isNotNull(), None).when(F.col("n") > 1, "several_groups").otherwise("no_group")
    return x.select("id", grp.alias("grp"), reason.alias("reason"))


@query("d01_d02_attribution", v.with_views("invoice", "payment") + f""", hit AS (
  SELECT p.id, count(DISTINCT i.counterparty) AS n, min(i.counterparty) AS one FROM v_payment p JOIN v_invoice i ON i.reference <> '' AND (p.reference = i.reference OR list_contains(string_split(p.memo, ' '), i.reference)) GROUP BY p.id),
x AS (SELECT p.id, p.booked, n, one, CASE WHEN EXISTS (SELECT 1 FROM v_invoice i WHERE i.counterparty = p.counterparty) THEN p.counterparty END AS own FROM v_payment p LEFT JOIN hit USING (id))
SELECT id, CASE WHEN booked > DATE '{v.AS_OF}' THEN NULL WHEN own IS NOT NULL THEN own WHEN n = 1 THEN one END AS grp,
  CASE WHEN booked > DATE '{v.AS_OF}' THEN 'after_as_of' WHEN own IS NOT NULL OR n = 1 THEN NULL WHEN n > 1 THEN 'several_groups' ELSE 'no_group' END AS reason FROM x""")
def q_attribution(spark, d):
    i = v.invoices(spark, d)
    return attribute(v.payments(spark, d), i, i, v.AS_OF)


def corroborate(invoices: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, state, n_hits): an invoice with one sale line of its reference supports it; several, or none although its
    counterparty has sale lines, is pending; without sale lines it is a receivable of its own."""
    sales = lines.filter("line_kind = 'sale'")
    hits = sales.groupBy("counterparty", "reference").agg(F.count("*").alias("n_hits"))
    some = sales.select("counterparty", F.lit(True).alias("has_sales")).distinct()
    x = invoices.join(hits, ["counterparty", "reference"], "left").join(some, "counterparty", "left").fillna(0, ["n_hits"])
    state = F.when(F.col("n_hits") == 1, "corroborating").when((F.col("n_hits") > 1) | F.coalesce("has_sales", F.lit(False)), "pending").otherwise("own")
    return x.select("id", state.alias("state"), "n_hits")


@query("d05_f14_receivable_states", v.with_views("line", "invoice") + """, h AS (SELECT counterparty, reference, count(*) AS n FROM v_line WHERE line_kind = 'sale' GROUP BY ALL)
SELECT i.id, coalesce(n, 0) AS n_hits, CASE WHEN n = 1 THEN 'corroborating' WHEN n > 1 OR i.counterparty IN (SELECT counterparty FROM h) THEN 'pending' ELSE 'own' END AS state FROM v_invoice i LEFT JOIN h ON h.counterparty = i.counterparty AND h.reference = i.reference""")
def q_states(spark, d):
    return corroborate(v.invoices(spark, d), v.lines(spark, d))


def duplicates(lines: DataFrame, parts: int | None = None) -> DataFrame:
    """(id, n_earlier, first) of every line: how many earlier lines of another version have its key, in (time, version, id) order,
    and the first of them; 0 and null if there are none. Lines without a time come last, lines without a key are equal to no other.

    lines(id, key, version, seen), dealt to ``parts`` tasks. Counting needs no pairs: all earlier ones less those of the own version.
    Nor does the first one: it is the group's first line, or else the first one of another version than that."""
    order = [F.col("seen").asc_nulls_last(), "version", "id"]
    every, own = W.partitionBy("key").orderBy(*order).rowsBetween(W.unboundedPreceding, -1), W.partitionBy("key", "version").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    x = v.dealt(lines.withColumn("key", F.coalesce("key", "id")), parts, "key").withColumn("n_earlier", F.count("*").over(every) - F.count("*").over(own))
    x = x.withColumn("a", F.first(F.struct("version", "id")).over(every))
    x = x.withColumn("b", F.first(F.when(F.col("version") != F.col("a.version"), F.col("id")), ignorenulls=True).over(every))
    return x.select("id", "n_earlier", F.when(F.col("version") != F.col("a.version"), F.col("a.id")).otherwise(F.col("b")).alias("first"))


@query("d07_d10_h03_duplicate_lines", v.with_views("line") + """, x AS (SELECT id, coalesce(reference || ':' || amount % 7, id) AS key, CAST(substr(id, length(id)) AS INTEGER) % 3 AS version, least(received, closed, paid) AS seen FROM v_line),
y AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seen NULLS LAST, version, id) AS n FROM x)
SELECT a.id, count(b.id) AS n_earlier, arg_min(b.id, b.n) AS first FROM y a LEFT JOIN y b ON b.key = a.key AND b.version <> a.version AND b.n < a.n GROUP BY a.id""")
def q_duplicates(spark, d):
    """All lines; a line's origin is the earliest of its facts, whichever of them it has."""
    x = v.lines(spark, d)
    return duplicates(x.select("id", F.concat("reference", F.lit(":"), F.col("amount") % 7).alias("key"), (F.substring("id", -1, 1).cast("int") % 3).alias("version"), F.least("received", "closed", "paid").alias("seen")), v.tasks(v.read(spark, d, "lineitem").count()))


VERSIONS = "ver AS (SELECT o_custkey AS document, o_orderkey AS version, o_orderstatus AS status, o_totalprice AS price, CAST(o_orderdate AS DATE) AS day FROM orders)"


def versions(spark, d) -> DataFrame:
    return v.read(spark, d, "orders").select(F.col("o_custkey").alias("document"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").cast("date").alias("day"))


@query("d14_d15_d23_h05_latest_versions", "WITH " + VERSIONS + " SELECT document, max(version) AS latest, max(version) FILTER (WHERE status = 'F') AS parsed, arg_max(status, version) AS status FROM ver GROUP BY document")
def q_latest(spark, d):
    """Latest version, latest parsed version and latest status of each document, in one aggregation."""
    parsed = F.max(F.when(F.col("status") == "F", F.col("version")))
    return versions(spark, d).groupBy("document").agg(F.max("version").alias("latest"), parsed.alias("parsed"), F.max_by("status", "version").alias("status"))


@query("d16_d17_owned_carried", "WITH " + VERSIONS + """, head AS (SELECT document, max(version) AS head FROM ver GROUP BY document)
SELECT l_partkey AS part, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT version FROM ver WHERE status = 'F') AND l_orderkey NOT IN (SELECT head FROM head) GROUP BY l_partkey""")
def q_owned(spark, d):
    """Records of any parsed version (semi join) that the current version doesn't have (anti join)."""
    x = versions(spark, d)
    line = v.read(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    heads = x.groupBy("document").agg(F.max("version").alias("l_orderkey"))
    mine = line.join(x.filter("status = 'F'").select(F.col("version").alias("l_orderkey")), "l_orderkey", "left_semi").join(heads, "l_orderkey", "left_anti")
    return mine.groupBy(F.col("l_partkey").alias("part")).agg(F.count("*").alias("n"))


#: Candidates that are shown for one payment; more are said to be cut.
SHOWN = 50


@query("d20_h07_candidates", v.with_views("invoice", "payment") + f"""
, x AS (SELECT p.id AS pid, i.id AS iid, p.amount = i.amount AS equal, p.reference <> '' AND p.reference = i.reference AS named, datediff('day', i.issued, p.booked) BETWEEN -7 AND 400 AS near, abs(p.amount - i.amount) AS off
  FROM v_payment p JOIN v_invoice i USING (counterparty) WHERE counterparty <> '')
SELECT pid, iid, equal, named, near, CAST(rank AS INTEGER) AS rank, n > {SHOWN} AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY named DESC, near DESC, off, iid) AS rank, count(*) OVER (PARTITION BY pid) AS n FROM x) WHERE rank <= {SHOWN}""".replace("\n, x AS", ", x AS"))
def q_candidates(spark, d):
    """Items that a payment may be for: those of its counterparty, named ones first, then those within the window, then by amount;
    the first SHOWN with their reasons, and whether there are more."""
    p, i = v.payments(spark, d).filter("counterparty <> ''"), v.invoices(spark, d)
    x = p.select(F.col("id").alias("pid"), "counterparty", F.col("amount").alias("paid"), "booked", F.col("reference").alias("ref"))
    x = x.join(i.select(F.col("id").alias("iid"), "counterparty", "amount", "issued", "reference"), "counterparty")
    x = x.select("pid", "iid", (F.col("paid") == F.col("amount")).alias("equal"), ((F.col("ref") != "") & (F.col("ref") == F.col("reference"))).alias("named"),
                 F.datediff("booked", "issued").between(-7, 400).alias("near"), F.abs(F.col("paid") - F.col("amount")).alias("off"))
    order = F.row_number().over(W.partitionBy("pid").orderBy(F.desc("named"), F.desc("near"), "off", "iid"))
    x = x.withColumn("rank", order).withColumn("n", F.count("*").over(W.partitionBy("pid")))
    return x.filter(F.col("rank") <= SHOWN).select("pid", "iid", "equal", "named", "near", "rank", (F.col("n") > SHOWN).alias("truncated"))


@query("d21_stated_rate_mode", """
SELECT o_custkey AS k, rate FROM (SELECT o_custkey, o_orderpriority AS rate, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, min(o_orderkey)) AS r FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey, o_orderpriority) WHERE r = 1""")
def q_mode(spark, d):
    """The most frequent value of a group; of equally frequent ones the one seen first."""
    c = v.read(spark, d, "orders").filter("o_orderstatus <> 'P'").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("c"), F.min("o_orderkey").alias("first"))
    return c.groupBy(F.col("o_custkey").alias("k")).agg(F.max_by("o_orderpriority", F.struct("c", -F.col("first"))).alias("rate"))


@query("d22_fact_table_links", """
SELECT l_orderkey AS k, l_returnflag AS label, l_suppkey AS fact, count(*) AS mentions FROM lineitem WHERE l_partkey % 10 <> 0 GROUP BY ALL""")
def q_fact_links(spark, d):
    """Facts with arrays of table labels, exploded, without masked ones, with mention counts."""
    x = v.read(spark, d, "lineitem")
    x = v.dealt(x.filter("l_partkey % 10 <> 0").select("l_orderkey", "l_suppkey", "l_returnflag"), v.tasks(x.count()), "l_orderkey", "l_suppkey").groupBy("l_orderkey", "l_suppkey").agg(F.collect_list("l_returnflag").alias("refs"))
    return x.select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("fact"), F.explode("refs").alias("label")).groupBy("k", "label", "fact").agg(F.count("*").alias("mentions"))


@query("d24_d25_left_outer_newest", """
SELECT c_custkey AS k, newest, status FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS newest, arg_max(o_orderstatus, o_orderkey) AS status FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY o_custkey) ON o_custkey = c_custkey""")
def q_newest(spark, d):
    o = v.read(spark, d, "orders").filter(F.col("o_orderstatus").isin("F", "O")).groupBy("o_custkey").agg(F.max("o_orderkey").alias("newest"), F.max_by("o_orderstatus", "o_orderkey").alias("status"))
    c = v.read(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return c.join(o, c["k"] == o["o_custkey"], "left").select("k", "newest", "status")
