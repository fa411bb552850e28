"""Records from the parsed rows of bank exports, tax invoices and delimited texts; each row keeps its reason when it gives none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ledgerloom.plans import ledger as v
from ledgerloom.plans.graph import Room, spread_join
from ledgerloom.registry import query
from ledgerloom.sources.csvscan import SMALL

IN_WORD, OUT_WORD = "입금", "출금"
SALES, PURCHASE = "매출", "매입"
DELIMITERS = (",", "\t", ";", "|")


def signed_amount(deposit: Column, withdrawal: Column, single: Column, memo: Column) -> Column:
    """struct<amount, reason>: money in is positive, money out negative; without an amount, why the row is excluded."""
    zero = F.lit(0).cast("long")
    into, out = F.coalesce(deposit, zero) != 0, F.coalesce(withdrawal, zero) != 0
    says_in, says_out = F.coalesce(memo, F.lit("")).contains(IN_WORD), F.coalesce(memo, F.lit("")).contains(OUT_WORD)
    alone = ~into & ~out & (F.coalesce(single, zero) != 0)
    known = (single < 0) | (says_in != says_out)
    amount = F.when(into & out, None).when(into, deposit).when(out, -withdrawal).when(alone & ((single < 0) | (says_in & ~says_out)), single).when(alone & says_out & ~says_in, -single)
    given = deposit.isNotNull() | withdrawal.isNotNull() | single.isNotNull()
    reason = F.when(into & out, "both").when(into | out | (alone & known), None).when(alone, "direction").when(given, "zero").otherwise("missing")
    return F.struct(amount.cast("long").alias("amount"), reason.alias("reason"))


@query("b09_signed_amount", """
WITH t AS (SELECT o_orderkey AS k, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS n FROM orders)
SELECT k, CASE k % 10 WHEN 0 THEN n WHEN 1 THEN -n WHEN 3 THEN n WHEN 4 THEN -n WHEN 6 THEN -n END AS amount,
  CASE k % 10 WHEN 2 THEN 'both' WHEN 5 THEN 'direction' WHEN 7 THEN 'zero' WHEN 8 THEN 'missing' WHEN 9 THEN 'direction' END AS reason FROM t""")
def q_signed(spark, d):
    n, m = F.col("n"), F.col("k") % 10
    x = v.read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), v.cents("o_totalprice").alias("n"))
    memo = F.when(m == 3, F.lit("무통장 입금")).when(m == 4, F.lit("자동 출금")).when(m == 9, F.lit("입금 출금"))
    rows = x.select(
        "k", F.when(m.isin(0, 2), n).when(m == 7, F.lit(0)).alias("deposit"), F.when(m.isin(1, 2), n).alias("withdrawal"),
        F.when(m.isin(3, 4, 5, 9), n).when(m == 6, -n).alias("single"), memo.alias("memo"),
    )
    return rows.select("k", signed_amount(F.col("deposit"), F.col("withdrawal"), F.col("single"), F.col("memo")).alias("s")).select("k", "s.amount", "s.reason")


def invoice_terms(supplier: Column, buyer: Column, own: Column, option: Column, hint: Column, total: Column, supply: Column, tax: Column, buyer_name: Column) -> Column:
    """struct<direction, amount, counterparty, kept, mismatch, missing>: the direction by the own registration number, else
    the option, else a hint that names only one; purchases and rows without an amount are not kept."""
    digits = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", "")
    mine = digits(own)
    sales, purchase = F.coalesce(hint.contains(SALES), F.lit(False)), F.coalesce(hint.contains(PURCHASE), F.lit(False))
    direction = (
        F.when((mine != "") & (digits(supplier) == mine), "sales").when((mine != "") & (digits(buyer) == mine), "purchase")
        .when(option.isin("sales", "purchase"), option).when(sales & ~purchase, "sales").when(purchase & ~sales, "purchase")
    )
    amount = F.coalesce(total, supply + F.coalesce(tax, F.lit(0)))
    name = F.when(direction == "sales", F.coalesce(buyer_name, F.lit(""))).otherwise("")
    kept = amount.isNotNull() & ~F.coalesce(direction == "purchase", F.lit(False))
    missing = F.array_compact(F.array(F.when(direction.isNull(), "direction"), F.when(name == "", "counterparty")))
    return F.struct(
        F.coalesce(direction, F.lit("unknown")).alias("direction"), amount.cast("long").alias("amount"), name.alias("counterparty"), kept.alias("kept"),
        F.coalesce(supply + tax != total, F.lit(False)).alias("mismatch"), F.array_join(missing, ",").alias("missing"),
    )


@query("b10_invoice_terms", """
WITH t AS (SELECT l_orderkey AS k, l_linenumber AS line, l_partkey AS p, l_suppkey AS s, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS n FROM lineitem),
x AS (SELECT *, CASE WHEN p % 5 = 0 THEN 'sales' WHEN p % 5 = 1 THEN 'purchase' WHEN p % 5 = 2 AND s % 2 = 0 THEN 'sales' WHEN p % 5 = 3 AND s % 2 = 0 THEN 'purchase' ELSE 'unknown' END AS direction FROM t)
SELECT k, line, p, s, n, direction, CASE WHEN n % 7 = 0 AND n % 3 = 0 THEN NULL WHEN n % 7 = 0 THEN n + n // 10 ELSE n + n // 10 + CASE WHEN n % 11 = 0 THEN 1 ELSE 0 END END AS amount,
  CASE WHEN direction = 'sales' AND s % 3 <> 0 THEN 'buyer' || s ELSE '' END AS counterparty, direction <> 'purchase' AND NOT (n % 7 = 0 AND n % 3 = 0) AS kept,
  n % 7 <> 0 AND n % 11 = 0 AND n % 3 <> 0 AS mismatch,
  CASE WHEN direction = 'unknown' THEN 'direction,counterparty' WHEN direction = 'sales' AND s % 3 <> 0 THEN '' ELSE 'counterparty' END AS missing FROM x""")
def q_invoice_terms(spark, d):
    n, p, s = F.col("n"), F.col("p"), F.col("s")
    x = v.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), v.cents("l_extendedprice").alias("n"))
    tax = F.expr("n div 10")
    terms = invoice_terms(
        F.when(p % 5 == 0, F.lit("123-45-67890")).otherwise(F.lit("999-99-99999")), F.when(p % 5 == 1, F.lit("123 45 67890")), F.lit("1234567890"),
        F.when((p % 5 == 2) & (s % 2 == 0), "sales").otherwise(F.lit(None)), F.when((p % 5 == 3) & (s % 2 == 0), "매입 세금계산서").when(p % 5 == 4, "매출 매입 목록"),
        F.when(n % 7 != 0, n + tax + F.when(n % 11 == 0, 1).otherwise(0)), F.when(n % 3 != 0, n).when(n % 7 == 0, None).otherwise(None), F.when((n % 7 == 0) & (n % 3 == 0), None).otherwise(tax),
        F.when(s % 3 != 0, F.concat(F.lit("buyer"), s)),
    )
    return x.select("k", "line", "p", "s", "n", terms.alias("t")).select("k", "line", "p", "s", "n", "t.*")


def sniff_delimiter(lines: DataFrame, key: str) -> DataFrame:
    """(key, delimiter) for lines(key, line): the one whose fields per line agree most, then that with more fields, then in
    the order of DELIMITERS; a comma if none gives two fields. Lines are not quoted."""
    marks = F.array(*[F.struct(F.lit(i).alias("p"), F.lit(x).alias("mark")) for i, x in enumerate(DELIMITERS)])
    x = lines.filter("line <> ''").select(key, "line", F.explode(marks).alias("m"))
    width = F.length("line") - F.length(F.replace(F.col("line"), F.col("m.mark"), F.lit(""))) + 1
    counted = x.groupBy(key, "m", width.alias("width")).agg(F.count("*").alias("c"))
    most = counted.groupBy(key, "m").agg(F.max_by("width", F.struct("c", -F.col("width"))).alias("mode"), F.max("c").alias("freq"), F.sum("c").alias("n"))
    best = most.withColumn("rank", F.when(F.col("mode") >= 2, F.struct((F.col("freq") / F.col("n")).alias("a"), F.col("mode").alias("b"), (-F.col("m.p")).alias("c"))))
    found = best.groupBy(key).agg(F.max_by("m.mark", "rank").alias("found"), F.max("rank").alias("rank"))
    return found.select(key, F.when(F.col("rank").isNull(), ",").otherwise(F.col("found")).alias("delimiter"))


@query("a05_delimiter_sniff", r"""
WITH x AS (SELECT doc_id AS k, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM (SELECT doc_id, max(text) AS text FROM documents GROUP BY doc_id)),
m AS (SELECT * FROM (VALUES (0, ','), (1, chr(9)), (2, ';'), (3, '|')) t(p, mark)),
w AS (SELECT k, p, mark, length(line) - length(replace(line, mark, '')) + 1 AS width, count(*) AS c FROM x, m WHERE line <> '' GROUP BY ALL),
r AS (SELECT *, sum(c) OVER (PARTITION BY k, p) AS n, row_number() OVER (PARTITION BY k, p ORDER BY c DESC, width) AS r FROM w),
b AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY c / n DESC, width DESC, p) AS best FROM r WHERE r = 1 AND width >= 2)
SELECT ks.k, coalesce(b.mark, ',') AS delimiter FROM (SELECT DISTINCT k FROM x WHERE line <> '') ks LEFT JOIN b ON b.k = ks.k AND b.best = 1""")
def q_delimiter(spark, d):
    """Delimiters of all documents, one for each id."""
    x = v.read(spark, d, "documents").groupBy(F.col("doc_id").alias("k")).agg(F.max("text").alias("text"))
    return sniff_delimiter(x.select("k", F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line")), "k")


def header_rows(cells: DataFrame, words: DataFrame, most=40, parts: int | None = None) -> DataFrame:
    """(doc, row, score, sure): the header row of each table of cells(doc, row, col, text): among the first non-empty rows the
    one with most points (3 for a cell that is a word of words(word), 1 for one that contains one; earlier rows win ties);
    with fewer than 3 points the first row of two texts or more, not sure.

    parts: tasks that many small tables are dealt to, each whole; without it a table may be of any size, since Spark leaves its
    first rows only before it shuffles. Texts that hold a word are broadcast if they are few; else hot ones are dealt out."""
    x = v.dealt(cells.filter("trim(text) <> ''").select("doc", "row", F.regexp_replace(F.lower("text"), r"[\s()]+", "").alias("bare")), parts, "doc")
    near = x.withColumn("at", F.dense_rank().over(W.partitionBy("doc").orderBy("row"))).filter(F.col("at") <= most).drop("at")
    texts = v.dealt(near.select("bare"), parts, "bare").distinct()
    lengths = [r[0] for r in words.select(F.length("word").alias("n")).distinct().collect() if r[0]]  # at most the longest word
    n = F.length("bare")
    parts = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda at: F.substring("bare", at, F.lit(k))))
    held = texts.select("bare", F.explode(F.array_distinct(F.flatten(F.array_compact(F.array(*[parts(k) for k in lengths]))))).alias("word")) if lengths else texts.select("bare", F.lit(None).cast("string").alias("word"))
    found = Room(cells.sparkSession).cut(held.join(words.select("word").distinct(), "word").groupBy("bare").agg(F.max(F.when(F.col("bare") == F.col("word"), 3).otherwise(1)).alias("points")))
    if found.limit(SMALL + 1).count() <= SMALL:
        near = near.join(F.broadcast(found), "bare", "left").fillna(0, ["points"])
    else:
        near = v.dealt(spread_join(near, texts.join(found, "bare", "left").fillna(0, ["points"]), "bare"), parts, "doc")
    rows = near.groupBy("doc", "row").agg(F.sum("points").cast("int").alias("score"), F.count("*").alias("texts"))
    best = rows.groupBy("doc").agg(F.max_by("row", F.struct("score", -F.col("row"))).alias("best"), F.max("score").alias("score"), F.min(F.when(F.col("texts") >= 2, F.col("row"))).alias("second"))
    sure = F.col("score") >= 3
    return best.select("doc", F.when(sure, F.col("best")).otherwise(F.col("second")).cast("int").alias("row"), "score", sure.alias("sure"))


HEADER_WORDS = ("quantity", "price", "day")


@query("c01_header_rows", """
WITH c AS (SELECT l_orderkey AS doc, CAST(l_linenumber AS INTEGER) AS row, unnest([1, 2, 3]) AS col, l_partkey AS p, l_suppkey AS s, l_quantity AS q FROM lineitem),
cells AS (SELECT doc, row, CASE WHEN p % 7 = 0 THEN CASE col WHEN 1 THEN 'Quantity' WHEN 2 THEN '(Price)' ELSE 'other' END WHEN p % 7 = 1 THEN CASE col WHEN 1 THEN 'unit price' WHEN 2 THEN 'x' ELSE '' END
  ELSE CASE col WHEN 1 THEN CAST(s AS VARCHAR) WHEN 2 THEN CASE WHEN s % 2 = 0 THEN CAST(CAST(q AS INTEGER) AS VARCHAR) ELSE ' ' END ELSE '' END END AS text FROM c),
b AS (SELECT doc, row, regexp_replace(lower(text), '[\\s()]+', '', 'g') AS bare FROM cells WHERE trim(text) <> ''),
f AS (SELECT *, dense_rank() OVER (PARTITION BY doc ORDER BY row) AS pos FROM b),
r AS (SELECT doc, row, sum(CASE WHEN bare IN ('quantity', 'price', 'day') THEN 3 WHEN contains(bare, 'quantity') OR contains(bare, 'price') OR contains(bare, 'day') THEN 1 ELSE 0 END) AS score, count(*) AS texts FROM f WHERE pos <= 40 GROUP BY doc, row),
m AS (SELECT doc, max(score) AS score, arg_min(row, row - 1000000 * score) AS best, min(CASE WHEN texts >= 2 THEN row END) AS second FROM r GROUP BY doc)
SELECT doc, CASE WHEN score >= 3 THEN best ELSE second END AS row, CAST(score AS INTEGER) AS score, score >= 3 AS sure FROM m""".replace("\\\\s", "\\s"))
def q_header_rows(spark, d):
    p, s = F.col("l_partkey") % 7, F.col("l_suppkey")
    kind = lambda a, b, c: F.array(*[x if isinstance(x, Column) else F.lit(x) for x in (a, b, c)])
    number = F.when(s % 2 == 0, F.col("l_quantity").cast("int").cast("string")).otherwise(F.lit(" "))
    texts = F.when(p == 0, kind("Quantity", "(Price)", "other")).when(p == 1, kind("unit price", "x", "")).otherwise(kind(s.cast("string"), number, ""))
    x = v.read(spark, d, "lineitem")
    cells = x.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("int").alias("row"), F.posexplode(texts).alias("col", "text"))
    return header_rows(cells, spark.createDataFrame([(w,) for w in HEADER_WORDS], "word string"), parts=v.tasks(x.count()))


def confirm_mapping(proposed: DataFrame, overrides: DataFrame) -> DataFrame:
    """(doc, col, field, confirmed): proposed(doc, col, field), with the user's choices (doc, col, field or null): a chosen
    column keeps no proposal, and a chosen field is taken from any other column."""
    kept = proposed.join(overrides.select("doc", "col"), ["doc", "col"], "left_anti").join(overrides.filter("field IS NOT NULL").select("doc", "field"), ["doc", "field"], "left_anti")
    return kept.select("doc", "col", "field", F.lit(False).alias("confirmed")).unionByName(overrides.filter("field IS NOT NULL").select("doc", "col", "field", F.lit(True).alias("confirmed")))


@query("c06_confirm_mapping", """
WITH p AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber AS col, 'f' || (l_linenumber % 5) AS field FROM lineitem),
o AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber AS col, CASE WHEN l_orderkey % 3 = 1 THEN 'f' || ((l_linenumber + 1) % 5) END AS field FROM lineitem WHERE l_linenumber = 2 AND l_orderkey % 3 > 0)
SELECT doc, col, field, false AS confirmed FROM p WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.doc = p.doc AND (o.col = p.col OR o.field = p.field)) UNION ALL SELECT doc, col, field, true FROM o WHERE field IS NOT NULL""")
def q_confirm(spark, d):
    n, k = F.col("l_linenumber"), F.col("l_orderkey")
    x = v.read(spark, d, "lineitem")
    proposed = x.select(k.alias("doc"), n.alias("col"), F.concat(F.lit("f"), n % 5).alias("field")).distinct()
    chosen = F.when(k % 3 == 1, F.concat(F.lit("f"), (n + 1) % 5))
    return confirm_mapping(proposed, x.filter((n == 2) & (k % 3 > 0)).select(k.alias("doc"), n.alias("col"), chosen.alias("field")).distinct())
