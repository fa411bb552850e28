"""Files of delimited text to typed records: header rows, mapping, totals and repeated headers, values, accounts of every row."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.values import amount_of, normalize_header, parse_date
from ledgerloom.operators import mapping
from ledgerloom.operators.intake import header_rows
from ledgerloom.plans import ledger as v
from ledgerloom.plans.graph import Room
from ledgerloom.registry import query
from ledgerloom.sources.csvscan import scan
from ledgerloom.sources.files import scratch

#: Words of a row of totals, among its first texts; and how many those are.
TOTALS, FIRST = ("합계", "소계", "총계", "누계", "total"), 3
#: Data rows whose values are looked at for a mapping.
SAMPLES = 50


@dataclass(frozen=True)
class Ingested:
    """plans(file, status, header_row, overall, unmapped_required), matches, records(file, row, day, counterparty, amount, reference, note),
    issues(file, row, field, text), accounts(file, source, totals, repeated, with_issues, applied, computed, stated, agrees)."""

    files: DataFrame
    plans: DataFrame
    matches: DataFrame
    records: DataFrame
    issues: DataFrame
    accounts: DataFrame


def row_kinds(cells: DataFrame, heads: DataFrame) -> DataFrame:
    """(doc, row, kind) of the rows below each header: total, header (it repeats at least two, and half, of the header's texts) or data."""
    x = cells.filter("trim(text) <> ''").join(heads.select("doc", F.col("row").alias("head")), "doc")
    names = x.filter("row = head").select("doc", "col", F.col("text").alias("name"))
    n = names.groupBy("doc").agg(F.count("*").alias("n"))
    below = x.filter("row > head").join(names, ["doc", "col"], "left")
    low = F.lower("text")
    may = reduce(or_, [reduce(and_, [low.contains(c) for c in dict.fromkeys(w)]) for w in TOTALS])  # spares most texts the patterns
    total = may & normalize_header(F.col("text")).isin(*TOTALS)
    ordered = F.slice(F.array_sort(F.collect_list(F.struct("col", total.alias("t")))), 1, FIRST)  # one row's cells, bounded by the columns
    rows = below.groupBy("doc", "row").agg(F.exists(ordered, lambda c: c["t"]).alias("total"), F.count_if(F.col("text") == F.col("name")).alias("same")).join(F.broadcast(n), "doc")
    kind = F.when(F.col("total"), "total").when(F.col("same") >= F.greatest(F.lit(2), F.col("n") / 2), "header").otherwise("data")
    return rows.select("doc", "row", kind.alias("kind"))


def ingest(spark: SparkSession, path: str, specs: DataFrame | None = None, confirmed: DataFrame | None = None) -> Ingested:
    """Read all files under a path. Files whose mapping needs a confirmation give no records until confirmed(doc, col, field) has it."""
    room, specs = Room(spark), mapping.field_specs(spark) if specs is None else specs
    files, cells = scan(spark, path)
    cells = room.cut(cells.withColumnRenamed("file", "doc"))
    words = specs.select(F.explode("synonyms").alias("s")).select(normalize_header(F.col("s")).alias("word")).distinct()
    heads = room.cut(header_rows(cells.select("doc", F.col("row").cast("int").alias("row"), "col", "text"), words))
    headers = cells.join(F.broadcast(heads.select("doc", "row")), ["doc", "row"]).select("doc", "col", F.col("text").alias("header"))
    kinds = room.cut(row_kinds(cells, heads))
    data = cells.join(kinds.filter("kind = 'data'").select("doc", "row"), ["doc", "row"], "left_semi")
    near = data.join(F.broadcast(heads.select("doc", F.col("row").alias("head"))), "doc").filter(F.col("row") <= F.col("head") + SAMPLES)
    matches = mapping.suggest(headers, near.select("doc", "col", "text"), specs)
    if confirmed is not None:
        chosen = confirmed.join(specs.select("field", "required"), "field").select("doc", "col", "field", "required")
        kept = matches.join(chosen.select("doc", "col"), ["doc", "col"], "left_anti").join(chosen.select("doc", "field"), ["doc", "field"], "left_anti")
        more = chosen.join(headers, ["doc", "col"]).withColumns({"score": F.lit(0), "confidence": F.lit("CONFIRMED"), "share": F.lit(None).cast("double")})
        matches = room.cut(kept.select(*matches.columns).unionByName(more.select(*matches.columns)))
    over = mapping.overview(heads.select("doc"), matches, specs)
    plans = over.join(heads.select("doc", F.col("row").alias("header_row")), "doc").select("doc", F.when(F.col("needs_confirmation"), "NEEDS_MAPPING").otherwise("PARSED").alias("status"), "header_row", "overall", "unmapped_required")
    plans = room.cut(plans)
    parsed = plans.filter("status = 'PARSED'").select("doc")
    fields = matches.join(F.broadcast(parsed), "doc").select("doc", "col", "field", "required")
    value = lambda name: F.max(F.when(F.col("field") == name, F.trim("text"))).alias(name)
    names = [r.field for r in specs.select("field").orderBy("field").collect()]  # a format's few fields
    rows = kinds.filter("kind <> 'header'").join(F.broadcast(parsed), "doc", "left_semi")
    texts = cells.join(fields, ["doc", "col"]).groupBy("doc", "row").agg(*[value(n) for n in names])
    wide = rows.join(texts, ["doc", "row"], "left").withColumn("a", amount_of(F.col("amount"))).withColumn("d", parse_date(F.col("day")))
    wide = room.cut(wide.select("doc", "row", "kind", *[c for c in names if c not in ("amount", "day")], "amount", "day", F.col("a.number").alias("number"), F.col("a.error").alias("error"), "d"))
    kept = wide.filter("kind = 'data'")
    wrong = [
        F.when(F.col("error").isNotNull() | F.col("number").isNull(), F.struct(F.lit("amount").alias("field"), F.col("amount").alias("text"))),
        F.when(F.col("d").isNull(), F.struct(F.lit("day").alias("field"), F.col("day").alias("text"))),
        F.when(F.coalesce(F.col("counterparty"), F.lit("")) == "", F.struct(F.lit("counterparty").alias("field"), F.col("counterparty").alias("text"))),
    ]
    issues = kept.select("doc", "row", F.explode(F.array_compact(F.array(*wrong))).alias("i")).select("doc", "row", "i.*")
    bad = F.size(F.array_compact(F.array(*wrong))) > 0
    records = kept.filter(~bad).select("doc", "row", F.col("d").alias("day"), "counterparty", F.col("number").alias("amount"), *[c for c in ("reference", "note") if c in names])
    sums = wide.groupBy("doc").agg(
        F.count("*").alias("seen"), F.count_if(F.col("kind") == "total").alias("totals"), F.count_if((F.col("kind") == "data") & bad).alias("with_issues"), F.count_if((F.col("kind") == "data") & ~bad).alias("applied"),
        F.sum(F.when(F.col("kind") == "data", F.col("number"))).cast("long").alias("computed"), F.max(F.when(F.col("kind") == "total", F.col("number"))).alias("stated"),
    )
    all_rows = kinds.groupBy("doc").agg(F.count("*").alias("source"), F.count_if(F.col("kind") == "header").alias("repeated"))
    accounts = all_rows.join(sums, "doc").select("doc", "source", "totals", "repeated", "with_issues", "applied", "computed", "stated", (F.col("computed") == F.col("stated")).alias("agrees"))
    accounts = accounts.withColumn("balanced", F.col("source") == F.col("totals") + F.col("repeated") + F.col("with_issues") + F.col("applied"))
    return Ingested(files, plans, matches, records, issues, accounts)


# statements made from the orders: one file for every SHARDS-th customer, with a title, a header, a header again, and totals

SHARDS = 4
COLUMNS = ("일자", "거래처", "금액(원)", "비고")


def write_statements(spark, d, path: str) -> None:
    """Shard 3 has headers that name no field; shard 2 states another total."""
    c = v.read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    o = v.read(spark, d, "orders").join(c, "o_custkey").withColumn("g", F.col("o_custkey") % SHARDS)
    k = F.col("o_orderkey")
    day = F.when(k % 50 == 0, "n/a").when(k % 3 == 0, F.date_format("o_orderdate", "yyyy.MM.dd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    cents = v.cents("o_totalprice")
    amount = F.when(k % 60 == 1, "-").when(k % 2 == 0, F.format_number(cents, 0)).otherwise(cents.cast("string"))
    data = o.select("g", (k * 10).alias("at"), day.alias("c1"), F.col("c_name").alias("c2"), amount.alias("c3"), F.concat(F.lit('order "'), k, F.lit('",\nline two')).alias("c4"))
    names = F.when(F.col("g") == 3, F.array(*[F.lit(x) for x in ("aa", "bb", "cc", "dd")])).otherwise(F.array(*[F.lit(x) for x in COLUMNS]))
    groups = o.groupBy("g").agg(F.max("o_orderkey").alias("top"), F.sum(F.when(k % 60 != 1, cents)).alias("sum"))
    empty = F.lit("")
    row = lambda at, *cs: F.struct(at.cast("long").alias("at"), *[c.alias(f"c{i}") for i, c in enumerate(cs, 1)])
    head = lambda at: row(at, *[F.get(names, F.lit(i)) for i in range(4)])
    stated = (F.col("sum") + F.when(F.col("g") == 2, 1).otherwise(0)).cast("string")
    extra = groups.select("g", F.explode(F.array(row(F.lit(-2), F.lit("거래내역"), empty, empty, empty), head(F.lit(-1)), head(F.col("top") * 5), row(F.col("top") * 10 + 1, F.lit("합계"), empty, stated, empty))).alias("r")).select("g", "r.*")
    data.unionByName(extra).repartition("g").sortWithinPartitions("g", "at").drop("at").write.partitionBy("g").csv(path, header=False, quoteAll=True, escape='"', lineSep="\n")




def _shard():
    return F.regexp_extract("doc", "/g=([0-9]+)/", 1).cast("long").alias("g")


_ORDERS = f"o AS (SELECT o_custkey % {SHARDS} AS g, c_name, o_orderkey AS k, CAST(o_orderdate AS DATE) AS day, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS cents FROM orders JOIN customer ON c_custkey = o_custkey)"


@query("c11_csv_records", f"WITH {_ORDERS} SELECT g, day, c_name AS counterparty, cents AS amount, 'order \"' || k || '\",' || chr(10) || 'line two' AS note FROM o WHERE g <> 3 AND k % 50 <> 0 AND k % 60 <> 1")
def q_records(spark, d):
    """Typed records of all statements."""
    path = scratch(spark)
    write_statements(spark, d, path)
    return ingest(spark, path).records.select(_shard(), "day", "counterparty", "amount", "note")


@query("c02_c10_c12_c13_csv_accounts", f"""WITH {_ORDERS}
SELECT o.g, 'PARSED' AS status, CAST(2 AS INTEGER) AS header_row, count(*) + 2 AS source, 1::BIGINT AS totals, 1::BIGINT AS repeated, count(*) FILTER (WHERE k % 50 = 0 OR k % 60 = 1) AS with_issues, count(*) FILTER (WHERE k % 50 <> 0 AND k % 60 <> 1) AS applied,
  CAST(sum(CASE WHEN k % 60 <> 1 THEN cents END) AS BIGINT) AS computed, CAST(sum(CASE WHEN k % 60 <> 1 THEN cents END) + CAST(o.g = 2 AS BIGINT) AS BIGINT) AS stated, o.g <> 2 AS agrees, true AS balanced FROM o WHERE g <> 3 GROUP BY o.g
UNION ALL SELECT 3, 'NEEDS_MAPPING', 2, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL WHERE EXISTS (SELECT 1 FROM o WHERE g = 3)""")
def q_accounts(spark, d):
    """The plan of each statement, and where each of its rows went."""
    path = scratch(spark)
    write_statements(spark, d, path)
    got = ingest(spark, path)
    return got.plans.select("doc", "status", "header_row").join(got.accounts, "doc", "left").select(_shard(), "status", "header_row", "source", "totals", "repeated", "with_issues", "applied", "computed", "stated", "agrees", "balanced")
