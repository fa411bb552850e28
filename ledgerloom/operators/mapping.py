"""Columns of many tables mapped to fields at once: header scores, checks of sample values, greedy assignment, confidence.

The assignment is the one that goes through all pairs of a column and a field in order (best score, required fields, column,
name) and takes each whose column and field are still free. Spark sorts the pairs of a table within one task; the pass streams
them and holds what one table has taken."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.values import normalize_header, parse_amount, parse_brn, parse_date, parse_int, parse_time
from ledgerloom.plans import ledger as v
from ledgerloom.plans.graph import Room
from ledgerloom.sources.csvscan import SMALL
from ledgerloom.registry import query

#: Least share of sample values that must look like the field's kind.
SHARE = 0.6
RANK = {"CONFIRMED": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1, "NONE": 0}

#: Fields of a settlement table: name, kind, required, synonyms, parts that rule a header out.
FIELDS = (
    ("amount", "amount", True, ("금액", "매출액", "amount"), ("비율", "rate")),
    ("counterparty", "text", True, ("거래처", "업체명", "supplier"), ()),
    ("day", "date", True, ("일자", "거래일", "date"), ()),
    ("reference", "text", False, ("전표번호", "번호", "document"), ("사업자",)),
    ("note", "text", False, ("비고", "적요", "note"), ()),
    ("quantity", "int", False, ("수량", "quantity"), ()),
)


def field_specs(spark: SparkSession, fields=FIELDS) -> DataFrame:
    """(field, kind, required, synonyms, excluded); a dimension of a format's few fields."""
    return spark.createDataFrame([(n, k, r, list(s), list(e)) for n, k, r, s, e in fields], "field string, kind string, required boolean, synonyms array<string>, excluded array<string>")


def score_of(header: Column, synonyms: Column, excluded: Column) -> Column:
    """100 for a synonym itself, 60 and its length (20 at most) for a header that contains one of two letters or more, 30 and
    its own length for a header of two or more that is part of one; the best of all synonyms; 0 for an excluded part."""
    def one(s: Column) -> Column:
        n = normalize_header(s)
        held = F.when((F.length(n) >= 2) & header.contains(n), 60 + F.least(F.length(n), F.lit(20)))
        return F.when(n == "", 0).when(header == n, 100).otherwise(F.coalesce(held, F.when((F.length(header) >= 2) & n.contains(header), 30 + F.least(F.length(header), F.lit(20))), F.lit(0)))

    out = F.exists(excluded, lambda e: header.contains(e))
    return F.when((header == "") | out, 0).otherwise(F.coalesce(F.array_max(F.transform(synonyms, one)), F.lit(0)))


def scores(headers: DataFrame, specs: DataFrame) -> DataFrame:
    """(doc, col, header, field, kind, required, score, confidence) of headers(doc, col, header) with each field that fits.

    Each distinct header is scored once, against the fields in one row, so nothing is multiplied by a join."""
    all_fields = specs.agg(F.collect_list(F.struct("field", "kind", "required", "synonyms", "excluded")).alias("fields")).first()["fields"]  # a format's few fields
    known = headers.select("header").distinct().withColumn("bare", normalize_header(F.coalesce("header", F.lit(""))))
    lit = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    found = F.array(*[F.struct(F.lit(f.field).alias("field"), F.lit(f.kind).alias("kind"), F.lit(f.required).alias("required"), score_of(F.col("bare"), lit(f.synonyms), lit(f.excluded)).alias("score")) for f in all_fields])
    known = Room(headers.sparkSession).cut(known.select("header", F.explode(F.filter(found, lambda s: s["score"] > 0)).alias("s")).select("header", "s.*"))
    x = headers.join(F.broadcast(known) if known.limit(SMALL + 1).count() <= SMALL else known, "header")
    return x.withColumn("confidence", F.when(F.col("score") == 100, "HIGH").when(F.col("score") >= 60, "MEDIUM").otherwise("LOW"))


def looks_like(kind: Column, text: Column) -> Column:
    number, wrong = parse_amount(text)
    brn = parse_brn(text)
    good = F.when(kind == "date", parse_date(text).isNotNull()).when(kind == "amount", number.isNotNull() & wrong.isNull()).when(kind == "time", parse_time(text).isNotNull())
    return F.coalesce(good.when(kind == "int", parse_int(text).isNotNull()).when(kind == "brn", brn.rlike("[0-9]")).otherwise(True), F.lit(False))


KINDS = ("date", "amount", "time", "int", "brn", "text")


def checked(pairs: DataFrame, samples: DataFrame, parts: int | None = None) -> DataFrame:
    """pairs without those of LOW confidence whose column's samples(doc, col, text) mostly don't look like the field's kind; the
    confidence of others is one step lower then. share is null for columns without values."""
    shares = v.dealt(samples.filter("trim(text) <> ''"), parts, "doc", "col").groupBy("doc", "col").agg(*[F.avg(looks_like(F.lit(k), F.col("text")).cast("int")).alias(f"_{k}") for k in KINDS])
    share = reduce(lambda acc, k: acc.when(F.col("kind") == k, F.col(f"_{k}")), KINDS, F.when(F.lit(False), F.lit(None).cast("double")))
    x = v.dealt(pairs, parts, "doc", "col").join(shares, ["doc", "col"], "left").withColumn("share", share).drop(*[f"_{k}" for k in KINDS])
    x = x.withColumn("weak", F.coalesce(F.col("share") < SHARE, F.lit(False)))
    lower = F.when(F.col("confidence") == "HIGH", "MEDIUM").otherwise("LOW")
    return x.filter("NOT (weak AND confidence = 'LOW')").withColumn("confidence", F.when(F.col("weak"), lower).otherwise(F.col("confidence"))).drop("weak")


def greedy(pairs: DataFrame, group: str, left: str, right: str, order: list[Column], parts: int | None = None) -> DataFrame:
    """The rows of pairs that a pass in ``order`` (then left and right) would take, each left and right of a group at most once.

    (group, left, right) must be unique. One shuffle by group and a sort, which spills; the pass holds the lefts and rights that
    one group has taken."""
    at = [pairs.columns.index(c) for c in (group, left, right)]

    def run(batches):
        now, lefts, rights = object(), set(), set()
        for b in batches:
            free = []
            for g, x, y in zip(*(b.column(i).to_pylist() for i in at), strict=True):
                if g != now:
                    now, lefts, rights = g, set(), set()
                good = x not in lefts and y not in rights
                if good:
                    lefts.add(x), rights.add(y)
                free.append(good)
            yield b.filter(pa.array(free, pa.bool_()))

    keys = [f"_o{i}" for i in range(len(order))]
    x = pairs.withColumns(dict(zip(keys, order, strict=True)))
    x = x.repartition(group) if parts is None else x.repartition(parts, group)
    return x.sortWithinPartitions(group, *keys, left, right).select(*pairs.columns).mapInArrow(run, pairs.schema)


def suggest(headers: DataFrame, samples: DataFrame, specs: DataFrame, parts: int | None = None) -> DataFrame:
    """(doc, col, header, field, required, score, confidence, share): the suggested mapping of every table; parts: tasks that
    the tables are dealt to (None: as the session has them)."""
    pairs = checked(scores(headers, specs), samples, parts)
    order = [(-F.col("score")).alias("a"), (~F.col("required")).alias("b")]
    return greedy(pairs, "doc", "col", "field", order, parts).select("doc", "col", "header", "field", "required", "score", "confidence", "share")


def overview(docs: DataFrame, matches: DataFrame, specs: DataFrame, parts: int | None = None) -> DataFrame:
    """(doc, matched, unmapped_required, overall, needs_confirmation) for every row of docs(doc): overall is the least confidence
    of the required fields, LOW where one is missing, NONE without a match."""
    required = [r.field for r in specs.filter("required").select("field").collect()]  # a format's few fields
    rank = reduce(lambda acc, kv: acc.when(F.col("confidence") == kv[0], kv[1]), RANK.items(), F.when(F.lit(False), 0))
    x = v.dealt(matches, parts, "doc").groupBy("doc").agg(F.count("*").alias("matched"), F.sort_array(F.collect_set(F.when(F.col("required"), F.col("field")))).alias("have"), F.min(F.when(F.col("required"), rank)).alias("least"))
    x = v.dealt(docs.select("doc"), parts, "doc").join(x, "doc", "left").fillna(0, ["matched"])
    missing = F.array_except(F.array(*[F.lit(n) for n in sorted(required)]).cast("array<string>"), F.coalesce("have", F.array().cast("array<string>")))
    x = x.withColumn("missing", missing)
    name = reduce(lambda acc, kv: acc.when(F.col("least") == kv[1], kv[0]), RANK.items(), F.when(F.lit(False), ""))
    overall = F.when(F.col("matched") == 0, "NONE").when((F.size("missing") > 0) | F.col("least").isNull(), "LOW").otherwise(name)
    confirm = (F.size("missing") > 0) | F.coalesce(F.col("least") < RANK["HIGH"], F.lit(False))
    return x.select("doc", "matched", F.array_join("missing", ",").alias("unmapped_required"), overall.alias("overall"), confirm.alias("needs_confirmation"))


# tables made from the given ones: each order is a table, each of its lines a column with a header and two values

#: Headers that occur; '' is a column without one.
HEADERS = ("금액(원)", "거래처명", "거래 일자", "전표번호", "비고", "매출액", "Amount", "supplier name", "date", "수량", "사업자 번호", "할인 비율 금액", "일", "no", "")


def tables(spark, d) -> tuple[DataFrame, DataFrame, int]:
    """headers(doc, col, header), samples(doc, col, text), and the tasks for them."""
    x = v.read(spark, d, "lineitem")
    parts = v.tasks(x.count())
    x = x.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("int").alias("col"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"))
    x = v.dealt(x, parts, "doc", "col").groupBy("doc", "col").agg(F.max("p").alias("p"), F.max("s").alias("s"))
    names = F.array(*[F.lit(h) for h in HEADERS])
    texts = F.when(F.col("s") % 4 == 0, F.array(F.lit("1,234"), F.lit("99"))).when(F.col("s") % 4 == 1, F.array(F.lit("2025-01-02"), F.lit("2025-03-04"))).when(F.col("s") % 4 == 2, F.array(F.lit("12"), F.lit("x"))).otherwise(F.array(F.lit(""), F.lit(" ")))
    return x.select("doc", "col", F.get(names, (F.col("p") % len(HEADERS)).cast("int")).alias("header")), x.select("doc", "col", F.explode(texts).alias("text")), parts


def _sql() -> str:
    """The same by a recursion over the ranked pairs: step k takes pair k if its column and field are free."""
    fields = ", ".join(f"('{n}', '{k}', {r}, {list(s)!r}, {list(e)!r}::VARCHAR[])" for n, k, r, s, e in FIELDS)
    headers = ", ".join("'" + h + "'" for h in HEADERS)
    return f"""WITH RECURSIVE spec(field, kind, required, synonyms, excluded) AS (VALUES {fields}),
x AS MATERIALIZED (SELECT l_orderkey AS doc, CAST(l_linenumber AS INTEGER) AS col, max(l_partkey) AS p, max(l_suppkey) AS s FROM lineitem GROUP BY ALL),
h AS (SELECT doc, col, [{headers}][p % {len(HEADERS)} + 1] AS header, s % 4 AS v FROM x),
b AS MATERIALIZED (SELECT DISTINCT header, regexp_replace(regexp_replace(lower(trim(header)), '\\((원|krw)\\)', '', 'g'), '[\\s()]+', '', 'g') AS bare FROM h),
sc AS MATERIALIZED (SELECT header, field, kind, required, max(CASE WHEN bare = syn THEN 100 WHEN contains(bare, syn) THEN 60 + length(syn) WHEN length(bare) >= 2 AND contains(syn, bare) THEN 30 + length(bare) ELSE 0 END) AS score
  FROM (SELECT *, unnest(synonyms) AS syn FROM b, spec WHERE bare <> '' AND NOT list_bool_or(list_transform(list_concat(excluded, ['~']), lambda e: contains(bare, e)))) GROUP BY ALL),
pairs AS (SELECT doc, col, h.header, field, required, score, CASE WHEN score = 100 THEN 'HIGH' WHEN score >= 60 THEN 'MEDIUM' ELSE 'LOW' END AS conf,
  CASE WHEN v = 3 THEN NULL WHEN kind = 'text' THEN 1.0 WHEN v = 0 THEN CASE kind WHEN 'amount' THEN 1.0 WHEN 'int' THEN 0.5 ELSE 0.0 END WHEN v = 1 THEN CASE WHEN kind = 'date' THEN 1.0 ELSE 0.0 END ELSE CASE WHEN kind IN ('amount', 'int') THEN 0.5 ELSE 0.0 END END AS share
  FROM h JOIN sc ON sc.header = h.header WHERE score > 0),
ranked AS MATERIALIZED (SELECT doc, col, header, field, required, score, share, CASE WHEN share < 0.6 THEN CASE conf WHEN 'HIGH' THEN 'MEDIUM' ELSE 'LOW' END ELSE conf END AS confidence,
  row_number() OVER (PARTITION BY doc ORDER BY score DESC, NOT required, col, field) AS k FROM pairs WHERE NOT (coalesce(share < 0.6, false) AND conf = 'LOW')),
fold AS (SELECT doc, 0::BIGINT AS k, []::INTEGER[] AS cols, []::VARCHAR[] AS fields, CAST(NULL AS BIGINT) AS took FROM (SELECT DISTINCT doc FROM ranked)
  UNION ALL SELECT r.doc, r.k, CASE WHEN free THEN list_append(cols, r.col) ELSE cols END, CASE WHEN free THEN list_append(fields, r.field) ELSE fields END, CASE WHEN free THEN r.k END
  FROM (SELECT f.cols, f.fields, r.*, NOT list_contains(f.cols, r.col) AND NOT list_contains(f.fields, r.field) AS free FROM fold f JOIN ranked r ON r.doc = f.doc AND r.k = f.k + 1) r),
m AS (SELECT r.* FROM fold JOIN ranked r ON r.doc = fold.doc AND r.k = fold.took)"""


@query("c03_c04_c05_suggested_mapping", _sql() + " SELECT doc, col, field, CAST(score AS INTEGER) AS score, confidence, CAST(share AS DOUBLE) AS share FROM m")
def q_suggest(spark, d):
    """Columns of each order's table mapped to fields."""
    headers, samples, parts = tables(spark, d)
    return suggest(headers, samples, field_specs(spark), parts).select("doc", "col", "field", F.col("score").cast("int").alias("score"), "confidence", "share")


@query("c16_mapping_confidence", _sql() + """, o AS (SELECT doc, count(*) AS matched, count(*) FILTER (WHERE required) AS n, min(CASE WHEN required THEN CASE confidence WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END END) AS least,
  array_to_string(list_sort(list_filter(['amount', 'counterparty', 'day'], lambda f: NOT list_contains(list(field), f))), ',') AS missing FROM m GROUP BY doc)
SELECT d.doc, coalesce(matched, 0) AS matched, coalesce(missing, 'amount,counterparty,day') AS unmapped_required, CASE WHEN matched IS NULL THEN 'NONE' WHEN n < 3 THEN 'LOW' ELSE ['LOW', 'MEDIUM', 'HIGH'][least] END AS overall, coalesce(n < 3 OR least < 3, true) AS needs_confirmation
FROM (SELECT DISTINCT doc FROM x) d LEFT JOIN o USING (doc)""")
def q_confidence(spark, d):
    headers, samples, parts = tables(spark, d)
    specs = field_specs(spark)
    docs = v.dealt(v.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc")), parts, "doc").distinct()
    return overview(docs, suggest(headers, samples, specs, parts), specs, parts)
