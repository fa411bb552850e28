"""Reading inputs of unknown layout: file kinds, tables in HTML, header scores, column mapping, row accounting, stores."""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ledgerloom.functions.values import amount_of
from ledgerloom.plans import ledger as v
from ledgerloom.registry import query


def file_kind(content: Column) -> Column:
    """Kind by first bytes, never by name."""
    head = F.hex(F.substring(content, 1, 8))
    text = F.lower(F.ltrim(F.decode(F.substring(content, 1, 512), "ISO-8859-1")))
    return (
        F.when(head.startswith("25504446"), "pdf").when(head.startswith("504B0304"), "xlsx").when(head.startswith("D0CF11E0A1B11AE1"), "xls")
        .when(text.rlike("^(<!doctype html|<html|<table)"), "html").when(text.contains(","), "csv").otherwise("unknown")
    )


@query("a01_file_kind", """
SELECT kind, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(lower(ltrim(substr(html, 1, 400))), '^(<!doctype html|<html|<table)') THEN 'html' WHEN contains(substr(html, 1, 400), ',') THEN 'csv' ELSE 'unknown' END AS kind FROM pages) GROUP BY kind""")
def q_kind(spark, d):
    return v.read(spark, d, "pages").select(file_kind(F.encode("html", "UTF-8")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


#: Most columns and rows that one cell may span, as browsers have it.
ACROSS, DOWN = 1000, 65_534


#: Plain markup, which needs no parser: tags whose content is markup, with nothing but quoted attributes without references.
_PLAIN = "a|b|body|br|caption|div|em|h[1-6]|html|i|img|li|ol|p|span|strong|table|tbody|td|tfoot|th|thead|tr|u|ul"
_TAG = rf"""<(?:/((?i:{_PLAIN}))|((?i:{_PLAIN}))((?:[ \t\n]++[a-zA-Z]++="[^"<>&]*+")*+))>([^<]*+)"""
_TOKENS, _PAGE = re.compile(_TAG), re.compile(f"[^<]*+(?:{_TAG})*+(?<=>)")
_ATTRIBUTES = re.compile('([a-zA-Z]+)="([^"]*)"')


class _Cells(HTMLParser):
    """Rows of cells of every table; spans are filled from their cell, as far as the table has rows."""

    def read(self, page: str) -> list[tuple]:
        """(table, row, column, text) of a page; plain pages by their tokens at once, others by the parser."""
        if not _PAGE.fullmatch(page):
            self.feed(page)
            return self.out
        for end, start, attributes, text in _TOKENS.findall(page):
            if end:
                self.handle_endtag(end.lower())
            else:
                self.handle_starttag(start.lower(), [(k.lower(), x) for k, x in _ATTRIBUTES.findall(attributes)] if attributes else ())
            if text and self.stack:
                self.handle_data(unescape(text))
        return self.out

    def __init__(self):
        super().__init__()
        self.stack, self.out, self.tables = [], [], 0

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables += 1
            self.stack.append({"table": self.tables, "row": 0, "taken": set(), "free": 1, "cell": None, "down": {}})
        elif self.stack and tag == "tr":
            self.begin_row(self.stack[-1])
        elif self.stack and tag in ("td", "th"):
            self.close()
            a = dict(attrs)
            span = lambda k, most: min(int(a[k]), most) if (a.get(k) or "").isdigit() and int(a[k]) > 0 else 1
            self.stack[-1]["cell"] = [span("colspan", ACROSS), span("rowspan", DOWN), ""] if a else [1, 1, ""]

    def handle_data(self, data):
        if self.stack and self.stack[-1]["cell"]:
            self.stack[-1]["cell"][2] += data

    def handle_endtag(self, tag):
        if self.stack and tag in ("td", "th", "tr"):
            self.close()
        elif self.stack and tag == "table":
            self.close()
            self.stack.pop()

    def begin_row(self, t):
        """A new row; columns that cells above reach down to are filled first."""
        self.close()
        t["row"] += 1
        t["taken"], t["free"] = set(t["down"]), 1
        if t["down"]:
            self.out += [(t["table"], t["row"], c, text) for c, (_, text) in t["down"].items()]
            t["down"] = {c: (left - 1, text) for c, (left, text) in t["down"].items() if left > 1}

    def close(self):
        t = self.stack[-1]
        if t["cell"]:
            across, down, text = t["cell"]
            text, col, taken = " ".join(text.split()), t["free"], t["taken"]
            while col in taken:
                col += 1
            t["free"] = col + 1
            for c in range(col, col + across):
                if c not in taken:
                    taken.add(c)
                    self.out.append((t["table"], t["row"], c, text))
                    if down > 1:
                        t["down"][c] = (down - 1, text)
            t["cell"] = None


def html_cells(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, tbl, row, col, text) of all tables; nested tables are tables of their own."""

    schema = pa.schema([("k", pa.int64()), ("tbl", pa.int32()), ("row", pa.int32()), ("col", pa.int32()), ("text", pa.string())])

    def run(batches):
        for b in batches:
            rows = [(k, *c) for k, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if h for c in _Cells().read(h)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [()] * 5, schema, strict=True)], schema=schema)

    return pages.select(F.col(key).cast("long").alias("k"), F.col(html).alias("h")).mapInArrow(run, "k long, tbl int, row int, col int, text string").withColumnRenamed("k", key)


@query("a06_html_tables", """
WITH l AS (SELECT l_orderkey AS k, l_partkey AS p, CAST(l_quantity AS BIGINT) AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) + 1 AS row FROM lineitem),
h AS (SELECT DISTINCT k FROM l)
SELECT k AS page, 1 AS tbl, 1 AS row, c AS col, CASE WHEN c < 3 THEN 'order ' || k ELSE 'qty & more' END AS text FROM h, (VALUES (1), (2), (3)) t(c)
UNION ALL SELECT k, 1, CAST(row AS INTEGER), c, CASE c WHEN 1 THEN CAST(k AS VARCHAR) WHEN 2 THEN CAST(p AS VARCHAR) ELSE CAST(q AS VARCHAR) END FROM l, (VALUES (1), (2), (3)) t(c)""")
def q_tables(spark, d):
    """Orders as pages with a table each: a header across two columns, the order's number down all lines. The given pages hold no table."""
    order = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    x = v.read(spark, d, "lineitem")
    x = v.dealt(x, v.tasks(x.count()), "l_orderkey").select(F.col("l_orderkey").alias("page"), order.alias("n"), F.concat(F.lit("<td>"), "l_partkey", F.lit("</td><td> "), F.col("l_quantity").cast("long"), F.lit(" </td></tr>")).alias("h"))
    x = x.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("n", "h"))).alias("rows"))
    lines = F.array_join(F.transform("rows", lambda r: r["h"]), "<tr>")
    html = F.concat(F.lit('<p>text</p><table><tr><th colspan="2">order '), "page", F.lit('<th>qty &amp; more</tr><tr><td rowspan="'), F.size("rows"), F.lit('">'), "page", F.lit("</td>"), lines, F.lit("</table>"))
    return html_cells(x.select("page", html.alias("html")), "page", "html")


@query("c02_c04_c12_c13_row_accounting", """
WITH x AS (SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_partkey % 20 = 0 THEN '합계' WHEN l_partkey % 20 = 1 THEN 'n/a' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS text FROM lineitem)
SELECT k, count(*) AS source, count(*) FILTER (WHERE text = '합계') AS totals, count(*) FILTER (WHERE text = 'n/a') AS issues, count(*) FILTER (WHERE text NOT IN ('합계', 'n/a')) AS applied,
  CAST(coalesce(sum(CASE WHEN text NOT IN ('합계', 'n/a') THEN CAST(text AS BIGINT) END), 0) AS BIGINT) AS total FROM x GROUP BY k""")
def q_accounting(spark, d):
    """Rows of a table: totals set aside, values with issues, applied rows and their sum; source = totals + issues + applied."""
    p = F.col("l_partkey") % 20
    text = F.when(p == 0, "합계").when(p == 1, "n/a").otherwise(F.col("l_quantity").cast("long").cast("string"))
    x = v.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), text.alias("text"))
    total = F.col("text").isin("합계", "소계", "총계")
    x = x.select("k", total.alias("total_row"), F.when(~total, amount_of(F.col("text"))).alias("parsed")).select("k", "total_row", F.col("parsed.number").alias("amount"), "parsed.error")
    return x.groupBy("k").agg(
        F.count("*").alias("source"), F.count_if("total_row").alias("totals"), F.count("error").alias("issues"), F.count("amount").alias("applied"), F.coalesce(F.sum("amount"), F.lit(0)).cast("long").alias("total")
    )


@query("c07_format_recognition", """
SELECT page_id, CAST(2 * CAST(contains(html, '<table') AS INTEGER) + 3 * CAST(contains(html, '<article') AS INTEGER) + CAST(contains(html, '<nav') AS INTEGER) AS INTEGER) AS score FROM pages WHERE 2 * CAST(contains(html, '<table') AS INTEGER) + 3 * CAST(contains(html, '<article') AS INTEGER) + CAST(contains(html, '<nav') AS INTEGER) >= 3""")
def q_formats(spark, d):
    """Weighted markers of a format with a least score."""
    score = sum(F.col("html").contains(m).cast("int") * w for m, w in (("<table", 2), ("<article", 3), ("<nav", 1)))
    return v.read(spark, d, "pages").select("page_id", score.alias("score")).filter("score >= 3")


@query("c11_extract_rows", """
SELECT conv_id AS k, max(CASE WHEN role = 'user' THEN length(text) END) AS user_chars, max(CASE WHEN role = 'assistant' THEN length(text) END) AS assistant_chars, count(*) FILTER (WHERE role NOT IN ('user', 'assistant')) AS excluded FROM conversations GROUP BY conv_id""")
def q_extract(spark, d):
    """Cells pivoted to records."""
    x = v.read(spark, d, "conversations").select(F.col("conv_id").alias("k"), "role", F.length("text").alias("chars"))
    n = x.groupBy("k").agg(F.count_if(~F.col("role").isin("user", "assistant")).alias("excluded"))
    p = x.groupBy("k").pivot("role", ["user", "assistant"]).agg(F.max("chars"))
    return p.join(n, "k").select("k", F.col("user").alias("user_chars"), F.col("assistant").alias("assistant_chars"), "excluded")


@query("c14_mapping_inheritance", """
WITH h AS (SELECT conv_id AS doc, turn AS col, role AS text FROM conversations), o AS (SELECT doc, text, min(col) AS old_col FROM h GROUP BY ALL HAVING count(*) = 1), n AS (SELECT doc, text, min(col) AS new_col, count(*) AS c FROM h GROUP BY ALL)
SELECT o.doc, o.text, old_col, CASE WHEN c = 1 THEN new_col END AS new_col, coalesce(c > 1, false) AS blocked FROM o LEFT JOIN n ON n.doc = o.doc + 1 AND n.text = o.text""")
def q_inherit(spark, d):
    """Confirmed columns found again by header text in the next version; several of one text block it."""
    h = v.read(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc"), F.col("role").alias("text")).agg(F.min("turn").alias("col"), F.count("*").alias("c"))
    old = h.filter("c = 1").select("doc", "text", F.col("col").alias("old_col"))
    new = h.select((F.col("doc") - 1).alias("doc"), "text", F.col("col").alias("n"), "c")
    return old.join(new, ["doc", "text"], "left").select("doc", "text", "old_col", F.when(F.col("c") == 1, F.col("n")).alias("new_col"), F.coalesce(F.col("c") > 1, F.lit(False)).alias("blocked"))


@query("a16_merged_hits", """
SELECT l_partkey AS k, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS queries, count(*) AS hits FROM lineitem WHERE l_discount < 0.05 GROUP BY l_partkey""")
def q_hits(spark, d):
    x = v.read(spark, d, "lineitem").filter("l_discount < 0.05")
    return x.groupBy(F.col("l_partkey").alias("k")).agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("queries"), F.count("*").alias("hits"))


@query("a19_a20_upsert", "SELECT o_custkey AS k, max(o_orderkey) AS id, arg_max(o_orderstatus, o_orderkey) AS payload FROM orders GROUP BY o_custkey")
def q_upsert(spark, d):
    """Latest write of each key wins."""
    return v.read(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").alias("id"), F.max_by("o_orderstatus", "o_orderkey").alias("payload"))


@query("a21_content_addresses", "SELECT doc_id, sha256(text) AS address, octet_length(encode(text)) AS bytes FROM documents")
def q_blobs(spark, d):
    return v.read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("address"), F.octet_length("text").cast("long").alias("bytes"))


@query("a23_file_builder", v.with_views("line") + """
SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM (SELECT CASE WHEN received IS NULL THEN 'no date' WHEN amount <= 0 THEN 'not positive' WHEN trade_type IS NULL THEN 'no type' END AS reason FROM v_line) GROUP BY ALL""")
def q_builder(spark, d):
    reason = F.when(F.col("received").isNull(), "no date").when(F.col("amount") <= 0, "not positive").when(F.col("trade_type").isNull(), "no type").otherwise("kept")
    return v.lines(spark, d).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def invariants(invoices: DataFrame, lines: DataFrame, parts: int | None = None) -> DataFrame:
    """(kind, id) of ids that repeat within a table or occur in both; empty for a good snapshot. parts: tasks for them."""
    invoices, lines = (v.dealt(x.select("id"), parts, "id") for x in (invoices, lines))
    twice = lambda df, kind: df.groupBy("id").count().filter("count > 1").select(F.lit(kind).alias("kind"), "id")
    both = invoices.join(lines, "id", "left_semi").distinct().select(F.lit("both").alias("kind"), "id")
    return twice(invoices, "invoice").unionByName(twice(lines, "line")).unionByName(both)


@query("a24_snapshot_invariants", """
SELECT 'line' AS kind, id FROM (SELECT l_orderkey || '-' || l_linenumber AS id FROM lineitem) GROUP BY id HAVING count(*) > 1 UNION ALL
SELECT 'both', id FROM (SELECT DISTINCT o_orderkey || '-1' AS id FROM orders WHERE o_orderkey || '-1' IN (SELECT l_orderkey || '-' || l_linenumber FROM lineitem))""")
def q_invariants(spark, d):
    """On natural keys, which do repeat."""
    i = v.read(spark, d, "orders").select(F.concat("o_orderkey", F.lit("-1")).alias("id"))
    x = v.read(spark, d, "lineitem")
    return invariants(i, x.select(F.concat("l_orderkey", F.lit("-"), "l_linenumber").alias("id")), v.tasks(x.count()))
