"""Dropping boilerplate lines by their frequency within a site.

Documents are grouped by host. A line (trimmed of white space, not empty) is boilerplate in a host if at least
``min_pages`` documents of the host contain it and their number divided by the host's documents exceeds ``ratio``.
Boilerplate lines are dropped from the host's documents; the other lines stay as they are, in order.

With ``distinct``, a page is a distinct text of a host: a line counts once for each, and the total is taken alike, so
that exact copies of a page don't make its lines boilerplate.

Counts are over all documents: one row for each distinct line of a document, counted with partial aggregates, so
neither a host nor a line of any frequency is gathered in one task. Lines are known by 64-bit hashes. A host has
fewer than (lines per document) / ratio boilerplate lines, so the result of the count is small; if it is below a
checked size, in all and for each host, it is broadcast and texts don't move, else the lines to drop are brought to
documents by joins.

Nulls and odd values: a null text stays null and counts as a document without lines; a null host is a host of its
own. Repeated rows each count as a document. A text all of whose lines go becomes empty; the row stays. Texts of any
length are read whole. A share equal to the ratio is not above it: the line stays. An empty table gives an empty result. Extra columns
stay as they are, whatever their names and types, but lines_dropped and chars_dropped are those of this run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import BROADCAST_ROWS, SPACE, cut, row_digest, small, table, whole_row

#: A line is boilerplate if more than this share of its host's documents, and at least so many, contain it.
RATIO, MIN_PAGES = 0.05, 3
#: Most lines of one host that are looked up in each of its rows; with more, lines are joined.
HOST_LINES = 2_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _hash(line: Column) -> Column:
    """Null for lines of white space alone."""
    bare = F.regexp_replace(line, f"^[{SPACE}]+|[{SPACE}]+$", "")
    return F.when(bare != "", F.xxhash64(bare))


def boilerplate(docs: DataFrame, host: str, ratio=RATIO, min_pages=MIN_PAGES, distinct=False) -> DataFrame:
    """(host_key, hashes): the hashes of each host's boilerplate lines."""
    key = F.struct(F.col(host).alias("host")).alias("host_key")  # a struct, so that null equals null
    digest = [F.struct(F.xxhash64("text"), F.xxhash64(F.lit(1), "text")).alias("digest")] if distinct else []
    pages, lines = docs.select(key, *digest), docs.select(key, *digest, F.explode(F.array_distinct(F.transform(_lines("text"), _hash))).alias("line")).filter("line IS NOT NULL")
    if distinct:
        pages, lines = pages.distinct(), lines.distinct()
    pages = cut(pages.groupBy("host_key").agg(F.count("*").alias("pages")))
    counted = lines.groupBy("host_key", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    return counted.join(small(pages), "host_key").filter(F.col("n") > F.col("pages") * ratio).select("host_key", "line")


def drop_boilerplate(docs: DataFrame, host="source", ratio=RATIO, min_pages=MIN_PAGES, distinct=False) -> DataFrame:
    """docs with cleaned text, and columns lines_dropped, chars_dropped (in place of columns of these names)."""
    text, rows = F.col("row.text"), docs.select(whole_row(docs).alias("row"), F.struct(F.col(host).alias("host")).alias("host_key"), row_digest(docs).alias("at"))
    found = cut(boilerplate(docs, host, ratio, min_pages, distinct))
    hashes = F.array_compact(F.array_distinct(F.transform(_lines(text), _hash)))
    by_host = found.groupBy("host_key").agg(F.count("*").alias("n"))
    if found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS and by_host.filter(F.col("n") > HOST_LINES).isEmpty():
        by_host = found.groupBy("host_key").agg(F.collect_list("line").alias("known"))
        marked = rows.join(F.broadcast(by_host), "host_key", "left").withColumn("dropped", F.array_intersect(hashes, "known"))
        marked = marked.withColumn("dropped", F.when(F.size("dropped") > 0, F.col("dropped")))
    else:  # each row's own lines to drop, by a digest of the row
        lines = rows.select("at", "host_key", F.explode(hashes).alias("line"))
        drops = lines.join(found, ["host_key", "line"], "left_semi").groupBy("at").agg(F.collect_set("line").alias("dropped"))
        marked = rows.join(drops, "at", "left")
    kept = F.filter(_lines(text), lambda x: ~F.coalesce(F.array_contains("dropped", _hash(x)), F.lit(False)))
    new = marked.select("row", F.when(F.col("dropped").isNull(), text).otherwise(F.array_join(kept, "\n")).alias("clean"), F.col("dropped").isNotNull().alias("hit"), F.size(kept).alias("left"))
    gone = F.when(~F.col("hit") | text.isNull(), 0).otherwise(F.size(_lines(text)) - F.col("left")).cast("long")
    chars = F.coalesce(F.length(text) - F.length("clean"), F.lit(0)).cast("long")
    others = [F.col(f"row.`{c}`").alias(c) if c != "text" else F.col("clean").alias(c) for c in docs.columns if c not in ("lines_dropped", "chars_dropped")]
    return new.select(*others, gone.alias("lines_dropped"), chars.alias("chars_dropped"))


def op10(spark, sf_dir):
    return drop_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "source", "text", "lines_dropped", "chars_dropped")


OP10_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text FROM documents),
lines AS (SELECT r, source, i, line, regexp_replace(line, '^[ \x09-\x0D]+|[ \x09-\x0D]+$', '', 'g') AS bare
  FROM (SELECT r, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d)),
counted AS (SELECT source, bare, count(DISTINCT r) AS n FROM lines WHERE bare <> '' GROUP BY ALL),
pages AS (SELECT source, count(*) AS pages FROM d GROUP BY ALL),
bad AS (SELECT c.source, bare FROM counted c JOIN pages p ON c.source IS NOT DISTINCT FROM p.source
  WHERE n >= {MIN_PAGES} AND n > pages * {RATIO}::DOUBLE),
kept AS (SELECT l.r, count(*) FILTER (WHERE b.bare IS NOT NULL) AS gone,
    string_agg(line, chr(10) ORDER BY i) FILTER (WHERE b.bare IS NULL) AS text
  FROM lines l LEFT JOIN bad b ON l.source IS NOT DISTINCT FROM b.source AND l.bare = b.bare GROUP BY l.r)
SELECT d.doc_id, d.source, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
  coalesce(gone, 0) AS lines_dropped, coalesce(length(d.text) - length(coalesce(kept.text, '')), 0) AS chars_dropped
FROM d LEFT JOIN kept USING (r)
"""
