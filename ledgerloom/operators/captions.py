"""Captions and images of a document's lines: each image with the caption before it, else after it, else that of the image it continues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ledgerloom.plans import ledger as v
from ledgerloom.registry import query

#: Unit lines that may stand between a caption and its image.
UNITS = 2


def pair_captions(elements: DataFrame) -> DataFrame:
    """(doc, pos, caption, place) of every image of elements(doc, pos, kind): kind is caption, image, unit or another, pos orders
    a document's lines (blank ones left out) and tells them apart.

    A caption belongs to the next image if nothing but UNITS unit lines at most lie between; else to an image directly before
    it that has none. An image without one directly after another image continues that one and has its caption, if any."""
    here = W.partitionBy("doc").orderBy("pos")
    unit = F.col("kind") == "unit"
    solid = lambda ahead: (F.first if ahead else F.last)(F.when(~unit, F.struct("kind", "pos", "units")), ignorenulls=True)
    x = elements.withColumn("units", F.sum(unit.cast("int")).over(here))
    x = x.withColumn("back", solid(False).over(here.rowsBetween(W.unboundedPreceding, -1))).withColumn("ahead", solid(True).over(here.rowsBetween(1, W.unboundedFollowing)))
    before = (F.col("kind") == "image") & (F.col("back.kind") == "caption") & (F.col("units") - F.col("back.units") <= UNITS)
    used = (F.col("kind") == "caption") & (F.col("ahead.kind") == "image") & (F.col("ahead.units") - F.col("units") <= UNITS)
    x = x.withColumn("before", F.coalesce(before, F.lit(False))).withColumn("used", F.coalesce(used, F.lit(False)))
    step = lambda f, c: f(c).over(here)
    after = ~F.col("before") & (step(F.lead, "kind") == "caption") & ~step(F.lead, "used")
    own = F.when(F.col("before"), F.col("back.pos")).when(after, step(F.lead, "pos"))
    x = x.select("doc", "pos", "kind", "before", own.alias("own"), (step(F.lag, "kind") == "image").alias("follows")).filter("kind = 'image'")
    run = x.withColumn("run", F.sum(F.when(F.col("follows"), 0).otherwise(1)).over(here))
    caption = F.last("own", ignorenulls=True).over(W.partitionBy("doc", "run").orderBy("pos"))
    place = F.when(F.col("before"), "before").when(F.col("own").isNotNull(), "after").when(F.col("follows"), "continued").otherwise("none")
    return run.select("doc", "pos", caption.alias("caption"), place.alias("place"))


@query("i04_caption_pairs", f"""
WITH l AS (SELECT doc_id AS doc, i AS pos, length(p) % 7 AS r FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(p) <> ''),
e AS MATERIALIZED (SELECT doc, pos, CASE r WHEN 0 THEN 'caption' WHEN 1 THEN 'image' WHEN 2 THEN 'image' WHEN 3 THEN 'unit' ELSE 'text' END AS kind, row_number() OVER (PARTITION BY doc ORDER BY pos) AS n FROM l),
s AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY n) AS k FROM e WHERE kind <> 'unit'),
first AS MATERIALIZED (SELECT i.doc, i.pos AS image, c.pos AS caption FROM s i JOIN s c ON c.doc = i.doc AND c.k = i.k - 1 WHERE i.kind = 'image' AND c.kind = 'caption' AND i.n - c.n - 1 <= {UNITS}),
second AS MATERIALIZED (SELECT i.doc, i.pos AS image, c.pos AS caption FROM e i JOIN e c ON c.doc = i.doc AND c.n = i.n + 1 WHERE i.kind = 'image' AND c.kind = 'caption'
  AND (i.doc, i.pos) NOT IN (SELECT doc, image FROM first) AND (c.doc, c.pos) NOT IN (SELECT doc, caption FROM first)),
own AS (SELECT e.doc, e.pos, e.n, first.caption AS a, second.caption AS b, p.kind IS NOT DISTINCT FROM 'image' AS follows FROM e LEFT JOIN first ON first.doc = e.doc AND first.image = e.pos LEFT JOIN second ON second.doc = e.doc AND second.image = e.pos
  LEFT JOIN e p ON p.doc = e.doc AND p.n = e.n - 1 WHERE e.kind = 'image'),
runs AS (SELECT *, n - row_number() OVER (PARTITION BY doc ORDER BY n) AS run FROM own)
SELECT doc, pos, last_value(coalesce(a, b) IGNORE NULLS) OVER (PARTITION BY doc, run ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS caption,
  CASE WHEN a IS NOT NULL THEN 'before' WHEN b IS NOT NULL THEN 'after' WHEN follows THEN 'continued' ELSE 'none' END AS place FROM runs""")
def q_captions(spark, d):
    """Lines of documents; their length says what they stand for."""
    x = v.read(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n", -1)).alias("p", "line")).filter("trim(line) <> ''")
    r = F.length("line") % 7
    kind = F.when(r == 0, "caption").when(r.isin(1, 2), "image").when(r == 3, "unit").otherwise("text")
    return pair_captions(x.select("doc", (F.col("p") + 1).cast("long").alias("pos"), kind.alias("kind")))
