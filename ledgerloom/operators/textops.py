"""Text extraction and search: paragraphs with offsets, citations, snippets, filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions.values import VERDICT_WORDS
from ledgerloom.plans import ledger as v
from ledgerloom.registry import query


#: Lines whose offsets are added up at once.
BLOCK = 256


def _squeeze(x):
    return F.trim(F.regexp_replace(x, r"\s+", " "))


@query("d19_citations", """
SELECT item_id, count(d.doc_id) AS documents, min(d.doc_id) AS first FROM benchmark b LEFT JOIN documents d ON trim(regexp_replace(b.text, '\\s+', ' ', 'g')) <> '' AND contains(trim(regexp_replace(d.text, '\\s+', ' ', 'g')), trim(regexp_replace(b.text, '\\s+', ' ', 'g'))) GROUP BY item_id""")
def citations(spark, d):
    """Passages that occur in documents, white space apart.

    Of a passage of seven words or more the second to sixth are whole words wherever it occurs: documents and passages meet on a
    hash of five words, then the whole passage is looked for. Only shorter ones are looked for in every document."""
    b = v.read(spark, d, "benchmark").select("item_id", _squeeze(F.col("text")).alias("passage"))
    docs = v.read(spark, d, "documents").select("doc_id", _squeeze(F.col("text")).alias("body"))
    five = lambda words, at: F.xxhash64(F.slice(words, at, 5))
    words = F.split("passage", " ")
    long = b.filter((F.size(words) >= 7)).withColumn("key", five(words, F.lit(2)))
    short = b.filter((F.col("passage") != "") & (F.size(words) < 7))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - 4, F.lit(1))), lambda at: five(F.col("words"), at))
    keyed = docs.withColumn("words", F.split("body", " ")).select("doc_id", F.explode(F.array_distinct(grams)).alias("key"))
    met = keyed.join(long.select("item_id", "key", "passage"), "key").select("doc_id", "item_id", "passage").distinct()
    found = met.join(docs, "doc_id").filter(F.col("body").contains(F.col("passage"))).select("item_id", "doc_id")
    if not short.isEmpty():  # passages are a parameter; with many short ones they are worth a shuffle
        few = F.broadcast(short) if short.count() <= 20_000 else short
        found = found.unionByName(docs.join(few, F.col("body").contains(F.col("passage"))).select("item_id", "doc_id"))
    hits = found.groupBy("item_id").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first"))
    return b.select("item_id").join(hits, "item_id", "left").select("item_id", F.coalesce("documents", F.lit(0)).alias("documents"), "first")


@query("i01_paragraphs", """
SELECT doc_id, i - 1 AS no, length(p) AS chars, CAST(coalesce(sum(length(p) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)""")
def paragraphs(spark, d):
    """Lines as paragraphs with offsets, found within each row: no shuffle. Offsets add up by blocks of BLOCK lines, so no array
    is copied more often than there are blocks or lines in one."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("parts") - 1) / BLOCK).cast("int")), lambda b: F.slice("parts", b * BLOCK + 1, BLOCK))
    size = lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda n, p: n + F.length(p) + 1)
    starts = F.aggregate(F.transform("blocks", size), F.array(F.lit(0).cast("long")), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    none = F.struct(F.col("start").alias("at"), F.array().cast("array<struct<start:long,chars:int>>").alias("out"))
    add = lambda a, p: F.struct((a["at"] + F.length(p) + 1).alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].alias("start"), F.length(p).alias("chars")))).alias("out"))
    x = v.read(spark, d, "documents").select("doc_id", F.split("text", "\n", -1).alias("parts")).select("doc_id", blocks.alias("blocks"))
    x = x.select("doc_id", "blocks", starts.alias("starts")).select("doc_id", F.posexplode("blocks").alias("b", "block"), "starts")
    x = x.select("doc_id", "b", "block", F.get("starts", F.col("b")).alias("start"))
    x = x.select("doc_id", "b", F.posexplode(F.aggregate("block", none, add)["out"]).alias("i", "p"))
    return x.select("doc_id", (F.col("b") * BLOCK + F.col("i")).alias("no"), F.col("p.chars").alias("chars"), F.col("p.start").alias("start"))


@query("i02_i06_fact_extraction", r"""
SELECT doc_id, CAST(len(regexp_extract_all(text, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}')) AS INTEGER) AS addresses, nullif(regexp_extract(text, '(?:Released|Licensed|licensed) under the ([A-Za-z ]+)', 1), '') AS terms,
  TRY_CAST(nullif(regexp_extract(text, '[Vv]ersion ([0-9]+)', 1), '') AS INTEGER) AS version FROM documents""")
def facts(spark, d):
    """Typed facts by pattern: counts, wording, numbers or null."""
    t = F.col("text")
    terms = F.nullif(F.regexp_extract(t, r"(?:Released|Licensed|licensed) under the ([A-Za-z ]+)", 1), F.lit(""))
    return v.read(spark, d, "documents").select("doc_id", F.regexp_count(t, F.lit(r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}")).alias("addresses"), terms.alias("terms"), F.nullif(F.regexp_extract(t, "[Vv]ersion ([0-9]+)", 1), F.lit("")).try_cast("int").alias("version"))


@query("i03_i05_i07_text_filters", r"""
SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)license') AND regexp_matches(text, '(?i)version') THEN 2 WHEN regexp_matches(text, '(?i)license|token') THEN 1 ELSE 0 END AS score,
  CASE WHEN contains(text, 'Apache') THEN 'apache' WHEN contains(text, 'MIT') THEN 'mit' WHEN contains(text, 'GNU') THEN 'gnu' END AS kind FROM documents""")
def filters(spark, d):
    t = F.col("text")
    score = F.when(t.rlike("(?i)license") & t.rlike("(?i)version"), 2).when(t.rlike("(?i)license|token"), 1).otherwise(0)
    kind = F.when(t.contains("Apache"), "apache").when(t.contains("MIT"), "mit").when(t.contains("GNU"), "gnu")
    return v.read(spark, d, "documents").select("doc_id", score.alias("score"), kind.alias("kind"))


@query("i08_search", "SELECT doc_id, instr(lower(text), 'token') AS first, CAST(least(3, len(string_split(lower(text), 'token')) - 1) AS INTEGER) AS hits, substr(text, greatest(1, instr(lower(text), 'token') - 10), 25) AS snippet FROM documents WHERE contains(lower(text), 'token')")
def search(spark, d):
    """Documents with a term, at most three hits counted, and the first snippet."""
    low, term = F.lower("text"), "token"
    x = v.read(spark, d, "documents").filter(low.contains(term)).withColumn("first", F.instr(F.lower("text"), term))
    hits = F.least(F.lit(3), F.size(F.split(F.lower("text"), term, -1)) - 1)
    return x.select("doc_id", "first", hits.alias("hits"), F.substring(F.col("text"), F.greatest(F.lit(1), F.col("first") - 10), F.lit(25)).alias("snippet"))


@query("i09_known_on", "SELECT event_id AS k, CAST(ts + INTERVAL 9 HOUR AS DATE) AS day FROM events WHERE CAST(ts + INTERVAL 9 HOUR AS DATE) <= DATE '2024-01-10'")
def known_on(spark, d):
    """Rows recorded on or before a day in Seoul."""
    day = F.to_date(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Asia/Seoul"))
    return v.read(spark, d, "events").select(F.col("event_id").alias("k"), day.alias("day")).filter(F.col("day") <= F.lit("2024-01-10").cast("date"))


@query("i10_span_page", "SELECT conv_id, turn, length(text) AS chars FROM conversations WHERE role = 'assistant' AND (conv_id > 5 OR (conv_id = 5 AND turn > 1)) ORDER BY conv_id, turn LIMIT 21")
def span_page(spark, d):
    x = v.read(spark, d, "conversations").filter("role = 'assistant' AND (conv_id > 5 OR (conv_id = 5 AND turn > 1))")
    return x.orderBy("conv_id", "turn").limit(21).select("conv_id", "turn", F.length("text").alias("chars"))


@query("f27_f34_wording_and_numbers", r"""
SELECT doc_id, len(list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: length(x) > 2 AND NOT contains(CAST(n_chars AS VARCHAR), x))) = 0 AS numbers_ok,
  NOT (""" + " OR ".join(f"contains(text, '{w}')" for w in VERDICT_WORDS) + """) AS wording_ok FROM documents""")
def wording(spark, d):
    """Numbers of a text that aren't among the engine's, and phrases that would state a verdict."""
    other = F.filter(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)), lambda x: (F.length(x) > 2) & ~F.col("n_chars").cast("string").contains(x))
    verdict = F.lit(False)
    for w in VERDICT_WORDS:
        verdict = verdict | F.col("text").contains(w)
    return v.read(spark, d, "documents").select("doc_id", (F.size(other) == 0).alias("numbers_ok"), (~verdict).alias("wording_ok"))
