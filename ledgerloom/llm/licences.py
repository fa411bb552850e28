"""Licence scan by canonical digests of entire texts.

A text is brought to a canonical form: A-Z lower case; copyright lines and "all rights reserved" removed;
equivalent spellings made one; every run of characters that are neither letters nor digits becomes one space. Its
SHA-256 is joined (hash join) with the digests of known licence texts, made by the same expression, so an entire
text that differs from a known one in case, punctuation, line breaks, copyright holders or spelling still matches.
The known texts are a parameter of bounded size, so their digests are broadcast; the documents don't move.

Nulls and odd values: a null text counts as empty; the empty canonical text is no licence. Repeated rows each give
a row. Two known texts with one canonical form give the smaller name. Texts of any length are read whole. An empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import ascii_lower, table
from ledgerloom.llm.licence_texts import KNOWN

#: A line that begins with a copyright sign, or with the word and a sign, year or place holder.
COPYRIGHT = r"(^|\n)[^\p{L}\p{N}\n(©]*(?:©|\(c\)|copyright[ \t]*(?:\(c\)|©|:|,|[0-9]{4}|[<\[{]))[^\n]*"
#: Equivalent spellings, written as words of the canonical form.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"), ("sublicence", "sublicense"),
    ("non infringement", "noninfringement"), ("merchantibility", "merchantability"), ("organisation", "organization"),
    ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("behaviour", "behavior"), ("https", "http"), ("per cent", "percent"),
)


def canonical(text: Column) -> Column:
    x = ascii_lower(F.coalesce(text, F.lit("")))
    x = F.regexp_replace(x, COPYRIGHT, "\n")
    x = F.regexp_replace(x, r"[^\p{L}\p{N}]+", " ")
    x = F.replace(F.concat(F.lit(" "), x, F.lit(" ")), F.lit(" all rights reserved "), F.lit(" "))
    for a, b in SPELLINGS:
        x = F.replace(x, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(F.regexp_replace(x, " +", " "))


def known_digests(spark, known=KNOWN) -> DataFrame:
    texts = spark.createDataFrame(list(known), "licence string, text string")
    return texts.select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "licence").groupBy("digest").agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, known=KNOWN) -> DataFrame:
    """doc_id, n_canonical (characters), digest, licence (null: none known) for every row of docs(doc_id, text)."""
    x = docs.select("doc_id", canonical(F.col("text")).alias("canonical"))
    x = x.select("doc_id", F.length("canonical").cast("long").alias("n_canonical"), F.sha2("canonical", 256).alias("digest"))
    return x.join(F.broadcast(known_digests(docs.sparkSession, known)), "digest", "left").select("doc_id", "n_canonical", "digest", F.when(F.col("n_canonical") > 0, F.col("licence")).alias("licence"))


def op2(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))


def _sql(text: str) -> str:
    x = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    x = f"regexp_replace({x}, '{COPYRIGHT}', chr(10), 'g')"
    x = f"regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')"
    x = f"replace(' ' || {x} || ' ', ' all rights reserved ', ' ')"
    for a, b in SPELLINGS:
        x = f"replace({x}, ' {a} ', ' {b} ')"
    return f"trim(regexp_replace({x}, ' +', ' ', 'g'))"


_TEXTS = ", ".join("('{}', '{}')".format(n.replace("'", "''"), t.replace("'", "''")) for n, t in KNOWN)
OP2_SQL = f"""
WITH known AS (SELECT sha256({_sql("text")}) AS digest, min(licence) AS licence FROM (VALUES {_TEXTS}) k(licence, text) GROUP BY 1),
d AS (SELECT doc_id, {_sql("text")} AS canonical FROM documents)
SELECT doc_id, length(canonical) AS n_canonical, sha256(canonical) AS digest, CASE WHEN canonical <> '' THEN licence END AS licence
FROM d LEFT JOIN known ON sha256(canonical) = known.digest
"""
