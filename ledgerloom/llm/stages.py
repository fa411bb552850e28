"""Pipeline stages: each applies one operator to the documents that its predecessor kept.

A stage takes (spark, docs, sf_dir); all but the last return the columns of docs. Whole rows travel as one struct, so
extra columns of any name and type stay as they are. Null texts are empty documents: the scorer accepts them, they hold no
lines, are in no class and have size 0, so the mix takes none of them. Repeated rows are scored and cleaned alike, of a
class one stays, and the mix takes equal rows equally often. Ties are told in each stage. Empty tables stay empty."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import line_dedup, mixing, ngram_join, pieces, toxicity
from ledgerloom.llm.common import row_digest, small, stored, table, whole_row

#: Repeated lines lie above this share of a host's pages, body lines below it (README); line_dedup.RATIO is that of op10.
LINE_RATIO = 0.01
#: States and characters that the last stage holds in memory at once.
STATES, CHARS = 400_000, 300_000


def _rows(docs: DataFrame, *names: str) -> DataFrame:
    return docs.select(whole_row(docs).alias("_row"), *names)


def drop_toxic(spark, docs, sf_dir):
    """Documents that the toxicity scorer accepts; it learns from the labels of documents that are left to this stage."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return model.score(_rows(docs, "text")).filter("predicted = 0").select("_row.*")


def drop_boilerplate_lines(spark, docs, sf_dir):
    """Every document, without its site's boilerplate lines; n_chars follows the text."""
    out = line_dedup.drop_boilerplate(_rows(docs, "source", "text"), ratio=LINE_RATIO, distinct=True)
    changed = out["lines_dropped"] > 0
    text = F.when(changed, F.col("text")).otherwise(F.col("_row.text"))
    chars = F.when(changed, F.length("text").cast("long")).otherwise(F.col("_row.n_chars"))
    new = {"text": text, "n_chars": chars}
    return out.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def keep_one_of_a_class(spark, docs, sf_dir):
    """One row of each near-duplicate class, the one of least doc_id (rows without one last; ties by the row's digest),
    and every row without words. Of rows that are equal in all columns only one is in a class."""
    rows = docs.select(whole_row(docs).alias("_row"), "doc_id", "text", row_digest(docs).alias("_key"))
    found = stored(ngram_join.classes(rows, carry=["_key"]).filter("class IS NOT NULL").select("class", "doc_id", "_key"))
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "_key")
    chosen = found.groupBy("class").agg(F.min(first).alias("f"), F.count("*").alias("rows")).filter("rows > 1").select("class", F.col("f._key").alias("_first"))
    members = stored(found.join(small(chosen), "class").select("_key", "_first"))
    out = rows.join(small(members.filter("_key <> _first").select("_key").distinct()), "_key", "left_anti")
    # equal rows share a key: where a class has more rows than one, those of its key may be several
    repeated = stored(members.filter("_key = _first").groupBy("_key").agg(F.count("*").alias("c")).filter("c > 1").select("_key"))
    if not repeated.isEmpty():
        one = out.join(small(repeated), "_key", "left_semi").dropDuplicates(["_key"])
        out = out.join(small(repeated), "_key", "left_anti").unionByName(one)
    return out.select("_row.*")


def mix_sources(spark, docs, sf_dir):
    """Each row as many times as the mix takes it; only numbers of sources are joined to rows."""
    taken = mixing.repeated(docs.select(whole_row(docs).alias("_row"), "doc_id", "text", "source"), "_row").filter("copies > 0")
    return taken.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_copy")).select("_row.*")


def encode_pieces(spark, docs, sf_dir):
    """Sampled segmentations of every document. Python processes of earlier stages may live on beside this one's, so it
    remembers fewer units and takes fewer characters at once than the operator does alone; the results are the same."""
    return pieces.segmentations(docs, states=STATES, chars_at_once=CHARS, keep=False)
