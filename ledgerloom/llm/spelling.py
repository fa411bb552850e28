"""Spelling variants by letter-parity bitmasks in three bands.

A word's mask has a bit for each letter that it holds an odd number of times. One inserted, deleted or replaced letter
flips at most two bits, so of the mask's three bands at least one is the same in both words. Words meet in an
equi-join on an equal band, with lengths that differ by one at most, and are then verified by their edit distance.

A band alone would bring a fixed share of all pairs of words together. So the key holds, beside band and length, the
word without one of SEGMENTS parts: one edit lies in one part (counted from the left before it, from the right
after it) and leaves the others as they are. Only words that agree in all but one part and in a band ever meet;
no link is lost. A pair is kept where its first common key is, so no pair is seen twice.

Counts come before the join: occurrences are added up within each task, then by word. The chain from a word to its root
doubles its stride with each round; each form occurs at least RATIO times as often as its word, so there are few.

Nulls and odd values: a null text has no words; a null id counts as the empty text where it is hashed. Repeated rows
are counted each. Words at equal counts: the first in code-point order is the form. Texts of any length are read whole.
An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import ascii_lower, small, stored, table

#: Least code points of a word, least occurrences, and how much more frequent a form is.
LETTERS, LEAST, RATIO = 7, 2, 10
#: One of so many hashed (id, run) pairs loses a code point.
NOISE = 31
#: Bands of the mask, and parts of a word of which one may differ.
BANDS, SEGMENTS = 3, 4


def noisy_words(docs: DataFrame, key: str = "doc_id", text: str = "text", letters: int = LETTERS, noise: int = NOISE) -> DataFrame:
    """One row a word: each run of at least ``letters`` letters, A-Z in lower case, without one code point where the hash says so."""
    runs = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{letters},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("key"), F.explode(runs).alias("run"))
    rows = rows.select("key", ascii_lower(F.col("run")).alias("run"))
    rows = rows.select("run", F.crc32(F.concat("key", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = rows.select(F.when(F.col("h") % noise == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= letters)


def word_counts(words: DataFrame, least: int = LEAST) -> DataFrame:
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def _bands(word: Column) -> list[Column]:
    """The mask's bands, each a long: letter x has bit x // BANDS of band x % BANDS."""
    letters = F.transform(F.split(word, ""), lambda c: F.when(F.ascii(c) < 128, F.ascii(c) - 97).otherwise(F.ascii(c) - 166))

    def band(i: int) -> Column:
        bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.floor(x / BANDS).cast("int"))
        return F.aggregate(letters, F.lit(0).cast("long"), lambda mask, x: F.when(x % BANDS == i, mask.bitwiseXOR(bit(x))).otherwise(mask))

    return [band(i) for i in range(BANDS)]


def _cut(size: Column, j) -> Column:
    return F.floor(size * j / SEGMENTS).cast("int")


def _without(word: str, size: Column, extra, j: int) -> Column:
    """word(of size + extra letters) without part j, as two strings around a sign that no word has."""
    return F.concat(F.substr(word, F.lit(1), _cut(size, j)), F.lit("|"), F.substr(word, _cut(size, j + 1) + 1 + extra))


def _postings(words: DataFrame, extra: int) -> DataFrame:
    """word, n, all bands but the last, and one key for each part and band (slot); extra: as the longer word of a pair by so many letters."""
    size = F.length("word") - extra
    keys = [
        F.struct(F.lit(j * BANDS + i).cast("byte").alias("slot"), F.xxhash64(F.lit(j * BANDS + i), size, F.col(f"b{i}"), _without("word", size, extra, j)).alias("key"))
        for j in range(SEGMENTS) for i in range(BANDS)
    ]
    return words.select("word", "n", *[f"b{i}" for i in range(BANDS - 1)], F.explode(F.array(*keys)).alias("k")).select("*", "k.slot", "k.key").drop("k")


def _meet(a: DataFrame, b: DataFrame) -> DataFrame:
    """word, n, near, near_n for pairs that share a key; the word is the shorter, or the first of two equally long."""
    b = b.select(*[F.col(c).alias(f"{c}_") for c in b.columns])
    size = F.length("word")
    extra = F.length("word_") - size
    part, at = F.floor(F.col("slot") / BANDS), F.col("slot") % BANDS
    earlier = F.lit(False)  # an earlier part or band that agrees, too
    for j in range(SEGMENTS - 1):
        earlier |= (part > j) & (_without("word", size, 0, j) == _without("word_", size, extra, j))
    for i in range(BANDS - 1):
        earlier |= (at > i) & (F.col(f"b{i}") == F.col(f"b{i}_"))
    on = (F.col("key") == F.col("key_")) & (F.col("slot") == F.col("slot_")) & ((extra == 1) | ((extra == 0) & (F.col("word") < F.col("word_"))))
    return a.join(b, on & (F.levenshtein("word", "word_", 1) == 1) & ~earlier).select("word", "n", F.col("word_").alias("near"), F.col("n_").alias("near_n"))


def near_pairs(words: DataFrame) -> DataFrame:
    """word, n, near, near_n: every pair of words(word, n) that one edit parts, once in each direction."""
    banded = words.select("word", "n", *[b.alias(f"b{i}") for i, b in enumerate(_bands(F.col("word")))])
    shorter = _postings(banded, 0)
    pairs = _meet(shorter, shorter.unionByName(_postings(banded, 1)))
    both = F.explode(F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))))
    return pairs.select(both.alias("p")).select("p.*")


def roots(forms: DataFrame) -> DataFrame:
    """word, root for forms(word, form): the end of each word's chain."""
    found = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        further = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(found.join(small(further), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        found = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return found


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of words(word, n), whose words differ."""
    words = stored(words)
    best = F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best")
    stats = near_pairs(words).groupBy("word").agg(F.first("n").alias("n"), F.count("*").alias("n_near"), best)
    fits = -F.col("best.m") >= F.col("n") * ratio
    stats = stored(stats.select("word", "n_near", F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.m")).alias("form_n")))
    forms = stats.filter("form IS NOT NULL")
    out = words.join(stats, "word", "left").join(small(roots(forms)), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def op13(spark, sf_dir):
    return variants(word_counts(noisy_words(table(spark, sf_dir, "documents"))))


def _op13_sql() -> str:
    """Counts by a CRC in SQL; near words by what is left of them without one letter, not by masks."""
    from ledgerloom.llm.importance import _CRC_TABLE, crc_sql

    return f"""
WITH RECURSIVE crc AS MATERIALIZED ({_CRC_TABLE}),
runs AS MATERIALIZED (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS c
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) x WHERE length(run) >= {LETTERS} GROUP BY 1, 2),
hashed AS (SELECT run, c, {crc_sql("(doc_id || ':' || run)")} AS h FROM runs, crc),
noisy AS (SELECT CASE WHEN h % {NOISE} = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, c FROM hashed),
words AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM noisy WHERE length(word) >= {LETTERS} GROUP BY 1 HAVING sum(c) >= {LEAST}),
cuts AS MATERIALIZED (SELECT word, p, left(word, p - 1) AS a, substr(word, p + 1) AS b FROM (SELECT word, unnest(range(1, length(word) + 1)) AS p FROM words) x),
pairs AS (SELECT x.word, y.word AS near FROM cuts x JOIN cuts y ON x.p = y.p AND x.a = y.a AND x.b = y.b AND x.word <> y.word
    UNION SELECT c.word, w.word FROM cuts c JOIN words w ON c.a || c.b = w.word UNION SELECT w.word, c.word FROM cuts c JOIN words w ON c.a || c.b = w.word),
best AS (SELECT pairs.word, count(*) AS n_near, min({{'m': -y.n, 'w': near}}) AS b FROM pairs JOIN words y ON y.word = near GROUP BY 1),
forms AS MATERIALIZED (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.m >= {RATIO} * n THEN b.w END AS form, CASE WHEN -b.m >= {RATIO} * n THEN -b.m END AS form_n
    FROM words w LEFT JOIN best USING (word)),
steps AS (SELECT word, word AS root, form AS next FROM forms UNION ALL SELECT s.word, s.next, f.form FROM steps s JOIN forms f ON f.word = s.next)
SELECT f.word, f.form, s.root, f.n, f.n_near, f.form_n FROM forms f JOIN steps s ON s.word = f.word AND s.next IS NULL
"""


OP13_SQL = _op13_sql()
