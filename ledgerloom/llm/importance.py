"""Importance resampling towards a target distribution, on hashed word n-grams from a streaming CRC ring.

One scan of a document makes all its features' buckets: a ring keeps the running zlib states of the last n starts.
Each word extends every state by a space and the word and starts a state of its own, so a run of k words costs one
CRC step after that of k - 1 words and no n-gram is ever spelled out. The buckets are stored once (two passes read
them: corpus counts, document weights); texts are not read again.

Counts of source and target give each bucket a gain, a scaled log ratio of smoothed frequencies; a document's weight
is the floored mean of its features' gains. Adding Gumbel noise, a hash of the id, and drawing the highest scores is
sampling without replacement in proportion to exp(weight / 1000). Ranks come from a range partitioning of (score, id)
and counts for each partition: no row passes through one task or the driver; only the gains (one number a bucket)
are broadcast.

Nulls and odd values: a null text has no words; a text without words has weight 0 and no features. A null id counts
as the empty text where it is hashed and comes first among equal scores. Repeated rows are each counted, weighed and
ranked; rows of equal score and id follow in an order fixed when the scores are stored. Texts of any length are
scanned whole, in memory of a few bytes a word. An empty table gives an empty result, an empty target gains that
depend on the source alone. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ledgerloom.llm.common import stored, table

#: Words of a feature, buckets, scale of logarithms.
WORDS, BUCKETS, SCALE = 2, 10_000, 1000
#: Documents of fewer words are not drawn; percentage of the others that is; seed of the noise.
LEAST_WORDS, PERCENT, SEED = 20, 25, 7

#: Digits, letters and bytes of other signs stay, A-Z as a-z; every other byte parts words.
_CLEAN = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_CLEAN).split(b" ")


def ring_buckets(raw: bytes, n: int = WORDS, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """Number of words, and the buckets of all runs of 1 to n words, by the words they end with."""
    crc, ring, out, seen = zlib.crc32, [0] * n, array("L"), 0
    for word in words_of(raw):
        if not word:
            continue
        spaced = b" " + word
        for start in range(max(seen - n + 1, 0), seen):
            ring[start % n] = state = crc(spaced, ring[start % n])
            out.append(state)
        ring[seen % n] = state = crc(word)
        out.append(state)
        seen += 1
    return seen, (np.frombuffer(out, dtype=np.uint64) % buckets).astype(np.int32)


def features(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = WORDS, buckets: int = BUCKETS) -> DataFrame:
    """key, n_words, buckets (array<int>, one for each feature) for every row of docs."""

    def scan(batches):
        for batch in batches:
            keys, counts, found = batch.column(0), [], []
            for raw in batch.column(1):
                n_words, ids = ring_buckets((raw.as_py() or b""), n, buckets)
                counts.append(n_words), found.append(ids)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([keys, pa.array(counts, pa.int64()), lists], names=["key", "n_words", "buckets"])

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("binary").alias("raw"))
    return rows.mapInArrow(scan, "key long, n_words long, buckets array<int>").withColumnRenamed("key", key)


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n over all features; each task adds up its own rows first."""

    def count(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten(), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    return found.select("buckets").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS, scale: int = SCALE) -> DataFrame:
    """bucket, gain for every bucket, from bucket_counts of both sides."""
    x = source.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    for side, name in ((source, "s"), (target, "t")):
        x = x.join(F.broadcast(side.withColumnRenamed("n", name)), "bucket", "left").fillna(0, [name])
    x = x.select("bucket", "s", "t", *[F.sum(c).over(W.partitionBy()).alias(f"all_{c}") for c in "st"])  # one row a bucket
    s, t, all_s, all_t = (F.col(c).cast("double") for c in ("s", "t", "all_s", "all_t"))
    return x.select("bucket", F.floor(scale * F.log((t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets)))).cast("long").alias("gain"))


def weigh(found: DataFrame, gains: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_words, n_features, weight: the floored mean of gains over each row's features (none: 0)."""
    rows = gains.collect()  # one number a bucket: the parameter bounds it
    gain = np.zeros(len(rows), dtype=np.int64)
    gain[[r.bucket for r in rows]] = [r.gain for r in rows]
    gain = found.sparkSession.sparkContext.broadcast(gain)

    def mean(batches):
        for batch in batches:
            lists = batch.column(2)
            ends = lists.offsets.to_numpy()
            sums = np.concatenate([[0], np.cumsum(gain.value[lists.values.to_numpy()])])
            size = np.diff(ends).astype(np.int64)
            weight = (sums[ends[1:]] - sums[ends[:-1]]) // np.maximum(size, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size), pa.array(weight)], names=["key", "n_words", "n_features", "weight"])

    rows = found.select(F.col(f"`{key}`").alias("key"), "n_words", "buckets")
    return rows.mapInArrow(mean, "key long, n_words long, n_features long, weight long").withColumnRenamed("key", key)


def gumbel(key: Column, seed: int = SEED, scale: int = SCALE) -> Column:
    """Scaled Gumbel noise, floored, from the first 32 bits of a digest of seed and key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-scale * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, eligible: Column, percent: int = PERCENT, key: str = "doc_id") -> DataFrame:
    """rows(key, score, ...) with rank: the place among eligible rows by (score down, key), null beyond percent % of them."""
    rows = stored(rows.withColumn("_place", F.monotonically_increasing_id()))
    first = [F.col("score").desc(), F.col(key).asc_nulls_first(), F.col("_place")]
    dealt = stored(rows.filter(eligible).repartitionByRange(*first).withColumn("_part", F.spark_partition_id()))
    parts = dealt.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = parts.select("_part", F.coalesce(F.sum("_rows").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    drawn = dealt.count() * percent // 100
    place = F.col("_before") + F.row_number().over(W.partitionBy("_part").orderBy(*first))
    numbered = dealt.join(F.broadcast(before), "_part").withColumn("rank", place.cast("long")).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = rows.filter(~F.coalesce(eligible, F.lit(False))).withColumn("rank", F.lit(None).cast("long"))
    return numbered.drop("_part", "_before", "_place").unionByName(rest.drop("_place"))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_key: str = "item_id", n: int = WORDS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """key, n_words, n_features, weight, score, rank (null: not drawn) for every row of docs; target(target_key, text) is the distribution wanted."""
    found = stored(features(docs, key, text, n, buckets))
    aim = features(target, target_key, text, n, buckets)
    gains = bucket_gains(bucket_counts(found, buckets), bucket_counts(aim, buckets), buckets)
    scored = weigh(found, gains, key).withColumn("score", F.col("weight") + gumbel(F.col(key), seed))
    return ranked(scored, F.col("n_words") >= least_words, percent, key)


def op11(spark, sf_dir):
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


# CRC-32 by its table, made from the polynomial, over the hex digits of a text's bytes
_CRC_TABLE = """SELECT list(c ORDER BY i) AS crcs FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) AS c FROM range(256) r(i)) b"""


def crc_sql(value: str) -> str:
    """DuckDB's expression of the unsigned CRC-32 of a text; the list crcs must be in scope."""
    nibble = "(strpos('0123456789ABCDEF', substr(hex(encode({0})), {1}, 1)) - 1)"
    byte = f"{nibble.format(value, '2 * p + 1')} * 16 + {nibble.format(value, '2 * p + 2')}"
    return f"xor(4294967295, list_reduce(list_transform(range(strlen({value})), lambda p: {byte}), lambda c, b: xor(crcs[(xor(c, b) & 255) + 1], c >> 8), 4294967295))"


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_RUNS = "unnest(words || list_transform(range(1, greatest(len(words), 1)), lambda i: words[i] || ' ' || words[i + 1]))"
OP11_SQL = f"""
WITH crc AS MATERIALIZED ({_CRC_TABLE}),
d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS words FROM documents),
b AS MATERIALIZED (SELECT {_WORDS} AS words FROM benchmark),
df AS MATERIALIZED (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, {_RUNS} AS run FROM d) x GROUP BY ALL),
bf AS MATERIALIZED (SELECT {_RUNS} AS run FROM b),
runs AS MATERIALIZED (SELECT run, {crc_sql("run")} % {BUCKETS} AS bucket FROM (SELECT run FROM df UNION SELECT run FROM bf) x, crc),
s AS (SELECT bucket, sum(n) AS n FROM df JOIN runs USING (run) GROUP BY 1),
t AS (SELECT bucket, count(*) AS n FROM bf JOIN runs USING (run) GROUP BY 1),
gains AS MATERIALIZED (SELECT r.bucket, floor({SCALE} * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s) + {BUCKETS})::DOUBLE
    / ((coalesce(s.n, 0) + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0) + {BUCKETS})::DOUBLE)))::BIGINT AS gain
    FROM (SELECT DISTINCT bucket FROM runs) r LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
w AS (SELECT doc_id, sum(n) AS n_features, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM df JOIN runs USING (run) JOIN gains USING (bucket) GROUP BY 1),
scored AS (SELECT d.doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0) AS weight, len(words) AS n_words,
    coalesce(weight, 0) + floor(-{SCALE} * ln(-ln((('0x' || substr(sha256('{SEED}:' || d.doc_id), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
    FROM d LEFT JOIN w USING (doc_id)),
places AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () * {PERCENT} // 100 AS drawn FROM scored WHERE n_words >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM scored LEFT JOIN places USING (doc_id)
"""
