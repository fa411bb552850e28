"""Toxicity scores: gradient-boosted trees over dense text features, with isotonic calibration.

Features of a text (its own words only; never labels, language, source or id): densities of a fixed and of a learned
lexicon, hits close to second-person words, rates of capitals, punctuation, exclamation, digits, single letters, and of
lexicon words that appear only after undoing obfuscation (``1d10t``, ``$tupid``).

Labelled rows may be learned from if crc32(id as text) mod 5 is not 0. Of these at most ``LABELLED`` rows (a
documented bound; the first by a hash of the id) are used, in three disjoint parts by that hash: words and beginnings of
words that stand in toxic documents significantly more often (log-likelihood ratio, copies of a text counted once) make
the learned lexicon (at most ``WORDS``, weighted by their log odds), trees are fitted by Spark ML on the second part, and isotonic regression maps their probabilities to scores on the third. Scoring covers every row and
is one pass without a shuffle. The score is 99.9 % the calibrated one and 0.1 % the trees', so that it ranks ties.

Nulls and odd values: a null text counts as empty; empty texts get a score too. A null label is no label; several
labels of an id count as toxic if any is. Without labels of both kinds every score is the share of toxic labels
(0 without any). Repeated rows each give a row with equal scores. Texts of any length are read whole, one at a time. An empty
table gives an empty result. Extra columns stay as they are, but for score and predicted and names with a leading underscore
that the scorer uses itself (_features, _raw, _probability, _class, _p, _calibrated): pass such rows as one struct.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import give_back, stored, table

LABELLED, WORDS, LEAST_G = 20_000, 200, 25.0
#: Lengths, in bytes, of the beginnings of words in the learned lexicon; distinct words that a task remembers.
STEMS, REMEMBERED = (4, 5, 6, 7), 100_000
TREES, DEPTH = 20, 3
NEAR = 3

#: Common insults, and second-person words, in four languages.
INSULTS = """idiot idiots moron morons stupid dumb fool loser trash garbage scum pathetic worthless disgusting clown
pig filth vermin jerk imbecile cretin dumbass bastard bitch asshole shit fuck fucking crap retard freak ugly hate kill
dummkopf trottel arschloch schwein depp vollidiot abschaum dreck wertlos
imbécile crétin connard salaud ordure merde débile minable abruti
imbécil estúpido basura escoria inútil cabrón mierda payaso asqueroso""".split()
SECOND = """you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos ti tú
tus usted ustedes vosotros""".split()
NAMES = (
    "log_words", "fixed", "learned", "learned_sum", "learned_max", "learned_kinds", "near_second", "second", "capitals",
    "punctuation", "exclaims", "digits", "single_letters", "undone", "other_signs",
)

_UPPER, _LOWER, _DIGIT, _PUNCT, _EXCLAIM, _SPACE, _OTHER = range(7)
_CLASS = np.full(256, _OTHER, dtype=np.uint8)
for _chars, _k in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER), (b"abcdefghijklmnopqrstuvwxyz", _LOWER), (b"0123456789", _DIGIT), (b"\"#$%&'()*+,-./:;<=>@[\\]^_`{|}~", _PUNCT), (b"!?", _EXCLAIM), (b" \t\n\r\x0b\x0c", _SPACE)):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = _LOWER  # bytes of letters outside ASCII, almost always
_WORDS = bytes(c if _CLASS[c] in (_UPPER, _LOWER, _DIGIT) else 32 for c in range(256))
_UNDO = bytes.maketrans(b"@$013457", b"asoieast")
_UNDO = bytes(c if _CLASS[c] in (_UPPER, _LOWER, _DIGIT, _SPACE) else 32 for c in _UNDO)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().translate(_WORDS).split()


def marks_of(words) -> set[bytes]:
    """Words of 3 bytes or more, and beginnings of words with a star."""
    found = {w for w in words if len(w) > 2}
    return found | {w[:n] + b"*" for w in found for n in STEMS if len(w) >= n}


class _Weights(dict):
    """The weight of a word (0: not in the lexicon), worked out once for each distinct word."""

    def __init__(self, learned: dict[bytes, float], fixed: set[bytes]):
        self.learned, self.fixed = learned, fixed

    def __missing__(self, word: bytes) -> float:
        found = [self.learned[m] for m in marks_of([word]) if m in self.learned]
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = x = max(found, default=0.0) or (1e-9 if word in self.fixed else 0.0)
        return x


class Features:
    def __init__(self, learned: dict[str, float]):
        self.fixed = {w.encode() for w in INSULTS}
        self.second = {w.encode() for w in SECOND}
        self.weights = _Weights({bytes.fromhex(w): x for w, x in learned.items()}, self.fixed)

    def __call__(self, text: str | None) -> list[float]:
        raw = (text or "").encode()
        counts = np.bincount(_CLASS[np.frombuffer(raw, dtype=np.uint8)], minlength=7).tolist()
        words = raw.lower().translate(_WORDS).split()
        n, size = max(len(words), 1), max(len(raw), 1)
        weigh, second = self.weights, self.second
        hits = [i for i, w in enumerate(words) if weigh[w]]
        you = [i for i, w in enumerate(words) if w in second]
        weights = [x for i in hits if (x := weigh[words[i]]) > 1e-6]
        near = 0
        if hits and you:  # hits with a second-person word at most NEAR words before or after
            at, k = np.array(you), np.array(hits)
            near = int((np.searchsorted(at, k + NEAR, "right") > np.searchsorted(at, k - NEAR)).sum())
        undone = 0
        if counts[_DIGIT] or counts[_PUNCT]:
            undone = max(0, sum(1 for w in raw.lower().translate(_UNDO).split() if weigh[w]) - len(hits))
        letters = max(counts[_UPPER] + counts[_LOWER], 1)
        return [
            math.log1p(len(words)), 100 * sum(1 for i in hits if words[i] in self.fixed) / n, 100 * len(weights) / n, float(sum(weights)),
            max(weights, default=0.0), float(len({words[i] for i in hits})), float(near), 100 * len(you) / n, 100 * counts[_UPPER] / letters,
            100 * counts[_PUNCT] / size, 100 * counts[_EXCLAIM] / size, 100 * counts[_DIGIT] / size,
            100 * sum(1 for w in words if len(w) == 1) / n, float(undone), 100 * counts[_OTHER] / size,
        ]


def feature_column(text: Column, learned: dict[str, float]) -> Column:
    @F.arrow_udf("array<double>")
    def f(texts: pa.Array) -> pa.Array:  # one text at a time leaves Arrow's memory
        one = Features(learned)
        out = pa.array([one(t.as_py()) for t in texts], pa.list_(pa.float64()))
        give_back()
        return out

    return f(text)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def mark_column(text: Column) -> Column:
    @F.arrow_udf("array<string>")
    def f(texts: pa.Array) -> pa.Array:
        out = pa.array([[m.hex() for m in marks_of(words_of(t.as_py()))] for t in texts], pa.list_(pa.string()))
        give_back()
        return out

    return f(text)


def learned_lexicon(sample: DataFrame, most=WORDS, least=LEAST_G) -> dict[str, float]:
    """Log odds of marks (hexadecimal) that are significant for toxic documents in sample(text, toxic)."""
    sample = sample.groupBy(F.xxhash64("text").alias("copy")).agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"))
    total = sample.agg(F.sum("toxic"), F.count("*")).first()
    bad, n = total[0] or 0, total[1] or 0
    if not 0 < bad < n:
        return {}
    marks = sample.select("toxic", F.explode(mark_column(F.col("text"))).alias("mark"))
    counts = marks.groupBy("mark").agg(F.sum("toxic").alias("a"), F.count("*").alias("m")).filter("a >= 2")
    a, b = F.col("a").cast("double"), (F.col("m") - F.col("a")).cast("double")
    share = F.lit(bad / n)
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    g = 2 * (part(a, (a + b) * share) + part(b, (a + b) * (1 - share)))
    odds = F.log((a + 0.5) / (bad - a + 0.5)) - F.log((b + 0.5) / (n - bad - b + 0.5))
    top = counts.select("mark", odds.alias("odds"), g.alias("g")).filter((F.col("g") >= least * F.least(F.lit(1.0), F.lit(n / 2000))) & (F.col("odds") > 2)).orderBy(F.col("g").desc(), "mark").limit(most)
    return {r["mark"]: float(r["odds"]) for r in top.collect()}


class Model:
    """A fitted scorer; score() adds columns to any documents."""

    def __init__(self, learned, trees, calibration, share):
        self.learned, self.trees, self.calibration, self.share = learned, trees, calibration, share

    def score(self, docs: DataFrame, text="text") -> DataFrame:
        """docs with columns score and predicted."""
        if self.trees is None:
            out = docs.withColumn("score", F.lit(float(self.share)))
        else:
            from pyspark.ml.functions import array_to_vector, vector_to_array

            x = docs.withColumn("_features", array_to_vector(feature_column(F.col(text), self.learned)))
            x = self.trees.transform(x).withColumn("_p", vector_to_array("_probability")[1])
            x = self.calibration.transform(x)
            score = 0.999 * F.least(F.greatest("_calibrated", F.lit(0.0)), F.lit(1.0)) + 0.001 * F.col("_p")
            out = x.withColumn("score", score).select(*docs.columns, "score")
        return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def fit(docs: DataFrame, labels: DataFrame, key="doc_id", most=LABELLED) -> Model:
    """A model from docs(key, text) and labels(key, toxic); see the module's text for what is learned from what."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    order = F.xxhash64(F.lit("toxicity"), F.col(key))
    chosen = (
        labels.filter(F.col("toxic").isNotNull() & ~held_out(F.col(key))).groupBy(key).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
        .orderBy(order, key).limit(most)
    )
    # at most LABELLED rows: a bounded broadcast
    rows = docs.select(key, "text").join(F.broadcast(chosen), key).withColumn("part", F.pmod(F.xxhash64(F.lit("part"), F.col(key)), F.lit(4)))
    sample = stored(rows)
    learned = learned_lexicon(sample.filter("part = 0"))
    x = stored(sample.select("part", F.col("toxic").cast("double").alias("label"), feature_column(F.col("text"), learned).alias("f")))
    kinds = {(r["part"] == 3, r["label"]): r["count"] for r in x.filter("part > 0").groupBy("part", "label").count().collect()}
    share = sample.agg(F.avg("toxic")).first()[0] or 0.0
    if len(kinds) < 4:
        return Model(learned, None, None, share)
    x = x.withColumn("_features", array_to_vector("f")).coalesce(4)
    booster = GBTClassifier(featuresCol="_features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=7, maxBins=64, minInstancesPerNode=5, predictionCol="_class")
    trees = booster.setProbabilityCol("_probability").setRawPredictionCol("_raw").fit(x.filter("part IN (1, 2)"))
    held = trees.transform(x.filter("part = 3")).select("label", vector_to_array("_probability")[1].alias("_p"))
    calibration = IsotonicRegression(featuresCol="_p", labelCol="label", predictionCol="_calibrated").fit(held)
    return Model(learned, trees, calibration, share)


def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return model.score(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
