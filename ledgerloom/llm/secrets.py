"""Secret scan: three fixed patterns, and tokens that pass a battery of randomness tests.

Fixed kinds (leftmost, non-overlapping matches of each): assign, access, hex. The battery adds spans of kind
``random``: tokens of 20 or more characters of base64 (or base64url) text that overlap no fixed span. For each one
an encoding is inferred from its characters (hex, base32, base64), its characters become numbers, and three tests
of "uniform over the encoding's alphabet" give p-values: chi-squared uniformity over eight equal parts of the
alphabet, the runs test about the alphabet's middle, and lag-one serial correlation. Three times the least p-value
(at most 1) says how well the token passes the battery.

A token is reported if it passes better than text does. The null hypothesis is a stretch of running text: the words of a
document that are no candidates put together, reduced to the encoding's alphabet, from one place of each document of the corpus and for each
encoding and power-of-two length class with tokens. The share of these stretches that pass at least as well is the token's
p-value against text, and the Benjamini-Hochberg procedure, apart for each encoding and length class, bounds the share of
false reports by ``RATE``: short tokens (weak tests) and long ones (strong tests) don't set each other's threshold. A class
with too few documents to tell anything from text reports nothing.

The procedure needs only counts by encoding, length class and bin of log p: a bounded table, however large the corpus.

Nulls and odd values: a null text counts as empty. Repeated rows each give a row, and count each. Ties share a bin and are
reported together or not at all. Positions are code points, ends exclusive. Very long texts are whole: matches are
numbered in blocks, so their cost grows in proportion. An empty table gives an empty result. Extra columns, of any name,
are ignored.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import stored, table

#: Fixed patterns. Short hex and access runs can't hold a match of full length, so their minimum is in the pattern.
ASSIGN = r"(?:(?i)password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+"
ASSIGN_VALUE = r"(?s)^(?:(?i)password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ASSIGN_WORDS = ["password", "passwd", "secret", "token", "api_key", "apikey"]
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "random")
#: Encodings in the order in which they are tried: pattern of all characters, alphabet in the order of values.
ENCODINGS = (
    ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    ("base32", r"^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base64", r"^[A-Za-z0-9+/_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)
PARTS = 8
#: Rate of false reports, bins for each halving of p, and the number of bins; matches of one block.
RATE, BINS_PER_BIT, MAX_BIN = 0.05, 4, 400
BLOCK = 256


def find(text: Column, pattern: str) -> Column:
    """array<struct<start, end, hit>> of all matches."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(F.length(g).alias("gap"), h.alias("hit")))
    none, zero = F.array().cast("array<struct<start:long,end:long,hit:string>>"), F.lit(0).cast("long")

    def add(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.length(x["hit"])
        item = F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), x["hit"].alias("hit"))
        return F.struct(end.cast("long").alias("at"), F.concat(acc["found"], F.array(item)).alias("found"))

    def numbered(pairs):
        block = lambda b: F.slice(pairs, b * BLOCK + 1, BLOCK)
        blocks = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(pairs) / BLOCK).cast("int") - 1, F.lit(0)))
        sums = F.transform(blocks, lambda b: F.aggregate(block(b), zero, lambda a, x: a + x["gap"] + F.length(x["hit"])))
        begins = F.aggregate(sums, F.array(zero), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
        each = lambda begins: F.flatten(F.transform(blocks, lambda b: F.aggregate(block(b), F.struct(begins[b].alias("at"), none.alias("found")), add)["found"]))
        return F.transform(F.array(begins), each)[0]

    return F.transform(F.array(pairs), numbered)[0]


def found(text: Column, pattern: str, may=None) -> Column:
    """``find``, which reads a text twice, only where one of the words ``may`` is in the text, if given, and the pattern in it."""
    there = text.rlike(pattern)
    if may:
        low = F.lower(text)
        there = functools.reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in may]) & there
    return F.when(there, find(text, pattern)).otherwise(F.array().cast("array<struct<start:long,end:long,hit:string>>"))


def bound(x: Column, f) -> Column:
    """f(x) with x computed once, however often f has it: within lambdas Spark computes an expression anew at each place."""
    return F.transform(F.array(x), f)[0]


def _tail(z: Column) -> Column:
    """P(normal > z) for z >= 0 by the polynomial of Abramowitz and Stegun, 26.2.17; never below 1e-300."""

    def at(z):
        poly = lambda t: t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        return F.greatest(F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * bound(1 / (1 + 0.2316419 * z), poly), F.lit(1e-300))

    return bound(z, at)


def _sum(values: Column, f=lambda x: x) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + f(x))


def test_token(hit: Column, known: Column | None = None) -> Column:
    """struct<enc, cls, bin> of a token: encoding (the known one, or inferred), length class, bin of -log2(p)."""
    enc, alphabet, part = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, pattern, letters in reversed(ENCODINGS):
        fits = hit.rlike(pattern) if known is None else known == name
        enc, alphabet = F.when(fits, name).otherwise(enc), F.when(fits, letters).otherwise(alphabet)
    plain = F.when(enc == "hex", F.lower(hit)).when(enc == "base64", F.translate(hit, "-_", "+/")).otherwise(hit)
    for name, _, letters in ENCODINGS:  # each character's part of the alphabet, as a text of digits: counted without a step for each
        part = F.when(enc == name, F.translate(plain, letters, "".join(str(x * PARTS // len(letters)) for x in range(len(letters))))).otherwise(part)
    values = F.transform(F.regexp_extract_all(plain, F.lit("."), F.lit(0)), lambda c: (F.instr(alphabet, c) - 1).cast("double"))
    head = F.struct(enc.alias("enc"), F.length(hit).cast("double").alias("n"), values.alias("v"), part.alias("part"))

    def counted(h):
        without = lambda text, what: F.length(F.replace(text, F.lit(what), F.lit(""))).cast("double")
        high = F.translate(h["part"], "01234567", "00001111")
        runs = 1 + (h["n"] - without(high, "01")) / 2 + (h["n"] - without(high, "10")) / 2
        return F.struct(h.alias("h"), *[(h["n"] - without(h["part"], str(k))).alias(f"c{k}") for k in range(PARTS)], runs.alias("runs"), (_sum(h["v"]) / h["n"]).alias("mid"))

    def stats(s):
        h, n, v, mid, runs = s["h"], s["h"]["n"], s["h"]["v"], s["mid"], s["runs"]
        counts = [s[f"c{k}"] for k in range(PARTS)]
        chi = functools.reduce(lambda a, b: a + b, [c * c for c in counts]) * PARTS / n - n
        df = PARTS - 1
        z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
        p_chi = bound(z_chi, lambda z: F.when(z >= 0, _tail(F.abs(z))).otherwise(1 - _tail(F.abs(z))))
        n1 = functools.reduce(lambda a, b: a + b, counts[PARTS // 2 :])
        n2 = n - n1
        mean = 2 * n1 * n2 / n + 1
        var = F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9))
        p_runs = F.when((n1 == 0) | (n2 == 0), 1e-300).otherwise(2 * _tail(F.abs(runs - mean) / F.sqrt(var)))
        pairs = F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v)), lambda a, b: (a - mid) * (b - mid))
        p_corr = bound(_sum(v, lambda x: (x - mid) * (x - mid)), lambda spread: F.when(spread == 0, 1e-300).otherwise(2 * _tail(F.abs((_sum(pairs) / spread + 1 / n) * F.sqrt(n)))))
        p = F.least(3 * F.least(p_chi, p_runs, p_corr), F.lit(1.0))
        return F.struct(
            h["enc"].alias("enc"), F.floor(F.log2(n)).cast("int").alias("cls"),
            F.least(F.floor(-F.log2(p) * BINS_PER_BIT), F.lit(MAX_BIN)).cast("int").alias("bin"),
        )

    return bound(bound(head, counted), stats)


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the fixed kinds, base (sorted fixed spans) and tokens (tested candidates)."""
    df = docs.withColumn("text", F.coalesce("text", F.lit("")))
    long_enough = F.filter(found(F.col("text"), ASSIGN, ASSIGN_WORDS), lambda x: F.length(F.regexp_extract(x["hit"], ASSIGN_VALUE, 1)) >= 12)
    df = df.withColumns({"assign": long_enough, "access": found(F.col("text"), ACCESS, ["akia"]), "hex": found(F.col("text"), HEX), "token": found(F.col("text"), TOKEN)})
    tag = lambda c, k: F.transform(c, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end")))
    df = df.withColumn("base", F.array_sort(F.concat(*[tag(name, k) for k, name in enumerate(KINDS[:3])])))
    free = lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    tested = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), test_token(x["hit"]).alias("t"))
    df = df.withColumn("tokens", F.transform(F.filter("token", free), tested))
    count = lambda c: F.size(c).cast("long")
    return df.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), "base", "tokens")


def texts_like(text: Column, classes: list[tuple[str, int]]) -> Column:
    """array<struct<enc, cls, s>>: for each (encoding, length class) a stretch of a text's words (none of them a candidate token),
    put together and reduced to the encoding's alphabet; null if the text is too short. Words are reduced once for each encoding,
    however many classes it has."""
    words = F.regexp_replace(F.regexp_replace(text, TOKEN, " "), r"[^A-Za-z0-9+/_-]+", "")
    reduced = {"base64": lambda w: w, "base32": lambda w: F.regexp_replace(F.upper(w), "[^A-Z2-7]+", ""), "hex": lambda w: F.regexp_replace(F.lower(w), "[^0-9a-f]+", "")}

    def stretches(enc):
        least = [(cls, max(20, 1 << cls)) for e, cls in classes if e == enc]  # shorter stretches pass more easily
        cut = lambda w, n: F.when(w["n"] >= n, F.substring(w["w"], F.pmod(w["h"], w["n"] - n + 1).cast("int") + 1, F.lit(n)))
        each = lambda w: F.array(*[F.struct(F.lit(enc).alias("enc"), F.lit(cls).alias("cls"), cut(w, n).alias("s")) for cls, n in least])
        measured = lambda w: F.struct(w.alias("w"), F.length(w).alias("n"), F.xxhash64(w).alias("h"))
        return lambda w: F.transform(F.transform(F.array(reduced[enc](w)), measured), each)[0]

    of = [stretches(enc) for enc in sorted({e for e, _ in classes})]
    return F.transform(F.array(words), lambda w: F.concat(*[f(w) for f in of]))[0]


def report_bins(scanned: DataFrame, docs: DataFrame, rate=RATE) -> dict[tuple[str, int], int]:
    """For each encoding and length class the last bin that is reported; classes that report nothing are left out.

    At most (encodings x length classes x bins) counts come to the driver, whatever the corpus."""

    def bins(df):
        found: dict[tuple[str, int], dict[int, int]] = {}
        for r in df.groupBy("t.enc", "t.cls", "t.bin").count().collect():
            found.setdefault((r["enc"], r["cls"]), {})[r["bin"]] = r["count"]
        return found

    tokens = bins(scanned.select(F.explode("tokens.t").alias("t")))
    if not tokens:
        return {}
    # written once: filters that Spark derives from an explode would compute the stretches again
    drawn = stored(docs.select(texts_like(F.col("text"), sorted(tokens)).alias("x"))).select(F.explode("x").alias("x")).filter("x.s IS NOT NULL")
    null = bins(drawn.select("x.enc", "x.cls", test_token(F.col("x.s"), F.col("x.enc"))["bin"].alias("bin")).select(F.struct("enc", "cls", "bin").alias("t")))
    out = {}
    for key, own in tokens.items():
        text, m = null.get(key, {}), sum(own.values())
        n, passed, better = sum(text.values()), 0, 0
        for b in range(MAX_BIN + 1):  # those that pass best first
            passed, better = passed + own.get(b, 0), better + text.get(b, 0)
            if own.get(b) and (1 + better) / (1 + n) <= rate * passed / m:
                out[key] = b
    return out


def scan(docs: DataFrame, rate=RATE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans for every row of docs(doc_id, text)."""
    docs = docs.select("doc_id", "text")
    scanned = stored(spans(docs))
    cuts = report_bins(scanned, docs, rate)

    def random_enough(x):
        limit = F.lit(-1)
        for (enc, cls), b in sorted(cuts.items()):
            limit = F.when((x["t"]["enc"] == enc) & (x["t"]["cls"] == cls), b).otherwise(limit)
        return x["t"]["bin"] <= limit

    kept = F.filter("tokens", random_enough)
    random = F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end")))
    names = F.array(*[F.lit(k) for k in KINDS])
    join = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", names[x["kind"]], x["start"], x["end"])), ",")
    count = lambda c: F.size(c).cast("long")
    return scanned.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        count(random).alias("n_random"), F.sha2(join(F.col("base")), 256).alias("base_sha256"), join(F.array_sort(F.concat("base", random))).alias("spans"),
    )


def op4(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))
