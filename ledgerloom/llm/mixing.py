"""Mixing sources to target weights by entropy balancing.

Every document gets a rate r = limit * sigmoid(lambda_source * size / mean_size), the exponentially tilted
(bounded) rate of least divergence from 1 that meets the token constraint of its source:
sum(rate * size) = target. The multipliers solve the convex dual by Newton steps; each step is one
aggregation by source over the distinct (source, size) pairs, so no step reads a text or gathers a group.

Rates become whole copies by one threshold for each source: a document takes floor(rate) copies and one more
if u - frac(rate) lies below the threshold, with u a hash of its id. The threshold is found by histograms that
are refined around the point where the taken words pass the target, so a source misses its target by at most
half of its one document at that point; then the one document whose size comes nearest to what is still missing
is added or left out. Everything is a function of the rows alone: reruns agree.

Nulls: a null text has size 0; a null source is a source of its own, last in order. Documents of size 0 get
``taken`` 0. Repeated rows are all kept; rows with equal ids and texts have the same hash and are taken or left
together. Rows of one id (or of none) with other texts are documents of their own. Rows of equal hash are a
tie: all of them or none takes the copy more. Texts of any length are counted whole. An empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ledgerloom.llm.common import cut, small, stored, word_count

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, LIMIT = 1.5, 2.0
#: Newton steps in one job, most jobs, and the share of a target that may be missed before rounding.
STEPS, JOBS, CLOSE = 4, 10, 1e-6
#: Bins in each refinement of the rounding threshold, and refinements.
BINS, ROUNDS = 256, 4


def _key():
    """A source's key in joins: never null, apart from every real name, ordered by code point with null last."""
    return F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))


def source_targets(sources: DataFrame, weights=WEIGHTS, share=SHARE, limit=LIMIT) -> DataFrame:
    """sources(key, source_size, n) with a column target: a share by weight, at most limit * source_size.

    The position of a source in code-point order picks its weight; positions come from a range partitioning
    and counts for each partition, so there is no global sort in one task."""
    ranged = cut(sources.repartitionByRange(F.col("key")).withColumn("part", F.spark_partition_id()))
    before = (
        ranged.groupBy("part").agg(F.count("*").alias("rows"))
        .select("part", (F.sum("rows").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))).alias("before"))
    )
    place = F.row_number().over(W.partitionBy("part").orderBy("key")) - 1 + F.coalesce("before", F.lit(0))
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place % len(weights) + 1).cast("int"))
    weighed = cut(ranged.join(F.broadcast(before), "part").withColumn("weight", weight).drop("part", "before"))
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level, was = None, -1
    while True:  # water filling: sources at their limit leave the rest to the others
        full = F.lit(False) if level is None else F.col("weight") * level > F.col("source_size") * limit
        n, kept, w = weighed.agg(
            F.sum(full.cast("long")), F.sum(F.when(full, F.col("source_size") * limit)), F.sum(F.when(~full, F.col("weight")))
        ).first()
        if not w or n == was:
            break
        level, was = (share * total - (kept or 0.0)) / w, n
    level = float("inf") if level is None else level
    return weighed.withColumn("target", F.least(F.col("weight") * level, F.col("source_size") * limit))


def _rate(lam, limit):
    """The tilted rate for x = size / mean size; at the limit (lambda null) exactly the limit."""
    return F.when(lam.isNull(), F.lit(limit)).otherwise(F.lit(limit) / (1 + F.exp(-F.greatest(F.least(lam * F.col("x"), F.lit(700.0)), F.lit(-700.0)))))


def solve_multipliers(sizes: DataFrame, targets: DataFrame, limit=LIMIT) -> DataFrame:
    """targets with the multiplier lam of each source (null: every rate is at the limit)."""
    cells = cut(sizes.filter("size > 0").groupBy("key", "size").agg(F.count("*").alias("n")))
    at_limit = F.col("target") >= F.col("source_size") * limit * (1 - 1e-12)
    # The root lies in a bracket that Newton steps may not leave.
    state = cut(targets.withColumns({
        "mean": F.col("source_size") / F.col("n"), "lam": F.when(~at_limit & (F.col("source_size") > 0), F.lit(0.0)),
        "low": F.lit(-1e9), "high": F.lit(1e9), "gap": F.lit(1.0),
    }))
    for _ in range(JOBS):
        for _ in range(STEPS):
            joined = cells.join(small(state.select("key", "lam", "mean"), 100_000), "key").withColumn("x", F.col("size") / F.col("mean"))
            rate = _rate(F.col("lam"), limit)
            sums = joined.groupBy("key").agg(
                F.sum(F.col("n") * F.col("size") * rate).alias("got"),
                F.sum(F.col("n") * F.col("size") * F.col("x") * rate * (1 - rate / limit)).alias("slope"),
            )
            lam, gap = F.col("lam"), F.col("got") - F.col("target")
            low = F.when(gap < 0, lam).otherwise(F.col("low"))
            high = F.when(gap > 0, lam).otherwise(F.col("high"))
            newton = F.when(F.col("slope") > 0, lam - gap / F.col("slope"))
            wide = F.when(low <= -1e9, high * 2 - 1).when(high >= 1e9, low * 2 + 1).otherwise((low + high) / 2)
            step = F.when((newton > low) & (newton < high) & (F.abs(newton - lam) <= 2 + F.abs(lam)), newton).otherwise(wide)
            state = (
                state.join(sums, "key", "left")
                .withColumns({"lam_": F.when(gap == 0, lam).otherwise(step), "low_": low, "high_": high, "gap_": F.abs(gap) / F.col("target")})
                .select("key", "source_size", "n", "weight", "target", "mean", F.when(lam.isNotNull(), F.col("lam_")).alias("lam"), F.col("low_").alias("low"), F.col("high_").alias("high"), F.col("gap_").alias("gap"))
            )
            state = cut(state)
        worst = state.filter("lam IS NOT NULL").agg(F.max("gap")).first()[0]
        if worst is None or worst <= CLOSE:
            break
    return state


def _placed(rated: DataFrame) -> DataFrame:
    """rated(who, key, size, rate) with the whole copies of each row and its place v in the order of one copy more."""
    u = F.shiftrightunsigned(F.xxhash64(F.lit("copies"), "who"), 11) / float(1 << 53)
    return rated.withColumns({"whole": F.floor("rate").cast("long"), "v": u - (F.col("rate") - F.floor("rate"))})


def _beyond(placed: DataFrame, edges: DataFrame) -> DataFrame:
    """placed with extra: whether a row takes one copy more, by edges(key, edge)."""
    extra = F.coalesce((F.col("v") < F.col("edge")) & (F.col("rate") > F.col("whole")), F.lit(False))
    return placed.join(small(edges, 100_000), "key").withColumn("extra", extra)


def rounding(rated: DataFrame, sources: DataFrame) -> DataFrame:
    """(key, edge, flip) of each source: where its rows' places end that take one copy more, and the row that does otherwise.
    rated(who, key, size, rate), sources(key, target); who, a hash, tells documents apart."""
    v = _placed(rated)
    at = small(sources, 100_000)
    lines = cut(
        v.groupBy("key").agg(F.sum(F.col("whole") * F.col("size")).alias("base")).join(at, "key")
        .select("key", (F.col("target") - F.col("base")).alias("need"), F.lit(-1.0).alias("low"), F.lit(2.0).alias("width"))
    )
    for _ in range(ROUNDS):
        place = F.floor((F.col("v") - F.col("low")) / F.col("width") * BINS)
        bins = (
            v.filter("size > 0").join(small(lines, 100_000), "key").filter((F.col("v") >= F.col("low")) & (F.col("v") < F.col("low") + F.col("width")))
            .groupBy("key", F.least(place, F.lit(BINS - 1)).alias("bin")).agg(F.sum("size").alias("words"))
        )
        upto = bins.withColumn("upto", F.sum("words").over(W.partitionBy("key").orderBy("bin")))
        # the first bin that passes the need, and the words below it
        first = upto.join(lines.select("key", "need"), "key").filter("upto > need").groupBy("key").agg(F.min_by(F.struct("bin", (F.col("upto") - F.col("words")).alias("below")), "bin").alias("b"))
        lines = cut(
            lines.join(first, "key", "left").select(
                "key",
                (F.col("need") - F.coalesce(F.col("b.below"), F.lit(0))).alias("need"),
                F.when(F.col("b").isNull(), F.col("low") + F.col("width")).otherwise(F.col("low") + F.col("b.bin") * F.col("width") / BINS).alias("low"),
                F.when(F.col("b").isNull(), F.lit(0.0)).otherwise(F.col("width") / BINS).alias("width"),
            )
        )
    # what lies inside the last bin (mostly one document) is taken if that brings the source nearer to its target
    inside = (
        v.filter("size > 0").join(small(lines, 100_000), "key").filter((F.col("v") >= F.col("low")) & (F.col("v") < F.col("low") + F.col("width")))
        .groupBy("key").agg(F.sum("size").alias("words"))
    )
    edge = cut(
        lines.join(inside, "key", "left")
        .select("key", (F.col("low") + F.when(F.abs(F.col("words") - F.col("need")) < F.abs("need"), F.col("width")).otherwise(0.0)).alias("edge"))
    )
    taken = _beyond(v, edge)
    # one document more or less, the one whose size is nearest to what a source still misses
    left = cut(
        taken.groupBy("key").agg(F.sum((F.col("whole") + F.col("extra").cast("long")) * F.col("size")).alias("got")).join(at, "key")
        .select("key", (F.col("target") - F.col("got")).alias("left"))
    )
    fits = F.struct(F.abs(F.col("size") - F.abs("left")).alias("off"), "who")
    best = cut(
        taken.join(small(left, 100_000), "key")
        .filter((F.col("size") > 0) & (F.col("rate") > F.col("whole")) & (F.col("extra") == (F.col("left") < 0)) & (F.col("size") < 2 * F.abs("left")))
        .groupBy("key").agg(F.min(fits).alias("fit")).select("key", F.col("fit.who").alias("flip"))
    )
    return cut(edge.join(best, "key", "left").select("key", "edge", "flip"))


def with_copies(rated: DataFrame, rounded: DataFrame) -> DataFrame:
    """rated with a column copies, by rounding(rated)."""
    out = _beyond(_placed(rated), rounded)
    flip = F.coalesce(F.col("who") == F.col("flip"), F.lit(False)) & (F.col("rate") > F.col("whole"))
    return out.withColumn("copies", F.col("whole") + (F.col("extra") != flip).cast("long")).drop("edge", "v", "whole", "extra", "flip")


def sized(docs: DataFrame, *carry: str) -> DataFrame:
    """carry, key, size, who of docs(doc_id, text, source)."""
    who = F.xxhash64("doc_id", F.xxhash64("text")).alias("who")
    return docs.select(*carry, _key().alias("key"), word_count(F.col("text")).alias("size"), who)


def rated(sizes: DataFrame, known: DataFrame, limit=LIMIT) -> DataFrame:
    """sizes(key, size) with source_size, target and rate, by known(key, source_size, target, lam, mean)."""
    x = sizes.join(small(known, 100_000), "key").withColumn("x", F.coalesce(F.col("size") / F.col("mean"), F.lit(0.0)))
    return x.withColumn("rate", F.when(F.col("size") > 0, _rate(F.col("lam"), limit)).otherwise(0.0)).drop("x", "mean", "lam")


def fit(sizes: DataFrame, weights=WEIGHTS, share=SHARE, limit=LIMIT) -> tuple[DataFrame, DataFrame]:
    """What the mix of sizes(key, size, who) needs of each source: known(key, source_size, target, lam, mean), and its rounding."""
    totals = sizes.groupBy("key").agg(F.sum("size").alias("source_size"), F.sum((F.col("size") > 0).cast("long")).alias("n"))
    state = solve_multipliers(sizes, source_targets(totals, weights, share, limit), limit)
    known = cut(state.select("key", "source_size", "target", "lam", "mean"))
    return known, rounding(rated(sizes, known, limit), known.select("key", "target"))


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, limit=LIMIT, carry=()) -> DataFrame:
    """doc_id, source, carry, size, source_size, target, rate, copies, taken for every row of docs(doc_id, text, source)."""
    sizes = stored(sized(docs, "doc_id", "source", *carry))
    known, rounded = fit(sizes, weights, share, limit)
    return with_copies(rated(sizes, known, limit), rounded).withColumn("taken", F.col("copies") * F.col("size")).drop("key", "who")


def repeated(docs: DataFrame, *carry: str, weights=WEIGHTS, share=SHARE, limit=LIMIT) -> DataFrame:
    """carry and copies of each row of docs(doc_id, text, source). What was learned of the sources is applied in the row: beside
    sizes no row is stored, and none moves."""
    known, rounded = fit(stored(sized(docs)), weights, share, limit)
    return with_copies(rated(sized(docs, *carry), known, limit), rounded).select(*carry, "copies")


def op9(spark, sf_dir):
    from ledgerloom.llm.common import table

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")
