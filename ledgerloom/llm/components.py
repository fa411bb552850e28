"""Connected components by alternating large-star and small-star steps, as DataFrame joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Connect neighbours to the least node of each neighbourhood: those above the node (large) or the others (small).

    edges(a, b) has a > b. The minimum is a partial aggregate, so a hub of any degree is no hot spot; the join
    brings every edge one minimum, a unique key on one side."""
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select("a", "b")
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = both.join(least, "a")
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the least node that can be reached.

    Edges with a null end and loops link nothing. Each round ends with a reliable checkpoint; the rounds end when
    the edges are stars that no step changes."""
    x = cut(edges.select("a", "b").filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def sign(df):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    was = sign(x)
    while was[0]:
        x = cut(_star(_star(x, True), False))
        now = sign(x)
        if now == was:
            break
        was = now
    return x.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(x.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
