"""Joins with hot keys and reachability over edge tables, with intermediate tables in the shared folder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.files import remove, scratch

#: A key of more rows than this is dealt out to WAYS tasks; its rows on the other side are copied there.
HOT, WAYS = 1_000_000, 32
#: Walks of so many steps are taken as a sign of cycles.
CHECK = 128


class Room:
    """Intermediate tables: each is written once and read back, which cuts its lineage; close() deletes them, but for one."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, []

    def cut(self, df: DataFrame) -> DataFrame:
        path = scratch(self.spark)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((out, path))
        return out

    def close(self, but: DataFrame | None = None) -> None:
        for df, path in self.tables:
            if df is not but:
                remove(self.spark, path)
        self.tables = []


def spread_join(left: DataFrame, right: DataFrame, on: str, hot: int = HOT, ways: int = WAYS, room: Room | None = None, rows: int | None = None) -> DataFrame:
    """Inner join on one column, whatever share of left's rows one key holds: rows of hot keys go to ``ways`` tasks by a hash of
    the whole row, and right's rows of those keys are copied to each. There are at most rows / hot hot keys; none if left is
    known to have no more than ``hot`` rows."""
    if rows is not None and rows <= hot:
        return left.join(right, on)
    often = (room or Room(left.sparkSession)).cut(left.groupBy(on).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot).select(on))
    if often.isEmpty():
        return left.join(right, on)
    known = F.broadcast(often.withColumn("_hot", F.lit(True)))
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(ways)).cast("int")
    a = left.join(known, on, "left").withColumn("_salt", F.when(F.col("_hot"), salt).otherwise(0)).drop("_hot")
    b = right.join(known, on, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(ways - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return a.join(b, [on, "_salt"]).drop("_salt")


def upstream(edges: DataFrame, targets: DataFrame, hot: int = HOT, check: int = CHECK) -> DataFrame:
    """(target, node): every node from which a walk over edges(src, dst) leads to a target; a target itself only if it lies on
    a cycle. Edges without an end and repeated edges count for nothing more.

    Beside what was found, walks of 1, 2, 4, 8.. steps are kept, so chains of any length take a number of rounds that grows
    with the logarithm of their length. What a round finds is written once and stays as it is; repeats go at the end. Edges to
    nodes that lead no further are in the first round only, and it ends when no walks are left. Where walks of ``check`` steps
    are left, there may be cycles: each round drops its repeats from then on, and one that finds nothing new is the last."""
    room = Room(edges.sparkSession)
    ends = targets.toDF("dst").distinct()
    known = room.cut(edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct())
    parts = [room.cut(known.join(ends, "dst", "left_semi").select(F.col("dst").alias("target"), F.col("src").alias("node")))]
    further = known.select(F.col("src").alias("dst")).distinct()
    steps, length, n = room.cut(known.join(further, "dst", "left_semi").select("src", "dst")), 1, None
    while not steps.isEmpty():
        found = reduce(DataFrame.unionByName, parts)
        more = spread_join(found.withColumnRenamed("node", "dst"), steps, "dst", hot, room=room, rows=found.count()).select("target", F.col("src").alias("node")).distinct()
        if length < check:
            parts.append(room.cut(more))
        else:
            parts = [room.cut(found.unionByName(more).distinct())]
            now = parts[0].count()
            if now == n:
                break
            n = now
        last = steps.select(F.col("src").alias("mid"), F.col("dst").alias("to"))
        steps = room.cut(spread_join(last, steps.withColumnRenamed("dst", "mid"), "mid", hot, room=room, rows=steps.count()).select("src", F.col("to").alias("dst")).distinct())
        length *= 2
    found = room.cut(reduce(DataFrame.unionByName, parts).distinct()) if len(parts) > 1 else parts[0]
    room.close(but=found)
    return found


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges(a, b); component is the least node of its connected component.

    Each round a node takes the least label around it, then the label of that label, so labels travel twice as far each time."""
    room = Room(edges.sparkSession)
    pairs = edges.select("a", "b").filter("a <> b")
    both = room.cut(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = room.cut(both.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        least = room.cut(labels.join(near.withColumnRenamed("a", "node"), "node").select("node", "component", F.least("component", "near").alias("to")))
        jump = least.select(F.col("node").alias("to"), F.col("to").alias("further"))
        now = room.cut(least.join(jump, "to").select("node", F.col("component").alias("was"), F.least("to", "further").alias("component")))
        labels = now.select("node", "component")
        if now.filter("was <> component").isEmpty():
            labels = room.cut(labels)
            room.close(but=labels)
            return labels
