"""Exact top-k search by a Voronoi kNN join.

Vectors become integers, v = floor(256 * x). The score is the integer inner product.

1. Equal vectors become one (its k + 1 smallest ids, by partial minima), on either side.
2. Pivots are a bounded sample of data vectors (at most ``MOST_PIVOTS``, fewer for small tables). Each vector goes to the
   cell of its nearest pivot p, and there to a shell by its cosine with p; cell and shell are its group.
3. Summaries of groups: with v = a p/|p| + w, w at right angles to p, the least and greatest a and the greatest |w|. They
   bound every score of a query with the group: q.v <= max(qa * a) + |qw| * max|w|, where qa and qw are q's own parts.
4. First pass: each query meets the group of greatest bound that holds k + 1 vectors; its (k + 1)-th score there, theta, is
   no more than its final one. Second pass: a query asks those other groups only whose bound reaches its theta.
5. Neighbouring groups of about ``MANY`` vectors in all travel as one block. A query is sent to a block once, with the groups
   that it asks there; only these are solved for it. A block of more vectors or queries is dealt in parts of ``MANY`` by a
   hash, so no task grows with the data; then each part of one side meets each of the other, which sends a row once for
   every MANY rows of the other side that it must meet. Each part finds the k + 1 best by matrix products; the parts'
   results meet in a window of few rows for each query. Ties go to smaller ids; the query's own id is left out at the end.

Only pivots and summaries (a bounded number of groups) reach the driver; bounds are computed for SLICE queries at a time.
The report's ``replicated`` counts asked groups of both passes, ``sent`` the rows that carry them.
Where vectors have no clusters (uniform directions), no bound excludes much and every query meets most groups; the result
is the same.

Vectors that are null, or hold null or non-finite components, take no part; so do empty ones, and those of another length
than most (ties: the smaller length). Repeated rows count as candidates each (equal ids are told apart only by the id: a
query leaves out all rows of its id). With fewer than k candidates all are returned; empty tables give an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ledgerloom.llm.common import stored, table

K, SCALE = 5, 256
MOST_PIVOTS, SHELLS, MANY = 1024, 8, 16_384
#: Queries whose bounds, and queries whose scores, are computed at once.
SLICE, ROWS = 256, 128


def integer_vectors(df: DataFrame, vector="embedding", scale=SCALE) -> DataFrame:
    """df with an integer array v; rows that take no part are dropped."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    good = df.filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(False))).withColumn("v", v)
    sizes = good.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "size").first()
    return good.filter(F.size("v") == (sizes["size"] if sizes else 0))


def _packed(df: DataFrame) -> DataFrame:
    """(id, x) of (id, v): the vector as bytes of 64-bit integers."""

    def run(batches):
        for b in batches:
            flat, size = b.column(1).flatten().to_numpy(zero_copy_only=False), b.num_rows and len(b.column(1)[0])
            rows = np.ascontiguousarray(flat, dtype=np.int64).reshape(-1, size or 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], names=["id", "x"])

    return df.select(F.col("id").cast("long").alias("id"), "v").mapInArrow(run, "id long, x binary")


def _smallest_ids(df: DataFrame, k: int) -> DataFrame:
    """(x, ids): the k smallest ids of each vector. Ids meet in two steps, so a frequent vector is no hot spot."""
    salt = F.pmod(F.xxhash64("id"), F.lit(97))
    few = df.select("x", "id", salt.alias("salt")).withColumn("r", F.row_number().over(W.partitionBy("x", "salt").orderBy("id"))).filter(F.col("r") <= k)
    return few.groupBy("x").agg(F.slice(F.array_sort(F.collect_list("id")), 1, k).alias("ids"))


def _matrix(column, kind=np.float64) -> np.ndarray:
    rows = [np.frombuffer(x.as_buffer(), dtype=np.int64) for x in column]
    return np.array(rows, dtype=kind) if rows else np.zeros((0, 1), dtype=kind)


def _parts(m: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row: its parts along each unit vector, and what is left at right angles."""
    along = m @ unit.T
    return along, np.sqrt(np.maximum((m * m).sum(axis=1)[:, None] - along * along, 0.0))


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return a.astype(np.float64) @ b.astype(np.float64).T if top < 2**52 else a @ b.T


def knn_join(queries: DataFrame, data: DataFrame, k=K, pivots=None, many=MANY, report=None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of data(id, v) for each row of queries(id, v).

    report, a dictionary, gets the numbers of groups that are asked and of rows sent."""
    spark, k1 = data.sparkSession, k + 1
    d = stored(_smallest_ids(_packed(data), k1))
    asked = stored(_packed(queries))
    q = asked.groupBy("x").agg(F.min("id").alias("qid"))
    n = d.count()
    if not n:
        return queries.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("score")).limit(0)
    pivots = pivots or min(MOST_PIVOTS, max(8, math.isqrt(n) // 8))
    chosen = [np.frombuffer(r["x"], dtype=np.int64) for r in d.orderBy(F.xxhash64("x")).select("x").limit(pivots).collect()]  # a bounded sample, the same in every run
    centre = np.array(chosen, dtype=np.float64)
    unit = centre / np.maximum(np.sqrt((centre * centre).sum(axis=1)), 1e-300)[:, None]
    shared = spark.sparkContext.broadcast((centre, unit))

    def place(batches):
        c, u = shared.value
        for b in batches:
            m = _matrix(b.column(0))
            if len(m):
                cell = ((c * c).sum(axis=1)[None, :] - 2 * m @ c.T).argmin(axis=1)
                along = (m * u[cell]).sum(axis=1)
                whole = (m * m).sum(axis=1)
                shell = np.minimum((along / np.maximum(np.sqrt(whole), 1e-300) + 1) * (SHELLS / 2), SHELLS - 1).astype(np.int64)
                rest = np.sqrt(np.maximum(whole - along * along, 0.0))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell * SHELLS + shell, pa.int64()), pa.array(along), pa.array(rest)], names=["x", "ids", "grp", "along", "rest"])

    placed = stored(d.mapInArrow(place, "x binary, ids array<long>, grp long, along double, rest double"))
    groups = placed.groupBy("grp").agg(F.min("along").alias("lo"), F.max("along").alias("hi"), F.max("rest").alias("rest"), F.count("*").alias("c")).orderBy("grp").collect()  # at most pivots x SHELLS
    grp, lo, hi, rest, size = (np.array([r[i] for r in groups]) for i in range(5))
    ends = np.cumsum(size)
    block = (ends - size) // many  # neighbouring groups, until they have as many vectors
    summary = spark.sparkContext.broadcast((grp, lo, hi, rest, size, block))

    def bounds(m):
        grp, lo, hi, rest, _, _ = summary.value
        along, aside = _parts(m, shared.value[1])
        cell = grp // SHELLS
        most = np.maximum(along[:, cell] * lo, along[:, cell] * hi) + aside[:, cell] * rest
        return most + 1e-9 * np.abs(most) + 1e-3  # never below the exact bound by rounding

    def asked_groups(b, x, qid, theta, wants):
        """Rows (x, qid, theta, block, groups) of a slice's queries and the places of groups that they want, in order of both."""
        grp, block = summary.value[0], summary.value[5]
        row, g = wants
        new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (block[g][1:] != block[g][:-1])])) if len(row) else np.zeros(0, np.int64)
        at = pa.array(row[new])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([new, [len(row)]]).astype(np.int32)), pa.array(grp[g], pa.int64()))
        return pa.RecordBatch.from_arrays([x.take(at), qid.take(at), pa.array(theta[row[new]]), pa.array(block[g[new]], pa.int64()), lists], names=["x", "qid", "theta", "block", "groups"])

    def first(batches):
        size = summary.value[4]
        for whole in batches:
            for i in range(0, whole.num_rows, SLICE):
                b = whole.slice(i, SLICE)
                best = np.where(size >= k1, bounds(_matrix(b.column(0))), -np.inf).argmax(axis=1)
                yield asked_groups(b, b.column(0), b.column(1), np.full(len(best), -np.inf), (np.arange(len(best)), best))

    def others(batches):
        grp = summary.value[0]
        for whole in batches:
            for i in range(0, whole.num_rows, SLICE):
                b = whole.slice(i, SLICE)
                theta, was = b.column(2).to_numpy(), b.column(3).to_numpy()
                wants = np.nonzero((bounds(_matrix(b.column(0))) >= theta[:, None]) & (grp[None, :] != was[:, None]))
                yield asked_groups(b, b.column(0), b.column(1), theta, wants)

    def solve(left, right):
        a, b = _matrix(left.column("x"), np.int64), _matrix(right.column("y"), np.int64)
        asked_by = left.column("groups").combine_chunks()
        who, what = np.repeat(np.arange(len(a)), np.diff(asked_by.offsets.to_numpy())), asked_by.values.to_numpy()[asked_by.offsets[0].as_py() :]
        theta, held = left.column("theta").to_numpy(), right.column("grp").to_numpy()
        ids = right.column("ids").to_pylist()
        least = np.array([x[0] for x in ids], dtype=np.int64)
        found = [(np.zeros(0, np.int64),) * 3]  # query, score, vector
        for g in np.unique(held):
            rows, mine = np.flatnonzero(held == g), who[what == g]
            for i in range(0, len(mine), ROWS):
                some = mine[i : i + ROWS]
                scores = _scores(a[some], b[rows])
                # all vectors that may hold one of the k + 1 best rows: score not below the (k + 1)-th
                bound = np.partition(scores, -k1, axis=1)[:, -k1] if len(rows) > k1 else np.full(len(some), np.iinfo(np.int64).min)
                q_at, v_at = np.nonzero((scores >= bound[:, None]) & (scores >= theta[some][:, None]))
                found.append((some[q_at], scores[q_at, v_at].astype(np.int64), rows[v_at]))
        query, score, vector = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((least[vector], -score, query))
        query, score, vector = query[order], score[order], vector[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)  # a query's rows, best first
        keep = place < k1
        qid = left.column("qid").to_numpy()[query[keep]]
        return pa.table({"qid": pa.array(qid, pa.int64()), "score": pa.array(score[keep], pa.int64()), "ids": pa.array([ids[x] for x in vector[keep]], pa.list_(pa.int64()))})

    in_block = F.broadcast(spark.createDataFrame([(int(g), int(x)) for g, x in zip(grp, block, strict=True)], "grp long, block long"))
    blocked = placed.join(in_block, "grp").select("grp", "block", F.col("x").alias("y"), "ids")
    dealt = {}
    for g, c in zip(block.tolist(), size.tolist(), strict=True):
        dealt[g] = dealt.get(g, 0) + c
    dealt = F.broadcast(spark.createDataFrame([(g, -(-c // many)) for g, c in dealt.items()], "block long, v_parts int"))

    def met(sent: DataFrame) -> DataFrame:
        parts = F.broadcast(sent.groupBy("block").agg(F.ceil(F.count("*") / many).cast("int").alias("q_parts")))  # fewer rows than groups
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        left = sent.join(parts, "block").join(dealt, "block").select("block", "x", "qid", "theta", "groups", F.pmod(F.xxhash64("qid"), F.col("q_parts")).cast("int").alias("qp"), every("v_parts").alias("vp"))
        right = blocked.join(parts, "block").join(dealt, "block").select("block", "grp", "y", "ids", F.pmod(F.xxhash64("y"), F.col("v_parts")).cast("int").alias("vp"), every("q_parts").alias("qp"))
        keys = ["block", "qp", "vp"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(solve, "qid long, score long, ids array<long>")

    rows_sent = "x binary, qid long, theta double, block long, groups array<long>"
    start = stored(q.select("x", "qid").mapInArrow(first, rows_sent))
    near = stored(met(start))
    by_score = W.partitionBy("qid").orderBy(F.desc("score"))
    theta = near.select("qid", "score", F.row_number().over(by_score).alias("r")).filter(F.col("r") == k1).select("qid", F.col("score").cast("double").alias("at"))
    known = start.join(theta, "qid", "left").select("x", "qid", F.coalesce("at", F.lit(float("-inf"))).alias("theta"), F.get("groups", F.lit(0)).alias("grp"))
    sent = stored(known.mapInArrow(others, rows_sent))
    if report is not None:
        report.update(rows=n, queries=start.count(), groups=len(groups), replicated=start.count() + (sent.agg(F.sum(F.size("groups"))).first()[0] or 0), sent=start.count() + sent.count())
    found = near.unionByName(met(sent)).select("qid", "score", F.explode("ids").alias("vec_id"))
    best = W.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    merged = found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k1).select("qid", "vec_id", "score")
    # back from distinct query vectors to queries, without their own ids
    lists = merged.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("found"))
    who = start.select("x", "qid").join(lists, "qid")
    own = F.filter("found", lambda x: x["vec_id"] != F.col("id"))
    full = asked.join(who, "x").select("id", F.posexplode(F.slice(own, 1, k)).alias("p", "y"))
    return full.select(F.col("id").alias("query_id"), (F.col("p") + 1).cast("int").alias("rank"), F.col("y.vec_id").alias("vec_id"), (-F.col("y.s")).alias("score"))


def op3(spark, sf_dir):
    rows = integer_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).select(F.col("vec_id").alias("id"), "v")
    return knn_join(rows.filter(F.col("id") % 50 == 0), rows)


OP3_SQL = f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id, CAST(list_dot_product(q.v, e.v) AS BIGINT) AS score FROM e q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {K}
"""
