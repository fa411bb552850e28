"""N-gram Jaccard join by a token-group matrix: classes of documents that link when their shingle sets are similar.

Sets: distinct w-word shingles (fewer words: the whole sequence), as 64-bit hashes; a shingle is a token. Two documents
link when den * |A n B| >= num * |A u B|. The result is the connected components of all links, exactly. Equal sets are
one node. A node of n tokens may miss at most ``allowed`` = n - ceil(num * n / den) of them in any partner.

1. Bound against everything else: all nodes send their tokens in one range of the hash space (a share of 1.45 times what
   may be missed). A node of which more than ``allowed`` of these occur in no other node links with nothing; mostly nine
   of ten end here. Only the others' sets are written, once.
2. Groups of similar documents: in each of a few rounds every node proposes two hubs among the nodes of its min-hash
   buckets, the one that comes up most often and the one with the fewest tokens of its own; exact overlaps decide, and a
   node that links with a hub is represented by it from then on. Linked nodes are a group.
3. Token-group matrix: the tokens of each group. A node whose tokens, but for more than ``allowed``, occur in its own
   group only is done: first by the tokens of the range, then by all, again while that shuts out many.
4. Query against group: of a node that is left, the tokens that other groups have too are ordered by how many groups hold
   them, rarest first. So many of the first must be in the group's union as any partner there shares with it; the
   sizes must fit, and the tokens that only one of the two sides has may not be more than links allow. Only groups that
   qualify are opened: their nodes, in blocks of similar numbers of tokens of their own, with the same bounds by block,
   are compared with the node until one links (a group is linked already, so one is enough).
5. Components of all links; the class id is the least doc_id.

Nothing is collected; hubs and blocks with any number of nodes to compare are dealt in parts; tokens of any frequency are
counted by partial aggregates; no number of partners or candidates is limited.

Nulls and odd values: null texts and texts without words have no tokens and link with nothing (component_id is doc_id).
Repeated rows are equal sets: one class. Rows that share an id with different texts are documents of their own. Rows
without an id take part like others; a class of such rows alone has component_id null. Very long texts are whole. Empty
tables give an empty result. Extra columns are ignored, but those named in ``carry`` come along.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ledgerloom.llm.common import SPACE, Scratch, give_back, small, table
from ledgerloom.llm.components import connected_components
from ledgerloom.llm.pieces import mixed
from ledgerloom.llm.shingles import shingle_sets

#: Near duplicates: five words, four fifths. op8's contract has values of its own.
WIDTH, NUM, DEN = 5, 80, 100
OP8 = {"width": 4, "num": 85, "den": 100}
#: Share of the hash space in the first bound, as a multiple of what may be missed.
RANGE = 1.45
ROUNDS, BANDS, ROWS = 2, 8, 3
PIVOT_BANDS, PIVOT_ROWS = 16, 2
#: Differences from its pivot by which a node finds others that share them.
STAR_KEYS = 16
#: Nodes of one task against a hub or block; nodes of a block; classes of own tokens by which blocks are cut.
FOLLOWERS, BLOCK, SHADES = 200, 256, 8
#: Texts whose sets are made at once.
AT_ONCE = 1000
#: Tokens beyond those that may be missed by which a node looks for groups, and most passes over all tokens.
MORE, PASSES = 2, 2

_U = np.uint64


def node_of(tokens: np.ndarray) -> int:
    """The set's 64-bit digest as a signed number."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _set(packed: pa.Scalar) -> np.ndarray:
    return np.frombuffer(packed.as_buffer(), dtype=np.uint64)


def _below(share: float) -> np.uint64:
    return _U(min(2**64 - 1, int(share * 2**64)))


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Common elements of sorted arrays without repeats."""
    if len(x) > len(y):
        x, y = y, x
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0


def overlaps(x: np.ndarray, tokens: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
    """Common elements of x with each of n sets, given as sorted tokens and the sets that own them."""
    lo, hi = np.searchsorted(tokens, x), np.searchsorted(tokens, x, "right")
    many = hi - lo
    at = np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
    return np.bincount(owners[at], minlength=n)


def _allowed(num, den) -> Column:
    """A node of n tokens may miss at most so many in a partner."""
    return F.expr(f"n * {den - num} div {den}")


def _tidy(run):
    """run of two tables, after which free memory goes back to the system."""

    def tidy(left, right):
        out = run(left, right)
        give_back(every=0.2)
        return out

    return tidy


def scan(docs: DataFrame, width: int, share: float, carry=()) -> DataFrame:
    """(doc_id, carry, n, node, tokens in the range) of docs(doc_id, text)."""
    limit, k = _below(share), 1 + len(carry)

    def run(batches):
        for batch in (whole.slice(i, AT_ONCE) for whole in batches for i in range(0, whole.num_rows, AT_ONCE)):
            ns, nodes, tokens = [], [], []
            for x in shingle_sets(batch.column(k), width):
                ns.append(len(x))
                nodes.append(node_of(x) if len(x) else None)
                tokens.append(x[: np.searchsorted(x, limit)].view(np.int64))
            lengths = np.concatenate([[0], np.cumsum([len(x) for x in tokens])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate([*tokens, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:k], pa.array(ns, pa.int64()), pa.array(nodes, pa.int64()), lists], names=[*batch.schema.names[:k], "n", "node", "tokens"]
            )
            del x, ns, nodes, tokens, lengths, lists
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carry, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{schema}, n long, node long, tokens array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """wanted(node, first_id, n, own) with the packed set of each node, from the texts of its first document."""

    def run(batches):
        for batch in batches:
            keep, packed = [], []
            for i, (node, x) in enumerate(zip(batch.column(0).to_pylist(), shingle_sets(batch.column(3), width), strict=True)):
                if len(x) and node_of(x) == node:  # else another document of the same id
                    keep.append(i)
                    packed.append(x.tobytes())
            own = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns[:3], pa.array(packed, pa.binary())], names=["node", "n", "own", "x"])
            del keep, packed, own
        give_back()

    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), "text")
    rows = texts.join(small(wanted), F.col("_id").eqNullSafe(F.col("first_id")))
    return rows.select("node", "n", "own", "text").mapInArrow(run, "node long, n long, own long, x binary")


# groups by hubs


def _band_keys(x: np.ndarray, turn: int, bands: int, rows: int) -> list[int]:
    seeds = mixed(np.arange(bands * rows, dtype=np.uint64) + _U(turn * 1000 + 1)) | _U(1)
    low = np.full(len(seeds), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(x), 20_000):
        low = np.minimum(low, mixed(x[None, i : i + 20_000] * seeds[:, None]).min(axis=1))
    out = mixed(np.arange(bands, dtype=np.uint64) + _U(turn * 1000))
    for row in low.reshape(bands, rows).T:
        out = mixed(out * _U(0x9E3779B97F4A7C15) + row)
    return out.view(np.int64).tolist()


def _buckets(sets: DataFrame, turn: int, bands=BANDS, rows=ROWS) -> DataFrame:
    """(node, rank, key): a node's min-hash buckets; rank orders nodes by their share of own tokens."""

    def run(batches):
        for batch in batches:
            keys = [k for x in batch.column(2) for k in _band_keys(_set(x), turn, bands, rows)]
            at = pa.array(np.repeat(np.arange(batch.num_rows), bands))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(keys, pa.int64())], names=["node", "rank", "key"])
        give_back()

    return sets.select("node", F.expr("own * 1000 div n").alias("rank"), "x").mapInArrow(run, "node long, rank long, key long")


def _dealt(pairs: DataFrame, by: str, many: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """pairs(node, by) with a part of at most about ``many`` rows, and (by, part) for all parts."""
    counts = scratch.cut(pairs.groupBy(by).agg(F.ceil(F.count("*") / many).cast("int").alias("parts")))
    dealt = scratch.cut(pairs.join(small(counts), by).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).drop("parts"))
    return dealt, counts.select(by, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))


def follow_hubs(sets: DataFrame, buckets: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) of nodes a to hubs b, verified by sets(node, x), over buckets(node, rank, key): the hub of a bucket is its
    node of least rank; of its buckets' hubs a node tries that of least rank and the one that comes up most often."""
    hubs = buckets.groupBy("key").agg(F.min(F.struct("rank", "node")).alias("hub"), F.count("*").alias("c")).filter("c > 1").drop("c")
    votes = buckets.join(hubs, "key").filter("hub.node <> node").groupBy("node", "hub").agg(F.count("*").alias("c"))
    best = votes.groupBy("node").agg(F.min("hub").alias("least"), F.min_by("hub", F.struct(-F.col("c"), "hub")).alias("most"))
    pairs = scratch.cut(best.select("node", F.explode(F.array_distinct(F.array("least.node", "most.node"))).alias("hub")))
    dealt, parts = _dealt(pairs, "hub", FOLLOWERS, scratch)

    def run(left, right):
        hub, out = {}, []
        for b, y in zip(right.column("hub").to_pylist(), right.column("y"), strict=True):
            hub[b] = _set(y)
        for a, b, x in zip(left.column("node").to_pylist(), left.column("hub").to_pylist(), left.column("x"), strict=True):
            x, y = _set(x), hub[b]
            if min(len(x), len(y)) * den >= max(len(x), len(y)) * num:
                both = overlap(x, y)
                if den * both >= num * (len(x) + len(y) - both):
                    out.append((a, b))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    x = sets.select("node", "x")
    left = x.join(small(dealt), "node").select("hub", "part", "node", "x")
    right = sets.select(F.col("node").alias("hub"), F.col("x").alias("y")).join(small(parts), "hub").select("hub", "part", "y")
    return scratch.cut(left.groupBy("hub", "part").cogroup(right.groupBy("hub", "part")).applyInArrow(_tidy(run), "a long, b long"))


# the token-group matrix


def tokens_of(members: DataFrame, share: float | None) -> DataFrame:
    """(token, node, family) of members(node, family, x), for the tokens of the range or all."""
    limit = None if share is None else _below(share)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                b = batch.slice(i, 200)
                sets = [_set(x) for x in b.column(2)]
                sets = sets if limit is None else [x[: np.searchsorted(x, limit)] for x in sets]
                at = pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets]))
                tokens = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(tokens), b.column(0).take(at), b.column(1).take(at)], names=["token", "node", "family"])
                del sets, at, tokens
        give_back()

    return members.select("node", "family", "x").mapInArrow(run, "token long, node long, family long")


def _spanning(tokens: DataFrame) -> DataFrame:
    """Tokens that more than one group has."""
    return tokens.groupBy("token").agg(F.min("family").alias("lo"), F.max("family").alias("hi")).filter("lo <> hi").select("token", F.lit(1).alias("shared"))


def still_open(members: DataFrame, share: float | None, num: int, den: int) -> DataFrame:
    """(node, n, family, missing) of the members whose tokens occur in other groups, but for at most those that may be missed."""
    tokens = tokens_of(members, share)
    own = tokens.join(_spanning(tokens), "token", "left").groupBy("node").agg((F.count("*") - F.count("shared")).alias("missing"))
    return members.select("node", "n", "family").join(own, "node", "left").withColumn("missing", F.coalesce("missing", F.lit(0))).filter(F.col("missing") <= _allowed(num, den))


def differences(sets: DataFrame, chosen: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """chosen(node, n, family, missing) with its pivot, the pivot's size, whether both link (near), and diff, the tokens that
    only one of them has, hashed with the pivot and the side. The pivot is, of a node's min-hash buckets, the node that misses
    the smallest share of its tokens elsewhere: in a cluster of copies the text that the others are made from, if it is there."""
    own = sets.select("node", "n", "x").join(small(chosen.select("node", F.col("missing").alias("own"))), "node")
    buckets = scratch.stored(_buckets(own, ROUNDS, PIVOT_BANDS, PIVOT_ROWS))
    hubs = buckets.groupBy("key").agg(F.min(F.struct("rank", "node")).alias("hub"))
    pivots = scratch.cut(buckets.join(hubs, "key").groupBy("node").agg(F.min("hub").alias("hub")).select("node", F.col("hub.node").alias("hub")))
    dealt, parts = _dealt(pivots, "hub", FOLLOWERS, scratch)
    fields = [("node", pa.int64()), ("hub", pa.int64()), ("hub_n", pa.int64()), ("near", pa.bool_()), ("diff", pa.list_(pa.int64()))]

    def run(left, right):
        hub = {b: _set(y) for b, y in zip(right.column("hub").to_pylist(), right.column("y"), strict=True)}
        rows = []
        for a, b, x in zip(left.column("node").to_pylist(), left.column("hub").to_pylist(), left.column("x"), strict=True):
            x, y = _set(x), hub[b]
            sides = np.setdiff1d(x, y, assume_unique=True), np.setdiff1d(y, x, assume_unique=True)
            both = len(x) - len(sides[0])
            pivot = np.array([b], dtype=np.int64).view(np.uint64)
            diff = [mixed(side + mixed(pivot + _U(i)) * _U(0x9E3779B97F4A7C15)) for i, side in enumerate(sides)]
            rows.append((a, b, len(y), den * both >= num * (len(x) + len(y) - both), np.concatenate(diff).view(np.int64)))
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
        return pa.table({name: pa.array(c, kind) for (name, kind), c in zip(fields, columns, strict=True)})

    left = sets.select("node", "x").join(small(dealt), "node").select("hub", "part", "node", "x")
    right = sets.select(F.col("node").alias("hub"), F.col("x").alias("y")).join(small(parts), "hub").select("hub", "part", "y")
    found = left.groupBy("hub", "part").cogroup(right.groupBy("hub", "part")).applyInArrow(_tidy(run), "node long, hub long, hub_n long, near boolean, diff array<long>")
    return scratch.stored(found.join(small(chosen.drop("missing")), "node").withColumnRenamed("hub", "pivot"))


def in_blocks(differing: DataFrame, scratch: Scratch) -> DataFrame:
    """differing without diff, with d, the number of differences, and block: nodes of one family and pivot, of about the
    same share of differences."""
    shaded = differing.withColumn("d", F.size("diff").cast("long")).drop("diff").withColumn("shade", F.expr(f"least(d * {2 * SHADES} div (n + 1), {SHADES})"))
    keys = ["pivot", "family", "shade"]
    sized = shaded.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    block = F.xxhash64(*keys, F.pmod(F.xxhash64("node"), F.col("blocks")))
    return scratch.stored(shaded.join(small(sized), keys).withColumn("block", block).drop("shade", "blocks"))


def open_blocks(tokens: DataFrame, nodes: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """(node, block): the blocks that a node of nodes(node, n, size, rank, may_miss, family, side, block) must be compared
    with, by tokens(token, node, family), where family is the nodes' side: only blocks of other sides count.

    Of a node's ``size`` tokens at most may_miss are missing in a partner of at least its rank."""
    held = tokens.join(small(nodes.select("node", "block")), "node")
    rare = held.groupBy("token", "block").agg(F.first("family").alias("family")).groupBy("token")
    rare = rare.agg(F.min("family").alias("lo"), F.max("family").alias("hi"), F.count("*").alias("groups")).filter("lo <> hi").select("token", "groups")
    spread = scratch.stored(held.join(rare, "token").select("token", "node", "block", "groups"))
    counts = spread.groupBy("node").agg(F.count("*").alias("c"))
    state = nodes.join(counts, "node", "left").withColumn("c", F.coalesce("c", F.lit(0))).withColumn("own", F.col("size") - F.col("c"))
    # tokens that only one of two linked nodes has are at most n * (den - num) / num
    state = scratch.stored(state.filter(F.col("own") * num <= F.col("n") * (den - num)))
    bounds = state.groupBy("block").agg(
        F.first("family").alias("family_"), F.first("side").alias("side_"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("own").alias("least"),
        F.max("rank").alias("top"), F.min("c").alias("c_lo"), F.max("c").alias("c_hi"), F.min("size").alias("size_lo"),
    )
    bounds = scratch.cut(bounds)
    matrix = spread.join(small(state.select("node")), "node", "left_semi").select("token", "block").distinct()
    spare = F.col("may_miss") - F.col("own")
    order = F.row_number().over(W.partitionBy("node").orderBy("groups", "token"))
    asked = (
        spread.drop("block").join(small(state.filter(spare >= 0)), "node").withColumn("r", order).filter(F.col("r") <= spare + MORE)
        .select("token", "node", "n", "rank", "size", "own", "c", "family", "side", F.least("c", spare + MORE).alias("sent"), (F.least("c", spare + MORE) - spare).alias("need"))
    )
    groups = matrix.join(small(bounds), "block").withColumnRenamed("token", "held")
    most = F.floor((F.col("n") + F.least("hi", F.col("n") * den / num)) * (den - num) / (den + num) + 1e-6)
    sizes = (F.col("top") >= F.col("rank")) & (F.col("lo") * num <= F.col("n") * den) & (F.col("hi") * den >= F.col("n") * num)
    others = (F.col("family") != F.col("family_")) & (F.col("side") != F.col("side_"))
    # tokens that only one of the two has: those that no other family has, and by how much the numbers of the others differ
    apart = F.col("own") + F.col("least") + F.greatest(F.lit(0), F.col("c") - F.col("c_hi"), F.col("c_lo") - F.col("c"))
    met = asked.join(groups, (F.col("token") == F.col("held")) & others & sizes & (apart <= most))
    # of the tokens sent, all but those that the node may miss in the block: both have at least (size + size_lo - most) / 2
    here = F.col("sent") - F.col("c") + F.ceil((F.col("size") + F.col("size_lo") - most) / 2)
    met = met.groupBy("node", "block", F.greatest("need", here).alias("need")).agg(F.count("*").alias("met"))
    return scratch.cut(met.filter("met >= need").select("node", "block"))


def compare(sets: DataFrame, pairs: DataFrame, placed: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) between nodes and the blocks opened for them, one for each block at most."""
    dealt, parts = _dealt(pairs, "block", FOLLOWERS, scratch)

    def run(left, right):
        out = []
        if left.num_rows and right.num_rows:
            nodes, members = right.column("member").to_pylist(), [_set(y) for y in right.column("y")]
            sizes = np.array([len(y) for y in members])
            tokens, owners = np.concatenate(members), np.repeat(np.arange(len(members)), sizes)
            order = np.argsort(tokens, kind="stable")
            tokens, owners = tokens[order], owners[order]
            for a, x in zip(left.column("node").to_pylist(), left.column("x"), strict=True):
                x = _set(x)
                both = overlaps(x, tokens, owners, len(members))
                hit = np.flatnonzero(den * both >= num * (len(x) + sizes - both))
                if len(hit):
                    out.append((a, nodes[hit[0]]))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    left = sets.select("node", "x").join(small(dealt), "node").select("block", "part", "node", "x")
    held = scratch.cut(placed.select(F.col("node").alias("member"), "block").join(small(parts), "block"))
    right = sets.select(F.col("node").alias("member"), F.col("x").alias("y")).join(small(held), "member").select("block", "part", "member", "y")
    return scratch.cut(left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(_tidy(run), "a long, b long"))


def links_between(packed: DataFrame, chosen: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) between different families of chosen(node, n, family)."""
    theta = (den - num) / (den + num)
    differing = differences(packed, chosen, num, den, scratch)
    # stars: nodes of one pivot that share differences follow the one of them that differs least
    stars = differing.filter("near AND node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    rest = differing
    for ascending in (True, False):
        some = F.slice(F.sort_array("diff", ascending), 1, STAR_KEYS)
        buckets = scratch.stored(rest.select("node", F.size("diff").cast("long").alias("rank"), F.explode(some).alias("key")))
        found = follow_hubs(packed.select("node", "x"), buckets, num, den, scratch)
        stars = stars.unionByName(found)
        rest = rest.join(small(scratch.cut(found.select(F.col("a").alias("node")).distinct())), "node", "left_anti")
    stars = scratch.cut(stars)
    joined = scratch.cut(connected_components(by_family(stars, chosen)).select(F.col("node").alias("family"), F.col("component").alias("to")))
    differing = scratch.stored(differing.join(small(joined), "family", "left").withColumn("family", F.coalesce("to", "family")).drop("to"))
    placed = in_blocks(differing, scratch)
    # nodes of one pivot, by their differences from it: of two that link and don't both link with the pivot, the one
    # with fewer differences shares at least so many of them
    twice = F.when(F.col("near"), F.col("d") + 1 + F.floor((F.col("hub_n") - F.col("n")) * theta - 1e-6)).otherwise(2 * F.col("d") - F.floor(F.col("n") * (theta * (1 + den / num)) + 1e-6))
    shared = F.greatest(F.ceil(twice / 2), F.lit(1))
    nodes = placed.select("node", "n", F.col("d").alias("size"), F.col("d").alias("rank"), (F.col("d") - shared).alias("may_miss"), "family", F.col("node").alias("side"), "block")
    tokens = differing.select(F.explode("diff").alias("token"), "node", "family")
    opened = open_blocks(tokens, nodes, num, den, scratch)
    # nodes of different pivots, by their tokens
    apart = placed.select("node", "n", F.col("pivot").alias("family"))
    apart = scratch.stored(still_open(packed.select("node", "x").join(small(apart), "node"), None, num, den))
    chosen_again = placed.join(small(apart.select("node")), "node", "left_semi")
    nodes = chosen_again.select("node", "n", F.col("n").alias("size"), F.col("n").alias("rank"), _allowed(num, den).alias("may_miss"), "family", F.col("pivot").alias("side"), "block")
    tokens = tokens_of(packed.select("node", "x").join(small(apart.select("node", "family")), "node"), None)
    opened = opened.unionByName(open_blocks(tokens, nodes, num, den, scratch)).distinct()
    far = compare(packed, scratch.cut(opened), placed, num, den, scratch)
    return far.unionByName(stars)


def by_family(found: DataFrame, chosen: DataFrame) -> DataFrame:
    """Links (a, b) of nodes as links of the families that chosen(node, family) names; others are families of their own."""
    for end in ("a", "b"):
        found = found.join(small(chosen.select(F.col("node").alias(end), F.col("family").alias("to"))), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    return found


def links(docs: DataFrame, seen: DataFrame, sets: DataFrame, width: int, num: int, den: int, scratch: Scratch) -> DataFrame:
    """(node, class) for every node that links with another one; class is the least node of the component."""
    share = min(1.0, RANGE * (den - num) / den)
    able = F.col("n") * (den - num) >= num  # smaller sets link with equal ones only
    sent = seen.filter(able).select("node", F.explode("tokens").alias("token"))
    lone = sent.groupBy("token").agg(F.min("node").alias("node"), F.max("node").alias("hi")).filter("node = hi").groupBy("node").agg(F.count("*").alias("own"))
    alive = scratch.stored(
        sets.filter(able).join(lone, "node", "left").select("node", "first_id", "n", F.coalesce("own", F.lit(0)).alias("own")).filter(F.col("own") <= _allowed(num, den))
    )
    if alive.isEmpty():
        return scratch.stored(alive.select("node", F.col("node").alias("class")))
    packed = scratch.stored(sets_of(docs, alive, width))
    if packed.count() > alive.count():  # rows that share an id and a text
        packed = scratch.stored(packed.dropDuplicates(["node"]))

    near, rest, left = None, packed, packed.count()
    for turn in range(ROUNDS):
        found = follow_hubs(rest, scratch.stored(_buckets(rest, turn)), num, den, scratch)
        near = found if near is None else near.unionByName(found)
        gone = scratch.cut(near.select(F.col("a").alias("node")).distinct())
        rest = packed.join(small(gone), "node", "left_anti")
        now = packed.count() - gone.count()
        if left - now <= left // 100:
            break
        left = now
    family = scratch.cut(connected_components(near))

    def members(chosen: DataFrame) -> DataFrame:
        return packed.select("node", "x").join(small(chosen), "node")

    chosen = scratch.stored(packed.select("node", "n").join(small(family.withColumnRenamed("component", "family")), "node", "left").withColumn("family", F.coalesce("family", "node")))
    many = chosen.count()
    for turn in range(PASSES if many else 0):
        chosen = scratch.stored(still_open(members(chosen), None if turn else share, num, den))
        before, many = many, chosen.count()
        if not many or turn and many > before * 0.9:
            break
    out = family
    if many:
        joined = scratch.cut(connected_components(by_family(links_between(packed, chosen, num, den, scratch), chosen)))
        alone = joined.select("node", F.col("node").alias("component")).join(small(family), "node", "left_anti")
        out = family.unionByName(alone).join(small(joined.select(F.col("node").alias("component"), F.col("component").alias("to"))), "component", "left")
        out = out.select("node", F.coalesce("to", "component").alias("component"))
    return scratch.stored(out.withColumnRenamed("component", "class"))


def classes(docs: DataFrame, width=WIDTH, num=NUM, den=DEN, carry=()) -> DataFrame:
    """doc_id, carry, n_shingles, component_id, class for every row of docs(doc_id, text). class, a number, tells classes
    apart even where doc_ids don't; it is null for rows without words."""
    scratch = Scratch(docs.sparkSession)
    seen = scratch.stored(scan(docs, width, min(1.0, RANGE * (den - num) / den), carry))
    sets = scratch.stored(seen.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.count("*").alias("rows")))
    linked = links(docs, seen, sets, width, num, den, scratch)
    least = linked.join(sets.select("node", "first_id"), "node").groupBy("class").agg(F.min("first_id").alias("component_id"))
    more = linked.join(least, "class").select("node", "class", "component_id")
    same = sets.filter("rows > 1").join(small(linked.select("node")), "node", "left_anti").select("node", F.col("node").alias("class"), F.col("first_id").alias("component_id"))
    known = scratch.stored(more.unionByName(same))
    out = seen.drop("tokens").join(small(known), "node", "left")
    scratch.clear(keep=(seen, known))
    one = F.col("class").isNull()
    return out.select(
        "doc_id", *carry, F.col("n").alias("n_shingles"), F.when(one, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("class", "node").alias("class")
    )


def op8(spark, sf_dir):
    return classes(table(spark, sf_dir, "documents"), **OP8).drop("class")


OP8_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{SPACE}]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {OP8["width"] - 1}], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {OP8["width"] - 2}, least(len(w), 1) + 1))) AS i FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
inter AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM inter JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE {OP8["den"]} * c >= {OP8["num"]} * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.b)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
"""
