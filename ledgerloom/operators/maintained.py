"""Decisions that are kept up to date: a versioned result store, an index from nodes to decisions, and scope hashes.

A snapshot is receivables, payments, agreements and settings. ``decide`` is a function of each group's rows, so a batch of
changes asks for the groups that it can have touched and no others:

1. changed records and documents reach decisions through the index, the closure of their provenance edges;
2. each group's scopes (its receivables, payments, agreements; the settings) are hashed on the new snapshot and compared
   with the hashes that the decisions saw, which finds inserted and vanished records and whatever a feed left out;
3. groups that are new or gone;
4. groups that the feed names, if it does: a record that no decision has seen, or that is gone already, reaches none by the index.

What cannot be reasoned about asks for everything: a change of an unknown entity, or a decision without index rows.
Results, index and scopes are stored by group; a batch replaces the groups it recomputed, in all three, and a batch that is
run again changes nothing."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ledgerloom.operators import rules
from ledgerloom.plans import ledger as v
from ledgerloom.plans.graph import Room
from ledgerloom.registry import query
from ledgerloom.sources.files import scratch
from ledgerloom.sources.store import Batches

#: Entities whose changes the index and the scopes can follow.
TRACKED = ("receivable", "payment", "agreement", "document", "config")
#: A receivable without an agreement falls due after so many days.
TERM = 60

RECEIVABLES = "id string, grp string, document string, amount long, issued date, reference string"
PAYMENTS = "id string, grp string, amount long, day date, reference string"
AGREEMENTS = "id string, grp string, valid_from date, valid_to date, term_days int"
DECISIONS = "grp string, decision string, status string, due date, paid long, open long, delay_days int, interest long, inputs string"


@dataclass(frozen=True)
class Snapshot:
    receivables: DataFrame
    payments: DataFrame
    agreements: DataFrame
    rate_milli: int = 155
    as_of: str = v.AS_OF
    stored: bool = False

    def of(self, groups: DataFrame) -> Snapshot:
        """The rows of groups(grp)."""
        return replace(self, stored=False, **{n: getattr(self, n).join(groups, "grp", "left_semi") for n in ("receivables", "payments", "agreements")})

    def written(self, room: Room) -> Snapshot:
        """The same rows, computed once; those that are written already are left."""
        return self if self.stored else replace(self, stored=True, **{n: room.cut(getattr(self, n)) for n in ("receivables", "payments", "agreements")})

    def config(self) -> str:
        return f"{self.rate_milli}|{self.as_of}"


def allocations(s: Snapshot) -> DataFrame:
    """(rid, grp, pid, applied, day): payments by (day, id) against the receivable of their group that they name, while its
    amount lasts."""
    r = s.receivables.select("grp", "reference", F.col("id").alias("rid"), "amount").filter("reference <> '' AND amount > 0")
    p = s.payments.select("grp", "reference", F.col("id").alias("pid"), F.col("amount").alias("paid"), "day").filter("paid > 0")
    before = F.coalesce(F.sum("paid").over(W.partitionBy("rid").orderBy("day", "pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    applied = F.least(F.col("paid"), F.col("amount") - before).cast("long")
    return r.join(p, ["grp", "reference"]).select("rid", "grp", "pid", "day", applied.alias("applied")).filter("applied > 0")


def terms(s: Snapshot) -> DataFrame:
    """(rid, aid, term_days) of agreements of the receivable's group in force when it was issued; open ends by null."""
    a = s.agreements.select("grp", F.col("id").alias("aid"), "valid_from", "valid_to", "term_days")
    inside = (F.col("valid_from").isNull() | (F.col("issued") >= F.col("valid_from"))) & (F.col("valid_to").isNull() | (F.col("issued") <= F.col("valid_to")))
    return s.receivables.select("grp", F.col("id").alias("rid"), "issued").join(a, "grp").filter(F.col("issued").isNull() | inside).select("grp", "rid", "aid", "term_days")


def decided(s: Snapshot, legs: DataFrame, agreed: DataFrame) -> DataFrame:
    """DECISIONS of a snapshot with its allocations and terms, group by group.

    Each allocation is a tranche with interest from the due date to its day, what is left open one to ``as_of``. Agreements with
    different terms are a CONFLICT, a receivable without a date is INSUFFICIENT; neither has a due date."""
    term = agreed.groupBy(F.col("rid").alias("id")).agg(F.count_distinct("term_days").alias("n_terms"), F.min("term_days").alias("term"), F.sum(F.xxhash64("aid", "term_days").cast("decimal(38,0)")).alias("a_hash"))
    x = s.receivables.join(term, "id", "left").withColumn("conflict", F.coalesce(F.col("n_terms") > 1, F.lit(False)))
    x = x.withColumn("due", F.when(~F.col("conflict"), F.date_add("issued", F.coalesce("term", F.lit(TERM)))))
    late = F.greatest(F.datediff("day", "due"), F.lit(0))
    cost = lambda amount, days: rules.interest(F.col(amount), days, F.lit(s.rate_milli), F.lit(365))
    t = legs.withColumnRenamed("rid", "id").join(x.select("id", "due"), "id")
    t = t.groupBy("id").agg(
        F.sum("applied").cast("long").alias("paid"), F.max(late).alias("leg_delay"), F.sum(cost("applied", late)).cast("long").alias("leg_interest"),
        F.sum(F.xxhash64("pid", "applied", "day").cast("decimal(38,0)")).alias("p_hash"),
    )
    x = x.join(t, "id", "left").fillna(0, ["paid"]).withColumn("open", F.col("amount") - F.col("paid"))
    rest = F.greatest(F.datediff(F.lit(s.as_of).cast("date"), "due"), F.lit(0))
    delay = F.when(F.col("due").isNotNull(), F.greatest(F.coalesce("leg_delay", F.lit(0)), F.when(F.col("open") > 0, rest).otherwise(0)))
    total = F.when(F.col("due").isNotNull(), F.coalesce("leg_interest", F.lit(0)) + cost("open", rest))
    status = F.when(F.col("conflict"), "CONFLICT").when(F.col("issued").isNull(), "INSUFFICIENT").when(F.col("open") <= 0, "MATCHED").when(F.col("paid") > 0, "PARTIAL").otherwise("UNMATCHED")
    seen = F.sha2(F.concat_ws("|", "id", "amount", F.coalesce(F.col("issued").cast("string"), F.lit("-")), F.coalesce(F.col("a_hash").cast("string"), F.lit("-")), F.coalesce(F.col("p_hash").cast("string"), F.lit("-")), F.lit(s.config())), 256)
    return x.select("grp", F.col("id").alias("decision"), status.alias("status"), "due", "paid", "open", delay.cast("int").alias("delay_days"), total.cast("long").alias("interest"), seen.alias("inputs"))


def _name(kind: str, col: str):
    return F.concat(F.lit(f"{kind}:"), F.col(col))


def _edges(s: Snapshot, legs: DataFrame, agreed: DataFrame) -> DataFrame:
    """(grp, src, dst): documents lead to receivables, these, payments and agreements to computations, and those to decisions."""
    name, edge = _name, lambda df, a, b: df.select("grp", a.alias("src"), b.alias("dst"))
    return (
        edge(s.receivables.filter("document IS NOT NULL"), name("document", "document"), name("receivable", "id"))
        .unionByName(edge(s.receivables, name("receivable", "id"), name("comp", "id"))).unionByName(edge(s.receivables, name("comp", "id"), name("dec", "id")))
        .unionByName(edge(legs, name("payment", "pid"), name("comp", "rid"))).unionByName(edge(agreed, name("agreement", "aid"), name("comp", "rid")))
    )


def rests(s: Snapshot, legs: DataFrame, agreed: DataFrame) -> DataFrame:
    """(grp, target, node) of each decision: the closure of its edges. No walk has more than three steps, and each node's place is
    known, so it takes no rounds: a receivable's decision rests on its own computation, record and document, and its legs and terms."""
    own = s.receivables.select("grp", "id", F.explode(F.array_compact(F.array(_name("comp", "id"), _name("receivable", "id"), _name("document", "document")))).alias("node"))
    own = own.unionByName(legs.select("grp", F.col("rid").alias("id"), _name("payment", "pid").alias("node"))).unionByName(agreed.select("grp", F.col("rid").alias("id"), _name("agreement", "aid").alias("node")))
    return own.select("grp", _name("dec", "id").alias("target"), "node")


def decide(s: Snapshot, room: Room) -> tuple[DataFrame, DataFrame]:
    """(decisions, edges(grp, src, dst)) of a snapshot, with what both need computed once."""
    legs, agreed = room.cut(allocations(s)), room.cut(terms(s))
    return decided(s, legs, agreed), _edges(s, legs, agreed)


def scopes(s: Snapshot) -> DataFrame:
    """(grp, scope): what each group's rows and the settings look like; in no order, so nothing is gathered or sorted.

    Two 64-bit hashes of each row (nulls marked, the table named) are added up by halves, which no number of rows overflows; all
    three tables go through one grouping."""
    rows = None
    for i, (part, columns) in enumerate(((s.receivables, ("id", "document", "amount", "issued", "reference")), (s.payments, ("id", "amount", "day", "reference")), (s.agreements, ("id", "valid_from", "valid_to", "term_days")))):
        marked = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
        one = part.select("grp", F.lit(i).alias("i"), *[F.xxhash64(F.lit(i * 2 + k), *marked).alias(f"h{k}") for k in range(2)])
        rows = one if rows is None else rows.unionByName(one)
    low, high = lambda k: F.col(f"h{k}").bitwiseAND(F.lit(0xFFFFFFFF)), lambda k: F.shiftrightunsigned(f"h{k}", 32)
    counts = [F.count_if(F.col("i") == i).alias(f"n{i}") for i in range(3)]
    x = rows.groupBy("grp").agg(*counts, *[F.sum(half(k)).alias(f"{name}{k}") for k in range(2) for name, half in (("low", low), ("high", high))])
    x = x.filter("n0 > 0")  # a group is one that has receivables
    return x.select("grp", F.concat_ws("/", *x.columns[1:], F.lit(s.config())).alias("scope"))


class Maintained:
    """Decisions of a snapshot that moves on by batches of changes(entity, id), with the record's grp where the feed knows it."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, path = spark, path or scratch(spark)
        self.decisions = Batches(spark, f"{path}/decisions", "grp", DECISIONS)
        self.index = Batches(spark, f"{path}/index", "grp", "grp string, target string, node string")
        self.scopes = Batches(spark, f"{path}/scopes", "grp", "grp string, scope string")

    def plan(self, changes: DataFrame, s: Snapshot, room: Room) -> tuple[DataFrame, DataFrame, bool]:
        """(affected(grp, reason), new scopes(grp, scope), whether all groups are asked for)."""
        fresh, changes = room.cut(scopes(s)), room.cut(changes)
        unknown = changes.filter(~F.coalesce(F.col("entity").isin(*TRACKED), F.lit(False))).select(F.lit(1))
        if self.empty():
            return fresh.select("grp", F.lit("new").alias("reason")), fresh, not unknown.isEmpty()
        old, index = self.scopes.read(), self.index.read()
        have = self.decisions.read().select("grp", _name("dec", "decision").alias("target"))
        own = index.filter(F.col("node") == F.concat(F.lit("comp:"), F.expr("substring(target, 5)"))).select("target")  # one row a decision
        bare = have.join(own, "target", "left_anti").select(F.lit(1))
        full = not unknown.unionAll(bare).limit(1).isEmpty()
        gone_or_other = fresh.withColumnRenamed("scope", "b").join(old.withColumnRenamed("scope", "a"), "grp", "full_outer")
        moved = gone_or_other.filter("NOT a <=> b").select("grp", F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "gone").otherwise("scope").alias("reason"))
        if full:
            return moved.unionByName(fresh.select("grp", F.lit("all").alias("reason"))), fresh, True
        if "grp" in changes.columns:
            moved = moved.unionByName(changes.select("grp", F.lit("feed").alias("reason")).join(fresh, "grp", "left_semi"))
        nodes = changes.select(F.concat_ws(":", "entity", "id").alias("node")).distinct()
        direct = index.join(nodes, "node", "left_semi").select("grp", F.lit("edge").alias("reason"))
        return moved.unionByName(direct), fresh, False

    def empty(self) -> bool:
        """No batch has left anything yet, an unfinished one included."""
        return not any(base or parts for base, parts in (x.batches() for x in (self.decisions, self.index, self.scopes)))

    def apply(self, batch: int, changes: DataFrame, s: Snapshot) -> dict:
        """Bring the stores to snapshot s; changes are what a feed says. Counts of groups and decisions, and whether it was all."""
        room = Room(self.spark)
        s, first = s.written(room), self.empty()
        affected, fresh, full = self.plan(changes, s, room)
        groups = room.cut(affected.select("grp").distinct())
        s = replace(s, receivables=s.receivables.filter("grp IS NOT NULL")) if first else s.of(groups)  # the first batch has all groups
        s = s if first else replace(s, receivables=room.cut(s.receivables))
        legs, agreed = room.cut(allocations(s)), room.cut(terms(s))
        self.index.commit(batch, rests(s, legs, agreed), groups)
        self.decisions.commit(batch, decided(s, legs, agreed), groups)
        self.scopes.commit(batch, fresh.join(groups, "grp", "left_semi"), groups)  # last: an unfinished batch is planned again
        out = {"groups": groups.count(), "recomputed": s.receivables.count(), "full": full}  # one decision a receivable
        room.close()
        return out | {"decisions": self.decisions.read().count()}

    def compact(self) -> None:
        for store in (self.decisions, self.index, self.scopes):
            store.compact()


def ledger(spark, d, room: Room) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Invoices, payments and agreements, joined and written once."""
    return room.cut(v.invoices(spark, d)), room.cut(v.payments(spark, d)), room.cut(v.agreements(spark, d))


def snapshot(spark, d, step: int = 0, known: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> Snapshot:
    """The ledger after ``step`` batches: amounts changed, receivables gone, payments added, terms moved, each by residues of keys.
    Where the ledger is written already (known), a snapshot of it takes no joins and isn't written again."""
    i, p, a = known or (v.invoices(spark, d), v.payments(spark, d), v.agreements(spark, d))
    hit = lambda col, m: (F.expr(col) % m).between(1, step)
    r = i.filter(~hit("orderkey", 991)).select(
        "id", F.col("counterparty").alias("grp"), F.concat(F.lit("D"), F.expr("orderkey div 8")).alias("document"),
        F.when(hit("orderkey", 997), F.col("amount") + 100).otherwise(F.col("amount")).alias("amount"), F.when(F.col("orderkey") % 41 != 0, F.col("issued")).alias("issued"), "reference",
    )
    p = p.withColumn("ref", F.concat(F.lit("ORD"), "orderkey")).filter("counterparty <> ''").select("id", F.col("counterparty").alias("grp"), "amount", F.col("booked").alias("day"), F.when(F.col("reference") != "", F.col("reference")).when(F.col("memo") != "", F.col("ref")).otherwise("").alias("reference"), "orderkey")
    more = p.filter(hit("orderkey", 97) & (F.col("amount") > 0)).select(F.concat(F.lit("N"), "id").alias("id"), "grp", F.expr("amount div 3").alias("amount"), F.date_add("day", 30).alias("day"), F.concat(F.lit("ORD"), "orderkey").alias("reference"))
    c = F.regexp_extract("id", "A([0-9]+)-", 1).cast("long")
    a = a.withColumn("c", c).select("id", F.col("counterparty").alias("grp"), "valid_from", "valid_to", (F.col("term_days") + F.when(hit("c", 89), 15).otherwise(0)).cast("int").alias("term_days"))
    return Snapshot(r, p.drop("orderkey").unionByName(more), a, stored=known is not None)


def feed(spark, d, step: int) -> DataFrame:
    """changes(entity, id, grp) of one batch; added payments are left to the scopes."""
    k, c = v.read(spark, d, "orders"), v.read(spark, d, "customer")
    k = k.filter((F.col("o_orderkey") % 997 == step) | (F.col("o_orderkey") % 991 == step)).join(c, F.col("o_custkey") == F.col("c_custkey"))
    k = k.select(F.lit("receivable").alias("entity"), F.concat(F.lit("I"), "o_orderkey").alias("id"), F.col("c_name").alias("grp"))
    c = c.filter(F.col("c_custkey") % 89 == step).select(F.lit("agreement").alias("entity"), F.concat(F.lit("A"), "c_custkey", F.lit("-0")).alias("id"), F.col("c_name").alias("grp"))
    return k.unionByName(c)


STEPS = 3


def snapshot_sql(step: int) -> str:
    """Views r, p, a and the decisions dec of the ledger after ``step`` batches, computed in full."""
    hit = lambda col, m: f"({col} % {m} BETWEEN 1 AND {step})"
    return f"""r AS (SELECT id, counterparty AS grp, CASE WHEN {hit("orderkey", 997)} THEN amount + 100 ELSE amount END AS amount, CASE WHEN orderkey % 41 <> 0 THEN issued END AS issued, reference FROM v_invoice WHERE NOT {hit("orderkey", 991)}),
p0 AS (SELECT id, counterparty AS grp, amount, booked AS day, CASE WHEN reference <> '' THEN reference WHEN memo <> '' THEN 'ORD' || orderkey ELSE '' END AS reference, orderkey FROM v_payment WHERE counterparty <> ''),
p AS (SELECT id, grp, amount, day, reference FROM p0 UNION ALL SELECT 'N' || id, grp, amount // 3, day + 30, 'ORD' || orderkey FROM p0 WHERE amount > 0 AND {hit("orderkey", 97)}),
a AS (SELECT id, counterparty AS grp, valid_from, valid_to, term_days + CASE WHEN {hit("CAST(regexp_extract(id, 'A([0-9]+)-', 1) AS BIGINT)", 89)} THEN 15 ELSE 0 END AS term_days FROM v_agreement),
legs AS (SELECT r.id, r.grp, p.id AS pid, p.day, least(p.amount, r.amount - coalesce(sum(p.amount) OVER (PARTITION BY r.id ORDER BY p.day, p.id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS applied
  FROM r JOIN p ON r.grp = p.grp AND r.reference = p.reference WHERE p.amount > 0 AND r.amount > 0 AND r.reference <> ''),
term AS (SELECT r.id, count(DISTINCT term_days) AS n_terms, min(term_days) AS term FROM r JOIN a ON a.grp = r.grp AND (issued IS NULL OR ((valid_from IS NULL OR issued >= valid_from) AND (valid_to IS NULL OR issued <= valid_to))) GROUP BY r.id),
x AS (SELECT r.*, coalesce(n_terms > 1, false) AS conflict, CASE WHEN NOT coalesce(n_terms > 1, false) THEN issued + coalesce(term, {TERM}) END AS due FROM r LEFT JOIN term USING (id)),
t AS (SELECT legs.id, sum(applied) AS paid, max(greatest(datediff('day', due, day), 0)) AS leg_delay, sum(CASE WHEN due IS NOT NULL THEN CAST(applied AS HUGEINT) * 155 * greatest(datediff('day', due, day), 0) // 365000 END) AS leg_interest
  FROM legs JOIN x USING (id) WHERE applied > 0 GROUP BY legs.id),
y AS (SELECT x.*, coalesce(paid, 0) AS paid, leg_delay, leg_interest, amount - coalesce(paid, 0) AS open, greatest(datediff('day', due, DATE '{v.AS_OF}'), 0) AS rest FROM x LEFT JOIN t USING (id)),
dec AS (SELECT grp, id AS decision, CASE WHEN conflict THEN 'CONFLICT' WHEN issued IS NULL THEN 'INSUFFICIENT' WHEN open <= 0 THEN 'MATCHED' WHEN paid > 0 THEN 'PARTIAL' ELSE 'UNMATCHED' END AS status, due,
  CAST(paid AS BIGINT) AS paid, CAST(open AS BIGINT) AS open, CAST(CASE WHEN due IS NOT NULL THEN greatest(coalesce(leg_delay, 0), CASE WHEN open > 0 THEN rest ELSE 0 END) END AS INTEGER) AS delay_days,
  CAST(CASE WHEN due IS NOT NULL THEN coalesce(leg_interest, 0) + CASE WHEN open > 0 THEN CAST(open AS HUGEINT) * 155 * rest // 365000 ELSE 0 END END AS BIGINT) AS interest FROM y)"""


VIEWS = ("invoice", "payment", "agreement")


@query("f19_f21_maintained_decisions", v.with_views(*VIEWS, snapshot_sql(STEPS)) + "SELECT * FROM dec")
def q_maintained(spark, d):
    """Decisions after three batches, each recomputing what it touched; the SQL recomputes everything."""
    kept, room = Maintained(spark), Room(spark)
    known = ledger(spark, d, room)
    for step in range(STEPS + 1):
        kept.apply(step + 1, feed(spark, d, step) if step else feed(spark, d, 1).limit(0), snapshot(spark, d, step, known))
    kept.compact()
    room.close()
    return kept.decisions.read().drop("inputs")


def differing(a: DataFrame, b: DataFrame) -> int:
    """Rows that are in one of two tables only, repeats counted: each is counted up in one and down in the other, in one pass."""
    x = a.withColumn("_n", F.lit(1)).unionByName(b.withColumn("_n", F.lit(-1))).groupBy(*a.columns).agg(F.abs(F.sum("_n")).alias("_n"))
    return x.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long")).first()[0]


def _touched(step: int) -> str:
    """SQL of the groups that batch ``step`` touches."""
    return f"""SELECT counterparty AS grp FROM v_invoice WHERE orderkey % 997 = {step} OR (orderkey % 991 = {step} AND NOT orderkey % 991 BETWEEN 1 AND {step - 1})
  UNION SELECT counterparty FROM v_payment WHERE counterparty <> '' AND amount > 0 AND orderkey % 97 = {step} UNION SELECT counterparty FROM v_agreement WHERE CAST(regexp_extract(id, 'A([0-9]+)-', 1) AS BIGINT) % 89 = {step}"""


@query("g16_recompute_equality", v.with_views(*VIEWS) + " UNION ALL ".join(
    f"SELECT CAST({s} AS INTEGER) AS step, (SELECT count(*) FROM v_invoice WHERE NOT orderkey % 991 BETWEEN 1 AND {s}) AS decisions, (SELECT count(*) FROM v_invoice WHERE NOT orderkey % 991 BETWEEN 1 AND {s} AND counterparty IN ({_touched(s)})) AS recomputed, CAST(0 AS BIGINT) AS differing, false AS full"
    for s in range(1, STEPS + 1)
))
def q_equality(spark, d):
    """After each batch: decisions, how many of them were computed anew, and rows that differ from a full computation."""
    kept, room, rows = Maintained(spark), Room(spark), []
    known = ledger(spark, d, room)
    kept.apply(1, feed(spark, d, 1).limit(0), snapshot(spark, d, 0, known))
    for step in range(1, STEPS + 1):
        now = snapshot(spark, d, step, known)
        did = kept.apply(step + 1, feed(spark, d, step), now)
        rows.append((step, did["decisions"], did["recomputed"], differing(kept.decisions.read(), decided(now, allocations(now), terms(now))), did["full"]))
    room.close()
    return spark.createDataFrame(rows, "step int, decisions long, recomputed long, differing long, full boolean")
