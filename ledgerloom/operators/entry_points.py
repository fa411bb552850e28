"""Typed reads over the rest: documents, decisions, due dates on other days, conditions, evidence, reports. Each returns a DataFrame."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import maintained as m
from ledgerloom.operators import rules
from ledgerloom.plans import ledger as v
from ledgerloom.plans.graph import Room, upstream
from ledgerloom.registry import query
from ledgerloom.sources.files import scratch, write_report

#: Signs around a found term, and rows of a page.
AROUND, PAGE = 30, 200


def search_documents(docs: DataFrame, terms: list[str], around: int = AROUND) -> DataFrame:
    """(doc_id, term, hits, snippet) of docs(doc_id, text) for each term that occurs, in whatever case; the snippet is the first one."""
    low = F.lower("text")
    found = [F.struct(F.lit(t).alias("term"), F.locate(t.lower(), low).alias("at"), ((F.length(low) - F.length(F.replace(low, F.lit(t.lower()), F.lit("")))) / len(t)).cast("long").alias("hits")) for t in terms if t]
    x = docs.select("doc_id", "text", F.explode(F.filter(F.array(*found), lambda f: f["at"] > 0)).alias("f"))
    start = F.greatest(F.col("f.at") - around, F.lit(1))
    size = F.col("f.at") - start + F.length("f.term") + around
    return x.select("doc_id", "f.term", "f.hits", F.substr("text", start, size).alias("snippet"))


def list_decisions(decisions: DataFrame, status: str | None = None, grp: str | None = None, after: tuple[int, str] | None = None, rows: int = PAGE) -> DataFrame:
    """One page of decisions, by interest (down) and name: those after the last row's (interest, decision) of the page before."""
    x = decisions.withColumn("interest", F.coalesce("interest", F.lit(-1)))
    for column, value in (("status", status), ("grp", grp)):
        x = x if value is None else x.filter(F.col(column) == value)
    if after:
        x = x.filter((F.col("interest") < after[0]) | ((F.col("interest") == after[0]) & (F.col("decision") > after[1])))
    return x.orderBy(F.desc("interest"), "decision").limit(rows)


def decision_detail(s: m.Snapshot, wanted: DataFrame) -> DataFrame:
    """Decisions of wanted(decision) with the nodes that they rest on. A receivable's decision rests on no other receivable, so
    only the wanted ones are decided again, and only their edges are followed."""
    room = Room(wanted.sparkSession)
    own = room.cut(s.receivables.join(wanted.select(F.col("decision").alias("id")), "id", "left_semi"))
    found, edges = m.decide(replace(s, receivables=own), room)
    found, edges = room.cut(found), room.cut(edges)
    nodes = upstream(edges.select("src", "dst"), found.select(F.concat(F.lit("dec:"), "decision")))
    rest = nodes.filter(~F.col("node").startswith("comp:")).groupBy(F.expr("substring(target, 5)").alias("decision")).agg(F.array_join(F.array_sort(F.collect_list("node")), " ").alias("evidence"))
    return found.join(rest, "decision", "left").select("decision", "grp", "status", "due", "paid", "open", "delay_days", "interest", "evidence")


def calculate_due(facts: DataFrame, as_of: str, known_at: str | None = None) -> DataFrame:
    """Due variants, delays and interest of facts as of another day, by the rules that were known on a day; nothing is stored."""
    spark = facts.sparkSession
    return rules.due(facts, rules.rule_versions(spark), rules.calendar(spark), as_of, known_at)


def agreement_conditions(s: m.Snapshot) -> DataFrame:
    """(id, conditions, terms): the agreements in force for each receivable, by name."""
    x = m.terms(s).groupBy(F.col("rid").alias("id")).agg(F.array_sort(F.collect_list(F.struct("aid", "term_days"))).alias("a"))
    return x.select("id", F.array_join(F.transform("a", lambda a: F.concat_ws("=", a["aid"], F.coalesce(a["term_days"].cast("string"), F.lit("?")))), " ").alias("conditions"), F.size(F.array_distinct("a.term_days")).alias("terms"))


def missing_evidence(decisions: DataFrame) -> DataFrame:
    """(decision, grp, wanted): what each decision that isn't settled waits for."""
    wanted = F.when(F.col("status") == "CONFLICT", "one agreement").when(F.col("status") == "INSUFFICIENT", "date of issue").when(F.col("status") == "UNMATCHED", "payment").when(F.col("status") == "PARTIAL", "rest of the payment")
    return decisions.select("decision", "grp", wanted.alias("wanted")).filter("wanted IS NOT NULL")


def explain(decisions: DataFrame) -> DataFrame:
    """(decision, text): what was decided and why, line by line in a fixed order; what isn't known has no line."""
    line = lambda label, column: F.concat(F.lit(f"{label}: "), F.col(column).cast("string"))
    late = F.when(F.col("delay_days") > 0, F.concat(line("days late", "delay_days"), F.lit(", interest "), F.coalesce(F.col("interest").cast("string"), F.lit("unknown"))))
    lines = [line("status", "status"), line("due", "due"), F.when(F.col("paid") > 0, line("paid", "paid")), F.when(F.col("open") != 0, line("open", "open")), late]
    lines.append(F.when(F.col("status") == "CONFLICT", "agreements name different terms").when(F.col("status") == "INSUFFICIENT", "needs the date of issue"))
    return decisions.select("decision", F.concat_ws("\n", *lines).alias("text"))


def _decided(spark, d) -> DataFrame:
    return m.decide(m.snapshot(spark, d), Room(spark))[0]


DEC = v.with_views(*m.VIEWS, m.snapshot_sql(0))


@query("j_search_documents", f"""
SELECT doc_id, term, CAST((length(low) - length(replace(low, term, ''))) / length(term) AS BIGINT) AS hits, substr(text, greatest(pos - {AROUND}, 1), pos - greatest(pos - {AROUND}, 1) + length(term) + {AROUND}) AS snippet
FROM (SELECT doc_id, text, lower(text) AS low, term, strpos(lower(text), term) AS pos FROM documents, (VALUES ('licen'), ('http'), ('tion ')) t(term)) WHERE pos > 0""")
def q_search(spark, d):
    return search_documents(v.read(spark, d, "documents"), ["licen", "http", "tion "])


@query("j_decision_pages", DEC + f""", part AS (SELECT * REPLACE (coalesce(interest, -1) AS interest) FROM dec WHERE status = 'PARTIAL'), paged AS (SELECT *, row_number() OVER (ORDER BY interest DESC, decision) AS n FROM part)
SELECT decision, grp, interest FROM paged WHERE n > {PAGE} AND n <= 2 * {PAGE}""")
def q_pages(spark, d):
    """The second page, found from the last row of the first."""
    x = _decided(spark, d).select("decision", "grp", "status", "interest")
    last = list_decisions(x, "PARTIAL").orderBy("interest", F.desc("decision")).first()
    return list_decisions(x, "PARTIAL", after=(last["interest"], last["decision"]) if last else None).drop("status")


@query("j_decision_detail", DEC + """, nodes AS (SELECT id AS decision, 'document:D' || CAST(CAST(substr(id, 2) AS BIGINT) // 8 AS VARCHAR) AS node FROM r UNION ALL SELECT id, 'receivable:' || id FROM r UNION ALL SELECT id, 'payment:' || pid FROM legs WHERE applied > 0
  UNION ALL SELECT r.id, 'agreement:' || a.id FROM r JOIN a ON a.grp = r.grp AND (issued IS NULL OR ((valid_from IS NULL OR issued >= valid_from) AND (valid_to IS NULL OR issued <= valid_to))))
SELECT dec.decision, any_value(grp) AS grp, any_value(status) AS status, any_value(due) AS due, any_value(paid) AS paid, any_value(open) AS open, any_value(delay_days) AS delay_days, any_value(interest) AS interest, string_agg(node, ' ' ORDER BY node) AS evidence
FROM dec JOIN nodes USING (decision) WHERE status = 'CONFLICT' OR delay_days > 500 GROUP BY dec.decision""")
def q_detail(spark, d):
    """Decisions that need a look, with what they rest on."""
    x = _decided(spark, d)
    return decision_detail(m.snapshot(spark, d), x.filter("status = 'CONFLICT' OR delay_days > 500").select("decision"))


@query("j_calculate_due", rules.DUE_VIEWS.replace(v.AS_OF, "2026-01-31") + "SELECT id, variant, missing, due, CAST(delay_days AS INTEGER) AS delay_days, interest FROM interests")
def q_due(spark, d):
    """All lines as of a later day."""
    return calculate_due(v.lines(spark, d), "2026-01-31").select("id", "variant", "missing", "due", "delay_days", "interest")


@query("j_missing_evidence", DEC + """ SELECT decision, grp, CASE status WHEN 'CONFLICT' THEN 'one agreement' WHEN 'INSUFFICIENT' THEN 'date of issue' WHEN 'UNMATCHED' THEN 'payment' ELSE 'rest of the payment' END AS wanted FROM dec WHERE status <> 'MATCHED'""")
def q_missing(spark, d):
    return missing_evidence(_decided(spark, d))


@query("j_agreement_conditions", DEC + """ SELECT r.id, string_agg(a.id || '=' || coalesce(CAST(term_days AS VARCHAR), '?'), ' ' ORDER BY a.id) AS conditions, CAST(count(DISTINCT coalesce(term_days, -1)) AS INTEGER) AS terms
FROM r JOIN a ON a.grp = r.grp AND (issued IS NULL OR ((valid_from IS NULL OR issued >= valid_from) AND (valid_to IS NULL OR issued <= valid_to))) GROUP BY r.id""")
def q_conditions(spark, d):
    return agreement_conditions(m.snapshot(spark, d))


@query("b26_explanations", DEC + """ SELECT decision, concat_ws(chr(10), 'status: ' || status, 'due: ' || CAST(due AS VARCHAR), CASE WHEN paid > 0 THEN 'paid: ' || paid END, CASE WHEN open <> 0 THEN 'open: ' || open END,
  CASE WHEN delay_days > 0 THEN 'days late: ' || delay_days || ', interest ' || coalesce(CAST(interest AS VARCHAR), 'unknown') END, CASE status WHEN 'CONFLICT' THEN 'agreements name different terms' WHEN 'INSUFFICIENT' THEN 'needs the date of issue' END) AS text FROM dec""")
def q_explain(spark, d):
    return explain(_decided(spark, d))


@query("j_report_export", DEC + " SELECT decision, status, open FROM dec")
def q_export(spark, d):
    """Decisions as a report, read back."""
    path = scratch(spark)
    write_report(_decided(spark, d).select("decision", "status", "open"), path)
    return spark.read.csv(path, header=True, schema="decision string, status string, open long", escape='"')
