"""Rule versions, business calendar, due dates, delay days and delay interest."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ledgerloom.plans import ledger as v
from ledgerloom.registry import query

#: Built-in rule versions (rule, version, effective from, to, known from, days, month-end days, rate in thousandths, day count).
RULES = (
    ("direct_term", "2021-10-21", "2021-10-21", None, "2021-04-20", 60, None, None, None),
    ("direct_term", "2026-amendment", None, None, "2026-09-17", 35, 20, None, None),
    ("consignment_term", "2012-01-01", "2012-01-01", None, "2011-11-14", 40, None, None, None),
    ("consignment_term", "2026-amendment", None, None, "2026-09-17", 20, None, None, None),
    ("subcontract_term", "2009-04-01", "2009-04-01", None, "2009-04-01", 60, None, None, None),
    ("retail_interest", "2021-13", "2021-10-21", None, "2021-10-21", None, None, 155, 365),
    ("subcontract_interest", "2018-21", "2018-12-06", None, "2018-12-06", None, None, 155, 365),
)
#: Holidays that fall on the same day every year, and the other ones of 2025.
SOLAR = ("01-01", "03-01", "05-05", "06-06", "08-15", "10-03", "10-09", "12-25")
LUNAR = ("2025-01-27", "2025-01-28", "2025-01-29", "2025-01-30", "2025-03-03", "2025-05-06", "2025-10-05", "2025-10-06", "2025-10-07", "2025-10-08")
FIRST_DAY, LAST_DAY = "2020-01-01", "2032-12-31"
RUN = 20
RULE_SCHEMA = "rule string, version string, effective_from date, effective_to date, known_from date, term_days int, monthly_days int, rate_milli int, day_count int"


def _d(x):
    return None if x is None else date.fromisoformat(x)


def rule_versions(spark, rules=RULES) -> DataFrame:
    """A frame of rule versions; a bounded dimension."""
    rows = [(a, b, _d(f), _d(t), _d(k), *rest) for a, b, f, t, k, *rest in rules]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def activate(rules: DataFrame, rule: str, version: str, effective_from: str) -> DataFrame:
    """The frame with another effective date for one version."""
    this = (F.col("rule") == rule) & (F.col("version") == version)
    return rules.withColumn("effective_from", F.when(this, F.lit(effective_from).cast("date")).otherwise(F.col("effective_from")))


def _sql(x, kind=None):
    return "NULL" if x is None else f"DATE '{x}'" if kind == "date" else f"'{x}'" if isinstance(x, str) else str(x)


RULES_SQL = "rules AS (SELECT * FROM (VALUES " + ", ".join(
    "(" + ", ".join([_sql(r[0]), _sql(r[1]), *(_sql(x, "date") for x in r[2:5]), *map(_sql, r[5:])]) + ")" for r in RULES
) + ") r(rule, version, effective_from, effective_to, known_from, term_days, monthly_days, rate_milli, day_count))"


def calendar(spark, first=FIRST_DAY, last=LAST_DAY, added=LUNAR, removed=()) -> DataFrame:
    """(day, is_holiday, is_business, next_business_day): removed dates win over added ones, those over yearly ones.

    One window over a bounded number of days; broadcast wherever it is joined. Days outside are rolled by next_business_day."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    text = F.date_format("day", "yyyy-MM-dd")
    holiday = ~text.isin(*(removed or ("",))) & (text.isin(*added) | F.date_format("day", "MM-dd").isin(*SOLAR))
    x = days.withColumn("is_holiday", holiday).withColumn("is_business", ~F.col("is_holiday") & (F.weekday("day") < 5))
    ahead = W.orderBy("day").rowsBetween(W.currentRow, W.unboundedFollowing)
    return x.withColumn("next_business_day", F.min(F.when(F.col("is_business"), F.col("day"))).over(ahead))


CALENDAR_SQL = f"""calendar AS (
  SELECT day, is_holiday, is_business, min(CASE WHEN is_business THEN day END) OVER (ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_business_day
  FROM (SELECT day, is_holiday, NOT is_holiday AND isodow(day) < 6 AS is_business
    FROM (SELECT day, strftime(day, '%Y-%m-%d') IN ({", ".join(f"'{x}'" for x in LUNAR)}) OR strftime(day, '%m-%d') IN ({", ".join(f"'{x}'" for x in SOLAR)}) AS is_holiday
      FROM (SELECT CAST(unnest(generate_series(DATE '{FIRST_DAY}', DATE '{LAST_DAY}', INTERVAL 1 DAY)) AS DATE) AS day))))"""


def next_business_day(day: Column, added=LUNAR) -> Column:
    """The same for any day, as an expression: the first business day of the RUN days from it on. No run of holidays and
    weekends is as long."""
    def business(x: Column) -> Column:
        return (F.weekday(x) < 5) & ~F.date_format(x, "MM-dd").isin(*SOLAR) & ~F.date_format(x, "yyyy-MM-dd").isin(*added)

    return F.get(F.filter(F.sequence(day, F.date_add(day, RUN)), business), F.lit(0))


def resolve(facts: DataFrame, rules: DataFrame, rule: Column, on: Column, keep: tuple[str, ...], known_at=None, prefix="") -> DataFrame:
    """facts with columns of the rule version that applies on a date: the latest by (effective_from, version) among those
    in force, and known by known_at. An as-of join against a bounded dimension, broadcast."""
    names = ("effective_from", "effective_to", "known_from", "version", *keep)
    r = rules.select(F.col("rule").alias("_rule"), *[F.col(c).alias("_" + c) for c in names])
    x = facts.withColumn("_on", on).withColumn("_want", rule)
    # one array of each rule's versions, latest first, so that no fact is multiplied or shuffled
    latest = r.filter("_effective_from IS NOT NULL").groupBy("_rule").agg(F.sort_array(F.collect_list(F.struct("_effective_from", "_version", "_effective_to", "_known_from", *["_" + c for c in keep])), asc=False).alias("_all"))
    x = x.join(F.broadcast(latest), x["_want"] == latest["_rule"], "left")

    def fits(t):
        good = (F.col("_on") >= t["_effective_from"]) & (t["_effective_to"].isNull() | (F.col("_on") <= t["_effective_to"]))
        return good if known_at is None else good & (t["_known_from"] <= F.lit(known_at).cast("date"))

    best = F.get(F.filter("_all", fits), F.lit(0))
    return x.withColumn("_best", best).select(*facts.columns, F.col("_best._version").alias(prefix + "version"), *[F.col("_best._" + c).alias(prefix + c) for c in keep])


def interest(principal: Column, days: Column, rate_milli: Column, day_count: Column, half_up: bool = False) -> Column:
    """Whole units of principal x rate x days / day count, rounded once: down, or halves up. 0 without delay or principal."""
    p = principal.cast("decimal(30,0)") * rate_milli * days
    base = (day_count * 1000).cast("decimal(12,0)")
    value = F.floor((p * 2 + base) / (base * 2)) if half_up else F.floor(p / base)
    return F.when((days <= 0) | (principal <= 0), F.lit(0)).otherwise(value).cast("long")


def due(facts: DataFrame, rules: DataFrame, cal: DataFrame, as_of: str | None = None, known_at=None) -> DataFrame:
    """Due-date variants of facts(id, trade_type, received, closed, amount, rollover, paid): one row a variant.

    missing: the fact that is needed first, or rule_version; then there is no due date. rollover: true moves a due date to
    the next business day, false doesn't; null gives one variant if it makes no difference, else both, unresolved."""
    kind = F.col("trade_type")
    base = F.when(kind == "consignment", F.col("closed")).when(kind.isNotNull(), F.col("received"))
    rule = F.when(kind == "direct", "direct_term").when(kind == "consignment", "consignment_term").when(kind == "subcontract", "subcontract_term")
    x = resolve(facts.withColumn("base_date", base), rules, rule, F.col("base_date"), ("term_days",), known_at, "term_")
    missing = (
        F.when(kind.isNull(), "trade_type").when(F.col("base_date").isNull() & (kind == "consignment"), "sales_close_date")
        .when(F.col("base_date").isNull() & (kind == "subcontract"), "object_received_date").when(F.col("base_date").isNull(), "goods_received_date")
        .when(F.col("term_version").isNull(), "rule_version")
    )
    x = x.withColumn("missing", missing).withColumn("raw_due", F.when(F.col("missing").isNull(), F.expr("date_add(base_date, term_term_days)")))
    days = cal.select(F.col("day").alias("raw_due"), F.col("next_business_day").alias("rolled"))
    x = x.join(F.broadcast(days), "raw_due", "left").withColumn("rolled", F.coalesce("rolled", F.when(F.col("raw_due").isNotNull(), next_business_day(F.col("raw_due")))))
    off = F.struct(F.lit("rollover_off").alias("variant"), F.col("raw_due").alias("due"))
    on = F.struct(F.lit("rollover_on").alias("variant"), F.col("rolled").alias("due"))
    options = (
        F.when(F.col("raw_due").isNull(), F.array(F.struct(F.lit(None).cast("string").alias("variant"), F.lit(None).cast("date").alias("due"))))
        .when(F.col("rollover"), F.array(on)).when(~F.col("rollover") | (F.col("rolled") == F.col("raw_due")), F.array(off)).otherwise(F.array(off, on))
    )
    x = x.withColumn("unresolved_rollover", F.coalesce(F.size(options) > 1, F.lit(False))).withColumn("first_due", options[0]["due"])
    rate_rule = F.when(kind == "subcontract", "subcontract_interest").otherwise("retail_interest")
    x = resolve(x, rules, rate_rule, F.date_add("first_due", 1), ("rate_milli", "day_count"), known_at, "rate_")
    x = x.withColumn("o", F.explode(options)).select("*", "o.variant", "o.due").drop("o")
    end = F.coalesce("paid", F.lit(as_of).cast("date"))
    x = x.withColumn("delay_days", F.when(F.col("due").isNotNull(), F.coalesce(F.greatest(F.lit(0), F.datediff(end, "due")), F.lit(0))))
    return x.withColumn("interest", F.when(F.col("rate_version").isNotNull(), interest(F.col("amount"), F.col("delay_days"), F.col("rate_rate_milli"), F.col("rate_day_count"))))


DUE_SQL = f"""based AS (
  SELECT *, CASE WHEN trade_type = 'consignment' THEN closed WHEN trade_type IS NOT NULL THEN received END AS base_date FROM v_line),
termed AS (
  SELECT b.*, r.version AS term_version, r.term_days FROM based b LEFT JOIN rules r ON r.rule = b.trade_type || '_term' AND b.base_date >= r.effective_from
    AND (r.effective_to IS NULL OR b.base_date <= r.effective_to)
  QUALIFY row_number() OVER (PARTITION BY b.id ORDER BY r.effective_from DESC NULLS LAST, r.version DESC) = 1),
missed AS (SELECT *, CASE WHEN trade_type IS NULL THEN 'trade_type'
    WHEN base_date IS NULL THEN CASE trade_type WHEN 'consignment' THEN 'sales_close_date' WHEN 'subcontract' THEN 'object_received_date' ELSE 'goods_received_date' END
    WHEN term_version IS NULL THEN 'rule_version' END AS missing FROM termed),
rolled AS (SELECT m.*, c.day AS raw_due, c.next_business_day AS rolled_due FROM missed m LEFT JOIN calendar c ON m.missing IS NULL AND c.day = m.base_date + m.term_days),
variants AS (
  SELECT *, CASE WHEN raw_due IS NULL THEN NULL WHEN rollover THEN 'rollover_on' ELSE 'rollover_off' END AS variant, CASE WHEN rollover THEN rolled_due ELSE raw_due END AS due FROM rolled
  UNION ALL SELECT *, 'rollover_on', rolled_due FROM rolled WHERE rollover IS NULL AND raw_due IS NOT NULL AND rolled_due <> raw_due),
rated AS (
  SELECT v.*, r.version AS rate_version, r.rate_milli, r.day_count FROM variants v LEFT JOIN rules r
    ON r.rule = CASE WHEN trade_type = 'subcontract' THEN 'subcontract_interest' ELSE 'retail_interest' END
    AND (CASE WHEN rollover THEN rolled_due ELSE raw_due END) + 1 >= r.effective_from),
dues AS (
  SELECT *, raw_due IS NOT NULL AND rollover IS NULL AND rolled_due <> raw_due AS unresolved_rollover,
    CASE WHEN due IS NOT NULL THEN greatest(0, datediff('day', due, coalesce(paid, DATE '{v.AS_OF}'))) END AS delay_days FROM rated),
interests AS (SELECT *, CASE WHEN rate_version IS NULL THEN NULL WHEN delay_days <= 0 OR amount <= 0 THEN 0
    ELSE CAST((CAST(amount AS HUGEINT) * rate_milli * delay_days) // (day_count * 1000) AS BIGINT) END AS interest FROM dues)"""
DUE_VIEWS = v.with_views("line", RULES_SQL, CALENDAR_SQL, DUE_SQL)


def _dues(spark, d):
    return due(v.lines(spark, d), rule_versions(spark), calendar(spark), v.AS_OF)


@query("due_interest_by_counterparty", DUE_VIEWS + """
SELECT counterparty, count(*) AS n, count(due) AS n_due, CAST(sum(delay_days) AS BIGINT) AS delay_days, CAST(sum(interest) AS BIGINT) AS interest
FROM interests WHERE variant IS DISTINCT FROM 'rollover_on' OR NOT unresolved_rollover GROUP BY counterparty""")
def due_interest_by_counterparty(spark, d):
    """Flagship: lines to first due variants, delay and interest, summed by counterparty."""
    x = _dues(spark, d).filter(~((F.col("variant") == "rollover_on") & F.col("unresolved_rollover")) | F.col("variant").isNull())
    return x.groupBy("counterparty").agg(F.count("*").alias("n"), F.count("due").alias("n_due"), F.sum("delay_days").cast("long").alias("delay_days"), F.sum("interest").cast("long").alias("interest"))


@query("f01_f04_due_variants", DUE_VIEWS + "SELECT id, variant, missing, due, CAST(delay_days AS INTEGER) AS delay_days, interest, unresolved_rollover FROM interests")
def due_variants(spark, d):
    return _dues(spark, d).select("id", "variant", "missing", "due", "delay_days", "interest", "unresolved_rollover")


@query("d13_rule_asof", v.with_views("line", RULES_SQL) + """
SELECT l.id, r.version FROM v_line l LEFT JOIN rules r ON r.rule = l.trade_type || '_term' AND l.received >= r.effective_from AND r.known_from <= DATE '2024-01-01'
QUALIFY row_number() OVER (PARTITION BY l.id ORDER BY r.effective_from DESC NULLS LAST, r.version DESC) = 1""")
def rule_asof(spark, d):
    x = v.lines(spark, d).select("id", "trade_type", "received")
    return resolve(x, rule_versions(spark), F.concat("trade_type", F.lit("_term")), F.col("received"), (), "2024-01-01").select("id", "version")


def register(rules: DataFrame, more: DataFrame) -> DataFrame:
    """The frame with more versions; a version that is there already is an error."""
    twice = rules.unionByName(more).groupBy("rule", "version").count().filter("count > 1").first()  # a bounded dimension
    if twice:
        raise ValueError(f"{twice['rule']} {twice['version']} is registered already")
    return rules.unionByName(more)


@query("f05_f06_rule_activation", v.with_views("line", RULES_SQL) + """, later AS (SELECT * REPLACE (CASE WHEN rule = 'direct_term' AND version = '2026-amendment' THEN DATE '2024-01-01' ELSE effective_from END AS effective_from) FROM rules
  UNION ALL SELECT 'subcontract_term', 'own', DATE '2023-06-01', DATE '2023-12-31', DATE '2023-06-01', 30, NULL, NULL, NULL)
SELECT l.id, r.version, r.term_days FROM v_line l LEFT JOIN later r ON r.rule = l.trade_type || '_term' AND l.received >= r.effective_from AND (r.effective_to IS NULL OR l.received <= r.effective_to)
QUALIFY row_number() OVER (PARTITION BY l.id ORDER BY r.effective_from DESC NULLS LAST, r.version DESC) = 1""".replace("\n, later", ", later"))
def rule_activation(spark, d):
    """Versions of all lines once an amendment is in force and a version of one's own is registered."""
    own = rule_versions(spark, (("subcontract_term", "own", "2023-06-01", "2023-12-31", "2023-06-01", 30, None, None, None),))
    rules = activate(register(rule_versions(spark), own), "direct_term", "2026-amendment", "2024-01-01")
    x = v.lines(spark, d).select("id", "trade_type", "received")
    return resolve(x, rules, F.concat("trade_type", F.lit("_term")), F.col("received"), ("term_days",)).select("id", "version", "term_days")


@query("b12_b13_b14_calendar", v.with_views("line", CALENDAR_SQL) + """
SELECT received AS day, count(*) AS n, is_holiday, isodow(received) >= 6 AS is_weekend, next_business_day, last_day(received) AS month_end, CAST(datediff('day', received, next_business_day) AS INTEGER) AS wait
FROM v_line JOIN calendar ON day = received GROUP BY ALL""")
def calendar_days(spark, d):
    x = v.lines(spark, d).join(F.broadcast(calendar(spark)), F.col("received") == F.col("day")).withColumn("is_weekend", F.weekday("day") >= 5)
    return x.groupBy("day", "is_holiday", "is_weekend", "next_business_day", F.last_day("day").alias("month_end"), F.datediff("next_business_day", "day").alias("wait")).agg(F.count("*").alias("n"))


@query("f04_interest_half_up", v.with_views("line") + """
SELECT id, CASE WHEN amount <= 0 OR orderkey % 90 = 0 THEN 0 ELSE CAST((2 * CAST(amount AS HUGEINT) * 155 * (orderkey % 90) + 365000) // 730000 AS BIGINT) END AS half_up,
  CASE WHEN amount <= 0 OR orderkey % 90 = 0 THEN 0 ELSE CAST((CAST(amount AS HUGEINT) * 155 * (orderkey % 90)) // 365000 AS BIGINT) END AS floored FROM v_line""")
def interest_rounding(spark, d):
    days = (F.col("orderkey") % 90).cast("int")
    f = lambda up: interest(F.col("amount"), days, F.lit(155), F.lit(365), up)
    return v.lines(spark, d).select("id", f(True).alias("half_up"), f(False).alias("floored"))


CONTRACT_SQL = """applied AS (
  SELECT l.id, l.received, a.term_days FROM v_line l JOIN v_agreement a ON a.counterparty = l.counterparty
    AND (l.received IS NULL OR ((a.valid_from IS NULL OR l.received >= a.valid_from) AND (a.valid_to IS NULL OR l.received <= a.valid_to)))),
terms AS (SELECT id, received, count(DISTINCT term_days) AS n_terms, min(term_days) AS term FROM applied GROUP BY ALL)"""


@query("d12_f07_f09_contract_due", v.with_views("line", "agreement", CONTRACT_SQL) + """
SELECT id, n_terms, CASE WHEN n_terms = 1 THEN received + term END AS contractual_due, n_terms > 1 AS conflict FROM terms""")
def contract_due(spark, d):
    """Applicable agreements (interval join, open ends by null, no date: all), one term or a conflict, contractual due date."""
    a = v.agreements(spark, d).drop("id")
    inside = F.col("received").isNull() | ((F.col("valid_from").isNull() | (F.col("received") >= F.col("valid_from"))) & (F.col("valid_to").isNull() | (F.col("received") <= F.col("valid_to"))))
    x = v.lines(spark, d).select("id", "counterparty", "received").join(a, "counterparty").filter(inside)
    x = x.groupBy("id", "received").agg(F.count_distinct("term_days").alias("n_terms"), F.min("term_days").alias("term"))
    return x.select("id", "n_terms", F.when(F.col("n_terms") == 1, F.expr("date_add(received, term)")).alias("contractual_due"), (F.col("n_terms") > 1).alias("conflict"))


@query("f08_tranche_interest", DUE_VIEWS + """
SELECT orderkey, variant, count(*) AS tranches, max(delay_days) AS max_delay, CASE WHEN count(*) = count(interest) THEN CAST(sum(interest) AS BIGINT) END AS interest
FROM interests WHERE variant IS NOT NULL GROUP BY orderkey, variant""")
def tranche_interest(spark, d):
    """Lines as tranches of an order: longest delay and total interest by variant; any unknown interest makes the total unknown."""
    x = _dues(spark, d).filter("variant IS NOT NULL").groupBy("orderkey", "variant")
    total = F.when(F.count("*") == F.count("interest"), F.sum("interest")).cast("long")
    return x.agg(F.count("*").alias("tranches"), F.max("delay_days").cast("long").alias("max_delay"), total.alias("interest"))
