"""Scalar value operators as column builders: amounts, dates, identifiers, names, references, safe text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.plans import ledger as v
from ledgerloom.registry import query

#: Corporate forms in names, separators, words of trade types and line kinds, formula triggers, phrases.
CORPORATE = r"\(주\)|㈜|주식회사|\(유\)|유한회사|\(재\)|co\.?,?\s*ltd\.?|inc\.?|corp\.?"
SEPARATORS = r"[\s\-_.,·/()\[\]]+"
HEADER_UNIT = r"\((원|krw|₩|건|일|금액|단위:?원)\)|\[(원|krw)\]"
HEADER_MARKS = r"[\s\x{00A0}\x{3000}·ㆍ•/\\_\-.:,()\[\]{}<>*#'\"]+"
TRADE_WORDS = (("direct", ("직매입",)), ("consignment", ("특약매입", "특정매입", "위수탁", "위탁판매", "수탁", "임대을")), ("subcontract", ("하도급",)))
KIND_WORDS = (
    ("deduction", ("공제", "차감", "판촉비", "장려금", "광고비")), ("return", ("반품",)), ("fee", ("수수료",)), ("refund", ("환불",)),
    ("sale", ("매출", "판매", "매입", "납품", "정상", "입고")),
)
FORMULA = r"^ *[=+\-@\t\r\n＝＋－＠]"
PLAIN_NUMBER = r"^[+-]?\d{1,3}(,\d{3})*(\.\d+)?$|^[+-]?\d+(\.\d+)?$"
VERDICT_WORDS = ("위법", "불법", "받을 수 있", "받을 수있", "청구할 수 있", "승소")

#: Layouts of a date; signs that begin a formula; signs that file names don't hold; what isn't a number though it has digits, and
#: what is one; the label of a unit note, and units by what they multiply.
DATE_LAYOUTS = (
    r"^(\d{4})\s*[-./]\s*(\d{1,2})\s*[-./]\s*(\d{1,2})\.?(?:[ T]+\d{1,2}:\d{2}(?::\d{2})?)?$",
    r"^(\d{4})(\d{2})(\d{2})(?:\s*\d{4}(?:\d{2})?)?$",
    r"^(\d{4})년\s*(\d{1,2})월\s*(\d{1,2})일?$",
)
LEADS = " =+-@\t\r\n＝＋－＠"
REFUSED = '[\\x00-\\x1f<>:"|?*]'
NOT_NUMBERS = r"\[[^\]\n]*\]|\b\d{4}-\d{2}-\d{2}\b"
NUMBER = r"[^\w.](-?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?)"
UNIT_LABEL = "단위[:：]"
UNITS = (("백만원", 1_000_000), ("천원", 1000))

#: An amount without white space: bracket, currency, sign, currency, digits in groups or alone, fraction, currency, sign, bracket.
_MONEY = r"(?:원|₩|\\|KRW|krw)*"
AMOUNT_FORM = rf"^(\(?){_MONEY}\+?([△▲−－-]?){_MONEY}(\d{{1,3}}(?:,\d{{3}})+|\d+)(?:\.(\d+))?{_MONEY}(-?){_MONEY}(\)?)$"


def amount_of(x: Column) -> Column:
    """struct<number, error> of an amount text in whole won; empty text and a lone dash are null without an error, what 64 bits
    can't hold is null with one.

    One match of one pattern: its parts, joined by a bar, are split and read once."""
    bare = F.regexp_replace(F.coalesce(x, F.lit("")), r"[\s\x{00A0}\x{3000}]+", "")
    parts = F.split(F.regexp_replace(bare, AMOUNT_FORM, "=|$1|$2|$3|$4|$5|$6"), r"\|", -1)

    def read(p):
        good = (p[0] == "=") & (F.size(p) == 7) & ((p[1] == "") == (F.get(p, 6) == ""))
        digits = F.replace(F.get(p, 3), F.lit(","), F.lit("")).try_cast("bigint")
        odd = ((p[1] != "").cast("int") + (F.get(p, 2) != "").cast("int") + (F.get(p, 5) != "").cast("int")) % 2 == 1
        whole = F.translate(F.get(p, 4), "0", "") == ""
        empty = p[0].isin("", "-", "−") & (F.size(p) == 1)
        number = F.when(good & whole, F.when(odd, -digits).otherwise(digits))
        return F.struct(number.alias("number"), F.when(empty, None).when(~good, "not an amount").when(~whole, "fractional").when(digits.isNull(), "out of range").alias("error"))

    return F.transform(F.array(parts), read)[0]


def parse_amount(x: Column) -> tuple[Column, Column]:
    """The two columns of amount_of; project the struct instead where both are used."""
    s = amount_of(x)
    return s["number"], s["error"]


def parse_date(x: Column, serials: bool = True) -> Column:
    """A business date from one of three layouts, or a five-digit spreadsheet serial; null if none is valid."""
    s = F.trim(x)
    found = []
    for layout in DATE_LAYOUTS:
        year, month, day = (F.regexp_extract(s, layout, i).try_cast("int") for i in (1, 2, 3))
        found.append(F.when(s.rlike(layout), F.concat_ws("-", F.format_string("%04d", year), F.format_string("%02d", month), F.format_string("%02d", day)).try_cast("date")))
    parts = F.coalesce(*found)
    n = s.try_cast("int")
    serial = F.when(s.rlike(r"^\d{5}$") & n.between(20000, 80000), F.date_add(F.lit("1899-12-30").cast("date"), n))
    return F.coalesce(parts, serial) if serials else parts


def parse_time(x: Column) -> Column:
    """HH:MM:SS text of H:MM[:SS] or HHMM[SS]; null if none is valid."""
    s = F.trim(x)
    p = F.when(s.contains(":"), F.regexp_extract(s, r"^(\d{1,2}):\d{2}(?::\d{2})?$", 1)).otherwise(F.regexp_extract(s, r"^(\d{2})\d{2}(?:\d{2})?$", 1))
    colon = r"^\d{1,2}:(\d{2})(?::(\d{2}))?$"
    compact = r"^\d{2}(\d{2})(\d{2})?$"
    m = F.when(s.contains(":"), F.regexp_extract(s, colon, 1)).otherwise(F.regexp_extract(s, compact, 1))
    sec = F.when(s.contains(":"), F.regexp_extract(s, colon, 2)).otherwise(F.regexp_extract(s, compact, 2))
    sec = F.when(sec == "", "00").otherwise(sec)
    good = (p != "") & (p.try_cast("int") < 24) & (m.try_cast("int") < 60) & (sec.try_cast("int") < 60)
    return F.when(good, F.concat_ws(":", F.lpad(p, 2, "0"), m, sec))


def parse_id(x: Column) -> Column:
    return F.nullif(F.regexp_replace(x, r"[\s\x{00A0}\x{3000}]+", ""), F.lit(""))


def parse_brn(x: Column) -> Column:
    digits = F.regexp_replace(x, r"\D", "")
    return F.when(F.length(digits) == 10, F.regexp_replace(digits, r"^(\d{3})(\d{2})(\d{5})$", "$1-$2-$3")).otherwise(parse_id(x))


def parse_int(x: Column) -> Column:
    return F.nullif(F.regexp_extract(F.trim(x), r"^(\d+)\s*(일|days?)?$", 1), F.lit("")).try_cast("int")


def normalize_counterparty(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(x, F.lit("")))), CORPORATE, ""), SEPARATORS, "")


def normalize_ref(x: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(F.coalesce(x, F.lit("")))), SEPARATORS, "")


def normalize_header(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(x, F.lit("")))), HEADER_UNIT, ""), HEADER_MARKS, "")


def _first_word(x: Column, words) -> Column:
    n, out = normalize_header(x), F.lit(None).cast("string")
    for name, options in reversed(words):
        out = F.when(n.rlike("|".join(options)), name).otherwise(out)
    return out


def trade_type(x: Column) -> Column:
    return _first_word(x, TRADE_WORDS)


def line_kind(x: Column) -> Column:
    return _first_word(x, KIND_WORDS)


def missing_base_fields(kind: Column, received: Column, closed: Column) -> Column:
    goods, close = F.when(received.isNull(), "goods_received_date"), F.when(closed.isNull(), "sales_close_date")
    need = F.when(kind.isNull(), F.array(goods, close, F.lit("trade_type"))).when(kind == "consignment", F.array(close)).otherwise(F.array(goods))
    return F.array_compact(need)


def escape_formula(x: Column) -> Column:
    return F.when(x.rlike(PLAIN_NUMBER) | ~x.rlike(FORMULA), x).otherwise(F.concat(F.lit("'"), x))


def strip_formula(x: Column) -> Column:
    return F.when(x.rlike(PLAIN_NUMBER), x).otherwise(F.ltrim(x, F.lit(LEADS)))


def safe_filename(x: Column) -> Column:
    """The last part of a path that has a name, without signs that file systems refuse."""
    named = F.filter(F.split(x, r"[/\\]"), lambda part: part != "")
    clean = F.btrim(F.regexp_replace(F.coalesce(F.element_at(F.when(F.size(named) > 0, named), -1), F.lit("")), REFUSED, "_"), F.lit(" ."))
    return F.when(clean == "", "upload").otherwise(clean)


def numbers_in(x: Column) -> Column:
    """Numbers of a text as plain texts; bracketed identifiers and ISO dates don't count."""
    bare = F.regexp_replace(x, NOT_NUMBERS, " ")
    return F.transform(F.regexp_extract_all(F.concat(F.lit(" "), bare), F.lit(NUMBER), F.lit(1)), lambda t: F.translate(t, ",", ""))


def unit_multiplier(x: Column) -> Column:
    """What a unit note multiplies amounts by: the unit that the text after its label, or the text itself, begins with."""
    parts = F.split(F.regexp_replace(x, r"\s", ""), UNIT_LABEL, 2)
    unit = F.element_at(parts, -1)
    return F.coalesce(*[F.when(unit.startswith(name), F.lit(n)) for name, n in UNITS], F.lit(1))


def masked_number(x: Column) -> tuple[Column, Column]:
    masked = x.contains("*")
    return F.when(~masked, F.replace(x, F.lit(","), F.lit("")).try_cast("bigint")), masked


def cents_half_up(x: Column) -> tuple[Column, Column]:
    """(cents, whether rounding changed them) of a decimal text; null for anything else."""
    exact = x.try_cast("decimal(28,8)") * 100
    cents = F.round(exact, 0).cast("long")
    return cents, F.coalesce(exact != cents, F.lit(False))


def event_day(x: Column) -> Column:
    """The date in a timestamp text's own offset."""
    return F.substring(x, 1, 10).try_cast("date")


def redact_url(x: Column) -> Column:
    kept = F.regexp_replace(x, r"([?&]OC=)test(&|$)", "$1\x01$2")
    return F.replace(F.regexp_replace(kept, r"([?&]OC=)[^&\x01]+", "$1***"), F.lit("\x01"), F.lit("test"))


def column_letter(n: Column) -> Column:
    """1 to A, 27 to AA, 703 to AAA: enough for every spreadsheet."""
    letter = lambda k: F.chr((k % 26 + 65).cast("long"))
    a = letter(n - 1)
    b = F.when(n > 26, letter(F.floor((n - 27) / 26))).otherwise("")
    c = F.when(n > 702, letter(F.floor((n - 703) / 676))).otherwise("")
    return F.concat(c, b, a)


@query("b01_parse_amount", """
WITH t AS (SELECT o_orderkey AS k, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS n FROM orders),
x AS (SELECT k, n, CASE k % 11 WHEN 0 THEN format('{:,}', n) || '원' WHEN 1 THEN '₩ ' || format('{:,}', n) WHEN 2 THEN '(' || format('{:,}', n) || ')' WHEN 3 THEN '△' || n
  WHEN 4 THEN '▲ ' || format('{:,}', n) WHEN 5 THEN n || '-' WHEN 6 THEN '+' || n WHEN 7 THEN n || '.00' WHEN 8 THEN n || '.5' WHEN 9 THEN '-' ELSE 'abc' || n END AS text FROM t)
SELECT k, text, CASE WHEN k % 11 IN (2, 3, 4, 5) THEN -n WHEN k % 11 < 8 THEN n END AS amount, CASE k % 11 WHEN 8 THEN 'fractional' WHEN 10 THEN 'not an amount' END AS error FROM x""")
def q_amount(spark, d):
    n = F.col("n")
    comma = F.format_number(n, 0)
    forms = [F.concat(comma, F.lit("원")), F.concat(F.lit("₩ "), comma), F.concat(F.lit("("), comma, F.lit(")")), F.concat(F.lit("△"), n), F.concat(F.lit("▲ "), comma), F.concat(n, F.lit("-")), F.concat(F.lit("+"), n), F.concat(n, F.lit(".00")), F.concat(n, F.lit(".5")), F.lit("-"), F.concat(F.lit("abc"), n)]
    text = F.element_at(F.array(*forms), (F.col("k") % 11 + 1).cast("int"))
    x = v.read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), v.cents("o_totalprice").alias("n")).withColumn("text", text)
    return x.withColumn("parsed", amount_of(F.col("text"))).select("k", "text", F.col("parsed.number").alias("amount"), "parsed.error")


@query("b02_b03_parse_date_time", """
SELECT o_orderkey AS k, CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day,
  CASE o_orderkey % 3 WHEN 0 THEN lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':07:00' WHEN 1 THEN lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':45:09' END AS time FROM orders""")
def q_date(spark, d):
    day = F.col("o_orderdate").cast("date")
    f = lambda p: F.date_format(day, p)
    serial = F.datediff(day, F.lit("1899-12-30").cast("date")).cast("string")
    texts = F.array(f("yyyy. M. d."), f("yyyyMMdd"), F.concat(f("yyyyMMdd"), F.lit("134509")), F.concat(f("yyyy"), F.lit("년 "), f("M"), F.lit("월 "), f("d"), F.lit("일")), serial, F.concat(f("MM/dd/yyyy")))
    k = F.col("o_orderkey")
    hour = F.lpad((k % 24).cast("string"), 2, "0")
    times = F.array(F.concat((k % 24).cast("string"), F.lit(":07")), F.concat(hour, F.lit("4509")), F.concat(hour, F.lit(":61")))
    x = v.read(spark, d, "orders").select(k.alias("k"), F.element_at(texts, (k % 6 + 1).cast("int")).alias("t"), F.element_at(times, (k % 3 + 1).cast("int")).alias("h"))
    return x.select("k", parse_date(F.col("t")).alias("day"), parse_time(F.col("h")).alias("time"))


@query("b04_parse_ids", """
SELECT c_custkey AS k, 'ID00' || c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN substr(b, 1, 3) || '-' || substr(b, 4, 2) || '-' || substr(b, 6) ELSE 'x' || b END AS brn, CAST(c_custkey % 90 AS INTEGER) AS days
FROM (SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), CASE WHEN c_custkey % 2 = 0 THEN 10 ELSE 9 END, '1') AS b FROM customer)""")
def q_ids(spark, d):
    k = F.col("c_custkey")
    brn = F.when(k % 2 == 0, F.lpad(k.cast("string"), 10, "1")).otherwise(F.concat(F.lit(" x"), F.lpad(k.cast("string"), 9, "1")))
    return v.read(spark, d, "customer").select(k.alias("k"), parse_id(F.concat(F.lit(" ID 00"), k, F.lit(" "))).alias("id"), parse_brn(brn).alias("brn"), parse_int(F.concat((k % 90).cast("string"), F.lit("일"))).alias("days"))


@query("b05_b06_b07_normalize", """
SELECT c_custkey AS k, 'customer#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS name, 'PO' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS ref, '공급가액' || c_custkey AS header FROM customer""")
def q_normalize(spark, d):
    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("(주) "), "c_name")).when(k % 3 == 1, F.concat(F.col("c_name"), F.lit(" Co., Ltd."))).otherwise(F.concat(F.lit("주식회사 "), "c_name", F.lit(" Inc.")))
    ref = F.concat(F.lit(" po-"), F.lpad(k.cast("string"), 6, "0"), F.lit("/"))
    return v.read(spark, d, "customer").select(k.alias("k"), normalize_counterparty(name).alias("name"), normalize_ref(ref).alias("ref"), normalize_header(F.concat(F.lit("공급 가액"), k, F.lit("(원)"))).alias("header"))


@query("b08_words_to_kinds", """
SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'direct' WHEN 1 THEN 'consignment' WHEN 2 THEN 'subcontract' END AS trade,
  CASE p_partkey % 6 WHEN 0 THEN 'deduction' WHEN 1 THEN 'return' WHEN 2 THEN 'fee' WHEN 3 THEN 'refund' WHEN 4 THEN 'sale' END AS kind FROM part""")
def q_words(spark, d):
    pick = lambda words: F.element_at(F.array(*map(F.lit, words)), (F.col("p_partkey") % len(words) + 1).cast("int"))
    trades, kinds = ("직 매입 거래", "위탁판매-A", "(하도급)", "기타"), ("판촉비 매출", "반품(매출)", "판매 수수료", "환불", "정상 매출", "기타")
    return v.read(spark, d, "part").select(F.col("p_partkey").alias("k"), trade_type(pick(trades)).alias("trade"), line_kind(pick(kinds)).alias("kind"))


@query("b11_missing_fields", v.with_views("line") + """
SELECT id, array_to_string(list_filter([
  CASE WHEN (trade_type IS NULL OR trade_type <> 'consignment') AND received IS NULL THEN 'goods_received_date' END,
  CASE WHEN (trade_type IS NULL OR trade_type = 'consignment') AND closed IS NULL THEN 'sales_close_date' END,
  CASE WHEN trade_type IS NULL THEN 'trade_type' END], lambda x: x IS NOT NULL), ',') AS missing FROM v_line""")
def q_missing(spark, d):
    x = v.lines(spark, d)
    return x.select("id", F.array_join(missing_base_fields(F.col("trade_type"), F.col("received"), F.col("closed")), ",").alias("missing"))


def canonical(*columns: str) -> Column:
    """The columns as one text in which rows that differ, nulls included, never look alike: each value with its length."""
    one = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    return F.concat_ws("|", *[one(c) for c in columns])


@query("b15_b24_canonical_hash", """
SELECT l_orderkey AS k, l_linenumber AS n, sha256(length(CAST(l_orderkey AS VARCHAR)) || ':' || l_orderkey || '|' || length(CAST(l_linenumber AS VARCHAR)) || ':' || l_linenumber || '|' || length(CAST(l_partkey AS VARCHAR)) || ':' || l_partkey) AS row_key,
  CAST(row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey ORDER BY l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax) AS INTEGER) AS occurrence FROM lineitem""")
def q_hash(spark, d):
    from pyspark.sql.window import Window as W

    w = W.partitionBy("l_orderkey", "l_linenumber", "l_partkey").orderBy("l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    key = F.sha2(canonical("l_orderkey", "l_linenumber", "l_partkey"), 256)
    return v.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), key.alias("row_key"), F.row_number().over(w).alias("occurrence"))


@query("b16_b17_safe_text", """
SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN '''=SUM(' || c_custkey || ')' WHEN 1 THEN '-' || c_custkey WHEN 2 THEN '''@' || c_name ELSE c_name END AS escaped,
  CASE c_custkey % 4 WHEN 0 THEN 'SUM(' || c_custkey || ')' WHEN 1 THEN '-' || c_custkey ELSE c_name END AS stripped, 'a_b' || c_custkey || '.csv' AS file FROM customer""")
def q_safe(spark, d):
    k = F.col("c_custkey")
    text = F.when(k % 4 == 0, F.concat(F.lit("=SUM("), k, F.lit(")"))).when(k % 4 == 1, F.concat(F.lit("-"), k)).when(k % 4 == 2, F.concat(F.lit("@"), "c_name")).otherwise(F.col("c_name"))
    return v.read(spark, d, "customer").select(k.alias("k"), escape_formula(text).alias("escaped"), strip_formula(text).alias("stripped"), safe_filename(F.concat(F.lit("..\\x/a:b"), k, F.lit(".csv"))).alias("file"))


@query("b18_b19_b20_numbers", """
SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) || ';-' || CAST(o_custkey AS VARCHAR) || ';' || CAST(CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS VARCHAR) AS numbers,
  CAST(CASE o_orderkey % 3 WHEN 0 THEN 1000 WHEN 1 THEN 1000000 ELSE 1 END AS INTEGER) AS unit, CASE WHEN o_orderkey % 2 = 0 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) END AS plain, o_orderkey % 2 = 1 AS masked FROM orders""")
def q_numbers(spark, d):
    k, n = F.col("o_orderkey"), v.cents("o_totalprice")
    text = F.concat(F.lit("no "), k, F.lit(" [id 99] on 2024-05-06 paid (-"), "o_custkey", F.lit(") of "), F.format_number(n, 0), F.lit("."))
    unit = F.element_at(F.array(F.lit("(단위 : 천 원)"), F.lit("단위: 백만원, %"), F.lit("원")), (k % 3 + 1).cast("int"))
    plain, masked = masked_number(F.when(k % 2 == 0, F.format_number(n, 0)).otherwise(F.concat(F.lit("**,"), n)))
    return v.read(spark, d, "orders").select(k.alias("k"), F.array_join(numbers_in(text), ";").alias("numbers"), unit_multiplier(unit).alias("unit"), plain.alias("plain"), masked.alias("masked"))


@query("b21_b22_b23_b25_misc", """
SELECT event_id AS k, CAST(round(CAST(value AS DECIMAL(28,4)) * 100 + CASE WHEN event_id % 2 = 0 THEN 0.5 ELSE 0 END, 0) AS BIGINT) AS cents, event_id % 2 = 0 AS rounded, CAST(ts AS DATE) AS day,
  'http://h/?OC=' || CASE WHEN event_id % 3 = 0 THEN 'test' ELSE '***' END || '&x=1' AS url,
  CASE WHEN event_id % 2000 >= 702 THEN chr(CAST(65 + (event_id % 2000 - 702) // 676 AS INTEGER)) ELSE '' END || CASE WHEN event_id % 2000 >= 26 THEN chr(CAST(65 + ((event_id % 2000 - 26) // 26) % 26 AS INTEGER)) ELSE '' END || chr(CAST(65 + event_id % 26 + (event_id % 2000 - event_id) % 26 AS INTEGER) % 26 + CASE WHEN CAST(65 + event_id % 26 + (event_id % 2000 - event_id) % 26 AS INTEGER) % 26 >= 13 THEN 52 ELSE 78 END) AS letters FROM events""")
def q_misc(spark, d):
    k = F.col("event_id")
    text = F.concat(F.col("value").cast("decimal(28,2)").cast("string"), F.when(k % 2 == 0, "5").otherwise(""))
    cents, rounded = cents_half_up(text)
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+09:00"))
    url = F.concat(F.lit("http://h/?OC="), F.when(k % 3 == 0, "test").otherwise(F.concat(F.lit("key"), k)), F.lit("&x=1"))
    return v.read(spark, d, "events").select(k.alias("k"), cents.alias("cents"), rounded.alias("rounded"), event_day(stamp).alias("day"), redact_url(url).alias("url"), column_letter(k % 2000 + 1).alias("letters"))
