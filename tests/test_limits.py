"""What used to be cut off in silence: vocabularies, candidates, far days, long numbers, short passages."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ledgerloom.functions.values import amount_of
from ledgerloom.operators import intake, rules


def test_a_vocabulary_of_any_size_counts(spark):
    words = spark.range(30_000).select(F.concat(F.lit("word"), "id", F.lit("z")).alias("word"))
    cells = spark.createDataFrame([(1, 1, 1, "x"), (1, 1, 2, "y"), (1, 2, 1, "Word 29999z"), (1, 2, 2, "the word7z too"), (2, 5, 1, "a"), (2, 5, 2, "b")], "doc int, row int, col int, text string")
    found = {r.doc: (r.row, r.score, r.sure) for r in intake.header_rows(cells, words).collect()}
    assert found == {1: (2, 4, True), 2: (5, 0, False)}
    assert {r.doc: r.row for r in intake.header_rows(cells, words.limit(0)).collect()} == {1: 1, 2: 5}


def test_numbers_beyond_64_bits_say_so(spark):
    texts = ["9223372036854775807", "9223372036854775808", "(12,345,678,901,234,567,890)", "12", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(amount_of(F.col("t")).alias("a")).select("a.*").collect()
    assert [(r.number, r.error) for r in rows] == [(9223372036854775807, None), (None, "out of range"), (None, "out of range"), (12, None), (None, None)]


def test_due_days_beyond_the_calendar_are_rolled(spark):
    days = [dt.date(2032, 12, 20), dt.date(2099, 8, 1), dt.date(1990, 1, 5)]
    facts = spark.createDataFrame([(f"L{i}", "direct", d, None, 100, None, None) for i, d in enumerate(days)], "id string, trade_type string, received date, closed date, amount long, rollover boolean, paid date")
    known = rules.rule_versions(spark, (("direct_term", "x", "1900-01-01", None, "1900-01-01", 60, None, None, None),))
    found = rules.due(facts, known, rules.calendar(spark), "2100-01-01").select("id", "variant", "due").collect()
    assert all(r.due is not None for r in found)
    by = {(r.id, r.variant): r.due for r in found}
    assert by["L0", "rollover_off"] == dt.date(2033, 2, 18) and ("L0", "rollover_on") not in by  # a Friday
    assert by["L1", "rollover_off"] == dt.date(2099, 9, 30) and by["L2", "rollover_off"] == dt.date(1990, 3, 6)
    far = spark.createDataFrame([(dt.date(2033, 1, 1),), (dt.date(2044, 10, 8),), (dt.date(2025, 10, 3),)], "d date").select(rules.next_business_day(F.col("d")).alias("n")).collect()
    assert [r.n for r in far] == [dt.date(2033, 1, 3), dt.date(2044, 10, 10), dt.date(2025, 10, 10)]
    same = rules.calendar(spark).withColumn("n", rules.next_business_day(F.col("day"))).filter("day < '2032-12-01' AND n <> next_business_day")
    assert same.isEmpty()


def test_html_spans_reach_as_far_as_the_table(spark):
    from ledgerloom.operators.ingest import html_cells

    pages = ['<table><tr><td rowspan=9>a<td>b<tr><td>c</table>', '<table><tr><td colspan="5000">x</td></tr></table>', "<table><tr><td>o<table><tr><td>i</table></td><td>p</td></tr></table>", "no table", None, '<table><tr><td rowspan="2">a</td><td colspan="2">b</td></tr><tr><td>c</td><td>d</td><td>e</td></tr></table>']
    found = html_cells(spark.createDataFrame(list(enumerate(pages)), "page long, html string"), "page", "html").collect()
    by = {}
    for r in found:
        by.setdefault(r.page, []).append((r.tbl, r.row, r.col, r.text))
    assert sorted(by[0]) == [(1, 1, 1, "a"), (1, 1, 2, "b"), (1, 2, 1, "a"), (1, 2, 2, "c")]
    assert len(by[1]) == 1000 and 3 not in by and 4 not in by
    assert sorted(by[2]) == [(1, 1, 1, "o"), (1, 1, 2, "p"), (2, 1, 1, "i")]
    assert sorted(by[5]) == [(1, 1, 1, "a"), (1, 1, 2, "b"), (1, 1, 3, "b"), (1, 2, 1, "a"), (1, 2, 2, "c"), (1, 2, 3, "d"), (1, 2, 4, "e")]


def test_a_rule_version_is_registered_once(spark):
    import pytest

    known = rules.rule_versions(spark)
    with pytest.raises(ValueError, match="already"):
        rules.register(known, known.limit(1))


def test_plain_pages_give_what_the_parser_gives():
    import random

    from ledgerloom.operators.ingest import _PAGE, _Cells

    rnd, quick = random.Random(7), 0
    bits = ["<table>", "</table>", "<tr>", "</tr>", "<td>", "<TD rowspan=\"2\">", '<th colspan="3" class="x y">', "</td>", "</th>", "a", " b &amp; &lt;c ", "&notit; &#65", "x\n y", "<p>", "</p>", "<br>"]
    odd = ["<!-- <td>z -->", "<td rowspan=2>", "<br/>", "<script>'<td>'</script>", "<", "<td", "</td >", '<td title="&quot;">', "<textarea><td></textarea>", "<?x>", ">", "&"]
    for n in range(3000):
        page = "".join(rnd.choice(bits if n % 2 or rnd.random() < 0.9 else odd) for _ in range(rnd.randint(1, 25))) + rnd.choice(["</table>", "</td></tr></table>", "", "end"])
        slow = _Cells()
        slow.feed(page)
        assert _Cells().read(page) == slow.out, page
        quick += bool(_PAGE.fullmatch(page))
    assert quick > 1000
