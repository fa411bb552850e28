"""Greedy assignment of many tables at once against a pass in order; scores and sample checks on single cases."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from ledgerloom.operators import mapping


def one_by_one(rows):
    """rows(doc, col, field, score, required) in order; a column and a field are taken once in a table."""
    out, used = set(), set()
    for doc, col, field, score, required in sorted(rows, key=lambda r: (-r[3], not r[4], r[1], r[2])):
        if (doc, col) not in used and (doc, field) not in used:
            used |= {(doc, col), (doc, field)}
            out.add((doc, col, field))
    return out


def test_greedy_equals_a_pass_in_order(spark):
    rnd, rows = random.Random(4), []
    required = {f"f{i}": i % 3 == 0 for i in range(9)}
    for doc in range(60):
        cols, most = rnd.randint(1, 12), rnd.choice([1, 3, 50])  # few scores: many ties
        rows += [(doc, c, f, rnd.randint(1, most), required[f]) for c in range(cols) for f in required if rnd.random() < 0.6]
    rows += [(100, c, f"g{f:03}", 1000 - abs(c - f), False) for c in range(40) for f in range(c, c + 2)]  # a chain: one pair a round at worst
    df = spark.createDataFrame(rows, "doc int, col int, field string, score int, required boolean")
    order = [(-F.col("score")).alias("a"), (~F.col("required")).alias("b")]
    found = mapping.greedy(df, "doc", "col", "field", order).select("doc", "col", "field").collect()
    assert len(found) == len(set(found)) and {tuple(r) for r in found} == one_by_one(rows)
    assert mapping.greedy(df.limit(0), "doc", "col", "field", order).count() == 0


def test_scores_exclusions_samples_and_confidence(spark):
    specs = mapping.field_specs(spark)
    headers = [(1, 0, "금액(원)"), (1, 1, "거래처명"), (1, 2, "거래 일자"), (1, 3, "할인 비율 금액"), (1, 4, None), (2, 0, "금"), (2, 1, "일"), (3, 0, "Amount"), (3, 1, "매출액")]
    samples = [(1, 0, "1,000"), (1, 2, "x"), (1, 2, "y"), (1, 2, "2025-01-01"), (3, 0, "abc"), (3, 0, ""), (3, 1, None)]
    h, s = spark.createDataFrame(headers, "doc int, col int, header string"), spark.createDataFrame(samples, "doc int, col int, text string")
    found = mapping.suggest(h, s, specs)
    got = {(r.doc, r.col): (r.field, r.score, r.confidence, r.share) for r in found.collect()}
    assert got[1, 0] == ("amount", 100, "HIGH", 1.0) and got[1, 1] == ("counterparty", 63, "MEDIUM", None)
    assert got[1, 2][:3] == ("day", 63, "LOW") and round(got[1, 2][3], 3) == 0.333  # contained, yet few values are days
    assert (1, 3) not in got and (1, 4) not in got and (2, 0) not in got and (2, 1) not in got  # excluded; no text; one letter
    assert got[3, 0] == ("amount", 100, "MEDIUM", 0.0) and (3, 1) not in got  # the first of two equal scores, one step lower
    over = {r.doc: (r.matched, r.unmapped_required, r.overall, r.needs_confirmation) for r in mapping.overview(h.select("doc").distinct(), found, specs).collect()}
    assert over == {1: (3, "", "LOW", True), 2: (0, "amount,counterparty,day", "NONE", True), 3: (1, "counterparty,day", "LOW", True)}
