"""Lines that repeat: every line takes part, whichever of its facts it has."""

from __future__ import annotations

import datetime as dt
import random

from compare import assert_same, connect

from ledgerloom import registry
from ledgerloom.operators import linkage


def test_duplicates_of_random_lines_equal_all_pairs(spark):
    rnd = random.Random(3)
    day = lambda: rnd.choice([None, *[dt.date(2025, 1, n) for n in range(1, 5)]])
    rows = [(f"L{n}", rnd.choice(["a", "a", "b", None]), rnd.randint(0, 2), day()) for n in range(150)]
    place = lambda r: (r[3] is None, r[3] or dt.date.min, r[2], r[0])
    want = {}
    for r in rows:
        earlier = sorted((e for e in rows if r[1] is not None and e[1] == r[1] and e[2] != r[2] and place(e) < place(r)), key=place)
        want[r[0]] = (len(earlier), earlier[0][0] if earlier else None)
    found = linkage.duplicates(spark.createDataFrame(rows, "id string, key string, version int, seen date"))
    assert {r.id: (r.n_earlier, r.first) for r in found.collect()} == want


def test_lines_without_a_date_of_receipt_are_looked_at(spark, tmp_path):
    """Part 50 has no date of receipt and part 51 no date of closing; before, the former's lines were left out."""
    con = connect(str(tmp_path))
    rows = {
        "customer": "SELECT 1::BIGINT AS c_custkey, 'C1' AS c_name",
        "orders": "SELECT 1::BIGINT AS o_orderkey, 1::BIGINT AS o_custkey",
        "lineitem": "SELECT 1::BIGINT AS l_orderkey, p::BIGINT AS l_partkey, 1::BIGINT AS l_suppkey, n::INTEGER AS l_linenumber, 1.0::DOUBLE AS l_quantity, 7.0::DOUBLE AS l_extendedprice, 0.0::DOUBLE AS l_discount, 0.0::DOUBLE AS l_tax, 'N' AS l_returnflag, CAST(day AS TIMESTAMP) AS l_shipdate FROM (VALUES (50, 1, '1998-01-05'), (51, 2, '1998-01-06'), (52, 3, '1998-01-07'), (50, 4, NULL)) t(p, n, day)",
    }
    for name, sql in rows.items():
        con.execute(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    found = linkage.q_duplicates(spark, str(tmp_path))
    assert assert_same(found, connect(str(tmp_path)), registry.ORACLE_SQL["d07_d10_h03_duplicate_lines"]) == 4
    assert {r.id: (r.n_earlier, r.first) for r in found.collect()} == {"L1-2": (0, None), "L1-3": (1, "L1-2"), "L1-1": (2, "L1-2"), "L1-4": (2, "L1-2")}  # L1-1 begins with its closing
