"""Whole files to records: encodings, titles, totals, issues, and a mapping that the user confirms."""

from __future__ import annotations

import datetime as dt

from ledgerloom.operators import tabular


def test_a_bank_statement_and_a_file_that_needs_a_mapping(spark, tmp_path):
    bank = '은행 거래내역\r\n계좌 : 1-2\r\n\r\n일자,거래처,금액(원),비고\r\n2025.10.20,가나,"1,000,000",\r\n2025.10.21,,500,"임대료, 10월"\r\n일자,거래처,금액(원),비고\r\n2025-10-22,다라,x,\r\n합계,,"1,000,500",\r\n'
    (tmp_path / "bank.csv").write_bytes(bank.encode("cp949"))
    (tmp_path / "own.csv").write_text("날,돈,상대\n2025-10-20,1000,가나\n2025-10-21,(200),다라\n", encoding="utf-8")
    (tmp_path / "broken.csv").write_bytes(b'a,"b\n')
    got = tabular.ingest(spark, str(tmp_path))
    name = lambda p: p.rsplit("/", 1)[1]
    assert {name(r.file): r.status for r in got.files.collect()} == {"bank.csv": "parsed", "own.csv": "parsed", "broken.csv": "corrupt"}
    assert {name(r.doc): (r.status, r.header_row) for r in got.plans.collect()} == {"bank.csv": ("PARSED", 4), "own.csv": ("NEEDS_MAPPING", 1)}
    assert [(name(r.doc), r.row, r.day, r.counterparty, r.amount) for r in got.records.collect()] == [("bank.csv", 5, dt.date(2025, 10, 20), "가나", 1_000_000)]
    assert sorted((r.row, r.field, r.text) for r in got.issues.collect()) == [(6, "counterparty", ""), (8, "amount", "x")]
    accounts = {name(r.doc): (r.source, r.totals, r.repeated, r.with_issues, r.applied, r.computed, r.stated, r.agrees, r.balanced) for r in got.accounts.collect()}
    assert accounts == {"bank.csv": (5, 1, 1, 2, 1, 1_000_500, 1_000_500, True, True)}
    own = [r.doc for r in got.plans.collect() if r.doc.endswith("own.csv")][0]
    confirmed = spark.createDataFrame([(own, 1, "day"), (own, 2, "amount"), (own, 3, "counterparty")], "doc string, col long, field string")
    again = tabular.ingest(spark, str(tmp_path), confirmed=confirmed)
    assert {name(r.doc): r.status for r in again.plans.collect()} == {"bank.csv": "PARSED", "own.csv": "PARSED"}
    assert sorted((r.amount, r.counterparty) for r in again.records.filter("doc LIKE '%own.csv'").collect()) == [(-200, "다라"), (1000, "가나")]
