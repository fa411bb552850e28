"""Tasks that grow in number with the input, not in what each of them holds: the same rows, dealt out."""

from __future__ import annotations

import pytest
from compare import assert_same

from ledgerloom import registry
from ledgerloom.plans import ledger as v

registry.load()
DEALT = [
    "c16_mapping_confidence",
    "c03_c04_c05_suggested_mapping",
    "c01_header_rows",
    "a06_html_tables",
    "a24_snapshot_invariants",
    "d07_d10_h03_duplicate_lines",
    "d22_fact_table_links",
    "d06_d09_d11_invoice_links",
]


@pytest.mark.parametrize("name", DEALT)
def test_tasks_follow_the_rows_of_the_input(spark, duck, sf_dir, monkeypatch, name):
    wanted = spark.sparkContext.defaultParallelism + 11  # more than the session has for a shuffle
    monkeypatch.setattr(v, "tasks", lambda rows, each=None: wanted)
    df = registry.QUERIES[name](spark, sf_dir)
    assert df.rdd.getNumPartitions() % wanted == 0
    assert assert_same(df, duck, registry.ORACLE_SQL[name]) > 0


def test_tasks_are_of_about_one_size():
    assert [v.tasks(n, 10) for n in (0, 1, 10, 11, 95)] == [0, 1, 1, 2, 10]
