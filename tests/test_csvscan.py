"""Cells and their places, whatever the files' sizes and splits, against a sequential reading."""

from __future__ import annotations

import random

import pytest

from ledgerloom.sources import csvscan
from ledgerloom.sources.csvscan import Limits, scan


def cells_of(text, d):
    """One character at a time: [(row, col, line, start, end, text)], or None where a quote never closes."""
    out, row, col, line, state, start, value = [], 1, 1, 1, "new", 0, ""
    at, n = 0, len(text)
    record = []

    def close(end):
        record.append((row, col, first, start, end, value))

    first = line
    while True:
        ch = text[at] if at < n else None
        if state == "new":
            start, value, first = at, "", line
            if ch == '"':
                state, start = "quoted", at + 1
            else:
                if ch is None and not record:
                    return out
                state = "plain"
                continue
        elif state == "quoted":
            if ch is None:
                return None
            if ch == '"' and at + 1 < n and text[at + 1] == '"':
                value, at = value + '"', at + 1
            elif ch == '"':
                close(at)
                state = "after"
            else:
                line += ch == "\n"
                value += ch
        else:
            if state == "plain" and ch is not None and ch not in (d, "\r", "\n"):
                value += ch
            elif ch is None or ch in (d, "\r", "\n"):
                if state == "plain":
                    close(at)
                if ch == d:
                    col, state = col + 1, "new"
                    if at + 1 == n:
                        start, value, first, at = n, "", line, n
                        close(n)
                        ch = None
                if ch is None or ch in "\r\n":
                    if not (len(record) == 1 and record[0][3] == record[0][4]):
                        out += record
                    record, row, col, line, state = [], row + 1, 1, line + 1, "new"
                    if ch == "\r" and at + 1 < n and text[at + 1] == "\n":
                        at += 1
                    if ch is None or at + 1 >= n:
                        return out
        at += 1


def read(spark, path, **options):
    files, cells = scan(spark, path, **options)
    return {r.file.rsplit("/", 1)[1]: r for r in files.collect()}, sorted((r.file.rsplit("/", 1)[1], r.row, r.col, r.line, r.start, r.end, r.text) for r in cells.collect())


def test_the_sequential_reading_itself():
    text = 'a,"b ""q"" c","multi\nline"\r\n\r\nx,y,\n'
    found = cells_of(text, ",")
    assert [(c[0], c[1], c[5]) for c in found] == [(1, 1, "a"), (1, 2, 'b "q" c'), (1, 3, "multi\nline"), (3, 1, "x"), (3, 2, "y"), (3, 3, "")]
    assert all(text[c[3] : c[4]].replace('""', '"') == c[5] for c in found)


def test_line_maps_compose_like_reading_on(spark):
    rnd = random.Random(2)
    for _ in range(3000):
        line = "".join(rnd.choice('ab",\r"') for _ in range(rnd.randint(0, 9)))
        for inside in (False, True):
            fields, after = csvscan.cut_line(line, inside, ",")
            to, ended, reset, closed = csvscan.line_map(line, inside, ",")
            assert to == after and ended == fields[-1][0] + (not after) and reset == (ended > 0)
            assert closed == (sum(f[0] == fields[-1][0] for f in fields) - 1 if after else 0)


@pytest.mark.parametrize("split", [7, 40, None])
def test_any_split_gives_the_cells_of_a_sequential_reading(spark, tmp_path, split):
    rnd = random.Random(split or 1)
    texts = {}
    for i in range(8 if split else 60):
        n = rnd.randint(0, 100)
        texts[f"f{i}.csv"] = "".join(rnd.choice(['"', '"', ",", "\n", "\n", "\r\n", "\r", "a", "é", "日본", "🙂", '""', 'x"y', ',"']) for _ in range(n))
    texts["long.csv"] = 'k,"' + "line\n" * (split or 300) + '""end""",z\n' + "q,w\n" * 5
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    files, cells = read(spark, str(tmp_path), split=split, delimiter=",")
    want = {name: cells_of(text, ",") for name, text in texts.items()}
    for name, text in texts.items():
        status = "empty" if not text else "corrupt" if want[name] is None else "parsed"
        assert files[name].status == status, name
    assert cells == sorted((name, *c) for name, found in want.items() for c in found or [])


def test_encodings_delimiters_and_numbering(spark, tmp_path):
    bank = '은행 거래내역\r\n계좌 : 1-2\r\n\r\n일시,적요,금액\r\n2025.10.21,"임대료, 10월","1,000,000"\r\n합계,,"1,000,000"\r\n'
    (tmp_path / "bank.csv").write_bytes(bank.encode("cp949"))
    (tmp_path / "tab.csv").write_bytes("﻿일자\t금액\n2025-10-20\t000123\n".encode())
    (tmp_path / "semi.csv").write_bytes(b"a;b;c\n1;2;3\n4;5;6\n")
    (tmp_path / "pipe.csv").write_bytes(b"a|b\n1|2\n")
    (tmp_path / "one.csv").write_bytes("똠방각하\n".encode("cp949"))
    files, cells = read(spark, str(tmp_path))
    got = {n: (f.status, f.encoding, f.delimiter, f.records) for n, f in files.items()}
    assert got == {"bank.csv": ("parsed", "cp949", ",", 6), "tab.csv": ("parsed", "utf-8", "\t", 2), "semi.csv": ("parsed", "utf-8", ";", 3), "pipe.csv": ("parsed", "utf-8", "|", 2), "one.csv": ("parsed", "cp949", ",", 1)}
    mine = [c for c in cells if c[0] == "bank.csv"]
    assert all(bank[c[4] : c[5]] == c[6] for c in mine) and [c[6] for c in mine if c[1] == 5] == ["2025.10.21", "임대료, 10월", "1,000,000"]
    assert [c[1:3] + c[3:4] + c[6:] for c in mine if c[1] == 4] == [(4, 1, 4, "일시"), (4, 2, 4, "적요"), (4, 3, 4, "금액")]
    tab = "일자\t금액\n2025-10-20\t000123\n"
    assert [(c[6], tab[c[4] : c[5]]) for c in cells if c[0] == "tab.csv"] == [(x, x) for x in ("일자", "금액", "2025-10-20", "000123")]


def test_broken_oversized_and_unknown_files_come_back_as_rows(spark, tmp_path):
    (tmp_path / "good.csv").write_bytes(b"a,b\n1,2\n")
    (tmp_path / "open.csv").write_bytes(b'a,"b\n1,2\n')
    (tmp_path / "nul.csv").write_bytes(b"a,b\n1,\x002\n")
    (tmp_path / "bytes.csv").write_bytes(b"a,b\n\xff\xff\xff,2\n")
    (tmp_path / "wide16.csv").write_bytes("a,b\n".encode("utf-16"))
    (tmp_path / "big.csv").write_bytes(b"a,b\n" * 200)
    (tmp_path / "rows.csv").write_bytes(b"a,b\n" * 20)
    (tmp_path / "cols.csv").write_bytes(b"a,b\nx,y,z,w\n")
    (tmp_path / "none.csv").write_bytes(b"")
    files, cells = read(spark, str(tmp_path), limits=Limits(max_bytes=400, max_rows=10, max_cols=3))
    assert {n: (f.status, f.code) for n, f in files.items()} == {
        "good.csv": ("parsed", None), "open.csv": ("corrupt", "csv"), "nul.csv": ("corrupt", "binary"), "bytes.csv": ("corrupt", "bad_encoding"), "wide16.csv": ("corrupt", "bad_encoding"),
        "big.csv": ("rejected", "size"), "rows.csv": ("rejected", "rows"), "cols.csv": ("rejected", "cols"), "none.csv": ("empty", None),
    }
    assert {c[0] for c in cells} == {"good.csv"} and files["cols.csv"].message == "row 2: too many columns"


def test_lines_of_closed_fields_give_the_same_map_without_a_cut(monkeypatch):
    """Lines of one record are mapped by patterns: what was cut field by field, under both assumptions, before."""
    rnd, cut, cuts = random.Random(3), csvscan.cut_line, []

    def by_fields(line, inside, d):
        fields, after = cut(line, inside, d)
        last = fields[-1][0]
        return (True, last, last > 0, sum(f[0] == last for f in fields) - 1) if after else (False, last + 1, True, 0)

    lines = [("".join(rnd.choice(['"', '""', ",", ";", "a", " ", "b" if n % 8 else "\r"]) for _ in range(rnd.randint(1, 14))), rnd.choice(",;")) for n in range(8000)]
    monkeypatch.setattr(csvscan, "cut_line", lambda *a: cuts.append(a) or cut(*a))
    for line, d in lines:
        if '"' in line:
            for inside in (False, True):
                assert csvscan.line_map(line, inside, d) == by_fields(line, inside, d), (line, d)
    assert cuts and all("\r" in a[0] for a in cuts)
