"""Budgets, captions and event logs against plain loops."""

from __future__ import annotations

import random

from compare import spark_rows

from ledgerloom.operators import captions, records
from ledgerloom.sources import files


def test_admission_equals_a_fold_with_a_hot_key(spark):
    rnd = random.Random(3)
    rows = [("hot" if n % 3 == 0 else f"k{n % 50}", rnd.randint(0, 30), n, rnd.choice([None, 0, 5, 40, 400])) for n in range(3000)] + [(None, 1, -1, 1)]
    room = {"hot": 9000, **{f"k{n}": rnd.choice([0, 100, 800]) for n in range(48)}}
    used, want = {}, []
    for key, at, i, amount in sorted((r for r in rows if r[0]), key=lambda r: (r[0], r[1], r[2])):
        fits = key in room and amount is not None and used.get(key, 0) + amount <= room[key]
        used[key] = used.get(key, 0) + (amount if fits else 0)
        want.append((key, at, i, amount, fits, used[key]))
    df = spark.createDataFrame(rows, "key string, at int, id int, amount int")
    found = records.admitted(df, spark.createDataFrame(list(room.items()), "key string, room int"))
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))
    assert records.admitted(df.limit(0), spark.createDataFrame([], "key string, room int")).count() == 0


def in_turn(kinds):
    """[(pos, caption, place)] of the images of one document."""
    own, how, used = {}, {}, set()
    for c, kind in enumerate(kinds):
        nxt = next((i for i in range(c + 1, len(kinds)) if kinds[i] == "image"), None)
        if kind == "caption" and nxt is not None and nxt not in own and nxt - c - 1 <= captions.UNITS and all(k == "unit" for k in kinds[c + 1 : nxt]):
            own[nxt], how[nxt] = c, "before"
            used.add(c)
    for c, kind in enumerate(kinds):
        if kind == "caption" and c not in used and c and kinds[c - 1] == "image" and c - 1 not in own:
            own[c - 1], how[c - 1] = c, "after"
    out, last = [], None
    for i, kind in enumerate(kinds):
        if kind == "image":
            follows = i > 0 and kinds[i - 1] == "image"
            last = own.get(i, last if follows else None)
            out.append((i, last, how.get(i, "continued" if follows else "none")))
    return out


def test_captions_equal_a_reading_in_turn(spark):
    rnd = random.Random(5)
    docs = {d: [rnd.choice(["caption", "image", "image", "unit", "unit", "text"]) for _ in range(rnd.randint(0, 25))] for d in range(150)}
    docs[200] = ["image"] * 40 + ["caption"]
    df = spark.createDataFrame([(d, p, k) for d, ks in docs.items() for p, k in enumerate(ks)], "doc int, pos int, kind string")
    found = {tuple(r) for r in captions.pair_captions(df).collect()}
    assert found == {(d, *x) for d, ks in docs.items() for x in in_turn(ks)}


def test_event_logs_with_escapes_and_missing_values(spark, tmp_path):
    rows = [("a & b", 0, '<"x">', "2020-01-01", None), ("a & b", 1, "y;'", "2020-01-02", "3"), ("t", 0, "日本", None, "0")]
    df = spark.createDataFrame(rows[:2] + [("t", 0, "日本", "2020-01-03", "0")], "trace string, no int, activity string, at string, amount string")
    path = str(tmp_path / "log")
    files.write_event_log(df, path)
    assert spark_rows(files.read_event_log(spark, path)) == spark_rows(df)


def test_a_longer_event_log_has_more_files(spark, sf_dir, monkeypatch):
    from compare import spark_rows

    from ledgerloom.sources import files

    paths, write = [], files.write_event_log
    monkeypatch.setattr(files, "write_event_log", lambda df, path: (write(df, path), paths.append(path)))
    monkeypatch.setattr(files, "FILE_EVENTS", 100, raising=False)
    got = spark_rows(files.q_event_log_stream(spark, sf_dir))
    assert got == spark_rows(files._user_events(spark, sf_dir).select("trace", "no", "activity", "at", "amount").withColumn("trace", files.F.col("trace").cast("string")))
    assert len([n for n in files.listed(spark, paths[0]) if n.startswith("part-")]) > 3  # 3 of any length before
