"""The pipeline's stages on small tables, against brute force."""

from __future__ import annotations

import random
import re

import corpus_pipeline
import pyarrow as pa
from pyspark.sql import functions as F
from test_operators import docs_of

from ledgerloom.llm import line_dedup, mixing, pieces, stages


def least_of_classes(texts, width=5, num=80) -> set[int]:
    """The least index of each component of linked texts."""
    root, words = list(range(len(texts))), [t.split() for t in texts]
    sets = [{tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} for w in words]

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if words[i] and words[j] and 100 * min(len(x), len(y)) >= num * max(len(x), len(y)) and 100 * len(x & y) >= num * len(x | y):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {find(i) for i in root}


def test_near_copies_by_five_words_and_four_fifths(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(4000)]
    texts = ["one two", "one two three"]
    for size in (40, 200):
        base = [rng.choice(words) for _ in range(size)]
        texts.append(" ".join(base))
        for part in (0.1, 0.2, 0.3):  # an insert in one place
            at = rng.randrange(size)
            texts.append(" ".join(base[:at] + [rng.choice(words) for _ in range(round(part * size))] + base[at:]))
    rng.shuffle(texts)
    got = {r["doc_id"] for r in stages.keep_one_of_a_class(spark, docs_of(spark, texts), None).select("doc_id").collect()}
    assert got == least_of_classes(texts)
    assert got != least_of_classes(texts, 4, 85)


ODD = "doc_id long, text string, lang string, source string, n_chars long, `_row` int, `_key` string, taken string"


def odd_rows(spark):
    """Repeated and missing ids, equal rows, empty and null texts, clashing columns."""
    one, two = "one two three four five six seven", "a text of its own with other words in it"
    rows = [(1, one), (1, two), (1, one), (2, one), (None, one), (None, "third text " * 9), (None, "third text " * 9), (5, None), (5, None), (6, ""), (None, None)]
    return spark.createDataFrame([(i, t, "en", None if k % 2 else "s", None, k % 2, "k", "t") for k, (i, t) in enumerate(rows)], ODD), rows


def test_one_row_of_each_class_stays_whatever_the_ids(spark):
    docs, rows = odd_rows(spark)
    out = stages.keep_one_of_a_class(spark, docs, None)
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in out.collect()))
    want = [(False, 1, rows[0][1]), (False, 1, rows[1][1]), (True, 0, rows[5][1]), (False, 5, ""), (False, 5, ""), (False, 6, ""), (True, 0, "")]
    assert got == sorted(want)
    equal = docs.limit(0).unionByName(docs.filter("doc_id = 2")).unionByName(docs.filter("doc_id = 2"))
    assert stages.keep_one_of_a_class(spark, equal, None).count() == 1
    assert stages.keep_one_of_a_class(spark, docs.limit(0), None).count() == 0


def test_the_mix_takes_each_row_by_itself(spark):
    docs, rows = odd_rows(spark)
    out = stages.mix_sources(spark, docs, None)
    assert out.columns == docs.columns and stages.mix_sources(spark, docs.limit(0), None).count() == 0
    mixed = mixing.mix(docs.withColumn("at", F.col("_row")), carry=["_row"]).collect()
    want = sorted((r["doc_id"] or -1, r["source"] or "", r["size"]) for r in mixed for _ in range(r["copies"]))
    got = sorted((r["doc_id"] or -1, r["source"] or "", len((r["text"] or "").split())) for r in out.collect())
    assert got == want and sorted(map(str, out.collect())) == sorted(map(str, stages.mix_sources(spark, docs.repartition(3), None).collect()))


def test_stages_on_odd_and_empty_tables(spark, sf_dir):
    docs, _ = odd_rows(spark)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), sf_dir)
        out = stage(spark, docs, sf_dir)
        assert empty.count() == 0 and out.count() > 0, name
        assert name.startswith("SentencePiece") or out.columns == docs.columns, name


def test_the_whole_pipeline_equals_its_stages_one_by_one(spark, sf_dir):
    """Each stage's own rule in plain Python over the table, and a second run."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = stages.drop_toxic(spark, docs, sf_dir)
    lines = stages.drop_boilerplate_lines(spark, kept, sf_dir).orderBy("doc_id").collect()
    texts = [r["text"] or "" for r in lines]
    known = stages.keep_one_of_a_class(spark, spark.createDataFrame(lines, docs.schema), sf_dir)
    least = least_of_classes(texts)
    assert sorted(r["doc_id"] for r in known.collect()) == sorted(r["doc_id"] for i, r in enumerate(lines) if i in least or not texts[i].split())
    copies = stages.mix_sources(spark, known, sf_dir).groupBy("doc_id").count().collect()
    samples = {r["doc_id"]: r["n"] for r in corpus_pipeline.run(spark, sf_dir).groupBy("doc_id").agg(F.countDistinct("sample").alias("s"), F.count("*").alias("n")).collect()}
    assert set(samples) == {r["doc_id"] for r in copies}
    assert all(r["count"] <= samples[r["doc_id"]] <= 2 * r["count"] for r in copies)


def test_lines_on_two_pages_of_a_hundred_go(spark, monkeypatch):
    texts = [f"body {i}\n" + "shared\n" * (i < 8) + "seldom\n" * (i < 4) + f"end {i}" for i in range(400)]
    want = [t.replace("shared\n", "") for t in texts]
    for rows in (line_dedup.BROADCAST_ROWS, 0):  # the lines to drop are broadcast, or joined
        monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", rows)
        got = stages.drop_boilerplate_lines(spark, docs_of(spark, texts), None).orderBy("doc_id").collect()
        assert [(r["text"], r["n_chars"]) for r in got] == [(t, len(t)) for t in want]


def test_one_of_a_third_of_copies_survives(spark):
    copied = "first of the copied text\nsecond line of it\nthird line with more words"
    texts = [copied if i % 3 == 0 else f"menu\nonly {i} {i * i} here\nand {i + 7} {i * 31} there" for i in range(90)]
    docs = stages.drop_boilerplate_lines(spark, docs_of(spark, texts), None)
    assert {r["text"] for r in docs.filter("doc_id % 3 = 0").collect()} == {copied}
    assert docs.filter("text LIKE '%menu%'").isEmpty()
    assert stages.keep_one_of_a_class(spark, docs, None).filter("doc_id % 3 = 0").select("doc_id").collect() == [(0,)]


def test_columns_of_any_name_and_type_travel_along(spark):
    """Names with dots, columns of maps and structs: through every stage and the line operator, values and all."""
    texts = ["one two three four five six seven eight"] * 3 + [f"menu here\nown words {i} of page {i * i}\nlast {i}" for i in range(9)] + [None, ""]
    docs = docs_of(spark, texts).withColumns({"a.b": F.concat(F.lit("v"), "doc_id"), "tags": F.create_map(F.lit("k"), "doc_id"), "s": F.struct(F.col("doc_id").alias("x.y"), F.array("doc_id").alias("z"))})
    docs = docs.withColumn("_key", F.lit(1)).withColumn("_place", F.lit(2))
    for stage in (stages.drop_boilerplate_lines, stages.keep_one_of_a_class, stages.mix_sources):
        out = stage(spark, docs, None)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r["a.b"] == f"v{r['doc_id']}" and r["tags"] == {"k": r["doc_id"]} and r["s"]["x.y"] == r["doc_id"] for r in rows)
    for most in (line_dedup.HOST_LINES, 0):  # looked up in each row, or joined
        line_dedup.HOST_LINES, old = most, line_dedup.HOST_LINES
        try:
            out = line_dedup.drop_boilerplate(docs)
            got = {r["doc_id"]: (r["text"], r["lines_dropped"], r["a.b"]) for r in out.collect()}
        finally:
            line_dedup.HOST_LINES = old
        assert got[5] == (texts[5].split("\n", 1)[1], 1, "v5") and got[12] == (None, 0, "v12") and got[0] == ("", 1, "v0")


def test_sets_of_slices_are_those_of_the_whole_column():
    import pyarrow as pa

    from ledgerloom.llm.shingles import shingle_sets

    rng = random.Random(4)
    texts = pa.array([None if i % 50 == 0 else " ".join(rng.choice(["a", "é", "word", "日本"]) for _ in range(rng.randrange(12))) for i in range(2500)])
    whole = [x.tolist() for x in shingle_sets(texts, 5)]
    assert [x.tolist() for i in range(0, len(texts), 1000) for x in shingle_sets(texts.slice(i, 1000), 5)] == whole


def test_an_encoder_gives_its_memory_back(spark):
    """What a Python process holds after a task is missing to the stages that run beside it later."""
    words = random.Random(5)
    texts = [" ".join(f"{words.getrandbits(40):x}" for _ in range(150)) for _ in range(6000)]
    batch = pa.RecordBatch.from_pydict({"key": list(range(len(texts))), "text": texts})
    del texts

    class Rows:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            self.run = run
            return self

        def withColumnRenamed(self, *_):  # noqa: N802
            return self

    def held() -> float:
        with open("/proc/self/smaps_rollup") as f:
            return int(re.search(r"\nPss_Anon:\s+(\d+)", f.read())[1]) / 1e3

    run = pieces.segmentations(Rows(), states=400_000, chars_at_once=300_000, keep=False).run
    assert sum(b.num_rows for b in run([batch.slice(0, 10)])) == 20  # the vocabulary is loaded
    before = held()
    assert sum(b.num_rows for b in run([batch])) == 12_000
    assert held() - before < 40
