"""Operators 11 to 13: SQL runs with the others; here brute force, the reference library, odd and empty tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
import tiktoken
from pyspark.sql import functions as F

from ledgerloom.llm import byte_bpe, importance, queries, spelling

DOCS = "doc_id long, text string, key string, `word` string, `a.b` string, ids array<int>"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", None, "y", [1]) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and blank texts, repeated rows, a long text, a long word, signs of all planes; columns with clashing names."""
    texts = [(1, None), (2, ""), (3, " \t\n"), (4, "Seventh seventh SEVENTH sevenths"), (4, "Seventh seventh SEVENTH sevenths"), (None, "é 日本 🙂 ▁ \r\n x don't"),
             (5, "word " * 30_000), (6, "a" * 20_000), (None, None), (7, "naïvement naivement ÀÀÀÀÀÀÀ ÀÀÀÀÀÀÀ")]
    return docs_of(spark, texts)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# 11: importance resampling


def brute_features(text, n):
    words = [w for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))]
    return len(words), Counter(zlib.crc32(b" ".join(words[i : i + k])) % 10_000 for k in range(1, n + 1) for i in range(len(words) - k + 1))


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_ring_buckets_are_those_of_spelled_out_runs(n):
    rnd = random.Random(n)
    for _ in range(200):
        text = "".join(rnd.choice("abC 9é日_-\n ") for _ in range(rnd.randint(0, 40)))
        words, found = importance.ring_buckets(text.encode(), n)
        assert (words, Counter(found.tolist())) == brute_features(text, n)


def brute_resample(docs, bench):
    s, t = Counter(), Counter()
    for _, x in docs:
        s += brute_features(x, 2)[1]
    for x in bench:
        t += brute_features(x, 2)[1]
    all_s, all_t, out = sum(s.values()), sum(t.values()), []
    for i, x in docs:
        words, f = brute_features(x, 2)
        gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in f}
        weight = sum(gain[b] * c for b, c in f.items()) // max(sum(f.values()), 1)
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, sum(f.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    drawn = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    return out, drawn[: 25 * len(drawn) // 100]


def test_resampling_on_odd_tables_equals_brute_force(spark, odd, empty):
    rnd = random.Random(3)
    more = [(100 + i, " ".join(rnd.choice(["law", "fee", "due", "the", "x"]) for _ in range(rnd.randint(15, 40)))) for i in range(60)]
    docs = odd.unionByName(docs_of(spark, more + more[:3]))
    bench = spark.createDataFrame([(1, "the law of the fee"), (2, None), (2, "")], "item_id long, text string")
    found = importance.resample(docs, bench).collect()
    want, drawn = brute_resample([(r.doc_id, r.text) for r in docs.collect()], ["the law of the fee", None, ""])
    as_key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted([(r.doc_id, r.n_features, r.weight, r.score) for r in found], key=as_key) == sorted([w[:4] for w in want], key=as_key)
    assert [(r.doc_id, r.score) for r in sorted((r for r in found if r["rank"]), key=lambda r: r["rank"])] == [(d[0], d[3]) for d in drawn]
    assert sorted(r["rank"] for r in found if r["rank"]) == list(range(1, len(drawn) + 1))
    assert importance.resample(empty, bench).count() == 0
    assert importance.resample(docs, bench.limit(0)).count() == docs.count()


def test_ranks_with_equal_scores_on_a_third_of_all_rows(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, 50).otherwise(F.col("id") % 100).alias("score"))
    found = importance.ranked(rows, F.lit(True), percent=50).filter("rank IS NOT NULL").orderBy("rank").collect()
    assert [r["rank"] for r in found] == list(range(1, 1501))
    want = sorted(((-r.score, r.doc_id) for r in rows.collect()))[:1500]
    assert [(-r.score, r.doc_id) for r in found] == want


# 12: byte-level BPE


@pytest.fixture(scope="module")
def ranks():
    with open(byte_bpe.RANKS, "rb") as f:
        return byte_bpe.Ranks(f.read())


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=byte_bpe.PATTERN, mergeable_ranks=ranks.rank, special_tokens={})


def random_text(rnd, n):
    return "".join(rnd.choice("aaaabcdeehinorst' ,.-ésñ日本 🙂\n  19'll've") for _ in range(rnd.randint(0, n)))


def test_query_equals_the_library_on_a_whole_table(spark, sf_dir, library):
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    found = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.QUERIES["op12_prefix_bpe"](spark, sf_dir).collect()}
    assert found == want


def test_odd_and_empty_tables_encode_and_decode(spark, odd, empty, library):
    found = byte_bpe.decode(byte_bpe.encode(odd)).collect()
    got = sorted((r.doc_id or 0, bytes(r.decoded), tuple(r.ids)) for r in found)
    assert got == sorted((r.doc_id or 0, (r.text or "").encode(), tuple(library.encode_ordinary(r.text or ""))) for r in odd.collect())
    assert byte_bpe.decode(byte_bpe.encode(empty)).count() == 0
    assert [r.decoded for r in byte_bpe.decode(spark.createDataFrame([(None, 1)], "ids array<int>, decoded int")).collect()] == [None]


def test_every_prefix_has_the_encoding_of_its_entry(ranks):
    rnd = random.Random(5)
    for _ in range(300):
        piece = random_text(rnd, 30).replace(" ", "").replace("\n", "").encode()
        entries = byte_bpe.array("i")
        ranks.extend(piece, entries)
        for end in range(1, len(piece) + 1):
            assert ranks.tokens(entries, end) == ranks.merged(piece[:end])


def test_appends_and_edits_equal_a_new_encoding(ranks, library):
    rnd = random.Random(6)
    for _ in range(600):
        text = random_text(rnd, 80)
        e = byte_bpe.Encoded(ranks, text.encode())
        for _ in range(4):
            a = rnd.randint(0, len(text))
            b = len(text) if rnd.random() < 0.3 else min(len(text), a + rnd.choice([0, 0, 1, 3, 30]))
            new = random_text(rnd, 10) if rnd.random() < 0.8 else ""
            at = [len(text[:x].encode()) for x in (a, b)]
            e.edit(*at, new)
            text = text[:a] + new + text[b:]
            fresh = byte_bpe.Encoded(ranks, text.encode())
            assert (e.raw, list(e.ends), list(e.last)) == (text.encode(), list(fresh.ends), list(fresh.last))
            assert e.ids() == library.encode_ordinary(text)


def test_changes_compute_entries_near_them_only(spark, ranks, library):
    docs = spark.createDataFrame([(i, "some plain words, again and again " * 2000 + "z" * (1000 * i)) for i in range(4)], "doc_id long, text string")
    stored = byte_bpe.tables(docs)
    edits = [(0, 34_003, 2, "XY"), (1, None, None, " and more"), (2, 68_500, 3, "b")]
    changed = byte_bpe.change(stored, spark.createDataFrame(edits, "doc_id long, at long, removed long, added string"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for i, at, removed, added in edits:
        at = len(texts[i]) if at is None else at
        texts[i] = texts[i][:at] + added + texts[i][at + (removed or 0) :]
    rows = {r.doc_id: r for r in changed.collect()}
    assert {i: r.text for i, r in rows.items()} == texts and rows[3].computed == 0
    assert 0 < rows[0].computed < 200 and 0 < rows[1].computed < 200 and 0 < rows[2].computed < 400
    assert {r.doc_id: list(r.ids) for r in byte_bpe.ids_of(changed).collect()} == {i: library.encode_ordinary(t) for i, t in texts.items()}


# 13: spelling variants


def brute_variants(counts):
    letters = sorted({c for w in counts for c in w})
    out = {}
    for w in counts:
        near = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
        near = (near & set(counts)) - {w}
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        out[w] = (best if best and counts[best] >= 10 * counts[w] else None, len(near))
    rows = set()
    for w, (form, n_near) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, counts[w], n_near, counts[form] if form else None))
    return rows


def test_variants_equal_brute_force(spark):
    rnd = random.Random(8)
    words = Counter()
    for k in range(60):
        w = "".join(rnd.choice("abcdeéÿÀ") for _ in range(rnd.randint(7, 10)))
        words[w] = rnd.choice([2, 20, 200, 2000, 20000, 200000])
        for _ in range(25):
            for _ in range(rnd.randint(1, 2)):
                i, c = rnd.randint(0, len(w)), rnd.choice("abcdeéÿÀ")
                w = rnd.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]])
            if len(w) >= 7:
                words[w] = rnd.choice([2, 2, 20, 200, 2000])
    words |= Counter({"a" * n: 10**k for k, n in enumerate(range(7, 13), 1)})  # a chain, of one letter
    found = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()
    assert {tuple(r) for r in found} == brute_variants(words) and len(found) == len(words)
    assert max(len(r.root) - len(r.word) for r in found if set(r.word) == {"a"}) == 5


def test_counts_of_odd_tables(spark, odd, empty):
    want = Counter()
    for r in odd.collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{run}".encode())
            run = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
            want[run] += len(run) >= 7
    found = {r.word: r.n for r in spelling.word_counts(spelling.noisy_words(odd)).collect()}
    assert found == {w: n for w, n in want.items() if n >= 2}
    assert spelling.variants(spelling.word_counts(spelling.noisy_words(empty))).count() == 0
