"""Byte-level BPE by prefix dynamic programming: each byte prefix of a piece has one valid last token.

A sequence of tokens is what the merges make of its bytes exactly if every two neighbours stay as they are when
merged alone. So the encoding of a prefix is that of a shorter prefix and one token more, and one number a byte, the
last token of the prefix that ends there, holds the encodings of all prefixes: read backwards from any end it spells
the encoding. Appending computes the new bytes' entries only; an edit keeps the entries before it and, as an entry
depends on the entries and bytes of one longest token before it, those after it from where new and old entries
have agreed for that long.

Texts are split by a pattern into pieces that are encoded each by itself. ``Encoded`` keeps a text's pieces and
entries and splits only around a change again: a piece depends on nothing before it and on at most LOOK signs after it.

Nulls and odd values: a null text is the empty text: no ids, decoded to no bytes. Null ids decode to null. Repeated
rows each give a row; equal texts equal ids. Texts and pieces of any length take time and memory in proportion. An
empty table gives an empty result. Extra columns are ignored by ``encode`` and kept by ``decode`` (a column ``decoded``
is replaced). A null append or edit, or one without a text of its key, changes nothing.
"""

from __future__ import annotations

import base64
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import table

#: The vocabulary's file and the pattern that splits texts before the merges.
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A piece depends on at most so many signs after its end (the longest contraction).
LOOK = 3
#: Longest piece that is remembered, and most pieces (twice) and token pairs that are, in one Python process.
PIECE, REMEMBER = 64, 300_000


class Ranks:
    """A vocabulary: token bytes by rank, and which tokens may follow each other."""

    def __init__(self, raw: bytes, pattern: str = PATTERN):
        self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
        self.bytes = [b""] * (max(self.rank.values(), default=-1) + 1)
        for spelled, r in self.rank.items():
            self.bytes[r] = spelled
        self.longest = max(map(len, self.bytes), default=0)
        self.split = regex.compile(pattern).findall
        self.spans = regex.compile(pattern).finditer
        self.pairs: dict[int, bool] = {}
        self.known = Remembered(self)
        # ends of tokens: the rank of those that are tokens and are what the merges make of their own bytes, else -1
        self.ends: dict[bytes, int] = {}
        for spelled in self.rank:
            for i in range(len(spelled)):
                self.ends.setdefault(spelled[i:], -1)
        for spelled, r in self.rank.items():
            if self.merged(spelled) == [r]:
                self.ends[spelled] = r

    def merged(self, raw: bytes) -> list[int]:
        """What the merges make of a few bytes, least rank first; used on tokens and pairs of tokens only."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            ranks = [self.rank.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:], strict=False)]
            least = min(ranks)
            if least == 1 << 60:
                break
            i = ranks.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.rank[p] for p in parts]

    def follows(self, a: int, b: int) -> bool:
        """Whether the merges leave the tokens a, b as they are."""
        found = self.pairs.get(a << 32 | b)
        if found is None:
            if len(self.pairs) >= REMEMBER:
                self.pairs.clear()
            found = self.pairs[a << 32 | b] = self.merged(self.bytes[a] + self.bytes[b]) == [a, b]
        return found

    def extend(self, raw: bytes, last: array, stop=None) -> None:
        """Append to last, the entries of a prefix of raw, those of the longer prefixes, until all are there or stop(entries) holds."""
        ends, pairs, follows, longest = self.ends.get, self.pairs.get, self.follows, self.longest
        for end in range(len(last) + 1, len(raw) + 1):
            found = ends(raw[:end], -1) if end <= longest else -1  # a prefix that is a token is its own encoding
            start = end
            while found < 0:
                start -= 1
                token = ends(raw[start:end]) if start >= 0 else None
                if token is None:
                    raise ValueError(f"no token of the vocabulary ends at byte {end} of a piece: {raw[max(end - 32, 0):end]!r}")
                if token >= 0 and start:
                    before = last[start - 1]
                    fits = pairs(before << 32 | token)
                    if fits or (fits is None and follows(before, token)):
                        found = token
            last.append(found)
            if stop and stop(last):
                break

    def tokens(self, last, end: int | None = None, start: int = 0) -> list[int]:
        """The encoding of the bytes from start, where a piece begins, to end, read backwards."""
        end, out = len(last) if end is None else end, []
        while end > start:
            out.append(last[end - 1])
            end -= len(self.bytes[last[end - 1]])
        return out[::-1]

    def piece(self, piece: str) -> bytes:
        """The ids of one piece, as 32-bit numbers. A piece that is a token as a whole is that token, reachable by merges or not."""
        raw = piece.encode()
        whole = self.rank.get(raw)
        if whole is not None:
            return array("i", [whole]).tobytes()
        last = array("i")
        self.extend(raw, last)
        return array("i", self.tokens(last)).tobytes()

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.known.__getitem__, self.split(text))), dtype=np.int32)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


class Remembered(dict):
    """Ids of pieces by piece. When it is full, what was not asked for since the last time goes."""

    def __init__(self, ranks: Ranks):
        self.ranks, self.older = ranks, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            found = self.ranks.piece(piece)
        if len(piece) <= PIECE:
            if len(self) >= REMEMBER:
                self.older = dict(self)
                self.clear()
            self[piece] = found
        return found


class Encoded:
    """A text with its pieces' ends (in bytes) and one entry a byte; append and edit compute entries near the change only."""

    def __init__(self, ranks: Ranks, raw: bytes = b"", ends=None, last=None):
        self.ranks, self.raw, self.computed = ranks, raw, 0
        self.ends, self.last = array("i", ends or []), array("i", last if last is not None else [])
        if ends is None and raw:
            self._again(0, 0, raw, [])

    def ids(self) -> list[int]:
        out, start = [], 0
        for end in self.ends:
            whole = self.ranks.rank.get(self.raw[start:end])
            out += [whole] if whole is not None else self.ranks.tokens(self.last, end, start)
            start = end
        return out

    def append(self, more: str) -> None:
        self.edit(len(self.raw), len(self.raw), more)

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace the bytes from start to end, both between two signs, by a text."""
        if not 0 <= start <= end <= len(self.raw):
            raise ValueError(f"no bytes {start} to {end} in a text of {len(self.raw)}")
        raw = self.raw[:start] + new.encode() + self.raw[end:]
        keep = int(np.searchsorted(np.frombuffer(self.ends, dtype=np.int32), start - 4 * LOOK, "left")) if self.ends else 0
        old = self.ends[keep:]
        self._again(keep, end, raw, old)

    def _again(self, keep: int, changed: int, raw: bytes, old) -> None:
        """Split and encode raw from the end of the first ``keep`` pieces on, until a piece starts where one of the old ends lies behind ``changed``."""
        begin, shift = (self.ends[keep - 1] if keep else 0), len(raw) - len(self.raw)
        resume = {e + shift: i for i, e in enumerate(old) if e >= changed}
        ends, last, was = self.ends[:keep], self.last[:begin], self.last
        at, follow, window = begin, None, 1 << 12
        while at < len(raw) and follow is None:
            # a window of whole signs; pieces that might depend on what follows it are split again with a longer one
            stop = min(at + window, len(raw))
            while stop < len(raw) and raw[stop] & 0xC0 == 0x80:
                stop += 1
            done = at
            for m in self.ranks.spans(raw[at:stop].decode()):
                size = len(m.group().encode())
                if stop < len(raw) and done + size + 4 * LOOK >= stop:
                    break
                self._piece(raw, done, done + size, last, was, changed, shift)
                done += size
                ends.append(done)
                if done in resume:
                    follow = resume[done]
                    break
            window = window if done > at else 2 * window
            at = done
        if follow is not None:
            ends.extend(e + shift for e in old[follow + 1 :])
            last.extend(was[at - shift :])
        self.raw, self.ends, self.last = raw, ends, last

    def _piece(self, raw: bytes, start: int, end: int, last: array, was: array, changed: int, shift: int) -> None:
        """Entries of one piece: old ones as far as the bytes from its start are the old ones, then new ones until they meet the old again."""
        piece, own = raw[start:end], array("i")
        if self.raw:
            before = [e for e in (start, start - shift) if 0 <= e < len(self.raw) and (e == 0 or self._is_end(e))]
            for e in before[:1]:
                same = np.frombuffer(piece, np.uint8)
                there = np.frombuffer(self.raw[e : e + len(piece)], np.uint8)
                n = min(len(same), len(there), self._piece_end(e) - e)
                differs = np.flatnonzero(same[:n] != there[:n])
                own = was[e : e + (int(differs[0]) if len(differs) else n)]
        reused, longest = len(own), self.ranks.longest
        agreed = 0

        def met(entries) -> bool:
            nonlocal agreed
            at = start + len(entries) - 1 - shift
            same = at >= changed and at < len(was) and was[at] == entries[-1] and self._piece_end(at) == end - shift
            agreed = agreed + 1 if same else 0
            return agreed >= longest

        self.ranks.extend(piece, own, met if self.raw else None)
        self.computed += len(own) - reused
        if len(own) < len(piece):
            own.extend(was[start + len(own) - shift : end - shift])
        last.extend(own)

    def _is_end(self, e: int) -> bool:
        ends = np.frombuffer(self.ends, dtype=np.int32)
        i = int(np.searchsorted(ends, e))
        return i < len(ends) and ends[i] == e

    def _piece_end(self, at: int) -> int:
        """End of the old piece that holds the byte ``at``."""
        ends = np.frombuffer(self.ends, dtype=np.int32)
        i = int(np.searchsorted(ends, at, "right"))
        return int(ends[i]) if i < len(ends) else -1


_LOADED: dict[tuple[int, str], Ranks] = {}


def _ranks(raw: bytes, pattern: str) -> Ranks:
    """The vocabulary, built once in a Python process."""
    key = (hash(raw), pattern)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Ranks(raw, pattern)
    return _LOADED[key]


def vocabulary(spark: SparkSession, path: str = RANKS):
    """The file of ranks, read by Spark from any store and broadcast: a vocabulary's size bounds it."""
    rows = spark.read.format("binaryFile").load(path).select("content").collect()
    return spark.sparkContext.broadcast(bytes(rows[0].content))


def _lists(found: list, kind) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
    flat = np.concatenate([np.asarray(x, dtype=np.int32) for x in found]) if found else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """key, ids for every row of docs."""
    raw = vocabulary(docs.sparkSession, ranks)

    def run(batches):
        v = _ranks(raw.value, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _lists([v.encode(t.as_py() or "") for t in b.column(1)], pa.int32())], names=["key", "ids"])

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, "key long, ids array<int>").withColumnRenamed("key", key)


def decode(df: DataFrame, ids: str = "ids", ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """df with a column decoded (in place of one of that name): the bytes of its id lists; null for null."""
    raw = vocabulary(df.sparkSession, ranks)

    def run(batches):
        v = _ranks(raw.value, pattern)
        for b in batches:
            found = [None if not x.is_valid else v.decode(x.values.to_numpy().tolist()) for x in b.column(b.schema.get_field_index(ids))]
            yield b.append_column(pa.field("decoded", pa.binary()), pa.array(found, pa.binary()))

    df = df.drop("decoded")
    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("decoded", T.BinaryType())]))


_TABLE = "key long, text string, piece_ends array<int>, last array<int>"


def _table_batch(keys: list, made: list[Encoded], extra=()) -> pa.RecordBatch:
    cols = [pa.array(keys, pa.int64()), pa.array([e.raw.decode() for e in made], pa.string()), _lists([e.ends for e in made], pa.int32()), _lists([e.last for e in made], pa.int32())]
    return pa.RecordBatch.from_arrays([*cols, *extra], names=["key", "text", "piece_ends", "last", "computed"][: 4 + len(extra)])


def tables(docs: DataFrame, key: str = "doc_id", text: str = "text", ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """key, text, piece_ends, last: each byte prefix's last token, to be stored and changed by ``change``."""
    raw = vocabulary(docs.sparkSession, ranks)

    def run(batches):
        v = _ranks(raw.value, pattern)
        for b in batches:
            yield _table_batch(b.column(0).to_pylist(), [Encoded(v, (t or "").encode()) for t in b.column(1).to_pylist()])

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, _TABLE).withColumnRenamed("key", key)


def change(stored: DataFrame, changes: DataFrame, key: str = "doc_id", ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """``tables`` after changes(key, at, removed, added), one for each key at most: bytes from ``at`` (null: the end) give way to a text.

    A column ``computed`` tells how many entries were computed anew; texts without a change are passed on."""
    raw = vocabulary(stored.sparkSession, ranks)

    def run(batches):
        v = _ranks(raw.value, pattern)
        for b in batches:
            made, rows = [], b.to_pylist()
            for r in rows:
                e = Encoded(v, (r["text"] or "").encode(), r["piece_ends"] or [], r["last"] or [])
                if r["added"] is not None or r["removed"]:
                    at = len(e.raw) if r["at"] is None else r["at"]
                    e.edit(at, at + (r["removed"] or 0), r["added"] or "")
                made.append(e)
            yield _table_batch([r["key"] for r in rows], made, [pa.array([e.computed for e in made], pa.int64())])

    one = changes.select(F.col(f"`{key}`").cast("long").alias("key"), F.col("at").cast("long"), F.col("removed").cast("long"), "added").filter("key IS NOT NULL")
    rows = stored.select(F.col(f"`{key}`").alias("key"), "text", "piece_ends", "last").join(one, "key", "left")
    return rows.mapInArrow(run, _TABLE + ", computed long").withColumnRenamed("key", key)


def ids_of(stored: DataFrame, key: str = "doc_id", ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """key, ids of stored ``tables``, read backwards from each piece's end."""
    raw = vocabulary(stored.sparkSession, ranks)

    def run(batches):
        v = _ranks(raw.value, pattern)
        for b in batches:
            rows = b.to_pylist()
            made = [Encoded(v, (r["text"] or "").encode(), r["piece_ends"] or [], r["last"] or []).ids() for r in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(made, pa.int32())], names=["key", "ids"])

    rows = stored.select(F.col(f"`{key}`").alias("key"), "text", "piece_ends", "last")
    return rows.mapInArrow(run, "key long, ids array<int>").withColumnRenamed("key", key)


def op12(spark, sf_dir):
    found = decode(encode(table(spark, sf_dir, "documents")))
    digits = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(digits, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
