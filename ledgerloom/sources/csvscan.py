"""Delimited text with the place of every cell: files of any size, split anywhere, quoted line breaks and all.

A file is read as lines by as many tasks as it has blocks. Whether a line begins inside a quoted field depends on all lines
before it, so each block is read under both assumptions at once: a line maps (outside, inside) to states, counts of records
and the open field's column, and these maps compose. One row a block goes to a fold by file, which settles each block's true
beginning; then every line is decoded and cut into cells by itself. Only cells that run over several lines are put together
by a shuffle, and only their pieces move. Nothing holds a file.

A quote opens a field at its beginning only; doubled quotes stand for one; what follows a closing quote up to the next
delimiter is left out of the value. A record ends at \\n, \\r\\n or \\r outside quotes. Offsets count code points of the
decoded text (without a byte order mark) and enclose the value without its quotes; blank lines keep the numbering of rows.

Every file gives a row with a status, whatever it holds: parsed, empty, or rejected / corrupt with a code and a message."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.plans import ledger as v
from ledgerloom.plans.graph import Room
from ledgerloom.registry import query
from ledgerloom.sources.files import scratch, sizes

#: Delimiters in order of preference, and how much of a file's beginning is looked at to choose one.
DELIMITERS, HEAD, HEAD_RECORDS = (",", "\t", ";", "|"), 65_536, 60
#: At most so many blocks or files are broadcast to the lines; more are joined by shuffling.
SMALL = 200_000


@dataclass(frozen=True)
class Limits:
    max_bytes: int = 50 * 1024 * 1024 * 1024
    max_rows: int = 1_000_000_000
    max_cols: int = 2_000


def cut_line(line: str, inside: bool, delimiter: str) -> tuple[list[tuple[int, int, int, bool, bool, bool]], bool]:
    """([(record, start, end, began, ended, quoted)], inside): the fields of one line without its line break, given whether it
    begins inside a quoted field; record counts those that end before the field in this line."""
    fields, at, record, n = [], 0, 0, len(line)
    stop = re.compile(f"[{re.escape(delimiter)}\r]").search
    while True:
        began = not inside
        if inside or line.startswith('"', at):
            at += began
            close = line.find('"', at)
            while close >= 0 and line.startswith('"', close + 1):
                close = line.find('"', close + 2)
            if close < 0:
                fields.append((record, at, n, began, False, True))
                return fields, True
            fields.append((record, at, close, began, True, True))
            inside, found = False, stop(line, close + 1)
        else:
            found = stop(line, at)
            fields.append((record, at, found.start() if found else n, True, True, False))
        if found is None or (found.group() == "\r" and found.end() == n):
            return fields, False
        at = found.end()
        record += found.group() == "\r"


@lru_cache
def _patterns(delimiter: str) -> tuple:
    """For lines of one record: all of them is closed fields, as many closed fields as there are, one of those, the end of an open field."""
    d = re.escape(delimiter)
    field = f'(?:"(?:[^"]++|"")*+"[^{d}]*+|(?!")[^{d}]*+)'
    return re.compile(rf"{field}(?:{d}{field})*+\Z").match, re.compile(f"(?:{field}{d})*+").match, re.compile(f"{field}{d}").findall, re.compile(rf'(?:[^"]++|"")*+"[^{d}]*+').match


def line_map(line: str, inside: bool, delimiter: str) -> tuple[bool, int, bool, int]:
    """(inside, records that end here, whether one does, fields closed since the last one or since the line's beginning)."""
    if '"' not in line:
        return (True, 0, False, 0) if inside else (False, 1 + line.count("\r", 0, max(len(line) - 1, 0)), True, 0)
    if "\r" not in line:
        whole, upto, closed, close = _patterns(delimiter)
        at = 0
        if inside:
            found = close(line)
            if found is None:
                return True, 0, False, 0
            at = found.end() + 1
        if at > len(line) or whole(line, at):
            return False, 1, True, 0
        return True, 0, False, inside + len(closed(line, at, upto(line, at).end()))
    fields, after = cut_line(line, inside, delimiter)
    last = fields[-1][0]
    if not after:
        return False, last + 1, True, 0
    return True, last, last > 0, sum(f[0] == last for f in fields) - 1


#: What lies before a line under one assumption: inside, records ended, line breaks within fields, whether the open field's column is known, columns.
STATE = "struct<inside: boolean, records: long, breaks: long, known: boolean, col: long>"
LINE = f"file string, block long, no long, raw binary, bytes long, chars8 long, chars949 long, ok8 boolean, ok949 boolean, nul boolean, a {STATE}, b {STATE}"


def _after(state: tuple, line: str, delimiter: str) -> tuple:
    inside, records, breaks, known, col = state
    to, ended, reset, fields = line_map(line, inside, delimiter)
    return to, records + ended, breaks + to, known or reset, fields if reset else col + fields


def _chars(raw: bytes, encoding: str) -> int | None:
    try:
        return len(raw.decode(encoding))
    except UnicodeDecodeError:
        return None


_LINES = pa.schema([
    ("file", pa.string()), ("block", pa.int64()), ("no", pa.int64()), ("raw", pa.binary()), ("bytes", pa.int64()), ("chars8", pa.int64()), ("chars949", pa.int64()), ("ok8", pa.bool_()), ("ok949", pa.bool_()), ("nul", pa.bool_()),
    *[(n, pa.struct([("inside", pa.bool_()), ("records", pa.int64()), ("breaks", pa.int64()), ("known", pa.bool_()), ("col", pa.int64())])) for n in "ab"],
])


def _scan(text: DataFrame, delimiters: dict) -> DataFrame:
    """Rows LINE: every line with what lies before it in its block, under both assumptions; a block's last row (raw null) has its totals."""

    def run(batches):
        at = None  # file, block, delimiter, number, bytes, characters in either encoding, validity, NUL, states

        def row(raw):
            return (*at[:2], at[3] if raw is not None else -1, raw, *at[4:])

        for batch in batches:
            out = []
            for file, block, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at is None or at[0] != file or at[1] != block:
                    if at is not None:
                        out.append(row(None))
                    at = [file, block, delimiters[file], 0, 0, 0, 0, True, True, False, (False, 0, 0, True, 0), (True, 0, 0, False, 0)]
                if block == 0 and at[3] == 0 and raw.startswith(b"\xef\xbb\xbf"):
                    at[4], raw = 3, raw[3:]
                out.append(row(raw))
                line = raw.decode("latin-1")
                n8, n949 = (len(raw), len(raw)) if raw.isascii() else (_chars(raw, "utf-8"), _chars(raw, "cp949"))
                at[3:10] = at[3] + 1, at[4] + len(raw) + 1, at[5] + (n8 or 0) + 1, at[6] + (n949 or 0) + 1, at[7] and n8 is not None, at[8] and n949 is not None, at[9] or b"\0" in raw
                at[10:] = [_after(s, line, at[2]) for s in at[10:]]
            yield _batch(out, _LINES)
        if at is not None:
            yield _batch([row(None)], _LINES)

    return text.mapInArrow(run, LINE)


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    """Rows of tuples; structs are tuples as well."""
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)

    def array(c, kind):
        if not pa.types.is_struct(kind):
            return pa.array(c, kind)
        parts = list(zip(*c, strict=True)) or [()] * kind.num_fields
        return pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(parts, kind, strict=True)], fields=list(kind))

    return pa.RecordBatch.from_arrays([array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


BEGIN = "file string, block long, inside boolean, records long, breaks long, col long, chars long, encoding string"
FILE = "file string, status string, code string, message string, encoding string, delimiter string, records long"


def _begin(blocks: pd.DataFrame) -> list[tuple]:
    """Rows BEGIN of one file's blocks, and a last one with the totals."""
    blocks = blocks.sort_values("block")
    encoding = "utf-8" if blocks.ok8.all() else "cp949" if blocks.ok949.all() else None
    inside, records, breaks, col, chars, out = False, 0, 0, 0, 0, []
    for r in blocks.itertuples():
        out.append((r.file, r.block, inside, records, breaks, col, chars, encoding))
        s = r.b if inside else r.a
        inside, records, breaks, col = s["inside"], records + s["records"], breaks + s["breaks"], s["col"] if s["known"] else col + s["col"]
        chars += r.chars8 if encoding != "cp949" else r.chars949
    out.append((out[-1][0], -1, inside, records, breaks, col, chars, encoding))
    return out


def _texts(spark: SparkSession, path) -> DataFrame:
    """(file, block, raw) of all lines, in order within a block."""
    x = spark.read.option("lineSep", "\n").text(path)
    return x.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("raw"))


def heads(text: DataFrame, size: int = HEAD) -> DataFrame:
    """(file, head): the first lines of each file up to ``size`` bytes, cut there."""

    def run(batches):
        file, left = None, 0
        for batch in batches:
            if file is not None and left <= 0 and pc.all(pc.equal(batch.column(0), file)).as_py():
                continue  # more of a file whose beginning is known
            out = []
            for f, block, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if f != file:
                    file, left, no = f, size, 0
                if block == 0 and left > 0:
                    out.append((f, no, raw[:left]))
                    left, no = left - len(raw) - 1, no + 1
            yield _batch(out, pa.schema([("file", pa.string()), ("no", pa.int64()), ("raw", pa.binary())]))

    lines = F.array_sort(F.collect_list(F.struct("no", F.hex("raw").alias("h"))))
    x = text.filter("block = 0").mapInArrow(run, "file string, no long, raw binary").groupBy("file").agg(lines.alias("l"))
    return x.select("file", F.unhex(F.array_join(F.transform("l", lambda r: r["h"]), "0A")).alias("head"))


def choose_delimiter(head: bytes, delimiters=DELIMITERS) -> str:
    """The delimiter that gives most records the same number of fields (two at least); then more fields, then the preferred one."""
    try:
        text = head.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = head.decode("cp949", "replace")
    best = (0.0, 0, 0, ",")
    for preference, d in enumerate(delimiters):
        counts, inside, open_fields = [], False, 0
        for line in text.split("\n"):
            fields, inside = cut_line(line, inside, d)
            per = Counter(f[0] for f in fields if f[4])
            for k in range(fields[-1][0] + (not inside)):
                n = per[k] + (open_fields if k == 0 else 0)
                only = [f for f in fields if f[0] == k]
                if not (n == 1 and only[0][1] == only[0][2] and only[0][3]):
                    counts.append(n)
                if k == 0:
                    open_fields = 0
            if inside:
                open_fields = per[fields[-1][0]] + (open_fields if fields[-1][0] == 0 else 0)
        counts = counts[:HEAD_RECORDS]
        counts = counts[:-1] if len(counts) > 1 else counts
        if not inside or len(head) >= HEAD:
            mode, often = max(Counter(counts).items(), key=lambda x: (x[1], -counts.index(x[0])), default=(0, 0))
            if mode >= 2:
                best = max(best, (often / len(counts), mode, -preference, d))
    return best[3]


CELL = "file string, row long, col long, line long, start long, end long, text string, whole boolean"
_CELLS = pa.schema([("file", pa.string()), *[(n, pa.int64()) for n in ("row", "col", "line", "start", "end")], ("text", pa.string()), ("whole", pa.bool_())])


def _cells(lines: DataFrame, delimiters: dict) -> DataFrame:
    """Rows CELL of lines(file, raw, encoding, inside, records, breaks, col, chars), each by itself; a field that goes on gives a piece a line."""

    def run(batches):
        for batch in batches:
            out = []
            for file, raw, encoding, inside, records, breaks, col, chars in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                line = raw.decode(encoding)
                fields, _ = cut_line(line, inside, delimiters[file])
                sizes = Counter(f[0] for f in fields) if fields[-1][0] else (len(fields),)
                record, column = 0, col
                for k, start, end, began, ended, quoted in fields:
                    record, column = k, column + 1 if k == record else 1
                    if column == 1 and sizes[k] == 1 and began and ended and start == end:
                        continue  # a blank line
                    value = line[start:end].replace('""', '"') if quoted else line[start:end]
                    out.append((file, records + k + 1, column, 1 + records + k + breaks, chars + start, chars + end, value, began and ended))
            yield _batch(out, _CELLS)

    return lines.mapInArrow(run, CELL)


def scan(spark: SparkSession, path, delimiter: str | None = None, limits: Limits = Limits(), split: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(files(FILE), cells(file, row, col, line, start, end, text)) of all files under a path.

    Files above the size limit aren't opened. Two reads of the others where the delimiter is to be found, else one. split: bytes
    that one task reads at least of a file (None: as the session has it)."""
    room = Room(spark)
    found = sizes(spark, path)  # names and lengths, as Spark's own listing holds them
    listing = room.cut(spark.createDataFrame(found, "file string, length long"))
    good = [file for file, length in found if 0 < length <= limits.max_bytes]
    early = F.when(F.col("length") > limits.max_bytes, F.struct(F.lit("rejected").alias("status"), F.lit("size").alias("code"), F.format_string("%d bytes exceed limit %d", "length", F.lit(limits.max_bytes)).alias("message")))
    early = early.when(F.col("length") == 0, F.struct(F.lit("empty").alias("status"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("message")))
    if not good:
        files = listing.select("file", early.alias("s")).select("file", "s.*", *[F.lit(None).cast(t).alias(n) for n, t in (("encoding", "string"), ("delimiter", "string"), ("records", "long"))])
        return files, spark.createDataFrame([], "file string, row long, col long, line long, start long, end long, text string")
    text = _texts(spark, good)
    if delimiter is None:
        found = {r.file: choose_delimiter(bytes(r.head)) for r in heads(text).toLocalIterator()}  # 64 kB a file, one at a time
    else:
        found = dict.fromkeys(good, delimiter)
    by_path = {_plain(f): d for f, d in found.items()}
    text = text.withColumn("file", _plain_column(F.col("file")))
    size = "spark.sql.files.maxPartitionBytes"
    usual = spark.conf.get(size)
    try:
        spark.conf.set(size, str(split) if split else usual)
        lines = room.cut(_scan(text, by_path))
    finally:
        spark.conf.set(size, usual)
    blocks = lines.filter("raw IS NULL").select("file", "block", "ok8", "ok949", "nul", "chars8", "chars949", "a", "b")
    begin = room.cut(blocks.groupBy("file").applyInPandas(lambda p: pd.DataFrame(_begin(p), columns=[c.split()[0] for c in BEGIN.split(", ")]), BEGIN))
    ends = begin.filter("block = -1").join(blocks.groupBy("file").agg(F.bool_or("nul").alias("nul")), "file")
    first = lines.filter("block = 0 AND no = 0").select("file", F.col("raw").substr(1, 2).alias("mark"))
    ends = ends.join(first, "file", "left")
    bad = lambda cond, status, code, message: F.when(cond, F.struct(F.lit(status).alias("status"), F.lit(code).alias("code"), message.alias("message")))
    utf16 = F.coalesce(F.hex("mark").isin("FFFE", "FEFF"), F.lit(False))
    late = F.coalesce(
        bad(utf16, "corrupt", "bad_encoding", F.lit("UTF-16 is not split by lines; convert it first")), bad(F.col("nul"), "corrupt", "binary", F.lit("NUL in a text file")),
        bad(F.col("encoding").isNull(), "corrupt", "bad_encoding", F.lit("neither UTF-8 nor CP949")), bad(F.col("inside"), "corrupt", "csv", F.lit("unterminated quoted field")),
        bad(F.col("records") > limits.max_rows, "rejected", "rows", F.format_string("%d rows exceed limit %d", "records", F.lit(limits.max_rows))),
        F.struct(F.lit("parsed").alias("status"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("message")),
    )
    ends = room.cut(ends.withColumn("s", late).select("file", "s.*", "encoding", "records"))
    at = begin.filter("block >= 0").join(ends.filter("status = 'parsed'").select("file"), "file", "left_semi")
    at = at.select("file", "block", "encoding", *[F.col(c).alias(f"{c}_") for c in ("inside", "records", "breaks", "col", "chars")])
    if at.limit(SMALL + 1).count() <= SMALL:
        at = F.broadcast(at)
    s = F.when(F.col("inside_"), F.col("b")).otherwise(F.col("a"))
    x = lines.filter("raw IS NOT NULL").join(at, ["file", "block"]).withColumn("s", s)
    chars = F.when(F.col("encoding") == "utf-8", F.col("chars8")).otherwise(F.col("chars949"))
    x = x.select("file", "raw", "encoding", "s.inside", (F.col("records_") + F.col("s.records")).alias("records"), (F.col("breaks_") + F.col("s.breaks")).alias("breaks"),
                 (F.col("s.col") + F.when(F.col("s.known"), 0).otherwise(F.col("col_"))).alias("col"), (F.col("chars_") + chars).alias("chars"))
    cells = room.cut(_cells(x, by_path))
    wide = cells.filter(F.col("col") > limits.max_cols).groupBy("file").agg(F.min("row").alias("wide"))
    files = listing.withColumn("file", _plain_column(F.col("file"))).select("file", early.alias("e")).join(ends, "file", "left").join(wide, "file", "left")
    over = F.col("wide").isNotNull()
    pick = lambda c: F.when(over, {"status": F.lit("rejected"), "code": F.lit("cols"), "message": F.format_string("row %d: too many columns", "wide")}[c]).otherwise(F.coalesce(F.col(f"e.{c}"), F.col(c)))
    signs = spark.createDataFrame(list(by_path.items()), "file string, delimiter string")
    files = room.cut(files.select("file", *[pick(c).alias(c) for c in ("status", "code", "message")], "encoding", "records").join(signs, "file", "left").select(*[c.split()[0] for c in FILE.split(", ")]))
    cells = cells.join(F.broadcast(wide.select("file")), "file", "left_anti") if wide.limit(SMALL + 1).count() <= SMALL else cells.join(wide, "file", "left_anti")
    names = ("file", "row", "col", "line", "start", "end", "text")
    whole = cells.filter("whole").select(*names)
    parts = cells.filter("NOT whole").groupBy("file", "row", "col").agg(
        F.min("line").alias("line"), F.min("start").alias("start"), F.max("end").alias("end"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda p: p["text"]), "\n").alias("text"),
    )
    return files, whole.unionByName(parts.select(*names))


def _plain(path: str) -> str:
    return re.sub("^file:/+", "/", path)


def _plain_column(path: Column) -> Column:
    """file:///x, file:/x and /x are one file."""
    return F.regexp_replace(path, "^file:/+", "/")


def write_csv(df: DataFrame, path: str) -> None:
    """Every value between quotes, as it is; with a header."""
    df.write.mode("append").csv(path, header=True, quoteAll=True, escape='"', quote='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, lineSep="\n")


@query("a03_a04_csv_cells", """
SELECT conv_id, turn, role, text, length(text) + length(text) - length(replace(text, '"', '')) AS chars FROM conversations WHERE text IS NOT NULL""")
def q_cells(spark, d):
    """Conversations written as CSV and read back as cells: texts with line breaks, quotes and delimiters, and where they stand."""
    path = scratch(spark)
    write_csv(v.read(spark, d, "conversations").filter("text IS NOT NULL"), path)
    _, cells = scan(spark, path)
    head = cells.filter("row = 1").select("file", "col", F.col("text").alias("name"))
    x = cells.filter("row > 1").join(F.broadcast(head), ["file", "col"]).groupBy("file", "row").agg(
        *[F.max(F.when(F.col("name") == n, F.col("text"))).alias(n) for n in ("conv_id", "turn", "role", "text")], F.max(F.when(F.col("name") == "text", F.col("end") - F.col("start"))).alias("chars")
    )
    types = dict(v.read(spark, d, "conversations").dtypes)
    return x.select(*[F.col(c).cast(types[c]).alias(c) for c in ("conv_id", "turn", "role", "text")], "chars")
