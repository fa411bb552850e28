"""GIF media columns: encode bytes as frames, decode LZW code streams, compose timed frames.

The decoder reads GIF87a and GIF89a: global and local palettes, interlacing, graphic control (delay, transparency,
disposal), images smaller than the canvas, code streams with or without deferred clear codes. LZW is decoded by array
operations: between two clear codes the width of the i-th code depends on i alone, and every code after a clear is
a span of the output that begins where an earlier code's span began, so lengths follow from a chain of earlier
codes and bytes from a chain of earlier bytes; both chains are followed by pointer doubling.

Frames are rendered as RGBA after palettes, transparency and disposal, and stored with start time, delay and a colour
histogram of 64 bins (two bits of each channel; transparent pixels don't count).

The query stores each text as a GIF of 192 columns whose palette indices are the text's bytes, padded by spaces to
full rows, at most ``ROWS`` rows a frame; spaces are transparent and each frame is cleared before the next one, so a frame's
histogram counts its own letters. ``text_media`` returns the medium and its timed frames as columns; equal texts give equal
values. Null texts count as empty and give one row of
spaces. Broken media give a row with an error and no frames. Repeated rows each give a row; texts of any length are stored
whole, a frame at a time. An empty table gives an empty result. Extra columns are ignored. Rows are independent: no shuffle.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import table

COLUMNS, ROWS, DELAY = 192, 64, 4
BINS = 64
#: The palette of the query's media: every byte is a colour of its own, and its first six bits are the bin of that colour, so
#: that the histogram tells bytes apart (in steps of four).
SPREAD = bytes(x for i in range(256) for x in (i & 0xC0, (i << 2) & 0xC0, ((i << 4) & 0xC0) | (i & 3)))
#: Space, the byte of the padding, is transparent there.
BLANK = 32


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    """The code stream (not yet in blocks) of palette indices below 2**bits."""
    clear = 1 << bits
    codes = [clear]
    emit = codes.append
    fresh = clear + 2
    nxt = fresh
    # a tree of the strings with codes: each node is a dict of its continuations, and of its code at -1
    roots = [{-1: i} for i in range(clear)]
    it = iter(data)
    for c in it:
        node = roots[c]
        break
    for c in it:
        if c in node:
            node = node[c]
            continue
        emit(node[-1])
        if nxt < 4096:
            node[c] = {-1: nxt}
            nxt += 1
        else:
            emit(clear)
            roots = [{-1: i} for i in range(clear)]
            nxt = fresh
        node = roots[c]
    if data:
        emit(node[-1])
    emit(clear + 1)
    return _pack(np.array(codes, dtype=np.uint32), bits)


_WIDTH: dict[int, np.ndarray] = {}


def code_widths(n: int, bits: int) -> np.ndarray:
    if bits not in _WIDTH:
        _WIDTH[bits] = _make_widths(bits)
    w = _WIDTH[bits]
    return w[:n] if n <= len(w) else np.concatenate([w, np.full(n - len(w), 12, dtype=np.int64)])


def _make_widths(bits: int) -> np.ndarray:
    """After a clear, the first code has bits + 1 bits; before code i (from 0) the decoder holds 2**bits + 2 + i - 1
    entries (none is added by the first code), and codes grow when that number reaches a power of two."""
    entries = (1 << bits) + 2 + np.maximum(np.arange(5000) - 1, 0)
    return np.minimum(np.floor(np.log2(entries)).astype(np.int64) + 1, 12).clip(bits + 1)


def _pack(codes: np.ndarray, bits: int) -> bytes:
    clear = 1 << bits
    at = np.flatnonzero(codes == clear)
    widths = np.empty(len(codes), dtype=np.int64)
    widths[0] = bits + 1
    for i, a in enumerate(at):
        b = at[i + 1] + 1 if i + 1 < len(at) else len(codes)  # the next clear code is still of the old width
        widths[a + 1 : b] = code_widths(b - a - 1, bits)
    start = np.cumsum(widths) - widths
    total = int(widths.sum())
    out = np.zeros((total + 7) // 8 + 4, dtype=np.uint32)
    shifted = codes << (start & 7).astype(np.uint32)
    for k in range(3):  # codes don't overlap, so adding is the same as joining bits
        np.add.at(out, (start >> 3) + k, (shifted >> np.uint32(8 * k)) & np.uint32(255))
    return out[: (total + 7) // 8].astype(np.uint8).tobytes()


def _read_codes(raw: np.ndarray, bit: int, bits: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n codes from a bit position, as they stand after a clear code; and the position after each."""
    widths = code_widths(n, bits)
    ends = bit + np.cumsum(widths)
    ok = ends <= (len(raw) - 4) * 8
    widths, ends = widths[ok], ends[ok]
    start = ends - widths
    i = start >> 3
    word = raw[i].astype(np.uint32) | (raw[i + 1].astype(np.uint32) << 8) | (raw[i + 2].astype(np.uint32) << 16)
    return (word >> (start & 7).astype(np.uint32)) & ((np.uint32(1) << widths.astype(np.uint32)) - np.uint32(1)), ends


def lzw_decode(stream: bytes, bits: int, size: int) -> np.ndarray:
    """At most size palette indices of a code stream; raises ValueError for a code that can't be there."""
    clear, end = 1 << bits, (1 << bits) + 1
    raw = np.frombuffer(stream + b"\0\0\0\0", dtype=np.uint8)
    parts, have, bit, chunk = [], 0, 0, 4096
    while have < size:
        codes, ends = _read_codes(raw, bit, bits, chunk)
        stop = np.flatnonzero((codes == clear) | (codes == end))
        if not len(stop) and len(codes) == chunk:  # a full table goes on without a clear code
            chunk *= 4
            continue
        n = int(stop[0]) if len(stop) else len(codes)
        if n:
            out = _expand(codes[:n].astype(np.int64), clear)
            parts.append(out)
            have += len(out)
        chunk = 4096
        if not len(stop) or codes[n] == end:
            break
        bit = int(ends[n])
    out = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint8)
    return out[:size]


def _expand(codes: np.ndarray, clear: int) -> np.ndarray:
    """The indices of codes between two clear codes."""
    n = len(codes)
    here = np.arange(n)
    parent = codes - (clear + 2)  # code 2**bits + 2 + j stands for the span of code j and one index more
    literal = codes < clear
    if ((parent >= here) & ~literal).any() or (codes[0] >= clear):
        raise ValueError("bad LZW code")
    # depth of each chain of codes
    up, depth = np.where(literal, -1, parent), np.where(literal, 0, 1)
    jump, total = up.copy(), depth.copy()
    while (jump >= 0).any():
        go = jump >= 0
        total[go] += total[jump[go]]
        jump[go] = jump[jump[go]]
    length = total + 1
    start = np.cumsum(length) - length
    size = int(length.sum())
    # each output byte is that of an earlier byte, or a literal
    source = np.arange(size)
    inner = np.repeat(~literal, length)
    shift = np.repeat(start - np.where(literal, start, start[np.maximum(parent, 0)]), length)
    source = source - np.where(inner, shift, 0)
    while True:
        after = source[source]
        if (after == source).all():
            break
        source = after
    out = np.zeros(size, dtype=np.uint8)
    out[start[literal]] = codes[literal]
    return out[source]


def _blocks(stream: bytes) -> bytes:
    return b"".join(bytes([len(stream[i : i + 255])]) + stream[i : i + 255] for i in range(0, len(stream), 255)) + b"\0"


def encode(payload: bytes, columns=COLUMNS, rows=ROWS, delay=DELAY, palette=SPREAD, blank=BLANK) -> bytes:
    """A GIF whose frames' indices are the payload (a positive multiple of columns), at most so many rows a frame; the index
    ``blank`` is transparent, and a frame gives way to the background."""
    n = len(payload) // columns
    height = min(n, rows)
    out = [b"GIF89a", struct.pack("<HHBBB", columns, height, 0xF7, 0, 0), palette]
    for r in range(0, n, rows):
        part = payload[r * columns : (r + rows) * columns]
        out += [b"\x21\xf9\x04", struct.pack("<BHB", 2 << 2 | 1, delay, blank), b"\0"]
        out += [b"\x2c", struct.pack("<HHHHB", 0, 0, columns, len(part) // columns, 0), b"\x08", _blocks(lzw_encode(part))]
    return b"".join([*out, b"\x3b"])


def _sub_blocks(media: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while media[at]:
        parts.append(media[at + 1 : at + 1 + media[at]])
        at += 1 + media[at]
    return b"".join(parts), at + 1


def images(media: bytes):
    """(canvas width, height), then for each image: a dict of its place, indices, palette, delay, disposal, transparent."""
    if media[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack_from("<HHB", media, 6)
    at, shared = 13, None
    if flags & 0x80:
        n = 3 << ((flags & 7) + 1)
        shared, at = np.frombuffer(media, np.uint8, n, at).reshape(-1, 3), at + n
    yield width, height
    control = {"delay": 0, "disposal": 0, "transparent": None}
    while media[at] != 0x3B:
        if media[at] == 0x21:
            data, after = _sub_blocks(media, at + 2)
            if media[at + 1] == 0xF9:
                f, delay, index = struct.unpack_from("<BHB", data)
                control = {"delay": delay, "disposal": (f >> 2) & 7, "transparent": index if f & 1 else None}
            at = after
        elif media[at] == 0x2C:
            left, upper, w, h, flags = struct.unpack_from("<HHHHB", media, at + 1)
            at, palette = at + 10, shared
            if flags & 0x80:
                n = 3 << ((flags & 7) + 1)
                palette, at = np.frombuffer(media, np.uint8, n, at).reshape(-1, 3), at + n
            bits = media[at]
            if not 2 <= bits <= 8:
                raise ValueError("bad code size")
            stream, at = _sub_blocks(media, at + 1)
            index = lzw_decode(stream, bits, w * h)
            if len(index) < w * h:
                raise ValueError("image too short")
            index = index.reshape(h, w)
            if flags & 0x40:  # interlaced: rows 0, 8, ..; 4, 12, ..; 2, 6, ..; 1, 3, ..
                order = np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
                index = index[np.argsort(order)]
            yield {"left": left, "top": upper, "index": index, "palette": palette} | control
            control = {"delay": 0, "disposal": 0, "transparent": None}
        else:
            raise ValueError("bad block")


def frames(media: bytes):
    """For each frame: (image, RGBA canvas, histogram of 64 bins)."""
    it = images(media)
    width, height = next(it)
    canvas = np.zeros((height, width), dtype=np.uint32)  # 0xAABBGGRR
    for x in it:
        if x["palette"] is None:
            raise ValueError("no palette")
        colours = np.zeros(256, dtype=np.uint32)
        p = x["palette"].astype(np.uint32)
        colours[: len(p)] = p[:, 0] | (p[:, 1] << 8) | (p[:, 2] << 16) | np.uint32(0xFF000000)
        index = x["index"][: max(0, height - x["top"]), : max(0, width - x["left"])]
        box = (slice(x["top"], x["top"] + index.shape[0]), slice(x["left"], x["left"] + index.shape[1]))
        before = canvas[box].copy() if x["disposal"] == 3 else None
        new = colours[index]
        canvas[box] = new if x["transparent"] is None else np.where(index == x["transparent"], canvas[box], new)
        shown = canvas[canvas >= 0x01000000]
        bins = ((shown >> 6) & 3) << 4 | ((shown >> 14) & 3) << 2 | ((shown >> 22) & 3)
        yield x, canvas, np.bincount(bins, minlength=BINS)
        if x["disposal"] == 2:
            canvas[box] = 0
        elif x["disposal"] == 3:
            canvas[box] = before


FRAME = "frame int, start_cs long, delay_cs int, disposal int, transparent int, left int, top int, width int, height int, rgba_sha256 string, histogram array<long>"


def frame_rows(media: bytes, pixels: bool = False) -> list[dict]:
    """Stored frames: start and delay in hundredths of a second, place, histogram, digest (and pixels) of the canvas."""
    out, start = [], 0
    for i, (x, canvas, hist) in enumerate(frames(media)):
        h, w = x["index"].shape
        row = {"frame": i, "start_cs": start, "delay_cs": x["delay"], "disposal": x["disposal"], "transparent": x["transparent"], "left": x["left"], "top": x["top"], "width": w, "height": h, "rgba_sha256": hashlib.sha256(canvas.tobytes()).hexdigest(), "histogram": hist.tolist()}
        out.append(row | ({"rgba": canvas.astype("<u4").tobytes()} if pixels else {}))
        start += x["delay"]
    return out


def decode(df: DataFrame, key: str, media: str = "media", pixels: bool = False) -> DataFrame:
    """One row for each frame of each medium: key, the columns of FRAME (and rgba), error (null unless broken)."""
    import pandas as pd

    schema = f"key long, {FRAME}{', rgba binary' if pixels else ''}, error string"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(parts):
        for pdf in parts:
            for k, m in zip(pdf["key"], pdf["media"], strict=True):
                try:
                    rows = [r | {"error": None} for r in frame_rows(bytes(m or b""), pixels)]
                except (ValueError, IndexError, struct.error) as e:
                    rows = [{"error": str(e) or "broken"}]
                if rows:
                    out = pd.DataFrame([dict.fromkeys(names) | {"key": k} | r for r in rows], columns=names, dtype=object)
                    for c in ("frame", "start_cs", "delay_cs", "disposal", "transparent", "left", "top", "width", "height"):
                        out[c] = out[c].astype("Int64")
                    yield out

    return df.select(F.col(key).alias("key"), F.col(media).alias("media")).mapInPandas(run, schema).withColumnRenamed("key", key)


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b" " * (-len(raw) % COLUMNS or (0 if raw else COLUMNS))


def media_row(text: str | None) -> tuple:
    """Of one text: its medium, the timed frames and digests of what is read back from it."""
    media = encode(payload_of(text))
    parts, start, found, total = [], 0, [], np.zeros(BINS, dtype=np.int64)
    for x, _canvas, h in frames(media):
        parts.append(x["index"].tobytes())
        found.append({"start_cs": start, "delay_cs": x["delay"], "height": len(x["index"]), "histogram": h.tolist()})
        start, total = start + x["delay"], total + h
    back = b"".join(parts)
    feature = f"{len(found)}:{start}:" + ",".join(f"{i}={v}" for i, v in enumerate(total.tolist()) if v)
    return len((text or "").encode()), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, media, found


#: The columns of text_media besides doc_id.
MEDIA = {
    "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "media": pa.binary(),
    "frames": pa.list_(pa.struct([("start_cs", pa.int64()), ("delay_cs", pa.int32()), ("height", pa.int32()), ("histogram", pa.list_(pa.int64()))])),
}


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, media, frames."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                columns = zip(*[media_row(t.as_py()) for t in part.column(1)], strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(columns, MEDIA.values(), strict=True))], names=["doc_id", *MEDIA])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
        "media binary, frames array<struct<start_cs: long, delay_cs: int, height: int, histogram: array<long>>>",
    )


def op5(spark, sf_dir):
    return text_media(table(spark, sf_dir, "documents")).drop("media", "frames")
