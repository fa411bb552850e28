"""Word shingles of texts as sorted arrays of 64-bit hashes, many texts at a time.

Words end at ASCII white space (space, tab to carriage return) only; A-Z are lower-cased. A word's hash is a polynomial
of its bytes, each through a table of random numbers; by running sums over a buffer every word costs a few array
operations. Texts are worked off in portions of about ``PORTION`` bytes; a longer text is cut at white space for its
words and put together again, so no text is limited in length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ledgerloom.llm.pieces import mixed

PORTION = 1 << 20

_U = np.uint64
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)
_BASE = _U(0xA0761D6478BD642F)
_BACK = _U(pow(int(_BASE), -1, 1 << 64))  # its inverse modulo 2 ** 64

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * _MULT[0])
_BYTES[65:91] = _BYTES[97:123]
_BYTES[_BLANK] = 0


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base)]))


_POWERS, _INVERSE = _powers(_BASE, PORTION), _powers(_BACK, PORTION)


def word_hashes(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words before each start) for bytes of texts that begin at starts; the last start
    is the end of all."""
    blank = _BLANK[raw]
    first = ~blank
    first[1:] &= blank[:-1]
    inner = starts[(starts > 0) & (starts < len(raw))]
    first[inner] = ~blank[inner]
    last = np.zeros(len(raw), dtype=bool)  # before a blank, or before another text
    last[:-1] = blank[1:]
    last[inner - 1] = True
    last[-1:] = True
    last &= ~blank
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = np.empty(len(begin), dtype=np.uint64)
    at = 0
    while at < len(begin):  # as many words as fit into the table of powers
        upto = max(at + 1, int(np.searchsorted(end, begin[at] + PORTION, "right")))
        low, high = begin[at], end[upto - 1]
        if high - low <= PORTION:
            sums = np.zeros(high - low + 1, dtype=np.uint64)
            np.cumsum(_BYTES[raw[low:high]] * _POWERS[: high - low], out=sums[1:])
            b, e = begin[at:upto] - low, end[at:upto] - low
            hashes[at:upto] = mixed((sums[e] - sums[b]) * _INVERSE[b] + (e - b).astype(np.uint64) * _MULT[0])
        else:  # one word longer than the table
            h = np.zeros(1, dtype=np.uint64)
            for i in range(low, high, PORTION):
                part = raw[i : min(high, i + PORTION)]
                h = mixed(h * _MULT[1] + (_BYTES[part] * _POWERS[: len(part)]).sum(dtype=np.uint64, keepdims=True))
            hashes[at] = h[0]
        at = upto
    return hashes, np.searchsorted(begin, starts)


def _sets(hashes: np.ndarray, counts: np.ndarray, width: int) -> Iterator[np.ndarray]:
    x = np.full(max(0, len(hashes) - width + 1), width, dtype=np.uint64)
    for j in range(width):
        x = mixed(x * _MULT[1] + hashes[j : j + len(x)] + _MULT[2])
    for lo, hi in zip(counts[:-1].tolist(), counts[1:].tolist(), strict=True):
        if hi - lo >= width:
            own = np.sort(x[lo : hi - width + 1])
            yield own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif hi > lo:
            h = np.full(1, hi - lo, dtype=np.uint64)
            for j in range(lo, hi):
                h = mixed(h * _MULT[1] + hashes[j] + _MULT[2])
            yield h
        else:
            yield np.zeros(0, dtype=np.uint64)


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The set of each text in turn; empty for null texts and texts without words."""
    texts = pa.concat_arrays([texts.cast(pa.large_string()).fill_null("")])
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PORTION, "right")) - 1)
        own = offsets[at : upto + 1]
        hashes, counts = word_hashes(raw[own[0] : own[-1]], own - own[0])
        yield from _sets(hashes, counts, width)
        at = upto


def shingles(text: str | None, width: int) -> np.ndarray:
    return next(shingle_sets(pa.array([text], pa.string()), width))
