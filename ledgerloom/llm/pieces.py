"""SentencePiece encoding and decoding: distinct segmentations by Gumbel top-k over the piece lattice.

Every path through a text's lattice of pieces is a segmentation; its weight is exp(alpha * sum of scores). The
operator emits the k segmentations of greatest Gumbel-perturbed log probability, which is a sample of k without
replacement, by A* over regions of the lattice: a region is "the first j pieces of an emitted segmentation, then
any piece but those already taken there". The region with the greatest perturbed bound is opened next, its best
member is drawn top down, and what is left of it is divided into regions again, each with a Gumbel variate truncated
at its parent's. The bounds are exact, so no emitted segmentation repeats and none is missed.

No piece continues over a space or line break (nor from a letter to a full stop or comma), so a text's lattice is a chain of small lattices ("units": spaces and
the word after them); their forward probabilities are computed once for each distinct unit of a batch, with array
operations over all of them. All random numbers are hashes of (row key, sample, unit, step): results don't depend
on partitioning, batches or reruns. Rows are independent: no shuffle, memory is bounded by a batch and by the
cache of units (``CACHE_STATES``); executors that are lost only repeat their own rows.

Each result row has the sample's number (0 first), its ids, their log probability, and log_inclusion, the log of the
probability with which a segmentation of that weight exceeds the threshold (the best bound that was not emitted; 0 if
nothing is left): weights exp(log_prob - log_inclusion) give unbiased sums over segmentations.

As in SentencePiece with byte fallback: one space is put before a text, spaces become U+2581, characters without a
piece become their UTF-8 bytes. A U+2581 of the text itself also becomes bytes, so decoding returns every text
exactly. Null and empty texts have one segmentation, without pieces. A null key stays null; such a row is seeded by its text. A text with fewer than k segmentations has
fewer rows. Repeated rows (equal keys) give equal results. Very long texts are whole. Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
import math
import re
import zlib
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import give_back, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES, ALPHA = 2, 5e-4
#: Characters of text in one step of work; states that the cache of units may hold.
BATCH_CHARS, CACHE_STATES = 1_000_000, 2_000_000
#: Rows whose texts are Python strings at once, beside those of a step.
ROWS_AT_ONCE = 256
SLOT_BITS = 20
#: The first pieces of a segmentation are regions of their own; those after are one region until it is opened.
HEAD = 8
SPACE, OWN_MARK, SEP = "▁", "\ud800", "\ud801"  # lone surrogates can't be in a text

#: No piece of the usual vocabularies goes on from a letter to one of these marks (it is checked for each model).
CUT = re.compile(r"[.,](?<=[^\W\d_¹²³][.,])")

_U = np.uint64
_A, _B, _C = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_P = _U(0x100000001B3)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _B
    x = (x ^ (x >> _U(27))) * _C
    return x ^ (x >> _U(31))


def rolled(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The hash of a string that goes on by a character."""
    return (h + codes + _A) * _C


def slot(h: np.ndarray) -> np.ndarray:
    return (h >> _U(64 - SLOT_BITS)).astype(np.int64)


class Vocabulary:
    """Pieces by length, as sorted hashes of their characters."""

    def __init__(self, model: str, alpha: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.bytes = [b""] * n
        self.byte_id = np.zeros(256, dtype=np.int64)
        pieces, lowest = [], 0.0
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.bytes[i] = piece.replace(SPACE, " ").encode()
                score = sp.get_score(i)
                pieces.append((piece, i, score))
                lowest = min(lowest, score if score > -1e8 else 0.0)
        self.unknown = alpha * lowest - 10.0
        self.cuts = not any(CUT.search(x[0]) for x in pieces)
        self.by_length = {}
        # by the first bits of a hash: can it be that of a piece, of the beginning of a piece?
        self.maybe, self.prefix = np.zeros(1 << SLOT_BITS, dtype=bool), np.zeros(1 << SLOT_BITS, dtype=bool)
        for length in {len(p) for p, _, _ in pieces}:
            own = [x for x in pieces if len(x[0]) == length]
            codes = np.array([[ord(c) for c in x[0]] for x in own], dtype=np.uint64)
            h = np.zeros(len(own), dtype=np.uint64)
            for j in range(length):
                h = rolled(h, codes[:, j])
                self.prefix[slot(h)] = True
            order = np.argsort(h)
            scores = np.array([max(x[2], lowest) for x in own], dtype=np.float64) * alpha
            self.maybe[slot(h)] = True
            self.by_length[length] = (h[order], np.array([x[1] for x in own], dtype=np.int32)[order], scores[order])
        self.longest = max(self.by_length)

    def spell(self, ids: np.ndarray) -> bytes:
        """The bytes of all ids, one after the other, by array operations."""
        if not hasattr(self, "flat"):
            self.flat = np.frombuffer(b"".join(self.bytes), dtype=np.uint8)
            self.size = np.array(list(map(len, self.bytes)), dtype=np.int64)
            self.begin = np.cumsum(self.size) - self.size
        sizes = self.size[ids]
        shift = self.begin[ids] - (np.cumsum(sizes) - sizes)
        return self.flat[np.repeat(shift, sizes) + np.arange(int(sizes.sum()))].tobytes()

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes.__getitem__, ids))[1:].decode()


class Units:
    """Lattices of the distinct units seen so far: states (a unit's positions) with edges in compressed rows."""

    def __init__(self, vocabulary: Vocabulary, most: int = CACHE_STATES):
        self.v, self.most = vocabulary, most
        self.clear()

    def clear(self):
        self.index: dict[str, int] = {}
        self.start = np.zeros(0, dtype=np.int64)  # a unit's first state
        self.ptr = np.zeros(1, dtype=np.int64)  # a state's first edge
        self.to = np.zeros(0, dtype=np.int32)  # the state after an edge, -1 at a unit's end
        self.piece = np.zeros(0, dtype=np.int32)  # its piece (or byte), or -1 - code point of several bytes
        self.logp = np.zeros(0, dtype=np.float32)  # its probability given its state
        self.other = np.zeros(0, dtype=np.float32)  # log probability of its state's other edges together
        self.cum = np.zeros(0, dtype=np.float32)

    def add(self, units: list[str]) -> None:
        """The lattices of new units, by array operations over all their positions."""
        v = self.v
        lengths = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        n = len(codes)
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        left = np.repeat(first + lengths, lengths) - np.arange(n)  # characters up to the unit's end
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]] = []
        at, h = np.arange(n), np.zeros(n, dtype=np.uint64)
        single = np.zeros(n, dtype=bool)
        for length in range(1, v.longest + 1):
            if length > 1:
                keep = left[at] >= length
                at, h = at[keep], h[keep]
            if not len(at):
                break
            h = rolled(h, codes[at + length - 1])
            at, h = at[keep := v.prefix[slot(h)]], h[keep]
            if length in v.by_length:
                keys, ids, scores = v.by_length[length]
                some = np.flatnonzero(v.maybe[slot(h)])
                j = np.minimum(np.searchsorted(keys, h[some]), len(keys) - 1)
                hit = keys[j] == h[some]
                some, j = some[hit], j[hit]
                found.append((at[some], ids[j], scores[j], length))
                if length == 1:
                    single[at[some]] = True
        found.reverse()
        lone = np.flatnonzero(~single)
        shown = np.where(codes[lone] == _U(ord(OWN_MARK)), _U(ord(SPACE)), codes[lone])
        shown = shown.astype(np.int64)
        ascii_ = shown < 128
        lone_id = np.where(ascii_, v.byte_id[np.where(ascii_, shown, 0)], -1 - shown)
        found.append((lone, lone_id.astype(np.int32), np.full(len(lone), v.unknown), 1))
        state = np.concatenate([x[0] for x in found])
        length = np.concatenate([np.full(len(x[0]), x[3], dtype=np.int64) for x in found])
        piece = np.concatenate([x[1] for x in found])
        weight = np.concatenate([x[2] for x in found])
        order = np.argsort(state, kind="stable")  # long pieces first, as they come
        state, length, piece, weight = state[order], length[order], piece[order], weight[order]
        ptr = np.searchsorted(state, np.arange(n + 1))
        # total weight of all ways from a state to its unit's end, from the ends backwards
        beta = np.zeros(n + 1)
        ends = state + length == np.repeat(first + lengths, lengths)[state]
        from_end = left[state]
        furthest = int(lengths.max(initial=0))
        by_left = np.argsort(from_end.astype(np.uint16) if furthest < 1 << 16 else from_end, kind="stable")
        cuts = np.concatenate([[0], np.cumsum(np.bincount(from_end, minlength=furthest + 1))])[1:]
        for k in range(len(cuts) - 1):
            e = by_left[cuts[k] : cuts[k + 1]]
            if not len(e):
                continue
            after = np.where(ends[e], 0.0, beta[state[e] + length[e]])
            x, s = weight[e] + after, state[e]
            lead = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            top = np.maximum.reduceat(x, lead)
            sizes = np.diff(np.append(lead, len(s)))
            total = np.add.reduceat(np.exp(x - np.repeat(top, sizes)), lead)
            beta[s[lead]] = top + np.log(total)
        logp = weight + np.where(ends, 0.0, beta[state + length]) - beta[state]
        p = np.exp(logp)
        top = np.maximum.reduceat(p, ptr[:-1])[state]
        low = np.where(p == top, 0.0, p)
        low = np.add.reduceat(low, ptr[:-1])[state]  # without the likeliest edge, so that nothing is lost beside a 1
        tied = np.add.reduceat((p == top).astype(np.float64), ptr[:-1])[state]
        with np.errstate(divide="ignore"):
            other = np.log(np.where(p == top, low + (tied - 1) * top, np.maximum(1 - p, 0.0)))
        run = np.cumsum(p)
        before = np.concatenate([[0.0], run])[ptr[:-1]]
        cum = run - before[state]
        cum[ptr[1:] - 1] = 2.0  # whatever rounding did, the last edge takes the rest
        base, edges = len(self.ptr) - 1, len(self.to)
        self.index.update(zip(units, range(len(self.start), len(self.start) + len(units)), strict=True))
        self.start = np.concatenate([self.start, first + base])
        self.ptr = np.concatenate([self.ptr, ptr[1:] + edges])
        self.to = np.concatenate([self.to, np.where(ends, -1, state + length + base).astype(np.int32)])
        self.piece = np.concatenate([self.piece, piece])
        self.logp = np.concatenate([self.logp, np.minimum(logp, 0.0).astype(np.float32)])
        self.other = np.concatenate([self.other, other.astype(np.float32)])
        self.cum = np.concatenate([self.cum, cum.astype(np.float32)])

    def lookup(self, units: list[str]) -> np.ndarray:
        found = np.fromiter(map(self.index.get, units, itertools.repeat(-1)), dtype=np.int64, count=len(units))
        new = np.flatnonzero(found < 0)
        if len(new):
            if len(self.ptr) > self.most:
                self.clear()
                new = np.arange(len(units))
            names = [units[i] for i in new.tolist()]
            self.add(list(dict.fromkeys(names)))
            found[new] = np.fromiter(map(self.index.__getitem__, names), dtype=np.int64, count=len(names))
        return found

    def draw(self, states: np.ndarray, seeds: np.ndarray, places: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Random ways from states to their units' ends: (edges, number of edges of each). steps: where each one's count begins."""
        n = len(states)
        active, state = np.arange(n), states
        taken: list[tuple[np.ndarray, np.ndarray]] = []
        keys = mixed(seeds + places.astype(np.uint64) * _P + _A)
        step = steps.astype(np.uint64)
        while len(active):
            u = ((mixed(keys[active] + step[active] * _A) >> _U(11)).astype(np.float64) + 0.5) / float(1 << 53)
            edge = self.ptr[state]
            wait = np.flatnonzero(u > self.cum[edge])
            while len(wait):
                edge[wait] += 1
                wait = wait[u[wait] > self.cum[edge[wait]]]
            taken.append((active, edge))
            state = self.to[edge]
            on = state >= 0
            active, state = active[on], state[on]
            step += _U(1)
        counts = np.zeros(n, dtype=np.int64)
        for a, _ in taken:
            counts[a] += 1
        offset = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), dtype=np.int64)
        for k, (a, e) in enumerate(taken):
            out[offset[a] + k] = e
        return out, counts


def split_units(text: str, cuts: bool = False) -> list[str]:
    """A text's units; together they are the text with a space before it. cuts: marks after letters begin units too."""
    if cuts:
        text = CUT.sub(SEP + r"\g<0>", text)
    x = (SPACE + text.replace(SPACE, OWN_MARK).replace(" ", SEP + SPACE)).replace("\n", SEP + "\n" + SEP)
    return [u for u in x.replace(SPACE + SEP, SPACE).split(SEP) if u]


class _Search:
    """The A* queue of one text: (-bound, number, path, position, pieces used up there).

    used None: the far part of a path, all segmentations that share its first ``position`` pieces but not all."""

    def __init__(self, key: int, units: Units):
        self.random = Random(key).random
        self.units, self.heap, self.paths, self.counts = units, [], [], []
        self.bound = -math.log(-math.log(self.random() or 0.5))  # of the whole lattice, whose mass is 1

    def push(self, mass_log: float, limit: float, *where) -> None:
        """A region, with a Gumbel variate that doesn't exceed limit."""
        a, b = mass_log - limit, math.log(-math.log(self.random() or 0.5))
        top = max(a, b)
        bound = mass_log - top - math.log(math.exp(a - top) + math.exp(b - top))
        heapq.heappush(self.heap, (-bound, len(self.paths) * 1_000_000 + len(self.heap), *where))

    def path(self, edges: np.ndarray, j: int, bound: float, used: frozenset | None) -> None:
        """An emitted path; its first j pieces, and their regions, are an older path's; used: pieces used up at j."""
        phi = np.zeros(len(edges) + 1)
        np.cumsum(self.units.logp[edges], out=phi[1:])
        me = len(self.paths)
        self.paths.append((edges, phi))
        if used is not None:
            used = used | {int(edges[j])}
            free = self.free(me, j, used)[1]
            if free and free[-1] > 0:
                self.push(float(phi[j]) + math.log(free[-1]), bound, me, j, used)
            j += 1
        for x, mass in zip(*self.parts(me, j), strict=True):
            self.push(mass, bound, me, *x)

    def parts(self, me: int, j: int) -> tuple[list, list]:
        """Regions of a path from position j: the next HEAD positions, and the far part; with their log masses."""
        edges, phi = self.paths[me]
        stop = min(len(edges), j + HEAD)
        where, masses = [], []
        for at, e, f, other in zip(range(j, stop), edges[j:stop].tolist(), phi[j:stop].tolist(), self.units.other[edges[j:stop]].tolist(), strict=True):
            if other > -math.inf:
                where.append((at, frozenset([e])))
                masses.append(f + other)
        if stop < len(edges):
            far = -math.expm1(float(phi[-1] - phi[stop]))
            if far < 1e-3:  # by its parts, since little is left beside 1
                far = float(np.exp(phi[stop:-1] - phi[stop] + self.units.other[edges[stop:]]).sum())
            if far > 0:
                where.append((stop, None))
                masses.append(float(phi[stop]) + math.log(far))
        return where, masses

    def free(self, me: int, j: int, used) -> tuple[list, list]:
        """Edges that aren't used up at a position, and their running probabilities."""
        ptr, e = self.units.ptr, self.paths[me][0][j]
        state = int(np.searchsorted(ptr, e, side="right")) - 1
        free = [x for x in range(int(ptr[state]), int(ptr[state + 1])) if x not in used]
        return free, list(itertools.accumulate(math.exp(x) for x in self.units.logp[free].tolist())) if free else []

    def pop(self):
        """(path, position, edge to take there, bound, pieces used up there) of the best region, or None."""
        while self.heap:
            bound, _, me, j, used = heapq.heappop(self.heap)
            bound = -bound
            if used is None:  # one of its parts has its bound, the others lie below
                where, masses = self.parts(me, j)
                top = max(masses)
                run = list(itertools.accumulate(math.exp(x - top) for x in masses))
                pick = min(bisect.bisect_left(run, self.random() * run[-1]), len(run) - 1)
                for i, (x, mass) in enumerate(zip(where, masses, strict=True)):
                    if i != pick:
                        self.push(mass, bound, me, *x)
                heapq.heappush(self.heap, (-bound, len(self.paths) * 1_000_000 + len(self.heap), me, *where[pick]))
                continue
            free, run = self.free(me, j, used)
            return me, j, free[min(bisect.bisect_left(run, self.random() * run[-1]), len(run) - 1)], bound, used
        return None


def sample_batch(units: Units, keys: np.ndarray, texts: list[str], k: int):
    """For each text the list of (edges, log probability), and the threshold after them."""
    lists = [split_units(t, units.v.cuts) if t else [] for t in texts]
    sizes = np.array([len(x) for x in lists], dtype=np.int64)
    ids = units.lookup([u for x in lists for u in x])
    offset = np.concatenate([[0], np.cumsum(sizes)])
    place = np.arange(len(ids)) - np.repeat(offset[:-1], sizes)
    starts = units.start[ids]
    seeds = np.repeat(uniform_keys(keys, 0), sizes)
    edges, counts = units.draw(starts, seeds, place, np.zeros(len(ids), dtype=np.int64))
    ends = np.concatenate([[0], np.cumsum(counts)])
    searches = []
    for d, key in enumerate(keys):
        s = _Search(int(key), units)
        s.counts.append(counts[offset[d] : offset[d + 1]])
        s.path(edges[ends[offset[d]] : ends[offset[d + 1]]], 0, s.bound, None)
        searches.append(s)
    for e in range(1, k):
        todo = []
        for d, s in enumerate(searches):
            if (x := s.pop()) is not None:
                me, j, edge, g, taken = x
                c = s.counts[me]
                upto = np.cumsum(c)
                unit = int(np.searchsorted(upto, j, side="right"))
                done = j - (int(upto[unit]) - int(c[unit])) + 1  # pieces of this unit, with the new one
                todo.append((d, s, me, j, edge, g, taken, unit, done))
        if not todo:
            break
        flat_state, flat_place, flat_step, flat_seed, lens = [], [], [], [], []
        for d, _s, _me, _j, edge, _g, _t, unit, done in todo:
            after = int(units.to[edge])
            here = starts[offset[d] + unit + 1 : offset[d + 1]]
            where = np.arange(unit + 1, sizes[d])
            if after >= 0:
                here, where = np.concatenate([[after], here]), np.concatenate([[unit], where])
            steps = np.zeros(len(here), dtype=np.int64)
            if after >= 0:
                steps[0] = done
            flat_state.append(here), flat_place.append(where), flat_step.append(steps), lens.append(len(here))
            flat_seed.append(np.repeat(uniform_keys(keys[d : d + 1], e), len(here)))
        got, number = units.draw(*(np.concatenate(x) for x in (flat_state, flat_seed, flat_place, flat_step)))
        ends_n, at = np.concatenate([[0], np.cumsum(number)]), 0
        for (_d, s, me, j, edge, g, taken, unit, done), m in zip(todo, lens, strict=True):
            new = got[ends_n[at] : ends_n[at + m]]
            c = s.counts[me][: unit + 1].copy()
            own = number[at : at + m]
            if units.to[edge] >= 0:
                c[unit], own = done + own[0], own[1:]
            else:
                c[unit] = done
            s.counts.append(np.concatenate([c, own]))
            s.path(np.concatenate([s.paths[me][0][:j], [edge], new]), j, g, taken)
            at += m
    return [([(x[0], float(x[1][-1])) for x in s.paths], -s.heap[0][0] if s.heap else -math.inf) for s in searches]


def uniform_keys(keys: np.ndarray, sample: int) -> np.ndarray:
    return mixed(keys.astype(np.int64).view(np.uint64) * _P + _U((sample + 1) * int(_A) % 2**64))


_CACHE: dict = {}


def _units(model: str, alpha: float) -> Units:
    """One for each Python worker."""
    if (model, alpha) not in _CACHE:
        _CACHE[model, alpha] = Units(Vocabulary(model, alpha))
    return _CACHE[model, alpha]


def expand(piece: np.ndarray, byte_id: np.ndarray) -> np.ndarray:
    """Ids; characters without a piece become the ids of their bytes."""
    if not len(piece) or piece.min() >= 0:
        return piece
    out, at = [], 0
    for i in np.flatnonzero(piece < 0).tolist():
        out += [piece[at:i], byte_id[list(chr(-1 - int(piece[i])).encode())]]
        at = i + 1
    return np.concatenate([*out, piece[at:]]).astype(np.int32)


def segmentations(docs: DataFrame, key="doc_id", text="text", samples=SAMPLES, alpha=ALPHA, model=MODEL, states=CACHE_STATES, chars_at_once=BATCH_CHARS, keep=True) -> DataFrame:
    """(key, sample, ids, log_prob, log_inclusion, exact) for each row; exact: decoding the ids gave the text.

    keep: whether a Python process remembers units from one task to the next; that costs memory beside other work."""

    def run(batches):
        units = _units(model, alpha)
        units.most = states

        def emit(keys, texts):
            seeds = [zlib.crc32(t.encode()) if k is None else k for k, t in zip(keys, texts, strict=True)]
            found = sample_batch(units, np.array(seeds, dtype=np.int64), texts, samples)
            cols = ([], [], [], [], [], [])
            for key_, t, (paths, limit) in zip(keys, texts, found, strict=True):
                for i, (edges, phi) in enumerate(paths):
                    ids = expand(units.piece[edges], units.v.byte_id)
                    gap = phi - limit
                    inclusion = 0.0 if limit == -math.inf or gap > 5 else gap if gap < -30 else math.log(-math.expm1(-math.exp(gap)))
                    for c, x in zip(cols, (key_, i, ids, phi, inclusion, t), strict=True):
                        c.append(x)
            flat = np.concatenate(cols[2]) if cols[2] else np.zeros(0, dtype=np.int32)
            lens = np.concatenate([[0], np.cumsum([len(x) for x in cols[2]])]).astype(np.int32)
            lens_ = lens.tolist()
            raw, exact = units.v.spell(flat), []
            sizes = np.concatenate([[0], np.cumsum(units.v.size[flat])])
            for i, t in enumerate(cols[5]):
                a, b = int(sizes[lens_[i]]), int(sizes[lens_[i + 1]])
                exact.append(raw[a + 1 : b] == t.encode())
            lists = pa.ListArray.from_arrays(pa.array(lens), pa.array(flat.astype(np.int32)))
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), lists, pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.float64()), pa.array(exact, pa.bool_())],
                names=["key", "sample", "ids", "log_prob", "log_inclusion", "exact"],
            )

        keys, texts, chars = [], [], 0
        for batch in (whole.slice(i, ROWS_AT_ONCE) for whole in batches for i in range(0, whole.num_rows, ROWS_AT_ONCE)):
            for k_, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys.append(k_), texts.append(t or "")
                chars += len(texts[-1])
                if chars > chars_at_once or len(keys) >= 4096:
                    yield emit(keys, texts)
                    keys, texts, chars = [], [], 0
        if keys:
            yield emit(keys, texts)
        keys, texts, batch = [], [], None
        if not keep:
            units.clear()
        give_back()

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    out = rows.mapInArrow(run, "key long, sample int, ids array<int>, log_prob double, log_inclusion double, exact boolean")
    return out.withColumnRenamed("key", key)


def decode_ids(df: DataFrame, ids="ids", model=MODEL) -> DataFrame:
    """df with a column decoded (in place of one of that name): the texts of its id lists; null for null."""

    def run(batches):
        v = _units(model, ALPHA).v
        for b in batches:
            found = [None if x is None else v.decode(x) for x in b.column(b.schema.get_field_index(ids)).to_pylist()]
            yield b.append_column("decoded", pa.array(found, pa.string()))

    df = df.drop("decoded")
    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("decoded", T.StringType())]))


def op1(spark, sf_dir):
    return segmentations(table(spark, sf_dir, "documents"))
