"""Scoring by online logistic mixing of hashed-context bit predictors.

The text, A-Z lower-cased, is coded as bytes and one end symbol. A symbol is a walk down a binary tree that belongs to the
byte before it (a Huffman tree of the corpus' byte pairs), so it takes about three and a half binary decisions. Four
predictors know how often each decision went which way: by the two, the four and the six bytes before, and by the letters of the
current word. Their contexts are hashed into tables of counts that every training document adds to.
A mixer weighs the predictions in the logistic domain; which weights are used is gated by which contexts were ever seen, and
after each decision the weights take one gradient step. A last table refines the mixed probability. The product over all
decisions is the model's probability of the text.

Counting is a sum over all training documents: each task counts its own, and tables meet in segments. The weights and the
refinement are fitted on every training document too: of two halves each is looked up in the counts of the other, and how often
which predictions met with which outcome is summed in a table of fixed size, from which both are solved. A bounded sample only
says where the solution starts. In scoring the weights go on from there in
every lane of ``LANE`` symbols, so a score depends on the text and the training documents only, never on the neighbours in
the batch. The lanes of a batch advance together.

For the unigram base, tokens are counted exactly: each block of documents asks for its distinct tokens, the requests meet by
token, and the counts go back to the block.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetloom.llm.common import bytes_of, discard, mix64, stable_row_id, write_out
from fleetloom.session import ship_package

END, SYMBOLS = 256, 257
LANE = 128  # symbols that share one run of adapting weights
CHUNK = 1 << 19  # bytes of text worked on at once
SUM_CHUNK = 1 << 17  # the same where sums are all that is made: their arrays then stay in the processor's cache
ORDERS = (2, 4, 6)  # predictors by so many bytes before
HASHED = len(ORDERS) + 1  # predictors with hashed contexts: those, and the word so far; four cells fill one 64-bit number
GATES = 16  # sets of weights: how often the six bytes' context was seen, and the word's
SEGMENT = 1 << 14  # table cells that travel in one row
BLOCK_SHIFT = 11  # 2048 neighbouring rows make a block for token counts
SAMPLE_BYTES, SAMPLE_SHARE, SAMPLE_LONGEST = 4 << 20, 10, 1 << 16
RATE = 0.006
KEEP_NEAR = 100.0  # how many decisions the start of the weights counts for
LIMIT = 11.0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_END_TOKEN = np.uint64(0x5E2D58D8B3BCDF1A)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


# ---- the binary decisions


@dataclass
class Code:
    """Paths through the trees: of symbol s after byte c, steps begin[c, s] .. + length[c, s] of ``node`` and ``bit``."""

    length: np.ndarray
    begin: np.ndarray
    node: np.ndarray
    bit: np.ndarray


def build_code(pairs: np.ndarray) -> Code:
    """Huffman trees from counts of (byte before, symbol); every symbol can be coded in every tree."""
    length, begin = np.zeros((256, SYMBOLS), np.int32), np.zeros((256, SYMBOLS), np.int64)
    nodes, bits, at = [], [], 0
    for c in range(256):
        heap = [(int(2 * w + 1), s, s) for s, w in enumerate(pairs[c])]
        heapq.heapify(heap)
        parent, name = {}, SYMBOLS
        while len(heap) > 1:
            (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
            parent[x], parent[y] = (name, 0), (name, 1)
            heapq.heappush(heap, (a + b, name, name))
            name += 1
        for s in range(SYMBOLS):
            path, x = [], s
            while x in parent:
                up, b = parent[x]
                path.append((up - SYMBOLS, b))
                x = up
            length[c, s], begin[c, s] = len(path), at
            at += len(path)
            nodes += [p for p, _ in reversed(path)]
            bits += [b for _, b in reversed(path)]
    return Code(length, begin, np.array(nodes, np.uint8), np.array(bits, np.uint8))


@dataclass
class Stream:
    """Symbols of some documents: byte before, symbol, hashes of the contexts, document of each."""

    before: np.ndarray
    symbol: np.ndarray
    hashes: list[np.ndarray]
    size: np.ndarray  # symbols per document


def to_stream(data: np.ndarray, offsets: np.ndarray) -> Stream:
    """``data`` is lower-cased. Six line feeds stand before every document, its end symbol behind."""
    sizes = np.diff(offsets)
    d = len(sizes)
    full = np.full(len(data) + 7 * d, 10, np.uint8)
    shift = 7 * np.arange(d) + 6
    is_byte = np.arange(len(data)) + np.repeat(shift, sizes)
    full[is_byte] = data
    ends = offsets[1:] + shift
    own = np.ones(len(full), bool)
    for k in range(6):
        own[offsets[:-1] + 7 * np.arange(d) + k] = False
    symbol = full.astype(np.int16)
    symbol[ends] = END
    hashes = []
    with np.errstate(over="ignore"):
        wide = full.astype(np.uint64)
        recent = np.zeros(len(full), np.uint64)
        for back in range(1, ORDERS[-1] + 1):
            recent[back:] |= wide[:-back] << np.uint64(8 * back - 8)
            if back in ORDERS:
                hashes.append(_short(recent, len(hashes))[own])
        power, inverse = _powers(len(full))
        total = np.zeros(len(full) + 1, np.uint64)
        np.cumsum((wide + np.uint64(1)) * power, out=total[1:])
        # Begin of the word that the byte before is in.
        begin = np.zeros(len(full), np.int64)
        begin[1:] = np.maximum.accumulate(np.where(_BLANK[full], np.arange(1, len(full) + 1), 0))[:-1]
        word = (total[:-1] - total[begin]) * inverse[begin]
        word[1:] += wide[:-1]
        hashes.append(_short(word, len(hashes))[own])
    before = np.full(len(full), 10, np.uint8)
    before[1:] = full[:-1]
    return Stream(before[own], symbol[own], hashes, sizes + 1)


def _short(x: np.ndarray, k: int) -> np.ndarray:
    return (mix64(x + np.uint64(k + 1) * _ODD) >> np.uint64(32)).astype(np.uint32)


_MADE_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of an odd number and of its inverse, kept between calls."""
    if len(_MADE_POWERS[0]) < n:
        for k, base in enumerate((_ODD, _ODD_INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _MADE_POWERS[k] = np.multiply.accumulate(p)
    return _MADE_POWERS[0][:n], _MADE_POWERS[1][:n]


def _decisions(stream: Stream, code: Code):
    """Owner symbol, node and bit of every decision."""
    length = code.length[stream.before, stream.symbol]
    owner = np.repeat(np.arange(len(length), dtype=np.int32), length)
    first = (code.begin[stream.before, stream.symbol] - (np.cumsum(length) - length)).astype(np.int32)
    step = first[owner] + np.arange(len(owner), dtype=np.int32)
    return length, owner, code.node[step], code.bit[step]


_NODE = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B1)).astype(np.uint32)


def _cells(h: np.ndarray, owner: np.ndarray, node_hash: np.ndarray, bits: int) -> np.ndarray:
    x = h.take(owner)
    x += node_hash
    x *= np.uint32(0x85EBCA6B)
    x >>= np.uint32(32 - bits)
    return x


def _pieces(column: pa.Array, chunk: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo..hi with their lower-cased bytes, about ``chunk`` bytes at a time (a longer text is one piece)."""
    data, offsets = bytes_of(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + chunk, side="right")) - 1)
        yield lo, hi, _LOWER[data[offsets[lo] : offsets[hi]]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


# ---- sums over the corpus


def _segments(task: int, name: int, table: np.ndarray) -> Iterator[pa.RecordBatch]:
    rows = []
    for at in range(0, len(table), SEGMENT):
        part = table[at : at + SEGMENT]
        if part.any():
            rows.append({"sub": task // 64, "name": name, "at": at, "body": pa.compress(part.astype(np.int64).tobytes(), codec="zstd", asbytes=True), "n": len(part)})
        if len(rows) == 64:
            yield pa.RecordBatch.from_pylist(rows, _SEGMENT_SCHEMA)
            rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _SEGMENT_SCHEMA)


_SEGMENT_SCHEMA = pa.schema([("sub", pa.int32()), ("name", pa.int32()), ("at", pa.int64()), ("body", pa.binary()), ("n", pa.int64())])
_SEGMENT = "sub int, name int, at long, body binary, n long"


def _open(body: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(body, decompressed_size=n * 8, codec="zstd"), np.int64)


def _sum_segments(t: pa.Table) -> pa.Table:
    total = 0
    for body, n in zip(t["body"], t["n"], strict=True):
        total = total + _open(body.as_py(), n.as_py())
    return pa.Table.from_pylist([{"sub": t["sub"][0].as_py(), "name": t["name"][0].as_py(), "at": t["at"][0].as_py(), "body": pa.compress(total.tobytes(), codec="zstd", asbytes=True), "n": len(total)}], _SEGMENT_SCHEMA)


def _summed(parts: DataFrame) -> DataFrame:
    """Tables summed by segment, 64 tasks at a time and then all."""
    some = parts.groupBy("sub", "name", "at").applyInArrow(_sum_segments, _SEGMENT)
    return some.groupBy("name", "at").applyInArrow(_sum_segments, _SEGMENT)


def _task_id() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(256 * SYMBOLS, np.int64)
    for batch in batches:
        for _, _, data, offsets in _pieces(batch.column("_text")):
            s = to_pairs(data, offsets)
            total += np.bincount(s, minlength=len(total))
    yield from _segments(_task_id(), 0, total)


def to_pairs(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(byte before) * SYMBOLS + symbol of every symbol."""
    d = len(offsets) - 1
    symbol = np.full(len(data) + d, END, np.int64)
    symbol[np.arange(len(data)) + np.repeat(np.arange(d), np.diff(offsets))] = data
    before = np.concatenate(([10], symbol[:-1]))
    before[before == END] = 10
    return before * SYMBOLS + symbol


def _count_contexts(batches: Iterator[pa.RecordBatch], code, bits: int) -> Iterator[pa.RecordBatch]:
    tables = [np.zeros(2 << bits, np.uint32) for _ in range(HASHED)]
    for batch in batches:
        for _, _, data, offsets in _pieces(batch.column("_text"), SUM_CHUNK):
            stream = to_stream(data, offsets)
            _, owner, node, bit = _decisions(stream, code.value)
            node_hash = _NODE.take(node)
            for k in range(HASHED):
                x = _cells(stream.hashes[k], owner, node_hash, bits)
                x <<= np.uint32(1)
                x |= bit
                np.add.at(tables[k], x, np.uint32(1))
    for k in range(HASHED):
        yield from _segments(_task_id(), k, tables[k])


def _tables(counts: DataFrame, bits: int) -> list[np.ndarray]:
    """Log odds of each predictor's cells from summed counts; of a fixed size, whatever the input."""
    odds = counts.groupBy("name", "at").applyInArrow(_to_stretch, "name int, at long, body binary")
    tables = [np.zeros(1 << bits, np.uint16) for _ in range(HASHED)]
    for r in odds.toLocalIterator():
        part = np.frombuffer(r["body"], np.uint16)
        tables[r["name"]][r["at"] : r["at"] + len(part)] = part
    return tables


def _to_stretch(t: pa.Table) -> pa.Table:
    """Counts (0, 1, 0, 1, ...) of a segment to log odds."""
    out = _sum_segments(t).to_pylist()[0]
    cells = to_cells(_open(out["body"], out["n"]).reshape(-1, 2))
    return pa.table({"name": pa.array([out["name"]], pa.int32()), "at": pa.array([out["at"] // 2], pa.int64()), "body": pa.array([cells.tobytes()], pa.binary())})


def to_cells(counts: np.ndarray) -> np.ndarray:
    """Counts of 0 and 1 as log odds in 14 bits and, in the last two, how much they say: never seen, up to 2, 15, more."""
    c = counts + 0.25
    odds = np.clip(np.log(c[:, 1] / c[:, 0]), -LIMIT, LIMIT)
    level = np.searchsorted([1, 3, 16], counts.sum(1), side="right")
    return np.where(level == 0, 0, np.rint((odds + LIMIT) * ODDS_STEPS).astype(np.int64) * 4 + level).astype(np.uint16)


ODDS_STEPS = 16383 / (2 * LIMIT)
_ODDS = np.where(np.arange(1 << 16) & 3, (np.arange(1 << 16) >> 2) / ODDS_STEPS - LIMIT, 0).astype(np.float32)


# ---- mixing


@dataclass
class Mixer:
    code: Code
    tables: list[np.ndarray]  # cells of each predictor
    bits: int
    weights: np.ndarray  # (gates, inputs)
    refine: np.ndarray  # log odds by (gate, step)

    def score(self, data: np.ndarray, offsets: np.ndarray, learn: bool = False, rate: float = RATE):
        """log2 probability of each document; with ``learn`` the mean weights at the end, and counts for the refinement."""
        stream = to_stream(data, offsets)
        length, owner, node, bit = _decisions(stream, self.code)
        # Lanes: runs of LANE symbols of one document. The decisions are laid out step by step over all lanes.
        lanes = -(-stream.size // LANE)
        doc_start = np.cumsum(stream.size) - stream.size
        lane_doc = np.repeat(np.arange(len(lanes)), lanes)
        lane_no = np.arange(int(lanes.sum())) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        lane_first = doc_start[lane_doc] + lane_no * LANE
        ends = np.concatenate(([0], np.cumsum(length)))
        begin = ends[lane_first]
        lane_last = np.concatenate((lane_first[1:], [len(length)]))
        size = ends[lane_last] - begin
        rank = np.argsort(-size, kind="stable")
        size, begin = size[rank], begin[rank]
        steps = int(size[0])
        active = np.searchsorted(-size, -np.arange(steps), side="left")  # lanes longer than each step
        base = np.concatenate(([0], np.cumsum(active)))
        order = np.empty(int(base[-1]), np.int32)
        for t in range(steps):
            order[base[t] : base[t + 1]] = begin[: active[t]] + t
        # Looked up in the order of the text, side by side for each decision, then laid out.
        n = len(size)
        beside = np.empty((len(order), HASHED), np.uint16)
        for i, found in enumerate(self.look_up(stream, owner, node)):
            beside[:, i] = found
        beside = beside.view(np.uint64).ravel().take(order).view(np.uint16).reshape(-1, HASHED)
        x = [_ODDS.take(beside[:, i]) for i in range(HASHED)]
        gate = beside[:, -2] & np.uint16(3)
        gate <<= np.uint16(2)
        gate |= beside[:, -1] & np.uint16(3)
        bit = bit.take(order).astype(np.float32)
        mixed = np.empty(len(order), np.float32)
        rate = np.float32(rate)
        if learn:
            w = self._learn(x, gate, bit, base, n, mixed, rate)
        else:
            # The gated weights' part is the same in all lanes; each lane refines it by weights of its own, one for the
            # two short contexts and one for the two long ones.
            mixed = sum(v * g.take(gate) for v, g in zip(x, self.weights.astype(np.float32).T, strict=True))
            short, long = x[0] + x[1], x[2] + x[3]
            for_short, for_long = np.zeros(n, np.float32), np.zeros(n, np.float32)
            for t in range(steps):
                a, b = base[t], base[t + 1]
                m = b - a
                s, u, own_s, own_u, dot = short[a:b], long[a:b], for_short[:m], for_long[:m], mixed[a:b]
                dot += s * own_s
                dot += u * own_u
                error = np.exp(-dot)
                error += 1
                np.divide(rate, error, out=error)
                np.subtract(bit[a:b] * rate, error, out=error)
                own_s += s * error
                own_u += u * error
        np.clip(mixed, -LIMIT, LIMIT, out=mixed)
        cell = self._cell(gate, mixed)
        if learn:
            ones = np.bincount(cell, weights=bit, minlength=self.refine.size)
            return w, np.bincount(cell, minlength=self.refine.size), ones
        odds = self.refine.ravel().take(cell)
        odds += mixed
        odds *= bit - np.float32(0.5)  # half the sum, with the sign of what came
        cost = np.log(np.exp(-odds) + np.float32(1))
        total = np.zeros(n)
        for t in range(steps):
            total[: active[t]] += cost[base[t] : base[t + 1]]
        return -np.bincount(lane_doc[rank], weights=total, minlength=len(lanes)) / np.log(2)

    def look_up(self, stream: Stream, owner: np.ndarray, node: np.ndarray) -> Iterator[np.ndarray]:
        """Each predictor's cells for all decisions."""
        node_hash = _NODE.take(node)
        for i in range(HASHED):
            yield self.tables[i].take(_cells(stream.hashes[i], owner, node_hash, self.bits))

    def outcomes(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of every decision its place in the table of outcomes: gate, predictions in steps, bit."""
        stream = to_stream(data, offsets)
        _, owner, node, bit = _decisions(stream, self.code)
        at = bit.astype(np.int32)
        for place, found in zip(_PLACE, self.look_up(stream, owner, node), strict=True):
            at += place.take(found)
        return at

    def _learn(self, x, gate, bit, base, n, mixed, rate):
        """Gated weights after online steps from ``self.weights`` in every lane: the mean over lanes."""
        w = [np.repeat(v, n) for v in self.weights.astype(np.float32).T]  # for each input: gates * lanes
        row, lane = gate.astype(np.int64) * n, np.arange(n)
        for a, b in zip(base[:-1], base[1:], strict=True):
            at = row[a:b] + lane[: b - a]
            own = [v.take(at) for v in w]
            dot = sum(v[a:b] * g for v, g in zip(x, own, strict=True))
            mixed[a:b] = dot
            error = (bit[a:b] - 1 / (1 + np.exp(-dot))) * rate
            for v, g, out in zip(x, own, w, strict=True):
                out[at] = g + v[a:b] * error
        return np.stack([v.reshape(-1, n).mean(1) for v in w], 1)

    def _cell(self, gate, mixed):
        step = (mixed + np.float32(LIMIT)) * np.float32(1.5)
        step += np.float32(0.5)
        return step.astype(np.uint16) + gate * np.uint16(34)


# The table of outcomes has predictions in steps; a context never seen is a step of its own.
_EDGES = np.array([-7, -5, -3.7, -2.7, -1.9, -1.2, -0.4, 0.4, 1.2, 1.9, 2.7, 3.7, 5, 7])
_STEP = np.array([0, -8.5, -5.9, -4.3, -3.2, -2.25, -1.6, -0.8, 0, 0.8, 1.6, 2.25, 3.2, 4.3, 5.9, 8.5], np.float32)
_STEPS = len(_STEP)
OUTCOMES = GATES * _STEPS**HASHED * 2


def _places() -> list[np.ndarray]:
    """What each predictor's cell adds to a decision's place; the last two also say the gate."""
    codes = np.arange(1 << 16)
    step = np.where(codes & 3, 1 + np.searchsorted(_EDGES, _ODDS), 0)
    out = [2 * _STEPS ** (HASHED - 1 - i) * step for i in range(HASHED)]
    for i, gate in ((HASHED - 2, (codes & 3) << 2), (HASHED - 1, codes & 3)):
        out[i] = out[i] + 2 * _STEPS**HASHED * gate
    return [x.astype(np.int32) for x in out]


_PLACE = _places()


def _count_outcomes(batches: Iterator[pa.RecordBatch], mixer) -> Iterator[pa.RecordBatch]:
    total = np.zeros(OUTCOMES, np.int64)
    for batch in batches:
        for _, _, data, offsets in _pieces(batch.column("_text"), SUM_CHUNK):
            np.add.at(total, mixer.value.outcomes(data, offsets), 1)
    yield from _segments(_task_id(), 0, total)


def solve(mixer: Mixer, outcomes: np.ndarray, rounds: int = 12) -> None:
    """The weights of least cost over all counted decisions, by Newton's steps from those the mixer has, and its refinement.

    Where a gate has few decisions it stays near what it starts from.
    """
    at = np.flatnonzero(outcomes.reshape(-1, 2).sum(1))
    zeros, ones = outcomes.reshape(-1, 2)[at].astype(np.float64).T
    gate = at // _STEPS**HASHED
    x = np.stack([_STEP[at // _STEPS ** (HASHED - 1 - i) % _STEPS] for i in range(HASHED)], 1).astype(np.float64)
    weights, mixed = mixer.weights.astype(np.float64), np.zeros(len(at))
    for g in range(GATES):
        rows = np.flatnonzero(gate == g)
        own, n, hits, start = x[rows], (zeros + ones)[rows], ones[rows], weights[g].copy()

        def cost(w):
            dot = own @ w
            return float((n * np.logaddexp(0, dot) - hits * dot).sum() + 0.5 * KEEP_NEAR * ((w - start) ** 2).sum())

        w, now = start, cost(start)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-(own @ w)))
            slope = own.T @ (hits - n * p) - KEEP_NEAR * (w - start)
            bend = (own * (n * p * (1 - p))[:, None]).T @ own + KEEP_NEAR * np.eye(HASHED)
            step, after = np.linalg.solve(bend, slope), np.inf
            for _ in range(20):  # a step that goes too far is halved
                if (after := cost(w + step)) <= now:
                    break
                step /= 2
            if after >= now:
                break
            w, now = w + step, after
        weights[g], mixed[rows] = w, own @ w
    mixer.weights = weights.astype(np.float32)
    cell = mixer._cell(gate.astype(np.uint16), mixed.clip(-LIMIT, LIMIT).astype(np.float32))
    _refine(mixer, np.bincount(cell, zeros + ones, mixer.refine.size), np.bincount(cell, ones, mixer.refine.size))


def _refine(mixer: Mixer, n: np.ndarray, ones: np.ndarray) -> None:
    """Add to the refinement ``n`` decisions by (gate, step), of which ``ones`` were 1."""
    start = 1 / (1 + np.exp(-mixer.refine.ravel().astype(np.float64)))
    p = (ones + 20 * start) / (n + 20)
    mixer.refine = np.log(p / (1 - p)).clip(-LIMIT, LIMIT).astype(np.float32).reshape(mixer.refine.shape)


def _fresh_mixer(code, tables, bits) -> Mixer:
    steps = (np.arange(34, dtype=np.float32) / 1.5 - LIMIT).clip(-LIMIT, LIMIT)
    return Mixer(code, tables, bits, np.full((GATES, HASHED), 0.3, np.float32), np.broadcast_to(steps, (GATES, 34)).astype(np.float32).copy())


def tune(mixer: Mixer, texts: pa.Array, rounds: int = 3) -> None:
    """Starting weights and refinement from a few documents whose contexts are not in the tables."""
    pieces = [(d, o) for _, _, d, o in _pieces(texts)]
    if not sum(len(d) for d, _ in pieces):
        return
    for _ in range(rounds):
        found = [(len(d), mixer.score(d, o, True, 0.02)[0]) for d, o in pieces]
        mixer.weights = (sum(n * w for n, w in found) / sum(n for n, _ in found)).astype(np.float32)
    n = ones = 0
    for d, o in pieces:
        _, a, b = mixer.score(d, o, True)
        n, ones = n + a, ones + b
    _refine(mixer, n, ones)


# ---- tokens


_LETTER = np.random.default_rng(5).integers(0, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each document and its end token, and their numbers."""
    n, d = len(data), len(offsets) - 1
    word = ~_BLANK.take(data)
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    first = offsets[:-1][np.diff(offsets) > 0]
    last = offsets[1:][np.diff(offsets) > 0] - 1
    begins[first], ends[last] = word[first], word[last]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    counts = np.diff(np.searchsorted(begin, offsets))
    power, inverse = _powers(n)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_LETTER.take(data) * power, out=total[1:])
        words = mix64((total[end] - total[begin]) * inverse[begin])
    out = np.full(len(words) + d, _END_TOKEN, np.uint64)
    out[np.arange(len(words)) + np.repeat(np.arange(d), counts)] = words
    return out, counts + 1


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, token, times in training documents) for the distinct tokens of each block."""
    for batch in batches:
        blocks = batch.column("rid").to_numpy() >> BLOCK_SHIFT
        train = ~batch.column("held_out").to_numpy(zero_copy_only=False)
        for lo, hi in _same(blocks):
            seen = []
            part = batch.slice(lo, hi - lo)
            for a, b, data, offsets in _pieces(part.column("_text")):
                words, counts = _tokens(data, offsets)
                code, names = pd.factorize(words)
                seen.append((names, np.bincount(code, weights=np.repeat(train[lo + a : lo + b], counts), minlength=len(names))))
            names = np.concatenate([x for x, _ in seen])
            code, names = pd.factorize(names)
            n = np.bincount(code, weights=np.concatenate([x for _, x in seen]), minlength=len(names)).astype(np.int64)
            for at in range(0, len(names), 100_000):
                own = names[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), blocks[lo])), pa.array(own.view(np.int64)), pa.array(n[at : at + 100_000])], ["block", "token", "n"])


def _same(x: np.ndarray) -> list[tuple[int, int]]:
    edges = np.concatenate(([0], np.flatnonzero(np.diff(x)) + 1, [len(x)])) if len(x) else np.zeros(1, int)
    return list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"


def score_documents(df: DataFrame, text: str = "text", doc_id: str = "doc_id", folds: int = 7, held: int = 2, max_bits: int = 22) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    Rows whose crc32(doc_id as text) mod ``folds`` is ``held`` are held out: nothing is learned from them. A null doc_id is
    not held out. A null text counts as empty; it has one token, the end. Rows that repeat count as often as they occur.
    Scores are base-10 logarithms of probabilities; bits_per_byte counts the end symbol's bits, and is null for empty texts.
    Without training documents every count is zero and the base score is 0. Tokens are told apart by 64-bit hashes. Context
    tables have one cell for every four bytes of training text, up to 2**max_bits cells for each predictor (hashed contexts
    share cells beyond that; all documents are counted at every size). Other columns are not read.
    """
    spark = df.sparkSession
    ship_package(spark)
    crc = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    rows = stable_row_id(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")))
    rows = rows.withColumn("held_out", F.coalesce(crc == held, F.lit(False)))
    train = rows.filter("not held_out")

    size = int(train.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0])
    bits = min(max_bits, max(16, (size // 4).bit_length()))
    pairs = np.zeros(256 * SYMBOLS, np.int64)
    for r in _summed(train.select("_text").mapInArrow(_count_pairs, _SEGMENT)).collect():  # at most 256 * 257 cells
        pairs[r["at"] : r["at"] + r["n"]] = _open(r["body"], r["n"])
    code = build_code(pairs.reshape(256, SYMBOLS))
    sent_code = spark.sparkContext.broadcast(code)

    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id", "rid"), F.lit(2))
    share = max(SAMPLE_SHARE, size // SAMPLE_BYTES) // 2
    sampled = (half == 1) & (F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "rid"), F.lit(share)) == 0) & (F.octet_length("_text") <= SAMPLE_LONGEST)
    # The sample is written by all tasks at once; what is read in one task below is about SAMPLE_BYTES at any size.
    sample = write_out(train.filter(sampled).select("_text"), "sample")
    halves = [train.filter(half == k).select("_text") for k in (0, 1)]

    def counted(texts):
        counts = texts.mapInArrow(lambda b: _count_contexts(b, sent_code, bits), _SEGMENT)
        return write_out(counts.groupBy("sub", "name", "at").applyInArrow(_sum_segments, _SEGMENT), "counts")

    # Weights are fitted on texts that the tables don't know yet; the scores use tables of all training documents.
    counts = [counted(texts) for texts in halves]
    mixer = _fresh_mixer(code, _tables(counts[0], bits), bits)
    sent = spark.sparkContext.broadcast(mixer)

    def fit(batches):
        own = sent.value
        texts = [b.column("_text") for b in batches]
        if texts:
            tune(own, pa.chunked_array(texts).combine_chunks())
        yield pa.RecordBatch.from_pydict({"weights": [own.weights.tobytes()], "refine": [own.refine.tobytes()]})

    fitted = sample.coalesce(1).mapInArrow(fit, "weights binary, refine binary").first()

    def outcomes_of(texts, sent):
        total = np.zeros(OUTCOMES, np.int64)
        for r in _summed(texts.mapInArrow(lambda b: _count_outcomes(b, sent), _SEGMENT)).toLocalIterator():  # OUTCOMES cells at most
            total[r["at"] : r["at"] + r["n"]] = _open(r["body"], r["n"])
        return total

    outcomes = outcomes_of(halves[1], sent)
    sent.unpersist(True)
    mixer.tables = _tables(counts[1], bits)
    sent = spark.sparkContext.broadcast(mixer)
    outcomes += outcomes_of(halves[0], sent)
    sent.unpersist(True)
    if fitted:
        mixer.weights = np.frombuffer(fitted["weights"], np.float32).reshape(mixer.weights.shape)
        mixer.refine = np.frombuffer(fitted["refine"], np.float32).reshape(mixer.refine.shape)
    solve(mixer, outcomes)
    mixer.tables = _tables(counts[0].union(counts[1]), bits)
    sent = spark.sparkContext.broadcast(mixer)
    discard(sample, *counts)

    asked = rows.select("rid", "held_out", "_text").mapInArrow(_ask, "block long, token long, n long")
    by_token = Window.partitionBy("token")
    answers = asked.withColumn("c", F.sum("n").over(by_token)).withColumn("_first", F.row_number().over(by_token.orderBy("block")) == 1)
    answers = write_out(answers.drop("n"), "answers")
    n_all, n_kinds = answers.filter("_first and c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    floor = float(np.log10(n_all + n_kinds + 1))

    def judge(docs: pa.Table, found: pa.Table) -> pa.Table:
        own = sent.value
        names, at = np.unique(found["token"].to_numpy().view(np.uint64), return_index=True)
        c = found["c"].to_numpy()[at]
        out = []
        for _, _, data, offsets in _pieces(docs["_text"].combine_chunks()):
            words, counts = _tokens(data, offsets)
            kind, which = pd.factorize(words)
            times = c[np.searchsorted(names, which)][kind]
            first = np.cumsum(counts) - counts
            base = np.add.reduceat(np.log10(times + 1.0), first) - counts * floor
            known = np.add.reduceat((times > 0).astype(np.int64), first)
            log2p = own.score(data, offsets)
            out.append((counts, known, base, log2p, np.diff(offsets)))
        counts, known, base, log2p, size = (np.concatenate(x) for x in zip(*out, strict=True))
        per_byte = pa.array(-log2p / np.maximum(size, 1), mask=size == 0)
        return pa.table({
            "doc_id": docs["doc_id"], "held_out": docs["held_out"], "n_tokens": counts, "n_known": known, "train_tokens": np.full(len(counts), n_all, np.int64),
            "base_score": base, "score": log2p * np.log10(2.0), "n_bytes": size, "bits_per_byte": per_byte,
        })

    docs = rows.select("doc_id", "held_out", "_text", F.shiftright("rid", BLOCK_SHIFT).alias("block"))
    return docs.groupBy("block").cogroup(answers.select("block", "token", "c").groupBy("block")).applyInArrow(judge, RESULT)
