"""Removal of repeated byte strings by column-wise construction over many documents at once.

A string of ``width`` bytes is repeated when it starts at a second place anywhere. Column-wise construction takes one symbol
of every string per round, from the last column to the first, and updates the order of the collection (its Burrows-Wheeler
transform) and the common prefixes of neighbours by one sequential pass; where a common prefix has ``width`` bytes, the
string that starts in this column is repeated. It takes as many rounds as the longest string has bytes, so documents of
100,000 bytes can't go in whole. They are first cut so that strings that can be equal are aligned and short:

1. Each window of ``width`` bytes belongs to the k-gram in it with the smallest hash (the leftmost, on ties). Equal windows
   have the same anchor at the same distance. Successive windows with one anchor make a span of at most 2 * width bytes.
2. Spans whose anchor occurs once can't hold a repeat. Spans that are equal as a whole are repeats as a whole.
3. What is left - different spans with one anchor - is laid out in columns, aligned at the anchor, and goes through the
   rounds. Suffixes of different columns need no comparison, so a round sorts the symbols of one column only.

The stages are handed on in written tables, read in sequence. Spans with one anchor go to one task together, up to
``most_spans``; anchors with more spans (a passage that very many documents continue in different ways) are taken apart to
single windows, which Spark counts by key with map-side combine. Both ways give the same exact answer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetloom.llm.common import bytes_of, discard, mix64, write_out

GRAM = 32
CHUNK = 8 << 20  # bytes looked at in one go
_POS = np.uint64((1 << 24) - 1)
_LETTER = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def gram_hashes(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Hash of the ``size`` bytes (a power of two) that start at each position."""
    h, step = _LETTER[data], 1
    factor = np.uint64(0x9E3779B97F4A7C15)
    while step < size:
        with np.errstate(over="ignore"):
            h = h[: len(h) - step] * factor + h[step:]
            factor = factor * factor + np.uint64(2 * step)
        step *= 2
    return mix64(h)


def _sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    step, m = 1, x
    while step * 2 <= size:
        m = np.minimum(m[: len(m) - step], m[step:])
        step *= 2
    rest = size - step
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def spans(data: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Spans of windows with one anchor: start, number of windows, distance of the anchor, its hash. ``ends``: of documents."""
    n = len(data)
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    if n < width:
        return none
    g = gram_hashes(data)
    low = _sliding_min((g & ~_POS) | np.arange(len(g), dtype=np.uint64), width - GRAM + 1)
    anchor = (low & _POS).astype(np.int64)
    begins = np.concatenate(([0], ends[:-1]))
    last = ends - width  # last start of a window, by document
    mark = np.zeros(n + 1, np.int8)
    fit = last >= begins
    mark[begins[fit]] += 1
    np.add.at(mark, last[fit] + 1, -1)
    valid = np.cumsum(mark)[: len(anchor)] > 0
    first = np.zeros(len(anchor), bool)
    first[1:] = anchor[1:] != anchor[:-1]
    first[begins[fit]] = True
    start = np.flatnonzero(first & valid)
    if not len(start):
        return none
    stop = np.zeros(len(anchor) + 1, bool)
    stop[1:-1] = (first[1:] | ~valid[1:]) & valid[:-1]
    stop[-1] = valid[-1]
    end = np.flatnonzero(stop)
    return start, end - start, anchor[start] - start, g[anchor[start]]


_SPAN = "t1 long, t2 long, doc_id long, s long, n int, off int, g long, d long"


def _find(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    def pieces(offsets):
        """(row, from, to) of at most CHUNK bytes; longer texts are cut so that each window lies in one piece."""
        for r, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            if b - a >= width:
                for x in range(a, b - width + 1, CHUNK):
                    yield r, x, min(b, x + CHUNK + width - 1)

    def grouped(offsets):
        now, size = [], 0
        for p in pieces(offsets):
            if now and size + p[2] - p[1] > CHUNK + width:
                yield now
                now, size = [], 0
            now.append(p)
            size += p[2] - p[1]
        if now:
            yield now

    for batch in batches:
        data, offsets = bytes_of(batch.column("_text"))
        keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("t1", "t2", "doc_id")]
        for group in grouped(offsets):
            rows, lo, hi = (np.array(x, np.int64) for x in zip(*group, strict=True))
            part = np.concatenate([data[a:b] for a, b in zip(lo, hi, strict=True)])
            ends = np.cumsum(hi - lo)
            start, n, off, g = spans(part, ends, width)
            if not len(start):
                continue
            view = memoryview(part)
            digest = xxhash.xxh3_64_intdigest
            d = np.fromiter((digest(view[a : a + k + width - 1], o * 1024 + k) for a, k, o in zip(start.tolist(), n.tolist(), off.tolist(), strict=True)), np.uint64, len(start))
            piece = np.searchsorted(ends, start, side="right")
            row = rows[piece]
            inside = start - (ends - (hi - lo))[piece] + (lo - offsets[rows])[piece]
            yield pa.RecordBatch.from_arrays(
                [pa.array(k[row]) for k in keys] + [pa.array(inside), pa.array(n.astype(np.int32)), pa.array(off.astype(np.int32)), pa.array(g.view(np.int64)), pa.array(d.view(np.int64))],
                ["t1", "t2", "doc_id", "s", "n", "off", "g", "d"],
            )


_CUT = "t1 long, t2 long, s long, n int, off int, g long, d long, single boolean, hot boolean, body binary"


def _cut(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the spans that each text is asked for."""
    names = [x.split()[0] for x in _CUT.split(", ")]
    for batch in batches:
        for t1, t2, text, asked in zip(*[batch.column(c) for c in ("t1", "t2", "_text", "asked")], strict=True):
            data, asked = text.as_buffer(), asked.as_py()
            view = memoryview(data)
            rows = {k: [x[k] for x in asked] for k in ("s", "n", "off", "g", "d", "single", "hot")}
            m = len(asked)
            yield pa.RecordBatch.from_arrays([
                pa.array([t1.as_py()] * m, pa.int64()), pa.array([t2.as_py()] * m, pa.int64()), pa.array(rows["s"], pa.int64()), pa.array(rows["n"], pa.int32()),
                pa.array(rows["off"], pa.int32()), pa.array(rows["g"], pa.int64()), pa.array(rows["d"], pa.int64()), pa.array(rows["single"], pa.bool_()), pa.array(rows["hot"], pa.bool_()),
                pa.array([bytes(view[s : s + n + width - 1]) for s, n in zip(rows["s"], rows["n"], strict=True)], pa.binary()),
            ], names)


def repeated_starts(group: np.ndarray, off: np.ndarray, data: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """For strings aligned at their anchor, which starts (column 0: ``width - GRAM`` before the anchor) are repeated.

    Strings are sorted by ``group``. Each round takes the symbols of one column, from the right: a stable sort by symbol
    turns the order of the suffixes one column to the right into the order of this column, and the common prefix of two new
    neighbours is one more than the smallest one between their old places.
    """
    n, left = len(group), width - GRAM
    size = np.diff(np.concatenate(([0], ends)))
    lo = left - off  # first column of each string
    hi = lo + size
    shown = np.full((left + width, n), 256, np.int16)  # 256: no symbol here
    row = np.repeat(np.arange(n), size)
    column = np.arange(int(ends[-1])) - np.repeat(ends - size, size) + np.repeat(lo, size)
    shown[column, row] = data
    out = np.zeros((left + 1, n), bool)
    order = np.arange(n)
    common = np.zeros(n + 1, np.int64)  # common[i]: prefix that order[i - 1] and order[i] share; the last entry is a guard
    base = group.astype(np.int64) * 512
    for j in range(left + width - 1, -1, -1):
        symbol = shown[j, order]
        key = base + symbol  # the group never changes place, as strings of a group stay together
        place = np.argsort(key, kind="stable")
        sorted_key = key[place]
        same = (sorted_key[1:] == sorted_key[:-1]) & (symbol[place[1:]] != 256)
        fresh = np.zeros(n + 1, np.int64)
        u, v = place[:-1][same], place[1:][same]
        value = common[v]
        far = np.flatnonzero(v - u > 1)
        if len(far):
            edges = np.stack((u[far] + 1, v[far] + 1), 1).ravel()
            value[far] = np.minimum.reduceat(common, edges)[::2]
        fresh[1:n][same] = np.minimum(value + 1, width)
        common, order = fresh, order[place]
        if j <= left:
            full = common >= width
            out[j, order] = full[:n] | full[1:]
    return out


def _runs(flags: np.ndarray) -> np.ndarray:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edge.reshape(-1, 2)


def _rounds(table: pa.Table, width: int) -> pa.Table:
    """Repeated starts of the single spans of some anchors; all spans of an anchor are here."""
    g, d = table["g"].to_numpy(), table["d"].to_numpy()
    order = np.lexsort((d, g))
    fresh = np.ones(len(g), bool)
    fresh[1:] = (np.diff(g[order]) != 0) | (np.diff(d[order]) != 0)
    table = table.take(pa.array(order[fresh]))
    g, off, s = (table[c].to_numpy() for c in ("g", "off", "s"))
    data, offsets = bytes_of(table["body"])
    _, group = np.unique(g, return_inverse=True)
    found = repeated_starts(group, off.astype(np.int64), data, offsets[1:], width)
    single = np.flatnonzero(table["single"].to_numpy(zero_copy_only=False))
    rows = []
    for i in single[found[:, single].any(0)]:
        for a, b in _runs(found[:, i]):
            first = width - GRAM - off[i]
            rows.append((i, s[i] + a - first, b - a))
    at, start, n = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3
    return pa.table({"t1": table["t1"].to_numpy()[at], "t2": table["t2"].to_numpy()[at], "s": start, "n": n.astype(np.int32)})


def _windows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            view, n = memoryview(r["body"]), r["n"]
            keys = [xxhash.xxh3_128_digest(view[i : i + width]) for i in range(n)]
            yield pa.RecordBatch.from_arrays([
                pa.array([r["g"]] * n, pa.int64()), pa.array([i - r["off"] for i in range(n)], pa.int32()), pa.array(keys, pa.binary()), pa.array([r["d"]] * n, pa.int64()),
                pa.array([r["t1"]] * n, pa.int64()), pa.array([r["t2"]] * n, pa.int64()), pa.array([r["s"] + i for i in range(n)], pa.int64()), pa.array([r["single"]] * n, pa.bool_()),
            ], ["g", "at", "w", "d", "t1", "t2", "s", "single"])


def repeated_spans(docs: DataFrame, width: int, most_spans: int = 4096, spans_per_task: int = 20_000) -> DataFrame:
    """(t1, t2, ranges): for each text, the ranges (s, n) of starts of repeated strings. ``docs``: t1, t2, doc_id, _text."""
    found = write_out(docs.mapInArrow(lambda b: _find(b, width), _SPAN), "spans")
    # Written, so that the join isn't in the aggregate's stage: then Spark broadcasts the anchors or splits a frequent one's spans.
    again = write_out(found.groupBy("g").agg(F.count("*").alias("_c")).filter("_c > 1").select("g"), "again")
    found_again = write_out(found.join(again, "g", "left_semi"), "spans")
    discard(found, again)
    classes = found_again.groupBy("g", "d").agg(F.count("*").alias("c"), F.min(F.struct("t1", "t2", "doc_id", "s", "n", "off")).alias("r"))
    classes = write_out(classes.select("g", "d", "c", "r.*"), "classes")
    counts = write_out(classes.groupBy("g").agg(F.count("*").alias("k")).filter("k > 1"), "counts")
    asked = classes.join(counts, "g").groupBy("t1", "t2", "doc_id").agg(
        F.collect_list(F.struct("s", "n", "off", "g", "d", (F.col("c") == 1).alias("single"), (F.col("k") > most_spans).alias("hot"))).alias("asked")
    )
    bodies = write_out(docs.join(asked, ["t1", "t2", "doc_id"]).select("t1", "t2", "_text", "asked").mapInArrow(lambda b: _cut(b, width), _CUT), "bodies")
    tasks = 1 + bodies.filter("not hot").count() // spans_per_task
    rounds = bodies.filter("not hot").select("t1", "t2", "s", "off", "g", "d", "single", "body", F.pmod(F.xxhash64("g"), F.lit(tasks)).alias("task"))
    partly = rounds.groupBy("task").applyInArrow(lambda t: _rounds(t, width), "t1 long, t2 long, s long, n int")
    single = bodies.filter("hot").dropDuplicates(["g", "d"]).mapInArrow(lambda b: _windows(b, width), "g long, at int, w binary, d long, t1 long, t2 long, s long, single boolean")
    # Per window, one row of each task is enough: how many, and the only one there may be.
    counted = single.groupBy("g", "at", "w").agg(F.count("*").alias("c"))
    hot = single.filter("single").join(counted.filter("c > 1"), ["g", "at", "w"]).select("t1", "t2", "s", F.lit(1).alias("n"))
    whole = found_again.join(classes.filter("c > 1").select("g", "d"), ["g", "d"], "left_semi").select("t1", "t2", "s", "n")
    return whole.union(partly).union(hot).groupBy("t1", "t2").agg(F.collect_set(F.struct("s", "n")).alias("ranges"))


def remove_repeats(df: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 200, **options) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (from, to exclusive, in bytes), kept.

    Every byte that a repeated string of ``width`` bytes covers is removed; strings are judged on the input, texts never join,
    and a string that a document repeats in itself counts. Copies of a text, repeated rows too, repeat each other. A null or
    shorter text keeps all its bytes. doc_id is a whole number or null; other columns are not read.
    """
    if width < 2 * GRAM:
        raise ValueError(f"width must be at least {2 * GRAM}")
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"))
    rows = rows.withColumn("t1", F.xxhash64("_text")).withColumn("t2", F.xxhash64(F.lit("second"), "_text"))
    named = rows.withColumn("doc_id", F.coalesce("doc_id", F.lit(-(1 << 62))))
    ranges = write_out(repeated_spans(named, width, **options), "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text_, found in zip(batch.column("_text"), batch.column("ranges"), strict=True):
                data, found = text_.as_py(), found.as_py() or []
                gone = np.zeros(len(data) + 1, np.int32)
                for r in found:
                    gone[r["s"]] += 1
                    gone[r["s"] + r["n"] + width - 1] -= 1
                cut = _runs(np.cumsum(gone[:-1]) > 0) if found else np.zeros((0, 2), np.int64)
                edges = [0, *cut.ravel().tolist(), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(data), len(data) - len(kept), len(cut), hashlib.sha256(kept).hexdigest(), [{"from": int(a), "to": int(b)} for a, b in cut], kept))
            cols = list(zip(*out, strict=True)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string()),
                pa.array(cols[4], pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), pa.array(cols[5], pa.binary()),
            ], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    joined = rows.join(ranges, ["t1", "t2"], "left").select("doc_id", "_text", "ranges")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<from:long,to:long>>, kept binary")
