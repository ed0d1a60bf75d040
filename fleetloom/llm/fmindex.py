"""Benchmark decontamination with an FM-index for each shard of documents.

A shard is one Arrow batch of whole documents. Only runs of words that some benchmark window uses are indexed - no window
can lie outside them - so the index is small. Windows are looked up by backward search with ranks from a wavelet matrix over
the Burrows-Wheeler transform; occurrences are located by walking to the next sampled suffix position; hits of all windows
are merged to spans. Documents are not shuffled. The benchmark is the query set: it is handed out in blocks of bounded size,
and each task holds one block and one shard at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetloom.llm.common import bytes_of
from fleetloom.session import ship_package

SAMPLE = 16  # every so many text positions keep their place in the suffix order
# Word bytes are digits, letters and everything beyond ASCII; A-Z become a-z, the rest separates.
_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def split_words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Windows:
    """A block of benchmark windows: distinct word sequences and the items they come from."""

    def __init__(self, items: list[tuple[str, bytes]], width: int):
        self.ids = {}
        found: dict[tuple, set] = {}
        for item, text in items:
            w = [self.ids.setdefault(x, len(self.ids) + 1) for x in split_words(text)]
            for i in range(max(1, len(w) - width + 1) if w else 0):
                found.setdefault(tuple(w[i : i + width]), set()).add(item)
        self.items = sorted({x for s in found.values() for x in s})
        place = {x: i for i, x in enumerate(self.items)}
        self.length = np.array([len(w) for w in found], np.int64)
        self.words = np.zeros((len(found), width), np.int64)
        for i, w in enumerate(found):
            self.words[i, : len(w)] = w
        self.item_of = np.array([place[x] for s in found.values() for x in sorted(s)], np.int64)
        self.item_from = np.concatenate(([0], np.cumsum([len(s) for s in found.values()]))).astype(np.int64)
        self.bits = max(1, len(self.ids).bit_length())
        self.shortest = int(self.length.min()) if len(found) else 0


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by prefix doubling; each separator (0) counts as a letter of its own, so no tie is left."""
    n = len(text)
    zero = text == 0
    rank = np.where(zero, np.cumsum(zero) - 1, text + n)
    _, rank = np.unique(rank, return_inverse=True)
    k = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        step = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        rank[order] = step
        k *= 2
        if step[-1] == n - 1 or k >= 2 * n:
            return order


class FMIndex:
    """Index over word ids >= 1 with separators 0; must begin with a separator."""

    def __init__(self, text: np.ndarray, bits: int):
        order = suffix_order(text)
        n = len(text)
        bwt = text[order - 1]
        self.first = np.zeros((1 << bits) + 2, np.int64)
        self.first[1:] = np.cumsum(np.bincount(text, minlength=(1 << bits) + 1))
        self.bits, self.ones, self.zeros, self.level = bits, [], [], []
        at = bwt
        for b in range(bits - 1, -1, -1):
            bit = ((at >> b) & 1).astype(np.int8)
            self.level.append(bit)
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int64))))
            self.zeros.append(int(n - self.ones[-1][-1]))
            at = np.concatenate((at[bit == 0], at[bit == 1]))
        # Sampled: every SAMPLE-th position, and those after a separator, so that a walk never crosses one.
        keep = (np.arange(n) % SAMPLE == 0) | (text[np.arange(n) - 1] == 0)
        self.marked = keep[order]
        self.before = np.concatenate(([0], np.cumsum(self.marked)))
        self.sampled = order[self.marked]
        self.n = n

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs among the first i letters of the transform."""
        start = np.zeros_like(i)
        for d in range(self.bits):
            one = (symbol >> (self.bits - 1 - d)) & 1 == 1
            ones, zeros = self.ones[d], self.zeros[d]
            i = np.where(one, zeros + ones[i], i - ones[i])
            start = np.where(one, zeros + ones[start], start - ones[start])
        return i - start

    def back(self, row: np.ndarray) -> np.ndarray:
        """The row of the suffix one position to the left."""
        symbol, i, start = np.zeros_like(row), row, np.zeros_like(row)
        for d in range(self.bits):
            bit = self.level[d][i].astype(np.int64)
            ones, zeros = self.ones[d], self.zeros[d]
            i = np.where(bit == 1, zeros + ones[i], i - ones[i])
            start = np.where(bit == 1, zeros + ones[start], start - ones[start])
            symbol = symbol * 2 + bit
        return self.first[symbol] + i - start

    def search(self, words: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows lo..hi of all suffixes that begin with each pattern."""
        lo, hi = np.zeros(len(words), np.int64), np.full(len(words), self.n, np.int64)
        alive = np.arange(len(words))
        for step in range(words.shape[1]):
            alive = alive[(length[alive] <= step) | (hi[alive] > lo[alive])]
            now = alive[length[alive] > step]
            if not len(now):
                break
            symbol = words[now, length[now] - 1 - step]
            lo[now] = self.first[symbol] + self.rank(symbol, lo[now])
            hi[now] = self.first[symbol] + self.rank(symbol, hi[now])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows."""
        out, open_, walked = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        while len(open_):
            ready = self.marked[rows]
            out[open_[ready]] = self.sampled[self.before[rows[ready]]] + walked
            open_, rows = open_[~ready], self.back(rows[~ready])
            walked += 1
        return out


def _shard_hits(docs: list[list[bytes]], first_word: np.ndarray, block: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(window, word position in the shard) of every occurrence in the shard."""
    none = np.zeros(0, np.int64)
    if not len(block.length):
        return none, none
    get = block.ids.get
    ids = np.fromiter((get(w, 0) for d in docs for w in [*d, b""]), np.int64, int(first_word[-1]) + len(docs))
    # A zero ends each document; a word outside the benchmark is zero too.
    edge = np.flatnonzero(np.diff(np.concatenate(([0], (ids != 0).astype(np.int8), [0]))))
    begin, end = edge[::2], edge[1::2]
    long = end - begin >= block.shortest
    begin, end = begin[long], end[long]
    if not len(begin):
        return none, none
    size = end - begin
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    source = np.repeat(begin, size) + inside
    place = inside + np.repeat(np.cumsum(size) - size + np.arange(1, len(size) + 1), size)
    text = np.zeros(int(size.sum()) + len(size) + 1, np.int64)
    text[place] = ids[source]
    back = np.zeros(len(text), np.int64)
    back[place] = source
    index = FMIndex(text, block.bits)
    lo, hi = index.search(block.words, block.length)
    count = np.maximum(hi - lo, 0)
    window = np.repeat(np.arange(len(lo)), count)
    rows = np.repeat(lo, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    at = back[index.locate(rows)]
    # Each document before a position has one end mark, which is no word.
    doc = np.searchsorted(first_word[1:] + np.arange(1, len(docs) + 1), at, side="right")
    return window, at - doc


def _judge(texts: list[bytes], blocks) -> list[tuple]:
    docs = [split_words(t) for t in texts]
    counts = np.array([len(d) for d in docs], np.int64)
    first_word = np.concatenate(([0], np.cumsum(counts)))
    cover = np.zeros(int(first_word[-1]) + 1, np.int64)
    items: list[set] = [set() for _ in docs]
    for handle in blocks:
        block = handle.value
        window, at = _shard_hits(docs, first_word, block)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + block.length[window], -1)
        doc = np.searchsorted(first_word[1:], at, side="right")
        for w, d in np.unique(np.stack((window, doc), 1), axis=0) if len(at) else ():
            items[d].update(block.items[i] for i in block.item_of[block.item_from[w] : block.item_from[w + 1]])
    # A window never leaves its document, so coverage is back at zero at each document's end.
    hit = np.cumsum(cover[:-1]) > 0
    out = []
    for d, (a, b) in enumerate(zip(first_word[:-1], first_word[1:], strict=True)):
        own = hit[a:b]
        n = int(own.sum())
        edges = np.flatnonzero(np.diff(np.concatenate(([0], own.astype(np.int8), [0])))) if n else np.zeros(0, np.int64)
        spans = [{"from": int(x), "to": int(y)} for x, y in edges.reshape(-1, 2)]
        out.append((int(b - a), n, sorted(items[d]), spans, n > 0 and 20 * n >= b - a))
    return out


def _blocks(spark, bench: DataFrame, text: str, item_id: str, width: int, block_bytes: int) -> list:
    """The benchmark as broadcast blocks of at most ``block_bytes`` of text (an item is not cut); one at a time passes the driver."""
    out, now, size = [], [], 0
    rows = bench.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")), F.coalesce(text, F.lit("")).cast("binary"))
    for item, body in rows.toLocalIterator():
        now.append((item, bytes(body)))
        size += len(body)
        if size >= block_bytes:
            out.append(spark.sparkContext.broadcast(Windows(now, width)))
            now, size = [], 0
    if now:
        out.append(spark.sparkContext.broadcast(Windows(now, width)))
    return out


REPORT = "n_words long, n_hit long, items array<string>, spans array<struct<from:long,to:long>>, contaminated boolean"


def contamination(
    df: DataFrame, bench: DataFrame, text: str = "text", doc_id: str = "doc_id", bench_text: str = "text", item_id: str = "item_id",
    width: int = 13, block_bytes: int = 4 << 20,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items (sorted), spans of hit words (to is exclusive), contaminated.

    A window is ``width`` words of an item; an item of fewer words, but not none, is one window. A document is contaminated
    when n_hit > 0 and 20 * n_hit >= n_words. A null or empty text has no words and no hits; a null item_id is called "null";
    items with the same id count once; an empty benchmark hits nothing. Other columns are not read.
    """
    spark = df.sparkSession
    ship_package(spark)
    blocks = _blocks(spark, bench, bench_text, item_id, width, block_bytes)
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    kind = T.StructType([rows.schema["doc_id"], *T._parse_datatype_string(REPORT).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bytes_of(batch.column("_text"))
            found = _judge([data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], blocks)
            n_words, n_hit, items, spans, bad = zip(*found, strict=True) if found else ((),) * 5
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())),
                pa.array(spans, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), pa.array(bad, pa.bool_()),
            ], ["doc_id", "n_words", "n_hit", "items", "spans", "contaminated"])

    return rows.mapInArrow(run, kind)


def drop_contaminated(df: DataFrame, bench: DataFrame, text: str = "text", bench_text: str = "text", item_id: str = "item_id", width: int = 13, block_bytes: int = 4 << 20) -> DataFrame:
    """The documents that ``contamination`` doesn't call contaminated, with all their columns, in the same single pass."""
    spark = df.sparkSession
    ship_package(spark)
    blocks = _blocks(spark, bench, bench_text, item_id, width, block_bytes)
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bytes_of(batch.column(place))
            found = _judge([data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], blocks)
            yield batch.filter(pa.array([not x[4] for x in found], pa.bool_()))

    return df.mapInArrow(run, df.schema)
