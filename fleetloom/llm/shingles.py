"""Near duplicates by Order MinHash over five-word shingles, verified by shingle similarity and banded alignment.

For each of ``sketches`` hash functions a document keeps the ``keep`` shingles with the smallest hashes, each shingle labelled
with its number of occurrence, in the order of the text. Documents that agree in one sketch are candidates: the sketch agrees
more often, the more shingles they share in the same order. A candidate pair is linked when the sets of their shingles have a
Jaccard similarity of ``similarity`` or more and so has the edit similarity of their words, 1 - edits / longer length, found
by an alignment in a band that is as wide as the allowed edits. Classes are the connected components of the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetloom.llm.common import asked, bytes_of, components, discard, free_name, is_asked, lower_ascii, mix64, replayable, stable_row_id, write_out
from fleetloom.session import ship_package

SHINGLE, SKETCHES, KEEP = 5, 10, 2
BLOCK = 256  # members of a bucket in one block; two blocks meet in one task
SLOTS = 128  # bytes of the print of a document's shingle set
MARGIN = 0.18  # a pair is looked at in full if its prints are at most this much less alike than asked for
_POWER = np.uint64(0x9E3779B97F4A7C15)
_POWER_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LETTER = np.random.default_rng(5).integers(0, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word (run of anything but blanks), and the number of words of each row."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    word = ~_BLANK[data]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    firsts = offsets[:-1][offsets[:-1] < n]
    begin[firsts] = word[firsts]
    start = np.flatnonzero(begin)
    close = np.ones(n + 1, bool)
    close[:n] = ~word | begin
    # A word ends at the next blank or the next word's begin.
    stops = np.flatnonzero(close)
    end = stops[np.searchsorted(stops, start, side="right")]
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_LETTER[data] * _powers(_POWER, n), dtype=np.uint64)))
        h = mix64((total[end] - total[start]) * _powers(_POWER_INVERSE, n)[start])
    counts = np.searchsorted(start, offsets[1:], side="left") - np.searchsorted(start, offsets[:-1], side="left")
    return h, counts


def shingle_hashes(words: np.ndarray, counts: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``k`` words inside each row; a row of fewer words, but not none, has one shingle of all of them."""
    n = len(words)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for i in range(k):
            h[: n - i] = h[: n - i] * _POWER + words[i:]
    first = np.cumsum(counts) - counts
    number = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    at = np.arange(int(number.sum())) - np.repeat(np.cumsum(number) - number, number) + np.repeat(first, number)
    out = h[at]
    for r in np.flatnonzero((counts > 0) & (counts < k)):
        value = np.uint64(counts[r])
        with np.errstate(over="ignore"):
            for w in words[first[r] : first[r] + counts[r]]:
                value = value * _POWER + w
        out[int(number[:r].sum())] = value
    return mix64(out), number


def order_sketches(shingles: np.ndarray, number: np.ndarray, sketches: int = SKETCHES, keep: int = KEEP) -> np.ndarray:
    """(rows x sketches) hashes of the kept shingles in the order of the text; rows without shingles have zeros."""
    rows = np.flatnonzero(number)
    out = np.zeros((len(number), sketches), np.uint64)
    if not len(rows):
        return out
    size = number[rows]
    first = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(rows)), size)
    # Number of occurrence of a shingle in its row.
    order = np.lexsort((np.arange(len(shingles)), shingles, owner))
    s, o = shingles[order], owner[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (o[1:] != o[:-1])
    run = np.flatnonzero(new)
    label = np.empty(len(s), np.uint64)
    label[order] = np.arange(len(s)) - np.repeat(run, np.diff(np.concatenate((run, [len(s)]))))
    with np.errstate(over="ignore"):
        labelled = mix64(shingles + label * np.uint64(0xD6E8FEB86659FD93))
        for j in range(sketches):
            v = mix64(labelled ^ np.uint64((j + 1) * 0x2545F4914F6CDD1D % (1 << 64)))
            picked = []
            for _ in range(keep):
                low = np.minimum.reduceat(v, first)
                place = np.flatnonzero(v == low[owner])
                _, at = np.unique(owner[place], return_index=True)
                picked.append(place[at])
                v[place[at]] = np.iinfo(np.uint64).max
            # Rows with fewer shingles than ``keep`` pick one again, which their equals do too.
            h = np.full(len(rows), j + 1, np.uint64)
            for place in np.sort(np.stack(picked), 0):
                h = mix64(h * _POWER + labelled[place])
            out[rows, j] = h
    return out


def set_prints(shingles: np.ndarray, number: np.ndarray) -> np.ndarray:
    """(rows x SLOTS) bytes: the smallest hash in each slot, cut to 1..255; 0 where a slot has none."""
    owner = np.repeat(np.arange(len(number)), number)
    mixed = mix64(shingles ^ np.uint64(0x1F83D9ABFB41BD6B))
    low = np.full(len(number) * SLOTS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(low, owner * SLOTS + (mixed % np.uint64(SLOTS)).astype(np.int64), mixed // np.uint64(SLOTS))
    out = (low % np.uint64(255)).astype(np.uint8) + np.uint8(1)
    out[low == np.iinfo(np.uint64).max] = 0
    return out.reshape(-1, SLOTS)


def has_likeness(prints: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray, least: float) -> np.ndarray:
    """Rows of which a row on the other side has a print at least so much alike. Sizes that differ too much rule a pair out."""
    out = np.zeros(len(n), bool)
    own = np.flatnonzero(left | right)
    for i in np.flatnonzero(left):
        others = own[right[own] & (own != i)]
        if left is not right:
            others = others[~left[others]]
        both, some = prints[others], prints[i]
        filled = (both != 0) | (some != 0)
        alike = ((both == some) & filled).sum(1) / np.maximum(1, filled.sum(1))
        good = others[(alike >= least) & (np.minimum(n[others], n[i]) >= least * np.maximum(n[others], n[i]))]
        out[good] = True
        out[i] |= len(good) > 0
    return out


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edits (insert, delete, replace) from a to b, or ``most`` + 1 if it takes more.

    Follows, for 0, 1, 2, ... edits, how far each diagonal of the band -most..most gets.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1

    def slide(i, j):
        while i < n and j < m:
            step = min(64, n - i, m - j)
            differ = np.flatnonzero(a[i : i + step] != b[j : j + step])
            if len(differ):
                return i + int(differ[0])
            i, j = i + step, j + step
        return i

    reach = {0: slide(0, 0)}
    for edits in range(most + 1):
        if edits:
            nxt = {}
            for d in range(-edits, edits + 1):  # j - i
                i = max(reach.get(d, -2) + 1, reach.get(d - 1, -2), reach.get(d + 1, -2) + 1)
                i = min(i, n, m - d)
                if i >= 0 and i + d >= 0:
                    nxt[d] = slide(i, i + d)
            reach = nxt
        if reach.get(m - n, -1) >= n:
            return edits
    return most + 1


def linked(words_a: np.ndarray, words_b: np.ndarray, similarity: float) -> bool:
    longer = max(len(words_a), len(words_b))
    most = int((1 - similarity) * longer + 1e-9)
    return edit_distance(words_a, words_b, most) <= most


def _forest(texts: list[bytes], ids: list[bytes], left: np.ndarray, right: np.ndarray, similarity: float) -> list[tuple[bytes, bytes]]:
    """Links between rows of ``left`` and rows of ``right`` (masks); of links that join no new classes, none is kept."""
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    words, counts = word_hashes(np.frombuffer(b"".join(texts), np.uint8), offsets)
    shingles, number = shingle_hashes(words, counts)
    first = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(texts)), number)
    # Distinct shingles per row, coded 0.. over the rows at hand.
    values, code = np.unique(shingles, return_inverse=True)
    pairs = np.unique(owner * len(values) + code) if len(values) else np.zeros(0, np.int64)
    owner, code = pairs // max(1, len(values)), pairs % max(1, len(values))
    size = np.bincount(owner, minlength=len(texts))
    begin = np.cumsum(size) - size
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    inside = np.zeros(len(values) + 1, np.int64)
    out = []
    for i in np.flatnonzero(left):
        if not size[i]:
            continue
        own = code[begin[i] : begin[i] + size[i]]
        inside[own] = 1
        shared = np.bincount(owner, weights=inside[code], minlength=len(texts))
        inside[own] = 0
        good = right & (shared >= similarity * (size[i] + size - shared) - 1e-9) & (size > 0)
        if left is right:
            good = good & (np.arange(len(texts)) > i)
        for j in np.flatnonzero(good):
            a, b = root(i), root(j)
            if a != b and linked(words[first[i] : first[i] + counts[i]], words[first[j] : first[j] + counts[j]], similarity):
                parent[b] = a
                out.append((ids[i], ids[j]))
    return out


def _meetings(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of each pair of blocks (j, h, p, q) in a task, and which of them are on either side."""
    keys = [table[c].to_numpy() for c in ("j", "h", "p", "q")]
    order = np.lexsort(keys[::-1])
    change = np.zeros(max(0, len(order) - 1), bool)
    for k in keys:
        change |= np.diff(k[order]) != 0
    own, p, q = (table[c].to_numpy() for c in ("own", "p", "q"))
    for rows in np.split(order, np.flatnonzero(change) + 1):
        if len(rows) > 1:
            left = own[rows] == p[rows[0]]
            yield rows, left, left if p[rows[0]] == q[rows[0]] else own[rows] == q[rows[0]]


def _promising(table: pa.Table, least: float) -> pa.Table:
    """Members of a bucket whose print is like another member's; only their texts are fetched."""
    prints = np.frombuffer(b"".join(table["print"].to_pylist()), np.uint8).reshape(-1, SLOTS)
    n = table["n"].to_numpy()
    keep = np.zeros(len(n), bool)
    for rows, left, right in _meetings(table):
        keep[rows] = has_likeness(prints[rows], n[rows], left, right, least)
    return table.select(["rid", "j", "h", "own", "p", "q"]).filter(pa.array(keep))


def _verify(table: pa.Table, similarity: float) -> pa.Table:
    """Links of all block pairs of one task; rows: bucket, p, q (blocks), own (the row's block), id, body."""
    links = []
    ids, bodies = table["id"], table["body"]
    for rows, left, right in _meetings(table):
        links += _forest([bodies[int(r)].as_py() for r in rows], [ids[int(r)].as_py() for r in rows], left, right, similarity)
    a, b = zip(*links, strict=True) if links else ((), ())
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def _sketch(batches: Iterator[pa.RecordBatch], sketches: int, keep: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = bytes_of(batch.column("body"))
        # In pieces, so that the work arrays stay small beside the batch.
        cuts = [0]
        for r in range(1, len(offsets)):
            if r == len(offsets) - 1 or offsets[r + 1] - offsets[cuts[-1]] > 4 << 20:
                cuts.append(r)
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            words, counts = word_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            shingles, number = shingle_hashes(words, counts)
            found = order_sketches(shingles, number, sketches, keep)
            prints = pa.array([x.tobytes() for x in set_prints(shingles, number)], pa.binary())
            flat = pa.array(found.view(np.int64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * sketches), flat)
            part = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([part.column("rid"), part.column("doc_id"), part.column("id"), pa.array(number), lists, prints], ["rid", "doc_id", "id", "n", "sketch", "print"])


def near_duplicates(
    df: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = 0.8, sketches: int = SKETCHES, keep: int = KEEP, rows_per_task: int = 4000,
) -> DataFrame:
    """One row per row of ``df``: rid, doc_id, class_id (the smallest doc_id of the class), class_size, kept (that row stays).

    Texts are compared after lower-casing A-Z, as words between blanks. Texts with equal words are one class without any
    comparison; texts without words are one class of their own. Of rows that repeat the smallest doc_id one is kept; a null
    doc_id is smaller than others only if the class has no other. An empty table gives no rows.

    A bucket is the documents with one sketch. Members whose set of shingles is clearly like no other's there are set aside by
    a short print of the set (128 slots, five standard deviations of margin) before texts are fetched. Equal texts enter once; a bucket with the same members as another is looked at
    once; a large one is cut into blocks that meet pairwise in different tasks, and only links that join classes leave a task.
    Time for a bucket grows with the square of its different texts: links between them can't be had for less without loss.
    """
    spark = df.sparkSession
    ship_package(spark)
    rows = stable_row_id(df.select(F.col(doc_id).cast("long").alias("doc_id"), lower_ascii(F.coalesce(F.col(text), F.lit(""))).alias("body")))
    # The id is of the words alone; two SHA-256 halves would be no safer than its first 16 bytes.
    words = F.trim(F.regexp_replace("body", r"[\x20\x09-\x0D]+", " "))
    named = lambda rows: rows.select("rid", "doc_id", words.alias("body")).withColumn("id", F.substring(F.unhex(F.sha2("body", 256)), 1, 16))
    sketched = write_out(named(rows).mapInArrow(lambda b: _sketch(b, sketches, keep), "rid long, doc_id long, id binary, n long, sketch array<long>, print binary"), "sketches")
    texts = sketched.groupBy("id").agg(F.min("rid").alias("rid"), F.max("sketch").alias("sketch"), F.max("n").alias("n"), F.max("print").alias("print"))
    texts = write_out(texts, "texts")
    buckets = texts.filter("n > 0").select("id", "rid", "n", "print", F.posexplode("sketch").alias("j", "h"))
    shared = buckets.groupBy("j", "h").agg(F.count("*").alias("m"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("sign")).filter("m > 1")
    shared = write_out(shared.groupBy("m", "sign").agg(F.min(F.struct("j", "h")).alias("b")).select("b.*", "m"), "buckets")
    blocks = F.expr(f"cast((m + {BLOCK - 1}) div {BLOCK} as int)")
    members = buckets.join(shared, ["j", "h"]).withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    members = members.select("rid", "n", "print", "j", "h", "own", F.explode(F.expr("transform(sequence(0, blocks - 1), x -> struct(least(x, own) as p, greatest(x, own) as q))")).alias("at"))
    members = members.select("rid", "n", "print", "j", "h", "own", "at.p", "at.q")
    n_texts = texts.count() * sketches
    task = lambda rows: F.pmod(F.xxhash64("j", "h", "p", "q"), F.lit(1 + rows // rows_per_task)).alias("task")
    likely = members.select("*", task(n_texts)).groupBy("task").applyInArrow(lambda t: _promising(t, similarity - MARGIN), "rid long, j int, h long, own int, p int, q int")
    members = write_out(likely, "members")
    task = task(members.count())
    meetings = members.groupBy("rid").agg(F.collect_list(F.struct("j", "h", "own", "p", "q")).alias("asked"))
    # Texts that meet no other stay where they are.
    number = F.xxhash64("rid").alias("short")
    bitmap = asked(members.select(number))
    likely = rows.select("rid", "doc_id", "body", number)
    likely = likely.mapInArrow(lambda batches: (b.filter(pa.array(is_asked(bitmap.value, b["short"].to_numpy()))) for b in batches), likely.schema)
    # Merged at every size: the list grows with the input, and texts then travel the same way everywhere.
    sent = named(likely).join(meetings.hint("merge"), "rid").select("id", "body", F.explode("asked").alias("x")).select("id", F.col("body").cast("binary").alias("body"), "x.*")
    links = sent.select("*", task).groupBy("task").applyInArrow(lambda t: _verify(t, similarity), "a binary, b binary")
    links = write_out(links, "links")
    discard(members, shared)
    roots = components(links)
    named = sketched.select("rid", "doc_id", "id").join(roots, F.col("id") == F.col("node"), "left").select("rid", "doc_id", F.coalesce("root", "id").alias("class"))
    named = write_out(named, "classes")
    top = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "rid")).alias("top")
    classes = write_out(named.groupBy("class").agg(top, F.count("*").alias("class_size")), "class")
    return named.join(classes, "class").select(
        "rid", "doc_id", F.col("top.doc_id").alias("class_id"), "class_size", (F.col("rid") == F.col("top.rid")).alias("kept"),
    )


def keep_one(df: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``df`` that ``near_duplicates`` keeps, with all their columns."""
    df, rid = replayable(df), free_name(df, "_rid")
    kept = near_duplicates(df, text, doc_id, **options).filter("kept").select(F.col("rid").alias(rid))
    return stable_row_id(df, rid).join(kept, rid).select(*[F.col(f"`{c}`") for c in df.columns])
