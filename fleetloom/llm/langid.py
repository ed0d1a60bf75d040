"""Language of a text by string kernels: presence of byte n-grams, Nyström landmarks, one-versus-rest ridge regression.

The blended spectrum of a text is the set of its byte n-grams of the lengths 1 to ``SPAN``, after lower-casing A-Z; the kernel
of two texts is the number of n-grams they share over the root of the product of their numbers. Landmarks are some of the training
texts. The kernels between rows and landmarks are the Nyström features: with W the kernels among landmarks, features
times the inverse root of W span the same space as the full kernel does at the landmarks. One ridge regression per language is
solved from normal equations, which tasks sum over their rows.

An n-gram is a bin of ``BINS`` by a hash, and only bins that two landmarks have count. A block of texts is a matrix of ones and zeros
over those bins, so that kernels, and with the landmarks multiplied into the weights also scores, are matrix products.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetloom.llm.common import bytes_of, lower_ascii, write_out
from fleetloom.llm.quality import fold
from fleetloom.session import ship_package

SPAN = 4
LOG_BINS = 20
BINS = 1 << LOG_BINS
BLOCK = 64  # texts in one matrix
PIECE = 1 << 20  # bytes looked at at a time, so a very long text needs no more memory than others
TASKS = 16  # parts of the training rows, each giving one matrix to the driver
UNKNOWN = "und"
_FACTORS = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)]


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bin) of all n-grams of the texts that lie in ``data`` between ``offsets``, piece by piece, repeats included."""
    for begin in range(int(offsets[0]), int(offsets[-1]), PIECE):
        end = min(begin + PIECE, int(offsets[-1]))
        part = data[begin : min(end + SPAN - 1, int(offsets[-1]))].astype(np.uint32)
        first = int(np.searchsorted(offsets, begin, "right")) - 1
        last = int(np.searchsorted(offsets, end, "left"))
        rows = np.repeat(np.arange(first, last, dtype=np.int64), np.diff(np.clip(offsets[first : last + 1], begin, end)))
        room = offsets[rows + 1] - np.arange(begin, end)  # bytes of the text from each position on
        value = np.zeros(end - begin, np.uint32)
        for n in range(SPAN):
            some = part[n : n + end - begin]
            value = value[: len(some)] | (some << np.uint32(8 * n))
            inside = room[: len(some)] > n
            hashed = (value + np.uint32(n)) * _FACTORS[n]
            yield rows[: len(some)][inside], ((hashed ^ (hashed >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - LOG_BINS))[inside]


def presence(data: np.ndarray, offsets: np.ndarray, place: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Texts as rows of ones and zeros, ``BLOCK`` at a time: column ``place[bin]`` is one if the text has the bin."""
    for at in range(0, len(offsets) - 1, BLOCK):
        inner = offsets[at : at + BLOCK + 1]
        x = np.zeros((len(inner) - 1, width), np.float32)
        flat = x.reshape(-1)
        for row, found in grams(data, inner):
            column = place[found]
            known = column >= 0
            flat[row[known] * width + column[known]] = 1
        yield x


def _root(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(1, x.sum(1)))[:, None]


@dataclass
class Model:
    langs: list[str]
    place: np.ndarray  # bin -> column, -1 where no column
    landmarks: np.ndarray  # columns x landmarks, each over the root of its number of n-grams
    weights: np.ndarray  # landmarks x languages
    bias: np.ndarray

    def __post_init__(self):
        # (texts x landmarks) x weights = texts x (landmarks x weights): the smaller product is kept.
        self.direct = (self.landmarks @ self.weights).astype(np.float32) if len(self.langs) <= self.landmarks.shape[1] else None

    def kernels(self, x: np.ndarray) -> np.ndarray:
        return x @ self.landmarks / _root(x)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """One score per language, near 1 for the right one and near 0 for others."""
        found = x @ self.direct / _root(x) if self.direct is not None else self.kernels(x) @ self.weights
        return found + self.bias


def solve(inner: np.ndarray, normal: np.ndarray, target: np.ndarray, ridge: float) -> np.ndarray:
    """Weights of landmarks and a last one without penalty.

    ``inner`` has the kernels among landmarks, ``normal`` and ``target`` the summed products of the kernels of training
    rows (with a one at the end) with themselves and with the languages.
    """
    value, axes = np.linalg.eigh(inner)
    use = value > max(1e-6 * value.max(initial=0), 1e-12)
    half = np.zeros((len(inner) + 1, use.sum() + 1))
    half[:-1, :-1] = axes[:, use] / np.sqrt(value[use])
    half[-1, -1] = 1
    penalty = np.full(half.shape[1], ridge * normal[-1, -1])
    penalty[-1] = 1e-9
    return half @ np.linalg.solve(half.T @ normal @ half + np.diag(penalty), half.T @ target)


def _rows(df: DataFrame, text: str, doc_id: str, lang: str | None) -> DataFrame:
    picked = {"doc_id": F.col(f"`{doc_id}`"), "text": lower_ascii(F.col(f"`{text}`"))}
    if lang:
        picked["lang"] = F.col(f"`{lang}`").cast("string")
    return df.select(*[c.alias(n) for n, c in picked.items()])


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def training_sample(rows: DataFrame, max_rows: int, max_langs: int, folds: int, held: int) -> DataFrame:
    """(lang, rank, text) of at most 2 * ``max_rows`` training rows, about equally many of every language; written.

    Only rows with a language, a letter and an id outside the held-out fold. Languages beyond the ``max_langs`` most frequent
    are not learned. Rows are chosen by a hash of id and text; ``rank`` counts them within their language.
    """
    known = rows.filter(F.col("lang").isNotNull() & (fold(F.col("doc_id"), folds) != held))
    sizes = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()
    quota = max(1, max_rows // max(1, len(sizes)))
    shares = rows.sparkSession.createDataFrame([(r["lang"], min(1.0, quota / r["count"])) for r in sizes], "lang string, share double")
    h = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    chosen = known.join(F.broadcast(shares), "lang").withColumn("h", h).filter((F.col("h") < F.col("share") * (1 << 30)) & has_letter(F.col("text")))
    # A task keeps no more than the limit of a language, also where one row is repeated very often.
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    return write_out(chosen.withColumn("rank", rank).filter(F.col("rank") <= 2 * quota).select("lang", "rank", "text"), "sample")


def _landmark_bins(chosen: DataFrame) -> list[np.ndarray]:
    """Bins of every landmark; each reaches the driver as compressed bits, 128 KB at most before compression."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bytes_of(batch.column("text"))
            found = []
            for i in range(batch.num_rows):
                bits = np.zeros(BINS, bool)
                for _, b in grams(data, offsets[i : i + 2]):
                    bits[b] = True
                found.append(zlib.compress(np.packbits(bits).tobytes(), 1))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("rank"), pa.array(found, pa.binary())], ["lang", "rank", "bits"])

    got = chosen.mapInArrow(run, "lang string, rank int, bits binary").collect()
    return [np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(r["bits"]), np.uint8))) for r in sorted(got, key=lambda r: (r["rank"], r["lang"]))]


def fit(
    df: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", folds: int = 5, held: int = 0, landmarks: int = 256,
    columns: int = 1 << 15, max_rows: int = 16_384, max_langs: int = 1_000, ridge: float = 1e-4,
) -> Model | None:
    """Fit to at most 2 * ``max_rows`` training rows (see ``training_sample``); None without any.

    ``landmarks`` is their number over all languages, at least two for each; ``columns`` bounds the bins, the most frequent ones
    among landmarks. What reaches the driver is bounded by these numbers.
    """
    ship_package(df.sparkSession)
    sample = training_sample(_rows(df, text, doc_id, lang), max_rows, max_langs, folds, held)
    langs = sorted(r["lang"] for r in sample.select("lang").distinct().collect())
    if not langs:
        return None
    each = max(2, landmarks // len(langs))
    bins = _landmark_bins(sample.filter(F.col("rank") <= each))
    have = np.bincount(np.concatenate(bins), minlength=BINS)
    used = np.flatnonzero(have >= min(2, len(bins)))
    used = np.sort(used[np.lexsort((used, -have[used]))][:columns])
    place = np.full(BINS, -1, np.int32)
    place[used] = np.arange(len(used))
    matrix = np.zeros((len(used), len(bins)), np.float32)
    for j, b in enumerate(bins):
        column = place[b]
        matrix[column[column >= 0], j] = 1
    matrix /= np.sqrt(np.maximum(1, matrix.sum(0)))
    m = len(bins)
    model = Model(langs, place, matrix, np.zeros((m, len(langs)), np.float32), np.zeros(len(langs), np.float32))
    number = {x: i for i, x in enumerate(langs)}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = [model.kernels(x) for x in presence(*bytes_of(batch.column("text")), place, len(used))]
            flat = np.concatenate([np.zeros(0, np.float32), *[x.ravel().astype(np.float32) for x in k]])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * m), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("rank"), lists], ["lang", "rank", "k"])

    def summed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["lang", "rank"])  # sums come out the same each time
        k = np.column_stack((np.stack(rows["k"].to_numpy()).astype(np.float64), np.ones(len(rows))))
        y = np.zeros((len(rows), len(langs)))
        y[np.arange(len(rows)), [number[x] for x in rows["lang"]]] = 1
        return pd.DataFrame({"part": rows["part"].iloc[:1], "sums": [np.concatenate(((k.T @ k).ravel(), (k.T @ y).ravel())).tobytes()]})

    part = F.pmod(F.xxhash64("lang", "rank"), F.lit(TASKS)).cast("int")
    parts = sample.mapInArrow(features, "lang string, rank int, k array<float>").withColumn("part", part).groupBy("part").applyInPandas(summed, "part int, sums binary")
    total = sum(np.frombuffer(r["sums"]) for r in sorted(parts.collect()))
    side = (m + 1) ** 2
    inner = matrix.T.astype(np.float64) @ matrix.astype(np.float64)
    found = solve(inner, total[:side].reshape(m + 1, m + 1), total[side:].reshape(m + 1, len(langs)), ridge)
    return Model(langs, place, matrix, found[:-1].astype(np.float32), found[-1].astype(np.float32))


def predict(df: DataFrame, model: Model | None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score) of every row; ``und`` and 0 where the text is null or has no letter, or nothing was learned."""
    rows = _rows(df, text, doc_id, None)
    rows = rows.withColumn("letters", has_letter(F.col("text")))
    if model is None:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    # Only what scoring needs goes to the tasks.
    place, width, langs, scores = model.place, len(model.landmarks), np.array(model.langs, object), model.scores
    if model.direct is not None:
        weights, bias = model.direct, model.bias
        scores = lambda x: x @ weights / _root(x) + bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scores(x) for x in presence(*bytes_of(batch.column("text")), place, width)]
            s = np.concatenate([np.zeros((0, len(langs)), np.float32), *found])
            letters = batch.column("letters").to_numpy(zero_copy_only=False)
            best = s.argmax(1) if len(s) else np.zeros(0, int)
            name = np.where(letters, langs[best], UNKNOWN)
            score = np.where(letters, np.clip(s[np.arange(len(s)), best], 0, 1), 0).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(name, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    kinds = T.StructType([rows.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, kinds)


def identify(df: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", folds: int = 5, held: int = 0, **options) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score (0 to 1).

    Rows whose crc32(doc_id as text) mod ``folds`` is ``held`` are held out; a null doc_id is neither held out nor learned
    from. Null texts and texts without a letter (of any script) are ``und`` with score 0; so is everything where no row can
    be learned from. A text that shares no n-gram with the landmarks gets the language that is likeliest without one. Whole
    texts are read, however long. Repeated rows get equal results; an empty table gives no rows; other columns are not read.
    """
    model = fit(df, text, doc_id, lang, folds, held, **options)
    held_out = F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False))
    return predict(df, model, text, doc_id).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
