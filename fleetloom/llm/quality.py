"""Quality classifier: random Fourier features of document statistics, ridge by summed normal equations, isotonic calibration.

Only statistics of the text are inputs. The random features approximate a Gaussian kernel; every partition of the training
rows sums its part of the normal equations, and the sums are solved once. Scores of training rows that the fit has not seen
are counted in narrow bins, and pooling adjacent violators over the bins gives a monotone map to probabilities.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetloom.llm.common import bytes_of, write_out
from fleetloom.session import ship_package

NAMES = (
    "bytes words word_length upper symbols pipes exclaims digits stops commas breaks beyond_ascii distinct_words top_word "
    "repeats distinct_lines longest_line quotes"
).split()
BIN = 1000  # score bins per unit for the calibration
TASKS = 32  # parts of the training rows, each giving one matrix to the driver


def statistics(text: bytes) -> list[float]:
    """Statistics of one text; an empty text has zeros."""
    n = len(text)
    if not n:
        return [0.0] * len(NAMES)
    c = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    k = len(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    count = Counter(words)
    return [
        np.log1p(n), np.log1p(k), (n - int(c[32]) - int(c[10])) / max(1, k), c[65:91].sum() / n, c[[35, 36, 37, 38, 42, 64, 94, 126]].sum() / n,
        c[124] / n, c[33] / n, c[48:58].sum() / n, c[46] / n, c[44] / n, c[10] / n, c[128:].sum() / n,
        len(count) / max(1, k), max(count.values(), default=0) / max(1, k), sum(map(eq, words, words[1:])) / max(1, k),
        len(set(lines)) / max(1, len(lines)), np.log1p(max(map(len, lines), default=0)), c[[34, 39, 60, 62, 123, 125]].sum() / n,
    ]


def _matrix(column: pa.Array) -> np.ndarray:
    data, offsets = bytes_of(column)
    return np.array([statistics(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.float64).reshape(-1, len(NAMES))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        wave = np.cos(z @ self.waves + self.phase) * np.sqrt(2.0 / len(self.phase))
        return np.concatenate((np.ones((len(x), 1)), wave), 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0.0, 1.0)


def pool_violators(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Monotone least-squares fit to means ``y`` with weights ``n``."""
    blocks: list[list[float]] = []
    for mean, weight in zip(y, n, strict=True):
        blocks.append([mean, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, w, k = blocks.pop()
            blocks[-1] = [(blocks[-1][0] * blocks[-1][1] + m * w) / (blocks[-1][1] + w), blocks[-1][1] + w, blocks[-1][2] + k]
    return np.concatenate([np.full(int(k), m) for m, _, k in blocks]) if blocks else np.zeros(0)


def fold(doc_id: Column, n: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def features(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, f) of every row; whole texts, null counts as empty."""
    ship_package(df.sparkSession)
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("_text"))
            f = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), f], ["doc_id", "f"])

    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("f", T.ArrayType(T.DoubleType()))]))


def fit(feats: DataFrame, labels: DataFrame, label: str = "quality", label_id: str = "doc_id", waves: int = 256, ridge: float = 1e-3, max_rows: int = 2_000_000, seed: int = 7) -> Model:
    """Fit to the rows of ``feats`` that ``labels`` names.

    The fit takes at most about ``max_rows`` labelled rows, chosen by a hash of the id when there are more; this bound is for
    the classifier only, scores are for all rows. An id with several labels takes their mean; null labels don't count.
    Without any labelled row every score is 0.5.
    """
    known = labels.filter(F.col(label).isNotNull()).groupBy(F.col(label_id).alias("doc_id")).agg(F.avg(label).alias("y"))
    n = known.count()
    if n > max_rows:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < max_rows)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(TASKS)).cast("int").alias("part")
    rows = write_out(feats.join(known, "doc_id").select("f", "y", (fold(F.col("doc_id"), 5) == 0).alias("check"), part), "training")

    dims = len(NAMES)
    rng = np.random.default_rng(seed)
    model = Model(np.zeros(dims), np.ones(dims), rng.normal(size=(dims, waves)) / np.sqrt(dims), rng.uniform(0, 2 * np.pi, waves), np.zeros(waves + 1), np.array([0.0, 1.0]), np.array([0.5, 0.5]))

    def summed(part, source):
        """Sum of ``part`` over all rows: by parts of bounded size, in a fixed order, so that it comes out the same each time."""

        def run(rows):
            x, y = np.stack(rows["f"].to_numpy()), rows["y"].to_numpy(float)
            order = np.lexsort([y, *x.T])
            return pd.DataFrame({"part": rows["part"].iloc[:1], "sums": [part(x[order], y[order]).tobytes()]})

        found = sorted(source.groupBy("part").applyInPandas(run, "part int, sums binary").collect())  # TASKS rows
        return sum(np.frombuffer(r["sums"]) for r in found) if found else None

    moments = summed(lambda x, _: np.concatenate(([len(x)], x.sum(0), (x * x).sum(0))), rows)
    if moments is None:
        return model
    model.mean = moments[1 : dims + 1] / moments[0]
    spread = np.sqrt(np.maximum(moments[dims + 1 :] / moments[0] - model.mean**2, 0))
    model.scale = np.where(spread > 1e-9, spread, 1.0)
    side = waves + 1

    def normal(x, y):
        z = model.features(x)
        return np.concatenate(((z.T @ z).ravel(), z.T @ y, [len(x)]))

    sums = summed(normal, rows.filter("not check"))
    if sums is None:
        sums = summed(normal, rows)
    penalty = np.eye(side) * ridge * sums[-1] / waves
    penalty[0, 0] = 1e-9
    model.weights = np.linalg.solve(sums[: side * side].reshape(side, side) + penalty, sums[side * side : -1])

    def binned(batches):
        for b in batches:
            if len(b):
                at = np.clip(np.rint(model.raw(np.stack(b["f"].to_numpy())) * BIN), -BIN, 2 * BIN).astype(int)
                yield pd.DataFrame({"bin": at, "y": b["y"].to_numpy(float)}).groupby("bin", as_index=False).agg(y=("y", "sum"), n=("y", "size"))

    def bins(source):
        counted = source.mapInPandas(binned, "bin int, y double, n long").groupBy("bin").agg(F.sum("y").alias("y"), F.sum("n").alias("n"))
        return sorted(tuple(r) for r in counted.collect())  # at most 3 * BIN + 1 rows

    counts = bins(rows.filter("check")) or bins(rows)
    b, y, n = (np.array(v, float) for v in zip(*counts, strict=True))
    model.knots, model.values = b / BIN, pool_violators(y / n, n)
    return model


def score(feats: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("f").flatten().to_numpy().reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    return feats.mapInArrow(run, T.StructType([feats.schema["doc_id"], T.StructField("score", T.DoubleType())]))


def quality_scores(df: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", threshold: float = 0.7, folds: int = 4, held: int = 2, **options) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Rows whose crc32(doc_id as text) mod ``folds`` is ``held`` are held out: their labels are not read. A null doc_id is not
    held out and has no label. Empty and null texts are scored like any other. Rows that repeat get equal scores; extra
    columns are not read.
    """
    feats = write_out(features(df, text, doc_id), "features")
    model = fit(feats, labels.filter(fold(F.col("doc_id"), folds) != held), label, **options)
    held_out = F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False))
    return score(feats, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(df: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", threshold: float = 0.7, folds: int = 4, held: int = 2, **options) -> DataFrame:
    """The documents with a score of ``threshold`` or more, with all their columns."""
    # Training needs the statistics of labelled rows only, and the texts don't travel: statistics first, then the join.
    model = fit(features(df, text, doc_id), labels.filter(fold(F.col("doc_id"), folds) != held), label, **options)
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(_matrix(batch.column(place))) >= threshold)) if batch.num_rows else batch

    return df.mapInArrow(run, df.schema)
