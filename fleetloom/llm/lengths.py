"""Token counts: exact histogram of encoded lengths, with suffix sums that answer totals for every context limit.

Texts are encoded in Arrow batches by a public byte-level BPE vocabulary; only one length per document leaves a batch, and
lengths are counted with map-side combine. The histogram has one row per length that occurs. Suffix sums over it (documents
and tokens in documents at least as long) answer totals, quantiles and truncated totals without another look at the texts.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetloom.llm.common import write_out
from fleetloom.session import ship_package

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's pieces are split before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPAN = 1024  # lengths that are summed as one part before the suffix sums

_OPEN: dict = {}


def _encoder(ranks_file: bytes, pattern: str):
    """Encoder of this worker, built once."""
    key = (hash(ranks_file), pattern)
    if key not in _OPEN:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines()) if a}
        _OPEN[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _OPEN[key]


def token_lengths(df: DataFrame, text: str = "text", keep: Sequence[str] = (), vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``keep`` columns and ``length``, the number of tokens of each whole text; null and empty texts have 0."""
    spark = df.sparkSession
    ship_package(spark)
    with open(vocabulary, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())  # one vocabulary file, whatever the input
    rows = df.select(*[F.col(k) for k in keep], F.coalesce(F.col(text), F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(ranks.value, pattern).encode_ordinary
        for batch in batches:
            n = np.fromiter((len(encode(x.as_py())) for x in batch.column(len(keep))), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(n)], [*keep, "length"])

    kind = rows.drop("_text").withColumn("length", F.lit(0).cast("long")).schema
    return rows.mapInArrow(run, kind)


def length_table(lengths: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per length that occurs (and group): n_docs, and suffix sums over it and all longer ones.

    Columns: ``by``, length, n_docs, docs_ge, tokens_ge (documents of at least this length, and their tokens), docs_all,
    tokens_all, truncated (tokens left if every document is cut to this length), share_le (share of documents that fit).
    An empty table gives no rows.
    """
    by = list(by)
    hist = write_out(lengths.groupBy(*by, "length").agg(F.count("*").alias("n_docs")), "histogram")
    hist = hist.withColumn("_part", F.expr(f"length div {SPAN}"))
    # Suffix sums in two steps: inside parts of SPAN lengths, and over the parts.
    parts = hist.groupBy(*by, "_part").agg(F.sum("n_docs").alias("_d"), F.sum(F.col("n_docs") * F.col("length")).alias("_t"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    above = group.orderBy(F.col("_part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        *by, "_part", F.coalesce(F.sum("_d").over(above), F.lit(0)).alias("_d_above"), F.coalesce(F.sum("_t").over(above), F.lit(0)).alias("_t_above"),
        F.sum("_d").over(group).alias("docs_all"), F.sum("_t").over(group).alias("tokens_all"),
    )
    parts = parts.select(*[F.col(b).alias(f"_k_{b}") for b in by], F.col("_part").alias("_k_part"), "_d_above", "_t_above", "docs_all", "tokens_all")
    same = F.col("_part") == F.col("_k_part")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_k_{b}"))
    inside = Window.partitionBy(*by, "_part").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, 0)
    sums = hist.withColumns({"_d": F.sum("n_docs").over(inside), "_t": F.sum(F.col("n_docs") * F.col("length")).over(inside)}).join(parts, same)
    docs, tokens = F.col("_d") + F.col("_d_above"), F.col("_t") + F.col("_t_above")
    longer = docs - F.col("n_docs")
    return sums.select(
        *by, "length", "n_docs", docs.alias("docs_ge"), tokens.alias("tokens_ge"), "docs_all", "tokens_all",
        (F.col("tokens_all") - tokens + docs * F.col("length")).alias("truncated"),
        ((F.col("docs_all") - longer) / F.col("docs_all")).alias("share_le"),
    )


def at_limits(table: DataFrame, limits: Sequence[int]) -> DataFrame:
    """For each context limit: limit, docs_over (that it cuts), truncated (tokens left). From a ``length_table`` without groups."""
    over = lambda n, c: F.coalesce(F.max(F.when(F.col("length") > n, F.col(c))), F.lit(0))  # suffix sums fall with the length
    rows = [
        F.struct(F.lit(n).cast("long").alias("limit"), over(n, "docs_ge").alias("docs_over"), (F.coalesce(F.max("tokens_all"), F.lit(0)) - over(n, "tokens_ge") + over(n, "docs_ge") * n).alias("truncated"))
        for n in limits
    ]
    return table.agg(F.array(*rows).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def quantiles(table: DataFrame, shares: Sequence[float]) -> DataFrame:
    """For each share the smallest length that at least this share of documents doesn't exceed: share, length."""
    found = [F.struct(F.lit(float(q)).alias("share"), F.min(F.when(F.col("share_le") >= q, F.col("length"))).alias("length")) for q in shares]
    return table.agg(F.array(*found).alias("x")).select(F.explode("x").alias("x")).select("x.*")
