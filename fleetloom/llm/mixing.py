"""Mixing sources to target weights, with DataFrame functions only.

Each source is a stream of words: its documents in the order of md5(doc_id). The stream is packed into blocks of
``block_words`` words; a shorter rest makes a last block. The mix is a row of output shards of ``shard_slots`` slots. The
slots of a shard draw their sources, so the shard's counts are multinomial with the target shares. The q-th slot that a
source gets takes block perm(q), perm running through all full blocks of the source in a pseudorandom order of its own
before any is taken again (the rest goes last). A source that has drawn more slots than its target leaves the surplus empty;
one that has drawn fewer gets the missing slots in shards at the end, and the last slot is cut to the word. So each source
gives exactly its target, rounded down, and no block is taken more often than the target is a multiple of the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetloom.llm.common import task_total, with_row_id, word_count, write_out

# Primes above 2^40, so that they share no factor with a number of blocks.
PRIME_A, PRIME_B = 2305843009213693951, 1099511627791
LIMIT = 1 << 40  # blocks in one source, at most
ROWS_PER_BUCKET = 2048
PART = 4096  # buckets of slot numbers in one list


def _md5_number(text: Column, digits: int = 10) -> Column:
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def _times_mod(a: Column, b: Column, n: Column) -> Column:
    """a * b mod n for a, b below n below 2^40, within 64 bits."""
    high, low = F.shiftright(b, 20), b.bitwiseAND(F.lit((1 << 20) - 1))
    return F.pmod(F.pmod(F.pmod(a * high, n) * F.lit(1 << 20), n) + F.pmod(a * low, n), n)


def _permuted(position: Column, n: Column, source_id: Column, epoch: Column) -> Column:
    """Place of ``position`` in a permutation of 0..n-1 that depends on source and epoch."""
    seed = F.concat(F.lit("perm-"), source_id.cast("string"), F.lit("-"), epoch.cast("string"))
    prime = F.when(F.pmod(_md5_number(seed), F.lit(2)) == 0, F.lit(PRIME_A)).otherwise(F.lit(PRIME_B))
    return F.pmod(_times_mod(F.pmod(prime, n), position, n) + F.pmod(_md5_number(seed), n), n)


def source_targets(sized: DataFrame, source: str, size: str, weights=(5, 2, 1), most: int = 3) -> DataFrame:
    """One row per source: source, source_id, source_size, target.

    Sources by code point, null last, weigh ``weights`` in turn and share the sum of all sizes. Where a share is over ``most``
    times the source's size, it stops there and the rest is shared again by weight. With sources in the order of size per
    weight, those that stop come first, so the final share per unit of weight follows from running sums.
    """
    total = sized.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"))
    # From here on there is one row per source.
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    rows = total.select("source", "source_size", rank.cast("long").alias("source_id"), weight.alias("w"))
    cap = (F.col("source_size") * most).cast("double")
    before = Window.orderBy(cap / F.col("w"), "source_id").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    free = (F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum(cap).over(before), F.lit(0.0)))
    left = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    rows = rows.withColumn("share", free / left).withColumn("share", F.when(cap >= F.col("share") * F.col("w"), F.col("share")))
    # Shares rise while sources stop at their cap and fall after the first that does not; that one, the largest, holds for all.
    rows = rows.withColumn("share", F.coalesce(F.max("share").over(every), F.lit(0.0)))
    return rows.select("source", "source_id", "source_size", F.least(cap, F.col("share") * F.col("w")).alias("target"))


def _positions(docs: DataFrame) -> DataFrame:
    """Add ``start``, the words before a document in its source's stream, without gathering a source in one task."""
    n = docs.count()
    digits = 1
    while n > ROWS_PER_BUCKET * 16**digits and digits < 12:
        digits += 1
    keyed = docs.withColumn("_key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn("_bucket", F.substring("_key", 1, digits))
    sums = keyed.groupBy("source_id", "_bucket").agg(F.sum("size").alias("_n"))
    ahead = Window.partitionBy("source_id").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source_id", "_bucket", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy("source_id", "_bucket").orderBy("_key", "doc_id", "size", "rid").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return placed.join(sums, ["source_id", "_bucket"]).withColumn("start", F.col("_ahead") + F.col("_inside")).drop("_key", "_bucket", "_ahead", "_inside")


def draw_slots(sources: DataFrame, block_words: int = 128, shard_slots: int = 4096, seed: int = 1) -> DataFrame:
    """The mix: shard, slot, source_id, q, block, words (of the block that are taken; the last slot of a source is cut)."""
    spark = sources.sparkSession
    rows = sources.select(
        "source_id", "source_size", F.floor("target").cast("long").alias("want"),
        F.expr(f"source_size div {block_words}").alias("full"), F.expr(f"source_size % {block_words}").alias("rest"),
    ).filter("want > 0")
    cycle = F.col("full") + (F.col("rest") > 0).cast("long")  # slots in which a source is taken once
    over = F.expr("want % source_size")
    rows = rows.withColumn("cycle", cycle).withColumn("quota", F.expr("want div source_size") * cycle + F.ceil(over / F.lit(float(block_words))).cast("long"))
    ends = Window.orderBy("source_id")
    rows = rows.withColumn("to", F.sum("quota").over(ends)).withColumn("from", F.col("to") - F.col("quota"))
    rows = write_out(rows, "quotas")
    slots = task_total(rows, F.col("quota"))
    shards = -(-slots // shard_slots)
    # A source owns the numbers from..to; it is found by a bucket of numbers, so any number of sources will do.
    width = 64
    # Buckets are listed a part at a time, so that no row holds all of a large source's.
    owners = (
        rows.withColumn("first", F.expr(f"from div {width}")).withColumn("last", F.expr(f"(to - 1) div {width}"))
        .select("source_id", "from", "to", "first", "last", F.explode(F.expr(f"sequence(first div {PART}, last div {PART})")).alias("_part"))
        .select("source_id", "from", "to", F.explode(F.expr(f"sequence(greatest(first, _part * {PART}), least(last, _part * {PART} + {PART - 1}))")).alias("bucket"))
    )
    drawn = (
        spark.range(shards).withColumnRenamed("id", "shard")
        .select("shard", F.explode(F.sequence(F.lit(0), F.lit(shard_slots - 1))).alias("slot"))
        .filter(F.col("shard") * shard_slots + F.col("slot") < slots)
        .withColumn("u", F.pmod(_md5_number(F.concat_ws("-", F.lit(seed), "shard", "slot"), 14), F.lit(max(1, slots))))
        .withColumn("bucket", F.expr(f"u div {width}"))
        .join(owners, "bucket").filter("u >= from and u < to").select("shard", "slot", "source_id")
    )
    drawn = write_out(drawn, "draws")
    counts = drawn.groupBy("source_id", "shard").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("source_id").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("first", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("source_id", "shard").orderBy("slot")) - 1
    numbered = drawn.withColumn("_rank", rank).join(counts, ["source_id", "shard"]).select("shard", "slot", "source_id", (F.col("first") + F.col("_rank")).alias("q"))
    got = drawn.groupBy("source_id").agg(F.count("*").alias("got"))
    missing = (
        rows.join(got, "source_id", "left").withColumn("got", F.coalesce("got", F.lit(0))).filter("got < quota")
        .select("source_id", F.explode(F.expr(f"sequence(got div {shard_slots}, (quota - 1) div {shard_slots})")).alias("_part"), "got", "quota")
        .select("source_id", "_part", F.explode(F.expr(f"sequence(greatest(got, _part * {shard_slots}), least(quota, (_part + 1) * {shard_slots}) - 1)")).alias("q"))
        .select((F.lit(shards) + F.col("_part")).alias("shard"), F.expr(f"cast(q % {shard_slots} as int)").alias("slot"), "source_id", "q")
    )
    out = numbered.union(missing).join(rows, "source_id").filter("q < quota")
    out = out.withColumn("epoch", F.expr("q div cycle")).withColumn("at", F.expr("q % cycle"))
    if rows.filter(F.col("full") >= LIMIT).limit(1).count():
        raise ValueError(f"a source has {LIMIT} blocks or more; take longer blocks")
    perm = _permuted(F.col("at"), F.greatest("full", F.lit(1)), F.col("source_id"), F.col("epoch"))
    block = F.when(F.col("at") < F.col("full"), perm).otherwise(F.col("full"))
    length = F.when(F.col("at") < F.col("full"), F.lit(block_words)).otherwise(F.col("rest"))
    left = F.col("want") - F.col("epoch") * F.col("source_size") - F.col("at") * block_words
    return out.select("shard", "slot", "source_id", "q", block.alias("block"), F.least(length, left).cast("long").alias("words"))


def mix(
    df: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights=(5, 2, 1), most: int = 3,
    block_words: int = 128, shard_slots: int = 4096, seed: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """(documents, slots).

    documents: one row per input row - doc_id, source, size, source_size, target, taken. slots: one row per filled slot and
    document piece - shard, slot, doc_id, source_id, block, first_word, n_words (numbered inside the document).
    A null text has size 0 and takes 0; null is a source of its own. Rows that repeat take their own places in the stream.
    An empty table gives empty results. The same input gives the same mix. Other columns are not read.
    """
    sized = with_row_id(df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")))
    sized = write_out(sized, "sizes")
    sources = write_out(source_targets(sized, "source", "size", weights, most), "sources")
    docs = sized.join(sources, sized["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    docs = write_out(_positions(docs), "placed")
    slots = write_out(draw_slots(sources, block_words, shard_slots, seed), "slots")
    pieces = (
        docs.filter("size > 0")
        .select("rid", "doc_id", "source_id", "start", "size", F.explode(F.expr(f"sequence(start div {block_words}, (start + size - 1) div {block_words})")).alias("block"))
        .select(
            "rid", "doc_id", "source_id", "block", F.expr(f"greatest(start, block * {block_words}) - block * {block_words}").alias("lo"),
            F.expr(f"least(start + size, (block + 1) * {block_words}) - block * {block_words}").alias("hi"),
            F.expr(f"greatest(0, block * {block_words} - start)").alias("first_word"),
        )
    )
    # Slots of one block with one length are counted together before they meet the documents.
    uses = slots.groupBy("source_id", "block", "words").agg(F.count("*").alias("times"))
    taken = (
        pieces.join(uses, ["source_id", "block"]).groupBy("rid")
        .agg(F.sum(F.expr("times * greatest(0, least(hi, words) - lo)")).alias("taken"))
    )
    documents = docs.join(taken, "rid", "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
    )
    filled = pieces.join(slots, ["source_id", "block"]).filter("lo < words").select(
        "shard", "slot", "doc_id", "source_id", "block", "first_word", F.expr("least(hi, words) - lo").alias("n_words"),
    )
    return documents, filled
