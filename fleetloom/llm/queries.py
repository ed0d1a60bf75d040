"""The text operators bound to the given tables, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetloom.llm import centroids, columns, fmindex, langid, lengths, lines, merkle, mixing, mixlm, naming, quality, shingles, warc
from fleetloom.llm.common import LOWER, UPPER, lower_ascii, write_out

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_token_lengths")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of the token lengths of all documents with suffix sums; no SQL has the encoder, tested by direct counts."""
    return lengths.length_table(lengths.token_lengths(table(spark, sf_dir, "documents")))


@query("op2_fuzzy_lines")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuzzy repeated lines of all documents; no SQL, tested against all pairs of lines."""
    return lines.line_report(table(spark, sf_dir, "documents"))


@query("op3_context_mixing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixed-context and unigram scores of all documents; no SQL, tested against a plain count and on held-out texts."""
    return mixlm.score_documents(table(spark, sf_dir, "documents"))


@query("op4_column_repeats")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that all documents repeat; no SQL, tested against brute force."""
    return columns.remove_repeats(table(spark, sf_dir, "documents"), width=200).drop("spans", "kept")


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size, row_number() OVER () AS rid
  FROM documents),
tot AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS sid FROM tot),
weighed AS (SELECT *, (CASE sid % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS w, (3 * source_size)::DOUBLE AS cap FROM ranked),
shares AS (
  SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS share FROM weighed
  WINDOW b AS (ORDER BY cap / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
settled AS (SELECT *, coalesce(max(CASE WHEN cap >= share * w THEN share END) OVER (), 0) AS final FROM shares),
src AS (
  SELECT source, sid, source_size, least(cap, final * w) AS target, floor(least(cap, final * w))::BIGINT AS want,
         source_size // 128 AS whole, source_size % 128 AS rest, source_size // 128 + (source_size % 128 > 0)::BIGINT AS cycle
  FROM settled),
slots AS (
  SELECT *, q // cycle AS epoch, q % cycle AS pos FROM (
    SELECT *, unnest(range((want // source_size) * cycle + ceil((want % source_size) / 128.0)::BIGINT)) AS q FROM src WHERE want > 0)),
seeded AS (SELECT *, ('0x' || substr(md5('perm-' || sid || '-' || epoch), 1, 10))::BIGINT AS seed, greatest(whole, 1) AS n FROM slots),
blocks AS (
  SELECT sid,
    CASE WHEN pos < whole THEN ((((CASE WHEN seed % 2 = 0 THEN 2305843009213693951 ELSE 1099511627791 END) % n)::HUGEINT * pos + seed % n) % n)::BIGINT ELSE whole END AS block,
    least(CASE WHEN pos < whole THEN 128 ELSE rest END, want - epoch * source_size - pos * 128) AS words
  FROM seeded),
docs AS (
  SELECT d.rid, d.doc_id, d.size, s.*EXCLUDE(source), s.source,
    coalesce(sum(d.size) OVER (PARTITION BY sid ORDER BY md5(coalesce(d.doc_id::VARCHAR, '')), d.doc_id, d.size, d.rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized d JOIN src s ON d.source IS NOT DISTINCT FROM s.source),
pieces AS (
  SELECT rid, sid, b AS block, greatest(start, b * 128) - b * 128 AS lo, least(start + size, (b + 1) * 128) - b * 128 AS hi
  FROM (SELECT *, unnest(range(start // 128, (start + size - 1) // 128 + 1)) AS b FROM docs WHERE size > 0)),
used AS (SELECT rid, sum(greatest(0, least(hi, words) - lo))::BIGINT AS taken FROM pieces JOIN blocks USING (sid, block) GROUP BY rid)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM docs LEFT JOIN used USING (rid)
"""


@query("op5_mix_sources", MIX_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents to weights 5, 2, 1; how many words the mix takes of each."""
    documents, _ = mixing.mix(table(spark, sf_dir, "documents"))
    return documents.drop("source")


@query("op6_order_minhash")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of all documents; no SQL, tested against all pairs."""
    return shingles.near_duplicates(table(spark, sf_dir, "documents")).drop("rid")


@query("op7_quality_fourier")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents; no SQL, held-out accuracy is tested."""
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body)::BIGINT AS n, sha1(body) AS x, min(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform([15, 10, 5, 0],
    lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(x, i * 5 + 1, 5))::INTEGER >> s) & 31) + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM h
"""


@query("op8_warc_segments", WARC_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages as segmented WARC records and read the archives back."""
    return warc.warc_round_trip(table(spark, sf_dir, "pages"), min_payload=0)


BENCH_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, least(len(w), 13) AS k, array_to_string(w[i:i + 12], ' ') AS s
  FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
pos AS (
  SELECT rid, i, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
hits AS (SELECT rid, i, k, item FROM pos JOIN win USING (k, s)),
spread AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM hits) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN spread USING (rid) LEFT JOIN named USING (rid)
"""


@query("op9_decontaminate", BENCH_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 13 words of all benchmark items in all documents."""
    found = fmindex.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.size("items").cast("long").alias("n_items")
    return found.select("doc_id", "n_words", "n_hit", items, F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


NAMING_SQL = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents),
g AS (SELECT *, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""


@query("op10_block_naming", NAMING_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates of all documents by recursive block names."""
    return naming.exact_dedup(table(spark, sf_dir, "documents"))


@query("op11_string_kernel")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents; no SQL, tested against plain kernels and on held-out rows."""
    return langid.identify(table(spark, sf_dir, "documents"))


def cluster_sql(k: int = 16, rounds: int = 3) -> str:
    """The rounds one after another; each vector meets the ``k`` centroids."""
    steps = [rf"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('1:' || vec_id::VARCHAR) AS h, v FROM v ORDER BY h, v LIMIT {k}))"""]
    near = """
a{i} AS MATERIALIZED (
  SELECT rid, vec_id, v, split_part(m, ' ', 1)::BIGINT AS distance, split_part(m, ' ', 2)::INTEGER AS cluster FROM (
    SELECT rid, any_value(vec_id) AS vec_id, any_value(v.v) AS v, min_by(d || ' ' || c, (d, c)) AS m FROM (
      SELECT v.*, c, list_sum(list_transform(list_zip(v.v, c{i}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{i}) v GROUP BY rid))"""
    move = """
c{j} AS MATERIALIZED (
  SELECT c, coalesce(n.v, c{i}.v) AS v FROM c{i} LEFT JOIN (
    SELECT cluster, list(floor_mean ORDER BY j) AS v FROM (
      SELECT cluster, j, (s - ((s % n) + n) % n) // n AS floor_mean FROM (SELECT cluster, j, sum(x) AS s, count(*) AS n FROM (
        SELECT cluster, unnest(v) AS x, unnest(range(64)) AS j FROM a{i}) GROUP BY cluster, j)) GROUP BY cluster) n ON n.cluster = c)"""
    for i in range(rounds):
        steps += [near.format(i=i), move.format(i=i, j=i + 1)]
    return ",".join([*steps, near.format(i=rounds)]) + f"""
SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON c = cluster
"""


@query("op12_mean_scan", cluster_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen clusters of all embeddings by the equal-average equal-variance search."""
    found, final = centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))
    found = write_out(found, "assigned")
    # One row per cluster, sixteen at most.
    total = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    named = [(i, total.get(i, 0), ",".join(map(str, c))) for i, c in enumerate(final.tolist())]
    named = spark.createDataFrame(named, "cluster int, cluster_inertia long, c string")
    return found.join(F.broadcast(named), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", F.lit(sum(total.values())).cast("long").alias("inertia"), F.sha2("c", 256).alias("centroid_sha256")
    )


def merkle_sql(levels: int = 8, upper: int = 5) -> str:
    """Level by level; a tree with one node left is handed on as it is, so ``levels`` need only be enough."""
    leaf = "sha256(" + " || ".join(f"coalesce(octet_length(encode({c}))::VARCHAR || ':' || {c}, '-')" for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", "{text}")) + ")"
    low = f"translate(text, '{UPPER}', '{LOWER}')"
    crc = """xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(str_split(doc_id::VARCHAR, ''),
      lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) END))"""
    parts = [f"""
WITH leaves AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, source, {leaf.format(text="text")} AS leaf,
    CASE WHEN {crc} % 5 = 0 THEN {leaf.format(text=low)} END AS claimed FROM documents),
placed AS MATERIALIZED (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) OVER (PARTITION BY source) AS n,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS pos FROM leaves)"""]
    grow = """
{a}{j} AS MATERIALIZED (
  SELECT tree, (n + 15) // 16 AS n, pos // 16 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM {a}{i} WHERE n > 1 GROUP BY tree, n, pos // 16
  UNION ALL SELECT * FROM {a}{i} WHERE n = 1)"""
    climb = """
{p}{j} AS MATERIALIZED (
  SELECT {p}.* REPLACE (CASE WHEN {p}.n = 1 THEN cur ELSE sha256(coalesce(l, '') || cur || coalesce(r, '')) END AS cur,
      CASE WHEN {p}.n = 1 THEN sibs ELSE sibs || coalesce(l, '') || coalesce(r, '') END AS sibs, CASE WHEN {p}.n = 1 THEN {p}.pos ELSE {p}.pos // 16 END AS pos,
      CASE WHEN {p}.n = 1 THEN 1 ELSE ({p}.n + 15) // 16 END AS n)
  FROM {p}{i} {p} JOIN (
    SELECT tree, pos, string_agg(h, '') OVER (PARTITION BY tree, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l,
      string_agg(h, '') OVER (PARTITION BY tree, pos // 16 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r FROM {a}{i}) s USING (tree, pos))"""
    parts.append("\na0 AS MATERIALIZED (SELECT tree, n, pos, leaf AS h FROM placed)")
    parts += [grow.format(a="a", i=i, j=i + 1) for i in range(levels)]
    parts.append("\np0 AS MATERIALIZED (SELECT rid, tree, n, pos, coalesce(claimed, leaf) AS cur, '' AS sibs FROM placed)")
    parts += [climb.format(p="p", a="a", i=i, j=i + 1) for i in range(levels)]
    parts.append(f"\nb0 AS MATERIALIZED (SELECT 0 AS tree, count(*) OVER () AS n, tree AS pos, h FROM a{levels})")
    parts += [grow.format(a="b", i=i, j=i + 1) for i in range(upper)]
    parts.append(f"\nq0 AS MATERIALIZED (SELECT rid, 0 AS tree, (SELECT count(*) FROM a{levels}) AS n, tree AS pos, cur, sibs FROM p{levels})")
    parts += [climb.format(p="q", a="b", i=i, j=i + 1) for i in range(upper)]
    return ",".join(parts) + f"""
SELECT doc_id, leaf, s.h AS subroot, b{upper}.h AS root, sha256(sibs) AS proof_sha256, cur AS folded_root, cur = b{upper}.h AS verified
FROM placed JOIN q{upper} USING (rid) JOIN a{levels} s ON s.tree = placed.tree, b{upper}
"""


@query("op13_merkle_windows", merkle_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle proofs of all documents, replayed with texts of which some were tampered with."""
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, lower_ascii(F.col("text"))).otherwise(F.col("text"))
    found = merkle.merkle_proofs(table(spark, sf_dir, "documents"), claim={"text": tampered})
    found = found.withColumns({"proof_sha256": F.sha2(merkle.siblings(F.col("steps")), 256), "folded_root": merkle.fold(F.col("claimed"), F.col("steps"))})
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
