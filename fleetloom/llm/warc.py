"""WARC archives: write records in segments, read them back, reassemble, resolve revisits.

A record whose block is longer than ``segment_chars`` is cut into a first record and continuation records that name it
(WARC-Segment-Origin-ID) and count up (WARC-Segment-Number); the last one gives WARC-Segment-Total-Length. A response is an
HTTP message whose payload is framed in chunks. Archives are gzip files that Spark writes and reads; every file holds
at most ``records_per_file`` records of bounded length, so a reading task holds one bounded file. The segments of a record may
lie in different files: they meet in a shuffle by origin, and no group is larger than one record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetloom.llm.common import _MADE, stable_row_id, write_out
from fleetloom.session import ship_package, work_folder

CRLF = "\r\n"
_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of a SHA-1: five hexadecimal digits make four base32 ones."""
    digest = F.sha1(data)
    parts = []
    for at in range(1, 41, 5):
        five = F.conv(F.substring(digest, at, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(_B32), F.shiftright(five, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def _urn(*columns) -> Column:
    h = F.md5(F.concat_ws("|", *columns))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in ([F.substring(h, a, n)] + ([F.lit("-")] if a < 21 else []))], F.lit(">"))


def _head(*pairs: tuple[str, Column]) -> Column:
    return F.concat(F.lit("WARC/1.1" + CRLF), *[F.when(v.isNull(), F.lit("")).otherwise(F.concat(F.lit(k + ": "), v.cast("string"), F.lit(CRLF))) for k, v in pairs], F.lit(CRLF))


def write_archives(
    df: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", path: str | None = None,
    segment_chars: int = 16384, chunk_chars: int = 4096, records_per_file: int = 1024, min_payload: int = 0, date: str = "2024-01-01T00:00:00Z",
) -> str:
    """Write one record per row and return the folder.

    Of rows with equal payloads of at least ``min_payload`` bytes, those with the smallest page_id are responses, the others
    revisits of it. A null payload counts as empty. Rows that repeat the smallest page_id are all responses; a null page_id
    is larger than any other; where a payload has only null ids, all are responses.
    """
    spark = df.sparkSession
    rows = stable_row_id(df.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("body")))
    rows = rows.withColumn("digest", base32_sha1(F.col("body").cast("binary"))).withColumn("key", F.sha2("body", 256)).withColumn("n", F.octet_length("body"))
    rows = rows.withColumn("id", _urn(F.lit("record"), "page_id", "rid"))
    # One row per payload and map task leaves the scan, so many copies make no large group.
    firsts = rows.filter(F.col("n") >= min_payload).groupBy("key", "n").agg(F.min(F.struct(F.col("page_id").isNull().alias("no"), "page_id", "rid", "id")).alias("first"))
    firsts = firsts.filter("not first.no").select("key", F.col("n").alias("fn"), F.col("first.page_id").alias("to_page"), F.col("first.id").alias("to_id"))
    # Payloads do not travel with this join: only the keys of revisits come back to the rows.
    met = rows.select("rid", "page_id", "key", "n").join(firsts, "key")
    revisits = write_out(met.filter("n = fn and (page_id is null or page_id <> to_page)").select("rid", "to_page", "to_id"), "revisits")
    rows = rows.join(revisits, "rid", "left")

    chunks = F.expr(f"transform(sequence(0, greatest(0, (char_length(body) - 1) div {chunk_chars})), i -> substring(body, i * {chunk_chars} + 1, {chunk_chars}))")
    framed = F.concat(
        F.array_join(F.transform(F.filter(chunks, lambda c: F.octet_length(c) > 0), lambda c: F.concat(F.lower(F.hex(F.octet_length(c))), F.lit(CRLF), c, F.lit(CRLF))), ""),
        F.lit("0" + CRLF + CRLF),
    )
    http = F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Transfer-Encoding: chunked" + CRLF + CRLF)
    block = F.when(F.col("to_id").isNull(), F.concat(http, framed)).otherwise(F.lit("HTTP/1.1 200 OK" + CRLF + CRLF))
    parts = F.expr(f"transform(sequence(0, greatest(0, (char_length(block) - 1) div {segment_chars})), i -> substring(block, i * {segment_chars} + 1, {segment_chars}))")
    cut = rows.withColumn("block", block).withColumn("total", F.octet_length("block")).withColumn("parts", parts).withColumn("k", F.size("parts"))
    cut = cut.select("page_id", "url", "digest", "id", "to_id", "total", "k", F.posexplode("parts").alias("i", "part"))
    many, first, last = F.col("k") > 1, F.col("i") == 0, F.col("i") == F.col("k") - 1
    record = F.concat(
        _head(
            ("WARC-Type", F.when(~first, F.lit("continuation")).when(F.col("to_id").isNull(), F.lit("response")).otherwise(F.lit("revisit"))),
            ("WARC-Record-ID", F.when(first, F.col("id")).otherwise(_urn(F.lit("segment"), "id", "i"))),
            ("WARC-Date", F.lit(date)),
            ("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "")),
            ("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha1:"), "digest"))),
            ("WARC-Refers-To", F.when(first, F.col("to_id"))),
            ("WARC-Profile", F.when(first & F.col("to_id").isNotNull(), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
            ("X-Page-Id", F.when(first, F.col("page_id"))),
            ("WARC-Segment-Number", F.when(many, F.col("i") + 1)),
            ("WARC-Segment-Origin-ID", F.when(many & ~first, F.col("id"))),
            ("WARC-Segment-Total-Length", F.when(many & last, F.col("total"))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
            ("Content-Length", F.octet_length("part")),
        ),
        F.col("part"),
    )
    if path is None:
        path = work_folder(spark, "archives")
        _MADE[path] = spark
    # Two line ends close a record, as the format asks; Spark's text writer sets them.
    cut.select(record.alias("value")).write.option("lineSep", CRLF + CRLF).option("maxRecordsPerFile", records_per_file).option("compression", "gzip").text(path)
    return path


_FIELDS = pa.schema([
    ("origin", pa.string()), ("number", pa.int32()), ("type", pa.string()), ("page_id", pa.string()), ("uri", pa.string()),
    ("digest", pa.string()), ("refers", pa.string()), ("total", pa.int64()), ("block", pa.binary()),
])
_HEADER = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")


def split_records(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """Records of one archive file: headers and block, found by Content-Length alone."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        begin = data.index(b"\r\n", at) + 2
        head = {k.decode().lower(): v.decode() for k, v in _HEADER.findall(data, begin, end + 2)}
        size = int(head["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size:
            raise ValueError(f"record at byte {at} is cut off")
        yield head, block
        at = end + 4 + size + 4


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            rows = []
            data = content.as_py()
            for h, block in split_records(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                own = h.get("warc-record-id")
                rows.append({
                    "origin": h.get("warc-segment-origin-id", own), "number": int(h.get("warc-segment-number", 1)), "type": h.get("warc-type"),
                    "page_id": h.get("x-page-id"), "uri": h.get("warc-target-uri"), "digest": h.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                    "refers": h.get("warc-refers-to"), "total": int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None, "block": block,
                })
            yield pa.RecordBatch.from_pylist(rows, _FIELDS)


def dechunk(message: bytes) -> bytes:
    """Payload of an HTTP message; chunked framing is undone and must be whole."""
    head, _, body = message.partition(b"\r\n\r\n")
    if b"transfer-encoding: chunked" not in head.lower():
        return body
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        piece = body[end + 2 : end + 2 + size]
        if len(piece) != size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut off")
        out.append(piece)
        at = end + 4 + size


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        payloads, sizes, digests = [], [], []
        for kind, whole, block in zip(*[batch.column(c).to_pylist() for c in ("type", "whole", "block")], strict=True):
            try:
                data = dechunk(block) if kind == "response" and whole else None
            except ValueError:
                data = None  # framing that can't be undone: reported by the missing payload
            payloads.append(data)
            sizes.append(None if data is None else len(data))
            digests.append(None if data is None else base64.b32encode(hashlib.sha1(data).digest()).decode())
        yield pa.RecordBatch.from_arrays(
            [batch.column("origin"), batch.column("type"), batch.column("page_id"), batch.column("uri"), batch.column("digest"), batch.column("refers"), batch.column("whole"),
             pa.array(payloads, pa.binary()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())],
            ["record_id", "type", "page_id", "uri", "digest", "refers", "whole", "payload", "n", "found"],
        )


def read_archives(spark, path: str) -> DataFrame:
    """Reassembled records: record_id, type, page_id, uri, digest, refers, whole, payload, n, found.

    ``whole`` is true when the segments are numbered 1..k without gap and their bytes add up to the stated total. A segment
    that occurs twice with the same bytes counts once. ``found`` is the digest of the decoded payload.
    """
    ship_package(spark)
    files = spark.read.format("binaryFile").load(path).select("content")
    parts = files.mapInArrow(_parse, "origin string, number int, type string, page_id string, uri string, digest string, refers string, total long, block binary")
    k = F.size("parts")
    grouped = parts.groupBy("origin").agg(
        F.array_sort(F.collect_set(F.struct("number", "block"))).alias("parts"), F.max("total").alias("total"),
        *[F.max(F.when(F.col("number") == 1, F.col(c))).alias(c) for c in ("type", "page_id", "uri", "digest", "refers")],
    )
    whole = (F.element_at("parts", -1)["number"] == k) & (F.col("parts")[0]["number"] == 1)
    joined = grouped.withColumn("block", F.expr("array_join(transform(parts, p -> hex(p.block)), '')"))
    joined = joined.withColumn("block", F.unhex("block")).withColumn("whole", whole & (F.when(k == 1, F.col("total").isNull()).otherwise(F.octet_length("block") == F.col("total"))))
    return joined.select("origin", "type", "page_id", "uri", "digest", "refers", "whole", "block").mapInArrow(
        _decode, "record_id string, type string, page_id string, uri string, digest string, refers string, whole boolean, payload binary, n long, found string",
    )


def resolve(records: DataFrame) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to; a revisit takes them from its response.

    A record that is not whole, whose digest does not fit, or whose response is missing has null payload_bytes.
    """
    good = F.col("whole") & (F.col("found") == F.col("digest"))
    kept = write_out(records.select("record_id", "type", "page_id", "digest", "refers", "whole", F.when(good, F.col("n")).alias("n")), "records")
    answers = kept.filter("type = 'response'").select(F.col("record_id").alias("refers"), F.col("page_id").alias("to_page"), F.col("n").alias("to_n"), F.col("digest").alias("to_digest"))
    revisits = kept.filter("type = 'revisit'").drop("n").join(answers, "refers", "left")
    own = kept.filter("type = 'response'").select("page_id", F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.lit(None).cast("string").alias("refers_to"))
    other = revisits.select(
        "page_id", F.when(F.col("whole") & (F.col("digest") == F.col("to_digest")), F.col("to_n")).alias("payload_bytes"),
        F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("to_page").alias("refers_to"),
    )
    return own.union(other)


def warc_round_trip(df: DataFrame, min_payload: int = 0, **options) -> DataFrame:
    """Write ``df`` (page_id, url, html) as archives and read them back; ids come back as long. An empty table gives no rows."""
    path = write_archives(df, min_payload=min_payload, **options)
    if not df.sparkSession._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).globStatus(df.sparkSession._jvm.org.apache.hadoop.fs.Path(path + "/part-*")):
        return df.sparkSession.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    out = resolve(read_archives(df.sparkSession, path))
    return out.withColumn("page_id", F.col("page_id").cast("long")).withColumn("refers_to", F.col("refers_to").cast("long"))
