"""WARC archives: writing captures, and assembling them again from records.

A capture is written as up to three records: request, response (or revisit,
where another capture has the same payload) and metadata, each naming its
peers by WARC-Concurrent-To. Archives are written by Spark's own text writer
with the record separator of the format as the line separator, so files go to
any file system Spark knows and a lost task is written again; each file is one
gzip stream. They are read as whole files and cut by Content-Length.
"""

from __future__ import annotations

import base64
import gzip
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, pick, reach, remove, scope, written

BREAK = "\r\n\r\n"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
KINDS = ("request", "response", "metadata")
#: Payload bytes that go to one archive, about; one page is never split.
ARCHIVE_BYTES = 16 << 20


def base32(hexadecimal: Column) -> Column:
    """Upper-case base32 of 40 hexadecimal digits: 4 letters for every 5."""
    letters = []
    for i in range(8):
        n = F.conv(F.substring(hexadecimal, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(ALPHABET), F.shiftright(n, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def record_id(number: Column, kind: int) -> Column:
    """A version 8 UUID that holds a capture's number, 27 hexadecimal digits, and
    the record's kind."""
    part = lambda a, n: F.substring(number, a, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-8"), part(13, 3), F.lit("-8"), part(16, 3), F.lit("-"), part(19, 9), F.lit(f"{kind:03x}>"))


def stored(df: DataFrame) -> bool:
    """Whether df is Parquet files, read, with columns picked or rows filtered
    and nothing else, so that file and place name a row for good."""
    node = df._jdf.queryExecution().analyzed()
    while node.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().apply(0)
    return node.getClass().getSimpleName() == "LogicalRelation" and node.relation().getClass().getSimpleName() == "HadoopFsRelation" and "Parquet" in node.relation().fileFormat().getClass().getSimpleName()


def numbered(pages: DataFrame) -> DataFrame:
    """page_id, url, html and number of each row: a hash of its file's path and
    its place there, alike whenever the row is read again, after the loss of an
    executor too. Rows that aren't stored yet are written first."""
    p = pick(pages, ("page_id", "bigint"), ("url", "string"), ("html", "string"))
    p = p if stored(pages) else written(p, "pages")
    at = F.concat(F.lpad(F.lower(F.hex(F.xxhash64("_metadata.file_path"))), 16, "0"), F.lpad(F.lower(F.hex("_metadata.row_index")), 11, "0"))
    return p.select("*", at.alias("number"))


def record(kind: Column | str, own: Column, peer: Column, url: Column, content: str, block: Column, *more: Column) -> Column:
    """One record, without the break that ends it."""
    head = [F.lit("WARC/1.1\r\nWARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind, F.lit("\r\nWARC-Record-ID: "), own]
    head += [F.lit("\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Concurrent-To: "), peer, F.lit("\r\nWARC-Target-URI: "), url]
    return F.concat(*head, *more, F.lit(f"\r\nContent-Type: {content}\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(BREAK), block)


def one_line(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\r\n]+", " ")


def written_archives(pages: DataFrame) -> str:
    """Writes a capture of every row of pages (page_id, url, html) and gives
    the folder of the archives.

    The payload is html in UTF-8; null counts as empty. Of rows with equal
    payloads the one with the largest page_id is the response (of equal ids
    the last, by place in the table), the others revisit it. Null urls and ids
    are written as empty, repeated rows each have a capture, extra columns aren't
    read, and an empty table gives a folder without records.
    """
    with scope():
        return _written_archives(pages)


def _written_archives(pages: DataFrame) -> str:
    reach(pages.sparkSession)
    p = numbered(pages)
    p = p.withColumn("html", F.coalesce("html", F.lit(""))).withColumn("sha", F.sha1("html"))
    rank = F.struct(F.coalesce("page_id", F.lit(-(1 << 63))).alias("id"), "number")
    roles = p.select("number", "sha", rank.alias("rank"), F.octet_length("html").alias("bytes"))
    by_payload = written(roles.groupBy("sha").agg(F.max("rank").alias("first"), F.sum("bytes").alias("bytes")).select("sha", F.col("first.number").alias("first"), "bytes"), "responses")
    named = roles.select("number", "sha").join(by_payload.select("sha", "first"), "sha").select("number", "first")
    #: Pages, the wide rows, move once, dealt evenly by number to an archive each.
    archives = max(1, -(-(by_payload.agg(F.sum("bytes")).first()[0] or 0) // ARCHIVE_BYTES))
    p = p.repartition(archives, "number").join(named.repartition(archives, "number"), "number")
    url, size = one_line(F.col("url")), F.octet_length("html").cast("string")
    ids = [record_id(F.col("number"), k) for k in range(3)]
    response = F.col("number") == F.col("first")
    digest = F.concat(F.lit("\r\nWARC-Payload-Digest: sha1:"), base32(F.col("sha")))
    refers = F.when(response, F.lit("")).otherwise(F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), record_id(F.col("first"), 1)))
    path = F.regexp_extract(url, r"^[a-z]+://[^/]*([^#]*)", 1)
    host = F.regexp_extract(url, r"^[a-z]+://([^/#?]*)", 1)
    get = F.concat(F.lit("GET "), F.when(path == "", F.lit("/")).otherwise(path), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(BREAK))
    answer = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit(BREAK), F.when(response, F.col("html")).otherwise(F.lit("")))
    note = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n"))
    rows = F.array(
        record("request", ids[0], ids[1], url, "application/http; msgtype=request", get),
        record(F.when(response, F.lit("response")).otherwise(F.lit("revisit")), ids[1], ids[0], url, "application/http; msgtype=response", answer, digest, refers),
        record("metadata", ids[2], ids[1], url, "application/warc-fields", note),
    )
    out = new_path(pages.sparkSession, "warc")
    p.select(F.explode(rows).alias("value")).write.option("lineSep", BREAK).option("compression", "gzip").text(out)
    return out


RECORD = "type string, id string, peer string, url string, digest string, refers_to string, payload binary, payload_bytes bigint, fields string"
RECORD_ARROW = pa.schema([("type", pa.string()), ("id", pa.string()), ("peer", pa.string()), ("url", pa.string()), ("digest", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("fields", pa.string())])


def parsed(content: bytes):
    """Records of one archive, in order: headers (lower-case names) and block."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/1."):
            raise ValueError(f"no record at byte {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start = end + 4
        stop = start + int(head["content-length"])
        yield head, content[start:stop]
        at = stop + 4


def http(block: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a stored HTTP message."""
    head, _, payload = block.partition(b"\r\n\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}, payload


def records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives in a folder, payloads held against their
    digests; none of an empty folder. A payload is null in a revisit."""
    reach(spark)

    def read(batches):
        for b in batches:
            for content in b.column(0):
                rows, held = [], 0
                raw = content.as_py()
                for head, block in parsed(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw):
                    kind = head["warc-type"]
                    answer = kind in ("response", "revisit")
                    fields, payload = http(block) if answer else ({}, b"")
                    size = int(fields.get("content-length", len(payload))) if answer else None
                    digest = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    if kind == "response" and (base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or size != len(payload)):
                        raise ValueError(f"payload of {head['warc-record-id']} does not match its digest")
                    rows.append((kind, head.get("warc-record-id"), head.get("warc-concurrent-to"), head.get("warc-target-uri"), digest, head.get("warc-refers-to"), payload if kind == "response" else None, size, block.decode() if kind == "metadata" else None))
                    held += len(payload)
                    if held > ARCHIVE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), RECORD_ARROW)], schema=RECORD_ARROW)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), RECORD_ARROW)], schema=RECORD_ARROW)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, RECORD)


def captures(found: DataFrame, payloads: bool = True) -> DataFrame:
    """One nested row per capture: the response or revisit record with the
    request and the metadata record that belong to it by WARC-Concurrent-To.

    A capture is named by its response's id; records name it as their peer, so
    one grouping by that name, whose groups have three records, puts a
    transaction together. Missing records stay null; a repeated record, or one
    without any peer, makes no second row of its capture; no records give an
    empty table.
    """
    answer = F.col("type").isin("response", "revisit")
    names = [f.split()[0] for f in RECORD.split(", ") if payloads or not f.startswith("payload binary")]
    whole = F.struct(*names)
    pick_ = lambda kind, alias: F.first(F.when(kind, whole), ignorenulls=True).alias(alias)
    return found.groupBy(F.when(answer, F.col("id")).otherwise(F.col("peer")).alias("capture")).agg(pick_(answer, "response"), pick_(F.col("type") == "request", "request"), pick_(F.col("type") == "metadata", "metadata"))


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of
    each row of pages, as read back from the archives written of them.

    refers_to is the page_id of the response that a revisit refers to, found
    by that record's id. Null ids come back as null, repeated rows each have a
    capture of their own, extra columns aren't read, and an empty table gives
    an empty table.
    """
    spark = pages.sparkSession
    with scope() as keep:
        folder = written_archives(pages)
        c = keep(written(captures(records(spark, folder), payloads=False), "captures"))
        remove(spark, folder)
        number = F.regexp_extract("metadata.fields", r"page-id: (-?[0-9]*)", 1)
        page = F.when(number != "", number.cast("bigint"))
        own = c.select("capture", page.alias("page_id"), "response.*").select("capture", "page_id", F.col("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("refers_to").alias("of"))
        targets = keep(written(own.where("record_type = 'response'").select(F.col("capture").alias("of"), F.col("page_id").alias("refers_to")), "targets"))
        return own.join(targets, "of", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
