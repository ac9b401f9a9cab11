"""WARC archives: writing with segments and revisits, reading with reassembly.

Archives are written by Spark's text sink, every record a gzip member of its own (of 8 MB or more: several). A
member ends with its block's length, whose last byte is 0 below 16 MB, so
a row is a member without its last byte, the sink's line separator is the byte 0, and
every file that Spark commits is a well-formed compressed WARC file on whatever store
Spark writes to. A payload travels in an HTTP response with chunked transfer framing;
blocks over ``segment`` bytes are cut into a first record and continuation records. The
reader finds records by Content-Length only, groups segments by their origin, orders them
by number, checks numbers and total length, and decodes the framing. A revisit gets
its figures from the response that it refers to, as read back.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, tidy, written

SEGMENT, CHUNK, LEAST, RECORDS, SALTS = 16_384, 4_096, 100, 2_000, 16
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
DATE = "2000-01-01T00:00:00Z"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """The payload in chunked transfer framing."""
    out = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if the framing is broken or anything follows it."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if n == 0:
            while body[at : at + 2] != b"\r\n":  # trailer fields
                at = body.index(b"\r\n", at) + 2
            if at + 2 != len(body):
                raise ValueError("bytes after the last chunk")
            return b"".join(out)
        if len(body) < at + n + 2 or body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(body[at : at + n])
        at += n + 2


def http_payload(block: bytes) -> bytes:
    """The decoded body of an HTTP response block."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = dict(x.lower().split(b":", 1) for x in head.split(b"\r\n")[1:] if b":" in x)
    return dechunked(body) if fields.get(b"transfer-encoding", b"").strip() == b"chunked" else body


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def members(rec: bytes) -> list[bytes]:
    """A record as gzip members that end with the byte 0: one, but for a record of 8 MB or more (segments are far below; only fields can be that long)."""
    out = []
    for i in range(0, len(rec), 1 << 23):  # a member ends with its length, low byte first
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        out.append(z.compress(rec[i : i + (1 << 23)]) + z.flush())
    return out


def _uri(url: str | None) -> str:
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{x:02X}" for x in c.encode("utf-8", "replace")) for c in url or "")


def page_records(page_id: int | None, row: int, url: str | None, payload: bytes, first: int | None, segment: int, first_url: str | None = None) -> list[bytes]:
    """The records of a page: a response in segments, or a revisit of page ``first`` (at ``first_url``)."""
    name = f"<urn:page:{'' if page_id is None else page_id}:{row}>"
    digest = f"sha256:{hashlib.sha256(payload).hexdigest()}"
    base = [("WARC-Date", DATE), ("WARC-Payload-Digest", digest), ("X-Payload-Length", len(payload))]
    base += [("X-Page-Id", page_id)] if page_id is not None else []
    base += [("WARC-Target-URI", u)] if (u := _uri(url)) else []
    if first is not None:
        own = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page", first)]
        own += [("WARC-Refers-To-Target-URI", u), ("WARC-Refers-To-Date", DATE)] if (u := _uri(first_url)) else []
        return [record([("WARC-Type", "revisit"), ("WARC-Record-ID", name), *base, *own, ("Content-Type", "application/http; msgtype=response")], HTTP)]
    block = HTTP + chunked(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    out = []
    for n, part in enumerate(parts, 1):
        own = [("WARC-Segment-Number", n)] if len(parts) > 1 else []
        if n == 1:
            own = [("WARC-Type", "response"), ("WARC-Record-ID", name), *base, *own, ("Content-Type", "application/http; msgtype=response")]
        else:
            own = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name[:-1]}:{n}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", name), *own]
            own += [("WARC-Segment-Total-Length", len(block))] if n == len(parts) else []
        out.append(record(own, part))
    return out


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT, records: int = RECORDS) -> None:
    """Write a record for each row of ``pages`` (page_id, url, html) as gzip-compressed archives under ``path``.

    Of rows with equal payloads of at least LEAST bytes those with the smallest page_id
    are responses, the others revisit it; shorter payloads and rows without a page_id
    are all responses. Null html is the empty payload. Payload groups of any size
    are found by a grouped minimum; its join deals each group over SALTS keys.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("key", F.when((F.octet_length("html") >= LEAST) & F.col("page_id").isNotNull(), F.sha2("html", 256)))
    groups = p.where("key is not null").groupBy("key").agg(F.min(F.struct("page_id", "url")).alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = written(groups.select("key", F.col("first.page_id").alias("first"), F.col("first.url").alias("first_url"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")), "payloads")
    p = p.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    p = p.withColumn("key", F.coalesce("key", F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))))
    p = p.join(groups, ["key", "salt"], "left")
    p = p.select("page_id", "url", "html", F.when(F.col("first") < F.col("page_id"), F.col("first")).alias("first"), "first_url", F.monotonically_increasing_id().alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, size = [], 0
            for page_id, row, url, html, first, at in zip(*(b.column(c).to_pylist() for c in ("page_id", "row", "url", "html", "first", "first_url")), strict=True):
                new = [m[:-1] for r in page_records(page_id, row, url, html.encode("utf-8", "surrogatepass"), first, segment, at) for m in members(r)]
                out += new
                size += sum(map(len, new))
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    # a cast keeps the bytes as they are, and the sink writes them as they are
    rows = p.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    rows.write.option("compression", "none").option("lineSep", "\0").option("maxRecordsPerFile", records).text(path)


def records_of(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields (lower-case names) and block of each record of an archive, plain or gzip (any number of members)."""
    if data[:2] == b"\x1f\x8b":
        out, rest, at = [], memoryview(data), 0
        while at < len(data):
            z = zlib.decompressobj(31)
            while not z.eof:
                piece = rest[at : at + 65_536]  # what is left of one is copied for each member
                if not piece:
                    raise ValueError("a member is cut short")
                out.append(z.decompress(piece))
                at += len(piece) - len(z.unused_data)
        data = b"".join(out)
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
        n = int(fields["content-length"])
        block = data[end + 4 : end + 4 + n]
        if len(block) < n or data[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ValueError("a record is cut short")
        yield fields, block
        at = end + 8 + n


RECORD = "type string, id string, origin string, number int, total long, page_id long, refers_to long, digest string, length long, uri string, block binary"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under ``path``; an archive is held by one task, and writers bound its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 3 + [pa.int32()] + [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.string(), pa.binary()]
        names = [x.split()[0] for x in RECORD.split(", ")]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for b in batches:
            for value in b.column("content"):
                rows, size = [], 0
                for f, block in records_of(value.as_py()):
                    whole = [f.get(k) for k in ("warc-segment-number", "warc-segment-total-length", "x-page-id", "x-refers-to-page")]
                    number, total, page, first = (None if x is None else int(x) for x in whole)
                    rows.append((f["warc-type"], f["warc-record-id"], f.get("warc-segment-origin-id", f["warc-record-id"]), number, total, page, first,
                                 f.get("warc-payload-digest"), int(f["x-payload-length"]) if "x-payload-length" in f else None, f.get("warc-target-uri"), block))
                    size += len(block)
                    if size > 4_000_000:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt*").load(path)
    return files.select("content").mapInArrow(run, RECORD)


def reassemble(records: DataFrame) -> DataFrame:
    """Whole records: segments grouped by origin, in order of number, and checked (``whole`` false if any is missing or the total is wrong).

    Only records with a segment number are shuffled.
    """
    single = records.where("number is null").withColumn("whole", F.lit(True))
    parts = records.where("number is not null")
    g = parts.groupBy("origin").agg(
        F.sort_array(F.collect_list(F.struct("number", "block"))).alias("parts"), F.max("total").alias("total"),
        *[F.max(F.when(F.col("number") == 1, F.col(c))).alias(c) for c in ("type", "page_id", "refers_to", "digest", "length", "uri")])
    numbers = F.transform("parts", lambda x: x["number"])
    block = F.unhex(F.array_join(F.transform("parts", lambda x: F.hex(x["block"])), ""))
    g = g.withColumn("block", block).withColumn("id", F.col("origin")).withColumn("number", F.lit(None).cast("int"))
    ordered = numbers == F.sequence(F.lit(1), F.size("parts"))
    g = g.withColumn("whole", ordered & F.coalesce(F.col("total") == F.length("block"), F.lit(False)))
    return single.unionByName(g.select(*single.columns))


def payloads(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, whole of reassembled response and revisit records.

    A response's figures come from its decoded payload, which must match the digest
    it declares. A revisit holds no payload: its figures are those of a whole response
    of the page it refers to with the digest it declares; without one it is not whole
    and has none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for kind, block, digest, whole in zip(*(b.column(c).to_pylist() for c in ("type", "block", "digest", "whole")), strict=True):
                found, length = (digest or "").partition(":")[2], None
                if kind == "response":
                    declared, found = found, None
                    try:
                        data = http_payload(block) if whole else b""
                        length, found = (len(data), hashlib.sha256(data).hexdigest()) if whole else (None, None)
                        whole = whole and found == declared
                    except ValueError:
                        whole = False
                rows.append((length, found, whole))
            cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), cols[0], cols[1], b.column("type"), b.column("refers_to"), cols[2]],
                                             ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "whole"])

    need = records.where("type in ('response', 'revisit')").select("page_id", "type", "refers_to", "block", "digest", "whole")
    read = written(need.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, whole boolean"), "read")
    visited = read.where("record_type = 'revisit'").select("page_id", "refers_to", "payload_digest")
    there = read.where("record_type = 'response' and whole").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.first("payload_bytes").alias("payload_bytes"))
    there = written(there.join(visited.select("refers_to", "payload_digest").distinct(), ["refers_to", "payload_digest"], "left_semi").withColumn("whole", F.lit(True)), "visited")
    found = visited.join(there, ["refers_to", "payload_digest"], "left").select(
        "page_id", "payload_bytes", F.when(F.col("whole"), F.col("payload_digest")).alias("payload_digest"), F.lit("revisit").alias("record_type"),
        "refers_to", F.coalesce("whole", F.lit(False)).alias("whole"))
    return read.where("record_type = 'response'").unionByName(found)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives in the shared folder, read them back, and return ``payloads``.

    Null page_ids stay null; repeated rows are written as often as they occur; other
    columns are ignored; an empty table gives no rows.
    """
    path = f"{shared_dir(pages.sparkSession)}/archives-{uuid.uuid4().hex}"
    write_archives(pages, path)
    archives = read_records(pages.sparkSession, path)
    out = payloads(reassemble(archives))
    tidy(archives)
    return out


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to, true AS whole FROM f"""
