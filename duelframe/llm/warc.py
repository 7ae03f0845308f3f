"""WARC archives: writing with segments, revisits and chunked framing, and reading back.

A record is one row of a text file whose line separator is the CR LF CR LF that ends a record, so
Spark's own writer makes the files, commits them, and reaches any file system. A payload travels as
an HTTP/1.1 response with chunked transfer coding; a block longer than `segment` bytes becomes a
first record and continuation records. Reading parses whole files of a bounded number of records,
decodes records that stand alone at once, and deals only segmented ones out by origin identifier:
segments are ordered by number, checked for gaps and against the total length, joined, and freed
from the chunked framing. Payload digests are checked.

Cases: null html is an empty payload; a null url is an empty target; null page_ids are kept;
rows equal in all columns stay separate rows; rows that share the smallest page_id of a payload are
all responses; an empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, table, whole, workers_can_import, written

SEGMENT = 8192
CHUNK = 4096
RECORDS_PER_FILE = 8000
#: Rows of repeated payloads up to which they are broadcast (about 100 bytes each); beyond, a join.
FEW_REPEATED = 50_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def _uuid(page_id, digest: str) -> str:
    h = hashlib.md5(f"{page_id}|{digest}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def _record(kind: str, fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), *fields, ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head if v is not None) + b"\r\n" + block


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(x), x) for x in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        if len(out[-1]) != size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut short")
        at = end + 4 + size


def records_of(page_id, url: str | None, payload: bytes, refers_to, kind: str, segment: int = SEGMENT) -> list[bytes]:
    """The records of one page, in order."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    own = _uuid(page_id, digest)
    uri = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "")
    fields = [("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-ID", page_id)]
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _uuid(refers_to, digest)), ("Content-Type", "application/http; msgtype=response")]
        return [_record(kind, fields, HTTP)]
    block = HTTP + chunked(payload)
    fields.append(("Content-Type", "application/http; msgtype=response"))
    if len(block) <= segment:
        return [_record(kind, fields, block)]
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    out = [_record(kind, [*fields, ("WARC-Segment-Number", 1)], parts[0])]
    for n, part in enumerate(parts[1:], 2):
        out.append(_record("continuation", [("WARC-Record-ID", _uuid(f"{page_id}#{n}", digest)), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", len(block) if n == len(parts) else None)], part))
    return out


def _write_batches(segment: int):
    def run(batches):
        for batch in batches:
            out, size = [], 0
            for page_id, url, payload, first, repeated in zip(*(c.to_pylist() for c in batch.columns)):
                visit = repeated and first != page_id
                for x in records_of(page_id, url, payload, first if visit else None, "revisit" if visit else "response", segment):
                    out.append(x)
                    size += len(x)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    return run


def write_archive(pages: DataFrame, path: str, least_bytes: int = 0, segment: int = SEGMENT) -> None:
    """pages(page_id, url, html) as gzipped WARC files.

    Of pages with equal payloads of at least `least_bytes`, the one with the smallest page_id is
    written in full and the others revisit it.
    """
    spark = pages.sparkSession
    workers_can_import(spark)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), whole("html").cast("binary").alias("payload"))
    rows = rows.withColumn("_sha", F.sha1("payload"))
    large = rows.where(F.octet_length("payload") >= least_bytes).select("page_id", "_sha")
    repeated = written(large.groupBy("_sha").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_sha", "_first"), "repeated-payloads")
    few = repeated.count() <= FEW_REPEATED
    typed = rows.join(F.broadcast(repeated) if few else repeated, "_sha", "left")
    again = F.col("_first").isNotNull() & (F.octet_length("payload") >= least_bytes)
    made = typed.select("page_id", "url", "payload", F.col("_first"), again.alias("_again")).mapInArrow(_write_batches(segment), "value binary")
    made.select(F.col("value").cast("string")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parsed(data: bytes, damaged: bool = False):
    """(fields, block) of each record; names of fields in lower case. With damaged, what can't be read is a record
    of no fields, and the next one is looked for."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        first, *lines = data[at : max(end, at)].decode(errors="replace").split("\r\n")
        fields = {}
        for x in lines:
            name, _, value = x.partition(":")
            fields[name.strip().lower()] = value.strip()
        size = fields.get("content-length", "")
        block = data[end + 4 : end + 4 + int(size)] if size.isdigit() else b""
        if not first.startswith("WARC/") or not size.isdigit() or len(block) < int(size):
            if not damaged:
                raise ValueError(f"no record at byte {at}")
            yield {}, b""
            following = data.find(b"\r\n\r\nWARC/", at)
            at = following + 4 if following >= 0 else len(data)
            continue
        yield fields, block
        at = end + 4 + len(block) + 4


_PARTS = "page_id long, kind string, record_id string, refers_to string, digest string, uri string, n int, total long, block binary"
_WHOLE = "page_id long, record_type string, record_id string, refers_to string, digest string, uri string, payload binary"


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def _payload(kind: str, block: bytes, digest: str | None) -> bytes | None:
    """The payload of a whole block; None for a revisit. The digest must be right."""
    if kind == "revisit":
        return None
    head, _, body = block.partition(b"\r\n\r\n")
    if b"\r\ntransfer-encoding: chunked" in head.lower():
        body = dechunked(body)
    if digest and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
        raise ValueError(f"the payload doesn't have the digest {digest}")
    return body


def _or_damaged(kind: str, block: bytes, digest: str | None, damaged: bool) -> tuple[str, bytes | None]:
    """(kind, payload); the kind is `damaged` where the payload can't be had and that is allowed."""
    try:
        return kind, _payload(kind, block, digest)
    except (ValueError, IndexError):
        if not damaged:
            raise
        return "damaged", None


def _read_batches(segmented: bool, damaged: bool):
    schema = _schema(_PARTS if segmented else _WHOLE)

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                data = content.as_py()
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                rows = []
                for f, block in parsed(data, damaged):
                    if not f:
                        if not segmented:
                            rows.append((None, "damaged", None, None, None, None, None))
                        continue
                    part = "warc-segment-number" in f
                    kind = f["warc-type"]
                    if part != segmented or kind not in ("response", "revisit", "continuation", "resource"):
                        continue
                    page_id = f.get("x-page-id")
                    page_id = int(page_id) if page_id not in (None, "None", "") else None
                    digest = f.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    if segmented:
                        total = f.get("warc-segment-total-length")
                        rows.append((page_id, kind, f.get("warc-segment-origin-id") or f["warc-record-id"], f.get("warc-refers-to"), digest, f.get("warc-target-uri"), int(f["warc-segment-number"]), total and int(total), block))
                    else:
                        found, payload = _or_damaged(kind, block, digest, damaged)
                        rows.append((page_id, found, f["warc-record-id"], f.get("warc-refers-to"), digest, f.get("warc-target-uri"), payload))
                for lo in range(0, len(rows), 1000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows[lo : lo + 1000]), schema)], schema=schema)

    return run


def _join_batches(damaged: bool):
    schema = _schema(_WHOLE)

    def run(batches):
        for batch in batches:
            rows = []
            for page_id, kind, record_id, refers_to, digest, uri, copies, total, parts in zip(*(c.to_pylist() for c in batch.columns)):
                block = b"".join(x["block"] for x in parts)
                if kind is None or [x["n"] for x in parts] != list(range(1, len(parts) + 1)) or len(block) != total:
                    if not damaged:
                        raise ValueError(f"segments of {record_id} are missing")
                    rows += [(page_id, "damaged", record_id, refers_to, digest, uri, None)] * max(copies, 1)
                    continue
                found, payload = _or_damaged(kind, block, digest, damaged)
                rows += [(page_id, found, record_id, refers_to, digest, uri, payload)] * copies
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return run


def read_archive(spark: SparkSession, path: str, damaged: bool = False) -> DataFrame:
    """page_id, record_type, record_id, refers_to (a record's id), digest, uri, payload (null: revisit, damaged)."""
    workers_can_import(spark)
    files = spark.read.format("binaryFile").load(path).select("content")
    alone = files.mapInArrow(_read_batches(False, damaged), _WHOLE)
    parts = files.mapInArrow(_read_batches(True, damaged), _PARTS)
    head = F.col("n") == 1
    of_head = lambda c: F.max(F.when(head, F.col(c))).alias(c)
    grouped = parts.groupBy("record_id").agg(
        *[of_head(c) for c in ("page_id", "kind", "refers_to", "digest", "uri")],
        F.count_if(head).cast("int").alias("copies"),
        F.max("total").alias("total"),
        F.sort_array(F.collect_set(F.struct("n", "block"))).alias("parts"),
    )
    joined = grouped.select("page_id", "kind", "record_id", "refers_to", "digest", "uri", "copies", "total", "parts").mapInArrow(_join_batches(damaged), _WHOLE)
    return alone.unionByName(joined)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    rows = written(read_archive(spark, path).select("page_id", "record_type", "record_id", "refers_to", "digest", F.octet_length("payload").cast("long").alias("size")), "warc-records")
    full = rows.where("record_type = 'response'")
    visits = rows.where("record_type = 'revisit'")
    # Of responses that share an id (repeated rows), one answers.
    target = full.join(visits.select(F.col("refers_to").alias("record_id")).distinct(), "record_id", "left_semi").groupBy("record_id").agg(F.min("page_id").alias("_page"), F.min("size").alias("_size"))
    resolved = visits.join(target.withColumnRenamed("record_id", "refers_to"), "refers_to", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return full.select("page_id", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to")).unionByName(
        resolved.select("page_id", F.col("_size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.col("_page").alias("refers_to"))
    ).select(*columns)
