"""Legacy web archives (ARC 1 and 2) converted to WARC 1.1.

An ARC file starts with a ``filedesc`` record that names its version and fields; each record is one
header line, as many bytes as the line declares, and a line end. Fields are read from the right, so
an address with blanks stays whole. A header line that can't be read, or a length that runs past
the end, makes the parser move on to the next line that reads as a header; what was skipped is
counted on the next record. A converted record gets a name-based identifier, the time in ISO form,
a type (``response`` for HTTP messages, ``resource`` for others), and SHA-256 digests of block and
payload.

Archives are written by Spark's own text writer, one gzip file for each partition, with the two line
ends that close a WARC record as its separator, and read back as binary files by declared length.

Cases: a null payload is empty. A null id is read back as null and loses to any other; rows that repeat
an id are records of their own, and of equal payloads one row of the smallest id is the response. An
empty table gives no records.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelake.llm.common import _ARROW, materialize, scratch, shuffles_freed, small_batches, small_side

FIELDS = {
    1: ["url", "ip", "date", "type", "length"],
    2: ["url", "ip", "date", "type", "status", "checksum", "location", "offset", "filename", "length"],
}
NAMES = {
    1: b"URL IP-address Archive-date Content-type Archive-length",
    2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
LEAST_PAYLOAD = 100
SEGMENT = 4 << 20
CRLF = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def arc_start(version: int, name: str = "segment.arc") -> bytes:
    body = b"%d 0 wirelake\n%s\n" % (version, NAMES[version])
    tail = b"" if version == 1 else b" 200 - - 0 " + name.encode()
    return b"filedesc://%s 0.0.0.0 20240101000000 text/plain%s %d\n%s\n" % (name.encode(), tail, len(body), body)


def arc_record(version: int, url: str, ip: str, date: str, kind: str, content: bytes, status: int = 200, name: str = "segment.arc", offset: int = 0) -> bytes:
    tail = b"" if version == 1 else b" %d - - %d %s" % (status, offset, name.encode())
    return b"%s %s %s %s%s %d\n%s\n" % (url.encode(), ip.encode(), date.encode(), kind.encode(), tail, len(content), content)


def _header(line: bytes, version: int) -> dict | None:
    """Fields of a header line, or None if it isn't one."""
    names = FIELDS[version]
    parts = line.rsplit(b" ", len(names) - 1)
    if len(parts) != len(names) or not parts[-1].isdigit() or not re.fullmatch(rb"\d{8,14}", parts[names.index("date")]) or b":" not in parts[0]:
        return None
    return {k: v.decode("utf-8", "replace") for k, v in zip(names, parts, strict=True)} | {"length": int(parts[-1])}


def parse_arc(data: bytes):
    """Yield (offset, fields, content) of each record; fields has version and skipped."""
    version, at, skipped = 1, 0, 0
    while at < len(data):
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        line = data[at:end].rstrip(b"\r")
        if not line:
            at = end + 1
            continue
        own = next((h for v in (version, 3 - version) if (h := _header(line, v))), None) if line.startswith(b"filedesc://") else _header(line, version)
        if own is None or end + 1 + own["length"] > len(data):
            skipped += end + 1 - at
            at = end + 1
            continue
        content = data[end + 1 : end + 1 + own["length"]]
        if line.startswith(b"filedesc://"):
            version = 2 if content[:1] == b"2" else 1
        else:
            yield at, own | {"version": version, "skipped": skipped}, content
            skipped = 0
        at = end + 1 + own["length"]


def iso_date(date: str) -> str:
    d = (date + "00000101000000"[len(date) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """(head with its blank line, payload) of an HTTP message; no head for anything else."""
    if not content.startswith(b"HTTP/"):
        return b"", content
    cut = re.search(rb"\r?\n\r?\n", content)
    return (content[: cut.end()], content[cut.end() :]) if cut else (content, b"")


def converted(segment: str, data: bytes) -> list[dict]:
    """WARC fields of each record of one ARC file's bytes."""
    out = []
    for at, own, content in parse_arc(data):
        head, payload = split_http(content)
        out.append({
            "record_id": f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{segment}#{at}')}", "url": own["url"], "date": iso_date(own["date"]), "ip": own["ip"],
            "kind": own["type"], "is_http": bool(head), "head": head, "payload": payload, "digest": hashlib.sha256(payload).hexdigest(), "bytes": len(payload),
        })
    return out


def warc_record(kind: str, fields: dict[str, str], block: bytes) -> bytes:
    """One record without the two line ends that close it."""
    lines = {"WARC-Type": kind} | fields | {"WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()).encode() + CRLF + block


def parse_warc(data: bytes):
    """Yield (fields with lower-case names, block) of each record, by declared length."""
    at = 0
    while True:
        at = data.find(b"WARC/1.", at)
        if at < 0:
            return
        end = data.index(b"\r\n\r\n", at)
        fields = {}
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            k, _, v = line.partition(": ")
            fields[k.lower()] = v
        n = int(fields["content-length"])
        yield fields, data[end + 4 : end + 4 + n]
        at = end + 4 + n


def pages_to_arc(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """(segment, data): ARC bytes of at most about SEGMENT each; the id travels as an HTTP header, ``-`` for a null one."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string").cast("binary"), F.lit(b"")).alias("payload"))

    def fit(batches):
        task, number, data, size, version = TaskContext.get().partitionId(), 0, [], 0, 1

        def done():
            return pa.RecordBatch.from_arrays([pa.array([f"pages-{task}-{number}"]), pa.array([b"".join(data)], pa.binary())], names=["segment", "data"])

        for batch in batches:
            for i, url, payload in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "payload")), strict=True):
                if not data:
                    version = 1 + number % 2
                    data, size = [arc_start(version)], 0
                name = b"-" if i is None else b"%d" % i
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Record-Key: %s\r\nContent-Length: %d\r\n\r\n" % (name, len(payload))
                data.append(arc_record(version, re.sub(r"[\r\n]", "", url or "") if ":" in (url or "") else f"urn:page:{name.decode()}", "192.0.2.1", "20240115093000", "text/html", head + payload, offset=size))
                size += len(data[-1])
                if size >= SEGMENT:
                    yield done()
                    number, data = number + 1, []
        if data:
            yield done()

    return rows.mapInArrow(fit, "segment string, data binary")


def key_of(head: bytes) -> int | None:
    key = re.search(rb"(?im)^X-Record-Key: (-?\d+)\r?$", head)
    return int(key[1]) if key else None


def _batch(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], type=_ARROW[_KINDS[n]]) for n in names], names=names)


#: The columns of records and their types.
_KINDS = {
    "record_id": "string", "url": "string", "date": "string", "ip": "string", "kind": "string", "is_http": "boolean", "head": "binary", "payload": "binary", "digest": "string",
    "bytes": "long", "key": "long", "record_type": "string", "payload_bytes": "long", "refers_to_id": "string",
}


def _schema(names: list[str]) -> str:
    return ", ".join(f"{n} {_KINDS[n]}" for n in names)


def convert(segments: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of ARC segments (segment, data); key is the X-Record-Key header, or null."""
    names = ["record_id", "url", "date", "ip", "kind", "is_http", "head", "payload", "digest", "bytes", "key"]
    keep = [n for n in names if with_payload or n not in ("payload", "head", "kind", "ip")]

    def fit(batches):
        for batch in batches:
            for segment, data in zip(batch.column("segment").to_pylist(), batch.column("data").to_pylist(), strict=True):
                yield _batch([r | {"key": key_of(r["head"])} for r in converted(segment, data)], keep)

    return segments.mapInArrow(fit, _schema(keep))


FIRSTS = 100_000


def mark_revisits(records: DataFrame, narrow: DataFrame, least: int = LEAST_PAYLOAD) -> DataFrame:
    """records with first (record_id, url, date of the response) where they revisit an earlier key's payload.

    narrow has (key, record_id, url, date, digest, bytes) of the same records without their payload;
    the first of each digest that repeats is pre-aggregated, written, and broadcast while there are at
    most ``FIRSTS`` of them, so payloads aren't shuffled. A null key loses to any other.
    """
    low = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "record_id", "url", "date")).alias("first")
    firsts = narrow.where(F.col("bytes") >= least).groupBy("digest").agg(low, F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("digest").alias("f_digest"), "first.record_id", "first.url", "first.date")
    firsts = small_side(materialize(firsts.select("f_digest", F.struct("record_id", "url", "date").alias("first")), "firsts"), FIRSTS)
    joined = records.join(firsts, F.col("digest") == F.col("f_digest"), "left")
    return joined.withColumn("first", F.when((F.col("bytes") >= least) & (F.col("first.record_id") != F.col("record_id")), F.col("first"))).drop("f_digest")


def write_archives(records: DataFrame, path: str) -> None:
    """Write marked records as gzip WARC files, one for each partition, a warcinfo record first."""

    def fit(batches):
        out = [warc_record("warcinfo", {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, path)}>", "WARC-Date": "2024-01-15T09:30:00Z", "Content-Type": "application/warc-fields"}, b"software: wirelake\r\nformat: WARC File Format 1.1\r\n")]
        for batch in batches:
            for r in batch.to_pylist():
                fields = {"WARC-Record-ID": f"<{r['record_id']}>", "WARC-Target-URI": r["url"], "WARC-Date": r["date"], "WARC-IP-Address": r["ip"], "WARC-Payload-Digest": f"sha256:{r['digest']}"}
                kind, block, f = ("response" if r["is_http"] else "resource"), r["head"] + r["payload"], r["first"]
                if f is not None:
                    fields |= {"WARC-Refers-To": f"<{f['record_id']}>", "WARC-Refers-To-Target-URI": f["url"], "WARC-Refers-To-Date": f["date"], "WARC-Profile": PROFILE}
                    kind, block = "revisit", r["head"]
                fields["Content-Type"] = "application/http; msgtype=response" if r["is_http"] else r["kind"]
                out.append(warc_record(kind, fields, block))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
            out = []

    spark = records.sparkSession
    with shuffles_freed(spark):
        records.mapInArrow(fit, "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def read_archives(spark, path: str) -> DataFrame:
    """(record_id, record_type, url, date, digest, payload_bytes, refers_to_id, key) of every record but warcinfo."""
    names = ["record_id", "record_type", "url", "date", "digest", "payload_bytes", "refers_to_id", "key"]

    def fit(batches):
        for batch in batches:
            for content in batch.column("content").to_pylist():
                out = []
                for f, block in parse_warc(zlib.decompress(content, 31) if content[:2] == b"\x1f\x8b" else content):
                    if f["warc-type"] == "warcinfo":
                        continue
                    head, payload = split_http(block)
                    size = re.search(rb"(?im)^Content-Length: (\d+)", head)
                    revisit = f["warc-type"] == "revisit"
                    digest = f["warc-payload-digest"].removeprefix("sha256:")
                    if not revisit and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"payload of {f['warc-record-id']} doesn't match its digest")
                    out.append({
                        "record_id": f["warc-record-id"].strip("<>"), "record_type": f["warc-type"], "url": f["warc-target-uri"], "date": f["warc-date"], "digest": digest,
                        "payload_bytes": int(size[1]) if revisit and size else len(payload), "refers_to_id": f.get("warc-refers-to", "").strip("<>") or None, "key": key_of(head),
                    })
                yield _batch(out, names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(fit, _schema(names))


def convert_pages(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Pages as ARC, converted to WARC files below path, and read back."""
    segments = pages_to_arc(pages, id_col, url_col, payload_col)
    write_archives(mark_revisits(convert(segments), convert(segments, with_payload=False)), path)
    return read_archives(pages.sparkSession, path)


def query(spark, sf_dir: str) -> DataFrame:
    got = convert_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch(spark, "warc"))
    targets = got.where("record_type <> 'revisit'").select(F.col("record_id").alias("target"), F.col("key").alias("refers_to"))
    wanted = got.where("refers_to_id is not null").select(F.col("refers_to_id").alias("target")).distinct()
    targets = small_side(materialize(targets.join(small_side(materialize(wanted, "wanted"), FIRSTS), "target", "left_semi"), "targets"), FIRSTS)
    return got.join(targets, F.col("refers_to_id") == F.col("target"), "left").select(F.col("key").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h) AS n, sha256(h) AS d, min(page_id) OVER (PARTITION BY sha256(h)) AS f FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 100 AND f <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND f <> page_id THEN f END AS refers_to
FROM q
"""
