"""WARC archives: a writer with revisit records for equal payloads, and a reader that salvages what it can.

Archives are written through Spark's own writer, so they may lie in any file system that Spark knows: a row is one
record, and the row separator ends it. Compressed archives hold one gzip member a record and, as separator, an empty
gzip member; plain ones end each record with the two line ends that the format asks for.

The reader asks for what WARC requires: version, type, length and line ends. It checks gzip's own sums, and digests where
present and of a known algorithm; all record types pass. After a failed check it searches for the next gzip member or version
line at which a whole record starts, goes on from there, and reports the bytes in between as a gap row with offset,
length and reason. A search takes time in proportion to the bytes it passes. What comes out of a member whose sum fails is
suspect: such a record keeps its type and, where its digest holds, its payload, but neither ids nor url, which no sum
protects; it has no length of its own, as the gap row that follows covers the member's bytes. An archive is read whole by a task,
so one may take up to 2 GB.

Contract for odd input: a null payload is an empty one; a null url is left out; a row without an id is written without
one and, where its payload has been seen under an id, is a revisit. A row repeated whole is written as often, always
with the same type. Payloads may be of any length; an archive holds about archive_bytes of them, or one larger payload.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlemill.llm.common import bound_batches, new_path

MIN_REVISIT_BYTES, ARCHIVE_BYTES, DATE = 100, 32 << 20, "2024-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00" + bytes(8)
_CHUNK = 1 << 15
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
RECORD_SCHEMA = "archive string, offset long, length long, record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long, payload binary, gap string, suspect boolean"


def _urn(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id}/{digest}')}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A record without the two line ends that follow it."""
    block = _HTTP if revisit else _HTTP + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    if page_id is not None:
        head.append(f"X-Page: {page_id}")
    head += [f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block


def write_archives(pages: DataFrame, path: str, *, compress: bool = True, min_revisit_bytes: int = MIN_REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write a record for each row of pages (page_id, url, html) to archives below path.

    The rows' digests decide who revisits whom; payloads move once at most, by id and digest, so that a payload that
    very many pages share lies in many archives' revisit records but in no hot task.
    """
    spark = pages.sparkSession
    bound_batches(spark)
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("n", F.octet_length("payload"))
    rows = rows.withColumn("record", F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("/"), "digest"))
    light = rows.select("page_id", "digest", "n", "record").where(F.col("n") >= min_revisit_bytes)
    groups = light.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("members")).where("members > 1 and refers_to is not null")
    revisits = light.select("page_id", "digest", "record").distinct().join(groups, "digest").where("page_id is null or page_id > refers_to").select("record", "refers_to")
    total, count = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    records = max(1, math.ceil(count * archive_bytes / max(total, archive_bytes)))
    # A plain join by one key: where few payloads repeat it needs no exchange of the payloads, and a row repeated very often
    # makes a skewed partition that Spark splits. The number of records bounds the archives; they are no smaller than archive_bytes
    # asks for, save that every core has one, as a partition each makes many tiny files, for each of which executors start processes.
    typed = rows.join(revisits, "record", "left").coalesce(max(spark.sparkContext.defaultParallelism, math.ceil(total / archive_bytes)))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for r in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                made = record_bytes(r[0], r[1], r[2], r[3], r[4], r[4] is not None)
                if compress:
                    z = zlib.compressobj(6, zlib.DEFLATED, 31)
                    made = z.compress(made + b"\r\n\r\n") + z.flush()
                out.append(made)
                size += len(made)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    built = typed.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(build, "value binary")
    ends = _EMPTY_MEMBER.decode("latin-1") if compress else "\r\n\r\n"
    built.select(F.col("value").cast("string")).write.option("lineSep", ends).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", records).text(path)


def _agrees(digest: str, payload: bytes) -> bool:
    """Whether a labelled digest, in hex or base32, is the payload's; one of an unknown algorithm can't be told."""
    name, _, value = digest.partition(":")
    name = name.lower().replace("-", "")
    if name not in ("md5", "sha1", "sha256", "sha384", "sha512"):
        return True
    made = hashlib.new(name, payload)
    return value.lower() == made.hexdigest() or value.upper().rstrip("=") == base64.b32encode(made.digest()).decode().rstrip("=")


_VERSION = re.compile(rb"WARC/1\.[0-9]{1,3}\r\n")


class _Seen:
    """What earlier attempts have found, so that many false starts before one header cost no more than one of them: the next
    blank line, and up to which place any start before it fails as the last one did."""

    def __init__(self) -> None:
        self.blank, self.stop, self.until, self.why = -1, -1, -1, ""


def _header(data: bytes, at: int, stop: int) -> tuple[dict[str, str], dict[str, int]]:
    """Fields, and where the line of each begins; ValueError with the place of the first line that is none."""
    fields: dict[str, str] = {}
    where: dict[str, int] = {}
    last = ""
    while at < stop:
        end = data.find(b"\r\n", at, stop)
        end = stop if end < 0 else end
        line = data[at:end]
        if line[:1] in (b" ", b"\t") and last:  # a folded line
            fields[last] += " " + line.strip().decode("utf-8", "replace")
        else:
            name, colon, value = line.partition(b":")
            if not colon:
                raise ValueError(at)
            last = name.strip().lower().decode("latin-1")
            fields[last], where[last] = value.strip().decode("utf-8", "replace"), at
        at = end + 2
    return fields, where


#: The fields that a record's checks read.
_READ = ("content-length", "warc-type", "content-type", "warc-payload-digest", "warc-segment-number", "x-payload-length", "x-page", "x-refers-to-page")


def _record(data: bytes, at: int, seen: _Seen) -> tuple[dict, int]:
    """The record that starts at data[at] and the position after it; ValueError says which check failed."""
    m = _VERSION.match(data, at)
    if m is None:
        raise ValueError("no version line")
    first = m.end()
    if seen.blank < first - 2:
        found = data.find(b"\r\n\r\n", first - 2)
        seen.blank = len(data) if found < 0 else found
    stop = seen.blank
    if stop == len(data):
        raise ValueError("header without end")
    if stop == seen.stop and first <= seen.until:  # the same lines decide
        raise ValueError(seen.why)
    try:
        fields, where = _header(data, first, stop)
    except ValueError as e:
        seen.stop, seen.until, seen.why = stop, e.args[0], "bad header line"
        raise ValueError(seen.why) from None
    try:
        return _body(data, stop, fields)
    except ValueError as e:
        seen.stop, seen.until, seen.why = stop, min((where[f] for f in _READ if f in where), default=stop), str(e)
        raise


def _body(data: bytes, stop: int, fields: dict[str, str]) -> tuple[dict, int]:
    try:
        length, kind = int(fields["content-length"]), fields["warc-type"]
        digest, size = fields.get("warc-payload-digest"), fields.get("x-payload-length")
        out = {
            "record_type": kind, "url": fields.get("warc-target-uri"), "payload_digest": digest and digest.removeprefix("sha256:"), "payload_bytes": int(size) if size else None,
            "page_id": int(fields["x-page"]) if "x-page" in fields else None, "refers_to": int(fields["x-refers-to-page"]) if "x-refers-to-page" in fields else None,
        }
    except (KeyError, ValueError):
        raise ValueError("bad or missing header field") from None
    block = data[stop + 4 : stop + 4 + length]
    end = stop + 4 + length
    if length < 0 or len(block) < length:
        raise ValueError("record cut off")
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("no line ends after the record")
    if kind != "revisit":  # the digest of a revisit is that of a payload elsewhere
        http = fields.get("content-type", "").lower().startswith("application/http")
        head, _, body = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
        # Of encoded transfers and segments writers take digests of other bytes than these.
        plain = b"transfer-encoding:" not in head.lower() and "warc-segment-number" not in fields
        if out["payload_bytes"] not in (None, len(body)) or (plain and digest and not _agrees(digest, body)):
            raise ValueError("payload differs from its digest")
        out |= {"payload": body, "payload_bytes": len(body)}
    return out, end + 4


def _member(data: bytes, at: int) -> tuple[list[dict], int | None, str]:
    """The whole records of the gzip member that starts at data[at], the position after it (None where it is broken or
    cut off) and the first fault."""
    z, parts, end, why = zlib.decompressobj(31), [], at, ""
    try:
        while not z.eof and end < len(data):
            parts.append(z.decompress(data[end : end + _CHUNK]))
            end = min(end + _CHUNK, len(data))
    except zlib.error as e:
        why = f"bad member: {e}"
        z, parts = zlib.decompressobj(31), []
        try:  # once more, the failing chunk byte by byte, for what comes out before the fault
            if end > at:
                parts.append(z.decompress(data[at:end]))
            for i in range(end, min(end + _CHUNK, len(data))):
                parts.append(z.decompress(data[i : i + 1]))
        except zlib.error:
            pass
    after = None
    if not why and z.eof:
        after = end - len(z.unused_data)
    plain, found, i, seen = b"".join(parts), [], 0, _Seen()
    why = why or ("" if after else "member cut off")
    while 0 <= i < len(plain):
        try:
            r, i = _record(plain, i, seen)
            found.append(r)
        except ValueError as e:
            why = why or str(e)
            i = plain.find(b"WARC/1.", i + 1)
    return found, after, why


_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.")


def salvage(data: bytes) -> Iterator[dict]:
    """Records and gaps of an archive, in order; their offsets and lengths cover all its bytes but empty members, each
    once; the records of one member share its place."""
    at, bad, why, seen = 0, None, "", _Seen()
    while at < len(data):
        try:
            if data.startswith(b"\x1f\x8b\x08", at):
                found, end, fault = _member(data, at)
                if fault and not found:
                    raise ValueError(fault)
            else:
                one, end = _record(data, at, seen)
                found, fault = [one], ""
        except ValueError as e:
            if bad is None:
                bad, why = at, str(e)
            m = _START.search(data, at + 1)
            at = m.start() if m else len(data)
            continue
        if bad is not None:
            yield {"offset": bad, "length": at - bad, "gap": why}
            bad = None
        m = None if end else _START.search(data, at + 1)
        end = end or (m.start() if m else len(data))
        for r in found:
            yield r | ({"offset": at, "length": 0, "suspect": True, "page_id": None, "url": None, "refers_to": None} if fault else {"offset": at, "length": end - at, "suspect": False})
        if fault:
            yield {"offset": at, "length": end - at, "gap": fault}
        at = end
    if bad is not None:
        yield {"offset": bad, "length": len(data) - bad, "gap": why}


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives below path, and one for each gap: see RECORD_SCHEMA; gap is null for records."""
    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
    types = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}[x.split()[1]] for x in RECORD_SCHEMA.split(", ")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types, strict=True)], names)

        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                rows, size = [], 0
                for r in salvage(content.as_py()):
                    rows.append(r | {"archive": name.as_py()})
                    size += len(r.get("payload") or b"") + 200
                    if size > 4 << 20:
                        yield made(rows)
                        rows, size = [], 0
                yield made(rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, RECORD_SCHEMA)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write pages to archives in the shared folder and read them back."""
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path, **options)
    return read_archives(pages.sparkSession, path)
