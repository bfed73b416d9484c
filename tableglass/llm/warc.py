"""WARC archives written as Spark text files, and a reader that salvages what it can from damaged ones."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tableglass.llm.common import lookup, small_batches, stored

CRLF = "\r\n"
FILE_BYTES = 32 << 20  # of an archive, about; one file is one row when it is read
BROADCAST_ROWS = 200_000  # revisits are broadcast up to so many rows of some 120 bytes, and shuffled beyond
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = ("kind string, file string, offset bigint, length bigint, reason string, type string, record_id string, target_uri string, "
           "refers_to string, payload_bytes bigint, payload_digest string, payload binary")


# ---------------------------------------------------------------- writing

def _revisits(pages: DataFrame, least: int) -> tuple[DataFrame, int, int]:
    """(id, digest, keep) of the pages whose payload a page with a larger id has too; the number of pages and of bytes."""
    facts = stored(pages.select("id", F.octet_length("payload").alias("bytes"), F.sha2(F.col("payload").cast("binary"), 256).alias("digest")), "payloads")
    total, size = facts.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    large = facts.filter(F.col("bytes") >= least).select("id", "digest")
    groups = large.groupBy("digest").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    found = lookup(large, groups, ["digest"], "n", total).filter("NOT id <=> keep").select("id", "digest", "keep").distinct()
    return stored(found, "revisits"), total, size


def _header(*lines: tuple[str, Column]) -> Column:
    """Header lines; one whose value is null is left out."""
    return F.concat(*[F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit("")) for name, value in lines])


def write_archives(pages: DataFrame, path: str, url: str = "url", payload: str = "html", id_col: str = "page_id",
                   revisit_bytes: int = 1000, date: str = "2000-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> None:
    """A WARC/1.1 record for each page, in files below ``path``: a response, or a revisit without payload where a page with a
    larger id has the same payload of at least ``revisit_bytes`` bytes.

    A null payload is empty; a null id is smaller than all others and written as ``null``; of repeated rows with the largest id
    each is a response. Line breaks in a url are percent-encoded, a null url is left out. Other columns are not read; an
    empty table writes no record. The payloads are not shuffled unless there are more than ``BROADCAST_ROWS`` revisits. The
    records are text rows with CRLF as line separator, so that any file system Spark writes to will do.
    """
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    pages = pages.select(F.col(id_col).alias("id"), F.col(url).alias("url"), body.alias("payload"))
    revisits, total, size = _revisits(pages, revisit_bytes)
    few = revisits.count() <= BROADCAST_ROWS
    other = revisits.select(F.col("id").alias("other_id"), F.col("digest").alias("other_digest"), "keep", F.lit(True).alias("revisit"))
    rows = pages.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    rows = rows.join(F.broadcast(other) if few else other,
                     (F.col("digest") == F.col("other_digest")) & F.col("id").eqNullSafe(F.col("other_id")), "left")
    again = F.coalesce("revisit", F.lit(False))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF), _header(
        ("Content-Type", F.lit("text/html; charset=utf-8")), ("Content-Length", F.octet_length("payload").cast("string"))), F.lit(CRLF))
    rows = rows.withColumn("block", F.when(again, http).otherwise(F.concat(http, F.col("payload"))))
    record = F.concat(F.lit("WARC/1.1" + CRLF), _header(
        ("WARC-Type", F.when(again, "revisit").otherwise("response")), ("WARC-Record-ID", name("id")), ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        ("WARC-Profile", F.when(again, PROFILE)), ("WARC-Refers-To", F.when(again, name("keep"))),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.sha1("payload"))), ("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.sha1("block"))),
        ("Content-Type", F.lit("application/http; msgtype=response")), ("Content-Length", F.octet_length("block").cast("string"))),
        F.lit(CRLF), F.col("block"), F.lit(CRLF))
    per_file = max(1, int(file_bytes * total / max(size, 1)))
    rows.select(record.alias("value")).write.option("lineSep", CRLF).option("maxRecordsPerFile", per_file).text(path)


# ---------------------------------------------------------------- reading

VERSION = re.compile(rb"WARC/1\.[01]\r?\n|\x1f\x8b\x08")
LINE = re.compile(rb"WARC/1\.[01]\r?\n")


def _sha1_of(label: str | None) -> str | None:
    """Hex of a digest label ``sha1:...`` in hex or base 32; None for other kinds."""
    kind, _, value = (label or "").partition(":")
    if kind.lower() != "sha1":
        return None
    try:
        return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()
    except ValueError:
        return "?"


def parse_record(data: memoryview, at: int) -> tuple[int, dict[str, str], memoryview]:
    """(end, headers, block) of the plain record at ``at``; ValueError names the check that failed."""
    raw = data.obj
    if not re.compile(rb"WARC/1\.[01]\r?\n").match(raw, at):
        raise ValueError("no version line")
    first = raw.find(b"\n", at) + 1
    headers, begin = {}, first
    while True:  # only CR LF or LF ends a line, whatever else a url may hold
        stop = raw.find(b"\n", begin)
        if stop < 0:
            raise ValueError("header without end")
        line, begin = raw[begin:stop].removesuffix(b"\r"), stop + 1
        if not line:
            break
        key, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon:
            raise ValueError("bad header line")
        key = key.strip(" \t").lower()
        if key in headers and key != "warc-concurrent-to":
            raise ValueError("repeated header")
        headers[key] = value.strip(" \t")
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise ValueError("no content length")
    end = begin + int(length)
    if end > len(raw):
        raise ValueError("truncated")
    block = data[begin:end]
    wanted = _sha1_of(headers.get("warc-block-digest"))
    if wanted and hashlib.sha1(block).hexdigest() != wanted:
        raise ValueError("block digest differs")
    tail = re.compile(rb"\r\n\r\n|\n\n").match(raw, end)
    if not tail:
        raise ValueError("no record end")
    wanted = _sha1_of(headers.get("warc-payload-digest"))
    if wanted and headers.get("warc-type") != "revisit" and hashlib.sha1(_payload(headers, block)[0]).hexdigest() != wanted:
        raise ValueError("payload digest differs")
    return tail.end(), headers, block


STEP, FINE_STEP = 1 << 20, 64  # compressed bytes unpacked at a time, and before the place of an error


def unpack(data: memoryview, at: int) -> tuple[bytes, int, str]:
    """(what the gzip member at ``at`` holds, its end, what is wrong with it or ""). Of a cut or damaged member all that can be
    unpacked; its end is then where that ended. One whose check sum differs holds nothing that can be relied on."""
    member, parts, part = zlib.decompressobj(31), [], at
    while not member.eof:
        if part >= len(data):
            return b"".join(parts), len(data), "truncated member"
        step, before = data[part:part + STEP], member.copy()
        try:
            parts.append(member.decompress(step))
            part += len(step)
        except zlib.error as e:
            if "check" in str(e):
                return b"", part, "bad member"
            for i in range(0, len(step), FINE_STEP):
                try:
                    parts.append(before.decompress(step[i:i + FINE_STEP]))
                except zlib.error:
                    return b"".join(parts), part + i, "bad member"
    return b"".join(parts), part - len(member.unused_data), ""


def _plain(data: memoryview, version: re.Pattern) -> Iterator[tuple]:
    """("record", offset, length, headers, block) and ("gap", offset, length, reason) of plain records; where ``version`` finds
    something else than a record, what stands there is looked at by :func:`_member`."""
    at, gap, reason = 0, None, ""
    while at < len(data):
        try:
            if bytes(data[at:at + 3]) == b"\x1f\x8b\x08" and version is VERSION:
                end, found, rest = _member(data, at)
            else:
                end, headers, block = parse_record(data, at)
                found, rest = [("record", at, end - at, headers, block)], ""
        except ValueError as e:
            if gap is None:
                gap, reason = at, str(e)
            following = version.search(data.obj, at + 1)
            at = following.start() if following else len(data)
            continue
        if gap is not None:
            yield "gap", gap, at - gap, reason
        yield from found
        gap, reason, at = (None, "", end) if not rest else (end, rest, end)
        if rest:  # the member's end isn't known: on to what comes next
            following = version.search(data.obj, at)
            at = following.start() if following else len(data)
            if at == gap:
                gap = None
    if gap is not None and gap < len(data):
        yield "gap", gap, len(data) - gap, reason


def _member(data: memoryview, at: int) -> tuple[int, list[tuple], str]:
    """(end, records and gaps, what is wrong with the rest) of the gzip member at ``at``. A gap inside stands at the member's place in the
    file, and its reason names the unpacked bytes. Of a damaged member only records that carry a digest are taken."""
    unpacked, end, wrong = unpack(data, at)
    if not unpacked:
        raise ValueError(wrong or "empty member")
    sure = lambda h: wrong != "bad member" or h.get("warc-block-digest") or h.get("warc-payload-digest")
    found, first = [], "no record"
    for kind, begin, length, *more in _plain(memoryview(unpacked), LINE):
        if kind == "record" and sure(more[0]):
            found.append((kind, at, end - at, *more))
        else:
            reason = more[0] if kind == "gap" else "record without digest in a bad member"
            first = reason if first == "no record" else first
            found.append(("gap", at, end - at, f"{reason} (unpacked bytes {begin} to {begin + length} of a member)"))
    if not any(x[0] == "record" for x in found):
        raise ValueError(wrong or first)
    return end, found, wrong


def salvage(content: bytes) -> Iterator[tuple]:
    """("record", offset, length, headers, block) and ("gap", offset, length, reason): every byte belongs to one of them.

    Where a check fails, the bytes up to the next version line or gzip member that passes are a gap. Inside a gzip member the
    same holds for its unpacked bytes: records beside a damaged one, and those before a cut or an error in the
    compressed bytes, are found.
    """
    yield from _plain(memoryview(content), VERSION)


def _payload(headers: dict[str, str], block: memoryview) -> tuple[memoryview, int | None]:
    """The payload, and its length as the HTTP header has it."""
    if not headers.get("content-type", "").startswith("application/http"):
        return block, None
    size, stop, raw = 1 << 14, -1, b""
    while stop < 0 and len(raw) < len(block):  # a header of any length
        size *= 4
        raw = bytes(block[:size])
        stop = raw.find(b"\r\n\r\n")
    if stop < 0:
        return block, None
    said = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", raw[:stop])
    return block[stop + 4:], int(said[1]) if said else None


def _rows(file: str, content: bytes, with_payload: bool) -> Iterator[tuple]:
    for kind, at, length, *more in salvage(content):
        if kind == "gap":
            yield (kind, file, at, length, more[0], *[None] * 7)
            continue
        headers, block = more
        payload, said = _payload(headers, block)
        revisit = headers.get("warc-type") == "revisit"
        digest, wanted = hashlib.sha1(payload).hexdigest(), _sha1_of(headers.get("warc-payload-digest"))
        yield ("record", file, at, length, None, headers.get("warc-type"), headers.get("warc-record-id"), headers.get("warc-target-uri"),
               headers.get("warc-refers-to"), said if revisit else len(payload), wanted if revisit else digest,
               bytes(payload) if with_payload else None)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records and the quarantined gaps of all archives (plain or gzip by member) at ``path``.

    Columns: kind (record or gap), file, offset and length of its bytes in the file, reason of a gap, type, record_id, target_uri,
    refers_to, payload_bytes, payload_digest (SHA-1, hex; of a revisit as its header has it), payload. A record passes if its
    version line, header, length, block digest, end and payload digest are right; records after a damaged one are found again
    at the next version line or gzip member that passes, inside gzip members too (offset and length are then the member's). Each file is one row of one task, so keep archives at some tens of MB
    (``write_archives`` does); an empty file has no rows.
    """
    small_batches(spark)
    kinds = [f.split()[1] for f in RECORDS.split(", ")]
    types = [{"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[k] for k in kinds]
    names = [f.split()[0] for f in RECORDS.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1)):
                rows, size = [], 0
                for row in _rows(file.as_py(), content.as_py(), with_payload):
                    rows.append(row)
                    size += len(row[-1] or b"")
                    if size > 8 << 20 or len(rows) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(read, RECORDS)
