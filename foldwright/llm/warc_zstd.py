"""Web archives whose records are single Zstandard frames behind a shared dictionary.

An archive is a skippable frame that holds the dictionary, then one frame for each record. Spark's text writer puts
the frames of a partition into files with its own commit protocol; the line separator that it sets after each frame is
an empty skippable frame, which every reader of such files skips. A file holds ``ARCHIVE_ROWS`` frames at most and
starts with the dictionary.

Pages with equal payloads of ``REVISIT_BYTES`` or more are stored once: the page with the largest id keeps the payload
(``response``) and the others refer to it (``revisit``). Equality is that of SHA-256; records carry SHA-1.

Defined results: null html is an empty payload; a null url leaves its header out; line breaks and control characters
of a url are percent-encoded; a null page_id is kept and is never referred to unless all equal pages have none;
repeated rows of the largest id are all responses; an empty table gives no archive and an empty result. Other columns
are not read.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.llm.common import bounded_batches, bounded_sample, materialize, scratch_path

#: Fixed values of the file format: the magic numbers of dictionary, separator, dictionary body and record frame.
DICTIONARY_MAGIC, SEPARATOR_MAGIC, BODY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0x184D2A50, 0xEC30A437, 0xFD2FB528
SEPARATOR = struct.pack("<II", SEPARATOR_MAGIC, 0).decode("ascii")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REVISIT_BYTES = 1000
ARCHIVE_ROWS = 4096
#: The dictionary is fitted on so many pages, and on so many characters of each.
DICTIONARY_PAGES, DICTIONARY_CHARS, DICTIONARY_BYTES = 400, 4096, 32768
DATE = "2024-01-01T00:00:00Z"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, valid boolean"


def fit_dictionary(pages: DataFrame, n_pages: int = DICTIONARY_PAGES) -> bytes:
    """A dictionary from a bounded sample of pages; empty if the sample is too small to train one."""
    sample = (bounded_sample(pages.select("page_id", "html").where(F.length("html") > 0), n_pages, "page_id")
              .select(F.substring("html", 1, DICTIONARY_CHARS).alias("html")).collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [r["html"].encode() for r in sample]).as_bytes()
    except zstandard.ZstdError:
        return b""


def record_name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(name: str) -> int | None:
    match = re.fullmatch(r"<urn:page:(-?\d*)>", name)
    if not match:
        raise ValueError(f"no page in {name!r}")
    return int(match[1]) if match[1] else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record with its header; a revisit keeps the HTTP header of the full payload and drops the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_name(page_id)}",
            f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response",
            f"Content-Length: {len(block)}"]
    if url is not None:
        safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        head.append(f"WARC-Target-URI: {safe}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_name(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that starts at ``at`` ends, from its header and the lengths of its blocks."""
    head = zstandard.get_frame_parameters(data[at:at + 18])
    at += zstandard.frame_header_size(data[at:at + 18])
    last = False
    while not last:
        if at + 3 > len(data):
            raise ValueError("a frame is cut off")
        field = int.from_bytes(data[at:at + 3], "little")
        last, kind, size = bool(field & 1), field >> 1 & 3, field >> 3
        at += 3 + (1 if kind == 1 else size)
    at += 4 * head.has_checksum
    if at > len(data):
        raise ValueError("a frame is cut off")
    return at


def frames(data: memoryview) -> Iterator[bytes]:
    """The records of an archive, decoded one frame at a time with the dictionary in its leading skippable frame."""
    at, reader = 0, zstandard.ZstdDecompressor()
    while at < len(data):
        magic = int.from_bytes(data[at:at + 4], "little")
        if magic & 0xFFFFFFF0 == SEPARATOR_MAGIC:
            size = int.from_bytes(data[at + 4:at + 8], "little")
            if at + 8 + size > len(data):
                raise ValueError("a skippable frame is cut off")
            if magic == DICTIONARY_MAGIC:
                if at:
                    raise ValueError("the dictionary does not lead the archive")
                body = bytes(data[8:8 + size])
                if int.from_bytes(body[:4], "little") == FRAME_MAGIC:
                    body = zstandard.ZstdDecompressor().decompress(body)
                if int.from_bytes(body[:4], "little") != BODY_MAGIC:
                    raise ValueError("the leading frame holds no dictionary")
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body))
            at += 8 + size
        elif magic == FRAME_MAGIC:
            end = frame_end(data, at)
            yield reader.decompress(bytes(data[at:end]))
            at = end
        else:
            raise ValueError(f"no frame at byte {at}")


def headers(lines: bytes) -> tuple[str, dict[str, str]]:
    first, *rest = lines.decode().split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in rest)}


def read_record(data: bytes) -> dict:
    """The fields of a record. ``valid``: version, mandatory headers, lengths and the payload's digest are right."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, fields = headers(head)
    block = rest[:-4]
    http, _, payload = block.partition(b"\r\n\r\n")
    status, answer = headers(http)
    kind, size = fields["warc-type"], int(answer["content-length"])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    valid = (version == "WARC/1.1" and status.startswith("HTTP/1.1 ") and rest.endswith(b"\r\n\r\n")
             and int(fields["content-length"]) == len(block) and "warc-date" in fields)
    if kind == "response":
        valid &= len(payload) == size and hashlib.sha1(payload).hexdigest() == digest
    else:
        valid &= not payload and fields.get("warc-profile") == PROFILE and "warc-refers-to" in fields
    return {"page_id": page_of(fields["warc-record-id"]), "payload_bytes": size, "payload_digest": digest, "record_type": kind,
            "refers_to": page_of(fields["warc-refers-to"]) if kind == "revisit" else None, "valid": valid}


def with_roles(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, html, digest, same (number of equal large payloads is over one), keeper (their largest id)."""
    html = F.coalesce("html", F.lit(""))
    pages = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"),
                         F.when(F.octet_length(html) >= least, F.sha2(html.cast("binary"), 256)).alias("equal"))
    keepers = materialize(pages.where(F.col("equal").isNotNull()).groupBy("equal")
                          .agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies"))
                          .where("copies > 1").select("equal", "keeper", F.lit(True).alias("same")), "warc-keepers")
    return pages.join(keepers, "equal", "left").drop("equal")


def write_archives(pages: DataFrame, path: str, dictionary: bytes, least: int = REVISIT_BYTES, level: int = 3) -> None:
    """Write a record for each page to archives in the folder ``path``."""
    spark = pages.sparkSession
    bounded_batches(spark)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        writer = zstandard.ZstdCompressor(level=level, dict_data=shared, write_checksum=True)
        lead = struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary
        rows = 0
        for batch in batches:
            out = []
            for page in batch.to_pylist():
                if rows % ARCHIVE_ROWS == 0 and dictionary:
                    out.append(lead)
                    rows += 1
                revisit = bool(page["same"]) and page["page_id"] != page["keeper"]
                out.append(writer.compress(record(page["page_id"], page["url"], page["html"].encode(), page["digest"],
                                                  page["keeper"], revisit)))
                rows += 1
            yield pa.RecordBatch.from_pydict({"frame": pa.array(out, pa.binary())})

    (with_roles(pages, least).mapInArrow(pack, "frame binary").select(F.col("frame").cast("string"))
     .write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", ARCHIVE_ROWS).text(path))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives in the folder ``path``."""
    names = [c.split()[0] for c in RECORD.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                found = [read_record(x) for x in frames(memoryview(content.as_buffer()))]
                yield pa.RecordBatch.from_pydict({n: pa.array([r[n] for r in found], k) for n, k in zip(names, kinds)})

    return (spark.read.format("binaryFile").load(path).select("content")
            .mapInArrow(unpack, RECORD))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives in the shared folder and read them back."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path, fit_dictionary(pages))
    return read_archives(pages.sparkSession, path)
