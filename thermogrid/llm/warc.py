"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary, followed by one
frame per record that is compressed with it.  Other skippable frames are stepped over.

The archives are files that Spark's own writer commits, so they may lie in any store it reaches and a lost
executor leaves no halves: each row of a text table is one whole archive, and the line separator is the
eight bytes of an empty skippable frame, which are valid text.  They are read by the ``binaryFile`` source.
An archive is closed at ``ARCHIVE_BYTES``, so what a task holds at once is bounded by that and one record.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Workspace

DICTIONARY_MAGIC = 0x184D2A5D
#: An empty skippable frame; every byte is ASCII.
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
ARCHIVE_BYTES = 8 << 20
DICTIONARY_BYTES = 64 << 10
SAMPLE_ROWS, SAMPLE_CHARS = 512, 4096
SMALLEST = 100
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"


class WarcError(ValueError):
    """An archive or record that breaks the format."""


def dictionary(samples: list[bytes]) -> bytes:
    """A dictionary trained on a bounded sample; empty if the sample is too small to train on."""
    samples = [s for s in samples if s]
    try:
        return zstd.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstd.ZstdError:
        return b""


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """The bytes of a response record, or of a revisit whose HTTP header still tells the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    uri = "".join(c for c in url or "about:blank" if c > " ")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def start(trained: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(trained)) + trained if trained else b""


def frame_end(view: memoryview, at: int) -> int:
    """Where the frame that starts at ``at`` ends, by the sizes in its block headers; nothing is decompressed."""
    try:
        head = view[at : at + 18]
        checksum = zstd.get_frame_parameters(head).has_checksum
        at += zstd.frame_header_size(head)
    except zstd.ZstdError as x:
        raise WarcError(str(x)) from x
    last = False
    while not last:
        if at + 3 > len(view):
            raise WarcError("a record's frame is cut short")
        block = int.from_bytes(view[at : at + 3], "little")
        last, kind = bool(block & 1), block >> 1 & 3
        if kind == 3:
            raise WarcError("a block of no known type")
        at += 3 + (1 if kind == 1 else block >> 3)  # a repeated byte stands for its whole block
    at += 4 * checksum
    if at > len(view):
        raise WarcError("a record's frame is cut short")
    return at


def frames(data: bytes) -> Iterator[bytes]:
    """The decoded frame of each record, in time linear in the archive; reads the dictionary first."""
    at, unpacker = 0, zstd.ZstdDecompressor()
    view = memoryview(data)
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_MAGIC:
        size = struct.unpack_from("<I", data, 4)[0]
        if 8 + size > len(data):
            raise WarcError("the dictionary frame is cut short")
        raw = bytes(view[8 : 8 + size])
        if raw[:4] == zstd.FRAME_HEADER:  # the dictionary may be compressed itself
            raw = unpacker.decompressobj().decompress(raw)
        unpacker, at = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(raw)), 8 + size
    while at < len(data):
        if len(data) - at < 8:
            raise WarcError("bytes are left that are no frame")
        magic, size = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + size
            if at > len(data):
                raise WarcError("a skippable frame is cut short")
            continue
        if bytes(view[at : at + 4]) != zstd.FRAME_HEADER:
            raise WarcError("no frame starts here")
        end, one = frame_end(view, at), unpacker.decompressobj()
        try:
            plain = one.decompress(view[at:end])
        except zstd.ZstdError as x:
            raise WarcError(str(x)) from x
        if not one.eof:
            raise WarcError("a record's frame is cut short")
        at = end
        yield plain


def _headers(lines: list[bytes], what: str) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"not a {what} header: {line[:60]!r}")
        out[name.lower()] = value.strip()
    return out


def _page(uri: str) -> int | None:
    if not (uri.startswith("<urn:page:") and uri.endswith(">")):
        raise WarcError(f"not a record id: {uri!r}")
    return int(uri[10:-1]) if uri[10:-1] else None


def _length(headers: dict[str, str], what: str) -> int:
    value = headers.get("content-length", "")
    if not value.isdigit():
        raise WarcError(f"{what} without a length")
    return int(value)


def parse(plain: bytes) -> dict:
    """A checked record: kind, page_id, url, digest, payload (None for a revisit), payload_bytes, refers_to."""
    head, gap, rest = plain.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (b"WARC/1.1", b"WARC/1.0"):
        raise WarcError("not a WARC record")
    h = _headers(lines[1:], "WARC")
    for name in ("warc-type", "warc-record-id", "warc-date"):
        if name not in h:
            raise WarcError(f"{name} is missing")
    size = _length(h, "a record")
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise WarcError("the record's length does not match its header")
    http, gap, payload = rest[:size].partition(b"\r\n\r\n")
    if not gap or not http.startswith(b"HTTP/"):
        raise WarcError("the block is no HTTP response")
    told = _length(_headers(http.split(b"\r\n")[1:], "HTTP"), "an HTTP response")
    scheme, _, digest = h.get("warc-payload-digest", "").partition(":")
    if scheme != "sha256" or len(digest) != 64:
        raise WarcError("no payload digest")
    out = {"kind": h["warc-type"], "page_id": _page(h["warc-record-id"]), "url": h.get("warc-target-uri"), "digest": digest, "payload": None, "payload_bytes": told, "refers_to": None}
    if out["kind"] == "response":
        if len(payload) != told or hashlib.sha256(payload).hexdigest() != digest:
            raise WarcError("the payload's length or digest does not match its header")
        out["payload"] = payload
    elif out["kind"] == "revisit":
        if payload or "warc-refers-to" not in h or h.get("warc-profile") != _PROFILE:
            raise WarcError("not a revisit of an identical payload")
        out["refers_to"] = _page(h["warc-refers-to"])
    else:
        raise WarcError(f"unknown type {out['kind']}")
    return out


def planned(pages: DataFrame, work: Workspace, smallest: int = SMALLEST) -> DataFrame:
    """page_id, url, payload, digest, refers_to: the last is null for responses."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= smallest
    groups = rows.filter(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    groups = work.keep(groups.filter("n > 1").select("digest", "first"), "groups")
    rows = rows.join(groups, "digest", "left")  # few digests repeat, and AQE splits one that many rows share
    return rows.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))).drop("first")


def write_archives(pages: DataFrame, path: str, work: Workspace | None = None, smallest: int = SMALLEST, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write the records of ``pages`` (page_id, url, html) as archives below ``path``.

    Of equal payloads of at least ``smallest`` bytes the one with the smallest page_id is a response and the
    others revisit it; a row that repeats that id is a response too.  A null id is no candidate; null html
    is an empty payload.  A page is one record, however long it is; extra columns are ignored, and an empty
    table gives no archive.
    """
    work = work or Workspace(pages.sparkSession, "warc")
    sample = pages.filter(F.col("html").isNotNull()).select(F.substring("html", 1, SAMPLE_CHARS).alias("s")).limit(SAMPLE_ROWS)
    trained = dictionary([r["s"].encode() for r in sample.collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using = zstd.ZstdCompressionDict(trained) if trained else None
        if using is not None:
            using.precompute_compress(level=3)
        packer = zstd.ZstdCompressor(level=3, dict_data=using, write_checksum=True) if using else zstd.ZstdCompressor(level=3, write_checksum=True)
        parts, size = [start(trained)], 0
        done = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["archive"])
        for batch in batches:
            columns = [batch.column(n) for n in ("page_id", "url", "payload", "digest", "refers_to")]
            for i in range(batch.num_rows):
                page_id, url, payload, digest, refers_to = (c[i].as_py() for c in columns)
                kind = "response" if refers_to is None else "revisit"
                frame = packer.compress(record(kind, page_id, url, payload, digest, refers_to))
                parts.append(frame)
                size += len(frame)
                if size >= archive_bytes:
                    yield done()
                    parts, size = [start(trained)], 0
        if size:
            yield done()

    archives = planned(pages, work, smallest).select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "archive binary")
    archives.select(F.col("archive").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("lineSep", SEPARATOR).option("compression", "none").text(path)


def read_archives(spark, path: str) -> DataFrame:
    """page_id, url, record_type, refers_to, payload, payload_bytes, payload_digest of every record, all checked.

    A broken frame, header, length or digest raises ``WarcError``; an archive without records gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("page_id", "url", "kind", "refers_to", "payload", "payload_bytes", "digest")
        types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string())

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names=list(names))

        for batch in batches:
            for i in range(batch.num_rows):
                rows, size = [], 0
                for plain in frames(batch.column(0)[i].as_py()):
                    rows.append(parse(plain))
                    size += len(plain)
                    if size > 4 << 20:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    files = spark.read.format("binaryFile").load(path).filter("length > 0").select("content")
    got = files.mapInArrow(run, "page_id long, url string, kind string, refers_to long, payload binary, payload_bytes long, digest string")
    return got.withColumnsRenamed({"kind": "record_type", "digest": "payload_digest"})


def through_archives(pages: DataFrame, smallest: int = SMALLEST) -> DataFrame:
    """Write ``pages`` to archives and read them back, one row per row of ``pages``; see ``write_archives``.

    An empty table gives no records.
    """
    work = Workspace(pages.sparkSession, "warc")
    write_archives(pages, work.path("archives"), work, smallest)
    return read_archives(pages.sparkSession, work.path("archives"))
