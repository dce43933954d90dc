"""WARC: one gzip member per record, written by tasks and read back record by record.

The reader takes any archive of one member a record: of whatever record types, with or without digests, and with its own
records' ids beside those of others. Archives are opened by pyarrow (file, s3, gs, hdfs).
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_batches, scratch, spread

#: Payloads of fewer bytes are never replaced by a revisit.
MIN_REVISIT = 1000
#: A file is closed once it holds so many bytes.
FILE_BYTES = 1 << 26
#: Up to so many repeated payloads (some 100 bytes each), their table is broadcast; beyond, it is joined by a shuffle.
BROADCAST_REPEATS = 200_000
CHUNK = 1 << 16


class WarcError(ValueError):
    """A record that breaks the format or whose digest differs."""


def with_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload, refers_to: refers_to is set where an equal payload with a larger page_id is the response.

    Null html is an empty payload. Rows without page_id, and rows that repeat the winning page_id, are responses.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("digest"))
    repeats = rows.where(F.length("payload") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n"))
    repeats = cut(repeats.where("n > 1 and response is not null").select(F.col("digest").alias("of"), "response"), "repeated-payloads")
    right = F.broadcast(repeats) if repeats.count() <= BROADCAST_REPEATS else repeats
    joined = rows.join(right, F.col("digest") == F.col("of"), "left")
    return joined.select("page_id", "url", "payload", F.when(F.col("page_id") < F.col("response"), F.col("response")).alias("refers_to"))


def _named(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def _page(name: str | None) -> int | None:
    """The page_id in a record id of ours; null in others."""
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def _target(url: str | None) -> str:
    """The URL, but for control characters and blanks at its ends, which a header can't hold: those are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]|^ +| +$", lambda m: "".join(f"%{ord(c):02X}" for c in m[0]), url) if url else "urn:x-no-url"


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP head, with the payload's length, and its digest."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_named(page_id)}",
        f"WARC-Target-URI: {_target(url)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: {_digest(payload)}",
        f"WARC-Block-Digest: {_digest(block)}",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_named(refers_to)}"]
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(5, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def write_warc(records: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write records (page_id, url, payload, refers_to) as .warc.gz files into folder; returns file, records, bytes.

    Every attempt of a task writes files of its own; the table returned names only those of attempts that counted.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, name, n, size = None, "", 0, 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "records": [n], "bytes": [size]})

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                data = member(row["page_id"], row["url"], row["payload"], row["refers_to"])
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= file_bytes:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    rows = records.select("page_id", "url", "payload", "refers_to")
    return cut(map_batches(rows, write, "file string, records long, bytes long"), "warc-files")


def members(stream, chunk: int = CHUNK) -> Iterator[bytes]:
    """The decompressed gzip members of a stream, one at a time."""
    rest = stream.read(chunk)
    while rest:
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            parts.append(unpack.decompress(rest))
            rest = unpack.unused_data if unpack.eof else stream.read(chunk)
            if not rest and not unpack.eof:
                raise WarcError("a gzip member ends early")
        yield b"".join(parts)
        rest = rest or stream.read(chunk)


def fields_of(head: bytes) -> dict[str, str]:
    """The header fields under their names in lower case; a line that begins with a blank goes on with the one before."""
    fields: dict[str, str] = {}
    name = ""
    for line in head.decode(errors="replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            fields[name] += " " + line.strip()
            continue
        name, mark, value = line.partition(":")
        name = name.strip().lower()
        if not mark or not name:
            raise WarcError(f"a header line without a name: {line[:80]}")
        fields[name] = value.strip()
    return fields


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    """A record's header fields and its block, framed by Content-Length."""
    head, mark, rest = record.partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"WARC/"):
        raise WarcError("not a WARC record")
    fields = fields_of(head)
    if not fields.get("content-length", "").isdigit():
        raise WarcError(f"{fields.get('warc-record-id')}: no Content-Length")
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise WarcError(f"{fields.get('warc-record-id')}: the block isn't {size} bytes long")
    return fields, rest[:size]


def _known_digest(value: str | None) -> tuple[str, bytes] | None:
    """(algorithm, digest) of a header such as sha1:BASE32 or sha256:hex; nothing where it says neither."""
    name, _, text = (value or "").partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in ("md5", "sha1", "sha256", "sha512"):
        return None
    size = hashlib.new(name).digest_size
    try:
        found = bytes.fromhex(text) if len(text) == 2 * size else base64.b32decode(text.upper() + "=" * (-len(text) % 8))
    except (ValueError, binascii.Error):
        return None
    return (name, found) if len(found) == size else None


def _differs(data: bytes, digest: tuple[str, bytes] | None) -> bool:
    return digest is not None and hashlib.new(digest[0], data).digest() != digest[1]


def checked(record: bytes) -> dict:
    """A record as a row; raises WarcError where a digest or length differs from what the record says.

    A block of HTTP is split into its head and payload; any other block is its own payload. Digests that are missing, or
    of an unknown kind, are not verified; nor are the payload's where it was cut short (WARC-Truncated) or sent in chunks.
    payload_digest is the SHA-1 that the record gives, or else that of the payload at hand. A revisit has no payload: its
    length is that of its HTTP head, if it has one, and its digest the record's.
    """
    fields, block = parsed(record)
    name, kind = fields.get("warc-record-id"), fields.get("warc-type", "unknown")
    if _differs(block, _known_digest(fields.get("warc-block-digest"))):
        raise WarcError(f"{name}: block digest differs")
    payload, length = block, None
    http = fields.get("content-type", "").lower().startswith("application/http")
    sent = {}
    if http:
        head, _, payload = block.partition(b"\r\n\r\n")
        for line in head.split(b"\r\n")[1:]:
            key, _, value = line.partition(b":")
            sent[key.strip().lower()] = value.strip()
        if sent.get(b"content-length", b"").isdigit():
            length = int(sent[b"content-length"])
    revisit, digest = kind == "revisit", _known_digest(fields.get("warc-payload-digest"))
    if not revisit and not {b"transfer-encoding"} & sent.keys() and "warc-truncated" not in fields:
        if length is not None and b"content-encoding" not in sent and kind == "response" and len(payload) != length:
            raise WarcError(f"{name}: payload length differs")
        if _differs(payload, digest):
            raise WarcError(f"{name}: payload digest differs")
    sha1 = digest[1] if digest is not None and digest[0] == "sha1" else None if revisit else hashlib.sha1(payload).digest()
    url = fields.get("warc-target-uri", "").removeprefix("<").removesuffix(">")
    return {
        "page_id": _page(name),
        "url": None if url in ("", "urn:x-no-url") else url,
        "payload_bytes": length if revisit else len(payload),
        "payload_digest": sha1.hex() if sha1 is not None else None,
        "record_type": kind,
        "refers_to": _page(fields.get("warc-refers-to")),
        "payload": None if revisit else payload,
        "record_id": name,
    }


_ROW = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, record_id string"
_ARROW = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("record_id", pa.string())]
)


def read_warc(files: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the files named in column file, in the order of each file; see `checked`.

    payload is null in revisits, and everywhere without payloads. page_id and refers_to are null in records of others.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(file)
                rows, size = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for record in members(stream):
                        rows.append(checked(record))
                        if not payloads:
                            rows[-1]["payload"] = None
                        size += len(rows[-1]["payload"] or b"")
                        if len(rows) >= 4096 or size >= 1 << 24:
                            yield pa.RecordBatch.from_pylist(rows, _ARROW)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return map_batches(spread(files.select("file")), read, _ROW)


def archive(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write pages to new archives in folder (by default a new one in the shared folder); returns their files."""
    return write_warc(with_revisits(pages), folder or scratch(spark, "warc"))
