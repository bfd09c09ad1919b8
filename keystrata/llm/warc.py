"""WARC archives: a writer with revisit records, and a splittable reader of gzip members.

A reading task scans its byte range for the gzip magic, takes the first candidate whose decoded beginning is a
WARC header, and from there owns every record that starts inside the range, reading past its end where the last
one goes on.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dealt, filesystem, in_batches, materialise, retried, salted_join

# Fixed values of the formats.
GZIP_MAGIC = b"\x1f\x8b\x08"
WARC_BEGIN = b"WARC/1."
END = b"\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WARC_DATE = "2024-01-01T00:00:00Z"

CHUNK = 1 << 16
ARCHIVE_BYTES = 256 << 20


def digest_of(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _page(name: str) -> int | None:
    value = name.removeprefix("<urn:x-page:").removesuffix(">")
    return None if value == "none" else int(value)


def _one_line(value: str | None) -> str:
    return (value or "").replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC record as one gzip member; a revisit keeps the HTTP header and leaves out the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Target-URI: {_one_line(url)}",
        f"WARC-Date: {WARC_DATE}",
        f"WARC-Payload-Digest: sha1:{digest_of(hashlib.sha1(payload).digest())}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + END + body + END) + pack.flush()


def revisits(pages: DataFrame, id_col: str, html_col: str, least_bytes: int) -> DataFrame:
    """(page_id, sha1, refers_to) of pages whose payload of at least least_bytes a page with a larger id has too."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    keys = pages.where(F.octet_length(payload) >= least_bytes).select(F.col(id_col).cast("long").alias("page_id"), F.sha1(payload).alias("sha1"))
    keys = materialise(keys.distinct(), "warc-keys")
    groups = keys.groupBy("sha1").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return materialise(salted_join(keys, groups, "sha1", "page_id").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))), "warc-revisits")


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for each row of pages below folder; manifest: path, records, bytes.

    Of pages with equal payloads of at least least_bytes the one with the largest id is the response, the others
    revisit it. Null html is an empty payload, a null url an empty one, a null id the smallest; repeated rows
    get a record each, of the same type; rows with one id and other payloads are pages of their own. Very long urls
    and payloads are written whole. Other columns are not read. An empty table writes nothing. Only ids and digests
    are shuffled to find copies; the payloads are shuffled once, by page id. Each attempt at a task writes archives
    under names of its own, and only those of the manifest count.
    """
    twins = revisits(pages, id_col, html_col, least_bytes).select(F.col("page_id").alias("r_id"), F.col("sha1").alias("r_sha1"), "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        part, made, out, name, records = TaskContext.get().partitionId(), [], None, "", 0

        def close() -> None:
            size = out.tell()
            out.close()
            made.append({"path": f"{folder}/{name}", "records": records, "bytes": size})

        for batch in batches:
            for page_id, url, html, refers_to, twin in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if out is None:
                    fs.create_dir(root)
                    name, records = f"pages-{part:06d}-{len(made):04d}-{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                out.write(record(page_id, url, (html.as_py() or "").encode(), refers_to, twin))
                records += 1
                if out.tell() >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        if made:
            yield pa.RecordBatch.from_pylist(made)

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    same = F.col("page_id").eqNullSafe(F.col("r_id")) & (F.sha1(F.coalesce("html", F.lit(""))) == F.col("r_sha1"))
    marked = rows.join(twins, same, "left").select("page_id", "url", "html", "refers_to", F.col("r_sha1").isNotNull().alias("twin"))
    return materialise(marked.mapInArrow(write, "path string, records long, bytes long"), "warc-manifest")


class Member:
    """One gzip member of a source, decoded piece by piece from its offset."""

    def __init__(self, source, offset: int):
        source.seek(offset)
        self.source, self.engine, self.read_to, self.held = source, zlib.decompressobj(31), offset, b""

    def more(self) -> bool:
        """Decode the next piece into held; False at the member's end, whose checksum zlib has verified then."""
        if self.engine.eof:
            return False
        data = self.engine.unconsumed_tail or self.source.read(CHUNK)
        if not data:
            raise EOFError("the member is cut off")
        self.read_to += 0 if self.engine.unconsumed_tail else len(data)
        self.held += self.engine.decompress(data, CHUNK)
        return True

    def until(self, mark: bytes) -> bytes:
        """Take what comes up to and with mark, however long."""
        seen = 0
        while (at := self.held.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.held)
            if not self.more():
                raise ValueError(f"no {mark!r} in the member")
        out, self.held = self.held[: at + len(mark)], self.held[at + len(mark) :]
        return out

    def begins(self, mark: bytes) -> bool:
        while len(self.held) < len(mark) and self.more():
            pass
        return self.held.startswith(mark)

    def take(self, n: int) -> Iterator[bytes]:
        """Take n bytes in pieces."""
        while n:
            if not self.held and not self.more():
                raise EOFError("the record is shorter than its Content-Length")
            piece, self.held = self.held[:n], self.held[n:]
            n -= len(piece)
            if piece:
                yield piece

    def end(self) -> int:
        """Offset after the member."""
        while self.more():
            self.held = self.held[-len(END) :]
        return self.read_to - len(self.engine.unused_data)


def headers_of(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k}


def begins_record(source, offset: int) -> bool:
    """Whether a gzip member at offset decodes to a WARC header."""
    try:
        member = Member(source, offset)
        # most false candidates end with their first bytes; the header of a true one may have any length
        return member.begins(WARC_BEGIN) and "content-length" in headers_of(member.until(END))
    except (zlib.error, ValueError, EOFError):
        return False


def first_record(source, low: int, high: int) -> int:
    """Offset of the first record that starts in [low, high), or high."""
    at, tail = low, b""
    while at < high + len(GZIP_MAGIC) - 1:
        source.seek(at)
        data = source.read(min(CHUNK, high + len(GZIP_MAGIC) - 1 - at))
        if not data:
            break
        window, base = tail + data, at - len(tail)
        found = window.find(GZIP_MAGIC)
        while found >= 0:
            if base + found < high and begins_record(source, base + found):
                return base + found
            found = window.find(GZIP_MAGIC, found + 1)
        at, tail = at + len(data), window[-(len(GZIP_MAGIC) - 1) :]
    return high


def read_record(source, offset: int, with_payload: bool) -> tuple[dict, int]:
    """Fields of the record at offset, and the offset after it. The payload is hashed piece by piece."""
    member = Member(source, offset)
    head = headers_of(member.until(END))
    block = int(head["content-length"])
    http = member.until(END)
    left = block - len(http)
    kind = head["warc-type"]
    sha, size, kept = hashlib.sha1(), 0, []
    for piece in member.take(left):
        sha.update(piece)
        size += len(piece)
        if with_payload:
            kept.append(piece)
    named = head.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "revisit":
        digest, size = named, int(headers_of(http)["content-length"])
    else:
        digest = digest_of(sha.digest())
        if named and named != digest:
            raise ValueError(f"the payload of the record at {offset} does not match its digest")
    out = {
        "page_id": _page(head["warc-record-id"]), "url": head.get("warc-target-uri", ""), "payload_bytes": size, "payload_digest": digest, "record_type": kind,
        "refers_to": _page(head["warc-refers-to"]) if "warc-refers-to" in head else None,
    }
    if with_payload:
        out["payload"] = None if kind == "revisit" else b"".join(kept)
    return out, member.end()


def read_warc(spark: SparkSession, manifest: DataFrame, split_bytes: int = 16 << 20, with_payload: bool = False) -> DataFrame:
    """Records of the archives in a manifest (path, bytes): page_id, url, payload_bytes, payload_digest, record_type,
    refers_to, and payload if asked for (null for revisits). Archives are split into ranges of split_bytes, each of
    which is a task; a record belongs to the range in which it begins. Bytes between records that decode to no WARC
    header are passed over; a record that is damaged or does not match its digest fails the job. An empty manifest
    gives no rows."""
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * with_payload
    schema = pa.schema(fields)

    def rows(path: str, low: int, high: int) -> Iterator[tuple]:
        fs, name = filesystem(path)
        with fs.open_input_file(name) as source:
            at = retried(lambda: first_record(source, low, high))
            while at < high:
                found, at = retried(lambda at=at: read_record(source, at, with_payload))
                yield tuple(found.values())
                if at >= source.size():
                    break

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, low, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from in_batches(rows(path, low, high), schema, size=lambda r: len(r[6] or b"") if with_payload else 0)

    ranges = manifest.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("low"))
    ranges = ranges.select("path", "low", F.least(F.col("low") + split_bytes, F.col("bytes")).alias("high"))
    ranges = dealt(ranges, manifest.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0])
    return ranges.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload)
