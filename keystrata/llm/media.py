"""Media columns: lossless 8-bit images in tar archives, and a Spark data source that reads them by byte ranges."""

from __future__ import annotations

import struct
import tarfile
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import filesystem, in_batches, materialise, retried

#: Samples in a row of an image.
WIDTH = 64
# Fixed values of the PNG format.
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
GRAY_8_BIT = bytes([8, 0, 0, 0, 0])
#: Bytes of an archive after which a task begins the next one.
ARCHIVE_BYTES = 256 << 20
BLOCK = 512


def padded(data: bytes, unit: int = WIDTH) -> bytes:
    """data with zero bytes up to a positive multiple of unit."""
    return data + bytes(-len(data) % unit if data else unit)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_image(payload: bytes, width: int = WIDTH, level: int = 4) -> bytes:
    """8-bit grey PNG with a sample for each byte; the payload is a positive multiple of width."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    lines = np.zeros((len(rows), width + 1), np.uint8)  # filter 0 before each row
    lines[:, 1:] = rows
    header = struct.pack(">II", width, len(rows)) + GRAY_8_BIT
    return PNG_SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def decode_image(data: bytes) -> np.ndarray:
    """Samples of an unfiltered 8-bit grey PNG, rows by columns; checks every chunk."""
    if data[:8] != PNG_SIGNATURE:
        raise ValueError("not a PNG")
    at, shape, packed = 8, None, []
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if len(data) < at + 12 + n or struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError(f"bad {kind!r} chunk")
        if kind == b"IHDR":
            shape = struct.unpack(">II", body[:8])
            if body[8:] != GRAY_8_BIT:
                raise ValueError("not 8-bit grey")
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(shape[1], shape[0] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows are not supported")
    return lines[:, 1:]


class ArchiveWriter:
    """A tar file and, beside it, the offsets of its members (little-endian unsigned 64-bit)."""

    def __init__(self, fs, path: str):
        self.fs, self.path = fs, path
        self.out, self.at, self.offsets = fs.open_output_stream(path), 0, array("Q")

    def add(self, name: str, data: bytes) -> None:
        info = tarfile.TarInfo(name)
        info.size = len(data)
        whole = info.tobuf(tarfile.USTAR_FORMAT if len(data) < 8 << 30 else tarfile.GNU_FORMAT) + data + bytes(-len(data) % BLOCK)
        self.out.write(whole)
        self.offsets.append(self.at)
        self.at += len(whole)

    def close(self) -> None:
        self.out.write(bytes(2 * BLOCK))
        self.out.close()
        with self.fs.open_output_stream(f"{self.path}.idx") as index:
            index.write(np.asarray(self.offsets, "<u8").tobytes())


def read_member(source, offset: int) -> tuple[str, bytes]:
    """Name and bytes of the tar member whose header is at offset; the header's checksum is verified."""
    source.seek(offset)
    header = source.read(BLOCK)
    try:
        info = tarfile.TarInfo.frombuf(header, "utf-8", "strict")
    except tarfile.HeaderError as error:
        raise ValueError(f"no member at {offset}: {error}") from error
    data = source.read(info.size)
    if len(data) != info.size:
        raise EOFError(f"the member at {offset} is cut off")
    return info.name, data


class RangePartition(InputPartition):
    def __init__(self, path: str, low: int, high: int):
        self.path, self.low, self.high = path, low, high


class ArchiveReader(DataSourceReader):
    """Plans ranges of bytes from the archives' sizes alone; a range has the members whose headers begin in it.

    With a manifest (a Parquet folder of write_archives) only its archives are read, else all below the path.
    """

    def __init__(self, options: dict):
        self.folder, self.manifest = options["path"], options.get("manifest")
        self.range_bytes = int(options.get("rangebytes", 32 << 20))
        self.batch_bytes = int(options.get("batchbytes", 8 << 20))
        self.attempts = int(options.get("attempts", 4))

    def partitions(self) -> list[InputPartition]:
        if self.manifest:
            fs, root = filesystem(self.manifest)
            rows = pads.dataset(root, filesystem=fs, format="parquet").to_table().to_pylist()
            found = [(r["path"], r["bytes"]) for r in rows]
        else:
            fs, root = filesystem(self.folder)
            found = [(f.path, f.size) for f in fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)) if f.path.endswith(".tar")]
        return [RangePartition(path, low, min(low + self.range_bytes, size)) for path, size in sorted(found) for low in range(0, size, self.range_bytes)] or [RangePartition("", 0, 0)]

    def _rows(self, part: RangePartition) -> Iterator[tuple]:
        fs, _ = filesystem(self.folder)

        def index() -> np.ndarray:
            with fs.open_input_file(f"{part.path}.idx") as source:
                return np.frombuffer(source.read(), "<u8").astype(np.int64)

        offsets = retried(index, self.attempts)
        opened = []

        def member(offset: int) -> tuple[str, bytes]:
            if not opened:
                opened.append(fs.open_input_file(part.path))
            try:
                return read_member(opened[0], offset)
            except Exception:
                opened.pop().close()  # the next attempt opens the archive anew and seeks to this member only
                raise

        for offset in offsets[(offsets >= part.low) & (offsets < part.high)].tolist():
            name, data = retried(lambda offset=offset: member(offset), self.attempts)
            yield part.path, offset, name, data
        for source in opened:
            source.close()

    def read(self, partition: RangePartition) -> Iterator[pa.RecordBatch]:
        if partition.path:
            schema = pa.schema([("archive", pa.string()), ("member_offset", pa.int64()), ("member", pa.string()), ("media", pa.binary())])
            yield from in_batches(self._rows(partition), schema, 4000, lambda r: len(r[3]), self.batch_bytes)


class ArchiveSource(DataSource):
    """Spark data source "media_archives": members of all .tar files below `path`, streamed as Arrow batches.

    Options: manifest (path of the table of archives to read), rangeBytes (bytes of an archive for one task),
    batchBytes, attempts (for each member). A folder that is missing or has no archives gives no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return "archive string, member_offset long, member string, media binary"

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader({k.lower(): v for k, v in self.options.items()})


def write_archives(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Store every text as an image member of tar archives below folder; manifest: path, members, bytes.

    Payload: the UTF-8 bytes (null: none) with zero bytes up to a positive multiple of 64. Members are named
    <doc_id>/<unpadded bytes>.png, null ids "null". Repeated rows and ids get a member each, texts of any length are
    stored whole, other columns are not read. Each attempt at a task writes archives under names of its own, and only
    those of the manifest count. An empty table writes nothing.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        part, made, out, attempt = TaskContext.get().partitionId(), [], None, uuid.uuid4().hex
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = (text.as_py() or "").encode()
                if out is None:
                    fs.create_dir(root)
                    out = ArchiveWriter(fs, f"{root}/media-{part:06d}-{len(made):04d}-{attempt}.tar")
                out.add(f"{'null' if doc_id is None else doc_id}/{len(data)}.png", encode_image(padded(data)))
                if out.at >= archive_bytes:
                    out.close()
                    made, out = [*made, (out.path, len(out.offsets), out.at)], None
        if out is not None:
            out.close()
            made.append((out.path, len(out.offsets), out.at))
        if made:
            yield pa.RecordBatch.from_pylist([{"path": p, "members": m, "bytes": b} for p, m, b in made])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return materialise(rows.mapInArrow(write, "path string, members long, bytes long"), "media-manifest")


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame | None = None, **options) -> DataFrame:
    """Members of the archives below folder, or of those in a manifest of write_archives: archive, member_offset,
    member, media. The driver plans from the manifest, a row an archive."""
    spark.dataSource.register(ArchiveSource)
    reader = spark.read.format("media_archives")
    for key, value in (options | ({"manifest": manifest._scratch_path} if manifest is not None else {})).items():
        reader = reader.option(key, value)
    return reader.load(folder)


def feature(samples: np.ndarray) -> str:
    """Mean, deviation, mean step between neighbours and eight-bin histogram of the samples."""
    flat = samples.reshape(-1)
    n = len(flat)
    counts = np.bincount(flat, minlength=256)
    levels = np.arange(256)
    mean = float(counts @ levels) / n
    spread = max(0.0, float(counts @ (levels * levels)) / n - mean * mean) ** 0.5
    step = int(np.abs(np.diff(flat.astype(np.int16))).sum(dtype=np.int64)) / max(1, n - 1)
    return f"{mean:.4f} {spread:.4f} {step:.4f} " + " ".join(str(x) for x in counts.reshape(8, 32).sum(axis=1))


def media_features(media: DataFrame) -> DataFrame:
    """Features of stored images: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256 and feature, all from the bytes read back, a row a member. A member that doesn't decode fails the job."""
    import hashlib

    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for member, media in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    data = media.as_py()
                    doc_id, _, rest = member.partition("/")
                    samples = decode_image(data)
                    payload = samples.tobytes()
                    yield (None if doc_id == "null" else int(doc_id), int(rest.partition(".")[0]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(data), hashlib.sha256(data).hexdigest(), feature(samples))

        return in_batches(rows(), schema)

    return media.select("member", "media").mapInArrow(compute, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
