"""Token-id files in the zstandard seekable layout.

A file holds, in this order: independent zstandard frames of little-endian unsigned 32-bit token ids, one
skippable frame with the documents' index (zstandard-compressed pairs of doc_id and number of tokens), and the
trailing seek table: a skippable frame with compressed size, size and checksum (low 32 bits of XXH64) of each
frame before it. A reader finds the table from the end of the file and decompresses only frames that hold ids
of the documents asked for.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dealt, filesystem, in_batches, materialise, retried
from .tokenise import encoder

# Fixed values of the zstandard seekable format.
SEEKABLE_MAGIC = 0x8F92EAB1
TABLE_FRAME_MAGIC = 0x184D2A5E
SKIPPABLE_MAGIC = 0x184D2A50
HAS_CHECKSUMS = 0x80

#: Uncompressed bytes of a frame, and of a file (or its documents) after which a task begins the next one.
FRAME_BYTES, FILE_BYTES, FILE_DOCS = 1 << 18, 256 << 20, 1 << 20
#: Frames that a reading task takes at once.
READ_FRAMES = 256
#: doc_id of rows without one.
NO_ID = -(1 << 63)


def _check(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class TokenFileWriter:
    """Appends documents to one file; close() writes the index and the seek table. Held: a frame of ids, and for the
    index 16 bytes a document."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.out, self.frame_bytes = out, frame_bytes
        self.pack = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.held, self.held_bytes, self.frames, self.docs, self.tokens = [], 0, [], array("q"), 0

    def add(self, doc_id: int, ids: bytes) -> None:
        self.docs.extend((doc_id, len(ids) // 4))
        self.tokens += len(ids) // 4
        view = memoryview(ids)
        while view:
            piece, view = view[: self.frame_bytes - self.held_bytes], view[self.frame_bytes - self.held_bytes :]
            self.held.append(piece)
            self.held_bytes += len(piece)
            if self.held_bytes == self.frame_bytes:
                self._frame()

    @property
    def n_docs(self) -> int:
        return len(self.docs) // 2

    def _frame(self) -> None:
        if self.held_bytes:
            data = b"".join(self.held)
            packed = self.pack.compress(data)
            self.out.write(packed)
            self.frames.append((len(packed), len(data), _check(data)))
            self.held, self.held_bytes = [], 0

    def close(self) -> None:
        self._frame()
        index = self.pack.compress(np.asarray(self.docs, "<i8").tobytes())
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(index)) + index)
        self.frames.append((len(index) + 8, 0, _check(index)))
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), HAS_CHECKSUMS, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", TABLE_FRAME_MAGIC, len(table)) + table)
        self.out.close()


class TokenFileReader:
    """Random access to one file."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        frames, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC or not flags & HAS_CHECKSUMS:
            raise ValueError("no seek table at the end of the file")
        entries = np.frombuffer(self._at(size - 9 - 12 * frames, 12 * frames), "<u4").reshape(-1, 3)
        starts = np.concatenate([[0], np.cumsum(entries[:, 0].astype(np.int64))])
        index = self._at(int(starts[-2]) + 8, int(entries[-1, 0]) - 8)
        if _check(index) != entries[-1, 2]:
            raise ValueError("the index does not match its checksum")
        self.unpack = zstandard.ZstdDecompressor()
        docs = np.frombuffer(self.unpack.decompress(index), "<i8").reshape(-1, 2)
        self.doc_ids, self.lengths = docs[:, 0], docs[:, 1]
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])  # in tokens
        self.entries, self.places = entries[:-1], starts
        self.frame_starts = np.concatenate([[0], np.cumsum(entries[:-1, 1].astype(np.int64))])  # in bytes of ids
        if self.frame_starts[-1] != 4 * self.starts[-1]:
            raise ValueError("the seek table does not match the index")
        self.read_frames = 0
        self._last = (-1, b"")

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        data = self.source.read(n)
        if len(data) != n:
            raise EOFError("the file is shorter than its seek table says")
        return data

    def _frame(self, i: int) -> bytes:
        if self._last[0] != i:
            def once() -> bytes:
                data = self.unpack.decompress(self._at(int(self.places[i]), int(self.entries[i, 0])), max_output_size=int(self.entries[i, 1]))
                if len(data) != self.entries[i, 1] or _check(data) != self.entries[i, 2]:
                    raise ValueError(f"frame {i} does not match its checksum")
                return data

            self._last = (i, retried(once))
            self.read_frames += 1
        return self._last[1]

    def pieces(self, row: int) -> Iterator[bytes]:
        """The ids of the row-th document, as pieces of frames."""
        low, high = 4 * int(self.starts[row]), 4 * int(self.starts[row + 1])
        i = int(np.searchsorted(self.frame_starts, low, side="right")) - 1
        while low < high:
            begin, end = int(self.frame_starts[i]), int(self.frame_starts[i + 1])
            yield self._frame(i)[low - begin : min(high, end) - begin]
            low, i = min(high, end), i + 1

    def ids(self, row: int) -> np.ndarray:
        return np.frombuffer(b"".join(self.pieces(row)), "<u4")


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 2, keeps_space: bool = True, frame_bytes: int = FRAME_BYTES, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES, file_docs: int = FILE_DOCS) -> DataFrame:
    """Write the ids of all texts, each followed by end_id, in ascending id order; returns the manifest.

    Manifest, a row a file: part, file (in the part), path, n_docs, n_tokens, n_frames. A range partition is written
    to files of about file_bytes of ids or file_docs documents; a document lies in one file. Null text is empty (the
    end id only); a null id sorts first and is kept as null; rows with one id follow each other in no fixed order.
    Other columns are not read. Each attempt at a task writes under names of its own, and only files of the manifest
    count. Memory: one batch of texts, the ids of one text, one frame and the index of one file. An empty table
    gives no files.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(vocabulary, keeps_space), struct.pack("<I", end_id)
        part, out, made, attempt = TaskContext.get().partitionId(), None, 0, uuid.uuid4().hex
        fs, root = filesystem(folder)

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pylist([{"part": part, "file": made, "path": f"{folder}/{name}", "n_docs": out.n_docs, "n_tokens": out.tokens, "n_frames": len(out.frames) - 1}])

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode.all_ids(batch.column(1)), strict=True):
                if out is None:
                    fs.create_dir(root)
                    name = f"tokens-{part:06d}-{made:05d}-{attempt}.zst"
                    out = TokenFileWriter(fs.open_output_stream(f"{root}/{name}", compression=None), frame_bytes)
                out.add(NO_ID if doc_id is None else doc_id, ids + end)
                if 4 * out.tokens >= file_bytes or out.n_docs >= file_docs:
                    yield closed()
                    out, made = None, made + 1
        if out is not None:
            yield closed()

    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return materialise(ordered.mapInArrow(write, "part long, file long, path string, n_docs long, n_tokens long, n_frames long"), "token-manifest")


def read_token_files(spark: SparkSession, manifest: DataFrame, with_ids: bool = True, doc_ids: list[int] | None = None, read_frames: int = READ_FRAMES) -> DataFrame:
    """Documents of the files in a manifest: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and
    token_ids (binary, little-endian unsigned 32-bit), without the last if with_ids is False.

    A task reads the documents that begin in read_frames frames of a file, whatever the file's size. doc_ids: only
    these, and only their frames are decompressed. A damaged frame, index or table fails the job. Start positions
    come from the manifest; the driver gets a row for each range partition of the writer.
    """
    before, total = [], 0
    for part, tokens in sorted(manifest.groupBy("part").agg(F.sum("n_tokens")).collect()):
        before.append((part, total))
        total += tokens
    wanted = None if doc_ids is None else np.unique(np.asarray(doc_ids, np.int64))
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("token_ids", pa.binary())] * with_ids
    schema = pa.schema(fields)

    def rows(path: str, base: int, low: int, high: int) -> Iterator[tuple]:
        fs, name = filesystem(path)
        with fs.open_input_file(name) as source:
            file = retried(lambda: TokenFileReader(source))
            first, after = (int(np.searchsorted(4 * file.starts[:-1], file.frame_starts[min(f, len(file.entries))])) for f in (low, high))
            if high >= len(file.entries):
                after = len(file.doc_ids)
            chosen = range(first, after) if wanted is None else (first + np.flatnonzero(np.isin(file.doc_ids[first:after], wanted))).tolist()
            for row in chosen:
                crc, kept = 0, []
                for piece in file.pieces(row):
                    crc = zlib.crc32(piece, crc)
                    if with_ids:
                        kept.append(piece)
                doc_id = int(file.doc_ids[row])
                yield (None if doc_id == NO_ID else doc_id, base + int(file.starts[row]), int(file.lengths[row]), crc, *[b"".join(kept)] * with_ids)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base, low, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from in_batches(rows(path, base, low, high), schema, size=lambda r: len(r[4]) if with_ids else 0)

    parts = spark.createDataFrame(before, "part long, before long")
    earlier = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    placed = manifest.join(F.broadcast(parts), "part").withColumn("base", F.col("before") + F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)))
    ranges = placed.select("path", "base", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_frames") - 1, F.lit(read_frames).cast("long"))).alias("low"))
    plan = dealt(ranges.withColumn("high", F.col("low") + read_frames), manifest.agg(F.sum(F.ceil(F.col("n_frames") / read_frames))).first()[0])
    return plan.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", token_ids binary" * with_ids)
