"""Token ids as files of independent zstandard frames with a trailing seek table.

A file holds documents in ascending id order. Documents are gathered into frames of about ``frame_ids`` ids
(a longer document is a frame of its own); a frame is a whole zstandard frame of little-endian 32-bit ids.
After the frames come two skippable frames that ordinary decoders pass over: the document index (id, frame,
count; compressed) and, last, the seek table of the public seekable format with each frame's compressed size,
decompressed size and checksum. A reader finds the table from the file's end and decompresses only the
frames of the documents asked for. A ``manifest`` table beside the files has a row for each.

Files go where the path's scheme says (local mounts, HDFS, object stores). A task writes under a name of its own attempt
and then moves the file into place, so a task that runs twice leaves one file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import new_dir
from tidemark.llm.tokens import Encoder, le32, slices

# Fixed values of the public seekable format.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUMS = 0x80

MANIFEST = "part int, file string, n_docs long, n_ids long, n_bytes long"
NULL_ID = -(1 << 63)


def checksum(raw: bytes) -> int:
    return xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF


class FrameWriter:
    """Writes documents' ids to an open binary file."""

    def __init__(self, out, frame_ids: int, level: int) -> None:
        self.out, self.frame_bytes = out, 4 * frame_ids
        self.zstd = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.pending: list[bytes] = []
        self.size = self.n_ids = self.n_bytes = 0
        self.table: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.size and self.size + len(ids) > self.frame_bytes:
            self._flush()
        self.index.append((NULL_ID if doc_id is None else doc_id, len(self.table), len(ids) // 4))
        self.pending.append(ids)
        self.size += len(ids)
        self.n_ids += len(ids) // 4

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.n_bytes += len(data)

    def _flush(self) -> None:
        raw = b"".join(self.pending)
        frame = self.zstd.compress(raw)
        self._put(frame)
        self.table.append((len(frame), len(raw), checksum(raw)))
        self.pending, self.size = [], 0

    def finish(self) -> None:
        if self.index and (self.size or self.pending):
            self._flush()
        columns = np.array(self.index, "<i8").reshape(-1, 3).T
        index = self.zstd.compress(columns.tobytes())
        self._put(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        entries = b"".join(struct.pack("<III", *x) for x in self.table)
        footer = struct.pack("<IBI", len(self.table), CHECKSUMS, SEEKABLE_MAGIC)
        self._put(struct.pack("<II", SKIPPABLE_SEEK, len(entries) + len(footer)) + entries + footer)


class FrameReader:
    """Reads from an open random-access file; frames are decompressed when their documents are asked for."""

    def __init__(self, source) -> None:
        self.source = source
        end = source.size() if callable(getattr(source, "size", None)) else source.seek(0, 2)
        n, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEKABLE_MAGIC or flags != CHECKSUMS:
            raise ValueError("no seek table at the file's end")
        table_at = end - 9 - 12 * n
        self.table = list(struct.iter_unpack("<III", self._at(table_at, 12 * n)))
        self.starts = [0]
        for size, _, _ in self.table:
            self.starts.append(self.starts[-1] + size)
        kind, size = struct.unpack("<II", self._at(self.starts[-1], 8))
        if kind != SKIPPABLE_INDEX:
            raise ValueError("no document index after the frames")
        raw = zstandard.ZstdDecompressor().decompress(self._at(self.starts[-1] + 8, size))
        self.doc_id, self.frame, self.count = np.frombuffer(raw, "<i8").reshape(3, -1)

    def _at(self, start: int, n: int) -> bytes:
        self.source.seek(start)
        return self.source.read(n)

    def read_frame(self, k: int) -> bytes:
        size, raw_size, check = self.table[k]
        raw = zstandard.ZstdDecompressor().decompress(self._at(self.starts[k], size))
        if len(raw) != raw_size or checksum(raw) != check:
            raise ValueError(f"frame {k} is damaged")
        return raw

    def documents(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int | None, bytes]]:
        """(id, ids) in file order; ``wanted``: of these documents alone, other frames staying compressed."""
        chosen = np.ones(len(self.doc_id), bool) if wanted is None else np.isin(self.doc_id, np.array(list(wanted), np.int64))
        at, last, raw = 0, -1, b""
        for i in range(len(self.doc_id)):
            at = 0 if i and self.frame[i] != self.frame[i - 1] else at
            n = 4 * int(self.count[i])
            if chosen[i]:
                if self.frame[i] != last:
                    last, raw = int(self.frame[i]), self.read_frame(int(self.frame[i]))
                yield (None if self.doc_id[i] == NULL_ID else int(self.doc_id[i])), raw[at : at + n]
            at += n


def _located(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write(
    docs: DataFrame, out: str, *, vocabulary: str, end_id: int = 1, frame_ids: int = 1 << 16, level: int = 3, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encodes whole texts, an end id after each, into files below ``out`` in ascending id order.

    Null ids come first, null or empty texts hold the end id alone, and rows that repeat an id are written each. An empty table writes an
    empty manifest. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The text's hash spreads an id that very many rows repeat, and fixes their order.
    placed = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, part = Encoder.of(vocabulary), le32([end_id]), TaskContext.get().partitionId()
        system, base = _located(out)
        file = f"part-{part:06d}.tok.zst"
        trial, writer, stream = f"{base}/.{file}-{uuid.uuid4().hex}", None, None
        for batch in batches:
            for some in slices(list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())), size=lambda x: len(x[1] or "")):
                if writer is None:
                    stream = system.open_output_stream(trial)
                    writer = FrameWriter(stream, frame_ids, level)
                for (doc_id, _), ids in zip(some, encoder.encode([t for _, t in some])):
                    writer.add(doc_id, ids + end)
        if writer is None:
            return
        writer.finish()
        stream.close()
        system.move(trial, f"{base}/{file}")
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array([part], pa.int32()), "file": [file], "n_docs": [len(writer.index)], "n_ids": [writer.n_ids], "n_bytes": [writer.n_bytes]}
        )

    system, base = _located(out)
    system.create_dir(base, recursive=True)
    placed.mapInArrow(run, MANIFEST).write.mode("overwrite").parquet(f"{out}/manifest")


def read(spark: SparkSession, out: str) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, ids (little-endian 32-bit)."""
    manifest = spark.read.parquet(f"{out}/manifest")
    # A row per file, so the one window over all of them stays small.
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).select("part", "file", "base")
    files = files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _located(out)
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                with system.open_input_file(f"{base}/{file}") as source:
                    rows: list = []
                    for some in slices(FrameReader(source).documents(), 1 << 24, lambda x: len(x[1])):
                        rows = []
                        for doc_id, ids in some:
                            rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), ids))
                            start += len(ids) // 4
                        columns = list(zip(*rows))
                        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in columns[:4]), pa.array(columns[4], pa.binary())], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Writes ``docs`` below the shared folder and reads the files back."""
    spark = docs.sparkSession
    out = new_dir(spark, "token-ids")
    write(docs, out, **options)
    return read(spark, out)
