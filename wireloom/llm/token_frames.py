"""Token ids in files of independent zstandard frames with a seek table, readable document by document.

A file holds, in this order: frames of little-endian unsigned 32-bit ids, each frame compressed on its own and holding
whole documents; a skippable frame with the directory (for each document its id, whether it has one, and where its
ids begin), which the seek table lists as a frame without content; a skippable frame with the seek table of the public "zstd seekable format": for each frame its
compressed and decompressed size and a checksum (the low 32 bits of XXH64 of the ids), then the number of frames, a
descriptor byte and the magic number. Any zstandard reader decompresses such a file as a whole.

Documents are dealt by ranges of their id, so that files and the documents in them are in ascending order (null ids
first). A task writes under a name of its own and the returned manifest names the files that count, so a lost or
repeated task leaves at most an unused file. Documents without text have no ids beside the end id.
"""

from __future__ import annotations

import functools
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wireloom.session import scratch_path, store

from .bpe import byte_letters
from .common import slices, worker_threads_off
from .pretoken import PieceStore

#: Ids in one frame, unless a single document has more.
FRAME_IDS = 1 << 16
# fixed values of the zstd seekable format
SEEK_FRAME, DIRECTORY_FRAME = 0x184D2A5E, 0x184D2A50
SEEKABLE_MAGIC, CHECKSUM_FLAG = 0x8F92EAB1, 0x80


@functools.cache
def library_store(path: str) -> PieceStore:
    """The tokenizers library over the distinct pieces of the texts."""
    worker_threads_off()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
    letters, tokenize = byte_letters(), tokenizer.model.tokenize

    def encode(pieces: list[str]) -> list[list[int]]:  # the library's model, without the objects of its pipeline
        return [[t.id for t in tokenize(p.encode().decode("latin-1").translate(letters))] for p in pieces]

    return PieceStore(encode, special)


def open_folder(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)


class FrameWriter:
    """Writes one file; ``add`` takes whole documents in order."""

    def __init__(self, out):
        self.out, self.compress = out, zstandard.ZstdCompressor(level=3)
        self.frames, self.keys, self.begins, self.held, self.n_held, self.n = [], [], [], [], 0, 0

    def add(self, keys: list[int | None], ids: np.ndarray, begins: np.ndarray) -> None:
        self.keys += keys
        self.begins.append(begins[:-1] + self.n)
        self.n += len(ids)
        cut = 0
        while cut < len(begins) - 1:  # as many documents as fill the frame
            room = max(FRAME_IDS - self.n_held, 1)
            end = max(cut + 1, int(np.searchsorted(begins, begins[cut] + room, side="right")) - 1)
            self.held.append(ids[begins[cut] : begins[end]])
            self.n_held += int(begins[end] - begins[cut])
            cut = end
            if self.n_held >= FRAME_IDS or cut < len(begins) - 1:
                self.flush()

    def flush(self) -> None:
        raw = np.concatenate(self.held).astype("<u4").tobytes() if self.held else b""
        if raw:
            packed = self.compress.compress(raw)
            self.out.write(packed)
            self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.held, self.n_held = [], 0

    def close(self) -> None:
        self.flush()
        keys = np.array([k or 0 for k in self.keys], "<i8").tobytes()
        null = np.array([k is None for k in self.keys], np.uint8).tobytes()
        begins = np.concatenate([*self.begins, [self.n]]).astype("<i8").tobytes()
        body = self.compress.compress(struct.pack("<Q", len(self.keys)) + keys + null + begins)
        self.out.write(struct.pack("<II", DIRECTORY_FRAME, len(body)) + body)
        self.frames.append((8 + len(body), 0, 0))
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        table += struct.pack("<IBI", len(self.frames), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SEEK_FRAME, len(table)) + table)


class FrameReader:
    """Reads single documents of one file; only the frames that hold them are decompressed."""

    def __init__(self, file):
        self.file, size = file, file.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError("no seek table")
        table = self._at(size - 9 - 12 * n, 12 * n)
        self.frames = np.frombuffer(table, "<u4").reshape(n, 3).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.frames[:, 0])])
        self.first = np.concatenate([[0], np.cumsum(self.frames[:, 1])]) // 4
        directory = int(self.at[-2])  # the last frame before the seek table
        magic, length = struct.unpack("<II", self._at(directory, 8))
        if magic != DIRECTORY_FRAME:
            raise ValueError("no directory")
        body = zstandard.ZstdDecompressor().decompress(self._at(directory + 8, length))
        (count,) = struct.unpack("<Q", body[:8])
        null = np.frombuffer(body, np.uint8, count, 8 + 8 * count)
        self.keys = [None if x else k for k, x in zip(np.frombuffer(body, "<i8", count, 8).tolist(), null.tolist())]
        self.begins = np.frombuffer(body, "<i8", count + 1, 8 + 9 * count)
        self.kept = (-1, np.zeros(0, np.uint32))

    def _at(self, start: int, length: int) -> bytes:
        self.file.seek(start)
        return self.file.read(length)

    def frame(self, k: int) -> np.ndarray:
        if self.kept[0] != k:
            raw = zstandard.ZstdDecompressor().decompress(self._at(int(self.at[k]), int(self.frames[k, 0])))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.frames[k, 2]:
                raise ValueError(f"frame {k} is damaged")
            self.kept = (k, np.frombuffer(raw, "<u4"))
        return self.kept[1]

    def ids(self, i: int) -> np.ndarray:
        """The ids of the i-th document of the file."""
        start, end = int(self.begins[i]), int(self.begins[i + 1])
        if start == end:
            return np.zeros(0, np.uint32)
        k = int(np.searchsorted(self.first, start, side="right")) - 1
        return self.frame(k)[start - self.first[k] : end - self.first[k]]


def write_frames(docs: DataFrame, path: str, end_id: int | None, folder: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and write all documents in ascending ``key`` order; returns the stored manifest.

    It has one row for each file: shard (ascending with the keys), path, n_docs, n_ids, first_key and last_key (null if it
    holds null keys only) and base, the number of ids in all files before. ``folder`` is a new one in the shared folder unless it is given.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = library_store(path), TaskContext.get().partitionId()
        system, base = open_folder(folder)
        name, writer, out = f"{base}/{shard:06d}-{uuid.uuid4().hex}.zst", None, None
        for part in slices(batches, text):
            ids, begins = encoder.ids_of(part.column(text))
            if end_id is not None:
                ids = np.insert(ids, begins[1:], end_id)
                begins = begins + np.arange(len(begins))
            if writer is None:
                system.create_dir(base, recursive=True)
                out = system.open_output_stream(name, compression=None)
                writer = FrameWriter(out)
            writer.add(part.column(key).to_pylist(), ids, begins)
        if writer is None:
            return
        writer.close()
        out.close()
        at = f"{folder.rstrip('/')}/{name.rsplit('/', 1)[1]}"
        keys = [k for k in writer.keys if k is not None]  # ascending, nulls first
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([shard], pa.int64()), pa.array([at], pa.string()), pa.array([len(writer.keys)], pa.int64()),
                pa.array([writer.n], pa.int64()), pa.array(keys[:1] or [None], pa.int64()), pa.array(keys[-1:] or [None], pa.int64()),
            ],
            names=["shard", "path", "n_docs", "n_ids", "first_key", "last_key"],
        )

    files = store(
        docs.select(F.col(key).cast("long").alias(key), text).repartitionByRange(key).sortWithinPartitions(key)
        .mapInArrow(run, "shard long, path string, n_docs long, n_ids long, first_key long, last_key long"),
        "token-files",
    ).table
    # a row for each file comes here, each of them holding a task's share of the texts
    rows = sorted(files.collect(), key=lambda r: r["shard"])
    base, listed = 0, []
    for r in rows:
        listed.append((*r, base))
        base += r["n_ids"]
    return spark.createDataFrame(listed, MANIFEST)


MANIFEST = "shard long, path string, n_docs long, n_ids long, first_key long, last_key long, base long"


def files_with(manifest: DataFrame, keys: list[int]) -> DataFrame:
    """The files that may hold some of ``keys``."""
    wanted = F.lit(sorted({k for k in keys if k is not None})).cast("array<bigint>")
    inside = F.exists(wanted, lambda k: (k >= F.col("first_key")) & (k <= F.col("last_key")))
    holds_null = F.lit(None in keys) & (F.col("first_key").isNull() | (F.col("shard") == 0))
    return manifest.filter(F.coalesce(inside, F.lit(False)) | holds_null)


def read_frames(manifest: DataFrame, keys: list[int] | None = None, key: str = "doc_id") -> DataFrame:
    """``key``, start (ids before the document) and ids of all documents, or only of ``keys``.

    Of the latter only files whose range of keys holds one are opened, and there only their frames.
    """
    wanted = None if keys is None else set(keys)
    manifest = manifest if keys is None else files_with(manifest, keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, at = open_folder(row["path"])
                with system.open_input_file(at) as file:
                    reader = FrameReader(file)
                    found = [i for i, k in enumerate(reader.keys) if wanted is None or k in wanted]
                    for lot in np.array_split(found, max(1, len(found) // 256)):
                        ids = [reader.ids(i) for i in lot]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([reader.keys[i] for i in lot], pa.int64()),
                                pa.array([row["base"] + int(reader.begins[i]) for i in lot], pa.int64()),
                                pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),
                            ],
                            names=[key, "start", "ids"],
                        )

    files = max(1, manifest.count())
    return manifest.repartition(files, "shard").mapInArrow(run, f"{key} long, start long, ids binary")


def digests(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """Number of ids and CRC-32 of each document, from the files."""
    read = read_frames(manifest, key=key)
    return read.select(key, "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))

