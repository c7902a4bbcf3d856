"""Texts in packed batches that ask buckets and are answered.

``pack`` writes the texts once, compressed, a row for each batch of some megabytes, as a bucketed table: later steps
read a batch beside what was sent to it without moving the texts again. Questions and answers are arrays of numbers in
binary columns, a row for each (batch, bucket) pair; a batch asks for each distinct value once, so that a value
which a third of all texts hold reaches its bucket once for each batch.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from wireloom.session import scratch_path

from .common import U64, flat, grouped, shuffle_partitions, slices, text_bytes

SMALLEST, LARGEST = 1 << 19, 6 << 20
#: Rows of a batch, nearly; a row's number is its batch and its place there.
MOST_ROWS = 1 << 19
PLACE_BITS = 20
#: Files that the table of batches is bucketed into, at most.
MOST_FILES = 50_000


_coders = threading.local()  # which are not for threads to share


def compress(raw: bytes, level: int = 1) -> bytes:
    coder = _coders.__dict__.get(level)
    if coder is None:
        coder = _coders.__dict__[level] = zstandard.ZstdCompressor(level=level)
    return coder.compress(raw)


def expand(packed: bytes) -> bytes:
    coder = _coders.__dict__.get("expand")
    if coder is None:
        coder = _coders.__dict__["expand"] = zstandard.ZstdDecompressor()
    return coder.decompress(packed)


def pack_array(x: np.ndarray) -> bytes:
    """Integers as compressed bytes, first bytes first; high bytes that are zero in all of them are left out."""
    x = np.ascontiguousarray(x)
    used = x.dtype.itemsize
    if not len(x):
        used = 1
    elif x.dtype.kind == "u" or x.min() >= 0:
        used = max(1, -(-int(x.max()).bit_length() // 8))
    out = np.empty(1 + used * len(x), np.uint8)
    out[0] = used
    planes, held = out[1:].reshape(used, len(x)), x.view(np.uint8).reshape(len(x), x.dtype.itemsize)
    for i in range(used):
        planes[i] = held[:, i]
    return compress(out)


def unpack_array(packed: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(expand(packed), np.uint8)
    planes = raw[1:].reshape(int(raw[0]), -1)
    out = planes[0].astype(dtype)
    held = out.view(np.uint8).reshape(len(out), out.dtype.itemsize)
    for i in range(1, len(planes)):
        held[:, i] = planes[i]
    return out


def whole(held: list[pa.RecordBatch]) -> bytes:
    """The rows of a batch as they are, for ``unpack``."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, held[0].schema) as out:
        for part in held:
            out.write_batch(part)
    return compress(sink.getvalue().to_pybytes(), 3)


def pack(
    docs: DataFrame, columns: list[str], text: str = "text", encode: Callable[[list[pa.RecordBatch]], bytes] = whole
) -> tuple[DataFrame, int]:
    """A table of batches (batch, blob) with ``columns`` of all rows, and about how many there are.

    ``encode`` makes a blob of a batch's rows, which come in runs of about a megabyte.
    """
    spark = docs.sparkSession
    size = text_bytes(docs, text)
    limit = min(max(SMALLEST, size // (2 * shuffle_partitions(spark))), LARGEST)
    n = max(1, -(-size // limit))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, seen = TaskContext.get().partitionId() << 12, 0
        held: list[pa.RecordBatch] = []
        bytes_held = rows_held = 0

        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([first + seen], pa.int64()), pa.array([encode(held)], pa.binary())], names=["batch", "blob"]
            )

        for part in slices(rows, text, SMALLEST):
            held.append(part)
            bytes_held += len(flat(part.column(text))[0])
            rows_held += part.num_rows
            if bytes_held >= limit or rows_held >= MOST_ROWS:
                yield emit()
                held, bytes_held, rows_held, seen = [], 0, 0, seen + 1
                if seen == 1 << 12:
                    raise ValueError("too much text in one partition: repartition the documents first")
        if held:
            yield emit()

    name = f"packed_{uuid.uuid4().hex}"
    made = docs.select(*columns).mapInArrow(run, "batch long, blob binary")
    made.write.format("parquet").option("compression", "none").option("path", scratch_path(spark, "packed")).bucketBy(
        min(2 * n, MOST_FILES), "batch"
    ).saveAsTable(name)
    return spark.table(name), n


def unpack(blob: bytes) -> list[pa.RecordBatch]:
    """The rows of a batch in runs of about a megabyte."""
    return list(pa.ipc.open_stream(expand(blob)))


def row_numbers(batch: int, n: int) -> np.ndarray:
    """Numbers of a batch's rows, unique over all batches."""
    return (np.int64(batch) << PLACE_BITS) + np.arange(n)


def take(packed: DataFrame, numbers: DataFrame, columns: StructType) -> DataFrame:
    """The rows whose number is in ``numbers`` (column uid), with their ``columns``."""
    names = columns.fieldNames()

    def run(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        out = []
        for row in rows.to_pylist():
            whole = pa.Table.from_batches(unpack(row["blob"])).select(names)
            places = np.sort(wanted.column("uid").to_numpy() - (np.int64(row["batch"]) << PLACE_BITS))
            out.append(whole.take(pa.array(places)))
        return pa.concat_tables(out) if out else empty

    empty = to_arrow_schema(columns).empty_table()
    asked = numbers.select((F.shiftright("uid", PLACE_BITS)).alias("batch"), "uid")
    return packed.groupBy("batch").cogroup(asked.groupBy("batch")).applyInArrow(run, columns)


def n_buckets(table: DataFrame, batches: int) -> int:
    """Buckets that equal values meet in: some for each task, and growing with the texts."""
    return max(2 * shuffle_partitions(table.sparkSession), batches)


def by_bucket(bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that groups entries by bucket, the buckets that have any, and their bounds in it."""
    present, order, begins = grouped(bucket.astype(U64))
    return order, present.astype(np.int64), np.append(begins, len(order))
