"""Helpers shared by the operators: text buffers, word hashes and packed exchanges.

Large per-position data travels packed: a row holds numpy arrays as binary columns for one (bucket, batch) pair, so
that Spark partitions and shuffles it without a JVM object for each position.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that one numpy step works on.
CHUNK = 1 << 19

ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
DEFAULTS = ("64MB", "67108864b", str(64 << 20), "-1", str((1 << 63) - 1))

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package where they share the code folder, and bound what is handed to them at once.

    Texts vary from nothing to megabytes, so Arrow batches are bounded by bytes unless the session bounds them.
    """
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    if spark.conf.get(ARROW_BYTES) in DEFAULTS:
        spark.conf.set(ARROW_BYTES, str(8 << 20))
    return spark


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def grouped(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct unsigned values, a stable order that brings equal entries together, and where each value begins in it.

    Values that leave room for their places are sorted together with these, which numpy does several times as fast.
    """
    room = len(x).bit_length()
    width = int(x.max()).bit_length() + room if len(x) else 65
    if width > 64:
        order = np.argsort(x, kind="stable")
        rising = x[order]
    else:
        kind = np.uint32 if width <= 32 else U64
        rising = x.astype(kind) << kind(room) | np.arange(len(x), dtype=kind)
        rising.sort()
        order = (rising & kind((1 << room) - 1)).astype(np.int64)
        rising >>= kind(room)
    fresh = np.ones(len(x), bool)
    fresh[1:] = rising[1:] != rising[:-1]
    begins = np.flatnonzero(fresh)
    return rising[begins].astype(x.dtype), order, begins


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct unsigned values, the first place of each, and which of them each entry is, as ``np.unique`` gives them."""
    values, order, begins = grouped(x)
    which = np.empty(len(x), np.int64)
    which[order] = np.repeat(np.arange(len(begins)), np.diff(begins, append=len(x)))
    return values, order[begins], which


#: A random 64-bit value for each byte.
BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(_BASE))

_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(CHUNK, 1 << (n - 1).bit_length() if n > 1 else 1)
        full = np.full(size, base, U64)
        full[0] = 1
        have = np.multiply.accumulate(full)
        if size <= 4 * CHUNK:
            _powers[base] = have
    return have[:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end]; equal spans have equal hashes wherever they stand."""
    if not len(starts):
        return np.zeros(0, U64)
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers(len(values)), out=total[1:])
    return mix((total[ends] - total[starts]) * powers(len(values) + 1, _INVERSE)[starts] + (ends - starts).astype(U64))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column, one after another, and where each begins; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held and held.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batches: Iterable[pa.RecordBatch], text: str, limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in runs of about ``limit`` text bytes; a longer text stands alone, whole."""
    for batch in batches:
        sizes = np.diff(flat(batch.column(text))[1])
        start, held = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start)
    pa.default_memory_pool().release_unused()


def byte_classes(separators: Iterable[int]) -> np.ndarray:
    """What each byte counts as inside a word, A-Z lower-cased; 0 separates."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[list(separators)] = 0
    return table


#: Words are runs of digits, letters and anything outside ASCII.
ALNUM = byte_classes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
#: Words are runs of anything but blanks.
BLANK = byte_classes([0x20, *range(0x09, 0x0E)])
# a zero byte may be part of a blank-separated word, so it needs a value that no other byte has there
BLANK[0] = 0x20


def find_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
    """Lower-cased bytes, starts and ends of all words, and the first word of each text; words never cross texts."""
    lowered = table[data]
    inside = lowered != 0
    before = np.empty(len(inside), bool)
    before[:1], before[1:] = False, inside[:-1]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    before[begins] = False
    after = np.empty(len(inside), bool)
    after[-1:], after[:-1] = False, inside[1:]
    after[begins[begins > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return lowered, starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the first word of each text."""
    lowered, starts, ends, firsts = find_words(data, offsets, table)
    return span_hashes(BYTE_VALUES[lowered], starts, ends), firsts


def joined_words(data: np.ndarray, offsets: np.ndarray):
    """All texts as their words with single blanks around, a zero byte before each; starts of words; first
    words."""
    lowered, starts, ends, firsts = find_words(data, offsets, ALNUM)
    n_texts, n = len(offsets) - 1, len(starts)
    text_of = np.repeat(np.arange(n_texts), np.diff(firsts))
    sizes = ends - starts
    before = np.cumsum(sizes) - sizes
    places = before + np.arange(n) + 2 * (text_of + 1)
    out = np.full(int(sizes.sum()) + n + 2 * n_texts, 0x20, np.uint8)
    out[np.arange(int(sizes.sum())) + np.repeat(places - before, sizes)] = lowered[lowered != 0]
    upto = np.append(before, sizes.sum())[firsts[:-1]]
    out[upto + firsts[:-1] + 2 * np.arange(n_texts)] = 0
    return out, places, firsts


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts, by one aggregate over that column."""
    return docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0


def extend(frame: DataFrame, keep: Iterable[str], more: str) -> StructType:
    """The columns ``keep`` of ``frame`` and those of the DDL string ``more``."""
    return StructType([frame.schema[c] for c in keep] + StructType.fromDDL(more).fields)


def worker_threads_off() -> None:
    """Libraries with thread pools of their own use the one core of the task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
