"""Benchmark decontamination by Wu-Manber search for windows of benchmark words.

Windows of all items are patterns: their words with single blanks around. Patterns of similar length form one searcher.
It looks at the block of bytes that would end a window's shortest form at the present place. The shift table, by
the block's hash, says how far to go on when no pattern can end there; at shift 0 the bucket of that block gives the
patterns to compare directly. Many places of a batch of texts advance together as one array.

Defined cases: a null text, or one without words, has no words and is clean; items without words have no windows; an
item of fewer words than a window is one window. Items with a null id count as hits but aren't listed. Repeated rows of
``docs`` are judged each, repeated items once. Extra columns are not read. The benchmark is taken in blocks of
``BLOCK_BYTES`` of text, so that what a task holds is bounded whatever its size; each block is one more pass in the same
tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import ALNUM, U64, extend, find_words, flat, joined_words, mix, prepare, slices

WINDOW = 13
#: Bytes of benchmark text searched for in one pass.
BLOCK_BYTES = 4 << 20
#: Bytes that one place of a text is responsible for.
LANE = 2048


def item_windows(text: str | None, window: int = WINDOW) -> list[bytes]:
    """All windows of an item, as patterns."""
    data, offsets = flat(pa.array([text], pa.string()))
    lowered, starts, ends, _ = find_words(data, offsets, ALNUM)
    words = [lowered[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())]
    if not words:
        return []
    return [b" " + b" ".join(words[i : i + window]) + b" " for i in range(max(1, len(words) - window + 1))]


class Searcher:
    """Shift table and buckets for patterns of at least ``m`` bytes."""

    def __init__(self, patterns: list[bytes]):
        self.patterns = patterns
        self.m = m = min(map(len, patterns))
        self.block = block = max(1, min(16, m // 2))
        heads = np.frombuffer(b"".join(p[:m] for p in patterns) + bytes(8), np.uint8)
        at = (np.arange(len(patterns)) * m)[:, None] + np.arange(m - block + 1)[None, :]
        hashes = self.hashes(self.words_at(heads), heads, at.ravel()).reshape(at.shape)
        self.bits = max(10, int(np.unique(hashes).size * 8).bit_length())
        slots = (hashes >> U64(64 - self.bits)).astype(np.int64)
        self.shift = np.full(1 << self.bits, m - block + 1, np.int32)
        for j in range(m - block + 1):
            np.minimum.at(self.shift, slots[:, j], m - block - j)
        order = np.argsort(slots[:, -1], kind="stable")
        self.bucket_slots, begins = np.unique(slots[order, -1], return_index=True)
        self.bucket_begins, self.bucket_patterns = np.append(begins, len(order)), order

    @staticmethod
    def words_at(buffer: np.ndarray) -> np.ndarray:
        """The eight bytes from each place on as one number; ``buffer`` has eight bytes to spare."""
        return np.ndarray((max(len(buffer) - 7, 0),), "<u8", buffer=buffer, strides=(1,))

    def hashes(self, words: np.ndarray, buffer: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Hashes of the blocks that begin at ``at``."""
        if self.block >= 8:
            return mix(mix(words[at]) + words[at + self.block - 8])
        return mix(words[at] & U64((1 << (8 * self.block)) - 1))

    def search(self, buffer: np.ndarray, raw: bytes) -> list[tuple[int, int]]:
        """(place, pattern) of all occurrences; eight spare bytes end the buffer."""
        end = len(buffer) - 8 - self.m + 1  # places where a pattern may begin
        if end <= 0:
            return []
        words, found = self.words_at(buffer), []
        at = np.arange(0, end, LANE)
        until = np.minimum(at + LANE, end)
        while len(at):
            slots = (self.hashes(words, buffer, at + self.m - self.block) >> U64(64 - self.bits)).astype(np.int64)
            go = self.shift[slots]
            stop = np.flatnonzero(go == 0)
            if len(stop):
                k = np.searchsorted(self.bucket_slots, slots[stop])
                for place, a, b in zip(at[stop].tolist(), self.bucket_begins[k].tolist(), self.bucket_begins[k + 1].tolist()):
                    for p in self.bucket_patterns[a:b].tolist():
                        if raw.startswith(self.patterns[p], place):
                            found.append((place, p))
            at = at + np.maximum(go, 1)
            live = at < until
            at, until = at[live], until[live]
        return found


class Windows:
    """Searchers for a block of items, one for each doubling of the patterns' length."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        owners: dict[bytes, set] = {}
        for item, text in items:
            for pattern in item_windows(text, window):
                owners.setdefault(pattern, set()).add(item)
        groups: dict[int, list[bytes]] = {}
        for pattern in owners:
            groups.setdefault(len(pattern).bit_length(), []).append(pattern)
        self.searchers = [Searcher(sorted(g)) for g in groups.values()]
        self.owners = [[(sorted(str(i) for i in owners[p] if i is not None), p.count(b" ") - 1) for p in s.patterns] for s in self.searchers]

    def hits(self, buffer: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, list[tuple[int, list[str]]]]:
        """Begin and end words of all occurrences, and the items of each."""
        raw, spans, items = buffer.tobytes(), [], []
        for searcher, owners in zip(self.searchers, self.owners):
            found = searcher.search(buffer, raw)
            first = np.searchsorted(places, [place + 1 for place, _ in found])
            for k, (_, p) in zip(first.tolist(), found):
                spans.append((k, k + owners[p][1]))
                items.append((k, owners[p][0]))
        return np.array(spans, np.int64).reshape(-1, 2), items


def item_blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[list[tuple]]:
    """Items in lots of about ``block_bytes``."""
    held, size = [], 0
    for row in benchmark.select(item, text).distinct().toLocalIterator():
        held.append((row[0], row[1]))
        size += len((row[1] or "").encode())
        if size >= block_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def with_last(lots: Iterator[list]) -> Iterator[tuple[list, bool]]:
    """Each lot, and whether it is the last; an empty one if there is none. Two at a time are on the driver."""
    held = next(lots, [])
    for lot in lots:
        yield held, False
        held = lot
    yield held, True


def find_benchmark(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
    finish: tuple[Callable[[pa.RecordBatch], pa.RecordBatch], StructType] | None = None,
) -> DataFrame:
    """``docs`` with _words (their number), _spans (hit words from, to) and _items (ids as text, sorted).

    ``finish``, a function of such rows and its columns, is applied where the last block is searched for, so that no
    second worker runs beside that one.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in ("_words", "_spans", "_items")]
    found = docs.select(
        *[F.col(f"`{c}`") for c in names], F.lit(0).cast("long").alias("_words"),
        F.array().cast("array<bigint>").alias("_spans"), F.array().cast("array<string>").alias("_items"),
    )
    schema = found.schema

    def scan_with(held, finish):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows = held.value
            for part in slices(batches, text):
                buffer, places, firsts = joined_words(*flat(part.column(text)))
                spans, items = windows.hits(np.append(buffer, np.zeros(8, np.uint8)), places)
                own = np.searchsorted(firsts, spans[:, 0], side="right") - 1
                all_spans, all_items = part.column("_spans").to_pylist(), [set(x) for x in part.column("_items").to_pylist()]
                for d, (a, b) in zip(own.tolist(), (spans - firsts[own][:, None]).tolist()):
                    all_spans[d] += [a, b]
                for d, (_, ids) in zip(own.tolist(), items):
                    all_items[d].update(ids)
                scanned = pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in names), pa.array(np.diff(firsts)), pa.array(all_spans, pa.list_(pa.int64())),
                        pa.array([sorted(x) for x in all_items], pa.list_(pa.string())),
                    ],
                    names=[*names, "_words", "_spans", "_items"],
                )
                yield finish(scanned) if finish else scanned

        return scan

    for lot, last in with_last(item_blocks(benchmark, item, item_text, block_bytes)):
        step, columns = finish if finish and last else (None, schema)
        found = found.mapInArrow(scan_with(spark.sparkContext.broadcast(Windows(lot, window)), step), columns)
    return found


def covered(spans: list[int]) -> int:
    """Words inside any of the spans (from, to, from, to, ...)."""
    total, reached = 0, 0
    for a, b in sorted(zip(spans[::2], spans[1::2])):
        total += max(0, b - max(a, reached))
        reached = max(reached, b)
    return total


def judge(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", **options) -> DataFrame:
    """``keep``, n_words, n_hit, n_items, items_sha256 and contaminated for each row of ``docs``.

    Columns of ``keep`` with the name of one of these are replaced.
    """
    prepare(docs.sparkSession)
    keep = [c for c in keep if c not in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")]
    read = list(dict.fromkeys([*keep, text]))

    def sums(part: pa.RecordBatch) -> pa.RecordBatch:
        words, items = part.column("_words").to_pylist(), part.column("_items").to_pylist()
        hit = [covered(s) for s in part.column("_spans").to_pylist()]
        digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
        return pa.RecordBatch.from_arrays(
            [
                *(part.column(c) for c in keep), pa.array(words, pa.int64()), pa.array(hit, pa.int64()),
                pa.array([len(x) for x in items], pa.int64()), pa.array(digest, pa.string()),
                pa.array([h > 0 and 20 * h >= w for h, w in zip(hit, words)], pa.bool_()),
            ],
            names=[*keep, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )

    schema = extend(docs, keep, "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
    return find_benchmark(docs.select(*[F.col(f"`{c}`") for c in read]), benchmark, text, finish=(sums, schema), **options)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns."""
    inner = [f"_{i}" for i in range(len(docs.columns))]  # columns of the judgement's names may be among them
    renamed = docs.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(docs.columns, inner)])
    judged = judge(renamed, benchmark, inner, inner[docs.columns.index(text)], **options)
    return judged.filter(~F.col("contaminated")).select(*[F.col(i).alias(c) for c, i in zip(docs.columns, inner)])
