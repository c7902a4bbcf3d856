"""Removal of passages that an earlier document holds, by distributed prefix doubling over byte positions.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts in a document of a smaller id. Positions of one
rank share their first bytes. Two rounds find the positions whose first ``LENGTH`` bytes are shared:

1. Rank by ``GRAM`` bytes. Of each window of LENGTH bytes one position speaks for it, that of the smallest scrambled
   rank (leftmost of equals). Equal windows choose alike, so if that position's rank occurs in one document only, every
   window it speaks for is unique and leaves. Batches send each distinct rank once to the rank's bucket.
2. The rest go on with their surroundings, each distinct stretch once for each batch. A bucket ranks all their
   positions by LENGTH / 2 bytes, sorts the pairs of ranks at offset LENGTH / 2, and so ranks by LENGTH; each class
   is checked byte by byte. The least document of each position's class goes back to the batches.

Ranks travel packed, a row for each (batch, bucket): see ``batches``. What a batch holds many times is sent once, so that
a passage of a third of all documents reaches its bucket once for each batch.

Defined cases: null counts as empty; a null id counts as larger than all; documents of equal ids don't take from each
other. Texts shorter than LENGTH stay. Strings are judged on the input and never cross documents. ``drop_repeats`` keeps
all columns and rows; bytes of a character that was cut into go with it, and n_chars is renewed where it exists.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from wireloom.session import store

from . import batches
from .batches import pack_array, unpack_array
from .common import BYTE_VALUES, U64, extend, flat, mix, prepare, span_hashes

LENGTH, GRAM = 50, 24
HALF = LENGTH // 2
#: Windows that a position may speak for, and so positions that a window chooses among.
SPREAD = LENGTH - GRAM + 1
LAST = np.iinfo(np.int64).max
#: Windows that a bucket ranks at once, about.
SLICE = 1 << 19


def eight(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one number; ``data`` has eight spare bytes."""
    return np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))


def gram_ranks(data: np.ndarray) -> np.ndarray:
    """A rank of the GRAM bytes from each position on (equal bytes, equal ranks)."""
    n = len(data) - GRAM + 1
    words = eight(np.append(data, np.zeros(8, np.uint8)))
    return mix(mix(mix(words[:n]) + words[8 : n + 8]) + words[16 : n + 16])


class Stretches:
    """Runs of adjacent windows of one text that the same position speaks for."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, empty = data, np.zeros(0, np.int64)
        self.speaker, self.first, self.count, self.text, self.rank = empty, empty, empty, empty, np.zeros(0, U64)
        if len(data) < LENGTH:
            return
        ranks = gram_ranks(data)
        best = (ranks & U64(0xFFFFFFFF00000000)) | np.arange(len(ranks), dtype=U64)
        width = 1
        while 2 * width <= SPREAD:
            best, width = np.minimum(best[:-width], best[width:]), 2 * width
        best = np.minimum(best[: len(best) - (SPREAD - width)], best[SPREAD - width :])  # for each window
        sizes = np.maximum(np.diff(offsets) - LENGTH + 1, 0)
        windows = np.arange(int(sizes.sum())) + np.repeat(offsets[:-1] - (np.cumsum(sizes) - sizes), sizes)
        speaker = (best[windows] & U64(0xFFFFFFFF)).astype(np.int64)
        fresh = np.ones(len(windows), bool)
        fresh[1:] = (speaker[1:] != speaker[:-1]) | (windows[1:] != windows[:-1] + 1)
        at = np.flatnonzero(fresh)
        self.first, self.speaker = windows[at], speaker[at]
        self.count = np.diff(np.append(at, len(windows)))
        self.text = np.searchsorted(offsets, self.first, side="right") - 1
        self.rank = ranks[self.speaker]

    def cut(self, keep: np.ndarray) -> None:
        for name in ("first", "speaker", "count", "text", "rank"):
            setattr(self, name, getattr(self, name)[keep])

    def keys(self) -> np.ndarray:
        """Equal for stretches of the same bytes and the same place of the speaking position."""
        content = span_hashes(BYTE_VALUES[self.data], self.first, self.first + self.count + LENGTH - 1)
        return mix(content + mix(self.rank + (self.speaker - self.first).astype(U64)))


class Batch:
    """All texts of a packed batch, in runs."""

    def __init__(self, blob: bytes, key: str, text: str):
        self.parts = batches.unpack(blob)
        self.runs = [Stretches(*flat(p.column(text))) for p in self.parts]
        self.ids = [p.column(key).cast(pa.int64()).fill_null(LAST).to_numpy() for p in self.parts]

    def ranks(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct ranks, and which of them two documents of the batch hold."""
        rank = np.concatenate([r.rank for r in self.runs])
        ids = np.concatenate([i[r.text] for r, i in zip(self.runs, self.ids)])
        order = np.lexsort((ids, rank))
        rank, ids = rank[order], ids[order]
        first = np.ones(len(rank), bool)
        first[1:] = rank[1:] != rank[:-1]
        at = np.flatnonzero(first)
        last = np.append(at[1:], len(rank)) - 1
        return rank[at], (ids[at] != ids[last]) if len(at) else np.zeros(0, bool)

    def keep_shared(self, answers: list[dict], n: int) -> None:
        """Drop stretches whose rank occurs in one document only."""
        ranks, _ = self.ranks()
        order, present, bounds = batches.by_bucket(bucket_of(ranks, n), n)
        by = {a["bucket"]: a["a"] for a in answers}
        shared = np.zeros(len(ranks), bool)
        for b, i, j in zip(present.tolist(), bounds, bounds[1:]):
            shared[order[i:j]] = np.unpackbits(np.frombuffer(by[b], np.uint8), count=j - i).astype(bool)
        shared = ranks[shared]
        for run in self.runs:
            at = np.searchsorted(shared, run.rank)
            run.cut((at < len(shared)) & (shared[np.minimum(at, len(shared) - 1)] == run.rank) if len(shared) else np.zeros(len(run.rank), bool))

    def distinct(self):
        """Number of each stretch's content, and for each content one stretch (run, place), its least id and its rank."""
        keys = np.concatenate([r.keys() for r in self.runs])
        ids = np.concatenate([i[r.text] for r, i in zip(self.runs, self.ids)])
        found, first, number = np.unique(keys, return_index=True, return_inverse=True)
        least = np.full(len(found), LAST)
        np.minimum.at(least, number, ids)
        starts = np.cumsum([0, *(len(r.rank) for r in self.runs)])
        run = np.searchsorted(starts, first, side="right") - 1
        return number, run, first - starts[run], least


def bucket_of(ranks: np.ndarray, n: int) -> np.ndarray:
    return (ranks % U64(n)).astype(np.int64)


RANKS = "batch long, bucket int, a binary, b binary"
CONTENTS = "batch long, bucket int, rank binary, lead binary, count binary, least binary, bytes binary"


def table_of(ddl: str, rows: list[tuple]) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [c.split() for c in ddl.split(", ")]
    columns = zip(*rows) if rows else [[] for _ in fields]
    return pa.table({name: pa.array(list(c), kinds[kind]) for (name, kind), c in zip(fields, columns)})


def ask_ranks(key: str, text: str, n: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows:
            for row in part.to_pylist():
                ranks, twice = Batch(row["blob"], key, text).ranks()
                order, present, bounds = batches.by_bucket(bucket_of(ranks, n), n)
                ranks, twice = ranks[order], twice[order]
                yield from table_of(
                    RANKS,
                    [(row["batch"], b, ranks[i:j].tobytes(), np.packbits(twice[i:j]).tobytes()) for b, i, j in zip(present.tolist(), bounds, bounds[1:])],
                ).to_batches()

    return run


def shared_ranks(group: pa.Table) -> pa.Table:
    """One bucket: which ranks occur in two documents, told to each batch that asked."""
    asked = group.to_pylist()
    ranks = [np.frombuffer(q["a"], "<u8") for q in asked]
    twice = np.concatenate([np.unpackbits(np.frombuffer(q["b"], np.uint8), count=len(r)) for q, r in zip(asked, ranks)]).astype(bool)
    found, at, times = np.unique(np.concatenate(ranks), return_inverse=True, return_counts=True)
    shared = times > 1
    shared[at[twice]] = True
    marks, done, out = shared[at], 0, []
    for q, r in zip(asked, ranks):
        out.append((q["batch"], q["bucket"], np.packbits(marks[done : done + len(r)]).tobytes(), b""))
        done += len(r)
    return table_of(RANKS, out)


def ask_contents(key: str, text: str, n: int):
    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        for row in rows.to_pylist():
            batch = Batch(row["blob"], key, text)
            batch.keep_shared(told.to_pylist(), n)
            _, run, place, least = batch.distinct()
            if not len(run):
                continue
            rank, first, count, speaker = (gather(batch.runs, run, place, x) for x in ("rank", "first", "count", "speaker"))
            order, present, bounds = batches.by_bucket(bucket_of(rank, n), n)
            for b, i, j in zip(present.tolist(), bounds, bounds[1:]):
                mine = order[i:j]
                content = [batch.runs[r].data[f : f + c + LENGTH - 1] for r, f, c in zip(run[mine].tolist(), first[mine].tolist(), count[mine].tolist())]
                out.append(
                    (
                        row["batch"], b, pack_array(rank[mine]), pack_array((speaker - first)[mine].astype(np.uint8)),
                        pack_array(count[mine].astype(np.uint8)), pack_array(least[mine]), batches.compress(np.concatenate(content).tobytes()),
                    )
                )
        return table_of(CONTENTS, out)

    return run


def gather(runs: list[Stretches], run: np.ndarray, place: np.ndarray, name: str) -> np.ndarray:
    out = np.zeros(len(run), getattr(runs[0], name).dtype)
    for k, r in enumerate(runs):
        mine = run == k
        out[mine] = getattr(r, name)[place[mine]]
    return out


def rank_windows(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Ranks of the LENGTH bytes at each of ``at``, by doubling from HALF bytes; equal ranks mean equal bytes."""
    words = eight(np.append(data, np.zeros(8, np.uint8)))
    both = np.concatenate([at, at + HALF])
    prefix = mix(mix(mix(words[both]) + words[both + 8]) + words[both + 16]) + mix(words[both + HALF - 8] + U64(1))
    found, rank = np.unique(prefix, return_inverse=True)
    left, right = rank[: len(at)].astype(U64), rank[len(at) :].astype(U64)
    found, first, rank = np.unique(left << U64(32) | right, return_index=True, return_inverse=True)
    for shift in (*range(0, LENGTH - 8, 8), LENGTH - 8):  # byte by byte, eight at a time
        if not (words[at + shift] == words[at[first[rank]] + shift]).all():
            whole = data[at[:, None] + np.arange(LENGTH)]
            return np.unique(whole, axis=0, return_inverse=True)[1]
    return rank


def answer_windows(answer: np.ndarray, data: np.ndarray, windows: np.ndarray, starts: np.ndarray, firsts: np.ndarray, least: np.ndarray) -> None:
    """The least document of each window of some contents, put where ``answer`` has that content's windows."""
    step = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    rank = rank_windows(data, step + np.repeat(starts, windows))
    ids = np.repeat(least, windows)
    best = np.full(int(rank.max()) + 1, LAST)
    np.minimum.at(best, rank, ids)
    answer[step + np.repeat(firsts, windows)] = best[rank]


def least_documents(group: pa.Table) -> pa.Table:
    """One bucket: for all windows of all contents the least document that holds the same bytes, told as runs.

    Equal windows have equal ranks of their speaking positions, so contents are taken in slices by that rank.
    """
    asked = group.to_pylist()
    count = [unpack_array(q["count"], np.uint8).astype(np.int64) for q in asked]
    least = np.concatenate([unpack_array(q["least"], "<i8") for q in asked])
    data = np.frombuffer(b"".join(batches.expand(q["bytes"]) for q in asked), np.uint8)
    windows = np.concatenate(count)
    sizes = windows + LENGTH - 1
    starts, firsts = np.cumsum(sizes) - sizes, np.cumsum(windows) - windows
    total = int(windows.sum())
    n_slices = -(-total // SLICE)
    slice_of = mix(np.concatenate([unpack_array(q["rank"], "<u8") for q in asked])) % U64(max(n_slices, 1))
    answer = np.empty(total, np.int64)
    for k in range(n_slices):
        some = np.flatnonzero(slice_of == U64(k))
        if len(some):
            answer_windows(answer, data, windows[some], starts[some], firsts[some], least[some])
    done, out = 0, []
    for q, c in zip(asked, count):
        mine = answer[done : done + int(c.sum())]
        done += len(mine)
        change = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))
        out.append((q["batch"], q["bucket"], pack_array(mine[change]), pack_array(np.diff(np.append(change, len(mine))))))
    return table_of(RANKS, out)


def removed_bytes(batch: Batch, told: list[dict], n: int) -> list[np.ndarray]:
    """For each run of texts, which of its bytes go."""
    number, run, place, _ = batch.distinct()
    answers: np.ndarray | None = None
    out = []
    if len(run):
        rank, count = gather(batch.runs, run, place, "rank"), gather(batch.runs, run, place, "count")
        order, present, bounds = batches.by_bucket(bucket_of(rank, n), n)
        by = {t["bucket"]: t for t in told}
        answers = np.concatenate([np.repeat(unpack_array(by[b]["a"], "<i8"), unpack_array(by[b]["b"], "<i8")) for b in present.tolist()])
        begins = np.empty(len(run), np.int64)
        begins[order] = np.cumsum(count[order]) - count[order]
    done = 0
    for held, ids in zip(batch.runs, batch.ids):
        total = len(held.rank)
        cover = np.zeros(len(held.data) + 1, np.int32)
        if total:
            mine = number[done : done + total]
            done += total
            k = np.arange(int(held.count.sum())) - np.repeat(np.cumsum(held.count) - held.count, held.count)
            window = np.repeat(held.first, held.count) + k
            least = answers[np.repeat(begins[mine], held.count) + k]
            window = window[least < np.repeat(ids[held.text], held.count)]
            np.add.at(cover, window, 1)
            np.add.at(cover, window + LENGTH, -1)
        out.append(np.cumsum(cover[:-1]) > 0)
    return out


def find_repeats(docs: DataFrame, key: str, text: str):
    """The packed texts, the buckets' last answers, and their number."""
    prepare(docs.sparkSession)
    packed, n_batches = batches.pack(docs, docs.columns, text)
    n = batches.n_buckets(packed, n_batches)
    shared = store(packed.mapInArrow(ask_ranks(key, text, n), RANKS).groupBy("bucket").applyInArrow(shared_ranks, RANKS), "shared-ranks").table
    contents = packed.groupBy("batch").cogroup(shared.groupBy("batch")).applyInArrow(ask_contents(key, text, n), CONTENTS)
    least = store(contents.groupBy("bucket").applyInArrow(least_documents, RANKS), "least-documents").table
    answers = shared.withColumn("kind", F.lit(1)).unionByName(least.withColumn("kind", F.lit(2)))
    return packed, answers, n


def map_kept(docs: DataFrame, schema, make, key: str, text: str) -> DataFrame:
    """``make(rows, removed)`` for runs of rows, where ``removed`` says of each byte of their texts whether it goes."""
    packed, answers, n = find_repeats(docs, key, text)

    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        out, told = [], told.to_pylist()
        for row in rows.to_pylist():
            batch = Batch(row["blob"], key, text)
            batch.keep_shared([t for t in told if t["kind"] == 1], n)
            for part, gone in zip(batch.parts, removed_bytes(batch, [t for t in told if t["kind"] == 2], n)):
                out.append(make(part, gone))
        return pa.Table.from_batches(out) if out else empty

    empty = to_arrow_schema(schema).empty_table()
    return packed.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(run, schema)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_bytes, n_removed, n_spans and kept_sha256 for each row."""

    def make(part: pa.RecordBatch, gone: np.ndarray) -> pa.RecordBatch:
        data, offsets = flat(part.column(text))
        begin = gone & ~np.append(False, gone[:-1])
        inner = offsets[:-1][offsets[:-1] < len(data)]
        begin[inner] = gone[inner]  # runs don't go on from text to text
        removed, runs = np.append(0, np.cumsum(gone)), np.append(0, np.cumsum(begin))
        bounds = offsets.tolist()
        kept = [hashlib.sha256(data[a:b][~gone[a:b]].tobytes()).hexdigest() for a, b in zip(bounds, bounds[1:])]
        return pa.RecordBatch.from_arrays(
            [
                part.column(key).cast(pa.int64()), pa.array(np.diff(offsets)), pa.array(np.diff(removed[offsets])), pa.array(np.diff(runs[offsets])),
                pa.array(kept, pa.string()),
            ],
            names=[key, "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )

    read = docs.select(F.col(key).cast("long").alias(key), text)
    return map_kept(read, extend(read, [key], "n_bytes long, n_removed long, n_spans long, kept_sha256 string"), make, key, text)


def drop_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with what earlier documents hold taken out of their texts; null texts stay null."""
    names = docs.columns

    def make(part: pa.RecordBatch, gone: np.ndarray) -> pa.RecordBatch:
        data, offsets = flat(part.column(text))
        bounds, null = offsets.tolist(), part.column(text).is_null().to_pylist()
        kept = [None if x else data[a:b][~gone[a:b]].tobytes().decode("utf-8", "ignore") for a, b, x in zip(bounds, bounds[1:], null)]
        columns = {text: pa.array(kept, pa.string())}
        if "n_chars" in names:
            columns["n_chars"] = pa.array([None if k is None else len(k) for k in kept], part.column("n_chars").type)
        return pa.RecordBatch.from_arrays([columns.get(c, part.column(c)) for c in names], names=names)

    return map_kept(docs, docs.schema, make, key, text)
