"""Byte-level BPE encoding and decoding with a public tokenizer's vocabulary.

A piece is encoded in one contiguous array: the ids of its parts and the merge rank of each adjacent pair. The least
rank is found by a scan, its boundary is deleted, and the two neighbouring ranks are refreshed. Pieces of more than
``SHORT`` bytes keep their ranks in a heap instead, where scans would take quadratic time.

Defined cases: null counts as the empty text, which has no ids and decodes to the empty text. Special tokens' strings
in a text become their ids, as the library does by default. Rows stay as given, repeated ones too; other columns are
not read.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import extend, slices
from .pretoken import PieceStore

SHORT = 256
NO_RANK = 1 << 60


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary file: its own where it has one."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class BytePairs:
    """Vocabulary and merges of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        vocab: dict[str, int] = held["model"]["vocab"]
        letters = byte_letters()
        self.byte_ids = [vocab[letters[b]] for b in range(256)]
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(held["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault(vocab[left] << 32 | vocab[right], rank)
            self.merged.append(vocab[left + right])
        self.special = {t["content"]: t["id"] for t in held["added_tokens"]}
        of_letter = {c: b for b, c in letters.items()}
        parts = {i: bytes(of_letter[c] for c in t) for t, i in vocab.items()}
        parts |= {i: t.encode() for t, i in self.special.items()}
        ordered = [parts.get(i, b"") for i in range(max(parts) + 1)]
        self.sizes = np.fromiter(map(len, ordered), np.int64, len(ordered))
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(ordered), np.uint8)

    def encode_piece(self, piece: bytes) -> list[int]:
        byte_ids, rank_of = self.byte_ids, self.ranks.get
        parts = [byte_ids[b] for b in piece]
        if len(parts) > SHORT:
            return self._encode_long(parts)
        ranks = [rank_of(a << 32 | b, NO_RANK) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            i = ranks.index(least)
            parts[i] = self.merged[least]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank_of(parts[i] << 32 | parts[i + 1], NO_RANK)
            if i:
                ranks[i - 1] = rank_of(parts[i - 1] << 32 | parts[i], NO_RANK)
        return parts

    def _encode_long(self, parts: list[int]) -> list[int]:
        n, rank_of = len(parts), self.ranks.get
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := rank_of(parts[i] << 32 | parts[i + 1], NO_RANK)) < NO_RANK]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j < 0 or rank_of(parts[i] << 32 | parts[j], NO_RANK) != rank:
                continue  # one of the two has been merged meanwhile
            parts[i], parts[j], after[i] = self.merged[rank], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := rank_of(parts[a] << 32 | parts[b], NO_RANK)) < NO_RANK:
                    heapq.heappush(heap, (r, a))
        return [p for p in parts if p >= 0]

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        encode = self.encode_piece
        return [encode(p.encode()) for p in pieces]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids, one after another."""
        size = self.sizes[ids]
        upto = np.cumsum(size)
        return self.bytes[np.repeat(self.begins[ids] - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)]


@functools.cache
def pairs_of(path: str) -> BytePairs:
    return BytePairs(path)


@functools.cache
def store_of(path: str) -> PieceStore:
    pairs = pairs_of(path)
    return PieceStore(pairs.encode_pieces, pairs.special)


def encode(docs: DataFrame, path: str, text: str = "text", keep: list[str] = ()) -> DataFrame:
    """``keep`` and ``ids``: array of int for each row of ``docs``; a column of that name is replaced."""
    keep = [c for c in keep if c != "ids"]
    schema = pa.schema([("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = store_of(path)
        for part in slices(batches, text):
            ids, begins = store.ids_of(part.column(text))
            lists = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), lists], names=[*keep, *schema.names])

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, extend(docs, keep, "ids array<int>"))


def decode(rows: DataFrame, path: str, ids: str = "ids", keep: list[str] = ()) -> DataFrame:
    """``keep`` and ``decoded``: the text of each row's ids; byte runs that aren't UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = pairs_of(path)
        for part in batches:
            texts = [
                pairs.decode(np.asarray(x, np.int64)).tobytes().decode("utf-8", "replace") for x in part.column(ids).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, "decoded"])

    return rows.select(*dict.fromkeys([*keep, ids])).mapInArrow(run, extend(rows, keep, "decoded string"))


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: ``key``, number of ids, SHA-256 of the ids and of the text decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, pairs = store_of(path), pairs_of(path)
        for part in slices(batches, text):
            ids, begins = store.ids_of(part.column(text))
            packed, ends = ids.astype("<u4").tobytes(), begins.tolist()
            decoded = pairs.decode(ids).tobytes()
            sizes = np.concatenate([[0], np.cumsum(pairs.sizes[ids])])[begins].tolist()
            whole = [decoded[a:b] for a, b in zip(sizes, sizes[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(key), pa.array(np.diff(begins)),
                    pa.array([hashlib.sha256(packed[4 * a : 4 * b]).hexdigest() for a, b in zip(ends, ends[1:])], pa.string()),
                    pa.array([hashlib.sha256(w.decode("utf-8", "replace").encode()).hexdigest() for w in whole], pa.string()),
                ],
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = extend(docs, [key], "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return docs.select(key, text).mapInArrow(run, schema)
