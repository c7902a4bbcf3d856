"""Splitting texts into the pieces that byte-level BPE encodes one by one, over whole arrays of code points.

The split is the public pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
A run of one character class is a piece; one plain space before it joins it; of several blanks before a run the last
stands apart; a lone apostrophe that starts a piece takes one of the seven endings with it.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex

from .common import U64, flat, mix, span_hashes

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
#: Pieces that one worker keeps encoded; beyond, the store starts anew.
KEPT_PIECES = 250_000


@functools.cache
def classes() -> np.ndarray:
    """The class of each code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for found in regex.finditer(pattern, every):
            points = np.frombuffer(found[0].encode("utf-32-le"), np.uint32)
            table[points] = kind
    return table


@functools.cache
def point_values() -> np.ndarray:
    """A random 64-bit value for each code point."""
    return mix(np.arange(1, 0x110001, dtype=U64))


def piece_starts(points: np.ndarray, segments: np.ndarray) -> np.ndarray:
    """Where pieces start; ``segments`` are the starts of texts, which no piece crosses."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    fresh = np.zeros(n + 1, bool)
    fresh[segments[segments < n]] = True
    run = fresh[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    run[0] = True
    starts = np.append(run, True)
    # blanks that something follows in the same text
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~fresh[1:n]) if n > 1 else np.zeros(0, np.int64)
    starts[last] = True
    starts[last[points[last] == 0x20] + 1] = False
    # a lone apostrophe at the start of a piece, and a letter
    q = np.flatnonzero((points[:-1] == 0x27) & starts[: n - 1] & run[: n - 1] & (kind[1:] == LETTER) & ~fresh[1:n]) if n > 1 else last
    if len(q):
        first = points[q + 1]
        one = np.isin(first, [ord(c) for c in "stmd"])
        second = np.where((q + 2 < n) & ~fresh[np.minimum(q + 2, n)], points[np.minimum(q + 2, n - 1)], 0)
        two = ((first == ord("r")) & (second == ord("e"))) | ((first == ord("v")) & (second == ord("e"))) | (
            (first == ord("l")) & (second == ord("l"))
        )
        starts[q[one | two] + 1] = False
        starts[q[one] + 2] = True
        starts[q[two] + 3] = True
    return np.flatnonzero(starts[:n])


class PieceStore:
    """Ids of pieces seen before, by the pieces' hashes; ``encode`` gives those of new pieces."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], special: dict[str, int]):
        self.encode, self.special = encode, special
        self.marks = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.clear()

    def clear(self) -> None:
        self.slots: dict[int, int] = {}
        self.begins = np.zeros(1, np.int64)  # of slot 0, 1, ... and the end
        self.ids = np.zeros(0, np.uint32)

    def ids_of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's begin."""
        data, offsets = flat(column)
        text = data.tobytes().decode()
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        before = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=before[1:])
        texts = before[offsets]
        marks = [(m.start(), m.end(), self.special[m[0]]) for m in self.marks.finditer(text)] if self.marks else []
        if marks:  # a mark never spans two texts
            own = np.searchsorted(texts, [m[0] for m in marks], side="right")
            marks = [m for m, k in zip(marks, own.tolist()) if k < len(texts) and m[1] <= texts[k]]
        segments = np.unique(np.concatenate([texts[:-1], np.array([x for m in marks for x in m[:2]], np.int64)]))
        starts = piece_starts(points, segments)
        if marks:  # one piece for each
            a, b = np.array([m[0] for m in marks]), np.array([m[1] for m in marks])
            at = np.searchsorted(a, starts, side="right") - 1
            starts = starts[(at < 0) | (starts >= b[at]) | (starts == a[at])]
        ends = np.append(starts[1:], len(points))[: len(starts)]
        hashes = span_hashes(point_values()[points], starts, ends)
        for m in marks:
            hashes[np.searchsorted(starts, m[0])] = U64(m[2])
        found, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.slots) > KEPT_PIECES:
            self.clear()
        slots = self.slots
        known = [slots.get(h, -1) for h in found.tolist()]
        new = [i for i, s in enumerate(known) if s < 0]
        if new:
            by_mark = {m[2]: m[2] for m in marks}
            firsts, hashed = first[new], found[new].tolist()
            encoded = self.encode([text[a:b] for a, b in zip(starts[firsts].tolist(), ends[firsts].tolist())])
            encoded = [[by_mark[h]] if h in by_mark else e for h, e in zip(hashed, encoded)]
            n = len(slots)
            for k, (i, h) in enumerate(zip(new, hashed)):
                slots[h] = known[i] = n + k
            sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
            self.begins = np.concatenate([self.begins, self.begins[-1] + np.cumsum(sizes)])
            self.ids = np.concatenate([self.ids, np.fromiter((x for e in encoded for x in e), np.uint32, int(sizes.sum()))])
        slot = np.array(known, np.int64)[inverse] if len(known) else np.zeros(0, np.int64)
        begin, size = self.begins[slot], self.begins[slot + 1] - self.begins[slot]
        upto = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=upto[1:])
        ids = self.ids[np.repeat(begin - upto[:-1], size) + np.arange(upto[-1])]
        return ids, upto[np.searchsorted(starts, texts)]
