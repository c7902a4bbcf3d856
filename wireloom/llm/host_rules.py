"""Quality rules for whole hosts.

Each document is counted once: words, characters, symbols, repeated lines and repeated three-word windows. Rules over these
counts say what a document fails. Failures are added up by host, and a host's rate of failing a rule is shrunk towards the
rate of all hosts by a beta prior: its mean is the overall rate, its strength comes from how much more the rates of hosts
differ than chance explains (the analysis-of-variance estimate of the intraclass correlation). A host of few documents
thus keeps near the overall rate, a host of many near its own. A host whose shrunken rate reaches ``host_limit`` for some
rule is rejected, and its verdict is joined back to all its documents.

Counts are exact up to the equality of 64-bit hashes of words and lines of one text. Work on hosts is one aggregate with
partial sums, so a host of a third of all rows is one row per task; the join leaves the heaviest hosts where they lie.

Defined cases: a null or empty text has no words and fails ``few_words``. A null host has no verdict: its documents stand
on their own, and are no part of the prior. With one host, or one document on each, rates are shrunk wholly to the
overall rate; an empty table gives empty results. Repeated rows count each. A column of the documents with the name of
an added one is replaced by it. A long text is hashed in pieces of its lines and words; about 12 bytes of memory for each
of its bytes remain.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wireloom.operators.lookup import attach
from wireloom.session import Stored, store

from .common import BYTE_VALUES, CHUNK, U64, byte_classes, extend, find_words, flat, mix, prepare, slices, span_hashes

#: Words are runs of anything but blanks, as they are written.
SOLID = np.arange(256, dtype=np.uint8)
SOLID[byte_classes([0x20, *range(0x09, 0x0E)]) == 0] = 0
SOLID[0] = 0x20  # a zero byte is part of a word; a blank has no class of its own

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Limits:
    """What a document must keep to; shares are percentages."""

    min_words: int = 50
    repeat_words: int = 50
    symbols: int = 10
    dup_lines: int = 30
    word_length: tuple[int, int] = (3, 10)

    def failures(self) -> dict[str, Column]:
        """For each rule, whether a row of counts fails it; integers only, so that no rounding decides."""
        words, chars = F.col("n_words"), F.col("word_chars")
        short, long = self.word_length
        return {
            "few_words": words < self.min_words,
            "repeat_words": 100 * F.col("n_repeat_words") > self.repeat_words * words,
            "symbols": 100 * F.col("n_symbols") > self.symbols * words,
            "dup_lines": 100 * F.col("n_dup_lines") > self.dup_lines * F.col("n_lines"),
            "word_length": (chars < short * words) | (chars > long * words),
        }


#: Rules that reject a document by itself.
BASE = ("few_words", "repeat_words")


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of ascending spans, by pieces of bounded size; a span beyond a piece has a digest of its own."""
    if not len(starts):
        return np.zeros(0, U64)
    if ends[-1] - starts[0] <= 2 * CHUNK:
        return span_hashes(BYTE_VALUES[data[starts[0] : ends[-1]]], starts - starts[0], ends - starts[0])
    out = np.zeros(len(starts), U64)
    large = ends - starts > CHUNK
    for i in np.flatnonzero(large).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
        out[i] = int.from_bytes(digest, "little")
    small = np.flatnonzero(~large)
    piece = (starts[small] - starts[0]) // CHUNK  # spans of one piece lie within two chunks
    for rows in np.split(small, np.flatnonzero(np.diff(piece)) + 1):
        if len(rows):
            first = starts[rows[0]]
            values = BYTE_VALUES[data[first : ends[rows[-1]]]]
            out[rows] = span_hashes(values, starts[rows] - first, ends[rows] - first)
    return out


def tallies(keys: np.ndarray) -> np.ndarray:
    """How often the key at each place occurs."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    begins = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(begins, len(keys)))
    out = np.empty(len(keys), np.int64)
    out[order] = np.repeat(sizes, sizes)
    return out


def within(places: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of the ascending places lie in each text."""
    return np.diff(np.searchsorted(places, offsets))


def count_texts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The counts of each text, in the order of ``COUNTS``."""
    n_texts = len(offsets) - 1
    lowered, starts, ends, firsts = find_words(data, offsets, SOLID)
    n_words = np.diff(firsts)
    upto = np.concatenate([[0], np.cumsum(ends - starts)])
    chars = upto[firsts[1:]] - upto[firsts[:-1]] - within(np.flatnonzero(data & 0xC0 == 0x80), offsets)
    symbols = within(np.flatnonzero(SYMBOLS[data]), offsets)

    text_salt = mix(np.arange(1, n_texts + 1, dtype=U64))
    words = hashed(lowered, starts, ends)
    of_word = np.repeat(np.arange(n_texts), n_words)
    opens = np.flatnonzero(np.arange(len(words)) + 2 < firsts[1:][of_word]) if len(words) else np.zeros(0, np.int64)
    windows = mix(mix(mix(words[opens] + text_salt[of_word[opens]]) + words[opens + 1]) + words[opens + 2])
    again = opens[tallies(windows) > 1]
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[again + shift] = True
    repeats = within(np.flatnonzero(covered), firsts)

    breaks = np.flatnonzero(data == 10)
    n_breaks = within(breaks, offsets)
    line_starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    line_ends = np.sort(np.concatenate([breaks, offsets[1:]]))
    of_line = np.repeat(np.arange(n_texts), n_breaks + 1)
    worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends, of_line = line_starts[worded], line_ends[worded], of_line[worded]
    lines = mix(hashed(data, line_starts, line_ends) + text_salt[of_line])
    n_lines = np.bincount(of_line, minlength=n_texts)
    distinct = np.bincount(of_line[np.unique(lines, return_index=True)[1]], minlength=n_texts) if len(lines) else 0 * n_lines
    return [n_words, chars, symbols, n_lines, n_lines - distinct, repeats]


def count(docs: DataFrame, text: str = "text", keep: list[str] = ()) -> DataFrame:
    """``keep`` and the counts of each document."""
    prepare(docs.sparkSession)
    keep = [c for c in keep if c not in COUNTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            found = count_texts(*flat(part.column(text)))
            counts = [pa.array(c.astype(np.int64)) for c in found]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *counts], names=[*keep, *COUNTS])

    schema = extend(docs, keep, ", ".join(f"{c} long" for c in COUNTS))
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def host_failures(counted: DataFrame, host: str, limits: Limits) -> Stored:
    """``host``, its documents and how many of them fail each rule; stored, one row per host."""
    failed = [F.count_if(rule).alias(name) for name, rule in limits.failures().items()]
    rows = counted.filter(F.col(host).isNotNull()).select(F.col(host).alias("host"), *COUNTS)
    return store(rows.groupBy("host").agg(F.count("*").alias("docs"), *failed), "host-failures")


@dataclass(frozen=True)
class Prior:
    """A beta prior: ``strength`` documents at the rate ``mean``; infinite where hosts differ no more than by chance."""

    mean: float
    strength: float

    def shrink(self, failed: Column, docs: Column) -> Column:
        if self.strength == float("inf"):
            return F.lit(self.mean)
        return (failed + F.lit(self.strength * self.mean)) / (docs + F.lit(self.strength))


def fit_priors(hosts: DataFrame, rules: list[str]) -> dict[str, Prior]:
    """A prior for each rule from one aggregate over the hosts."""
    docs = F.col("docs").cast("double")
    sums = [F.count("*").alias("hosts"), F.sum("docs").alias("docs"), F.sum(docs * docs).alias("squares")]
    for rule in rules:
        failed = F.col(rule).cast("double")
        sums += [F.sum(rule).alias(f"{rule}_k"), F.sum(failed * failed / docs).alias(f"{rule}_q")]
    row = hosts.agg(*sums).first()
    n_hosts, n_docs = row["hosts"], row["docs"] or 0
    priors = {}
    for rule in rules:
        k, q = row[f"{rule}_k"] or 0, row[f"{rule}_q"] or 0.0
        mean, strength = (k / n_docs if n_docs else 0.0), float("inf")
        if n_hosts > 1 and n_docs > n_hosts:
            between = (q - k * k / n_docs) / (n_hosts - 1)
            inside = (k - q) / (n_docs - n_hosts)
            typical = (n_docs - row["squares"] / n_docs) / (n_hosts - 1)
            spread = between - inside
            if spread > 0:
                # one over the intraclass correlation, less one
                strength = max(0.0, (between + (typical - 1) * inside) / spread - 1)
        priors[rule] = Prior(mean, strength)
    return priors


def host_verdicts(failures: Stored, limits: Limits = Limits(), host_limit: float = 0.5) -> Stored:
    """``host``, ``docs``, ``<rule>_rate`` (shrunken), ``broken`` (names of the rules it breaks), ``host_kept``."""
    rules = list(limits.failures())
    priors = fit_priors(failures.table, rules)
    rates = {f"{r}_rate": priors[r].shrink(F.col(r), F.col("docs")) for r in rules}
    rated = failures.table.select("host", "docs", *[c.alias(n) for n, c in rates.items()])
    broken = F.array_compact(F.array(*[F.when(F.col(f"{r}_rate") >= host_limit, F.lit(r)) for r in rules]))
    judged = rated.withColumn("broken", broken)
    return store(judged.withColumn("host_kept", F.size("broken") == 0), "host-verdicts")


def judge(
    docs: DataFrame, keep: list[str] = (), host: str = "source", text: str = "text",
    limits: Limits = Limits(), host_limit: float = 0.5,
) -> DataFrame:
    """``keep``, the counts, ``base_failed``, ``host_kept`` and ``kept`` for each document."""
    added = [*COUNTS, "base_failed", "host_kept", "kept"]
    keep = [c for c in keep if c not in added]
    narrow = docs.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)], F.col(host).alias("host"), F.col(text).alias("text"))
    names = [f"_{i}" for i in range(len(keep))]
    counted = store(count(narrow, keep=[*names, "host"]), "text-counts")
    hosts = host_verdicts(host_failures(counted.table, "host", limits), limits, host_limit)
    verdicts = Stored(hosts.table.select("host", "docs", "host_kept"), hosts.rows)
    joined = attach(counted.table, verdicts, ["host"], "docs")
    rules = limits.failures()
    failed = F.lit(False)
    for name in BASE:
        failed = failed | rules[name]
    judged = joined.withColumns({"base_failed": failed, "host_kept": F.coalesce("host_kept", F.lit(True))})
    judged = judged.withColumn("kept", ~F.col("base_failed") & F.col("host_kept"))
    return judged.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], *added)
