"""A toxicity classifier that is fitted to give the same score when a group's name is swapped for another's.

Features are the presence of words and of five-byte pieces of words. Kept are all that go surely with either class, by a
likelihood-ratio statistic over all labelled rows, and whose share of toxic rows differs from the overall one by a factor;
the factor, unlike the statistic, doesn't grow with the rows, so the same text is described alike at every size. With them
go the features that identity terms bring. Weights minimise the logistic loss plus, for each labelled text that names a group, the squared change of its score when
the name is swapped for another of its kind, and a small ridge. Neutral mentions thus stay neutral.

The counts that choose features cover all labelled rows; the weights are fitted on ``MAX_ROWS`` of them at most, those
of the smallest hash of their key. Defined cases: a null or empty text has no features and gets the base score. Labels
of null, and of rows that aren't there, teach nothing; several labels of one row count each. Without labels, or with
labels of one class, every score is that class's share of the rows, or one half. Repeated rows are scored each.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, BYTE_VALUES, U64, extend, find_words, flat, mix, prepare, slices, span_hashes

#: Labelled rows that the weights are fitted on.
MAX_ROWS = 20_000
#: Bins that features fall into.
BINS_LOG = 20
#: What a feature's statistic must reach, and by which factor it must raise or lower the share of toxic rows.
LEAST_EVIDENCE, LEAST_FACTOR = 15.0, 2.0
PIECE = 5
#: Weight of the squared score change of a swap, and of the ridge.
SWAP_WEIGHT, RIDGE = 4.0, 1e-4
STEPS = 250

#: Names of groups, by kind; a name is swapped for the others of its kind.
IDENTITIES = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"),
    ("immigrant", "native", "refugee", "foreigner"),
    ("immigrants", "natives", "refugees", "foreigners"),
    ("disabled", "deaf", "blind", "autistic"),
)


def text_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins of all features, and the text of each; repeated ones are left in."""
    lowered, starts, ends, firsts = find_words(data, offsets, ALNUM)
    text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
    words = span_hashes(BYTE_VALUES[lowered], starts, ends)
    count = np.maximum(ends - starts - PIECE + 1, 0)
    first = np.cumsum(count) - count
    at = np.arange(int(count.sum())) + np.repeat(starts - first, count)
    eight = np.ndarray((len(lowered),), "<u8", buffer=np.append(lowered, np.zeros(8, np.uint8)), strides=(1,))
    pieces = mix((eight[at] & U64((1 << (8 * PIECE)) - 1)) + U64(1))
    bins = (np.concatenate([words, pieces]) >> U64(64 - BINS_LOG)).astype(np.int64)
    return bins, np.concatenate([text_of, np.repeat(text_of, count)])


def presence(column: pa.Array, place: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs without repeats; ``place`` maps bins to kept features, -1 to none."""
    bins, texts = text_features(*flat(column))
    if place is not None:
        bins = place[bins]
        bins, texts = bins[bins >= 0], texts[bins >= 0]
    pairs = np.unique(texts << BINS_LOG | bins)
    return pairs >> BINS_LOG, pairs & ((1 << BINS_LOG) - 1)


@dataclass
class ToxicityModel:
    bins: np.ndarray
    weights: np.ndarray
    base: float
    place: np.ndarray = field(init=False)

    def __post_init__(self):
        self.place = np.full(1 << BINS_LOG, -1, np.int32)
        self.place[self.bins] = np.arange(len(self.bins))

    def scores(self, column: pa.Array) -> np.ndarray:
        texts, features = presence(column, self.place)
        total = self.base + np.bincount(texts, self.weights[features], len(column))
        return 1.0 / (1.0 + np.exp(-np.clip(total, -500, 500)))


def count_presence(rows: DataFrame, text: str) -> DataFrame:
    """bin, n and n_toxic over all rows, of which ``toxic`` is 0 or 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, toxic = np.zeros(1 << BINS_LOG, np.int32), np.zeros(1 << BINS_LOG, np.int32)
        for part in slices(batches, text):
            texts, bins = presence(part.column(text))
            marked = np.array(part.column("toxic").to_pylist(), bool)[texts]
            every += np.bincount(bins, minlength=len(every)).astype(np.int32)
            toxic += np.bincount(bins[marked], minlength=len(every)).astype(np.int32)
        at = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at), pa.array(every[at].astype(np.int64)), pa.array(toxic[at].astype(np.int64))], names=["bin", "n", "n_toxic"]
        )

    counted = rows.select(text, "toxic").mapInArrow(run, "bin long, n long, n_toxic long")
    return counted.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))


def ratio_statistic(n_rows: int, n_toxic: int):
    """Log-likelihood ratio of presence and class, from the columns n and n_toxic."""
    term = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    share = n_toxic / n_rows
    has, toxic = F.col("n").cast("double"), F.col("n_toxic").cast("double")
    lack, lack_toxic = n_rows - has, n_toxic - toxic
    return (
        term(toxic, has * share) + term(has - toxic, has * (1 - share))
        + term(lack_toxic, lack * share) + term(lack - lack_toxic, lack * (1 - share))
    )


def swaps(identities) -> tuple[re.Pattern | None, dict[str, list[str]]]:
    others = {t: [o for o in kind if o != t] for kind in identities for t in kind}
    if not others:
        return None, others
    return re.compile(r"\b(" + "|".join(sorted(map(re.escape, others), key=len, reverse=True)) + r")\b", re.IGNORECASE), others


def fit(rows: list[tuple[np.ndarray, float]], moves: list[tuple[np.ndarray, np.ndarray]], n: int, swap_weight: float) -> tuple[np.ndarray, float]:
    """Weights of ``n`` features and a base, by accelerated gradient steps; ``moves`` are features lost and gained."""
    sizes = np.array([len(f) for f, _ in rows])
    features = np.concatenate([f for f, _ in rows]) if sizes.sum() else np.zeros(0, np.int64)
    row_of = np.repeat(np.arange(len(rows)), sizes)
    label = np.array([y for _, y in rows])
    share = label.mean()
    weight = np.where(label > 0, math.sqrt((1 - share) / share), 1.0)
    weight /= weight.sum()
    lost = np.concatenate([np.concatenate([a, b]) for a, b in moves]) if moves else np.zeros(0, np.int64)
    sign = np.concatenate([np.r_[-np.ones(len(a)), np.ones(len(b))] for a, b in moves]) if moves else np.zeros(0)
    move_of = np.repeat(np.arange(len(moves)), [len(a) + len(b) for a, b in moves]) if moves else np.zeros(0, np.int64)
    w, base, m, v = np.zeros(n), math.log(share / (1 - share)), np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, STEPS + 1):
        total = base + np.bincount(row_of, w[features], len(rows))
        error = weight * (1 / (1 + np.exp(-np.clip(total, -500, 500))) - label)
        slope = np.append(np.bincount(features, error[row_of], n) + RIDGE * w, error.sum())
        if moves:
            change = np.bincount(move_of, sign * w[lost], len(moves))
            slope[:n] += 2 * swap_weight / len(moves) * np.bincount(lost, sign * change[move_of], n)
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        move = 0.2 * (1 - step / STEPS) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, base = w - move[:n], base - move[n]
    return w, base


def learn(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", max_rows: int = MAX_ROWS,
    identities=IDENTITIES, swap_weight: float = SWAP_WEIGHT,
) -> ToxicityModel:
    """A model of the rows of ``docs`` that ``labels`` (``key``, toxic) marks 0 or 1."""
    prepare(docs.sparkSession)
    marked = labels.filter(F.col("toxic").isin(0, 1) & F.col(key).isNotNull()).select(key, F.col("toxic").cast("int").alias("toxic"))
    texts = docs.filter(F.col(key).isNotNull()).select(key, text)
    totals = marked.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    if not totals["t"] or totals["t"] == totals["n"]:
        share = min(max(totals["t"] / totals["n"], 1e-6), 1 - 1e-6) if totals["n"] else 0.5
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), math.log(share / (1 - share)))
    labelled = texts.join(marked.hint("merge"), key)  # labels may grow with the texts: never broadcast them all
    counts = count_presence(labelled, text)
    share = F.col("n_toxic") / F.col("n") * F.lit(totals["n"] / totals["t"])  # of toxic rows, relative to the overall one
    telling = counts.filter((share >= LEAST_FACTOR) | (share <= 1 / LEAST_FACTOR))
    best = telling.filter(ratio_statistic(totals["n"], totals["t"]) >= LEAST_EVIDENCE).select("bin").toArrow()
    named = pa.array([t for kind in identities for t in kind], pa.string())
    bins = np.unique(np.concatenate([best.column("bin").to_numpy(), presence(named)[1] if len(named) else []]).astype(np.int64))
    place = np.full(1 << BINS_LOG, -1, np.int64)
    place[bins] = np.arange(len(bins))
    pattern, others = swaps(identities)
    held = docs.sparkSession.sparkContext.broadcast(place)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            toxic = part.column("toxic").to_pylist()
            whole = part.column(text).to_pylist()
            extra = []  # (row, text with every name swapped)
            for i, t in enumerate(whole):
                if pattern is not None and t and pattern.search(t):
                    turns = max(len(others[m.lower()]) for m in pattern.findall(t))
                    for turn in range(turns):
                        put = lambda m: (o := others[m[0].lower()])[turn % len(o)]  # noqa: B023, E731
                        extra.append((i, pattern.sub(put, t)))
            column = pa.array([t or "" for t in whole] + [t for _, t in extra], pa.large_string())
            rows, features = presence(column, held.value)
            lists = [x.astype("<i4") for x in np.split(features, np.searchsorted(rows, np.arange(1, len(column))))]
            swapped = lists[len(whole) :]
            # of a swap only what it takes and what it brings; of a row all
            lost = [np.setdiff1d(lists[i], x) for (i, _), x in zip(extra, swapped)]
            gained = [np.setdiff1d(x, lists[i]) for (i, _), x in zip(extra, swapped)]
            yield pa.RecordBatch.from_pydict(
                {
                    "toxic": pa.array(toxic + [None] * len(extra), pa.int32()),
                    "features": pa.array([x.tobytes() for x in lists[: len(whole)] + gained], pa.binary()),
                    "lost": pa.array([None] * len(whole) + [x.tobytes() for x in lost], pa.binary()),
                }
            )

    sample = marked.orderBy(F.xxhash64(key), key, "toxic").limit(max_rows)
    drawn = texts.join(F.broadcast(sample), key).mapInArrow(reduce, "toxic int, features binary, lost binary").collect()
    unpack = lambda b: np.frombuffer(bytes(b), "<i4")
    rows = [(unpack(r["features"]), float(r["toxic"])) for r in drawn if r["toxic"] is not None]
    moves = [(unpack(r["lost"]), unpack(r["features"])) for r in drawn if r["toxic"] is None]
    toxic = sum(y for _, y in rows)
    if not 0 < toxic < len(rows):
        share = min(max(totals["t"] / totals["n"], 1e-6), 1 - 1e-6)
        return ToxicityModel(bins, np.zeros(len(bins)), math.log(share / (1 - share)))
    return ToxicityModel(bins, *fit(rows, moves, len(bins), swap_weight))


def score(docs: DataFrame, model: ToxicityModel, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and score (0 to 1, higher: toxic likelier) for each row of ``docs``; a column of that name is replaced."""
    keep = [c for c in keep if c != "score"]
    held = prepare(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            scores = held.value.scores(part.column(text))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(scores, pa.float64())], names=[*keep, "score"])

    read = [F.col(f"`{c}`") for c in dict.fromkeys([*keep, text])]
    return docs.select(*read).mapInArrow(run, extend(docs, keep, "score double"))


def drop_toxic(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score less than ``threshold``, with their columns."""
    inner = [f"_{i}" for i in range(len(docs.columns))]  # a column named score may be among them
    renamed = docs.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(docs.columns, inner)])
    scored = score(renamed, model, inner, inner[docs.columns.index(text)]).filter(F.col("score") < threshold)
    return scored.select(*[F.col(i).alias(c) for c, i in zip(docs.columns, inner)])
