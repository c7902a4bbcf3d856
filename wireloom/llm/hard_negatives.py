"""Hard negatives by exact integer scores.

Scores are inner products of integer vectors, computed by residues (``residues``). Anchors are taken in blocks of at most
about ``BLOCK`` rows; a block is broadcast and multiplied with all rows where they lie, in tiles, so no row of the table
is shuffled for the scores. Each task keeps the best few of each anchor and sends only these on; a window merges them.
The first pass over a block finds each anchor's positives, its best rows of the same label. The second selects, for each
positive, the best rows of another label whose score lies in a window relative to the positive's score.

Each block's results are written before the next block starts. The driver holds one block, and its positives, at a time.

Defined cases: rows with a null id, a null label, or a null or empty vector, or one with null or non-finite components,
take no part; shorter vectors count as padded with zeros. Rows with an anchor's own id are not its positives. Anchors
equal in id, label and vector are one; other rows that repeat an id each count, also each as a positive. Ties go to the
smaller id. Scaled components must be within 2**53 and scores within 2**62, else the query fails. An anchor without
positives, or a positive without negatives in the window, has no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wireloom.session import scratch_path, store

from .common import prepare
from .residues import Residues, primes_for, products
from .vectors import scaled, whole_vectors

#: Anchors that are broadcast at once, and the most bytes that their vectors take.
BLOCK, BLOCK_BYTES = 8192, 16 << 20
#: Anchors and rows of one tile of scores.
TILE = (256, 2048)
#: Rows of one result batch.
OUT_ROWS = 1 << 16
LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


@dataclass(frozen=True)
class Ratio:
    """Negatives score between ``least`` and ``most`` hundredths of the positive's score."""

    least: int = 30
    most: int = 90

    def window(self, positive: int) -> tuple[int, int]:
        """The least and the largest score within; where there is none, the first is the larger one."""
        low, high = -(-self.least * positive // 100), self.most * positive // 100
        return max(low, LOWEST + 1), min(high, HIGHEST)


class Best:
    """The k best (score, id) of each list, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.scores = np.full((n, k), LOWEST)
        self.ids = np.full((n, k), HIGHEST)

    def add(self, first: int, scores: np.ndarray, ids: np.ndarray, fits: np.ndarray) -> None:
        """Scores of lists ``first`` on, where ``fits``; ``ids`` ascend."""
        k, lists = self.scores.shape[1], slice(first, first + len(scores))
        last, last_id = self.scores[lists, -1:], self.ids[lists, -1:]
        fits &= scores >= last
        fits &= (scores > last) | (ids < last_id)
        sizes = np.count_nonzero(fits, axis=1)
        many = np.flatnonzero(sizes > k)
        if len(many):
            own = np.where(fits[many], scores[many], LOWEST)
            least = np.partition(own, -k, axis=1)[:, -k :][:, :1]
            tied = fits[many] & (own == least)
            fits[many] &= (own > least) | (tied & (np.cumsum(tied, axis=1) <= k))
        row, col = np.nonzero(fits)
        if not len(row):
            return
        hit = np.unique(row)
        held = hit + first
        row = np.concatenate([row, np.repeat(hit, k)])
        score = np.concatenate([scores[row[: len(col)], col], self.scores[held].ravel()])
        vec = np.concatenate([ids[col], self.ids[held].ravel()])
        order = np.lexsort((vec, ~score, row))
        row, score, vec = row[order], score[order], vec[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < k
        self.scores[first + row[keep], place[keep]] = score[keep]
        self.ids[first + row[keep], place[keep]] = vec[keep]

    def found(self) -> tuple[np.ndarray, np.ndarray]:
        """List and place of each entry."""
        return np.nonzero(self.scores > LOWEST)


class AnchorBlock:
    """Numbers, ids, labels and vectors of some anchors."""

    def __init__(self, rows: list, width: int):
        self.numbers = np.array([r["number"] for r in rows], np.int64)
        self.ids = np.array([r["vec_id"] for r in rows], np.int64)
        self.labels = np.array([r["label"] for r in rows], np.int64)
        self.vectors = unpacked([bytes(r["v"]) for r in rows], width)


def unpacked(packed: list[bytes], width: int) -> np.ndarray:
    rows = [np.frombuffer(p, "<i8") for p in packed]
    if all(len(r) == width for r in rows):
        return np.stack(rows) if rows else np.zeros((0, width), np.int64)
    return np.stack([np.pad(r, (0, width - len(r))) for r in rows])


def tiles(batches: Iterator[pa.RecordBatch], block: AnchorBlock, primes: list[int]):
    """First anchor, scores, and the tile's ids and labels, for all pairs of anchors and rows; ids ascend in a tile."""
    width = block.vectors.shape[1]
    anchors = Residues(block.vectors, primes)
    for batch in batches:
        ids, labels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, labels = ids[order], labels[order]
        vectors = Residues(unpacked(batch.column("v").to_pylist(), width)[order], primes)
        for at in range(0, len(ids), TILE[1]):
            rows = slice(at, at + TILE[1])
            for first in range(0, len(block.ids), TILE[0]):
                yield first, products(anchors[first : first + TILE[0]], vectors[rows]), ids[rows], labels[rows]


def emitted(columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_pydict({n: pa.array(c) for n, c in columns.items()})
    for at in range(0, whole.num_rows, OUT_ROWS):
        yield whole.slice(at, OUT_ROWS)


def pack(vectors: DataFrame, is_anchor: Column, label: Column, key: str, column: str, scale: float) -> DataFrame:
    """Rows that take part: vec_id, label, anchor, the packed vector, its width and largest absolute component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            good, found = whole_vectors(part.column("x"))
            whole = scaled(found, scale)
            take = pa.array(good)
            top = np.abs(whole).max(axis=1, initial=0) if len(whole) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    *(part.column(c).take(take) for c in ("vec_id", "label", "anchor")),
                    pa.array([row.astype("<i8").tobytes() for row in whole], pa.binary()),
                    pa.array(np.full(len(good), whole.shape[1], np.int64)), pa.array(top.astype(np.int64)),
                ],
                names=["vec_id", "label", "anchor", "v", "width", "top"],
            )

    rows = vectors.select(
        F.col(key).cast("long").alias("vec_id"), label.cast("long").alias("label"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.col(column).alias("x"),
    ).filter("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL")
    return rows.mapInArrow(run, "vec_id long, label long, anchor boolean, v binary, width long, top long")


def block_positives(rows: DataFrame, block, primes: list[int], k: int) -> DataFrame:
    """number, anchor_id, place, vec_id, score: each anchor's first ``k`` rows of its label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = block.value
        best = Best(len(own.ids), k)
        for first, scores, ids, labels in tiles(batches, own, primes):
            some = slice(first, first + len(scores))
            best.add(first, scores, ids, (own.labels[some, None] == labels) & (own.ids[some, None] != ids))
        row, at = best.found()
        yield from emitted(
            {"number": own.numbers[row], "anchor_id": own.ids[row], "vec_id": best.ids[row, at], "score": best.scores[row, at]}
        )

    found = rows.mapInArrow(run, "number long, anchor_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("place", place).filter(F.col("place") <= k)


def block_negatives(rows: DataFrame, block, positives, primes: list[int], k: int, ratio: Ratio) -> DataFrame:
    """The first ``k`` rows of another label in the window of each anchor and positive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, given = block.value, positives.value
        row_of = {n: i for i, n in enumerate(own.numbers.tolist())}
        most = max((p["place"] for p in given), default=0)
        # each place of a positive has bounds for all anchors; where there is none, nothing fits
        low, high = np.full((most, len(own.ids)), HIGHEST), np.full((most, len(own.ids)), LOWEST)
        at = {}
        for p in given:
            i, j = row_of[p["number"]], p["place"] - 1
            low[j, i], high[j, i] = ratio.window(p["score"])
            at[j, i] = p
        lists = [Best(len(own.ids), k) for _ in range(most)]
        for first, scores, ids, labels in tiles(batches, own, primes):
            some = slice(first, first + len(scores))
            other = own.labels[some, None] != labels
            for j, best in enumerate(lists):
                best.add(first, scores, ids, other & (scores >= low[j, some, None]) & (scores <= high[j, some, None]))
        for j, best in enumerate(lists):
            row, place = best.found()
            held = [at[j, i] for i in row.tolist()]
            yield from emitted(
                {
                    "number": own.numbers[row], "place": np.full(len(row), j + 1, np.int32), "anchor_id": own.ids[row],
                    "positive_id": np.array([p["vec_id"] for p in held], np.int64),
                    "positive_score": np.array([p["score"] for p in held], np.int64),
                    "negative_id": best.ids[row, place], "negative_score": best.scores[row, place],
                }
            )

    found = rows.mapInArrow(
        run, "number long, place int, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    )
    rank = F.row_number().over(Window.partitionBy("number", "place").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select(*COLUMNS)


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(
    vectors: DataFrame, is_anchor: Column, label: Column, n_positives: int = 5, n_negatives: int = 10, ratio: Ratio = Ratio(),
    scale: float = 256.0, key: str = "vec_id", column: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = prepare(vectors.sparkSession)
    packed = store(pack(vectors, is_anchor, label, key, column, scale), "vectors").table
    rows = packed.select("vec_id", "label", "v")
    distinct = packed.filter("anchor").dropDuplicates(["vec_id", "label", "v"])
    anchors = store(distinct.select(F.monotonically_increasing_id().alias("number"), "vec_id", "label", "v"), "anchors")
    if not anchors.rows:
        return spark.createDataFrame([], SCHEMA)
    size = packed.agg(F.max("width").alias("width"), F.max("top").alias("top")).first()
    primes = primes_for(size["width"] * size["top"] ** 2)
    per_block = max(1, min(BLOCK, BLOCK_BYTES // (8 * size["width"])))
    blocks = -(-anchors.rows // per_block)
    dealt = anchors.table.withColumn("block", F.pmod(F.xxhash64("number"), F.lit(blocks)))
    paths = []
    for b in range(blocks):
        block = spark.sparkContext.broadcast(AnchorBlock(dealt.filter(F.col("block") == b).collect(), size["width"]))
        found = block_positives(rows, block, primes, n_positives).select("number", "place", "vec_id", "score")
        positives = spark.sparkContext.broadcast([r.asDict() for r in found.collect()])
        paths.append(scratch_path(spark, "hard-negatives"))
        block_negatives(rows, block, positives, primes, n_negatives, ratio).write.parquet(paths[-1])
        positives.destroy()
        block.destroy()
    return spark.read.schema(SCHEMA).parquet(*paths)
