"""Whitening of embeddings: decorrelated components of unit variance.

Vectors become integers, so their number and sums are exact. Each task subtracts the mean from its rows, the whole part as
integers and the rest as a double, and adds up the products of what is left; the partial matrices are summed row by row in
two steps, so no task and no driver holds one matrix for each task. The covariance matrix, as large as the vectors are
wide, is decomposed on the driver (``eigen``). The leading components and the mean are broadcast and every row is
projected where it lies. The whitened rows are written once; the covariance of what was written is measured and its
largest difference from the identity is reported.

Defined cases: rows with a null or empty vector, or one with null or non-finite entries, take no part; shorter vectors
count as padded with zeros before scaling. Components with less than ``LEAST`` of the largest variance can't be whitened
and have no rows, so equal vectors, or a single one, give none; an empty table gives none. A row with a null id, and each
repeated row, counts and is returned. Scaled entries must be within 2**53. ``deviation`` is null where a long can't hold
it. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wireloom.session import store

from .common import prepare
from .eigen import leading
from .vectors import padded, scaled, whole_vectors

#: Variance that a component must have, as a share of the largest.
LEAST = 1e-10
#: Partial matrices that one task adds up.
LOT = 256
#: Rows of one product.
ROWS = 8192


@dataclass(frozen=True)
class Scaling:
    """Entries become floor(factor * c) + offset."""

    factor: float = 1024.0
    offset: int = 100_000

    def integers(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Rows that take part, and their entries before the offset is added."""
        good, found = whole_vectors(column)
        return good, scaled(found, self.factor)


@dataclass(frozen=True)
class Mean:
    """The sums of ``n`` vectors, in Python's integers."""

    n: int
    sums: tuple[int, ...]

    @property
    def whole(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        """n times what the whole part leaves of the mean."""
        return np.array([s % self.n for s in self.sums], np.int64)

    def centre(self, x: np.ndarray) -> np.ndarray:
        """x less the mean; only the last step rounds."""
        return (x - self.whole) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> pa.Array:
        """The sum over dimensions of (n * x - sum) ** 2; null where it is beyond a long."""
        y, rest, n = x - self.whole, self.rest, self.n
        most = int(np.abs(y).max(initial=0)) + 1
        if len(self.sums) * (n * most) ** 2 < 2**63:
            t = n * y - rest
            return pa.array((t * t).sum(axis=1))
        exact = ((n * y.astype(object) - rest.astype(object)) ** 2).sum(axis=1)
        return pa.array([v if v < 2**63 else None for v in exact.tolist()], pa.int64())


@dataclass(frozen=True)
class Whitening:
    """What projects rows: mean, unit components as columns, their variances, and the trace of the covariance."""

    mean: Mean
    components: np.ndarray
    variances: np.ndarray
    trace: float


def fit_mean(vectors: DataFrame, column: str, scaling: Scaling) -> Mean:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(0, np.int64)
        for part in batches:
            good, x = scaling.integers(part.column(column))
            width = max(len(sums), x.shape[1])
            sums = np.pad(sums, (0, width - len(sums)))
            sums += padded(x, width).sum(axis=0)
            n += len(good)
            # a long holds the sums of a batch; those of a task are passed on before they could outgrow it
            if n and np.abs(sums).max(initial=0) > 2**61:
                yield totals(n, sums)
                n, sums = 0, np.zeros(0, np.int64)
        if n:
            yield totals(n, sums)

    def totals(n: int, sums: np.ndarray) -> pa.RecordBatch:
        # place -1 holds the number of rows
        return pa.RecordBatch.from_arrays(
            [pa.array(np.arange(-1, len(sums), dtype=np.int32)), pa.array(np.append(n, sums))], names=["place", "total"]
        )

    found = vectors.select(column).filter(F.col(column).isNotNull()).mapInArrow(run, "place int, total long")
    rows = found.groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    sums = {r["place"]: int(r["total"]) for r in rows}
    n = sums.pop(-1, 0)
    return Mean(n, tuple(sums[i] + n * scaling.offset for i in range(len(sums))))


def covariance(vectors: DataFrame, column: str, scaling: Scaling, mean: Mean) -> np.ndarray:
    """Of the rows less their mean; divided by their number."""
    width = len(mean.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for part in batches:
            _, x = scaling.integers(part.column(column))
            for at in range(0, len(x), ROWS):
                centred = mean.centre(padded(x[at : at + ROWS], width) + scaling.offset)
                total += centred.T @ centred
        lot = TaskContext.get().partitionId() // LOT
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(width, dtype=np.int32)), pa.array(np.full(width, lot, np.int32)),
                pa.array([row.tobytes() for row in total], pa.binary()),
            ],
            names=["place", "lot", "row"],
        )

    def add(group: pa.Table) -> pa.Table:
        rows = group.column("row").to_pylist()
        total = np.sum([np.frombuffer(r, "<f8") for r in rows], axis=0)
        return pa.table({"place": group.column("place")[:1], "row": pa.array([total.tobytes()], pa.binary())})

    parts = vectors.select(column).filter(F.col(column).isNotNull()).mapInArrow(run, "place int, lot int, row binary")
    lots = parts.groupBy("place", "lot").applyInArrow(add, "place int, row binary")
    rows = lots.groupBy("place").applyInArrow(add, "place int, row binary").collect()
    out = np.zeros((width, width))
    for r in rows:
        out[r["place"]] = np.frombuffer(bytes(r["row"]), "<f8")
    return (out + out.T) / 2 / mean.n


def fit(vectors: DataFrame, column: str = "embedding", k: int = 8, scaling: Scaling = Scaling()) -> Whitening | None:
    """The leading components of all vectors; none without vectors."""
    prepare(vectors.sparkSession)
    mean = fit_mean(vectors, column, scaling)
    if not mean.n:
        return None
    matrix = covariance(vectors, column, scaling, mean)
    values, components = leading(matrix, k)
    kept = int((values > LEAST * max(values.max(initial=0), 0)).sum())
    return Whitening(mean, components[:, :kept], values[:kept], float(np.trace(matrix)))


def project(
    vectors: DataFrame, model: Whitening, key: str = "vec_id", column: str = "embedding", scaling: Scaling = Scaling()
) -> DataFrame:
    """vec_id, deviation and the whitened components of each row, as an array."""
    sent = prepare(vectors.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        width, k = own.components.shape
        weights = own.components / np.sqrt(own.variances)
        for part in batches:
            good, found = scaling.integers(part.column("x"))
            x = padded(found, width) + scaling.offset
            white = own.mean.centre(x) @ weights
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, k * len(good) + 1, max(k, 1), dtype=np.int32)), pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id").take(pa.array(good)), own.mean.deviations(x), lists], names=["vec_id", "deviation", "white"]
            )

    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).alias("x")).filter("x IS NOT NULL")
    return rows.mapInArrow(run, "vec_id long, deviation long, white array<double>")


def identity_error(white: DataFrame, k: int) -> float:
    """The largest absolute entry of the covariance of the whitened rows less the identity."""
    means = white.agg(*[F.avg(F.col("white")[i]).alias(f"m{i}") for i in range(k)]).first()
    centred = [F.col("white")[i] - F.lit(means[f"m{i}"]) for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = white.agg(*[F.avg(centred[i] * centred[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(
    vectors: DataFrame, k: int = 8, scaling: Scaling = Scaling(), key: str = "vec_id", column: str = "embedding"
) -> DataFrame:
    """One row for each row and component: see ``SCHEMA``."""
    spark = prepare(vectors.sparkSession)
    model = fit(vectors, column, k, scaling)
    if model is None or not len(model.variances):
        return spark.createDataFrame([], SCHEMA)
    white = store(project(vectors, model, key, column, scaling), "whitened").table
    error = identity_error(white, len(model.variances))
    shares = F.array(*[F.lit(float(v / model.trace)) for v in model.variances])
    rows = white.select("vec_id", "deviation", F.posexplode("white").alias("place", "whitened"))
    return rows.select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(model.mean.n).cast("long").alias("n"), "deviation", "whitened",
        shares[F.col("place")].alias("explained"), F.lit(error).alias("identity_error"),
    )
