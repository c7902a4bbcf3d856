"""Exact top-k inner products with an M-tree.

Vectors are turned into integers, so scores are exact. The tree has three levels: regions around pivots, pages of up to
``PAGE`` vectors inside a region, vectors inside a page. Every node has a centre, a covering radius and the distance to
its parent's centre, every vector its distance to its page's centre. A region is built and searched in one task;
regions with too many rows, for example of equal vectors, are split.

With d the Euclidean distance, q.x = (|q|^2 + |x|^2 - d(q,x)^2) / 2, and d(q,x) >= d(q,c) - r for all x in a ball, so a
node's score bound follows from one distance; by the triangle inequality |d(q,parent) - d(node,parent)| bounds
d(q,node) from below before it is computed. A query takes its pages in the order of their bounds and stops at the first
that can't reach its k-th best score. It first searches the region it would lie in; only regions whose bound reaches
the k-th best score found there see it again.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part; shorter vectors count
as padded with zeros. Rows with the query's own id are not its candidates; rows that repeat another id each are
candidates. Ties go to the smaller id. Null ids take no part. Scores must fit 53 bits. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wireloom.session import store

from .common import prepare

PAGE = 128
#: Rows of a region, unless that makes more regions than MOST_REGIONS.
REGION_ROWS, MOST_REGIONS = 4096, 2048
#: Rows that pivots are chosen among.
PIVOT_SAMPLE = 4096
#: Queries that one task holds.
QUERY_BLOCK = 2048
#: What rounding may add to a bound.
SLACK = 1e-6


def integers(column: pa.Array, scale: float) -> list[np.ndarray | None]:
    """floor(scale * x) of each vector; None for those that take no part."""
    out = []
    for v in column.to_pylist():
        x = np.array([np.nan if c is None else c for c in v], float) if v else None
        out.append(None if x is None or not np.isfinite(x).all() else np.floor(scale * x))
    return out


def matrix(packed: list[bytes], width: int | None = None) -> np.ndarray:
    """Rows of packed vectors, padded with zeros to one width."""
    rows = [np.frombuffer(p, "<f8") for p in packed]
    width = max([width or 0, *map(len, rows)])
    if all(len(r) == width for r in rows):
        return np.stack(rows) if rows else np.zeros((0, width))
    return np.stack([np.pad(r, (0, width - len(r))) for r in rows])


def fitted(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    width = max(a.shape[1], b.shape[1])
    a, b = fitted(a, width), fitted(b, width)
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows far from each other, farthest first."""
    chosen, far = [0], distances(sample, sample[:1])[:, 0]
    while len(chosen) < n and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, distances(sample, sample[chosen[-1] :][:1])[:, 0])
    return sample[chosen]


def cut_pages(vectors: np.ndarray, rows: np.ndarray) -> Iterator[np.ndarray]:
    """Rows in lots of at most PAGE, halved between two far vectors as long as they are too many."""
    todo = [rows]
    while todo:
        rows = todo.pop()
        if len(rows) <= PAGE:
            yield rows
            continue
        far = distances(vectors[rows], vectors[rows[:1]])[:, 0]
        a = rows[far.argmax()]
        from_a = distances(vectors[rows], vectors[a : a + 1])[:, 0]
        b = rows[from_a.argmax()]
        order = np.argsort(from_a - distances(vectors[rows], vectors[b : b + 1])[:, 0], kind="stable")
        todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]


PAGE_SCHEMA = "region int, part int, centre binary, radius double, to_parent double, parent binary, parent_radius double, norm double, ids binary, vectors binary, width int, to_centre binary"


def build_region(group: pa.Table) -> pa.Table:
    """The pages of one region (part)."""
    region, part = group.column("region")[0].as_py(), group.column("part")[0].as_py()
    vectors, ids = matrix(group.column("v").to_pylist()), group.column("vec_id").to_numpy()
    centre = vectors.mean(axis=0, keepdims=True)
    reach = float(distances(vectors, centre).max())
    pages = []
    for rows in cut_pages(vectors, np.arange(len(ids))):
        held = vectors[rows]
        middle = held[distances(held, held.mean(axis=0, keepdims=True))[:, 0].argmin()][None, :]
        away = distances(held, middle)[:, 0]
        pages.append(
            {
                "region": region, "part": part, "centre": middle.tobytes(), "radius": float(away.max()),
                "to_parent": float(distances(middle, centre)[0, 0]), "parent": centre.tobytes(), "parent_radius": reach,
                "norm": float(np.sqrt((held * held).sum(1).max())), "ids": ids[rows].astype("<i8").tobytes(),
                "vectors": held.astype("<f8").tobytes(), "width": held.shape[1], "to_centre": away.tobytes(),
            }
        )
    kinds = {"int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
    return pa.Table.from_pylist(pages, pa.schema([(n, kinds[k]) for n, k in (c.split() for c in PAGE_SCHEMA.split(", "))]))


def bound(norm_q: np.ndarray, norm_x: np.ndarray, nearest: np.ndarray) -> np.ndarray:
    """The largest inner product of vectors of length up to norm_x that are at least ``nearest`` away."""
    product = (norm_q**2 + norm_x**2 - np.maximum(nearest, 0) ** 2) / 2
    return np.minimum(product, norm_q * norm_x) + SLACK * (1 + np.abs(product))


class Best:
    """The k best of each query, ties to the smaller id."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.scores = np.full((n, k), -np.inf)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)
        self.floor = floor  # what a result must reach

    def need(self) -> np.ndarray:
        return np.maximum(self.floor, self.scores[:, -1])

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        hopeful = (scores >= self.need()[rows][:, None]).any(axis=1)
        rows, scores = rows[hopeful], scores[hopeful]
        if not len(rows):
            return
        k = self.scores.shape[1]
        all_scores = np.concatenate([self.scores[rows], scores], axis=1)
        all_ids = np.concatenate([self.ids[rows], np.broadcast_to(ids, scores.shape)], axis=1)
        order = np.lexsort((all_ids, -all_scores))[:, :k]
        self.scores[rows] = np.take_along_axis(all_scores, order, 1)
        self.ids[rows] = np.take_along_axis(all_ids, order, 1)


def search_region(pages: list[dict], queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, k: int) -> Best:
    """The k best vectors of a region for each query, among those that reach its floor."""
    width = max([queries.shape[1], *(p["width"] for p in pages)])
    q = fitted(queries, width)
    norm = np.sqrt((q * q).sum(1))
    best = Best(len(q), k, floor)
    centres = fitted(matrix([p["centre"] for p in pages]), width)
    radius, norms = np.array([p["radius"] for p in pages]), np.array([p["norm"] for p in pages])
    to_parent = np.array([p["to_parent"] for p in pages])
    from_parent = distances(q, fitted(np.frombuffer(pages[0]["parent"], "<f8")[None, :], width))[:, 0]
    # before any distance to a page: what the parent's distances allow
    allowed = bound(norm[:, None], norms[None, :], np.abs(from_parent[:, None] - to_parent) - radius)
    live = allowed >= floor[:, None]
    away = np.zeros(live.shape)
    for j in np.flatnonzero(live.any(axis=0)):
        rows = np.flatnonzero(live[:, j])
        away[rows, j] = distances(q[rows], centres[j : j + 1])[:, 0]
    limits = np.where(live, np.minimum(allowed, bound(norm[:, None], norms[None, :], away - radius)), -np.inf)
    order = np.argsort(-limits, axis=1, kind="stable")
    active = np.arange(len(q))
    for turn in range(len(pages)):
        page = order[active, turn]
        go = limits[active, page] >= best.need()[active]
        go &= np.isfinite(limits[active, page])
        active, page = active[go], page[go]
        if not len(active):
            break
        by_page = np.argsort(page, kind="stable")
        cuts = np.flatnonzero(np.diff(page[by_page])) + 1
        for lot in np.split(by_page, cuts):
            rows, p = active[lot], pages[page[lot[0]]]
            ids, to_centre = np.frombuffer(p["ids"], "<i8"), np.frombuffer(p["to_centre"], "<f8")
            held = fitted(np.frombuffer(p["vectors"], "<f8").reshape(len(ids), -1), width)
            # vectors that no query here can want, by their stored distance to the page's centre
            lengths = np.sqrt((held * held).sum(1))
            can = bound(norm[rows][:, None], lengths[None, :], np.abs(away[rows, page[lot[0]]][:, None] - to_centre))
            wanted = (can >= best.need()[rows][:, None]).any(axis=0)
            if wanted.any():
                scores = q[rows] @ held[wanted].T
                scores[query_ids[rows][:, None] == ids[wanted][None, :]] = -np.inf
                best.add(rows, scores, ids[wanted])
    return best


def top_k(
    vectors: DataFrame, is_query, k: int = 20, scale: float = 64.0, key: str = "vec_id", column: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id and score: the k best rows for each row where ``is_query``."""
    spark = prepare(vectors.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            found = integers(part.column("x"), scale)
            keep = [i for i, v in enumerate(found) if v is not None]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("vec_id").take(pa.array(keep, pa.int64())), part.column("query").take(pa.array(keep, pa.int64())),
                    pa.array([found[i].astype("<f8").tobytes() for i in keep], pa.binary()),
                ],
                names=["vec_id", "query", "v"],
            )

    source = vectors.select(
        F.col(key).cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("query"), F.col(column).alias("x")
    ).filter("vec_id IS NOT NULL AND x IS NOT NULL")
    packed = store(source.mapInArrow(pack, "vec_id long, query boolean, v binary"), "vectors")
    schema = "query_id long, rank int, vec_id long, score long"
    if not packed.rows:
        return spark.createDataFrame([], schema)
    regions = min(MOST_REGIONS, -(-packed.rows // REGION_ROWS))
    size = max(REGION_ROWS, -(-packed.rows // regions))
    drawn = packed.table.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).select("v").collect()
    pivots = spark.sparkContext.broadcast(choose_pivots(matrix([bytes(r["v"]) for r in drawn]), regions))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if part.num_rows:
                nearest = distances(matrix(part.column("v").to_pylist()), pivots.value).argmin(axis=1).astype(np.int32)
                yield part.append_column("region", pa.array(nearest))

    placed = packed.table.mapInArrow(place, "vec_id long, query boolean, v binary, region int")
    counts = placed.groupBy("region").agg(F.count("*").alias("n"))  # MOST_REGIONS rows at most
    parts = counts.select("region", F.ceil(F.col("n") / F.lit(size)).cast("int").alias("parts"))
    dealt = placed.join(F.broadcast(parts), "region").withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.col("parts")).cast("int"))
    dealt = store(dealt.drop("parts"), "placed-vectors").table
    index = store(dealt.groupBy("region", "part").applyInArrow(build_region, PAGE_SCHEMA), "pages").table
    nodes = index.groupBy("region", "part").agg(F.first("parent").alias("centre"), F.max("parent_radius").alias("radius"), F.max("norm").alias("norm"))
    asked = dealt.filter("query").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "region", "part").dropDuplicates(["query_id", "q"])
    blocks = max(1, -(-dealt.filter("query").count() // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("query_id", F.lit(11)), F.lit(blocks)).cast("int")

    def search(pages: pa.Table, lot: pa.Table) -> pa.Table:
        kinds = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if not pages.num_rows or not lot.num_rows:
            return kinds.empty_table()
        ids, floor = lot.column("query_id").to_numpy(), lot.column("floor").to_numpy()
        best = search_region(pages.to_pylist(), matrix(lot.column("q").to_pylist()), ids, floor, k)
        row, at = np.nonzero(np.isfinite(best.scores) & (best.scores >= floor[:, None]))
        return pa.table(
            [pa.array(ids[row]), pa.array(best.ids[row, at]), pa.array(best.scores[row, at].astype(np.int64))], schema=kinds
        )

    every_block = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(lot: DataFrame) -> DataFrame:
        keys = ["region", "part", "block"]
        return every_block.groupBy(*keys).cogroup(lot.withColumn("block", block).groupBy(*keys)).applyInArrow(
            search, "query_id long, vec_id long, score long"
        )

    at_home = store(run(asked.withColumn("floor", F.lit(float("-inf")))), "first-results").table
    floors = at_home.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    floors = floors.select("query_id", F.when(F.col("n") >= k, F.col("least").cast("double")).alias("known"))
    tops = spark.sparkContext.broadcast([(r["region"], r["part"], bytes(r["centre"]), r["radius"], r["norm"]) for r in nodes.collect()])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query once for each other region that may hold one of its best."""
        centres = matrix([t[2] for t in tops.value])
        region, part, radius, norms = (np.array([t[i] for t in tops.value]) for i in (0, 1, 3, 4))
        for b in batches:
            if not b.num_rows:
                continue
            q = matrix(b.column("q").to_pylist())
            norm, floor = np.sqrt((q * q).sum(1)), b.column("floor").to_numpy()
            can = bound(norm[:, None], norms[None, :], distances(q, centres) - radius) >= floor[:, None]
            can &= (b.column("region").to_numpy()[:, None] != region) | (b.column("part").to_numpy()[:, None] != part)
            row, node = np.nonzero(can)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("query_id").take(take), b.column("q").take(take), pa.array(region[node].astype(np.int32)),
                    pa.array(part[node].astype(np.int32)), b.column("floor").take(take),
                ],
                names=["query_id", "q", "region", "part", "floor"],
            )

    known = asked.join(floors, "query_id", "left").select(
        "query_id", "q", "region", "part", F.coalesce("known", F.lit(float("-inf"))).alias("floor")
    )
    elsewhere = run(known.mapInArrow(route, "query_id long, q binary, region int, part int, floor double"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    merged = at_home.unionByName(elsewhere).withColumn("rank", rank).filter(F.col("rank") <= k)
    return merged.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
