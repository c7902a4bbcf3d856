"""Join of near-equal texts on the Jaccard similarity of their word n-grams, with Bayesian pruning of candidates.

Texts with the same set of n-grams are one class, represented by one of them. Representatives that share
a band of their MinHash signature are candidates; links to the smallest member of each band's bucket tie all candidates
of a text into one cluster, without a row for each pair. A cluster is compared inside tasks, in blocks if it is large:
signatures step by step, dropping a pair as soon as the posterior probability that its similarity reaches the threshold
(uniform prior, binomial matches) is below ``TOLERANCE``; the pairs left are verified on the n-gram sets themselves.

With 42 bands of 6 values a pair at similarity 0.8 shares no band with probability 3e-6, and less above.

Words are runs of digits, letters and anything outside ASCII, with A-Z lower-cased; a text of fewer words than an
n-gram has one n-gram of all its words. Defined cases: null texts and texts without words link to nothing. Null keys
come last in their order. Repeated rows are copies of each other. Rows of one key are told apart. Extra columns are kept
only by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wireloom.session import store

from . import batches
from .batches import pack_array, unpack_array
from .common import ALNUM, U64, flat, mix, powers, prepare, word_hashes
from .components import connected

WORDS, THRESHOLD = 5, 0.8
BANDS, BAND = 42, 6
STEP = 36  # signature values compared at a time
TOLERANCE = 1e-7
#: Members of a cluster compared in one task.
BLOCK = 512


@cache
def multipliers() -> np.ndarray:
    return mix(np.arange(1, BANDS * BAND + 1, dtype=U64)) | U64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text in ascending order, one text after another, and where each text's begin."""
    words, firsts = word_hashes(data, offsets, ALNUM)
    count = np.diff(firsts)
    weights = powers(n + 1, 0xD6E8FEB86659FD93)
    padded = np.append(words, np.zeros(n, U64))
    grams = np.zeros(len(words), U64)
    for j in range(n):
        grams += padded[j : j + len(words)] * weights[j]
    place = np.arange(len(words)) - np.repeat(firsts[:-1], count)
    whole = place <= np.repeat(count - n, count)
    short = np.flatnonzero((count > 0) & (count < n))
    for t in short.tolist():  # all words, with their number
        own = words[firsts[t] : firsts[t + 1]]
        grams[firsts[t]] = (own * weights[: len(own)]).sum(dtype=U64) + U64(len(own))
        whole[firsts[t]] = True
    text = np.repeat(np.arange(len(count)), count)[whole]
    grams = mix(grams[whole])
    order = np.lexsort((grams, text))
    grams, text = grams[order], text[order]
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])
    grams, text = grams[fresh], text[fresh]
    return grams, np.searchsorted(text, np.arange(len(count) + 1))


def signatures(grams: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """MinHash signatures (values x sets) of non-empty sets that lie one after another from ``begins`` on."""
    out = np.empty((BANDS * BAND, len(begins)), np.uint32)
    for k, m in enumerate(multipliers()):
        out[k] = np.minimum.reduceat((grams * m) >> U64(32), begins).astype(np.uint32)
    return out


@cache
def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """The fewest matches in ``n`` values that leave the threshold a posterior probability of ``tolerance``."""
    total = 0.0  # P(Beta(m + 1, n - m + 1) >= t) = P(Bin(n + 1, t) <= m)
    for m in range(n + 1):
        total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


def pruned_pairs(left: np.ndarray, right: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of columns of two signature matrices that Bayesian pruning leaves; of one matrix, each pair once."""
    a, b = np.triu_indices(left.shape[1], 1) if same else (x.ravel() for x in np.indices((left.shape[1], right.shape[1])))
    matches = np.zeros(len(a), np.int32)
    left, right = np.ascontiguousarray(left.T), np.ascontiguousarray(right.T)
    for upto in range(STEP, BANDS * BAND + 1, STEP):
        span = slice(upto - STEP, upto)
        for lot in range(0, len(a), 1 << 16):
            part = slice(lot, lot + (1 << 16))
            matches[part] += (left[a[part], span] == right[b[part], span]).sum(axis=1, dtype=np.int32)
        live = matches >= least_matches(upto, threshold, TOLERANCE)
        a, b, matches = a[live], b[live], matches[live]
    return a, b


def verified(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs of sets are similar enough, exactly."""
    if not len(a):
        return np.zeros(0, bool)
    sizes = np.array([len(s) for s in sets])
    if len(a) <= 4 * len(sets):
        both = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a.tolist(), b.tolist())])
    else:  # many pairs: products of membership columns
        used = np.unique(np.concatenate([a, b]))
        row = np.full(len(sets), -1)
        row[used] = np.arange(len(used))
        items, column, seen = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True, return_counts=True)
        own = np.repeat(np.arange(len(used)), sizes[used])
        shared = seen[column] > 1
        place = np.cumsum(seen > 1) - 1
        own, column = own[shared], place[column[shared]]
        order = np.argsort(column, kind="stable")
        own, column = own[order], column[order]
        common = np.zeros((len(used), len(used)), np.float64)
        for lot in range(0, int((seen > 1).sum()), 2048):
            i, j = np.searchsorted(column, [lot, lot + 2048])
            member = np.zeros((len(used), 2048), np.float32)
            member[own[i:j], column[i:j] - lot] = 1
            common += member @ member.T
        both = common[row[a], row[b]]
    return both >= threshold * (sizes[a] + sizes[b] - both) - 1e-9


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def compare(threshold: float):
    def run(group: pa.Table) -> pa.Table:
        """Links inside one block of a cluster, or between two; for each member the least one it hangs together with."""
        group = group.sort_by("uid")
        uid, copies, side = (group.column(c).to_numpy() for c in ("uid", "copies", "block"))
        sets = [unpack_array(x, "<u8") for x in group.column("grams").to_pylist()]
        sizes = np.array([len(s) for s in sets])
        marks = signatures(np.concatenate(sets), np.cumsum(sizes) - sizes)
        low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
        if low == high:
            a, b = pruned_pairs(marks, marks, threshold, True)
        else:
            left, right = np.flatnonzero(side == low), np.flatnonzero(side == high)
            a, b = pruned_pairs(marks[:, left], marks[:, right], threshold, False)
            a, b = left[a], right[b]
        sure = verified(sets, a, b, threshold)
        a, b = a[sure], b[sure]
        links = np.bincount(a, copies[b], len(uid)) + np.bincount(b, copies[a], len(uid))
        forest = Forest(len(uid))
        for i, j in zip(a.tolist(), b.tolist()):
            forest.join(i, j)
        roots = np.array([forest.root(i) for i in range(len(uid))])
        return pa.table({"uid": uid, "links": links.astype(np.int64), "root": uid[roots]})

    return run


SKETCH = "uid long, key long, copy_a long, copy_b long, n long, bands binary"


def sketch(key: str, text: str, n: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows:
            for row in part.to_pylist():
                done = 0
                for held in batches.unpack(row["blob"]):
                    grams, begins = shingle_sets(*flat(held.column(text)), n)
                    size = np.diff(begins)
                    full = np.flatnonzero(size)
                    sums = [np.zeros(len(size), U64), np.zeros(len(size), U64)]
                    bands = np.zeros((len(size), BANDS), U64)
                    if len(full):
                        for s, salt in zip(sums, (0x1D8E4E27C47D124F, 0x2545F4914F6CDD1D)):
                            s[full] = np.add.reduceat(mix(grams ^ U64(salt)), begins[:-1][full])
                        marks = signatures(grams, begins[:-1][full]).astype(U64)
                        for k in range(BANDS):
                            value = np.full(len(full), k + 1, U64)
                            for line in marks[k * BAND : (k + 1) * BAND]:
                                value = mix(value + line)
                            bands[full, k] = value
                    numbers = batches.row_numbers(row["batch"], done + len(size))[done:]
                    done += len(size)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(numbers), held.column(key).cast(pa.int64()), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)),
                            pa.array(size.astype(np.int64)), pa.array([b.tobytes() if s else None for b, s in zip(bands, size.tolist())], pa.binary()),
                        ],
                        names=[c.split()[0] for c in SKETCH.split(", ")],
                    )

    return run


def similar_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = WORDS, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """The packed rows of ``docs``, and for each: uid, key, class_id, copies, group_id, group_uid and n_links.

    class_id is the least key of the texts with the same n-grams, copies their number; group_id is the least key of
    those tied together by links and group_uid tells such groups apart; n_links counts the other rows that are similar
    enough, copies included.
    """
    prepare(docs.sparkSession)
    packed, _ = batches.pack(docs, docs.columns, text)
    rows = store(packed.mapInArrow(sketch(key, text, n), SKETCH), "sketches").table
    grouped = rows.filter("n > 0").groupBy("copy_a", "copy_b", "n").agg(
        F.min("key").alias("class_id"), F.count("*").alias("copies"), F.min("uid").alias("uid")
    )
    classes = store(grouped.join(rows.select("uid", "bands"), "uid"), "classes").table

    def unfold(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if part.num_rows:
                bands = np.frombuffer(b"".join(part.column("bands").to_pylist()), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column("uid").to_numpy(), BANDS)), pa.array(bands)], names=["uid", "band"])

    banded = classes.select("uid", "bands").mapInArrow(unfold, "uid long, band long")
    heads = banded.groupBy("band").agg(F.min("uid").alias("head"), F.count("*").alias("members")).filter("members > 1")
    tied = banded.join(heads, "band").filter("uid <> head").select(F.col("uid").alias("a"), F.col("head").alias("b")).distinct()
    clusters = connected(tied)
    clusters = clusters.select(F.col("node").alias("uid"), "root").unionByName(
        clusters.select(F.col("root").alias("uid"), "root").distinct()
    )
    sizes = clusters.groupBy("root").agg(F.count("*").alias("members"))
    members = clusters.join(sizes, "root").join(classes.select("uid", "copies"), "uid")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    members = members.select("uid", "root", "copies", blocks.alias("blocks"), F.pmod(F.xxhash64("uid"), blocks).cast("int").alias("block"))

    def sets(parts: pa.Table, wanted: pa.Table) -> pa.Table:
        out = []
        for row in parts.to_pylist() if wanted.num_rows else []:
            places = wanted.column("uid").to_numpy() - (np.int64(row["batch"]) << batches.PLACE_BITS)
            done, found = 0, [b""] * len(places)
            for held in batches.unpack(row["blob"]):
                mine = np.flatnonzero((places >= done) & (places < done + held.num_rows))
                if len(mine):
                    grams, begins = shingle_sets(*flat(held.column(text).take(pa.array(places[mine] - done))), n)
                    for k, i in enumerate(mine.tolist()):
                        found[i] = pack_array(grams[begins[k] : begins[k + 1]])
                done += held.num_rows
            out.append(wanted.drop_columns(["batch"]).append_column("grams", pa.array(found, pa.binary())))
        kinds = [("uid", pa.int64()), ("root", pa.int64()), ("copies", pa.int64()), ("blocks", pa.int32()), ("block", pa.int32()), ("grams", pa.binary())]
        return pa.concat_tables(out) if out else pa.schema(kinds).empty_table()

    asked = members.withColumn("batch", F.shiftright("uid", batches.PLACE_BITS))
    held = packed.groupBy("batch").cogroup(asked.groupBy("batch")).applyInArrow(
        sets, "uid long, root long, copies long, blocks int, block int, grams binary"
    )
    # each block meets itself and every other one
    paired = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "uid", "root", "copies", "block", "grams", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    )
    found = store(paired.groupBy("root", "low", "high").applyInArrow(compare(threshold), "uid long, links long, root long"), "links").table
    links = found.groupBy("uid").agg(F.sum("links").alias("links"))
    groups = connected(found.select(F.col("uid").alias("a"), F.col("root").alias("b")))
    linked = (
        classes.select("uid", "copy_a", "copy_b", "n", "copies", "class_id").join(links, "uid", "left")
        .join(groups.withColumnRenamed("node", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    )
    groups = linked.groupBy("root").agg(F.min("class_id").alias("group_id"))
    linked = linked.join(groups, "root").select(
        "copy_a", "copy_b", "n", "class_id", "copies", "group_id", F.col("root").alias("group_uid"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
    )
    every = rows.select("uid", "key", "copy_a", "copy_b", "n").join(linked, ["copy_a", "copy_b", "n"], "left")
    return packed, every.select(
        "uid", "key", F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("key")).alias("class_id"),
        F.coalesce("copies", F.lit(1).cast("long")).alias("copies"),
        F.when(F.col("n") > 0, F.col("group_id")).otherwise(F.col("key")).alias("group_id"),
        F.coalesce("group_uid", "uid").alias("group_uid"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group of linked texts, that of the smallest key."""
    packed, found = similar_texts(docs, key, text, **options)
    least = found.filter(F.col("key").eqNullSafe(F.col("group_id"))).groupBy("group_uid").agg(F.min("uid").alias("uid"))
    return batches.take(packed, least.select("uid"), docs.schema)
