"""Row-cap sampling, the stratified split and class weights."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wireloom.operators.ranks import running_totals
from wireloom.session import Stored, store

SEED = 42


def text_draw(text: Column, seed: int = SEED) -> Column:
    """A long from the MD5 sum of a text and the seed: the same in any system that has MD5.

    The order of these longs is that of the first sixteen hex digits of ``md5(text || '|' || seed)``.
    """
    digits = F.substring(F.md5(F.concat_ws("|", text, F.lit(str(seed)))), 1, 16)
    unsigned = F.conv(digits, 16, 10).cast("decimal(20,0)")
    return (unsigned - F.lit(str(2**63)).cast("decimal(20,0)")).cast("bigint")


def with_draw(rows: DataFrame, seed: int = SEED, text: Column | None = None) -> Stored:
    """The rows, written once, with a ``draw`` each: a long from their content and the seed.

    The same rows get the same draws however they are partitioned. Equal rows share a draw and may
    stand for each other, so only those at a cut have to be told apart. Draws come from all columns, by a fast hash, or
    from ``text``, by MD5, so that another system can repeat them; the text must then tell unequal rows apart.
    """
    draw = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns], F.lit(seed)) if text is None else text_draw(text, seed)
    return store(rows.withColumn("draw", draw), "drawn")


@dataclass(frozen=True)
class Cut:
    """Rows of smaller draws are taken, and ``take`` of the ``tied`` rows with this one."""

    draw: int
    take: int
    tied: int


def _cutoffs(rows: DataFrame, group: str, sizes: dict[int, int], takes: dict[int, int]) -> dict[int, Cut]:
    """Per group, the cut up to which exactly ``takes`` of its ``sizes`` rows lie.

    Draws are nearly uniform over the longs, so only a narrow band around the expected cut is ranked.
    """

    def edge(value: int, side: int) -> int:
        n, k = sizes[value], takes[value]
        slack = (10 * math.sqrt(k * (n - k) / n) + 20) / n
        at = max(0.0, k / n + side * slack)
        return 2**63 - 1 if at >= 1 else int(at * 2**64) - 2**63

    def per_group(side: int) -> Column:
        chain = F.lit(None).cast("bigint")
        for value in sizes:
            chain = F.when(_is(group, value), F.lit(edge(value, side)).cast("bigint")).otherwise(chain)
        return chain

    narrow = rows.select(group, "draw")
    under = narrow.groupBy(group).agg(F.count_if(F.col("draw") < per_group(-1)).alias("n"))
    below = {r[group]: r["n"] for r in under.collect()}
    band = narrow.filter((F.col("draw") >= per_group(-1)) & (F.col("draw") <= per_group(1)))
    found = _ranked_draw(band, group, {v: takes[v] - below[v] for v in sizes})
    if len(found) < len(sizes):  # a band missed its cut, as when many rows are equal: rank everything
        found = _ranked_draw(narrow, group, takes)
    return found


def _is(group: str, value: int | None) -> Column:
    return F.col(group).eqNullSafe(F.lit(value))


def _ranked_draw(rows: DataFrame, group: str, ranks: dict[int, int]) -> dict[int, Cut]:
    tallied = rows.groupBy(group, "draw").agg(F.count("*").alias("one"))
    before, wanted = F.col("one_upto") - F.col("one"), F.lit(False)
    for value, rank in ranks.items():
        wanted = wanted | (_is(group, value) & (before < rank) & (F.col("one_upto") >= rank))
    ranked = running_totals(tallied, [group], F.col("draw"), ["one"])
    return {
        r[group]: Cut(r["draw"], ranks[r[group]] - r["one_upto"] + r["one"], r["one"]) for r in ranked.filter(wanted).collect()
    }


def _mark_first(rows: DataFrame, group: str, cuts: dict[int, Cut], name: str) -> DataFrame:
    """Add the boolean ``name``: whether the row is among the first of its group up to the cut."""
    first, tied = F.lit(False), F.lit(False)
    limit = F.lit(0)
    for value, cut in cuts.items():
        here = _is(group, value)
        first = first | (here & ((F.col("draw") < cut.draw) | ((F.col("draw") == cut.draw) & F.lit(cut.take >= cut.tied))))
        if cut.take < cut.tied:
            tied = tied | (here & (F.col("draw") == cut.draw))
            limit = F.when(here, F.lit(cut.take)).otherwise(limit)
    if all(cut.take >= cut.tied for cut in cuts.values()):
        return rows.withColumn(name, first)
    equal = store(rows.filter(tied).withColumns({"_place": F.monotonically_increasing_id(), "one": F.lit(1)}), "tied").table
    numbered = running_totals(equal, [group], F.col("_place"), ["one"]).withColumn(name, F.col("one_upto") <= limit)
    return rows.filter(~tied).withColumn(name, first).unionByName(numbered.select(*rows.columns, name))


def sample_rows(drawn: Stored, n: int) -> DataFrame:
    """Exactly ``n`` rows at random, or all of them if there are no more."""
    if drawn.rows <= n:
        return drawn.table
    keyed = drawn.table.withColumn("_all", F.lit(0))
    cuts = _cutoffs(keyed, "_all", {0: drawn.rows}, {0: n}) if n else {}
    return _mark_first(keyed, "_all", cuts, "_taken").filter("_taken").drop("_all", "_taken")


def train_quotas(counts: dict[int, int], test_share: float) -> dict[int, int]:
    """Training rows per class: the test part is rounded up, classes share by largest remainder."""
    total = sum(counts.values())
    train = total - math.ceil(round(total * test_share, 9))
    quotas = {c: train * n // total for c, n in counts.items()}
    by_rest = sorted(counts, key=lambda c: (-(train * counts[c] % total), c is None, c or 0))
    for c in by_rest[: train - sum(quotas.values())]:
        quotas[c] += 1
    return quotas


def split_rows(drawn: Stored, label: str = "Label", test_share: float = 0.30) -> DataFrame:
    """Add ``split``, ``train`` or ``test``, with exact shares of every class."""
    sizes = {r[label]: r["n"] for r in drawn.table.groupBy(label).agg(F.count("*").alias("n")).collect()}
    quotas = {c: k for c, k in train_quotas(sizes, test_share).items() if k > 0}
    cuts = _cutoffs(drawn.table, label, {c: sizes[c] for c in quotas}, quotas) if quotas else {}
    marked = _mark_first(drawn.table, label, cuts, "_train")
    return marked.withColumn("split", F.when(F.col("_train"), "train").otherwise("test")).drop("_train")


def fold_rows(drawn: Stored, folds: int, label: str = "Label") -> DataFrame:
    """Add ``fold``, from 0: equal shares of every class, to within a row; one cut for each class and fold but the last."""
    sizes = {r[label]: r["n"] for r in drawn.table.groupBy(label).agg(F.count("*").alias("n")).collect()}
    # rows that come from a cut of their draws fill only part of the longs; scrambled draws fill all of them again
    rows, names = drawn.table.withColumns({"_draw": F.col("draw"), "draw": F.xxhash64("draw")}), []
    for k in range(1, folds):
        takes = {c: n * k // folds for c, n in sizes.items() if n * k // folds}
        cuts = _cutoffs(rows, label, {c: sizes[c] for c in takes}, takes) if takes else {}
        names.append(f"_upto{k}")
        rows = _mark_first(rows, label, cuts, names[-1])
    passed = sum(((~F.col(n)).cast("int") for n in names), F.lit(0))
    return rows.withColumn("fold", passed).withColumn("draw", F.col("_draw")).drop("_draw", *names)


def class_weights(rows: DataFrame, label: str = "Label") -> DataFrame:
    """Balanced weight per class: rows / (classes * rows of the class)."""
    sizes = rows.groupBy(label).agg(F.count("*").alias("n"))
    whole = sizes.agg(F.sum("n").alias("rows"), F.count("*").alias("classes")).first()
    return sizes.select(
        label, (F.lit(float(whole["rows"] or 0)) / (F.col("n") * whole["classes"])).alias("weight")
    )


def with_class_weight(rows: DataFrame, label: str = "Label", name: str = "weight") -> DataFrame:
    weight = F.lit(1.0)
    for row in class_weights(rows, label).collect():  # one row per class
        weight = F.when(F.col(label) == row[label], row["weight"]).otherwise(weight)
    return rows.withColumn(name, weight)
