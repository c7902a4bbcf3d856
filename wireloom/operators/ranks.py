"""Running totals, order statistics and codes without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wireloom.operators.lookup import attach
from wireloom.session import Stored, store

# Exact running totals: slice the rows by range, total each slice, then add what lies in the
# slices before to the running total inside the slice. A slice is one shuffle partition in size.


# Spark's own limit of a window's rows ends at this k by default.
SPARK_CUTS = 1_000
TOP_SLICES = 64


def running_totals(rows: DataFrame, groups: list[str], order: Column, sums: list[str]) -> DataFrame:
    """Add ``<sum>_upto``, the total of each sum column over the group up to and with this row.

    Rows must be unique per group and ``order``: aggregate ties away first, so that one value
    held by a third of the rows is one row here.
    """
    # A struct is never null, so that rows of a null group meet their offsets too.
    by = ["_group"]
    keyed = rows.withColumn("_group", F.struct(*[F.col(g) for g in groups]) if groups else F.lit(0))
    sliced = store(
        keyed.repartitionByRange(*[F.col(g) for g in by], order).withColumn("_slice", F.spark_partition_id()),
        "slices",
    ).table
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*by, "_slice")
        .agg(*[F.sum(s).alias(s) for s in sums])
        .select(
            *by, "_slice",
            *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"_{s}_before") for s in sums],
        )
    )
    inside = Window.partitionBy(*by, "_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    # The join and the window below hash on the same columns: a slice moves once.
    placed = sliced.join(offsets, [*by, "_slice"])
    totals = {f"{s}_upto": F.col(f"_{s}_before") + F.sum(s).over(inside) for s in sums}
    return placed.withColumns(totals).select(*rows.columns, *totals)


def ordinal_codes(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values of each column in ascending order, coded from 0, with their row counts.

    A missing value is the text ``None`` and has a code of its own.
    """
    cells = [
        F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit("None")).alias("value"))
        for c in columns
    ]
    values = (
        rows.select(F.inline(F.array(*cells)))
        .groupBy("column", "value")
        .agg(F.count("*").alias("rows"), F.lit(1).alias("one"))
    )
    ranked = running_totals(values, ["column"], F.col("value"), ["one"])
    return ranked.select("column", "value", (F.col("one_upto") - 1).cast("int").alias("code"), "rows")


def quantiles(
    rows: DataFrame, group: str, value: str, q: float, name: str, sizes: Stored, size: str
) -> DataFrame:
    """Exact quantile per group, linear between neighbouring values. ``size`` is a group's row count."""
    tallied = rows.groupBy(group, value).agg(F.count("*").alias("n"))
    ranked = running_totals(tallied, [group], F.col(value), ["n"])
    placed = attach(ranked, sizes, [group], size, how="inner")
    position = F.lit(q) * (F.col(size) - 1)

    def at(rank: Column) -> Column:
        holds = (F.col("n_upto") - F.col("n") <= rank) & (rank < F.col("n_upto"))
        return F.max(F.when(holds, F.col(value)))

    found = placed.groupBy(group).agg(
        at(F.floor(position)).alias("_low"),
        at(F.ceil(position)).alias("_high"),
        F.max(position - F.floor(position)).alias("_part"),
    )
    between = F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part")
    return found.select(group, between.alias(name))


def top_k(rows: DataFrame, group: str, order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group.

    Up to ``SPARK_CUTS`` Spark cuts each task's rows to ``k`` before the shuffle. Beyond, the rows of a
    group are first dealt over slices and cut there, so that no task sorts a whole group.
    """
    if k > SPARK_CUTS:
        by = Window.partitionBy(group, "_slice").orderBy(*order)
        sliced = rows.withColumn("_slice", F.pmod(F.xxhash64(*rows.columns), F.lit(TOP_SLICES)))
        rows = sliced.withColumn("_place", F.row_number().over(by)).filter(F.col("_place") <= k).drop("_slice", "_place")
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn(rank, place).filter(F.col(rank) <= k)
