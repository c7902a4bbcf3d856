"""Joining a unique-key table onto rows whose keys may be very uneven."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wireloom.session import Stored, store

# Rows times columns; with short addresses and numbers this is a few tens of megabytes at most.
BROADCAST_CELLS = 1_000_000
HEAVY_KEYS = 1_000
# Partitions' worth of places that rows of heavy keys are dealt to.
LANES = 1 << 16


def attach(
    rows: DataFrame,
    lookup: Stored,
    keys: list[str],
    size: str | None,
    how: str = "left",
    sizes: DataFrame | None = None,
    broadcast_cells: int | None = None,
    heavy_keys: int | None = None,
) -> DataFrame:
    """Join ``lookup``, one row per key, onto ``rows`` without moving heavy keys.

    A lookup of at most ``broadcast_cells`` counted cells is broadcast. Of a larger one the ``heavy_keys`` keys with the
    largest ``size`` are broadcast, and rows of these keys get their values at once; in the shuffle that joins the others
    they are dealt over all partitions, so every key left to it holds less than a thousandth of the rows by default. The
    rows are read once. ``size`` counts the rows of a key; it is read from ``sizes`` where the lookup covers only part of
    the keys, and is ``None`` where ``rows`` are unique by key as well, so that no key is heavy.
    """
    table = lookup.table
    bound = BROADCAST_CELLS if broadcast_cells is None else broadcast_cells
    if lookup.rows * len(table.columns) <= bound:
        return rows.join(F.broadcast(table), keys, how)
    if size is None:
        return rows.join(table, keys, how)
    ranked = table if sizes is None else sizes
    top = ranked.orderBy(F.desc(size), *keys).limit(heavy_keys or HEAVY_KEYS)
    heavy = store(top.select(keys), "heavy-keys").table
    values = [c for c in table.columns if c not in keys]
    packed = F.struct(*values, F.lit(True).alias("_known"))
    known = table.join(F.broadcast(heavy), keys, "left_semi").select(*keys, packed.alias("_held"))
    # heavy keys that the lookup lacks are dealt out as well
    held = heavy.join(F.broadcast(known), keys, "left").withColumn("_heavy", F.lit(True))
    # always 0, but no literal: that would be taken out of the join's keys
    own_lane = F.pmod(F.xxhash64(*keys), F.lit(1)).cast("int")
    light = table.join(F.broadcast(heavy), keys, "left_anti").select(*keys, own_lane.alias("_lane"), packed.alias("_light"))
    lane = F.when(F.col("_heavy").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.lit(LANES)) + 1).otherwise(0)
    marked = rows.join(F.broadcast(held), keys, "left").withColumn("_lane", lane.cast("int"))
    joined = marked.join(light, [*keys, "_lane"], "left").withColumn("_found", F.coalesce("_held", "_light"))
    if how == "inner":
        joined = joined.filter(F.col("_found").isNotNull())
    others = [c for c in rows.columns if c not in keys]
    return joined.select(*keys, *others, *[F.col(f"_found.{c}").alias(c) for c in values])
