"""The bounded neighbourhood of flagged nodes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wireloom.operators.lookup import attach
from wireloom.operators.ranks import top_k
from wireloom.operators.sample import text_draw
from wireloom.schema import EDGE, NODE
from wireloom.session import Stored, store

# Graph limits on a machine with enough memory, and the number of highlighted nodes.
MAX_NODES, MAX_EDGES, TOP_NODES = 500, 800, 4


@dataclass(frozen=True)
class Subgraph:
    """``nodes``: SensorId, node, tier, graph_degree, cnc_score. ``edges``: SensorId, src, dst, weight."""

    nodes: DataFrame
    edges: DataFrame


def at_end(table: DataFrame, end: str, **renamed: str) -> DataFrame:
    """A node table keyed for a join on one end of the edges."""
    return table.select(
        "SensorId", F.col("node").alias(end), *[F.col(c).alias(n) for c, n in renamed.items()]
    )


def vertices(edges: DataFrame) -> DataFrame:
    ends = F.array(F.col("SrcAddr"), F.col("DstAddr"))
    return edges.select("SensorId", F.explode(ends).alias("node")).distinct()


def graph_degree(edges: DataFrame) -> DataFrame:
    """Distinct successors plus distinct predecessors; a self-loop counts twice."""
    ends = F.array(F.col("SrcAddr"), F.col("DstAddr"))
    return (
        edges.select("SensorId", F.explode(ends).alias("node"))
        .groupBy(*NODE)
        .agg(F.count("*").alias("graph_degree"))
    )


def mark_ends(edges: DataFrame, chosen: Stored, degrees: DataFrame, mark: str) -> DataFrame:
    """Edges with ``src_<mark>`` and ``dst_<mark>``: whether each end is among the chosen nodes."""
    for end, flag in (("SrcAddr", f"src_{mark}"), ("DstAddr", f"dst_{mark}")):
        lookup = Stored(at_end(chosen.table, end).withColumn(flag, F.lit(True)), chosen.rows)
        sizes = at_end(degrees, end, graph_degree="graph_degree")
        edges = attach(edges, lookup, ["SensorId", end], "graph_degree", sizes=sizes)
        edges = edges.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))
    return edges


def neighbours(touching: DataFrame) -> DataFrame:
    """Predecessors and successors of flagged nodes that are not flagged themselves."""
    source, target = F.col("src_flagged"), F.col("dst_flagged")
    found = F.when(source & ~target, F.col("DstAddr")).when(target & ~source, F.col("SrcAddr"))
    return touching.filter(source != target).select("SensorId", found.alias("node")).distinct()


def flag_subgraph(
    edges: DataFrame,
    nodes: DataFrame,
    max_nodes: int = MAX_NODES,
    max_edges: int = MAX_EDGES,
    random_seed: int | None = None,
) -> Subgraph:
    """Flagged nodes, their best-connected neighbours and the edges among them, per sensor.

    All flagged nodes stay; the caps bound the others. With ``random_seed`` the caps draw at random
    as the older detector does: up to ``max_nodes`` neighbours, then ``max_edges`` edges, and where
    edges were cut the nodes left without one go.
    """
    degrees = store(graph_degree(edges), "degrees").table
    flagged = store(nodes.filter("flagged").select(*NODE), "flagged")
    touching = mark_ends(edges, flagged, degrees, "flagged")
    kept = store(_kept_neighbours(touching, flagged, degrees, max_nodes, random_seed), "kept-neighbours")
    inside = mark_ends(touching, kept, degrees, "kept").filter(
        (F.col("src_flagged") | F.col("src_kept")) & (F.col("dst_flagged") | F.col("dst_kept"))
    )
    if random_seed is None:
        touches = F.col("src_flagged") | F.col("dst_flagged")
        order = [F.desc(touches), F.desc("w_sensor"), F.col("SrcAddr"), F.col("DstAddr")]
    else:
        draw = text_draw(F.concat_ws("|", *EDGE), random_seed)
        order = [draw, F.col("SrcAddr"), F.col("DstAddr")]
    best = store(top_k(inside, "SensorId", order, max_edges).select(*EDGE, "w_sensor"), "kept-edges").table
    members = Stored(flagged.table.unionByName(kept.table), flagged.rows + kept.rows)
    if random_seed is not None:
        members = store(_connected(members.table, inside, best, max_edges), "connected")
    shown = attach(nodes.select(*NODE, "cnc_score", "flagged"), members, NODE, None, how="inner")
    shown = store(attach(degrees, Stored(shown, members.rows), NODE, None, how="inner"), "shown-nodes")
    leaders = top_k(shown.table.filter("flagged"), "SensorId", [F.desc("cnc_score"), F.col("node")], TOP_NODES)
    tiers = shown.table.join(leaders.select(*NODE, "rank"), NODE, "left")
    tier = F.when(F.col("rank").isNotNull(), "top").when(F.col("flagged"), "candidate").otherwise("normal")
    return Subgraph(
        tiers.select(*NODE, tier.alias("tier"), "graph_degree", "cnc_score"),
        best.select(
            "SensorId", F.col("SrcAddr").alias("src"), F.col("DstAddr").alias("dst"),
            F.col("w_sensor").alias("weight"),
        ),
    )


def _kept_neighbours(touching, flagged, degrees, max_nodes, random_seed):
    around = neighbours(touching)
    if random_seed is not None:
        draw = text_draw(F.concat_ws("|", *NODE), random_seed)
        return top_k(around, "SensorId", [draw, F.col("node")], max_nodes).select(*NODE)
    taken = flagged.table.groupBy("SensorId").agg(F.count("*").alias("taken"))
    ranked = top_k(
        around.join(degrees, NODE), "SensorId", [F.desc("graph_degree"), F.col("node")], max_nodes
    )
    placed = ranked.join(taken, "SensorId")  # at most max_nodes rows per sensor
    return placed.filter(F.col("rank") + F.col("taken") <= max_nodes).select(*NODE)


def _connected(members, inside, best, max_edges):
    """Members with a kept edge, and every member of a sensor whose edges were not cut."""
    counted = inside.groupBy("SensorId").agg(F.count("*").alias("n_inside"))
    cut = counted.filter(F.col("n_inside") > max_edges).select("SensorId")
    sensors_cut = store(cut, "cut-sensors")
    marked = attach(
        members, Stored(sensors_cut.table.withColumn("cut", F.lit(True)), sensors_cut.rows),
        ["SensorId"], None,
    )
    linked = vertices(best).withColumn("linked", F.lit(True))
    return marked.join(linked, NODE, "left").filter("cut is null or linked").select(*NODE)
