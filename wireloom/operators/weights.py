"""Edge tables and the graph weights derived from them.

Everything starts from one aggregate of the flows per directed pair. Partial aggregation folds a
pair that holds a third of all flows into one row per task before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wireloom.operators.lookup import attach
from wireloom.schema import EDGE, PAIR
from wireloom.session import Stored, store


def pair_weights(flows: DataFrame) -> DataFrame:
    """Flows per directed pair over all sensors together."""
    return flows.groupBy(*PAIR).agg(F.count("*").alias("EdgeWeight"))


def sensor_edges(flows: DataFrame, prob: str | None = None, extra: list[Column] | None = None) -> DataFrame:
    """One row per sensor and directed pair: its flows, their probabilities, its label, its weights.

    ``w_sensor`` counts the pair's flows at this sensor, ``w_global`` at all sensors. Flows without
    a sensor count into ``w_global`` but give no row.
    """
    aggregates = [F.count("*").alias("w_sensor"), F.max("LabelCNC").alias("label_cnc")]
    if prob is not None:
        aggregates += [F.count(prob).alias("n_prob"), F.sum(prob).alias("sum_prob")]
    edges = flows.groupBy(*EDGE).agg(*aggregates, *(extra or []))
    # A pair has at most one row per sensor here, so this window never meets a large group.
    everywhere = F.sum("w_sensor").over(Window.partitionBy(*PAIR))
    return edges.withColumn("w_global", everywhere).filter(F.col("SensorId").isNotNull())


def endpoint_totals(pairs: DataFrame, end: str, name: str) -> DataFrame:
    """Sum over the flow rows of an address of their pair weight: the sum of squared weights.

    Squares outgrow a long at 3e9 flows of a pair, so the sum is a double: exact up to 2**53.
    """
    return pairs.groupBy(end).agg(
        F.sum(F.col("EdgeWeight").cast("double") * F.col("EdgeWeight")).alias(name),
        F.count("*").alias(f"{end}_pairs"),
    )


def weighted_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs with the totals of both their ends, so that flows need one join instead of three."""
    sources = store(endpoint_totals(pairs, "SrcAddr", "SrcTotalWeight"), "source-totals")
    targets = store(endpoint_totals(pairs, "DstAddr", "DstTotalWeight"), "target-totals")
    with_source = attach(pairs, sources, ["SrcAddr"], "SrcAddr_pairs")
    with_both = attach(with_source, targets, ["DstAddr"], "DstAddr_pairs")
    return with_both.select(*PAIR, "EdgeWeight", "SrcTotalWeight", "DstTotalWeight")


def stored_pairs(flows: DataFrame) -> Stored:
    return store(weighted_pairs(store(pair_weights(flows), "pairs").table), "weighted-pairs")


def flow_weights(flows: DataFrame, pairs: Stored | None = None) -> DataFrame:
    """Flows with ``EdgeWeight``, ``SrcTotalWeight`` and ``DstTotalWeight``."""
    joined = attach(flows, pairs or stored_pairs(flows), PAIR, "EdgeWeight")
    return joined.fillna({"EdgeWeight": 1, "SrcTotalWeight": 0.0, "DstTotalWeight": 0.0})
