"""From flows to flagged nodes, given a probability per flow."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from wireloom.operators import clean, nodes, rules, weights
from wireloom.operators.subgraph import MAX_EDGES, MAX_NODES, Subgraph, flag_subgraph
from wireloom.session import Stored, store


@dataclass(frozen=True)
class Detection:
    """``edges`` per sensor and pair, ``nodes`` with scores, flags and reasons, ``sensors`` with limits."""

    edges: Stored
    nodes: DataFrame
    sensors: Stored

    def summary(self) -> DataFrame:
        return rules.detection_summary(self.nodes, self.sensors.table)

    def flagged(self) -> DataFrame:
        return self.nodes.filter("flagged")

    def subgraph(self, max_nodes: int = MAX_NODES, max_edges: int = MAX_EDGES) -> Subgraph:
        return flag_subgraph(self.edges.table, self.nodes, max_nodes, max_edges)


def prepare(flows: DataFrame, sensors: list[int] | None = None) -> DataFrame:
    """Valid, complete, labelled flows. Filters come first, so that they reach the scan."""
    return clean.label_flows(clean.drop_incomplete(clean.valid_flows(flows, sensors)))


def scored_nodes(edges: DataFrame) -> tuple[DataFrame, Stored]:
    """Scored nodes and the sensor weights they were scored with."""
    stats = store(nodes.node_stats(edges), "node-stats")
    sensors = store(nodes.sensor_weights(stats.table), "sensor-weights")
    return nodes.score_nodes(stats.table, sensors), sensors


def detect(flows: DataFrame, prob: str, use_ground_truth: bool = True) -> Detection:
    """The flows are read once, into the edge table; everything after works on edges and nodes."""
    return detect_on_edges(store(weights.sensor_edges(flows, prob), "edges"), use_ground_truth)


def detect_on_edges(edges: Stored, use_ground_truth: bool = True) -> Detection:
    scored, sensors = scored_nodes(edges.table)
    limits = store(rules.sensor_limits(scored, sensors), "sensor-limits")
    return Detection(edges, rules.apply_rules(scored, limits, use_ground_truth), limits)


def detect_simple(flows: DataFrame, prob: str) -> DataFrame:
    """The older fixed rule, one row per node."""
    edges = weights.sensor_edges(flows, prob)
    return nodes.fixed_rule(nodes.node_stats(edges))
