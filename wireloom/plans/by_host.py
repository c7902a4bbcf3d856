"""Detection from node classification instead of flow classification."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wireloom.operators import hosts, weights
from wireloom.operators.features import flow_features
from wireloom.operators.subgraph import graph_degree
from wireloom.plans.detect import Detection, detect_on_edges
from wireloom.schema import PLAIN_FEATURES
from wireloom.session import Stored, store


@dataclass(frozen=True)
class HostGraph:
    """Edges with feature sums, node features with labels, and node degrees."""

    edges: Stored
    nodes: Stored
    degrees: Stored


def feature_edges(flows: DataFrame, features: list[str] = PLAIN_FEATURES) -> DataFrame:
    """The edge table with the sums behind the node features, from one pass over the flows."""
    return weights.sensor_edges(flow_features(flows), extra=hosts.feature_sums(features))


def pairs_of(edges: DataFrame) -> DataFrame:
    """Pair weights over all sensors, from the edge table."""
    return edges.groupBy("SrcAddr", "DstAddr").agg(F.max("w_global").alias("EdgeWeight"))


def host_graph(flows: DataFrame) -> HostGraph:
    edges = store(feature_edges(flows), "feature-edges")
    totals = weights.weighted_pairs(store(pairs_of(edges.table), "pairs").table)
    nodes = store(hosts.node_features(edges.table, totals), "node-features")
    return HostGraph(edges, nodes, store(graph_degree(edges.table), "degrees"))


def feature_names(graph: HostGraph) -> list[str]:
    return [c for c in graph.nodes.table.columns if c not in ("SensorId", "node", "label_cnc")]


def node_scores(graph: HostGraph, kind: str = "mlp", rounds: int = 20) -> DataFrame:
    """``PredictedProb_Node`` per sensor and node."""
    names = feature_names(graph)
    wide = hosts.with_hops(graph.edges.table, graph.nodes, names, graph.degrees.table)
    ready = store(wide, "hop-features").table
    return hosts.HostClassifier(names, kind, rounds=rounds).fit(ready).transform(ready)


def detect_by_host(flows: DataFrame, kind: str = "mlp", rounds: int = 20, use_ground_truth: bool = True) -> Detection:
    """Every flow of an edge has the edge's probability, so the flows are not read again."""
    graph = host_graph(flows)
    scores = store(node_scores(graph, kind, rounds), "node-scores")
    scored = hosts.edge_probability(graph.edges.table, scores, graph.degrees.table)
    edges = scored.select(
        "SensorId", "SrcAddr", "DstAddr", "w_sensor", "w_global", "label_cnc",
        F.col("w_sensor").alias("n_prob"),
        (F.col("PredictedProb") * F.col("w_sensor")).alias("sum_prob"),
    )
    return detect_on_edges(store(edges, "edges"), use_ground_truth)
