"""Writing results. ``run_id`` keeps the outputs of different runs apart."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wireloom.operators.subgraph import Subgraph


def new_run_id() -> str:
    return datetime.now().strftime("%Y%m%d_%H%M%S")


def write_split(split: DataFrame, path: str, run_id: str, fmt: str = "csv") -> str:
    """Training and test rows as one dataset partitioned by ``split``."""
    target = f"{path}/split_{run_id}"
    _save(split.write.partitionBy("split"), target, fmt)
    return target


def write_node_scores(nodes: DataFrame, path: str, run_id: str, fmt: str = "csv", name: str = "node_scores") -> str:
    """Nodes, one folder per sensor, by falling score.

    Range partitioning spreads a large sensor over many files and keeps the files in score order; the
    address spreads nodes that share a score.
    """
    return _write_ordered(nodes, [F.col("SensorId"), F.desc("cnc_score"), F.col("node")], f"{path}/{name}_{run_id}", fmt)


def write_flagged(nodes: DataFrame, path: str, run_id: str, fmt: str = "csv") -> str:
    """The flagged nodes, as the node scores are written."""
    return write_node_scores(nodes.filter("flagged"), path, run_id, fmt, "flagged")


def write_summary(summary: DataFrame, path: str, run_id: str, fmt: str = "csv") -> str:
    """Limits and counts, a row for each sensor."""
    target = f"{path}/summary_{run_id}"
    _save(summary.repartitionByRange("SensorId").sortWithinPartitions("SensorId").write, target, fmt)
    return target


def write_subgraph(graph: Subgraph, path: str, run_id: str, fmt: str = "csv") -> tuple[str, str]:
    """Nodes by falling score and edges by falling weight, one folder per sensor."""
    nodes = write_node_scores(graph.nodes, path, run_id, fmt, "subgraph_nodes")
    order = [F.col("SensorId"), F.desc("weight"), F.col("src"), F.col("dst")]
    return nodes, _write_ordered(graph.edges, order, f"{path}/subgraph_edges_{run_id}", fmt)


def _write_ordered(rows: DataFrame, order: list[Column], target: str, fmt: str) -> str:
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    _save(ordered.write.partitionBy("SensorId"), target, fmt)
    return target


def append_metrics(metrics: DataFrame, model: str, path: str, fmt: str = "csv") -> str:
    """Append a row of metrics under the model's name."""
    named = metrics.select(F.lit(model).alias("Model"), "*")
    _save(named.coalesce(1).write.mode("append"), path, fmt)
    return path


def _save(writer, target: str, fmt: str) -> None:
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(target)
