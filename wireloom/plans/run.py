"""The complete runs: ingest raw text, then detect and write.

Each run reads flows, finds controllers and writes what it found under ``output``, in folders whose names end in the run's
id: node scores, flagged nodes, the summary and the subgraph around flagged nodes, for each sensor.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.ml import Estimator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wireloom.operators import nodes as node_rules
from wireloom.operators import stacking, weights
from wireloom.operators.clean import require_rows
from wireloom.operators.sample import SEED
from wireloom.operators.stacking import Learner
from wireloom.operators.subgraph import MAX_EDGES, MAX_NODES, Subgraph, flag_subgraph
from wireloom.plans import by_host
from wireloom.plans.classify import Classified, classify
from wireloom.plans.detect import Detection, detect, prepare
from wireloom.schema import PLAIN_FEATURES
from wireloom.session import store
from wireloom.sources import files, sinks


def ingest(spark: SparkSession, source: str, target: str, report: str | None = None) -> DataFrame:
    """Raw text to a clean Parquet dataset; returns its schema report.

    With ``report``, a path, what became of the raw rows is written there: unparsable cells and rows lost to each filter.
    """
    if report is not None:
        files.ingest_report(files.read_raw(spark, source)).coalesce(1).write.option("header", True).csv(report)
    return files.describe_schema(files.convert_flows(spark, source, target))


def _flows(spark: SparkSession, source: str, fmt: str, sensors: list[int] | None) -> DataFrame:
    return require_rows(prepare(files.read_flows(spark, source, fmt), sensors))


def _write_model(classified: Classified, kind: str, output: str, run_id: str, save_model: bool) -> None:
    sinks.write_split(classified.split, output, run_id)
    sinks.append_metrics(classified.metrics, kind, f"{output}/metrics")
    if save_model:
        classified.model.save(f"{output}/model_{run_id}")


def _write_detection(found: Detection, graph: Subgraph, output: str, run_id: str) -> None:
    sinks.write_node_scores(found.nodes, output, run_id)
    sinks.write_flagged(found.nodes, output, run_id)
    sinks.write_summary(found.summary(), output, run_id)
    sinks.write_subgraph(graph, output, run_id)


def run(
    spark: SparkSession,
    source: str,
    output: str,
    fmt: str = "parquet",
    sensors: list[int] | None = None,
    bases: dict[str, Learner] | None = None,
    run_id: str | None = None,
    model: str = "stack",
    forest: Estimator | None = None,
    fallback: bool = False,
    max_rows: int | None = None,
    trim_dir: bool = False,
    use_ground_truth: bool = True,
    max_nodes: int = MAX_NODES,
    max_edges: int = MAX_EDGES,
    save_model: bool = False,
) -> Detection:
    """Train on the flows, score them, flag nodes; also writes the split, the metrics and, if asked for, the model.

    ``max_rows`` bounds the labelled flows that are learned from; all are scored.
    """
    run_id = run_id or sinks.new_run_id()
    flows = _flows(spark, source, fmt, sensors)
    classified = classify(
        flows, bases=bases, model=model, forest=forest, fallback=fallback, max_rows=max_rows, trim_dir=trim_dir
    )
    _write_model(classified, model, output, run_id, save_model)
    found = detect(classified.flows, "PredictedProb", use_ground_truth)
    found = replace(found, nodes=store(found.nodes, "nodes").table)
    _write_detection(found, found.subgraph(max_nodes, max_edges), output, run_id)
    return found


def run_simple(
    spark: SparkSession,
    source: str,
    output: str,
    fmt: str = "parquet",
    sensors: list[int] | None = None,
    bases: dict[str, Learner] | None = None,
    run_id: str | None = None,
    fallback: bool = True,
    max_rows: int | None = None,
    max_nodes: int = MAX_NODES,
    max_edges: int = MAX_EDGES,
    save_model: bool = False,
) -> DataFrame:
    """The older run: no weights among the features, boosting without early stop, the fixed rule, and a random subgraph.

    Returns all nodes with their score, ``Role`` and ``flagged``.
    """
    run_id = run_id or sinks.new_run_id()
    flows = _flows(spark, source, fmt, sensors)
    learners = bases or stacking.base_learners(early_stop=False)
    classified = classify(flows, PLAIN_FEATURES, bases=learners, fallback=fallback, max_rows=max_rows)
    _write_model(classified, "stack", output, run_id, save_model)
    edges = store(weights.sensor_edges(classified.flows, "PredictedProb"), "edges").table
    rated = node_rules.fixed_rule(node_rules.node_stats(edges)).withColumn("flagged", F.col("Role") == "C&C")
    nodes = store(rated, "nodes").table
    sinks.write_node_scores(nodes, output, run_id)
    sinks.write_flagged(nodes, output, run_id)
    sinks.write_subgraph(flag_subgraph(edges, nodes, max_nodes, max_edges, random_seed=SEED), output, run_id)
    return nodes


def run_by_host(
    spark: SparkSession,
    source: str,
    output: str,
    fmt: str = "parquet",
    sensors: list[int] | None = None,
    run_id: str | None = None,
    kind: str = "mlp",
    rounds: int = 20,
    use_ground_truth: bool = True,
    max_nodes: int = MAX_NODES,
    max_edges: int = MAX_EDGES,
) -> Detection:
    """Classify hosts by the flows of their neighbourhood, then flag nodes by the probabilities of their edges."""
    run_id = run_id or sinks.new_run_id()
    found = by_host.detect_by_host(_flows(spark, source, fmt, sensors), kind, rounds, use_ground_truth)
    found = replace(found, nodes=store(found.nodes, "nodes").table)
    _write_detection(found, found.subgraph(max_nodes, max_edges), output, run_id)
    return found
