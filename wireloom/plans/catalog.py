"""The registered queries: each runs one operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wireloom.functions.ratios import direction_code, ratio_columns
from wireloom.operators import (
    clean, evaluate, features, hosts, nodes, ranks, rules, sample, sketches, stacking, subgraph, weights,
)
from wireloom.operators.edge_state import EdgeState
from wireloom.operators.lookup import attach
from wireloom.plans import by_host, classify
from wireloom.plans.detect import detect, detect_simple, prepare, scored_nodes
from wireloom.schema import EDGE, FEATURES, FLOW, NODE, SCAN_COLUMNS, WEIGHT_FEATURES
from wireloom.session import Stored, scratch_path, store
from wireloom.sources import files, sinks
from wireloom.sources.order_flows import STAND_IN_PROB, order_flows

Query = Callable[[SparkSession, str], DataFrame]
_registry: dict[str, Query] = {}


def query(function: Query) -> Query:
    _registry[function.__name__] = function
    return function


def queries() -> dict[str, Query]:
    return dict(_registry)


def prepared(spark: SparkSession, folder: str) -> DataFrame:
    """Prepared flows with the stand-in probability."""
    return prepare(order_flows(spark, folder)).withColumn("prob", F.expr(STAND_IN_PROB))


def stored_flows(spark: SparkSession, folder: str) -> DataFrame:
    """The scanned columns of the prepared flows written once, for operators that read them repeatedly."""
    return store(prepared(spark, folder).select(*SCAN_COLUMNS, "LabelCNC", "prob"), "flows").table


def edges_of(spark: SparkSession, folder: str) -> Stored:
    return store(weights.sensor_edges(prepared(spark, folder), "prob"), "edges")


def six(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def raw_text(spark: SparkSession, folder: str, own: list[str] = ()) -> DataFrame:
    """All-text flows in which some rows repeat the header and some have no first column; the ``own`` values beside them."""
    header, headless = F.col("Sport") % 50 == 0, F.col("Sport") % 50 == 7
    cells = [F.when(header, F.lit(c)).otherwise(F.col(c).cast("string")).alias(c) for c in FLOW.names]
    kept = [F.col(c).alias(f"own_{c}") for c in own]
    texts = order_flows(spark, folder).select(*cells, *kept, headless.alias("headless"))
    return texts.withColumn("StartTime", F.when(~F.col("headless"), F.col("StartTime"))).drop("headless")


def raw_file(spark: SparkSession, folder: str) -> str:
    """The text flows as a CSV dataset with header, padded arrows and all."""
    path = scratch_path(spark, "raw")
    raw_text(spark, folder).write.options(**files.CSV_TEXT).csv(path)
    return path


# Sources and filters


@query
def flows_valid(spark, folder):
    return clean.valid_flows(order_flows(spark, folder)).select(SCAN_COLUMNS)


@query
def flows_one_sensor(spark, folder):
    return clean.valid_flows(order_flows(spark, folder), sensors=[3]).select(SCAN_COLUMNS)


@query
def complete_flows(spark, folder):
    flows = order_flows(spark, folder)
    gaps = flows.withColumns(
        {
            "Proto": F.nullif("Proto", F.lit("icmp")),
            "Dur": F.when(F.col("TotPkts") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("Dur")),
        }
    )
    return clean.drop_incomplete(gaps).select(SCAN_COLUMNS)


@query
def repeated_headers(spark, folder):
    kept = clean.drop_repeated_headers(raw_text(spark, folder))
    return kept.select("StartTime", "SrcAddr", "DstAddr", "Sport")


@query
def header_report(spark, folder):
    return files.clean_report(raw_text(spark, folder))


@query
def header_lines(spark, folder):
    path = scratch_path(spark, "lines")
    cells = [F.coalesce(F.col(c), F.lit("")) for c in FLOW.names]
    raw_text(spark, folder).select(F.concat_ws(",", *cells).alias("value")).write.text(path)
    return files.count_header_lines(spark, path)


@query
def header_line_numbers(spark, folder):
    """Where the header lines stand in three texts, one for each sensor, whose lines are ordered by source port.

    A sensor's text is a folder of parts that follow each other: ranges of lines, so that no task writes a whole sensor.
    """
    path = scratch_path(spark, "lines")
    cells = [F.coalesce(F.col(c), F.lit("")) for c in FLOW.names]
    lines = raw_text(spark, folder, ["SensorId", "Sport"]).select(
        "own_SensorId", "own_Sport", F.concat_ws(",", *cells).alias("value")
    )
    order = ["own_SensorId", "own_Sport", "value"]
    ordered = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.select("value", "own_SensorId").write.partitionBy("own_SensorId").text(path)
    sensor = F.regexp_extract("file", "own_SensorId=([0-9]+)", 1).cast("bigint").alias("SensorId")
    return files.header_lines(spark, path, in_parts=True).select(sensor, "line")


@query
def ingest_report(spark, folder):
    """Some cells of the raw text don't parse."""
    spoilt = {
        "SrcBytes": F.when(F.col("own_Sport") % 11 == 3, F.lit("x")).otherwise(F.col("SrcBytes")),
        "TotBytes": F.when(F.col("own_Sport") % 13 == 4, F.lit("12,5")).otherwise(F.col("TotBytes")),
        "StartTime": F.when((F.col("own_Sport") % 17 == 5) & (F.col("own_Sport") % 50 != 0), F.lit("yesterday")).otherwise(F.col("StartTime")),
    }
    raw = raw_text(spark, folder, ["Sport"]).withColumns(spoilt).drop("own_Sport")
    return files.ingest_report(raw)


@query
def converted_flows(spark, folder):
    target = scratch_path(spark, "converted")
    return files.convert_flows(spark, raw_file(spark, folder), target)


@query
def converted_shape(spark, folder):
    target = scratch_path(spark, "converted")
    converted = files.convert_flows(spark, raw_file(spark, folder), target, fmt="csv")
    return files.frame_shape(converted)


@query
def schema_table(spark, folder):
    path = scratch_path(spark, "typed")
    order_flows(spark, folder).write.option("header", True).csv(path)
    return files.infer_schema(spark, path)


@query
def type_report(spark, folder):
    """Types of a text file with some cells that don't fit their column."""
    path = scratch_path(spark, "dirty")
    odd = F.col("Sport") % 9 == 4
    cells = {
        "Sport": F.when(odd, F.concat(F.col("Sport").cast("string"), F.lit(".5"))).otherwise(F.col("Sport").cast("string")),
        "SrcBytes": F.when(odd, F.lit("many")).otherwise(F.col("SrcBytes").cast("string")),
        "StartTime": F.when(odd, F.lit("2001-02-30 00:00:00")).otherwise(F.date_format("StartTime", "yyyy-MM-dd HH:mm:ss")),
        "ActivityLabel": F.when(F.col("ActivityLabel") == 1, F.lit("TRUE")).otherwise(F.lit("false")),
        "BotnetName": F.lit(None).cast("string"),
    }
    order_flows(spark, folder).withColumns(cells).write.options(**files.CSV_TEXT).csv(path)
    return files.type_report(files.read_raw(spark, path))


@query
def bot_flow_count(spark, folder):
    return clean.count_bot_flows(order_flows(spark, folder), sensor=2)


# Labels


@query
def cnc_labels(spark, folder):
    flags = ["LabelFromBotnet", "LabelToBotnet", "LabelBotnet", "LabelCNC"]
    return prepared(spark, folder).select(*EDGE, *flags)


@query
def binary_label(spark, folder):
    return prepared(spark, folder).select(*EDGE, "TotBytes", "Label")


@query
def label_counts(spark, folder):
    flows = prepared(spark, folder)
    counted = [
        clean.label_counts(flows, c).select(F.lit(c).alias("column"), F.col(c).alias("value"), "flows") for c in ("Label", "LabelCNC")
    ]
    return counted[0].unionByName(counted[1])


@query
def flow_summary(spark, folder):
    return clean.flow_summary(prepared(spark, folder))


# Features


@query
def dir_code(spark, folder):
    flows = prepared(spark, folder)
    return flows.groupBy("Dir").agg(F.count("*").alias("flows")).select(
        F.col("Dir").alias("Dir_raw"), direction_code(F.col("Dir")).alias("code"),
        direction_code(F.col("Dir"), trim=True).alias("trimmed_code"), "flows",
    )


@query
def proto_codes(spark, folder):
    return ranks.ordinal_codes(prepared(spark, folder), ["Proto", "State"])


@query
def ratio_features(spark, folder):
    computed = ratio_columns()
    return prepared(spark, folder).withColumns(computed).select(*EDGE, *computed)


@query
def matrix_clean(spark, folder):
    rows = classify.feature_rows(stored_flows(spark, folder))
    return classify.model_rows(rows, FEATURES)


@query
def feature_vector(spark, folder):
    """Count and maximum at every position of the assembled vector."""
    rows = classify.model_rows(classify.feature_rows(stored_flows(spark, folder)), FEATURES)
    vectors = features.assemble(rows, FEATURES).select(F.posexplode(vector_to_array("features")).alias("pos", "value"))
    return vectors.groupBy("pos").agg(F.count("*").alias("flows"), F.max("value").alias("max_value"))


@query
def scaled_features(spark, folder):
    """Rounded to four digits: sums of inexact ratios depend on their order."""
    rows = classify.model_rows(classify.feature_rows(stored_flows(spark, folder)), FEATURES)
    kept = store(rows.select(FEATURES), "unscaled").table
    scaled = features.Standardizer.fit(kept, FEATURES).transform(kept)
    return scaled.select(*[F.round(f, 4).alias(f) for f in FEATURES])


# Weights and node statistics


@query
def edge_weights(spark, folder):
    return weights.pair_weights(prepared(spark, folder))


@query
def flow_weights(spark, folder):
    return weights.flow_weights(stored_flows(spark, folder)).select(
        *EDGE, "TotBytes", "EdgeWeight", "SrcTotalWeight", "DstTotalWeight"
    )


@query
def flow_weights_split(spark, folder):
    """flow_weights as with pairs too many to broadcast: only the fifty heaviest are."""
    flows = stored_flows(spark, folder)
    pairs = weights.stored_pairs(flows)
    joined = attach(flows, pairs, ["SrcAddr", "DstAddr"], "EdgeWeight", broadcast_cells=0, heavy_keys=50)
    return joined.select(*EDGE, "TotBytes", "EdgeWeight", "SrcTotalWeight", "DstTotalWeight")


@query
def sensor_edges(spark, folder):
    edges = weights.sensor_edges(prepared(spark, folder), "prob")
    return edges.select(
        *EDGE, "w_sensor", "w_global", (F.col("w_sensor").cast("double") * F.col("w_global")).alias("edge_weight_sum"), "sum_prob"
    )


def _stats(spark, folder):
    return nodes.node_stats(weights.sensor_edges(prepared(spark, folder), "prob"))


@query
def node_in_out(spark, folder):
    return _stats(spark, folder).select(*NODE, "in_ct", "in_prob", "out_ct", "out_prob")


@query
def node_unique_peers(spark, folder):
    return _stats(spark, folder).select(*NODE, "out_unique_dests", "in_unique_srcs")


@query
def node_weights(spark, folder):
    return _stats(spark, folder).select(*NODE, "src_total_weight", "dst_total_weight")


@query
def sensor_weights(spark, folder):
    found = nodes.sensor_weights(_stats(spark, folder))
    return found.select("SensorId", "n_nodes", *six("w_out", "w_in"))


@query
def node_scores(spark, folder):
    scored, _ = scored_nodes(edges_of(spark, folder).table)
    return scored.select(*NODE, "degree", *six("in_ratio", "out_ratio", "cnc_prob", "cnc_score"))


@query
def fixed_rule(spark, folder):
    found = detect_simple(prepared(spark, folder), "prob")
    return found.select(*NODE, *six("avg_prob", "in_ratio", "out_ratio"), "degree", "Role")


@query
def node_scores_simple(spark, folder):
    found = detect_simple(prepared(spark, folder), "prob").filter("Role = 'C&C'")
    return found.select(*NODE, *six("cnc_score"))


@query
def strict_threshold(spark, folder):
    scored, _ = scored_nodes(edges_of(spark, folder).table)
    return rules.strict_thresholds(scored).select("SensorId", *six("strict_thr"))


@query
def score_cutoff(spark, folder):
    scored, sensors = scored_nodes(edges_of(spark, folder).table)
    return rules.score_cutoffs(scored, sensors).select("SensorId", *six("p95"))


@query
def node_rules(spark, folder):
    found = detect(prepared(spark, folder), "prob").nodes
    return found.select(*NODE, "strict", "percentile", "label_cnc", "flagged", "Role")


@query
def node_reasons(spark, folder):
    return detect(prepared(spark, folder), "prob").nodes.select(*NODE, "Role", "Reason")


@query
def no_ground_truth(spark, folder):
    found = detect(prepared(spark, folder), "prob", use_ground_truth=False).nodes
    return found.select(*NODE, "Role")


@query
def detection_summary(spark, folder):
    counts = ["n_strict", "n_percentile", "n_truth", "n_flagged"]
    found = detect(prepared(spark, folder), "prob").summary()
    return found.select("SensorId", *six("w_out", "w_in", "strict_thr", "p95"), *counts)


@query
def flagged_nodes(spark, folder):
    found = detect(prepared(spark, folder), "prob").flagged()
    return found.select(*NODE, "in_ct", "out_ct", *six("cnc_prob", "cnc_score"), "Role")


@query
def top5_nodes(spark, folder):
    scored, _ = scored_nodes(edges_of(spark, folder).table)
    best = ranks.top_k(scored, "SensorId", [F.desc("cnc_score"), F.col("node")], 5)
    return best.select(*NODE, "rank", *six("cnc_score"))


@query
def top5_flagged(spark, folder):
    flagged = detect(prepared(spark, folder), "prob").flagged()
    best = ranks.top_k(flagged, "SensorId", [F.desc("cnc_score"), F.col("node")], 5)
    return best.select(*NODE, "rank", *six("cnc_score"))


# Mergeable summaries


@query
def edge_state(spark, folder):
    """Flows that come in three runs, one of them twice, and the edges that are then known."""
    flows = stored_flows(spark, folder)
    state = EdgeState(spark, scratch_path(spark, "edge-state"))
    for run in (0, 1, 1, 2):
        state.add(flows.filter(F.pmod(F.col("TotBytes"), F.lit(3)) == run), f"day{run}", "prob")
    return state.compact(scratch_path(spark, "edge-state")).edges().select(*EDGE, "w_sensor", "w_global", "n_prob", "sum_prob")


@query
def peer_estimates(spark, folder):
    """Distinct peers from the sketches of two days."""
    flows = stored_flows(spark, folder)
    days = [sketches.peer_sketches(flows.filter(F.pmod(F.col("TotBytes"), F.lit(2)) == d)) for d in (0, 1)]
    kept = store(days[0].unionByName(days[1]), "peer-sketches").table
    found = sketches.peer_estimates(sketches.merged_peers(kept))
    return found.select(*NODE, *[F.round(c).cast("bigint").alias(c) for c in ("out_unique_dests", "in_unique_srcs")])


@query
def approximate_cutoffs(spark, folder):
    """Whether each sensor's cut-off, from the sketches of two halves of its nodes, stands within the stated rank error."""
    scored = store(scored_nodes(edges_of(spark, folder).table)[0].select(*NODE, "cnc_score"), "scores").table
    half = F.pmod(F.crc32("node"), F.lit(2))
    parts = [sketches.score_sketches(scored.filter(half == h)) for h in (0, 1)]
    kept = store(parts[0].unionByName(parts[1]), "score-sketches").table
    cutoffs = sketches.approximate_cutoffs(sketches.merged_scores(kept))
    low, high = sketches.quantile_rank_band(sketches.QUANTILE_K, 0.95)
    ranked = scored.join(F.broadcast(cutoffs), "SensorId")  # a row for each sensor
    counts = ranked.groupBy("SensorId").agg(
        F.count("*").alias("nodes"), F.avg((F.col("cnc_score") < F.col("p95")).cast("int")).alias("below"),
        F.avg((F.col("cnc_score") <= F.col("p95")).cast("int")).alias("upto"),
    )
    return counts.select("SensorId", "nodes", ((F.col("below") <= high) & (F.col("upto") >= low)).alias("within"))


@query
def score_histogram(spark, folder):
    flows = stored_flows(spark, folder)
    days = [sketches.score_histogram(flows.filter(F.pmod(F.col("TotBytes"), F.lit(2)) == d), "Label", "prob") for d in (0, 1)]
    return sketches.merged_histograms(days[0].unionByName(days[1]))


@query
def quality_bounds(spark, folder):
    """Bounds from forty bins."""
    histogram = sketches.score_histogram(prepared(spark, folder), "Label", "prob", 40)
    names = ["auc_low", "auc_high", "balance_low", "balance_high", "threshold"]
    return sketches.quality_bounds(histogram, 40).select(*six(*names))


# Graph


@query
def vertices(spark, folder):
    return subgraph.vertices(weights.sensor_edges(prepared(spark, folder)))


@query
def graph_degree(spark, folder):
    return subgraph.graph_degree(weights.sensor_edges(prepared(spark, folder)))


@query
def neighbours(spark, folder):
    found = detect(prepared(spark, folder), "prob")
    flagged = store(found.flagged().select(*NODE), "flagged")
    degrees = store(subgraph.graph_degree(found.edges.table), "degrees").table
    return subgraph.neighbours(subgraph.mark_ends(found.edges.table, flagged, degrees, "flagged"))


@query
def subgraph_nodes(spark, folder):
    return detect(prepared(spark, folder), "prob").subgraph().nodes.select(
        *NODE, "tier", "graph_degree", *six("cnc_score")
    )


@query
def subgraph_edges(spark, folder):
    return detect(prepared(spark, folder), "prob").subgraph().edges


@query
def tight_subgraph_nodes(spark, folder):
    found = detect(prepared(spark, folder), "prob").subgraph(max_nodes=100, max_edges=200)
    return found.nodes.select(*NODE, "tier", "graph_degree")


@query
def tight_subgraph_edges(spark, folder):
    return detect(prepared(spark, folder), "prob").subgraph(max_nodes=100, max_edges=200).edges


@query
def random_subgraph(spark, folder):
    flows = prepared(spark, folder)
    edges = store(weights.sensor_edges(flows, "prob"), "edges").table
    rated = nodes.fixed_rule(nodes.node_stats(edges)).withColumn("flagged", F.col("Role") == "C&C")
    return subgraph.flag_subgraph(edges, rated, max_nodes=200, max_edges=400, random_seed=sample.SEED).edges


# Node classification


def single(names: list[str]) -> list:
    """To single precision: sums of inexact numbers depend on their order in the last digits of a double."""
    return [F.col(n).cast("float").cast("double").alias(n) for n in names]


@query
def node_features(spark, folder):
    graph = by_host.host_graph(stored_flows(spark, folder))
    names = by_host.feature_names(graph)
    counts = [n for n in names if n.endswith("_count")]
    return graph.nodes.table.select(*NODE, *counts, *single([n for n in names if n not in counts]))


@query
def node_labels(spark, folder):
    return hosts.node_labels(weights.sensor_edges(prepared(spark, folder)))


@query
def neighbour_mean(spark, folder):
    graph = by_host.host_graph(stored_flows(spark, folder))
    names = by_host.feature_names(graph)
    means = hosts.neighbour_mean(graph.edges.table, graph.nodes, names, graph.degrees.table)
    return means.select(*NODE, *single(names))


@query
def two_hop_mean(spark, folder):
    graph = by_host.host_graph(stored_flows(spark, folder))
    names = by_host.feature_names(graph)
    wide = hosts.with_hops(graph.edges.table, graph.nodes, names, graph.degrees.table)
    return wide.select(*NODE, *single([f"hop{h}_{n}" for h in (1, 2) for n in names]))


@query
def score_join_back(spark, folder):
    flows = stored_flows(spark, folder)
    edges = store(weights.sensor_edges(flows, "prob"), "edges")
    degrees = store(subgraph.graph_degree(edges.table), "degrees").table
    stats = nodes.node_stats(edges.table)
    given = stats.filter("in_ct > 5").select(*NODE, F.col("in_prob").alias("PredictedProb_Node"))
    scored = hosts.edge_probability(edges.table, store(given, "given-scores"), degrees)
    found = hosts.flow_probability(flows, store(scored, "scored-edges"))
    return found.select(*EDGE, "TotBytes", *six("PredictedProb"), "PredictedLabel")


@query
def node_classifier(spark, folder):
    graph = by_host.host_graph(stored_flows(spark, folder))
    return by_host.node_scores(graph, kind="mlp", rounds=20)


@query
def host_check(spark, folder):
    """Per sensor: the nodes that a host classifier scores, and those without a proper probability."""
    graph = by_host.host_graph(stored_flows(spark, folder))
    probability = F.col("PredictedProb_Node")
    bad = F.count_if(probability.isNull() | ~probability.between(0, 1)).alias("bad")
    return by_host.node_scores(graph, kind="logistic").groupBy("SensorId").agg(F.count("*").alias("nodes"), bad)


@query
def detect_by_host(spark, folder):
    return by_host.detect_by_host(stored_flows(spark, folder), kind="logistic").summary()


# Split, classes and evaluation


@query
def class_weights(spark, folder):
    return sample.class_weights(prepared(spark, folder)).select("Label", *six("weight"))


@query
def split_counts(spark, folder):
    drawn = sample.with_draw(prepared(spark, folder).select("Label", "TotBytes"))
    return sample.split_rows(drawn).groupBy("Label", "split").agg(F.count("*").alias("flows"))


@query
def split_export(spark, folder):
    rows = classify.model_rows(classify.feature_rows(stored_flows(spark, folder)), FEATURES)
    drawn = sample.with_draw(rows.select("Label", *FEATURES))
    path = sinks.write_split(sample.split_rows(drawn), scratch_path(spark, "export"), sinks.new_run_id(), "parquet")
    return spark.read.parquet(path).groupBy("Label", "split").agg(F.count("*").alias("flows"))


def flow_text() -> Column:
    """All that a flow is made of as a text, without decimals, which systems write differently."""
    exact = [F.round(F.col("Dur") * 10_000).cast("bigint"), F.col("sTos").cast("bigint"), F.col("dTos").cast("bigint")]
    whole = [F.col(c) for c in ("SensorId", "SrcAddr", "DstAddr", "Proto", "Dir", "State", "TotBytes", "TotPkts", "SrcBytes", "Label", "LabelCNC")]
    return F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("-")) for c in [*whole, *exact]])


@query
def split(spark, folder):
    flows = stored_flows(spark, folder).withColumn("text", flow_text())
    rows = classify.model_rows(classify.feature_rows(flows), FEATURES, [*EDGE, "Label", "LabelCNC", "text"])
    return sample.split_rows(sample.with_draw(rows, text=F.col("text"))).drop("draw", "text")


@query
def sample_rows(spark, folder):
    rows = prepared(spark, folder).select(*EDGE, "TotBytes", "Label")
    drawn = sample.with_draw(rows, text=F.concat_ws("|", *rows.columns))
    return sample.sample_rows(drawn, drawn.rows // 4).drop("draw")


@query
def roc_points(spark, folder):
    curve = evaluate.roc_curve(prepared(spark, folder), "Label", "prob")
    return curve.select("threshold", "pos_upto", "neg_upto", *six("tpr", "fpr"))


@query
def best_threshold(spark, folder):
    curve = evaluate.roc_curve(prepared(spark, folder), "Label", "prob")
    return evaluate.best_threshold(curve).select("threshold", *six("balance"))


@query
def class_metrics(spark, folder):
    found = evaluate.class_metrics(prepared(spark, folder), "Label", "prob", 0.5)
    return found.select(*six("accuracy", "precision", "recall", "f1"))


@query
def roc_auc(spark, folder):
    curve = evaluate.roc_curve(prepared(spark, folder), "Label", "prob")
    return evaluate.roc_auc(curve).select(*six("roc_auc"))


@query
def node_roc_auc(spark, folder):
    edges = edges_of(spark, folder).table
    stats = nodes.node_stats(edges).drop("label_cnc").join(hosts.node_labels(edges), NODE)
    return evaluate.roc_auc(evaluate.roc_curve(stats, "label_cnc", "out_ct")).select(*six("roc_auc"))


def _regression(spark, folder):
    flows = prepared(spark, folder).withColumn("guess", F.col("prob") - 0.5)
    return evaluate.regression_metrics(flows.withColumn("actual", F.col("Label").cast("double")), "actual", "guess")


@query
def regression_metrics(spark, folder):
    return _regression(spark, folder).select(*six("MSE", "RMSE", "MAE", "R2"))


# Sinks


@query
def metrics_log(spark, folder):
    path = scratch_path(spark, "metrics")
    found = store(_regression(spark, folder), "metrics").table
    for model in ("first", "second"):
        sinks.append_metrics(found, model, path, fmt="parquet")
    return spark.read.parquet(path).select("Model", *six("MSE", "RMSE", "MAE", "R2"))


@query
def node_export(spark, folder):
    scored, _ = scored_nodes(edges_of(spark, folder).table)
    path = sinks.write_node_scores(scored, scratch_path(spark, "export"), sinks.new_run_id(), fmt="parquet")
    found = spark.read.parquet(path).withColumn("SensorId", F.col("SensorId").cast("bigint"))
    return found.select(*NODE, "in_ct", "out_ct", *six("cnc_score"))


@query
def export_order(spark, folder):
    """Whether every file of exported nodes is in falling order of their score."""
    scored, _ = scored_nodes(edges_of(spark, folder).table)
    path = sinks.write_node_scores(scored, scratch_path(spark, "export"), sinks.new_run_id(), fmt="parquet")
    lines = spark.read.parquet(path).select(
        F.col("SensorId").cast("bigint").alias("SensorId"), "cnc_score", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("line"),
    )
    before = F.lag("cnc_score").over(Window.partitionBy("file").orderBy("line"))  # a file is one task's rows
    falls = F.coalesce(F.col("before") >= F.col("cnc_score"), F.lit(True))
    checked = lines.withColumn("before", before)
    return checked.groupBy("SensorId").agg(F.count("*").alias("nodes"), F.bool_and(falls).alias("ordered"))


# Training


@query
def base_predict(spark, folder):
    """The probability each base learner gives every flow."""
    rows = classify.model_rows(classify.feature_rows(stored_flows(spark, folder)), FEATURES)
    drawn = sample.with_draw(rows)
    train = classify.training_rows(sample.split_rows(drawn).filter("split = 'train'"), FEATURES)
    fitted = stacking.fit_all(stacking.StackedClassifier().bases, train, [F.lit(True)])[0]
    scored = stacking.base_probabilities(features.assemble(drawn.table, FEATURES), fitted)
    return scored.select(*EDGE, "Label", "rf_prob", "et_prob", "hgb_prob")


@query
def stack_predict(spark, folder):
    found = classify.classify(stored_flows(spark, folder).drop("prob"))
    return found.flows


@query
def stack_check(spark, folder):
    """Per sensor: the scored flows and their bytes, bad probabilities, labels that disagree with the threshold, and whether
    the model separates the held-out classes."""
    found = classify.classify(stored_flows(spark, folder).drop("prob"))
    return _checked(found)


@query
def forest_check(spark, folder):
    """stack_check for the single forest."""
    return _checked(classify.classify(stored_flows(spark, folder).drop("prob"), model="rf"))


def _checked(found: classify.Classified) -> DataFrame:
    probability, label = F.col("PredictedProb"), F.col("PredictedLabel")
    auc = found.metrics.first()["roc_auc"]
    return found.flows.groupBy("SensorId").agg(
        F.count("*").alias("flows"), F.sum("TotBytes").alias("total_bytes"),
        F.count_if(probability.isNull() | ~probability.between(0, 1)).alias("bad"),
        F.count_if((probability >= found.threshold) != (label == 1)).alias("mislabelled"),
        F.lit(auc > 0.8).alias("separates"),
    )


@query
def forest_predict(spark, folder):
    """A single forest on all features."""
    found = classify.classify(stored_flows(spark, folder).drop("prob"), model="rf")
    return found.flows


@query
def stacked_detection(spark, folder):
    found = classify.classify(stored_flows(spark, folder).drop("prob"))
    return detect(found.flows, "PredictedProb").summary()
