"""Per-sensor node statistics and scores, built from the edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wireloom.functions import scores
from wireloom.operators.lookup import attach
from wireloom.schema import NODE
from wireloom.session import Stored


def node_stats(edges: DataFrame) -> DataFrame:
    """One row per sensor and address, in either role.

    Each edge gives a row to both its ends and one aggregate does what would otherwise be an outer
    join and four left joins. ``label_cnc`` marks destinations of controller traffic.
    """
    weight = F.col("w_sensor").cast("double") * F.col("w_global")  # outgrows a long
    none, nothing, one = F.lit(0).cast("bigint"), F.lit(0.0), F.lit(1).cast("bigint")
    outgoing = F.struct(
        F.col("SrcAddr").alias("node"),
        none.alias("in_ct"), nothing.alias("in_sum"), none.alias("in_unique_srcs"),
        nothing.alias("dst_total_weight"), F.lit(0).alias("label_cnc"),
        F.col("n_prob").alias("out_ct"), F.col("sum_prob").alias("out_sum"),
        one.alias("out_unique_dests"), weight.alias("src_total_weight"),
    )
    incoming = F.struct(
        F.col("DstAddr").alias("node"),
        F.col("n_prob").alias("in_ct"), F.col("sum_prob").alias("in_sum"), one.alias("in_unique_srcs"),
        weight.alias("dst_total_weight"), F.col("label_cnc"),
        none.alias("out_ct"), nothing.alias("out_sum"),
        none.alias("out_unique_dests"), nothing.alias("src_total_weight"),
    )
    summed = [
        "in_ct", "in_sum", "out_ct", "out_sum", "out_unique_dests", "in_unique_srcs",
        "src_total_weight", "dst_total_weight",
    ]
    ends = edges.select("SensorId", F.inline(F.array(outgoing, incoming)))
    totals = ends.groupBy(*NODE).agg(
        *[F.sum(c).alias(c) for c in summed], F.max("label_cnc").alias("label_cnc")
    )

    def mean(side: str):
        return F.coalesce(F.try_divide(F.col(f"{side}_sum"), F.col(f"{side}_ct")), F.lit(0.0))

    return totals.select(
        *NODE,
        "in_ct", mean("in").alias("in_prob"), "out_ct", mean("out").alias("out_prob"),
        "out_unique_dests", "in_unique_srcs", "src_total_weight", "dst_total_weight",
        (F.coalesce(F.col("label_cnc"), F.lit(0)) == 1).alias("label_cnc"),
    )


def with_degree(nodes: DataFrame) -> DataFrame:
    degree = F.col("in_ct") + F.col("out_ct")
    return nodes.withColumn("degree", degree).withColumns(
        {
            "in_ratio": scores.share(F.col("in_ct"), F.col("degree")),
            "out_ratio": scores.share(F.col("out_ct"), F.col("degree")),
        }
    )


def sensor_weights(nodes: DataFrame) -> DataFrame:
    """How each sensor weighs outgoing against incoming probability, over all its nodes."""
    means = nodes.groupBy("SensorId").agg(
        F.count("*").alias("n_nodes"), F.avg("out_prob").alias("mal_out"), F.avg("in_prob").alias("mal_in")
    )
    w_out = scores.outward_weight(F.col("mal_out"), F.col("mal_in"))
    return means.select("SensorId", "n_nodes", w_out.alias("w_out"), (F.lit(1.0) - w_out).alias("w_in"))


def score_nodes(nodes: DataFrame, sensors: Stored) -> DataFrame:
    """Nodes with ``cnc_prob`` and ``cnc_score``."""
    weighed = attach(with_degree(nodes), sensors, ["SensorId"], "n_nodes", how="inner")
    probability = F.col("out_prob") * F.col("w_out") + F.col("in_prob") * F.col("w_in")
    scored = weighed.withColumn("cnc_prob", probability)
    return scored.withColumn("cnc_score", scores.cnc_score(F.col("cnc_prob"))).drop("w_out", "w_in", "n_nodes")


def fixed_rule(nodes: DataFrame) -> DataFrame:
    """The older rule and score, with fixed cut-offs and no sensor adaptation."""
    # Cut-offs of the older rule.
    min_prob, min_degree, min_out_ratio = 0.70, 110, 0.70
    rated = with_degree(nodes).withColumn("avg_prob", (F.col("in_prob") + F.col("out_prob")) / 2)
    flagged = (
        (F.col("avg_prob") > min_prob)
        & (F.col("degree") > min_degree)
        & (F.col("out_ratio") > min_out_ratio)
    )
    return rated.withColumns(
        {
            "Role": F.when(flagged, "C&C").otherwise("Normal"),
            "cnc_score": scores.simple_score(F.col("avg_prob")),
        }
    )
