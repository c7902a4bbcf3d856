"""Flagging nodes, with reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wireloom.operators.lookup import attach
from wireloom.operators.ranks import quantiles
from wireloom.session import Stored

# Cut-offs of the detection rules.
STRICT_FLOOR, STRICT_CEILING, STRICT_DEVIATIONS = 0.40, 0.95, 1.5
STRICT_MIN_OUT, STRICT_MIN_OUT_RATIO = 120, 0.70
PERCENTILE, PERCENTILE_MIN_PROB, PERCENTILE_MIN_OUT = 95, 0.40, 20
HIGH_OUT_RATIO, VERY_HIGH_OUT, HIGH_SRC_WEIGHT = 0.8, 200, 500


def strict_thresholds(scored: DataFrame) -> DataFrame:
    """Mean plus deviations of ``cnc_prob``, clamped; null where one node leaves it undefined.

    The null is kept explicitly: ``least`` and ``greatest`` would skip it and set a limit.
    """
    spread = scored.groupBy("SensorId").agg(
        F.avg("cnc_prob").alias("mean"), F.stddev_samp("cnc_prob").alias("std")
    )
    limit = F.col("mean") + F.lit(STRICT_DEVIATIONS) * F.col("std")
    clamped = F.greatest(F.lit(STRICT_FLOOR), F.least(F.lit(STRICT_CEILING), limit))
    return spread.select(
        "SensorId", F.when(F.col("std").isNotNull() & ~F.isnan("std"), clamped).alias("strict_thr")
    )


def score_cutoffs(scored: DataFrame, sensors: Stored) -> DataFrame:
    """The 95th percentile of ``cnc_score`` per sensor, at least 0."""
    cut = quantiles(scored, "SensorId", "cnc_score", PERCENTILE / 100, "p95", sensors, "n_nodes")
    return cut.withColumn("p95", F.greatest(F.lit(0.0), F.col("p95")))


def sensor_limits(scored: DataFrame, sensors: Stored) -> DataFrame:
    """All per-sensor scalars the rules need."""
    limits = strict_thresholds(scored).join(score_cutoffs(scored, sensors), "SensorId")
    return sensors.table.join(limits, "SensorId")


def apply_rules(scored: DataFrame, limits: Stored, use_ground_truth: bool = True) -> DataFrame:
    """Nodes with the three rule flags, ``Role`` and ``Reason``."""
    joined = attach(scored, limits, ["SensorId"], "n_nodes", how="inner")
    strict = (
        (F.col("cnc_prob") > F.col("strict_thr"))
        & (F.col("out_ct") > STRICT_MIN_OUT)
        & (F.col("out_ratio") > STRICT_MIN_OUT_RATIO)
    )
    percentile = (
        (F.col("cnc_score") >= F.col("p95"))
        & (F.col("cnc_prob") >= PERCENTILE_MIN_PROB)
        & (F.col("out_ct") >= PERCENTILE_MIN_OUT)
    )
    truth = F.col("label_cnc") if use_ground_truth else F.lit(False)
    flagged = joined.withColumns(
        {
            "strict": F.coalesce(strict, F.lit(False)),
            "percentile": F.coalesce(percentile, F.lit(False)),
            "label_cnc": truth,
        }
    ).withColumn("flagged", F.col("strict") | F.col("percentile") | F.col("label_cnc"))
    # The wording of the reasons.
    over_cut = F.format_string(f"score>=p{PERCENTILE} (>= %.4f)", F.col("p95"))
    reasons = F.concat_ws(
        ";",
        F.when(F.col("strict"), "strict_rule"),
        F.when(F.col("percentile"), over_cut),
        F.when(F.col("label_cnc"), "label_cnc"),
        F.when(F.col("out_ratio") > HIGH_OUT_RATIO, "high_out_ratio"),
        F.when(F.col("out_ct") > VERY_HIGH_OUT, "very_high_out_ct"),
        F.when(F.col("src_total_weight") > HIGH_SRC_WEIGHT, "high_src_total_weight"),
    )
    return flagged.withColumns(
        {
            "Role": F.when(F.col("flagged"), "C&C").otherwise("Normal"),
            "Reason": F.when(F.col("flagged"), reasons).otherwise(""),
        }
    ).drop("n_nodes", "w_out", "w_in", "strict_thr", "p95")


def detection_summary(ruled: DataFrame, limits: DataFrame) -> DataFrame:
    """Hits per rule and the limits used, one row per sensor."""
    hits = ruled.groupBy("SensorId").agg(
        F.count_if("strict").alias("n_strict"),
        F.count_if("percentile").alias("n_percentile"),
        F.count_if("label_cnc").alias("n_truth"),
        F.count_if("flagged").alias("n_flagged"),
    )
    return limits.select("SensorId", "w_out", "w_in", "strict_thr", "p95").join(hits, "SensorId")
