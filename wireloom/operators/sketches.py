"""Summaries that can be merged, for those who'd rather be quick than exact. The exact operators stay the default.

Each summary is made per part of the data, for example a day, kept in a table, and merged when it is read; merging needs
none of the flows. Sizes depend on the chosen accuracy, not on the rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wireloom.schema import NODE

#: Accuracy of quantiles: how many values a sketch keeps at its top level.
QUANTILE_K = 1024
#: Distinct peers of a node are exact up to 2 ** PEER_BITS of them.
PEER_BITS = 12


def rank_error(k: int = QUANTILE_K) -> float:
    """By how much the rank of a sketched quantile is off, as a share of all rows, in 99 of 100 cases."""
    # The published error of this kind of sketch (KLL) for one quantile.
    return 2.296 / k**0.9723


def score_sketches(scored: DataFrame, k: int = QUANTILE_K, group: str = "SensorId", value: str = "cnc_score") -> DataFrame:
    """A sketch of the scores of each sensor."""
    return scored.groupBy(group).agg(F.kll_sketch_agg_double(value, k).alias("scores"))


def merged_scores(sketches: DataFrame, group: str = "SensorId") -> DataFrame:
    return sketches.groupBy(group).agg(F.kll_merge_agg_double("scores").alias("scores"))


def approximate_cutoffs(sketches: DataFrame, q: float = 0.95, name: str = "p95") -> DataFrame:
    """The quantile of each sensor, at least 0, its rank off by no more than ``rank_error`` says; merge sketches first."""
    found = F.kll_sketch_get_quantile_double("scores", F.lit(q))
    return sketches.select("SensorId", F.greatest(F.lit(0.0), found).alias(name))


def peer_sketches(edges: DataFrame, bits: int = PEER_BITS) -> DataFrame:
    """For each sensor and node a sketch of the addresses it sends to and one of those it hears from.

    ``edges`` may be flows as well: an address counts once however often it comes.
    """
    nothing = F.lit(None).cast("string")
    ends = F.array(
        F.struct(F.col("SrcAddr").alias("node"), F.col("DstAddr").alias("to"), nothing.alias("from")),
        F.struct(F.col("DstAddr").alias("node"), nothing.alias("to"), F.col("SrcAddr").alias("from")),
    )
    sides = edges.select("SensorId", F.inline(ends))
    return sides.groupBy(*NODE).agg(
        F.theta_sketch_agg("to", bits).alias("sent_to"), F.theta_sketch_agg("from", bits).alias("heard_from")
    )


def merged_peers(sketches: DataFrame, bits: int = PEER_BITS) -> DataFrame:
    return sketches.groupBy(*NODE).agg(
        F.theta_union_agg("sent_to", bits).alias("sent_to"), F.theta_union_agg("heard_from", bits).alias("heard_from")
    )


def peer_estimates(sketches: DataFrame) -> DataFrame:
    """``out_unique_dests`` and ``in_unique_srcs``: exact up to 2 ** bits peers, beyond with a standard error of
    2 ** (-bits / 2) of the count. Merge sketches first."""
    return sketches.select(
        *NODE, F.theta_sketch_estimate("sent_to").alias("out_unique_dests"),
        F.theta_sketch_estimate("heard_from").alias("in_unique_srcs"),
    )


def score_histogram(rows: DataFrame, label: str, prob: str, bins: int = 1000) -> DataFrame:
    """``bin``, ``pos`` and ``neg``: rows of each class in equal bins of the probability; empty bins have no row."""
    place = F.least(F.greatest(F.floor(F.col(prob) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    counted = rows.filter(F.col(prob).isNotNull() & ~F.isnan(prob))
    return counted.groupBy(place.alias("bin")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )


def merged_histograms(histograms: DataFrame) -> DataFrame:
    return histograms.groupBy("bin").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def quality_bounds(histogram: DataFrame, bins: int = 1000) -> DataFrame:
    """Bounds of what the exact curve would give: ``auc_low``, ``auc_high``, ``balance_low``, ``balance_high``.

    Rows of one bin may be in any order, all else is known. The balance is the best over all thresholds, also those
    that the exact search skips inside straight stretches. ``threshold`` is the lower end of the bin at which the lower
    bound of the balance, sqrt(tpr * (1 - fpr)), is reached; the highest one on ties. One class only gives null.
    """
    down = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)  # at most ``bins`` rows
    summed = histogram.withColumns({"pos_upto": F.sum("pos").over(down), "neg_upto": F.sum("neg").over(down)})
    whole = histogram.agg(F.sum("pos").cast("double").alias("all_pos"), F.sum("neg").cast("double").alias("all_neg"))
    placed = summed.join(F.broadcast(whole))  # one row

    def balance(pos: Column, neg: Column) -> Column:
        return F.sqrt(F.try_divide(pos, F.col("all_pos")) * (F.lit(1.0) - F.try_divide(neg, F.col("all_neg"))))

    both = F.col("all_pos") * F.col("all_neg")
    low = F.sum(F.col("neg") * (F.col("pos_upto") - F.col("pos")))
    inside = F.sum(F.col("neg").cast("double") * F.col("pos"))
    here = balance(F.col("pos_upto"), F.col("neg_upto"))
    reach = balance(F.col("pos_upto"), F.col("neg_upto") - F.col("neg"))
    best = F.max(F.struct(here.alias("balance"), F.col("bin")))
    return placed.agg(
        F.try_divide(low, F.max(both)).alias("auc_low"), F.try_divide(low + inside, F.max(both)).alias("auc_high"),
        best.getField("balance").alias("balance_low"), F.max(reach).alias("balance_high"),
        F.when(best.getField("balance").isNotNull(), best.getField("bin") / F.lit(float(bins))).alias("threshold"),
    )


def quantile_rank_band(k: int, q: float) -> tuple[float, float]:
    """The shares of rows that a sketched quantile may stand at."""
    return max(0.0, q - rank_error(k)), min(1.0, q + rank_error(k))


def needed_k(error: float) -> int:
    """The smallest accuracy whose rank error is at most ``error``."""
    return max(8, math.ceil((2.296 / error) ** (1 / 0.9723)))
