"""Node scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def share(part: Column, whole: Column) -> Column:
    return part / (whole + F.lit(1e-9))


def outward_weight(mean_out: Column, mean_in: Column) -> Column:
    """How far a sensor trusts outgoing over incoming probability: between 0.5 and 1."""
    return F.lit(0.5) + F.lit(0.5) * share(mean_out, mean_out + mean_in)


def cnc_score(probability: Column) -> Column:
    """Controller score. The last two factors are ln(2 + x), so a pure sink still scores."""
    shape = F.lit(1.0) + F.col("out_ratio") * 1.8 + F.col("in_ratio") * 0.8
    return (
        probability * shape
        * F.log1p(F.col("degree"))
        * F.log1p(F.col("out_unique_dests") + 1)
        * F.log1p(F.col("src_total_weight") + 1)
    )


def simple_score(mean_probability: Column) -> Column:
    """The older score: no peers, no weights."""
    shape = F.lit(1.0) + F.col("in_ratio") + F.col("out_ratio")
    return mean_probability * shape * F.log1p(F.col("degree"))
