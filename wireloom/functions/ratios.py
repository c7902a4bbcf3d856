"""Per-flow features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Direction arrows and their codes; every other arrow is 0.
DIRECTION_CODES = {"->": 1, "<-": -1, "<->": 0}


def direction_code(arrow: Column, trim: bool = False) -> Column:
    """Code of the direction arrow. Padded arrows count as unknown unless ``trim`` is set."""
    arrow = F.trim(arrow) if trim else arrow
    code = F.lit(0)
    for text, value in DIRECTION_CODES.items():
        code = F.when(arrow == text, value).otherwise(code)
    return code


def ratio_columns() -> dict[str, Column]:
    """The eight ratio features. A zero denominator gives null, which ``finite_or_zero`` turns into 0."""
    packets, total, sent, seconds = (F.col(c) for c in ("TotPkts", "TotBytes", "SrcBytes", "Dur"))

    def ratio(top: Column, bottom: Column) -> Column:
        return F.try_divide(top.cast("double"), bottom.cast("double"))

    return {
        "ByteRatio": ratio(total, packets + 1),
        "DurationRate": ratio(packets, seconds + F.lit(0.1)),
        "FlowIntensity": ratio(sent, total + 1),
        "PktByteRatio": ratio(packets, total + 1),
        "SrcByteRatio": ratio(sent, total + 1),
        "TrafficBalance": F.abs(F.col("sTos") - F.col("dTos")),
        "DurationPerPkt": ratio(seconds, packets + 1),
        "Intensity": ratio(total, seconds + 1),
    }


def finite_or_zero(value: Column) -> Column:
    """Null, NaN and both infinities become 0."""
    value = value.cast("double")
    return F.when(F.abs(value) < float("inf"), value).otherwise(F.lit(0.0))
