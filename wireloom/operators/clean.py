"""Row filters and reports on raw flows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wireloom.functions import labels
from wireloom.schema import KEY_COLUMNS

# `\z`, because `$` would also accept a trailing newline.
ADDRESS = r"^[0-9.]+\z"


def drop_repeated_headers(frame: DataFrame, key: str = "StartTime") -> DataFrame:
    """Drop rows whose first column repeats the header; a null first column stays."""
    if key not in frame.columns:
        return frame
    return frame.filter(~F.col(frame.columns[0]).eqNullSafe(F.lit(key)))


def valid_flows(flows: DataFrame, sensors: list[int] | None = None) -> DataFrame:
    """Labelled flows from a digits-and-dots source, of all sensors or the given ones."""
    kept = flows.filter(F.col("Label").isNotNull() & F.col("SrcAddr").rlike(ADDRESS))
    return kept if sensors is None else kept.filter(F.col("SensorId").isin(sensors))


def drop_incomplete(flows: DataFrame) -> DataFrame:
    """Flows with every key column set. One null test per column reaches the scan; NaN counts as null."""
    for name in KEY_COLUMNS:
        flows = flows.filter(F.col(name).isNotNull())
        if flows.schema[name].dataType.typeName() in ("double", "float"):
            flows = flows.filter(~F.isnan(name))
    return flows


def require_rows(flows: DataFrame) -> DataFrame:
    if flows.isEmpty():
        raise ValueError("no labelled flows in the input")
    return flows


def label_flows(flows: DataFrame) -> DataFrame:
    """Botnet flags and controller label first, because the binary label replaces the text."""
    text = F.col("Label")
    return flows.withColumns(
        {
            "LabelFromBotnet": labels.has_text(text, labels.FROM_BOTNET),
            "LabelToBotnet": labels.has_text(text, labels.TO_BOTNET),
            "LabelBotnet": labels.has_text(text, labels.ANY_BOTNET),
            "LabelCNC": labels.cnc_label(text),
            "Label": labels.binary_label(text),
        }
    )


def label_counts(flows: DataFrame, column: str) -> DataFrame:
    return flows.groupBy(column).agg(F.count("*").alias("flows"))


def flow_summary(flows: DataFrame) -> DataFrame:
    return flows.agg(F.count("*").alias("flows"), F.countDistinct("SensorId").alias("sensors"))


def count_bot_flows(flows: DataFrame, sensor: int, direction: str = "->") -> DataFrame:
    hit = (
        F.col("Label").like("%Bot%")
        & (F.trim("Dir") == direction)
        & (F.col("SensorId") == sensor)
    )
    return flows.filter(hit).agg(F.count("*").alias("flows"))
