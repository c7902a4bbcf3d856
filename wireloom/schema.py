"""Column names and types of the flow data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Names, order and types of the flow records this library reads.
FLOW = T.StructType(
    [
        T.StructField("StartTime", T.TimestampNTZType()),
        T.StructField("Dur", T.DoubleType()),
        T.StructField("Proto", T.StringType()),
        T.StructField("SrcAddr", T.StringType()),
        T.StructField("Sport", T.LongType()),
        T.StructField("Dir", T.StringType()),
        T.StructField("DstAddr", T.StringType()),
        T.StructField("Dport", T.LongType()),
        T.StructField("State", T.StringType()),
        T.StructField("sTos", T.DoubleType()),
        T.StructField("dTos", T.DoubleType()),
        T.StructField("TotPkts", T.LongType()),
        T.StructField("TotBytes", T.LongType()),
        T.StructField("SrcBytes", T.LongType()),
        T.StructField("Label", T.StringType()),
        T.StructField("ActivityLabel", T.LongType()),
        T.StructField("BotnetName", T.StringType()),
        T.StructField("SensorId", T.LongType()),
    ]
)

# The columns a detection run scans.
SCAN_COLUMNS = [
    "SrcAddr", "DstAddr", "Proto", "Dir", "State", "Dur", "TotBytes", "TotPkts",
    "sTos", "dTos", "SrcBytes", "Label", "SensorId",
]

# A flow missing any of these is dropped.
KEY_COLUMNS = ["SrcAddr", "DstAddr", "Dir", "Proto", "Dur", "TotBytes", "TotPkts", "Label"]

# Feature order of the model without graph weights ...
PLAIN_FEATURES = [
    "Dir", "Dur", "Proto", "TotBytes", "TotPkts", "sTos", "dTos", "SrcBytes",
    "ByteRatio", "DurationRate", "FlowIntensity", "PktByteRatio",
    "SrcByteRatio", "TrafficBalance", "DurationPerPkt", "Intensity",
]
# ... and the three weights the current model appends to it.
WEIGHT_FEATURES = ["EdgeWeight", "SrcTotalWeight", "DstTotalWeight"]
FEATURES = PLAIN_FEATURES + WEIGHT_FEATURES

PAIR = ["SrcAddr", "DstAddr"]
EDGE = ["SensorId", "SrcAddr", "DstAddr"]
NODE = ["SensorId", "node"]
