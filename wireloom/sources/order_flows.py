"""Flow records derived from order line items, for tests and benchmarks without network captures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CLIENT = "'10.1.' || CAST(o_custkey % 200 AS VARCHAR(10)) || '.1'"
SERVER = "'10.2.' || CAST(l_suppkey % 256 AS VARCHAR(10)) || '.1'"
FORWARD = (
    "((l_suppkey % 10 = 0 AND (l_orderkey + l_linenumber) % 8 <> 0)"
    " OR (l_suppkey % 10 <> 0 AND (l_orderkey + l_linenumber) % 2 = 0))"
)

# Expressions both Spark and other SQL engines read alike.
COLUMNS = {
    "StartTime": "l_shipdate",
    "Dur": "l_quantity * l_discount",
    "Proto": "CASE l_returnflag WHEN 'A' THEN 'tcp' WHEN 'N' THEN 'udp' ELSE 'icmp' END",
    "SrcAddr": f"CASE WHEN l_orderkey % 97 = 0 THEN '00:1a:2b:3c:4d:5e' WHEN {FORWARD} THEN {SERVER} ELSE {CLIENT} END",
    "Sport": "CAST(l_partkey % 65536 AS BIGINT)",
    "Dir": "CASE l_linenumber % 4 WHEN 0 THEN '->' WHEN 1 THEN '   ->' WHEN 2 THEN '<->' ELSE '<?>' END",
    "DstAddr": f"CASE WHEN {FORWARD} THEN {CLIENT} ELSE {SERVER} END",
    "Dport": "CAST(l_suppkey % 1024 AS BIGINT)",
    "State": "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linestatus END",
    "sTos": "CASE WHEN l_linenumber = 6 THEN NULL ELSE CAST(l_linenumber AS DOUBLE) END",
    "dTos": "CAST(l_linenumber % 3 AS DOUBLE)",
    "TotPkts": "CAST(floor(l_quantity) AS BIGINT)",
    "TotBytes": "CAST(floor(l_extendedprice) AS BIGINT)",
    "SrcBytes": "CAST(floor(l_extendedprice * (1 - l_discount)) AS BIGINT)",
    "Label": (
        "CASE WHEN l_orderkey % 89 = 0 THEN NULL"
        f" WHEN l_suppkey % 10 = 0 AND {FORWARD} THEN 'flow=From-Botnet-V42-TCP-Established'"
        " WHEN l_suppkey % 10 = 0 THEN 'flow=To-Botnet-V42-UDP'"
        " WHEN l_suppkey % 10 = 1 THEN 'from_botnet'"
        " WHEN l_suppkey % 10 = 2 THEN '1'"
        " WHEN l_suppkey % 10 = 3 THEN '0.2'"
        " WHEN l_suppkey % 10 = 4 THEN 'flow=From-Normal-V42'"
        " ELSE 'flow=Background' END"
    ),
    "ActivityLabel": "CAST(l_linenumber % 2 AS BIGINT)",
    "BotnetName": "CASE WHEN l_suppkey % 10 = 0 THEN 'B' || CAST(l_suppkey AS VARCHAR(10)) ELSE NULL END",
    "SensorId": "CAST(1 + l_orderkey % 3 AS BIGINT)",
}

# A stand-in probability in steps of 1/1024, so that sums are exact in any order.
STAND_IN_PROB = (
    "(CASE WHEN Label = 1 THEN CAST(0.90625 AS DOUBLE) ELSE CAST(0.0625 AS DOUBLE) END)"
    " + TotPkts / CAST(1024 AS DOUBLE)"
)


def order_flows(spark: SparkSession, folder: str) -> DataFrame:
    """The 18 flow columns, one flow per line item."""
    items = spark.read.parquet(f"{folder}/lineitem.parquet")
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    # Both tables grow with the data, so neither side is one to broadcast.
    joined = items.join(orders.hint("merge"), items.l_orderkey == orders.o_orderkey)
    return joined.selectExpr(*[f"{text} AS {name}" for name, text in COLUMNS.items()])
