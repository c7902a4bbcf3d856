"""Edge tables that grow with each run, so that no flow is read twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wireloom.schema import EDGE, PAIR

SCHEMA = (
    "SensorId bigint, SrcAddr string, DstAddr string, w_sensor bigint, label_cnc int, n_prob bigint, sum_prob double"
)


class EdgeState:
    """A folder of partial edge tables, one for each run.

    ``add`` aggregates new flows alone and replaces what a run of the same name has left, so a run may be repeated.
    ``edges`` merges all partial tables: counts, sums and labels are those of one pass over all flows. ``compact`` merges
    them for good.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def add(self, flows: DataFrame, run: str, prob: str | None = None) -> None:
        has = F.lit(None).cast("double") if prob is None else F.col(prob)
        partial = flows.groupBy(*EDGE).agg(
            F.count("*").alias("w_sensor"), F.max("LabelCNC").alias("label_cnc"), F.count(has).alias("n_prob"),
            F.sum(has).alias("sum_prob"),
        )
        # flows without a sensor count for their pair, so their rows stay here
        partial.write.mode("overwrite").parquet(f"{self.path}/run={run}")

    def partials(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).option("basePath", self.path).parquet(f"{self.path}/run=*")

    def merged(self) -> DataFrame:
        return self.partials().groupBy(*EDGE).agg(
            F.sum("w_sensor").alias("w_sensor"), F.max("label_cnc").alias("label_cnc"), F.sum("n_prob").alias("n_prob"),
            F.sum("sum_prob").alias("sum_prob"),
        )

    def edges(self) -> DataFrame:
        """As ``weights.sensor_edges`` over all flows of all runs."""
        everywhere = F.sum("w_sensor").over(Window.partitionBy(*PAIR))
        return self.merged().withColumn("w_global", everywhere).filter(F.col("SensorId").isNotNull())

    def compact(self, path: str) -> EdgeState:
        """One partial table in place of all, in another folder."""
        self.merged().write.parquet(f"{path.rstrip('/')}/run=compacted")
        return EdgeState(self.spark, path)
