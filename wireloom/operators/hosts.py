"""Classifying nodes directly from aggregated flow features of their neighbourhood."""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wireloom.operators.lookup import attach
from wireloom.operators.sample import SEED
from wireloom.operators.subgraph import at_end
from wireloom.schema import EDGE, FEATURES, NODE, PLAIN_FEATURES, WEIGHT_FEATURES
from wireloom.session import Stored, store


def feature_sums(features: list[str] = PLAIN_FEATURES) -> list[Column]:
    """Per-edge sum and non-null count of flow features, as extra aggregates of the edge table."""
    sums = [F.sum(F.col(f).cast("double")).alias(f"sum_{f}") for f in features]
    return sums + [F.count(f).alias(f"n_{f}") for f in features]


def node_features(edges: DataFrame, totals: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """Mean and count of every flow feature as source and as destination, 0 where there is none.

    The graph weights are the same for all flows of an edge, so the edge table is enough and no
    flow is joined. ``totals`` holds SrcTotalWeight and DstTotalWeight per pair.
    """
    joined = edges.join(totals.drop("EdgeWeight"), ["SrcAddr", "DstAddr"])
    flows = F.col("w_sensor")
    known = {"EdgeWeight": F.col("w_global"), "SrcTotalWeight": F.col("SrcTotalWeight"),
             "DstTotalWeight": F.col("DstTotalWeight")}

    def side(prefix: str, end: str, own: str, count: str) -> DataFrame:
        """One aggregate over the edges of each node in one role."""

        def mean(total: Column, n: Column) -> Column:
            return F.try_divide(F.sum(total), F.sum(n))

        aggregates: list[Column] = []
        for f in features:
            total = known[f].cast("double") * flows if f in WEIGHT_FEATURES else F.col(f"sum_{f}")
            n = flows if f in WEIGHT_FEATURES else F.col(f"n_{f}")
            aggregates += [mean(total, n).alias(f"{prefix}_{f}_mean"), F.sum(n).alias(f"{prefix}_{f}_count")]
        aggregates += [
            F.sum(flows).alias(count), mean(known[own].cast("double") * flows, flows).alias(f"{prefix}_total_weight_agg"),
            F.max("label_cnc").alias(f"{prefix}_label"),
        ]
        return joined.groupBy("SensorId", F.col(end).alias("node")).agg(*aggregates)

    sent = side("src", "SrcAddr", "SrcTotalWeight", "out_count")
    received = side("dst", "DstAddr", "DstTotalWeight", "in_count")
    # both sides are partitioned by node already, so the join moves nothing
    both = sent.join(received, NODE, "full")
    labels = ["src_label", "dst_label"]
    names = [c for c in both.columns if c not in (*NODE, *labels)]
    zero = {c: F.lit(0) if c.endswith("_count") else F.lit(0.0) for c in names}
    return both.select(
        *NODE, *[F.coalesce(F.col(c), zero[c]).alias(c) for c in names], F.greatest(*labels).alias("label_cnc")
    )


def node_labels(edges: DataFrame) -> DataFrame:
    """1 for a node at either end of controller traffic."""
    ends = F.explode(F.array("SrcAddr", "DstAddr")).alias("node")
    return edges.select("SensorId", ends, "label_cnc").groupBy(*NODE).agg(F.max("label_cnc").alias("label_cnc"))


def neighbour_mean(edges: DataFrame, nodes: Stored, columns: list[str], degrees: DataFrame) -> DataFrame:
    """Unweighted mean of each column over the distinct in-neighbours, 0 where there are none."""
    sources = Stored(
        nodes.table.select("SensorId", F.col("node").alias("SrcAddr"), *columns), nodes.rows
    )
    sizes = at_end(degrees, "SrcAddr", graph_degree="graph_degree")
    arriving = attach(
        edges.select(*EDGE), sources, ["SensorId", "SrcAddr"], "graph_degree", how="inner", sizes=sizes
    )
    means = arriving.groupBy("SensorId", F.col("DstAddr").alias("node")).agg(
        *[F.avg(c).alias(c) for c in columns]
    )
    return nodes.table.select(*NODE).join(means, NODE, "left").fillna(0.0, columns)


def with_hops(edges: DataFrame, nodes: Stored, columns: list[str], degrees: DataFrame) -> DataFrame:
    """Node columns beside those of one and two hops inward, as ``hop1_*`` and ``hop2_*``."""
    wide = nodes.table
    level = nodes
    for hop in (1, 2):
        level = store(neighbour_mean(edges, level, columns, degrees), f"hop{hop}")
        renamed = level.table.select(*NODE, *[F.col(c).alias(f"hop{hop}_{c}") for c in columns])
        wide = wide.join(renamed, NODE)
    return wide


class HostClassifier:
    """Scaled hop features into a small network or a logistic regression."""

    def __init__(self, columns: list[str], kind: str = "mlp", hidden: int = 32, rounds: int = 20):
        self.columns = [*columns, *[f"hop{h}_{c}" for h in (1, 2) for c in columns]]
        self.kind, self.hidden, self.rounds = kind, hidden, rounds
        self.scaler: Model | None = None
        self.model: Model | None = None

    def _vectors(self, nodes: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=self.columns, outputCol="raw").transform(nodes)

    def fit(self, nodes: DataFrame) -> HostClassifier:
        ready = self._vectors(nodes)
        self.scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(ready)
        common = {"labelCol": "label_cnc", "featuresCol": "features", "maxIter": self.rounds}
        if self.kind == "mlp":
            learner = MultilayerPerceptronClassifier(
                layers=[len(self.columns), self.hidden, 2], seed=SEED, **common
            )
        else:
            learner = LogisticRegression(**common)
        self.model = learner.fit(self.scaler.transform(ready))
        return self

    def transform(self, nodes: DataFrame) -> DataFrame:
        """SensorId, node and ``PredictedProb_Node``."""
        scored = self.model.transform(self.scaler.transform(self._vectors(nodes)))
        return scored.select(*NODE, vector_to_array("probability")[1].alias("PredictedProb_Node"))


def edge_probability(edges: DataFrame, scores: Stored, degrees: DataFrame) -> DataFrame:
    """Edges with ``PredictedProb``: the larger node score of the two ends, 0 where there is none."""
    for end, name in (("SrcAddr", "at_source"), ("DstAddr", "at_target")):
        lookup = Stored(at_end(scores.table, end, PredictedProb_Node=name), scores.rows)
        sizes = at_end(degrees, end, graph_degree="graph_degree")
        edges = attach(edges, lookup, ["SensorId", end], "graph_degree", sizes=sizes)
    larger = F.greatest(
        F.coalesce(F.col("at_source"), F.lit(0.0)), F.coalesce(F.col("at_target"), F.lit(0.0))
    )
    return edges.withColumn("PredictedProb", larger).drop("at_source", "at_target")


def flow_probability(flows: DataFrame, scored_edges: Stored, cut: float = 0.5) -> DataFrame:
    """Flows with the probability of their edge and the label it gives, in one join of the flows."""
    lookup = Stored(scored_edges.table.select(*EDGE, "PredictedProb", "w_sensor"), scored_edges.rows)
    joined = attach(flows, lookup, EDGE, "w_sensor").drop("w_sensor")
    probability = F.coalesce(F.col("PredictedProb"), F.lit(0.0))
    return joined.withColumn("PredictedProb", probability).withColumn(
        "PredictedLabel", (F.col("PredictedProb") >= cut).cast("int")
    )
