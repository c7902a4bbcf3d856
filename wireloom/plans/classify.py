"""Learning a probability per flow."""

from __future__ import annotations

import json
import logging
from dataclasses import asdict, dataclass

from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wireloom.operators import evaluate, features, sample, stacking, weights
from wireloom.operators.stacking import Learner
from wireloom.schema import EDGE, FEATURES
from wireloom.session import Stored, store

log = logging.getLogger(__name__)

#: A flow's own columns while its features are computed.
OWN = "_own"
SCORES = ["PredictedProb", "PredictedLabel"]


@dataclass(frozen=True)
class FlowModel:
    """All that scores flows: codes of text columns, scaling, the classifier and its threshold."""

    names: list[str]
    codes: Stored
    scaler: features.Standardizer
    model: Model
    threshold: float
    trim_dir: bool = False

    def features_of(self, flows: DataFrame) -> DataFrame:
        return own_rows(flows, self.names, self.trim_dir, self.codes)

    def score(self, flows: DataFrame) -> DataFrame:
        """Flows, also ones that no model has seen, with all their columns, PredictedProb and PredictedLabel.

        Weights are those of the given flows. Texts without a code count as -1.
        """
        return self.score_rows(self.features_of(flows))

    def score_rows(self, rows: DataFrame) -> DataFrame:
        return labelled(scored_rows(rows.select(OWN, *self.names), self.names, self.scaler, self.model), self.threshold)

    def save(self, path: str) -> None:
        spark = self.codes.table.sparkSession
        said = {"names": self.names, "scaler": asdict(self.scaler), "threshold": repr(self.threshold), "trim_dir": self.trim_dir}
        self.codes.table.write.parquet(f"{path}/codes")
        self.model.save(f"{path}/classifier")
        spark.createDataFrame([(json.dumps(said),)], "value string").coalesce(1).write.text(f"{path}/flows")

    @staticmethod
    def load(spark: SparkSession, path: str) -> FlowModel:
        said = json.loads(spark.read.text(f"{path}/flows").first()["value"])
        return FlowModel(
            said["names"], Stored(spark.read.parquet(f"{path}/codes")), features.Standardizer(**said["scaler"]),
            stacking.load_model(spark, f"{path}/classifier"), float(said["threshold"]), said["trim_dir"],
        )


@dataclass(frozen=True)
class Classified:
    """``flows`` with PredictedProb and PredictedLabel, the ``split`` of labels and features into
    training and test rows, the cut-off and the hold-out metrics; ``model`` scores further flows."""

    flows: DataFrame
    split: DataFrame
    threshold: float
    metrics: DataFrame
    model: FlowModel


def feature_rows(flows: DataFrame, with_weights: bool = True, trim_dir: bool = False, codes: Stored | None = None) -> DataFrame:
    """Prepared flows with every model feature.

    Codes and pair weights are both taken from the flows as they come, and meet in the one join
    that moves flows.
    """
    rows = features.flow_features(flows, trim_dir, codes)
    if not with_weights:
        return rows
    return weights.flow_weights(rows, weights.stored_pairs(flows))


def model_rows(rows: DataFrame, names: list[str], keep: list[str] = [*EDGE, "Label", "LabelCNC"]) -> DataFrame:
    """What training keeps of a flow: its key, labels and features."""
    return features.clean_matrix(rows, names).select(*keep, *names)


def own_rows(flows: DataFrame, names: list[str], trim_dir: bool = False, codes: Stored | None = None) -> DataFrame:
    """The features of flows beside all their own columns, in one struct, and the label where there is one."""
    held = flows.withColumn(OWN, F.struct(*[F.col(f"`{c}`") for c in flows.columns]))
    rows = feature_rows(held, "EdgeWeight" in names, trim_dir, codes)
    return model_rows(rows, names, [OWN, *(c for c in ["Label"] if c in flows.columns)])


def training_rows(train: DataFrame, names: list[str], folds: int = 2) -> DataFrame:
    """Vectors with class weight, stack fold and early-stop marker, stored and spread over all cores."""
    ready = sample.with_class_weight(features.assemble(train, names))
    marked = ready.withColumn("validation", F.pmod(F.floor(F.xxhash64("draw") / 2), F.lit(10)) == 0)
    drawn = store(marked.select("Label", "features", "weight", "validation", "draw"), "training")
    fitting = store(sample.fold_rows(drawn, folds).drop("draw"), "folds").table
    cores = fitting.sparkSession.sparkContext.defaultParallelism
    return fitting.repartition(cores) if fitting.rdd.getNumPartitions() < cores else fitting


def scored_rows(rows: DataFrame, names: list[str], scaler: features.Standardizer, model: Model) -> DataFrame:
    """``rows`` with PredictedProb in place of the features."""
    return model.transform(features.assemble(scaler.transform(rows), names).drop(*names))


def labelled(scored: DataFrame, threshold: float) -> DataFrame:
    """The flows' own columns with PredictedProb and PredictedLabel."""
    kept = [c for c in scored.schema[OWN].dataType.names if c not in SCORES]
    label = (F.col("PredictedProb") >= threshold).cast("int").alias("PredictedLabel")
    return scored.select(*[F.col(f"{OWN}.`{c}`") for c in kept], "PredictedProb", label)


def fit_model(
    train: DataFrame,
    names: list[str],
    model: str,
    bases: dict[str, Learner] | None,
    forest: Estimator | None,
    fallback: bool,
) -> Model:
    forest = forest or stacking.fallback_forest()
    fitting = training_rows(train, names)
    if model == "rf":
        return stacking.ForestModel(forest.fit(fitting))
    try:
        return stacking.StackedClassifier(bases).fit(fitting)
    except Exception:
        if not fallback:
            raise
        log.exception("stacking failed, fitting a single forest")
        return stacking.ForestModel(forest.fit(fitting))


def classify(
    flows: DataFrame,
    names: list[str] = FEATURES,
    model: str = "stack",
    bases: dict[str, Learner] | None = None,
    forest: Estimator | None = None,
    max_rows: int | None = None,
    fallback: bool = False,
    trim_dir: bool = False,
) -> Classified:
    """Split, scale, train, choose the threshold on the hold-out part, score every flow.

    Encoders and weights see all rows and every row is scored, training rows included, as in the
    detector this follows. ``max_rows`` bounds the labelled rows that are split and learned from; by default all are.
    """
    codes = features.fit_codes(flows)
    whole = sample.with_draw(own_rows(flows, names, trim_dir, codes))
    used = whole if max_rows is None else Stored(sample.sample_rows(whole, max_rows))
    marked = sample.split_rows(used)
    split = store(marked.select("Label", *names, "split", "draw"), "split").table
    train, test = split.filter("split = 'train'"), split.filter("split = 'test'")
    scaler = features.Standardizer.fit(train, names)
    fitted = fit_model(scaler.transform(train), names, model, bases, forest, fallback)
    if max_rows is None:  # the hold-out part is among the rows to score: all are scored once
        scored = store(scored_rows(marked.select(OWN, "Label", "split", *names), names, scaler, fitted), "scored").table
        held_out = scored.filter("split = 'test'").select("Label", "PredictedProb")
    else:
        scored = scored_rows(whole.table.select(OWN, *names), names, scaler, fitted)
        held_out = store(scored_rows(test.select("Label", *names), names, scaler, fitted), "hold-out").table
    curve = store(evaluate.roc_curve(held_out, "Label", "PredictedProb"), "roc").table
    threshold = evaluate.best_threshold(curve).first()["threshold"]
    auc = evaluate.roc_auc(curve).first()["roc_auc"]
    quality = evaluate.class_metrics(held_out, "Label", "PredictedProb", threshold)
    metrics = quality.withColumns({"roc_auc": F.lit(auc).cast("double"), "threshold": F.lit(threshold)})
    found = FlowModel(names, codes, scaler, fitted, threshold, trim_dir)
    return Classified(labelled(scored, threshold), split.drop("draw"), threshold, metrics, found)
