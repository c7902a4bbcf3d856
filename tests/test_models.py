"""Split, sampling, evaluation, training and sinks."""

import math

import numpy as np
import pytest
from pyspark.ml import Estimator
from pyspark.sql import functions as F

from wireloom.operators import evaluate, features, sample, stacking
from wireloom.operators.boosting import Rules
from wireloom.operators.random_trees import RandomTrees
from wireloom.plans import by_host, catalog, classify
from wireloom.plans.run import ingest, run, run_by_host, run_simple
from wireloom.schema import FEATURES, FLOW, PLAIN_FEATURES
from wireloom.session import scratch_path, shared_folder
from wireloom.sources import sinks
from wireloom.sources.order_flows import order_flows


def labelled(spark, counts):
    return spark.createDataFrame([(c, 7) for c, n in counts.items() for _ in range(n)], "Label int, same int").repartition(4)


@pytest.mark.parametrize("counts, train", [
    ({0: 700, 1: 300}, {0: 490, 1: 210}),
    ({0: 101, 1: 34}, {0: 70, 1: 24}),
    ({0: 5000, 1: 7}, {0: 3499, 1: 5}),
    ({0: 10}, {0: 7}),
])
def test_split_is_exact_even_for_equal_rows(spark, counts, train):
    drawn = sample.with_draw(labelled(spark, counts))
    assert drawn.table.select("draw").distinct().count() == len(counts)  # equal rows share a draw
    split = sample.split_rows(drawn)
    got = {r["Label"]: r["n"] for r in split.filter("split = 'train'").groupBy("Label").agg(F.count("*").alias("n")).collect()}
    assert got == train
    assert split.count() == sum(counts.values())


@pytest.mark.parametrize("n", [1, 10, 499, 500, 900])
def test_sample_size_is_exact(spark, n):
    drawn = sample.with_draw(labelled(spark, {0: 400, 1: 100}))
    assert sample.sample_rows(drawn, n).count() == min(n, 500)


def test_class_weights(spark):
    found = {r["Label"]: r["weight"] for r in sample.class_weights(labelled(spark, {0: 30, 1: 10})).collect()}
    assert found == {0: pytest.approx(40 / 60), 1: pytest.approx(2.0)}


def test_standardizer(spark):
    rows = [(1.0, 5.0), (2.0, 5.0), (6.0, 5.0)]
    frame = spark.createDataFrame(rows, "x double, flat double")
    found = features.Standardizer.fit(frame, ["x", "flat"]).transform(frame).collect()
    xs = np.array([1.0, 2.0, 6.0])
    assert [r["x"] for r in found] == pytest.approx(list((xs - xs.mean()) / xs.std()))
    assert [r["flat"] for r in found] == [0.0, 0.0, 0.0]


def plain_roc(pairs):
    points = []
    for t in sorted({p for _, p in pairs}, reverse=True):
        tp = sum(1 for y, p in pairs if y and p >= t)
        fp = sum(1 for y, p in pairs if not y and p >= t)
        points.append((t, tp, fp))
    return points


CASES = {
    "mixed": [(1, 0.9), (0, 0.9), (1, 0.8), (0, 0.3), (1, 0.3), (0, 0.1), (0, 0.05)],
    "perfect": [(1, 0.9), (1, 0.8), (0, 0.2), (0, 0.1)],
    "reversed": [(0, 0.9), (1, 0.1)],
    "one_class": [(1, 0.9), (1, 0.1)],
    "all_tied": [(1, 0.5), (0, 0.5), (0, 0.5)],
    "straight": [(y, p / 10) for p in range(10) for y in (0, 1)],
}


@pytest.mark.parametrize("name", CASES)
def test_roc_threshold_and_auc(spark, name):
    pairs = CASES[name]
    pos, neg = sum(y for y, _ in pairs), sum(1 - y for y, _ in pairs)
    curve = evaluate.roc_curve(spark.createDataFrame(pairs, "y int, p double"), "y", "p")
    found = {r["threshold"]: (r["pos_upto"], r["neg_upto"], r["corner"]) for r in curve.collect()}
    points = plain_roc(pairs)
    assert {t: v[:2] for t, v in found.items()} == {t: (tp, fp) for t, tp, fp in points}
    steps = [(tp - a, fp - b) for (_, tp, fp), (_, a, b) in zip(points, [(0, 0, 0)] + points)]
    for i, (t, _, _) in enumerate(points):
        inner = 0 < i < len(points) - 1 and steps[i] == steps[i + 1]
        assert found[t][2] == (not inner)
    best, auc = evaluate.best_threshold(curve).first(), evaluate.roc_auc(curve).first()["roc_auc"]
    if not pos or not neg:
        assert best["threshold"] == math.inf and auc is None
        return
    good = [(math.sqrt(tp / pos * (1 - fp / neg)), t) for t, tp, fp in points if found[t][2]]
    top = max(good)
    assert best["threshold"] == (top[1] if top[0] > 0 else math.inf)
    wins = sum((a > b) + 0.5 * (a == b) for y, a in pairs for z, b in pairs if y and not z)
    assert auc == pytest.approx(wins / (pos * neg))


def test_class_metrics(spark):
    frame = spark.createDataFrame(CASES["mixed"], "y int, p double")
    found = evaluate.class_metrics(frame, "y", "p", 0.8).first()
    assert found.asDict() == {
        "accuracy": pytest.approx(500 / 7), "precision": pytest.approx(2 / 3),
        "recall": pytest.approx(2 / 3), "f1": pytest.approx(2 / 3),
    }
    nothing = evaluate.class_metrics(frame, "y", "p", 2.0).first()
    assert (nothing["precision"], nothing["recall"], nothing["f1"]) == (0, 0, 0)


def test_regression_metrics(spark):
    frame = spark.createDataFrame([(1.0, -5.0), (2.0, 2.0), (4.0, 3.0)], "y double, p double")
    found = evaluate.regression_metrics(frame, "y", "p").first()
    y, p = np.array([1.0, 2.0, 4.0]), np.array([0.0, 2.0, 3.0])
    assert found["MSE"] == pytest.approx(((y - p) ** 2).mean()) and found["MAE"] == pytest.approx(abs(y - p).mean())
    assert found["RMSE"] == pytest.approx(math.sqrt(found["MSE"]))
    assert found["R2"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    flat = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "y double, p double")
    assert evaluate.regression_metrics(flat, "y", "p").first()["R2"] == 1.0
    off = spark.createDataFrame([(1.0, 0.0), (1.0, 1.0)], "y double, p double")
    assert evaluate.regression_metrics(off, "y", "p").first()["R2"] == 0.0


def test_stacked_classification(spark, folder):
    flows = catalog.prepared(spark, folder).drop("prob")
    found = classify.classify(flows, bases=stacking.base_learners(5, 4, 5, 5, 3))
    quality = found.metrics.first()
    assert quality["roc_auc"] > 0.6 and 0 <= quality["accuracy"] <= 100
    assert found.flows.count() == flows.count()
    bad = found.flows.filter("PredictedProb < 0 or PredictedProb > 1 or PredictedProb is null")
    assert bad.count() == 0
    assert found.flows.filter((F.col("PredictedProb") >= found.threshold) != (F.col("PredictedLabel") == 1)).count() == 0


def test_single_forest_and_row_cap(spark, folder):
    flows = catalog.prepared(spark, folder).drop("prob")
    forest = stacking.fallback_forest(5, 4)
    found = classify.classify(flows, names=PLAIN_FEATURES, model="rf", forest=forest, max_rows=2000)
    assert found.flows.count() == flows.count()


def test_fallback_only_when_asked(spark, folder):
    flows = catalog.prepared(spark, folder).drop("prob")
    broken = {"bad": stacking.fallback_forest(1, 1).setWeightCol("no_such_column")}
    forest = stacking.fallback_forest(3, 3)
    with pytest.raises(Exception):
        classify.classify(flows, names=PLAIN_FEATURES, bases=broken, forest=forest)
    found = classify.classify(flows, names=PLAIN_FEATURES, bases=broken, forest=forest, fallback=True)
    assert isinstance(found.model.model, stacking.ForestModel)


def test_host_classifier(spark, folder):
    graph = by_host.host_graph(catalog.prepared(spark, folder))
    assert len(by_host.feature_names(graph)) == 4 * len(FEATURES) + 4
    scores = by_host.node_scores(graph, kind="mlp", rounds=5)
    assert scores.count() == graph.nodes.rows
    assert scores.filter("PredictedProb_Node < 0 or PredictedProb_Node > 1").count() == 0


@pytest.fixture(scope="module")
def clean_flows(spark, folder, tmp_path_factory):
    from wireloom.sources.files import CSV_TEXT

    at = tmp_path_factory.mktemp("flows")
    raw, clean = str(at / "raw"), str(at / "clean")
    order_flows(spark, folder).write.options(**CSV_TEXT).csv(raw)
    assert [r["Column"] for r in ingest(spark, raw, clean, str(at / "report")).collect()] == FLOW.names
    report = spark.read.option("header", True).csv(str(at / "report"))
    assert report.filter("step = 'read'").first()["rows"] == str(order_flows(spark, folder).count())
    return clean


def small_bases():
    return stacking.base_learners(3, 3, 3, 3, 3)


def written(spark, out, name):
    return spark.read.option("header", True).csv(f"{out}/{name}")


def test_full_run(spark, clean_flows, tmp_path):
    out = str(tmp_path)
    found = run(
        spark, clean_flows, out, sensors=[3], bases=small_bases(), run_id="x", use_ground_truth=False, max_nodes=40, max_edges=60,
        max_rows=1500, trim_dir=True, save_model=True,
    )
    assert {r["SensorId"] for r in found.summary().collect()} == {3}
    assert written(spark, out, "node_scores_x").count() == found.nodes.count()
    assert written(spark, out, "flagged_x").count() == found.flagged().count() > 0
    assert written(spark, out, "summary_x").first()["n_truth"] is not None
    assert "label_cnc" not in {r["Reason"] for r in found.flagged().collect()}
    assert 0 < written(spark, out, "subgraph_edges_x").count() <= 60
    assert found.flagged().count() <= written(spark, out, "subgraph_nodes_x").count() <= max(40, found.flagged().count())
    assert written(spark, out, "metrics").first()["Model"] == "stack"
    split = written(spark, out, "split_x")
    assert split.count() == 1500 and {r["split"] for r in split.select("split").distinct().collect()} == {"train", "test"}
    model = classify.FlowModel.load(spark, f"{out}/model_x")
    assert model.trim_dir and set(model.model.bases) == {"rf", "et", "hgb"}


def test_run_of_the_older_detector(spark, clean_flows, tmp_path):
    out = str(tmp_path)
    forest = {"rf": stacking.base_learners(3, 3)["rf"]}
    nodes = run_simple(spark, clean_flows, out, bases=forest, run_id="y", max_rows=2000)
    assert written(spark, out, "node_scores_y").count() == nodes.count()
    flagged = nodes.filter("Role = 'C&C'").count()
    assert flagged == nodes.filter("flagged").count()
    if flagged:
        assert written(spark, out, "flagged_y").count() == flagged
    assert written(spark, out, "metrics").count() == 1


def test_run_by_host(spark, clean_flows, tmp_path):
    out = str(tmp_path)
    found = run_by_host(spark, clean_flows, out, run_id="z", kind="logistic", rounds=5, max_edges=30)
    assert written(spark, out, "node_scores_z").count() == found.nodes.count()
    edges = written(spark, out, "subgraph_edges_z").groupBy("SensorId").count().collect()
    assert edges and all(r["count"] <= 30 for r in edges)
    assert written(spark, out, "summary_z").count() == 3


def test_node_scores_are_written_in_order(spark, tmp_path):
    frame = spark.createDataFrame([(i % 2, str(i), float(i * 7 % 50)) for i in range(50)], "SensorId long, node string, cnc_score double")
    path = sinks.write_node_scores(frame, str(tmp_path), "r1", fmt="parquet")
    rows = spark.read.parquet(path).filter("SensorId = 1").withColumn("file", F.col("_metadata.file_name")).collect()
    assert len(rows) == 25
    for name in {r["file"] for r in rows}:
        own = [r["cnc_score"] for r in rows if r["file"] == name]
        assert own == sorted(own, reverse=True)


def test_metrics_are_appended(spark, tmp_path):
    path = str(tmp_path / "metrics")
    for model in ("a", "b"):
        sinks.append_metrics(spark.createDataFrame([(1.5,)], "MSE double"), model, path)
    assert sorted(r["Model"] for r in spark.read.option("header", True).csv(path).collect()) == ["a", "b"]


def test_cluster_needs_a_shared_folder(spark):
    class Context:
        master, applicationId = "yarn", "x"

    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        sparkContext = Context

    with pytest.raises(ValueError):
        shared_folder(Session)
    Session.conf.get = staticmethod(lambda key, default=None: "hdfs://shared/dir/")
    assert scratch_path(Session, "edges").startswith("hdfs://shared/dir/wireloom/x/edges-")


class Reached(Exception):
    """Raised with the learners in place of fitting them."""


def sizes(learners):
    found = {}
    for name, e in learners.items():
        if isinstance(e, Estimator):
            found[name] = [e.getOrDefault(p) for p in ("numTrees", "maxDepth")]
        else:
            found[name] = [e.trees, e.depth] if isinstance(e, RandomTrees) else [e.rounds, e.rate, e.patience, e.rules]
    return found


@pytest.mark.parametrize("name", ["base_predict", "stack_predict", "stacked_detection", "forest_predict"])
def test_registered_models_have_the_default_size(spark, folder, monkeypatch, name):
    given = stacking.StackedClassifier.__init__

    def stop_stack(self, *args, **kwargs):
        given(self, *args, **kwargs)
        raise Reached(sizes(self.bases))

    def stop_forest(self, rows, params=None):
        raise Reached(sizes({"forest": self}))

    monkeypatch.setattr(stacking.StackedClassifier, "__init__", stop_stack)
    monkeypatch.setattr(stacking.RandomForestClassifier, "fit", stop_forest)
    with pytest.raises(Reached) as found:
        catalog.queries()[name](spark, folder)
    full = {"rf": [100, 12], "et": [100, None], "hgb": [100, 0.05, 10, Rules(depth=8, leaves=31, least_rows=20, l2=0.0)]}
    assert found.value.args[0] == ({"forest": [200, 14]} if name == "forest_predict" else full)
