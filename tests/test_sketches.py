"""Mergeable summaries against exact results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wireloom.operators import evaluate, nodes, sketches, weights
from wireloom.operators.edge_state import EdgeState
from wireloom.session import store


def test_quantile_error_is_as_stated(spark):
    rng = np.random.default_rng(2)
    values = np.round(np.exp(rng.normal(size=60_000) * 3), 4)
    frame = spark.createDataFrame([(int(i % 2), int(i % 3), float(v)) for i, v in enumerate(values)], "SensorId long, day int, cnc_score double")
    frame = store(frame, "values").table
    for k in (64, 1024):
        days = [sketches.score_sketches(frame.filter(F.col("day") == d), k) for d in range(3)]
        kept = store(days[0].unionByName(days[1]).unionByName(days[2]), "sketches").table
        merged = store(sketches.merged_scores(kept), "merged").table
        for q in (0.05, 0.5, 0.95):
            low, high = sketches.quantile_rank_band(k, q)
            for r in sketches.approximate_cutoffs(merged, q).collect():
                own = values[np.arange(len(values)) % 2 == r.SensorId]
                assert (own < r.p95).mean() <= high and (own <= r.p95).mean() >= low
    assert sketches.rank_error(200) == pytest.approx(0.0133, abs=1e-4)
    assert sketches.rank_error(sketches.needed_k(0.001)) <= 0.001 < sketches.rank_error(sketches.needed_k(0.001) - 1)


def test_negative_cutoffs_are_zero(spark):
    frame = spark.createDataFrame([(1, -2.0), (1, -1.0), (2, 3.0)], "SensorId long, cnc_score double")
    found = sketches.approximate_cutoffs(sketches.score_sketches(frame))
    assert {r.SensorId: r.p95 for r in found.collect()} == {1: 0.0, 2: 3.0}


def test_distinct_peers(spark):
    rows = spark.range(60_000).select(
        F.lit(1).cast("long").alias("SensorId"), F.when(F.col("id") % 2 == 0, "hub").otherwise("small").alias("SrcAddr"),
        F.concat(F.lit("d"), F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(F.col("id") % 200)).alias("DstAddr"), "id",
    )
    days = [sketches.peer_sketches(rows.filter(F.col("id") % 3 == d)) for d in range(3)]
    merged = sketches.merged_peers(store(days[0].unionByName(days[1]).unionByName(days[2]), "days").table)
    found = {r.node: r for r in sketches.peer_estimates(merged).filter("out_unique_dests > 0").collect()}
    assert found["small"].out_unique_dests == 100 and found["small"].in_unique_srcs == 0
    assert abs(found["hub"].out_unique_dests / 30_000 - 1) < 4 * 2 ** (-sketches.PEER_BITS / 2)
    whole = {r.node: r for r in sketches.peer_estimates(sketches.peer_sketches(rows)).filter("out_unique_dests > 0").collect()}
    assert abs(whole["hub"].out_unique_dests / found["hub"].out_unique_dests - 1) < 8 * 2 ** (-sketches.PEER_BITS / 2)
    assert whole["small"].out_unique_dests == 100


@pytest.mark.parametrize("bins", [1, 7, 500])
def test_bounds_hold(spark, bins):
    rng = np.random.default_rng(bins)
    prob = np.clip(rng.normal(0.4, 0.3, 3000), 0, 1).round(3)
    label = (rng.random(3000) < prob).astype(int)
    frame = spark.createDataFrame([(int(y), float(p)) for y, p in zip(label, prob)] + [(1, None), (0, float("nan"))], "y int, p double")
    exact = frame.filter("p is not null and not isnan(p)")
    curve = store(evaluate.roc_curve(exact, "y", "p"), "curve").table
    auc = evaluate.roc_auc(curve).first()["roc_auc"]
    balance = curve.agg(F.max(F.sqrt(F.col("tpr") * (1 - F.col("fpr"))))).first()[0]
    halves = [sketches.score_histogram(exact.filter((F.col("p") * 1000 % 2 < 1) == h), "y", "p", bins) for h in (True, False)]
    found = sketches.quality_bounds(sketches.merged_histograms(halves[0].unionByName(halves[1])), bins).first()
    assert found.auc_low <= auc <= found.auc_high and found.balance_low <= balance <= found.balance_high
    if bins == 500:
        assert found.auc_high - found.auc_low < 0.01 and found.balance_high - found.balance_low < 0.01
    assert sketches.score_histogram(frame, "y", "p", bins).agg(F.sum(F.col("pos") + F.col("neg"))).first()[0] == 3000


def test_bounds_of_one_class(spark):
    frame = spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, p double")
    assert tuple(sketches.quality_bounds(sketches.score_histogram(frame, "y", "p"))[["auc_low", "auc_high"]].first()) == (None, None)
    nothing = sketches.quality_bounds(sketches.score_histogram(frame.limit(0), "y", "p")).first()
    assert set(nothing.asDict().values()) == {None}


def test_edges_in_runs_equal_one_pass(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [
        (None if rng.random() < 0.1 else int(rng.integers(1, 3)), f"a{rng.integers(6)}", f"b{rng.integers(6)}", int(rng.random() < 0.2),
         None if rng.random() < 0.2 else float(rng.integers(0, 64)) / 64, int(rng.integers(3)))
        for _ in range(900)
    ]
    flows = spark.createDataFrame(rows, "SensorId long, SrcAddr string, DstAddr string, LabelCNC int, prob double, day int").repartition(4)
    state = EdgeState(spark, str(tmp_path / "state"))
    for day in (0, 1, 2, 1):  # one day comes again
        state.add(flows.filter(F.col("day") == day), f"d{day}", "prob")
    want = weights.sensor_edges(flows, "prob")
    for found in (state, state.compact(str(tmp_path / "compacted"))):
        assert sorted(map(str, found.edges().select(want.columns).collect())) == sorted(map(str, want.collect()))
    stats = nodes.node_stats(state.edges())
    assert stats.count() == nodes.node_stats(want).count()
    without = EdgeState(spark, str(tmp_path / "plain"))
    without.add(flows, "all")
    assert without.edges().filter("n_prob <> 0 or sum_prob is not null").count() == 0
