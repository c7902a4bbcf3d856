"""Edges, nodes, rules and subgraphs against plain Python on small graphs."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wireloom.operators import hosts, lookup, nodes, rules, subgraph, weights
from wireloom.plans.detect import detect
from wireloom.session import Stored, store

SCHEMA = "SensorId long, SrcAddr string, DstAddr string, LabelCNC int, prob double"


def flows(seed=1, n=400):
    """A third of all flows are one pair."""
    pick = random.Random(seed)
    hot = [(1, "a", "b", 0, 0.75)] * (n // 3)
    return hot + [
        (pick.choice([1, 2]), f"n{pick.randrange(12)}", f"n{pick.randrange(12)}", int(pick.random() < 0.1),
         pick.randrange(64) / 64)
        for _ in range(n - n // 3)
    ]


@pytest.fixture(params=[lookup.BROADCAST_CELLS, 0], ids=["broadcast", "split"])
def both_joins(request, monkeypatch):
    """Every lookup join once by broadcast and once split by heavy keys."""
    monkeypatch.setattr(lookup, "BROADCAST_CELLS", request.param)
    monkeypatch.setattr(lookup, "HEAVY_KEYS", 2)


def test_flow_weights(spark, both_joins):
    rows = flows()
    pair = Counter((s, d) for _, s, d, _, _ in rows)
    out, into = Counter(), Counter()
    for _, s, d, _, _ in rows:
        out[s] += pair[s, d]
        into[d] += pair[s, d]
    found = weights.flow_weights(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == len(rows)
    for r in found:
        s, d = r["SrcAddr"], r["DstAddr"]
        assert (r["EdgeWeight"], r["SrcTotalWeight"], r["DstTotalWeight"]) == (pair[s, d], out[s], into[d])
    assert all(out[s] == sum(w * w for (a, _), w in pair.items() if a == s) for s in out)


def test_flows_without_sensor_count_globally_only(spark):
    rows = [(1, "a", "b", 0, 0.5), (None, "a", "b", 0, 0.5)]
    edges = weights.sensor_edges(spark.createDataFrame(rows, SCHEMA), "prob").collect()
    assert [(r["SensorId"], r["w_sensor"], r["w_global"]) for r in edges] == [(1, 1, 2)]


def expected_nodes(rows):
    pair = Counter((s, d) for _, s, d, _, _ in rows)
    stats = defaultdict(lambda: dict(inp=[], outp=[], srcs=set(), dsts=set(), sw=0, dw=0, cnc=False))
    for sensor, s, d, c, p in rows:
        a, b = stats[sensor, s], stats[sensor, d]
        a["outp"].append(p), a["dsts"].add(d)
        b["inp"].append(p), b["srcs"].add(s)
        a["sw"] += pair[s, d]
        b["dw"] += pair[s, d]
        b["cnc"] |= c == 1
    return stats


def test_detection_matches_plain_python(spark, both_joins):
    rows = flows(seed=5, n=900)
    found = detect(spark.createDataFrame(rows, SCHEMA), "prob")
    got = {(r["SensorId"], r["node"]): r for r in found.nodes.collect()}
    stats = expected_nodes(rows)
    assert got.keys() == stats.keys()
    mean = lambda xs: sum(xs) / len(xs) if xs else 0.0
    for sensor in (1, 2):
        own = {k: v for k, v in stats.items() if k[0] == sensor}
        mo, mi = (np.mean([mean(v[side]) for v in own.values()]) for side in ("outp", "inp"))
        w_out = 0.5 + 0.5 * mo / (mo + mi + 1e-9)
        prob, score = {}, {}
        for k, v in own.items():
            n_in, n_out = len(v["inp"]), len(v["outp"])
            degree = n_in + n_out
            prob[k] = mean(v["outp"]) * w_out + mean(v["inp"]) * (1 - w_out)
            shape = 1 + 1.8 * n_out / (degree + 1e-9) + 0.8 * n_in / (degree + 1e-9)
            score[k] = (
                prob[k] * shape * math.log1p(degree) * math.log(2 + len(v["dsts"])) * math.log(2 + v["sw"])
            )
        cut = max(0.0, np.percentile(list(score.values()), 95))
        limit = max(0.40, min(0.95, np.mean(list(prob.values())) + 1.5 * np.std(list(prob.values()), ddof=1)))
        for k, v in own.items():
            r = got[k]
            assert r["cnc_prob"] == pytest.approx(prob[k]) and r["cnc_score"] == pytest.approx(score[k])
            assert (r["out_unique_dests"], r["in_unique_srcs"]) == (len(v["dsts"]), len(v["srcs"]))
            assert (r["src_total_weight"], r["dst_total_weight"]) == (v["sw"], v["dw"])
            n_out = len(v["outp"])
            strict = prob[k] > limit and n_out > 120 and n_out / (n_out + len(v["inp"]) + 1e-9) > 0.70
            high = score[k] >= cut - 1e-12 and prob[k] >= 0.40 and n_out >= 20
            assert (r["strict"], r["percentile"], r["label_cnc"]) == (strict, high, v["cnc"])
            assert (r["Role"] == "C&C") == (strict or high or v["cnc"]) == (r["Reason"] != "")
    assert found.summary().agg(F.sum("n_flagged")).first()[0] == sum(r["flagged"] for r in got.values())


def test_one_node_sensor_has_no_strict_limit(spark):
    rows = [(1, "a", "a", 0, 1.0)] * 200 + [(2, "a", "b", 0, 1.0)]
    found = detect(spark.createDataFrame(rows, SCHEMA), "prob")
    node = found.nodes.filter("SensorId = 1").first()
    assert (node["degree"], node["in_ct"], node["out_ct"]) == (400, 200, 200)
    assert found.sensors.table.filter("SensorId = 1").first()["strict_thr"] is None
    assert node["strict"] is False


def test_counts_add_up(spark):
    rows = flows(seed=9)
    edges = weights.sensor_edges(spark.createDataFrame(rows, SCHEMA), "prob")
    stats = nodes.node_stats(edges)
    sums = stats.groupBy("SensorId").agg(F.sum("in_ct").alias("i"), F.sum("out_ct").alias("o")).collect()
    per_sensor = Counter(r[0] for r in rows)
    assert all(r["i"] == r["o"] == per_sensor[r["SensorId"]] for r in sums)
    assert edges.agg(F.sum("w_sensor")).first()[0] == len(rows)


def test_ground_truth_can_be_left_out(spark):
    rows = [(1, "a", "b", 1, 0.1), (1, "b", "c", 0, 0.1)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert [r["node"] for r in detect(frame, "prob").flagged().collect()] == ["b"]
    assert detect(frame, "prob", use_ground_truth=False).flagged().count() == 0


def plain_subgraph(edges, flagged, max_nodes, max_edges):
    """Edges {(src, dst): weight} of one sensor and scores of its flagged nodes."""
    degree = Counter()
    for s, d in edges:
        degree[s] += 1
        degree[d] += 1
    near = {d for s, d in edges if s in flagged} | {s for s, d in edges if d in flagged}
    others = sorted(near - set(flagged), key=lambda n: (-degree[n], n))[: max(0, max_nodes - len(flagged))]
    kept = set(flagged) | set(others)
    inside = [(s, d) for s, d in edges if s in kept and d in kept]
    inside.sort(key=lambda e: (not (e[0] in flagged or e[1] in flagged), -edges[e], e))
    return kept, inside[:max_edges], degree


@pytest.mark.parametrize("max_nodes, max_edges", [(500, 800), (6, 10), (2, 3), (1, 1)])
def test_subgraph(spark, both_joins, max_nodes, max_edges):
    pick = random.Random(4)
    table, plain, scores = [], {}, {1: {"n0": 5.0, "n3": 5.0, "n7": 9.0}, 2: {}, 3: {"n1": 1.0}}
    for sensor in scores:
        pairs = {(f"n{pick.randrange(15)}", f"n{pick.randrange(15)}") for _ in range(60)} | {("n0", "n1"), ("n3", "n3"), ("n7", "n2")}
        plain[sensor] = {p: pick.randrange(1, 4) for p in pairs}
        table += [(sensor, s, d, w) for (s, d), w in plain[sensor].items()]
    edges = store(spark.createDataFrame(table, "SensorId long, SrcAddr string, DstAddr string, w_sensor long"), "e").table
    rated = subgraph.vertices(edges).collect()
    node_table = spark.createDataFrame(
        [(r[0], r[1], scores[r[0]].get(r[1], 0.5), r[1] in scores[r[0]]) for r in rated],
        "SensorId long, node string, cnc_score double, flagged boolean",
    )
    found = subgraph.flag_subgraph(edges, node_table, max_nodes, max_edges)
    got_nodes, got_edges = found.nodes.collect(), found.edges.collect()
    for sensor, flagged in scores.items():
        mine = {r["node"]: r for r in got_nodes if r["SensorId"] == sensor}
        if not flagged:
            assert not mine and not [r for r in got_edges if r["SensorId"] == sensor]
            continue
        kept, inside, degree = plain_subgraph(plain[sensor], flagged, max_nodes, max_edges)
        assert mine.keys() == kept
        assert {(r["src"], r["dst"]): r["weight"] for r in got_edges if r["SensorId"] == sensor} == {
            e: plain[sensor][e] for e in inside
        }
        assert all(mine[n]["graph_degree"] == degree[n] for n in kept)
        assert all(r["tier"] == ("top" if n in flagged else "normal") for n, r in mine.items())


def test_random_subgraph_caps_and_drops_isolated(spark):
    table = [(1, "hub", f"n{i}", 1) for i in range(30)] + [(2, "hub", "x", 1)]
    edges = store(spark.createDataFrame(table, "SensorId long, SrcAddr string, DstAddr string, w_sensor long"), "e").table
    node_table = subgraph.vertices(edges).select("*", F.lit(1.0).alias("cnc_score"), (F.col("node") == "hub").alias("flagged"))
    found = subgraph.flag_subgraph(edges, node_table, max_nodes=20, max_edges=5, random_seed=1)
    kept = {r["SensorId"]: r["n"] for r in found.edges.groupBy("SensorId").agg(F.count("*").alias("n")).collect()}
    assert kept == {1: 5, 2: 1}
    members = {(r["SensorId"], r["node"]) for r in found.nodes.collect()}
    linked = {(r["SensorId"], n) for r in found.edges.collect() for n in (r["src"], r["dst"])}
    assert members == linked
    again = subgraph.flag_subgraph(edges, node_table, max_nodes=20, max_edges=5, random_seed=1)
    assert sorted(again.edges.collect()) == sorted(found.edges.collect())


def test_self_loop_degree(spark):
    edges = spark.createDataFrame([(1, "a", "a"), (1, "a", "b")], "SensorId long, SrcAddr string, DstAddr string")
    assert {r["node"]: r["graph_degree"] for r in subgraph.graph_degree(edges).collect()} == {"a": 3, "b": 1}


def test_neighbour_mean(spark, both_joins):
    edges = spark.createDataFrame(
        [(1, "a", "c"), (1, "b", "c"), (1, "c", "a"), (2, "a", "c")], "SensorId long, SrcAddr string, DstAddr string"
    )
    level = Stored(spark.createDataFrame(
        [(1, "a", 1.0), (1, "b", 3.0), (1, "c", 5.0), (2, "a", 7.0), (2, "c", 9.0)], "SensorId long, node string, x double"
    ))
    degrees = subgraph.graph_degree(edges)
    found = {(r["SensorId"], r["node"]): r["x"] for r in hosts.neighbour_mean(edges, level, ["x"], degrees).collect()}
    assert found == {(1, "a"): 5.0, (1, "b"): 0.0, (1, "c"): 2.0, (2, "a"): 0.0, (2, "c"): 7.0}
    wide = hosts.with_hops(edges, level, ["x"], degrees)
    hop2 = {(r["SensorId"], r["node"]): r["hop2_x"] for r in wide.collect()}
    assert hop2 == {(1, "a"): 2.0, (1, "b"): 0.0, (1, "c"): 2.5, (2, "a"): 0.0, (2, "c"): 0.0}


def test_scores_back_to_flows(spark, both_joins):
    rows = flows(seed=7)
    frame = spark.createDataFrame(rows, SCHEMA)
    edges = store(weights.sensor_edges(frame, "prob"), "edges")
    given = {(1, "a"): 0.9, (1, "n1"): 0.2, (2, "n3"): 0.6}
    scores = Stored(spark.createDataFrame([(*k, v) for k, v in given.items()], "SensorId long, node string, PredictedProb_Node double"))
    degrees = subgraph.graph_degree(edges.table)
    scored = store(hosts.edge_probability(edges.table, scores, degrees), "scored")
    found = hosts.flow_probability(frame.drop("prob"), scored).collect()
    assert len(found) == len(rows)
    for r in found:
        best = max(given.get((r["SensorId"], r["SrcAddr"]), 0.0), given.get((r["SensorId"], r["DstAddr"]), 0.0))
        assert r["PredictedProb"] == best and r["PredictedLabel"] == int(best >= 0.5)


def test_nothing_flagged_gives_an_empty_subgraph(spark):
    rows = [(1, "a", "b", 0, 0.1), (1, "b", "c", 0, 0.1)]
    found = detect(spark.createDataFrame(rows, SCHEMA), "prob")
    graph = found.subgraph()
    assert (found.nodes.count(), graph.nodes.count(), graph.edges.count()) == (3, 0, 0)


def test_scores_do_not_depend_on_partitioning(spark):
    frame = spark.createDataFrame(flows(seed=3, n=600), SCHEMA)
    one = detect(frame.coalesce(1), "prob").nodes.collect()
    many = detect(frame.repartition(13, "prob"), "prob").nodes.collect()
    key = lambda r: (r["SensorId"], r["node"])
    for a, b in zip(sorted(one, key=key), sorted(many, key=key)):
        assert a["cnc_score"] == pytest.approx(b["cnc_score"]) and (a["Role"], a["strict"]) == (b["Role"], b["strict"])
