"""Registered queries against their SQL, and the shape of their plans."""

import pytest
from check_queries import connect, difference

import __spark_entry__
from wireloom.plans import catalog, oracles, detect as plan
from wireloom.operators import features, weights
from wireloom.schema import FEATURES

SQL = oracles.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(catalog.queries())
    rows_only = set(catalog.queries()) - set(SQL)
    assert rows_only == {
        "node_classifier", "detect_by_host", "base_predict", "stack_predict", "forest_predict", "stacked_detection",
    }


@pytest.mark.parametrize("name", SQL)
def test_query_matches_sql(spark, con, folder, name):
    assert difference(catalog.queries()[name](spark, folder), con, SQL[name]) is None


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 462


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_plans_stay_in_the_engine(spark, folder):
    flows = catalog.prepared(spark, folder)
    found = plan.detect(flows, "prob")
    graph = found.subgraph()
    frames = [
        flows, weights.sensor_edges(flows, "prob"), weights.flow_weights(flows), found.nodes, found.summary(),
        graph.nodes, graph.edges, features.clean_matrix(features.flow_features(weights.flow_weights(flows)), FEATURES),
    ]
    for text in map(plan_of, frames):
        assert "Python" not in text and "CartesianProduct" not in text
        assert "BroadcastNestedLoopJoin" not in text and "Exchange SinglePartition" not in text


def test_scan_reads_only_what_is_needed(spark, tmp_path, folder):
    from wireloom.sources import files
    from wireloom.sources.order_flows import order_flows

    path = str(tmp_path / "flows")
    order_flows(spark, folder).write.partitionBy("SensorId").parquet(path)
    flows = plan.prepare(files.read_flows(spark, path, "parquet"), sensors=[2])
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = plan_of(weights.sensor_edges(flows))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "SensorId#" in text.split("PartitionFilters: [")[1].split("]")[0]
    assert "IsNotNull(Label)" in text and "IsNotNull(Dur)" in text
    schema = text.split("ReadSchema: struct<")[1].split(">")[0]
    assert "StartTime" not in schema and "sTos" not in schema and "SrcBytes" not in schema


def test_host_queries_cover_every_feature(spark, folder):
    found = set(catalog.queries()["node_features"](spark, folder).columns)
    assert {f"{s}_{f}_{k}" for s in ("src", "dst") for f in FEATURES for k in ("mean", "count")} <= found
