import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wireloom.operators import ranks
from wireloom.operators.lookup import attach
from wireloom.session import Stored, store


@pytest.mark.parametrize("how", ["left", "inner"])
def test_split_join_equals_plain_join(spark, how):
    pick = random.Random(1)
    # One key holds a third of the rows, some keys are unknown to the lookup.
    keys = ["hot"] * 1000 + [f"k{pick.randrange(300)}" for _ in range(2000)]
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, i int")
    sizes = Counter(keys)
    table = spark.createDataFrame([(k, n, len(k)) for k, n in sizes.items() if k != "k7"], "k string, n long, v int")
    lookup = Stored(table)
    plain = sorted(rows.join(table, ["k"], how).collect(), key=lambda r: r["i"])
    for heavy in (1, 3, 1000):
        split = attach(rows, lookup, ["k"], "n", how, broadcast_cells=0, heavy_keys=heavy)
        assert sorted(split.collect(), key=lambda r: r["i"]) == plain
    small = attach(rows, lookup, ["k"], "n", how)
    assert sorted(small.collect(), key=lambda r: r["i"]) == plain


def test_heavy_keys_absent_from_the_lookup(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(50)] + [("a", 1), ("b", 2)], "k string, i int")
    sizes = spark.createDataFrame([("hot", 50), ("a", 1), ("b", 1)], "k string, n long")
    table = Stored(spark.createDataFrame([("a", 7)], "k string, v int"))
    found = attach(rows, table, ["k"], "n", sizes=sizes, broadcast_cells=0, heavy_keys=1)
    assert Counter((r["k"], r["v"]) for r in found.collect()) == {("hot", None): 50, ("a", 7): 1, ("b", None): 1}


def test_rows_of_a_split_join_are_read_once(spark):
    rows = spark.range(10, 20).select((F.col("id") % 7).alias("k"))
    lookup = store(spark.range(5).select(F.col("id").alias("k"), F.lit(1).alias("n")), "lookup")
    split = attach(rows, lookup, ["k"], "n", broadcast_cells=0, heavy_keys=2)
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (10, 20") == 1 and "Union" not in plan and "CartesianProduct" not in plan


def test_heavy_rows_are_dealt_over_all_partitions(spark):
    """Also those whose key the lookup lacks: after the join no partition holds more than its share."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(8000).select(F.when(F.col("id") % 2 == 0, "lost").otherwise("held").alias("k"))
        sizes = spark.createDataFrame([("lost", 4000), ("held", 4000)], "k string, n long")
        table = Stored(spark.createDataFrame([("held", 7), ("other", 8)], "k string, v int"))
        joined = attach(rows, table, ["k"], "n", sizes=sizes, broadcast_cells=0, heavy_keys=2)
        spread = joined.groupBy(F.spark_partition_id().alias("p"), "k", "v").count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert {(r["k"], r["v"]) for r in spread} == {("lost", None), ("held", 7)}
    assert max(r["count"] for r in spread) < 1000 and sum(r["count"] for r in spread) == 8000


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, descending):
    pick = random.Random(2)
    rows = [(g, v, pick.randrange(5)) for g in ("a", "b") for v in range(200)]
    pick.shuffle(rows)
    frame = spark.createDataFrame(rows, "g string, v int, n long").repartition(5)
    order = F.desc("v") if descending else F.col("v")
    found = ranks.running_totals(frame, ["g"], order, ["n"]).collect()
    for r in found:
        before = [n for g, v, n in rows if g == r["g"] and (v >= r["v"] if descending else v <= r["v"])]
        assert r["n_upto"] == sum(before)
    assert len(found) == len(rows)


def test_running_totals_span_slices(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = spark.range(1000).select(F.col("id").alias("v"), F.lit(1).alias("one"))
        found = ranks.running_totals(frame, [], F.col("v"), ["one"])
        assert found.filter("one_upto <> v + 1").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_quantiles_match_numpy(spark):
    pick = random.Random(3)
    groups = {1: [pick.random() for _ in range(101)], 2: [0.0] * 50 + [1.0, 2.0], 3: [4.5], 4: [1.0, 2.0]}
    frame = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g int, v double")
    sizes = store(frame.groupBy("g").agg(F.count("*").alias("size")), "sizes")
    for q in (0.0, 0.5, 0.95, 1.0):
        found = {r["g"]: r["x"] for r in ranks.quantiles(frame, "g", "v", q, "x", sizes, "size").collect()}
        assert found == {g: pytest.approx(np.percentile(vs, q * 100), abs=1e-12) for g, vs in groups.items()}


def test_ordinal_codes(spark):
    frame = spark.createDataFrame([("tcp", "b"), ("udp", None), ("icmp", "S"), ("tcp", "a")], "p string, s string")
    found = {(r["column"], r["value"]): (r["code"], r["rows"]) for r in ranks.ordinal_codes(frame, ["p", "s"]).collect()}
    assert found == {
        ("p", "icmp"): (0, 1), ("p", "tcp"): (1, 2), ("p", "udp"): (2, 1),
        ("s", "None"): (0, 1), ("s", "S"): (1, 1), ("s", "a"): (2, 1), ("s", "b"): (3, 1),
    }


def test_top_k_ties_and_early_cut(spark):
    frame = spark.createDataFrame([(1, "b", 2.0), (1, "a", 2.0), (1, "c", 3.0), (2, "z", 0.0)], "g int, node string, s double")
    best = ranks.top_k(frame, "g", [F.desc("s"), F.col("node")], 2)
    assert sorted((r["g"], r["rank"], r["node"]) for r in best.collect()) == [(1, 1, "c"), (1, 2, "a"), (2, 1, "z")]
    assert "WindowGroupLimit" in best._jdf.queryExecution().executedPlan().toString()
