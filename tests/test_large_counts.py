"""Counts beyond what small tables hold, and draws that don't depend on partitions."""

import pytest
from pyspark.sql import functions as F

from wireloom.operators import hosts, nodes, ranks, sample, weights
from wireloom.sources import files


@pytest.mark.parametrize("flows", [3_000_000, 4_000_000_000])
def test_heavy_pairs_do_not_overflow(spark, flows):
    edges = spark.createDataFrame(
        [(1, "1.1.1.1", "2.2.2.2", flows, flows, 1, flows, flows * 0.5)],
        "SensorId long, SrcAddr string, DstAddr string, w_sensor long, w_global long, label_cnc int, n_prob long, sum_prob double",
    )
    pairs = edges.select("SrcAddr", "DstAddr", F.col("w_global").alias("EdgeWeight"))
    totals = weights.weighted_pairs(pairs)
    assert totals.first()["SrcTotalWeight"] == float(flows) ** 2
    found = hosts.node_features(edges, totals, ["EdgeWeight", "SrcTotalWeight", "DstTotalWeight"]).filter("node = '1.1.1.1'").first()
    assert found["src_SrcTotalWeight_mean"] == pytest.approx(float(flows) ** 2)
    stats = nodes.node_stats(edges).filter("node = '2.2.2.2'").first()
    assert stats["dst_total_weight"] == float(flows) ** 2


def rows_with_ties(spark):
    return spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("x"),
        F.when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id") % 2).cast("int").alias("Label"),
    )


def test_draws_depend_on_content_only(spark):
    rows, found = rows_with_ties(spark), []
    for parts in (2, 7):
        drawn = sample.with_draw(rows.repartition(parts))
        split = sample.split_rows(drawn).groupBy("x", "Label", "split").count().collect()
        taken = sample.sample_rows(drawn, 1000).groupBy("x", "Label").count().collect()
        found.append((sorted(map(str, split)), sorted(map(str, taken))))
        assert sum(r["count"] for r in taken) == 1000
        by = {}
        for r in split:
            by[r.Label, r.split] = by.get((r.Label, r.split), 0) + r["count"]
        for label in (0, 1, None):
            total = by[label, "train"] + by[label, "test"]
            assert abs(by[label, "train"] - 0.7 * total) <= 1
    assert found[0] == found[1]


def test_top_k_in_slices(spark):
    rows = spark.range(20_000).select((F.col("id") % 2).alias("g"), F.xxhash64("id").alias("s"), F.col("id").alias("node"))
    best = ranks.top_k(rows, "g", [F.desc("s"), F.col("node")], 1500)
    plain = {g: sorted(((-r.s, r.node) for r in rows.collect() if r.g == g))[:1500] for g in (0, 1)}
    got = best.collect()
    assert len(got) == 3000 and all(plain[r.g][r.rank - 1] == (-r.s, r.node) for r in got)


def test_columns_are_found_by_name(spark, tmp_path, folder):
    from wireloom.sources.order_flows import order_flows

    flows = order_flows(spark, folder).limit(50).cache()
    names = flows.columns
    swapped = [n for n in names if n not in ("SrcAddr", "DstAddr")] + ["DstAddr", "SrcAddr"]
    flows.select(swapped).coalesce(1).write.options(**files.CSV_TEXT).csv(str(tmp_path / "swapped"))
    back = files.read_flows(spark, str(tmp_path / "swapped"), columns=["SrcAddr", "DstAddr"])
    assert sorted(back.collect()) == sorted(flows.select("SrcAddr", "DstAddr").collect())
    raw = files.read_raw(spark, str(tmp_path / "swapped"))
    assert sorted(raw.select("SrcAddr").collect()) == sorted(flows.select("SrcAddr").collect())


def test_types_are_told_as_they_are(spark):
    frame = spark.createDataFrame([(1, 1.0)], "a int, b float")
    assert [tuple(r) for r in files.describe_schema(frame).collect()] == [("a", "INTEGER"), ("b", "FLOAT")]


def test_null_groups_keep_their_totals(spark):
    rows = spark.createDataFrame([(None, 1, 2), (None, 2, 3), (1, 1, 5)], "g int, o int, n int")
    got = {(r.g, r.o): r.n_upto for r in ranks.running_totals(rows, ["g"], F.col("o"), ["n"]).collect()}
    assert got == {(None, 1): 2, (None, 2): 5, (1, 1): 5}
