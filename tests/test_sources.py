"""Line numbers, types of text columns and the report on raw rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from wireloom.plans import catalog
from wireloom.schema import FLOW
from wireloom.sources import files
from wireloom.sources.order_flows import order_flows


def test_line_numbers_across_blocks(spark, tmp_path):
    """Files of many blocks, of none, and with headers in all places."""
    lines = {
        "long.csv": ["StartTime,x"] + [f"{i},{'y' * (i % 90)}" for i in range(3000)] + ["StartTime,z", ""],
        "short.csv": ["a,b", "StartTime,"], "empty.csv": [], "one.csv": ["StartTime,only"],
    }
    for name, text in lines.items():
        (tmp_path / name).write_text("\n".join(text))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "64")
    try:
        found = files.numbered_lines(spark, str(tmp_path))
        assert found.rdd.getNumPartitions() > 20
        got = {}
        for r in found.collect():
            got.setdefault(r.file.split("/")[-1], {})[r.line] = r.value
        headers = {(r.file.split("/")[-1], r.line) for r in files.header_lines(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    lines["long.csv"] = lines["long.csv"][:-1]  # a last empty line is only the end of the one before
    assert got == {n: dict(enumerate(text, 1)) for n, text in lines.items() if text}
    assert headers == {(n, i) for n, text in lines.items() for i, line in enumerate(text, 1) if line.startswith("StartTime,")}


def test_line_numbers_across_parts(spark, tmp_path):
    """Parts of a folder follow each other by number, also beyond five digits; folders are apart."""
    parts = {"a/part-00001-x.txt": "1\n2", "a/part-99999-x.txt": "3\nStartTime,", "a/part-100000-x.txt": "5\n6", "b/part-00000-x.txt": "1\nStartTime,\n3"}
    for name, text in parts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    found = files.numbered_lines(spark, f"{tmp_path}/*", in_parts=True).collect()
    assert {(r.file[-1], r.line, r.value) for r in found} == {
        *(("a", i, "StartTime," if i == 4 else str(i)) for i in range(1, 7)), *(("b", i, "StartTime," if i == 2 else str(i)) for i in range(1, 4)),
    }
    assert {(r.file[-1], r.line) for r in files.header_lines(spark, f"{tmp_path}/*", in_parts=True).collect()} == {("a", 4), ("b", 2)}


def test_no_task_writes_all_lines_of_a_sensor(spark, folder, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "scratch_path", lambda session, name: str(tmp_path / name))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {(r.SensorId, r.line) for r in catalog.queries()["header_line_numbers"](spark, folder).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    own = [p.parent.name for p in (tmp_path / "lines").glob("*/part-*")]
    assert all(own.count(f"own_SensorId={k}") >= 2 for k in (1, 2, 3)) and len(own) >= 8
    ports = {}
    for r in order_flows(spark, folder).select("SensorId", "Sport").collect():
        ports.setdefault(r.SensorId, []).append(r.Sport)
    assert found == {(k, i) for k, ps in ports.items() for i, p in enumerate(sorted(ps), 1) if p % 50 == 0}


def test_kinds_of_many_columns_are_compiled(spark):
    wide = spark.range(50).select(*[F.col("id").cast("string").alias(f"c{i}") for i in range(60)])
    counted = files.kind_counts(wide)
    assert {(r.place, r.n, r.BIGINT) for r in counted.collect()} == {(i, 50, 50) for i in range(60)}
    final = counted._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert all("*(" in line for line in final.splitlines() if "HashAggregate" in line or "Generate" in line)


COLUMNS = {
    "whole": (["1", "-20", "+3", None], "BIGINT", 0), "large": (["1", "99999999999999999999", "2"], "DOUBLE", 0),
    "mixed": (["1", "2.5", "1e3", "nan", "-.5"], "DOUBLE", 0), "words": (["a", "1", "2"], "VARCHAR", 1),
    "flags": (["true", "FALSE", None], "BOOLEAN", 0), "days": (["2001-02-03", "1999-12-31"], "DATE", 0),
    "times": (["2001-02-03 10:00:00", "2001-02-03T10:00:00.25", "2001-02-03"], "TIMESTAMP", 0),
    "no_day": (["2001-02-30", "2001-02-03"], "VARCHAR", 1), "none": ([None], "VARCHAR", 0), "texts": (["a", "b"], "VARCHAR", 0),
    "suffix": (["1d", "2f"], "VARCHAR", 0), "newline": (["1\n", "2"], "VARCHAR", 1), "tie": (["1", "true"], "VARCHAR", 1),
    "odd `name.": (["7"], "BIGINT", 0),
}


def test_types_of_text_columns(spark):
    height = max(len(v) for v, *_ in COLUMNS.values())
    rows = list(zip(*[v + [None] * (height - len(v)) for v, *_ in COLUMNS.values()]))
    schema = ", ".join(f"c{i} string" for i in range(len(COLUMNS)))
    names = [n.replace("`", "") for n in COLUMNS]
    frame = spark.createDataFrame(rows, schema).toDF(*names).repartition(3)
    found = {r.Column: (r.Type, r["values"], r.nulls, r.conflicts) for r in files.type_report(frame).collect()}
    filled = {n: sum(x is not None for x in v) for n, (v, *_) in zip(names, COLUMNS.values())}
    assert found == {n: (t, filled[n], height - filled[n], c) for n, (_, t, c) in zip(names, COLUMNS.values())}
    empty = files.type_report(spark.createDataFrame([], "a string, b string")).collect()
    assert [tuple(r) for r in empty] == [("a", "VARCHAR", 0, 0, 0), ("b", "VARCHAR", 0, 0, 0)]


def test_types_agree_with_another_scan(spark, folder, tmp_path):
    path = str(tmp_path / "flows")
    order_flows(spark, folder).coalesce(1).write.options(**files.CSV_TEXT).csv(path)
    found = {r.Column: r.Type for r in files.infer_schema(spark, path).collect()}
    sniffed = duckdb.sql(f"DESCRIBE SELECT * FROM read_csv('{path}/*.csv', header = true, sample_size = -1)").limit(50).fetchall()
    assert found == {r[0]: r[1] for r in sniffed}


def raw_rows(spark, rows):
    blank = {c: None for c in FLOW.names}
    good = {
        "StartTime": "2011/08/10 09:46:59.607", "Dur": "1.5", "Proto": "tcp", "SrcAddr": "1.2.3.4", "Dir": "->", "DstAddr": "5.6.7.8",
        "TotPkts": "3", "TotBytes": "99", "Label": "flow=Background", "SensorId": "1",
    }
    full = [tuple((blank | good | r)[c] for c in FLOW.names) for r in rows]
    return spark.createDataFrame(full, ", ".join(f"{c} string" for c in FLOW.names)).repartition(3)


def test_ingest_report(spark):
    rows = [
        {}, {}, {c: c for c in FLOW.names}, {"StartTime": None}, {"StartTime": "soon"}, {"Label": None, "SrcAddr": "::1"}, {"SrcAddr": "::1"},
        {"SrcAddr": None}, {"Dur": "NaN"}, {"Dur": "slow", "TotBytes": "x"}, {"TotPkts": None}, {"SrcBytes": "1.5"}, {"Sport": "0x1F"},
    ]
    found = {(r.step, r.column): r.rows for r in files.ingest_report(raw_rows(spark, rows)).collect()}
    assert {k: n for k, n in found.items() if n} == {
        ("read", None): 13, ("repeated header", None): 1, ("unparsable", "StartTime"): 1, ("unparsable", "Dur"): 1,
        ("unparsable", "TotBytes"): 1, ("unparsable", "SrcBytes"): 1, ("unparsable", "Sport"): 1, ("without label", None): 1,
        ("bad source", None): 2, ("incomplete", None): 3, ("kept", None): 6,
    }
    assert set(c for s, c in found if s == "unparsable") == set(FLOW.names)
    nothing = files.ingest_report(raw_rows(spark, [])).agg(F.sum("rows").alias("n")).first()
    assert nothing["n"] == 0
