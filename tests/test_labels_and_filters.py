import pytest
from pyspark.sql import functions as F

from wireloom.functions import labels, ratios
from wireloom.operators import clean
from wireloom.schema import FLOW, KEY_COLUMNS
from wireloom.sources import files


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


@pytest.mark.parametrize(
    "text, expected",
    [
        ("flow=From-Botnet-V42", 1), ("from_botnet", 0), ("to_botnet", 0), ("BOTNET_V1", 0),
        ("Botnet V1", 1), ("c&c", 1), ("attack!", 1), ("0.5", 1), ("0.49", 0), ("1d", 0), ("2f", 0),
        ("NaN", 0), (" 5 ", 1), ("1.", 1), ("\t.5\n", 1), ("1e3", 1), ("1e", 0), ("0x10", 0),
        ("inf", 1), ("+Infinity", 1), ("-INF", 0), (" 1e400", 0), ("normal", 0), ("", 0), (None, 0),
        ("robot", 0), ("DDoS flood", 1), ("ébot", 0),
    ],
)
def test_binary_label(spark, text, expected):
    found = column(spark, [text]).select(labels.binary_label(F.col("x")).alias("y")).first()["y"]
    assert found == expected


def test_botnet_flags(spark):
    texts = ["From-Botnet", "from_botnet", "TOBOTNET", "To-Botnet", "botnet", "normal", None]
    frame = column(spark, texts)
    patterns = (labels.FROM_BOTNET, labels.TO_BOTNET, labels.ANY_BOTNET)
    rows = frame.select(*[labels.has_text(F.col("x"), p) for p in patterns], labels.cnc_label(F.col("x"))).collect()
    assert [tuple(r) for r in rows] == [
        (True, False, True, 0), (True, False, True, 0), (False, True, True, 1), (False, True, True, 1),
        (False, False, True, 0), (False, False, False, 0), (False, False, False, 0),
    ]


def flow_frame(spark, **values):
    base = dict.fromkeys(FLOW.names)
    rows = len(next(iter(values.values())))
    table = [tuple({**base, **{k: v[i] for k, v in values.items()}}.values()) for i in range(rows)]
    return spark.createDataFrame(table, FLOW)


def test_addresses(spark):
    sources = ["1.2.3.4", "5", "1..9", "::1", "00:1a", "1.2.3.4\n", "", None]
    frame = flow_frame(spark, SrcAddr=sources, Label=["x"] * 8)
    assert [r["SrcAddr"] for r in clean.valid_flows(frame).collect()] == ["1.2.3.4", "5", "1..9"]


def test_sensor_choice_and_missing_label(spark):
    frame = flow_frame(spark, SrcAddr=["1"] * 4, Label=["x", None, "x", "x"], SensorId=[1, 1, 2, None])
    assert clean.valid_flows(frame).count() == 3
    assert clean.valid_flows(frame, sensors=[1]).count() == 1


def test_incomplete_rows_go(spark):
    full = {"SrcAddr": "1", "DstAddr": "2", "Dir": "->", "Proto": "tcp", "Dur": 0.0, "TotBytes": 1, "TotPkts": 1, "Label": "x"}
    assert set(full) == set(KEY_COLUMNS)
    rows = [full] + [{**full, c: None} for c in full] + [{**full, "Dur": float("nan")}]
    frame = flow_frame(spark, **{c: [r[c] for r in rows] for c in full})
    assert clean.drop_incomplete(frame).count() == 1


def test_empty_input_is_an_error(spark):
    with pytest.raises(ValueError):
        clean.require_rows(spark.createDataFrame([], FLOW))


def test_repeated_headers(spark):
    rows = [("StartTime", "Label"), (None, "a"), ("2020", "b"), ("StartTime", "Label")]
    frame = spark.createDataFrame(rows, "StartTime string, Label string")
    assert [r["Label"] for r in clean.drop_repeated_headers(frame).collect()] == ["a", "b"]
    other = frame.withColumnRenamed("StartTime", "Begin")
    assert clean.drop_repeated_headers(other).count() == 4
    assert files.clean_report(frame).first().asDict() == {"kept": 2, "removed": 2}


def test_direction_codes(spark):
    arrows = ["->", "<-", "<->", "   ->", "<?>", None]
    frame = column(spark, arrows)
    plain = frame.select(ratios.direction_code(F.col("x"))).collect()
    trimmed = frame.select(ratios.direction_code(F.col("x"), trim=True)).collect()
    assert [r[0] for r in plain] == [1, -1, 0, 0, 0, 0]
    assert [r[0] for r in trimmed] == [1, -1, 0, 1, 0, 0]


def test_finite_or_zero(spark):
    frame = column(spark, [1.5, None, float("nan"), float("inf"), float("-inf")], "double")
    assert [r[0] for r in frame.select(ratios.finite_or_zero(F.col("x"))).collect()] == [1.5, 0, 0, 0, 0]


def test_zero_denominator_becomes_zero(spark):
    frame = flow_frame(spark, TotPkts=[-1], TotBytes=[-1], Dur=[-1.0], SrcBytes=[3], sTos=[1.0])
    found = frame.withColumns(ratios.ratio_columns())
    assert found.first()["ByteRatio"] is None and found.first()["TrafficBalance"] is None
    assert found.select(ratios.finite_or_zero(F.col("Intensity"))).first()[0] == 0


HEADER = ",".join(FLOW.names)
ROW = "2011/08/10 09:46:53.047277,1.5,tcp,1.1.1.1,10,   ->,2.2.2.2,20,CON,0.0,,3,400,200,flow=To-Botnet,1,B,2"


def test_ingest_text(spark, tmp_path):
    raw = tmp_path / "raw.csv"
    raw.write_text("\n".join([HEADER, ROW, HEADER, ROW.replace("1.5", "oops"), HEADER]) + "\n")
    counted = files.count_header_lines(spark, str(raw)).first()
    assert (counted["headers"], counted["ok"]) == (3, False)
    assert {r["file"].rsplit("/", 1)[1] for r in files.header_lines(spark, str(raw)).collect()} == {"raw.csv"}
    for fmt in ("parquet", "csv"):
        target = str(tmp_path / f"clean-{fmt}")
        rows = files.convert_flows(spark, str(raw), target, fmt).orderBy(F.col("Dur").asc_nulls_last()).collect()
        assert [r["Dur"] for r in rows] == [1.5, None]
        assert rows[0]["Dir"] == "   ->" and rows[0]["SensorId"] == 2 and rows[0]["dTos"] is None
        assert rows[0]["StartTime"].microsecond == 47277
    described = files.describe_schema(files.read_flows(spark, str(tmp_path / "clean-parquet"), "parquet"))
    assert described.filter("`Column` = 'TotBytes'").first()["Type"] == "BIGINT"


def test_bot_count_is_case_sensitive(spark):
    frame = flow_frame(spark, Label=["From-Botnet", "from-botnet", "Bot"], Dir=["  -> ", "->", "<-"], SensorId=[2, 2, 2])
    assert clean.count_bot_flows(frame, 2).first()["flows"] == 1
