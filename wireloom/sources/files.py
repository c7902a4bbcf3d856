"""Raw flow files: scan, clean, convert, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType, StructField, StructType

from wireloom.operators.clean import ADDRESS, drop_repeated_headers
from wireloom.operators.lookup import attach
from wireloom.schema import FLOW, KEY_COLUMNS, SCAN_COLUMNS
from wireloom.session import store

# Type names of the schema report.
TYPE_NAMES = {
    "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "date": "DATE", "double": "DOUBLE",
    "float": "FLOAT", "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN",
}

# Keeps padded arrows and microseconds, both of which the CSV writer would cut.
CSV_TEXT = {
    "header": "true", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}


def read_flows(
    spark: SparkSession, path: str, fmt: str = "csv", columns: list[str] | None = None
) -> DataFrame:
    """Scan flows with the declared schema, reading only the given columns."""
    if fmt == "csv":
        frame = _by_header(spark, path, {f.name: f.dataType for f in FLOW.fields})
    else:
        frame = spark.read.schema(FLOW).format(fmt).load(path)
    return frame.select(columns or SCAN_COLUMNS)


def _by_header(spark: SparkSession, path: str, types: dict[str, DataType]) -> DataFrame:
    """Text with columns found by the names in its header, whatever their order; others are strings.

    Files of one folder must agree on the order: a file that doesn't fails instead of being misread.
    """
    names = spark.read.option("header", True).csv(path).columns
    schema = StructType([StructField(n, types.get(n, StringType())) for n in names])
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Flow text with a header, every column a string in the order of the flow schema."""
    return _by_header(spark, path, {}).select(FLOW.names)


def _cell(field: StructField) -> Column:
    text = F.col(field.name)
    if field.name == "StartTime":
        text = F.replace(text, F.lit("/"), F.lit("-"))
    return text.try_cast(field.dataType).alias(field.name)


def to_flow_types(raw: DataFrame) -> DataFrame:
    """Cast text columns to the flow schema; text that does not parse becomes null, which ``ingest_report`` counts."""
    return raw.select(*[_cell(field) for field in FLOW.fields])


def convert_flows(spark: SparkSession, source: str, target: str, fmt: str = "parquet") -> DataFrame:
    """Rewrite raw flow text as a clean typed dataset partitioned by sensor and return it."""
    typed = to_flow_types(drop_repeated_headers(read_raw(spark, source)))
    writer = typed.write.format(fmt)
    if fmt == "csv":
        writer.options(**CSV_TEXT).save(target)
    else:
        writer.partitionBy("SensorId").save(target)
    return read_flows(spark, target, fmt, FLOW.names)


def ingest_report(raw: DataFrame) -> DataFrame:
    """What becomes of raw text rows, in one pass: ``step``, ``column`` and ``rows``.

    ``read`` counts all rows, ``repeated header`` those that the header filter removes, ``unparsable`` the texts of a column
    that do not convert, ``without label``, ``bad source`` and ``incomplete`` the rows that the filters of a run drop in
    this order, and ``kept`` what is left.
    """
    repeated = F.col(raw.columns[0]).eqNullSafe(F.lit(raw.columns[0]))
    sides = raw.select(
        F.struct(*raw.columns).alias("_raw"),
        F.struct(*[_cell(f) for f in FLOW.fields]).alias("_typed"), repeated.alias("_header"),
    )
    body = ~F.col("_header")
    value = {c: F.col(f"_typed.{c}") for c in FLOW.names}
    labelled = body & value["Label"].isNotNull()
    sourced = labelled & F.coalesce(value["SrcAddr"].rlike(ADDRESS), F.lit(False))
    whole = sourced
    for name in KEY_COLUMNS:
        whole = whole & value[name].isNotNull()
        if FLOW[name].dataType.typeName() in ("double", "float"):
            whole = whole & ~F.isnan(value[name])
    steps = [("read", None, F.lit(True)), ("repeated header", None, F.col("_header"))]
    steps += [("unparsable", c, body & F.col(f"_raw.{c}").isNotNull() & value[c].isNull()) for c in FLOW.names]
    steps += [("without label", None, body & ~labelled), ("bad source", None, labelled & ~sourced)]
    steps += [("incomplete", None, sourced & ~whole), ("kept", None, whole)]
    counts = sides.agg(*[F.count_if(test).alias(f"c{i}") for i, (_, _, test) in enumerate(steps)])
    lines = [F.struct(F.lit(s).alias("step"), F.lit(c).cast("string").alias("column"), F.col(f"c{i}").alias("rows")) for i, (s, c, _) in enumerate(steps)]
    return counts.select(F.inline(F.array(*lines)))


def frame_shape(frame: DataFrame) -> DataFrame:
    return frame.agg(F.count("*").alias("rows"), F.lit(len(frame.columns)).alias("columns"))


def clean_report(raw: DataFrame, key: str = "StartTime") -> DataFrame:
    """Rows kept and removed by the header filter, in one pass."""
    repeated = F.col(raw.columns[0]).eqNullSafe(F.lit(key))
    return raw.agg(F.count_if(~repeated).alias("kept"), F.count_if(repeated).alias("removed"))


def numbered_lines(spark: SparkSession, path: str, in_parts: bool = False) -> DataFrame:
    """Every line of the text files with its ``file`` and its number in it, ``line``, from 1.

    With ``in_parts`` a folder stands for one file, which Spark wrote in parts: they follow each other by their numbers.

    Lines are counted for each block that the scan splits a file into; the lines of earlier blocks are added to the place
    inside the block. Only blocks are ordered, one row each, and no line is shuffled. Both passes read one listing of the
    files and split them alike.
    """
    text = F.regexp_replace("file", "/[^/]*$", "") if in_parts else F.col("file")
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("_at"),
    )
    counted = lines.groupBy("file", "block").agg(F.count("*").alias("lines"), F.min("_at").alias("_first"))
    order = [F.length("file"), F.col("file"), F.col("block")]  # part numbers of over five digits make longer names
    earlier = Window.partitionBy(text).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    blocks = store(
        counted.select("file", "block", "_first", F.coalesce(F.sum("lines").over(earlier), F.lit(0)).alias("_before"), "lines"), "blocks"
    )
    placed = attach(lines, blocks, ["file", "block"], "lines", how="inner")
    number = F.col("_before") + F.col("_at") - F.col("_first") + 1
    return placed.select(text.alias("file"), number.alias("line"), "value")


def header_lines(spark: SparkSession, path: str, key: str = "StartTime", in_parts: bool = False) -> DataFrame:
    """Lines that look like the header, with the file they are in and their number there."""
    return numbered_lines(spark, path, in_parts).filter(F.col("value").startswith(f"{key},"))


def count_header_lines(spark: SparkSession, path: str, key: str = "StartTime") -> DataFrame:
    """How many header lines there are; a clean single file has exactly one."""
    lines = spark.read.text(path).filter(F.col("value").startswith(f"{key},"))
    counted = lines.agg(F.count("*").alias("headers"))
    return counted.withColumn("ok", F.col("headers") == 1)


#: What text may be, the narrowest first, as a pattern and a type it must also convert to.
KINDS = {
    "BOOLEAN": (r"(?i)^(true|false)\z", "boolean"),
    "BIGINT": (r"^[+-]?[0-9]+\z", "bigint"),
    "DOUBLE": (r"(?i)^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|nan|inf|infinity)\z", "double"),
    "DATE": (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z", "date"),
    "TIMESTAMP": (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,9})?)?\z", "timestamp_ntz"),
}


def kind_counts(texts: DataFrame) -> DataFrame:
    """For each column, by its place: its texts, its nulls, and how many texts are of each kind.

    A cell is a row here, so that the expressions are the same few for all columns, however many there are: Spark compiles
    these, and doesn't compile an aggregate of over a hundred sums. Patterns that others include are tried after those.
    """
    text, long = F.col("text"), F.octet_length("text")
    fits = {k: text.rlike(pattern) for k, (pattern, _) in KINDS.items()}
    cells = texts.select(F.posexplode(F.array(*[F.col(f"`{c}`") for c in texts.columns])).alias("place", "text")).select(
        "place", "text", fits["DOUBLE"].alias("number"), (long.between(10, 29) & fits["TIMESTAMP"]).alias("moment")
    )
    of = {
        "BOOLEAN": long.between(4, 5) & fits["BOOLEAN"],
        "BIGINT": F.col("number") & fits["BIGINT"],
        "DOUBLE": F.col("number"),  # the pattern says it all
        "DATE": F.col("moment") & (long == 10),
        "TIMESTAMP": F.col("moment"),
    }
    converts = {k: text.try_cast(KINDS[k][1]).isNotNull() for k in ("BIGINT", "DATE", "TIMESTAMP")}
    sums = [F.count_if(test & converts[k] if k in converts else test).alias(k) for k, test in of.items()]
    return cells.groupBy("place").agg(F.count("text").alias("n"), F.count_if(text.isNull()).alias("none"), *sums)


def type_report(texts: DataFrame) -> DataFrame:
    """For each text column its narrowest type, from one aggregate over all cells.

    A column has a type if all its values do; dates are timestamps as well, and whole numbers are doubles. Columns without
    values, and those whose values agree on nothing, are text. ``values`` and ``nulls`` are counted, and ``conflicts``: the
    values that keep the column from the type that most of them have.
    """
    counts = {r["place"]: r.asDict() for r in kind_counts(texts).collect()}  # a row for each column
    nothing = dict.fromkeys(["n", "none", *KINDS], 0)
    rows = []
    for i, name in enumerate(texts.columns):
        found = counts.get(i, nothing)
        n, fitting = found["n"], {k: found[k] for k in KINDS}
        kind = next((k for k in KINDS if n and fitting[k] == n), "VARCHAR")
        most = max(fitting.values())
        rows.append((name, kind, n, found["none"], 0 if kind != "VARCHAR" else (n - most) * (most > 0)))
    schema = "`Column` string, `Type` string, `values` bigint, nulls bigint, conflicts bigint"
    return texts.sparkSession.createDataFrame(rows, schema)


def infer_schema(spark: SparkSession, path: str) -> DataFrame:
    """Types found by a full scan of a text file with header."""
    return type_report(_by_header(spark, path, {})).select("Column", "Type")


def describe_schema(frame: DataFrame) -> DataFrame:
    """One row per column: its name and type."""
    return frame.sparkSession.createDataFrame(_types(frame), "`Column` string, `Type` string")


def _types(frame: DataFrame) -> list[tuple[str, str]]:
    return [(name, TYPE_NAMES.get(kind, kind.upper())) for name, kind in frame.dtypes]
