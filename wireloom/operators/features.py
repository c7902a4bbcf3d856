"""The feature matrix."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wireloom.functions import ratios
from wireloom.operators.lookup import attach
from wireloom.operators.ranks import ordinal_codes
from wireloom.session import Stored, store


CODED = ["Proto", "State"]


def fit_codes(flows: DataFrame, columns: list[str] = CODED) -> Stored:
    """The ordinal codes of the values of text columns."""
    return store(ordinal_codes(flows, columns), "codes")


def encode_ordinal(rows: DataFrame, columns: list[str], codes: Stored | None = None) -> DataFrame:
    """Replace string columns by the ordinal codes of their values; given codes leave -1 for values they don't know."""
    known = codes is not None
    codes = codes or fit_codes(rows, columns)
    for column in columns:
        own = codes.table.filter(F.col("column") == column)
        lookup = Stored(own.select(F.col("value").alias(column), "code", "rows"), codes.rows)
        filled = rows.withColumn(column, F.coalesce(F.col(column), F.lit("None")))
        coded = attach(filled, lookup, [column], "rows")
        code = F.coalesce("code", F.lit(-1)) if known else F.col("code")
        rows = coded.withColumn(column, code).select(*rows.columns)
    return rows


def flow_features(flows: DataFrame, trim_dir: bool = False, codes: Stored | None = None) -> DataFrame:
    """Direction code, protocol and state codes, and the ratios."""
    directed = flows.withColumns(
        {"Dir_raw": F.col("Dir"), "Dir": ratios.direction_code(F.col("Dir"), trim_dir)}
    )
    coded = encode_ordinal(directed, CODED, codes)
    return coded.withColumns(ratios.ratio_columns())


def clean_matrix(rows: DataFrame, features: list[str]) -> DataFrame:
    """The features as finite doubles, other columns as they are."""
    return rows.withColumns({f: ratios.finite_or_zero(F.col(f)) for f in features})


def assemble(rows: DataFrame, features: list[str], output: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol=output).transform(rows)


@dataclass(frozen=True)
class Standardizer:
    """Means and population deviations of the training rows; a constant feature is only centred."""

    means: dict[str, float]
    deviations: dict[str, float]

    @staticmethod
    def fit(rows: DataFrame, features: list[str]) -> Standardizer:
        aggregates = [F.avg(f).alias(f"m_{f}") for f in features]
        aggregates += [F.stddev_pop(f).alias(f"s_{f}") for f in features]
        row = rows.agg(*aggregates).first()
        return Standardizer(
            {f: row[f"m_{f}"] or 0.0 for f in features},
            {f: row[f"s_{f}"] or 1.0 for f in features},
        )

    def transform(self, rows: DataFrame) -> DataFrame:
        scaled = {
            f: (F.col(f) - F.lit(self.means[f])) / F.lit(self.deviations[f]) for f in self.means
        }
        return rows.withColumns(scaled)
