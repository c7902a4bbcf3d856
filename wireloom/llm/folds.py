"""Which rows a model may learn from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_fold(key: str, remainder: int, folds: int = 5) -> Column:
    """Whether crc32 of the key as text leaves ``remainder``; false for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds == remainder, F.lit(False))
