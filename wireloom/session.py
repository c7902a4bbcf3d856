"""Session defaults and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_folders: dict[str, tempfile.TemporaryDirectory] = {}

#: Lets Spark delete a query's shuffle files as soon as it ends, instead of when the driver collects its garbage.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "wireloom", **conf: str) -> SparkSession:
    """A session with adaptive execution on; cluster settings come from spark-submit or ``conf``."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may do without the setting; it then gets a temporary folder for the process.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.TemporaryDirectory(prefix="wireloom-")
    return _local_folders[context.applicationId].name


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, never used before."""
    run = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/wireloom/{run}/{name}-{uuid.uuid4().hex}"


class Stored:
    """A table whose row count may be asked for: counted once, from file metadata where it is a file."""

    def __init__(self, table: DataFrame, rows: int | None = None):
        self.table = table
        self._rows = rows

    @property
    def rows(self) -> int:
        if self._rows is None:
            self._rows = self.table.count()
        return self._rows


def store(frame: DataFrame, name: str, tidy: bool = False) -> Stored:
    """Write ``frame`` once and read it back: later plans start here and survive lost executors.

    ``tidy``: the shuffle files of this write go with its end. Not for writes that run side by side.
    """
    spark = frame.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(FILE_CLEANUP, None)
    if tidy:
        spark.conf.set(FILE_CLEANUP, "true")
    try:
        frame.write.parquet(path)
    finally:
        if tidy and before is None:
            spark.conf.unset(FILE_CLEANUP)
        elif tidy:
            spark.conf.set(FILE_CLEANUP, before)
    return Stored(spark.read.schema(frame.schema).parquet(path))
