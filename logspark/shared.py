"""Tables that jobs keep between steps: the shared folder, cutting lineage, and versions that count once they are committed."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import ship

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where that is unset and Spark runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = _own.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="spark-shared-")
        _own[spark.sparkContext.applicationId] = named
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: its lineage ends there, so a lost executor costs nothing."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_sequence(rows: DataFrame, key: list[str], *order: str | Column) -> DataFrame:
    """rows with those of a key in one partition, one after another in order: for folds that keep a few values and stream, so that a group of any size fits."""
    spark = ship(rows.sparkSession)
    return rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *key).sortWithinPartitions(*key, *order)


def read_or_none(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """A table, or None where there is no such folder."""
    try:
        reader = spark.read if schema is None else spark.read.schema(schema)
        df = reader.parquet(path)
        df.schema  # noqa: B018  the path is resolved here
        return df
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None


class Versions:
    """Tables of numbered versions under one folder, as streams write them, a version a batch.

    A version's tables are written first, each to a folder of its number, and then named in the commit log by a row in a file of its own, which Spark puts in place with
    one rename. Tables of a version without that row don't count: a job that dies between two tables leaves nothing that a reader sees, and the batch that runs again
    replaces what it finds. A batch that was committed isn't written again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def committed(self) -> int | None:
        """The newest committed version. Batches run one after another, so all before it are committed, too."""
        log = read_or_none(self.spark, f"{self.path}/_commits", "version bigint")
        return None if log is None else log.agg(F.max("version")).first()[0]

    def folder(self, table: str, version: int) -> str:
        return f"{self.path}/{table}/version={version}"

    def write(self, table: str, version: int, df: DataFrame, **options) -> None:
        writer = df.write.mode("overwrite")
        if "partition_by" in options:
            writer = writer.partitionBy(*options["partition_by"])
        writer.parquet(self.folder(table, version))

    def read(self, table: str, version: int) -> DataFrame | None:
        return read_or_none(self.spark, self.folder(table, version))

    def read_all(self, table: str) -> DataFrame | None:
        """All committed versions of a table, with the column version."""
        last, df = self.committed(), read_or_none(self.spark, f"{self.path}/{table}")
        return None if df is None or last is None else df.where(F.col("version") <= last)

    def commit(self, version: int) -> None:
        self.spark.createDataFrame([(version,)], "version bigint").coalesce(1).write.mode("append").parquet(f"{self.path}/_commits")
