"""The event store: Parquet by app and UTC day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.filters import VARIANT
from ..functions.text import property_text
from ..operators.traces import with_spans
from ..schema import LOG_EVENT
from ..shared import Versions

COLUMNS = [c.split()[0] for c in LOG_EVENT.split(", ")]


def dealt(events: DataFrame, salt: int = 8) -> DataFrame:
    """Events by app and day, in order of their ids; a hot app-day is dealt to several tasks."""
    return events.repartition("app_id", "day", F.pmod(F.xxhash64("id"), F.lit(salt))).sortWithinPartitions("app_id", "day", "id")


def write_events(events: DataFrame, path: str, promoted: tuple[str, ...] = (), mode: str = "append", salt: int = 8, rows_a_file: int = 5_000_000, spans: bool = False) -> None:
    """Stores events; promoted properties become real columns p_<name>, and with spans the start and the parent of a span do, as traces read them. A hot app-day goes to several files."""
    if spans:
        events = with_spans(events).drop("event_id")
    if promoted:
        bag = events.withColumn(VARIANT, F.try_parse_json("properties"))
        events = bag.select(*events.columns, *[property_text(VARIANT, p).alias(f"p_{p}") for p in promoted])
    dealt(events, salt).write.mode(mode).option("maxRecordsPerFile", rows_a_file).partitionBy("app_id", "day").parquet(path)


def read_events(spark: SparkSession, path: str, apps: list[str] | None = None, start=None, end=None) -> DataFrame:
    """Stored events; apps and days (inclusive) prune partitions."""
    return _pruned(spark.read.parquet(path), apps, start, end)


def _pruned(df: DataFrame, apps: list[str] | None, start, end) -> DataFrame:
    if apps is not None:
        df = df.where(F.col("app_id").isin(apps))
    if start is not None:
        df = df.where(F.col("day") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col("day") <= F.lit(end).cast("date"))
    return df


def read_version(spark: SparkSession, path: str, version: int) -> DataFrame:
    """The events of one batch of a stream, committed or not."""
    folder = Versions(spark, path).folder("events", version)
    return spark.read.schema(LOG_EVENT).parquet(folder).select(*COLUMNS)


def read_ingested(spark: SparkSession, path: str, apps: list[str] | None = None, start=None, end=None) -> DataFrame:
    """Events that streams stored, with the version (batch) of each; only committed batches count. Versions, apps and days prune partitions."""
    versions = Versions(spark, path)
    last = versions.committed()
    df = spark.read.schema(LOG_EVENT + ", version bigint").parquet(f"{path}/events") if last is not None else spark.createDataFrame([], LOG_EVENT + ", version bigint")
    return _pruned(df.where(F.col("version") <= F.lit(-1 if last is None else last)), apps, start, end).select(*COLUMNS, "version")


def settle(spark: SparkSession, path: str, store_path: str, batches: int | None = None) -> int | None:
    """Moves the events of committed batches that aren't settled yet (the oldest `batches` of them) into store_path, in files of a good size; gives the last settled batch.

    A move is a version of store_path with the last batch it holds, so one that is cut short and runs again replaces what it left. read_ingested() reads store_path, too.
    """
    last, settled = Versions(spark, path).committed(), Versions(spark, store_path)
    before = settled.committed()
    low = -1 if before is None else settled.read("upto", before).first()["batch"]
    if last is None or last <= low:
        return low if before is not None else None
    high, number = last if batches is None else min(last, low + batches), 0 if before is None else before + 1
    rows = read_ingested(spark, path).where((F.col("version") > low) & (F.col("version") <= high)).select(*COLUMNS)
    settled.write("events", number, dealt(rows), partition_by=("app_id", "day"))
    settled.write("upto", number, spark.createDataFrame([(high,)], "batch bigint"))
    settled.commit(number)
    return high


def storage_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(app_id, day, bytes), and a row with a null day for each app."""
    files = spark.read.parquet(path).select("app_id", "day", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("size")).groupBy("app_id", "day", "f").agg(F.max("size").alias("size"))
    return files.groupingSets([["app_id", "day"], ["app_id"]], "app_id", "day").agg(F.sum("size").alias("bytes"))
