"""Windows event records as log events, and incremental loading by cursor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.search import at

# Windows levels to log levels.
LEVEL = {1: 5, 2: 4, 3: 3, 5: 0}


def windows_level(level: Column) -> Column:
    return F.coalesce(*[F.when(level == w, n) for w, n in LEVEL.items()], F.lit(2))


def windows_level_ceiling(level: Column, minimum: int) -> Column:
    """The app's floor as a condition on the Windows level, for the source read; level 0 always passes."""
    return (level == 0) | (windows_level(level) >= minimum)


def map_windows_events(records: DataFrame, local_name: str) -> DataFrame:
    """Records to ts, level, template, message, machine, trace_id and properties."""
    said = F.trim(F.coalesce("description", F.lit("")))
    data = F.coalesce("data", F.array().cast("array<string>"))
    shown = F.slice(F.filter(data, lambda x: F.trim(x) != ""), 1, 20)
    head = F.concat_ws(" ", F.col("provider"), F.lit("event"), F.col("event_id").cast("string"))
    message = F.when(said != "", said).when(F.size(shown) > 0, F.concat(head, F.lit(": "), F.array_join(shown, " | "))).otherwise(head)
    trace = F.regexp_replace("activity_id", "-", "")
    pairs = F.transform(F.slice(data, 1, 20), lambda x, i: F.struct(F.concat(F.lit("Data"), i.cast("string")).alias("key"), x.alias("value")))
    named = F.array(*[F.struct(F.lit(n).alias("key"), F.col(c).cast("string").alias("value")) for n, c in (("Channel", "channel"), ("Provider", "provider"), ("EventId", "event_id"), ("RecordId", "record_id"))])
    bag = F.to_json(F.map_from_entries(F.filter(F.concat(named, pairs), lambda e: e["value"].isNotNull())))
    return records.select(
        "record_id", "channel", F.col("time_created").alias("ts"), windows_level(F.col("level")).alias("level"), F.concat(F.lit("["), F.col("channel"), F.lit("/"), F.col("provider"), F.lit(" "), F.col("event_id").cast("string"), F.lit("]")).alias("template"),
        message.alias("message"), F.coalesce("machine", F.lit(local_name)).alias("machine"), F.when(trace.rlike("[^0]"), trace).alias("trace_id"), F.col("provider").alias("source"), bag.alias("properties"))


def incremental_load(records: DataFrame, cursors: DataFrame, max_batch: int, max_batches: int, now, backfill_hours: int = 0) -> tuple[DataFrame, DataFrame]:
    """New records of each (machine, channel), the oldest first, and the new cursors.

    Without a cursor a log starts at its newest record, or at those of the last hours in one batch. A log whose newest record is below the
    cursor was cleared: the cursor goes back to 0 and the next load reads it.
    """
    key = ["machine", "channel"]
    state = records.groupBy(*key).agg(F.max("record_id").alias("newest")).join(cursors.select(*key, "last_record_id"), key, "full")
    rows = records.join(state, key)
    first = F.col("last_record_id").isNull()
    recent = F.col("time_created") >= at(now) - F.make_dt_interval(F.lit(0), F.lit(max(0, min(720, backfill_hours))))
    fresh = rows.where(F.when(first, recent if backfill_hours > 0 else F.lit(False)).otherwise(F.col("record_id") > F.col("last_record_id")))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("record_id"))
    loaded = fresh.withColumn("__r", rank).where(F.col("__r") <= F.when(first, max_batch).otherwise(max_batch * max_batches)).drop("__r", "newest", "last_record_id")
    got = loaded.groupBy(*key).agg(F.max("record_id").alias("got"))
    cleared = F.col("got").isNull() & (F.col("newest") < F.col("last_record_id"))
    cursor = F.when(cleared, F.lit(0).cast("long")).when(first & F.col("got").isNull(), F.col("newest")).otherwise(F.greatest("last_record_id", "got"))
    return loaded, state.join(got, key, "left").select(*key, cursor.alias("last_record_id"))
