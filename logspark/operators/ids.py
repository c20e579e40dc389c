"""Row ids within (app, day), event ids and cursors."""

from __future__ import annotations

import base64
import datetime
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Consecutive order values that are numbered together: bounds a window's partition whatever an app-day holds.
SPLIT = 50_000


def assign_row_ids(df: DataFrame, order: str, current_max: DataFrame | None = None, split: int = SPLIT) -> DataFrame:
    """df with id: 1, 2, ... within (app_id, day) by order, a whole number; after the ids in current_max (app_id, day, max_id).

    Counts by (app, day, split) give each split's first id; rows are numbered inside splits only.
    """
    parted = df.withColumn("__part", F.floor(F.col(order) / F.lit(split)))
    counts = parted.groupBy("app_id", "day", "__part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("app_id", "day").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    first = counts.withColumn("__first", F.coalesce(before, F.lit(0))).drop("n")
    if current_max is not None:
        first = first.join(current_max, ["app_id", "day"], "left").withColumn("__first", F.col("__first") + F.coalesce("max_id", F.lit(0))).drop("max_id")
    number = F.row_number().over(Window.partitionBy("app_id", "day", "__part").orderBy(order))
    return parted.join(first, ["app_id", "day", "__part"]).withColumn("id", F.col("__first") + number).drop("__part", "__first")


def event_id(day: Column, row: Column) -> Column:
    return F.concat_ws(":", F.date_format(day, "yyyyMMdd"), row.cast("string"))


def parse_event_id(text: Column) -> Column:
    """struct(day, id); null where the text isn't an event id."""
    day, row = F.regexp_extract(text, r"^(\d{8}):\d+$", 1), F.regexp_extract(text, r"^\d{8}:(\d+)$", 1)
    d = F.try_to_timestamp(day, F.lit("yyyyMMdd")).cast("date")
    return F.when(d.isNotNull(), F.struct(d.alias("day"), row.try_cast("bigint").alias("id")))


def encode_cursor(day: datetime.date, row: int) -> str:
    raw = json.dumps({"P": day.strftime("%Y%m%d"), "I": row}, separators=(",", ":")).encode()
    return base64.urlsafe_b64encode(raw).decode().rstrip("=")


def decode_cursor(text: str | None) -> tuple[datetime.date, int] | None:
    """A cursor that doesn't decode is no cursor."""
    try:
        got = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
        return datetime.datetime.strptime(got["P"], "%Y%m%d").date(), int(got["I"])
    except (TypeError, ValueError, KeyError):
        return None
