"""Retention of stored days, and purges."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def retention_plan(partitions: DataFrame, apps: DataFrame, today: dt.date, free_bytes: int | None = None, min_free_bytes: int | None = None) -> DataFrame:
    """(app_id, day, bytes, reason) to drop: too old; then the oldest of an app above its size; then the oldest of all until enough is free, never today's.

    partitions has a row for each app-day (app_id, day, bytes), apps (app_id, retention_days, max_size_mb).
    """
    p = partitions.join(apps.select("app_id", "retention_days", "max_size_mb"), "app_id", "left")
    old = F.coalesce(F.col("day") < F.date_sub(F.lit(today), F.col("retention_days")), F.lit(False))
    p = p.withColumn("old", old)
    # bytes of this day and all younger ones that stay: where they are above the limit, this day goes
    young = F.sum(F.when(~F.col("old"), F.col("bytes")).otherwise(0)).over(Window.partitionBy("app_id").orderBy(F.col("day").desc()).rowsBetween(Window.unboundedPreceding, 0))
    big = ~F.col("old") & (young > F.col("max_size_mb") * F.lit(1024 * 1024))
    p = p.withColumn("reason", F.when(F.col("old"), "retention").when(big, "size"))
    out = p.where("reason is not null").select("app_id", "day", "bytes", "reason")
    if free_bytes is None or min_free_bytes is None:
        return out
    freed = out.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    left = p.where(F.col("reason").isNull() & (F.col("day") < F.lit(today)))
    # by whole days first, so that the running sum over all apps is a window over days, not over partitions
    days = left.groupBy("day").agg(F.sum("bytes").alias("b"))
    ahead = F.coalesce(F.sum("b").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("bytes").over(Window.partitionBy("day").orderBy("app_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    floor = left.join(days.withColumn("ahead", ahead), "day").withColumn("before", F.col("ahead") + inside).where(F.col("before") + F.lit(free_bytes + freed) < F.lit(min_free_bytes))
    return out.unionByName(floor.select("app_id", "day", "bytes", F.lit("disk").alias("reason")))


def purge_app(app: str, tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Tables without what belongs to an app, and what goes of each. rules for all apps stay; occurrences go with their rules."""
    gone = {n: t.where(F.col("app_id") == app) for n, t in tables.items() if "app_id" in t.columns}
    stay = {n: t.where(F.col("app_id").isNull() | (F.col("app_id") != app)) for n, t in tables.items() if "app_id" in t.columns}
    if "rules" in tables and "occurrences" in tables:
        ids = gone["rules"].select(F.col("id").alias("rule_id"))
        gone["occurrences"] = tables["occurrences"].join(ids, "rule_id", "left_semi")
        stay["occurrences"] = tables["occurrences"].join(ids, "rule_id", "left_anti")
    return tables | stay, gone


def purge_destination(destination: str, rules: DataFrame, occurrences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rules and occurrences without a destination's; deliveries stay as history."""
    gone = rules.where(F.col("destination_id") == destination).select(F.col("id").alias("rule_id"))
    return rules.where(F.col("destination_id").isNull() | (F.col("destination_id") != destination)), occurrences.join(gone, "rule_id", "left_anti")
