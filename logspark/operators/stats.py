"""Histograms, facets, statistics of apps, and acknowledgement watermarks."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .search import at, event_query, newest_days


def histogram(events: DataFrame, app: str, start=None, end=None, buckets: int = 60, now: datetime.datetime | None = None, **conditions) -> DataFrame:
    """(bucket, label, level, n) for all buckets: n of each level that occurs, and 0 with a null level for a bucket without events.

    Bucket widths and labels divide differently: the width is whole microseconds, labels are exact to a tenth of one.
    """
    buckets = max(1, min(500, buckets))
    micro = lambda t: int(t.replace(tzinfo=datetime.timezone.utc).timestamp() * 1_000_000)
    stop = micro(end or now)
    own = events.where(F.col("app_id") == app)
    if start is None:
        oldest = own.agg(F.min("day").alias("d")).first()["d"]
        begin = int(datetime.datetime(oldest.year, oldest.month, oldest.day, tzinfo=datetime.timezone.utc).timestamp()) * 1_000_000 if oldest else stop - 86_400_000_000
    else:
        begin = micro(start)
    if begin >= stop:
        begin = stop - 60_000_000
    width = max(1, (stop - begin) // buckets)
    lo, hi = (datetime.datetime.fromtimestamp(x / 1_000_000, datetime.timezone.utc) for x in (begin, stop))
    rows = event_query(own, start=lo, end=hi, **conditions)
    rows = rows.join(F.broadcast(newest_days(own.where(F.col("day").between(lo.date(), hi.date())), 90).select("day")), "day")  # at most 90 days
    index = F.least(F.lit(buckets - 1), F.greatest(F.lit(0), F.expr(f"(unix_micros(ts) - {begin}) div {width}"))).cast("int")
    counts = rows.groupBy(index.alias("bucket"), "level").agg(F.count("*").alias("n"))
    every = events.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    label = F.timestamp_micros(F.lit(begin) + F.expr(f"(bucket * cast({(stop - begin) * 10 // buckets} as bigint)) div 10"))
    return every.join(counts, "bucket", "left").select("bucket", label.alias("label"), "level", F.coalesce("n", F.lit(0)).alias("n"))


def histogram_totals(hist: DataFrame) -> DataFrame:
    """(total, busiest): events of all buckets, and of the busiest one."""
    return hist.groupBy("bucket").agg(F.sum("n").alias("n")).agg(F.sum("n").alias("total"), F.max("n").alias("busiest"))


def level_facet(events: DataFrame) -> DataFrame:
    return events.groupBy("app_id", "level").agg(F.count("*").alias("n"))


def source_facet(events: DataFrame, top: int = 8) -> DataFrame:
    """The most frequent sources of each app; equal counts in order of name."""
    counts = events.where("source is not null").groupBy("app_id", "source").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("app_id").orderBy(F.col("n").desc(), "source"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= top)


def app_stats(events: DataFrame) -> DataFrame:
    """(app_id, level, n, newest): one row an app and level, and one with a null level for the app, in one pass."""
    by = events.groupBy("app_id", "level").agg(F.count("*").alias("n"), F.max("ts").alias("newest"))
    return by.groupingSets([["app_id", "level"], ["app_id"]], "app_id", "level").agg(F.sum("n").alias("n"), F.max("newest").alias("newest"))


def hourly_counts(events: DataFrame, now) -> DataFrame:
    since = at(now) - F.expr("interval 24 hours")
    recent = events.where((F.col("day") >= F.to_date(since)) & (F.col("ts") >= since))
    return recent.groupBy("app_id", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"))


def hour_key(hour) -> F.Column:
    return F.date_format(hour, "yyyy-MM-dd'T'HH:00'Z'")


def hourly_series(events: DataFrame, apps: DataFrame, now) -> DataFrame:
    """24 slots for each app, the oldest first, the last one the hour of now; 0 where nothing happened."""
    last = F.date_trunc("hour", at(now))
    slots = apps.select("app_id").distinct().withColumn("hour", F.explode(F.sequence(last - F.expr("interval 23 hours"), last, F.expr("interval 1 hour"))))
    return slots.join(hourly_counts(events, now), ["app_id", "hour"], "left").select("app_id", hour_key(F.col("hour")).alias("hour"), F.coalesce("n", F.lit(0)).alias("n"))


def ack_snapshot(acks: DataFrame) -> DataFrame:
    """The latest watermark of each (app_id, scope); scopes are * or an event type, others don't count."""
    fine = acks.where((F.col("scope") == "*") | F.col("scope").try_cast("bigint").isNotNull())
    newest = F.struct("created_ts", "note", "acked_by")
    return fine.groupBy("app_id", "scope").agg(F.max("through_ts").alias("through_ts"), F.max_by(newest, newest).alias("x")).select("app_id", "scope", "through_ts", "x.note", "x.acked_by", "x.created_ts")


def acknowledge(acks: DataFrame, new: DataFrame) -> DataFrame:
    """Watermarks with new ones; they never go back."""
    return ack_snapshot(acks.unionByName(new))


def clear_ack(acks: DataFrame, cleared: DataFrame) -> DataFrame:
    """Without the (app_id, scope) in cleared; a null scope there clears the whole app."""
    whole = cleared.where("scope is null").select("app_id")
    return acks.join(cleared.where("scope is not null").select("app_id", "scope"), ["app_id", "scope"], "left_anti").join(whole, "app_id", "left_anti")


def unacknowledged_errors(events: DataFrame, acks: DataFrame, key: str = "event_type") -> DataFrame:
    """(app_id, n): errors that are newer than the app's watermark and their type's. Small watermark tables are broadcast by size."""
    marks = ack_snapshot(acks)
    app = marks.where("scope = '*'").select("app_id", F.col("through_ts").alias("__app"))
    own = marks.where("scope <> '*'").select("app_id", F.col("scope").alias("__scope"), F.col("through_ts").alias("__own"))
    errors = events.where("level >= 4").withColumn("__scope", F.col(key).cast("string"))
    left = errors.join(app, "app_id", "left").join(own, ["app_id", "__scope"], "left")
    open_ = (F.col("__app").isNull() | (F.col("ts") > F.col("__app"))) & (F.col("__own").isNull() | (F.col("ts") > F.col("__own")))
    return left.where(open_).groupBy("app_id").agg(F.count("*").alias("n"))
