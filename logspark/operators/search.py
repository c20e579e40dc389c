"""Search with keyset paging, lookups, context windows, property discovery and saved searches."""

from __future__ import annotations

import datetime
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.filters import VARIANT, FilterError, filter_expr, text_search, with_variant
from ..session import ship
from .ids import decode_cursor, encode_cursor, parse_event_id

When = datetime.datetime | str | None


def at(when: When) -> Column:
    return F.lit(when).cast("timestamp")


def predicate(app: str | None = None, start: When = None, end: When = None, level: int | None = None, text: str | None = None, where: str | None = None) -> Column:
    """The condition of a query; day bounds go along with time bounds, so partitions are pruned."""
    c = F.lit(True)
    if app is not None:
        c &= F.col("app_id") == app
    if start is not None:
        c &= (F.col("day") >= F.to_date(at(start))) & (F.col("ts") >= at(start))
    if end is not None:
        c &= (F.col("day") <= F.to_date(at(end))) & (F.col("ts") <= at(end))
    if level is not None:
        c &= F.col("level") >= level
    if text and text.strip():
        c &= text_search(text)
    if where and where.strip():
        c &= filter_expr(where)
    return c


def event_query(events: DataFrame, **conditions) -> DataFrame:
    rows = with_variant(events) if conditions.get("where") else events
    return rows.where(predicate(**conditions)).drop(VARIANT)


def search(events: DataFrame, limit: int = 100, cursor: str | None = None, **conditions) -> DataFrame:
    """The newest rows by (day, id), at most limit + 1 of them: one more than the page if there is a next page."""
    rows = event_query(events, **conditions)
    after = decode_cursor(cursor)
    if after:
        day = F.lit(after[0])
        rows = rows.where((F.col("day") < day) | ((F.col("day") == day) & (F.col("id") < after[1])))
    return rows.orderBy(F.col("day").desc(), F.col("id").desc()).limit(max(1, min(1000, limit)) + 1)


def page(events: DataFrame, limit: int = 100, cursor: str | None = None, **conditions) -> tuple[list, str | None]:
    """One page for display, and the cursor of the next one. The page is at most 1000 rows."""
    limit = max(1, min(1000, limit))
    rows = search(events, limit, cursor, **conditions).collect()
    more = len(rows) > limit
    return rows[:limit], encode_cursor(rows[limit - 1]["day"], rows[limit - 1]["id"]) if more else None


def get_by_id(events: DataFrame, ids: DataFrame) -> DataFrame:
    """Events for a table of (app_id, event_id); ids that don't parse find nothing."""
    keys = ids.select("app_id", parse_event_id(F.col("event_id")).alias("k")).select("app_id", "k.day", "k.id").dropna().distinct()
    return events.join(keys, ["app_id", "day", "id"])


def newest_days(events: DataFrame, n: int) -> DataFrame:
    """(app_id, day): the n newest days that each app has."""
    rank = F.row_number().over(Window.partitionBy("app_id").orderBy(F.col("day").desc()))
    return events.select("app_id", "day").distinct().withColumn("r", rank).where(F.col("r") <= n).drop("r")


def count_by_event_type(events: DataFrame, types: DataFrame, key: str = "event_type", max_days: int = 60) -> DataFrame:
    """Events of each (app_id, type) in types within the app's newest days; types without events count 0."""
    recent = events.join(newest_days(events, max_days), ["app_id", "day"])
    counts = recent.groupBy("app_id", key).agg(F.count("*").alias("n"))
    return types.join(counts, ["app_id", key], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def _nearest(width: int, limit: int, schema: list[str]):
    """Events and anchors of an app and bucket to the anchors' newest events, in order."""
    def run(events: pa.Table, anchors: pa.Table) -> pa.Table:
        number = lambda c: c.combine_chunks().cast(pa.int64()).to_numpy()
        order = np.lexsort((-number(events["id"]), -number(events["day"].cast(pa.int32()))))
        ts = number(events["__ts"])[order]
        found = [np.flatnonzero(np.abs(ts - x) <= width)[:limit] for x in number(anchors["__ts"])] if len(events) else [ts[:0]] * len(anchors)
        sizes = [len(x) for x in found]
        e = events.take(pa.array(order[np.concatenate(found).astype(np.int64)])) if sum(sizes) else events.slice(0, 0)
        a = anchors.take(pa.array(np.repeat(np.arange(len(anchors)), sizes)))
        rank = pa.array(np.concatenate([np.arange(1, n + 1) for n in sizes]).astype(np.int32) if sizes else [], pa.int32())
        columns = {"rank": rank} | {c: a[c] for c in a.column_names} | {c: e[c] for c in e.column_names}
        return pa.table([columns[c] for c in schema], names=schema)
    return run


def context_window(events: DataFrame, anchors: DataFrame, minutes: int = 2, limit: int = 80) -> DataFrame:
    """Events of the anchor's app within some minutes of it, the newest limit of each anchor: a row of (app_id, anchor_id, anchor_ts).

    Anchors stand in a bucket of that width, events in three; a bucket's events are put in order once, and each anchor takes its first ones from there. Pairs are never
    rows: their number grows with the square of what a bucket holds.
    """
    ship(events.sparkSession)
    width, key = minutes * 60_000_000, ["app_id", "__b"]
    bucket = F.floor(F.col("__ts") / F.lit(width))
    a = anchors.withColumn("__ts", F.unix_micros("anchor_ts")).withColumn("__b", bucket).dropna(subset=["app_id", "__ts"])
    e = events.withColumn("__ts", F.unix_micros("ts")).dropna(subset=["app_id", "__ts"]).withColumn("__b", F.explode(F.sequence(bucket - 1, bucket + 1)))
    e = e.join(a.select(*key).distinct(), key, "left_semi")
    mine = [f for f in anchors.schema if f.name != "app_id"]
    schema = T.StructType([*events.schema, *mine, T.StructField("rank", T.IntegerType())])
    a = a.select(F.col("app_id").alias("__app"), F.col("__b").alias("__a"), "__ts", *[f.name for f in mine])  # columns of its own, where both sides come from one table
    return e.groupBy(*key).cogroup(a.groupBy("__app", "__a")).applyInArrow(_nearest(width, limit, schema.names), schema)


def discover_properties(events: DataFrame, limit: int = 20) -> DataFrame:
    """(name, position): property names in order of first appearance, newest event first; the first limit."""
    each = events.select(F.struct((-F.unix_date("day")).alias("d"), (-F.col("id")).alias("i"), F.col("app_id").alias("a")).alias("o"), F.posexplode(F.expr("json_object_keys(properties)")).alias("p", "name"))
    first = each.groupBy("name").agg(F.min(F.struct("o", "p")).alias("first"))
    top = first.orderBy("first", "name").limit(limit)
    return top.withColumn("position", F.row_number().over(Window.orderBy("first", "name"))).select("name", "position")


def pivot_properties(events: DataFrame, keys: list[str]) -> DataFrame:
    """The events with the named properties as text columns; a missing one is empty, JSON null is the word null."""
    rows = with_variant(events)
    shown = [F.coalesce(F.when(F.expr(f"is_variant_null(variant_get({VARIANT}, '$.{k}'))"), F.lit("null")), F.regexp_replace(F.get_json_object("properties", f"$.{k}"), "^$", ""), F.lit("")).alias(k) for k in keys]
    return rows.select(*[c for c in events.columns if c not in keys], *shown)


RANGES = {"15m": 15, "1h": 60, "24h": 1440, "7d": 10080}


def saved_conditions(spec: str, now: datetime.datetime) -> dict:
    """A saved search's JSON (q, level, range, filter) as conditions of a query. range: 24h if missing; unknown ones have no bound."""
    got = json.loads(spec) if spec else {}
    out: dict = {"text": got.get("q"), "where": got.get("filter")}
    if got.get("level") is not None:
        out["level"] = int(got["level"])
    minutes = RANGES.get(got.get("range", "24h"))
    if minutes:
        out["start"] = now - datetime.timedelta(minutes=minutes)
    return out


def run_saved_searches(events: DataFrame, saved: list[tuple[str, str, str]], now: datetime.datetime) -> DataFrame:
    """(search_id, n) for saved searches (id, app, spec), in one scan: a sum for each of them."""
    sums = []
    for key, app, spec in saved:
        try:
            hit = predicate(app=app, **saved_conditions(spec, now))
        except FilterError:
            continue
        sums.append(F.struct(F.lit(key).alias("search_id"), F.coalesce(F.sum(hit.cast("long")), F.lit(0)).alias("n")))
    return with_variant(events).agg(F.array(*sums).alias("s")).select(F.explode("s").alias("s")).select("s.*")
