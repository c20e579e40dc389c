"""Streams over the same functions as the batch jobs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.filters import VARIANT, filter_expr, with_variant
from ..operators import rules as R
from ..operators.ids import assign_row_ids
from ..shared import Versions, cut
from ..sources import clef, store
from .frames import frames, stream_frames  # noqa: F401


def ingest_batch(lines: DataFrame, path: str, apps: DataFrame, now: dt.datetime, batch_id: int) -> DataFrame:
    """One micro-batch: parse, admit, mark, number, store; gives the rows it stored. lines has app_id, line and seq, a whole number in order of arrival.

    A batch is a version of the store (shared.Versions): its events and the highest id of each app-day so far, which count once the version is committed. A job that dies
    in between leaves files that no reader sees; the batch that runs again replaces them, and one that was committed gives what it stored.
    """
    spark = lines.sparkSession
    versions = Versions(spark, path)
    last = versions.committed()
    if last is not None and last >= batch_id:
        return store.read_ingested(spark, path).where(F.col("version") == batch_id).drop("version")
    top = None if last is None else versions.read("ids", last)
    admitted = clef.admit(clef.parse_clef(lines, now), apps, now).where("status = 'accepted'")
    rows = assign_row_ids(clef.mark_late_truncated(admitted, now), "seq", top).select(*store.COLUMNS)
    versions.write("events", batch_id, store.dealt(rows), partition_by=("app_id", "day"))
    own = store.read_version(spark, path, batch_id)
    ids = own.groupBy("app_id", "day").agg(F.max("id").alias("max_id"))
    if top is not None:
        ids = ids.unionByName(top).groupBy("app_id", "day").agg(F.max("max_id").alias("max_id"))
    versions.write("ids", batch_id, ids)
    versions.commit(batch_id)
    return own


def stream_ingest(lines: DataFrame, path: str, apps: DataFrame, checkpoint: str, clock=lambda: dt.datetime.now(dt.timezone.utc), observe=None):
    """Stores a stream of lines (app_id, line, seq); store.read_ingested() reads it. observe(rows, batch id) sees each stored batch. No watermark: late events are marked, not dropped."""
    def each(batch: DataFrame, batch_id: int) -> None:
        rows = ingest_batch(batch, path, apps, clock(), batch_id)
        if observe is not None:
            observe(rows, batch_id)

    return lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def subscription(key: str, app: str, level: int = 0, where: str | None = None) -> dict:
    return {"id": key, "app_id": app, "level": level, "filter": where}


def tail(events: DataFrame, subscriptions: list[dict]) -> DataFrame:
    """Events with sub_id and matched, a row for each subscription of the event's app. Works on streams and tables alike."""
    def hit(s: dict) -> Column:
        c = F.col("level") >= s["level"]
        return c & F.coalesce(filter_expr(s["filter"]), F.lit(False)) if s["filter"] else c

    rows = [F.when(F.col("app_id") == s["app_id"], F.struct(F.lit(s["id"]).alias("sub_id"), F.coalesce(hit(s), F.lit(False)).alias("matched"))) for s in subscriptions]
    return with_variant(events).withColumn("__s", F.explode(F.array_compact(F.array(*rows)))).select(*[c for c in events.columns if c != VARIANT], "__s.*")


def stats_frames(tailed: DataFrame, time: str = "ts") -> DataFrame:
    """(sub_id, second, total, matched, by_level): tumbling windows of one second; for streams with a watermark too."""
    w = F.window(time, "1 second")
    return tailed.groupBy("sub_id", w.alias("w")).agg(
        F.count("*").alias("total"), F.count_if("matched").alias("matched"), *[F.count_if(F.col("matched") & (F.col("level") == i)).alias(f"level_{i}") for i in range(6)]).withColumn("second", F.col("w.start")).drop("w")


def zero_filled(stats: DataFrame, subscriptions: list[str], start, end) -> DataFrame:
    """Statistics with the silent seconds between start and end (both included)."""
    spark = stats.sparkSession
    slots = spark.createDataFrame([(s,) for s in subscriptions], "sub_id string").withColumn("second", F.explode(F.sequence(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"), F.expr("interval 1 second"))))
    counts = [c for c in stats.columns if c not in ("sub_id", "second")]
    return slots.join(stats, ["sub_id", "second"], "left").select("sub_id", "second", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


def rules_batch(batch: DataFrame, batch_id: int, rules: list[dict], destinations: list[dict], state: Versions) -> None:
    """One micro-batch of events with commit_ts: rules that are still enabled, over the occurrences and the last hour's deliveries that the batch before left.

    The version of a batch has three tables of state (occurrences, disabled rules with their reason, deliveries of the last hour) and the deliveries it made, and they count
    together, once it is committed.
    """
    spark = batch.sparkSession
    last = state.committed()
    if last is not None and last >= batch_id:  # it ran before, whole
        return
    old = {t: state.read(t, last) if last is not None else None for t in ("occurrences", "disabled", "recent")}
    gone = set() if old["disabled"] is None else {r["rule_id"] for r in old["disabled"].select("rule_id").collect()}  # rules are a small control table
    clock = batch.agg(F.max("commit_ts")).first()[0]
    if clock is None:
        for name, df in old.items():
            if df is not None:
                state.write(name, batch_id, df)
        if last is not None:
            state.commit(batch_id)
        return
    alive = [r for r in rules if r["id"] not in gone]
    now, fired, off = R.evaluate_rules(batch, alive, destinations, old["occurrences"], old["recent"])
    now = cut(now)
    if old["occurrences"] is not None:
        now = now.unionByName(old["occurrences"].join(now.select("rule_id", "dedupe_key"), ["rule_id", "dedupe_key"], "left_anti"))
    state.write("occurrences", batch_id, R.prune_occurrences(now, clock))
    off = off.select("rule_id", "reason", "commit_ts")
    state.write("disabled", batch_id, off if old["disabled"] is None else off.unionByName(old["disabled"]))
    state.write("deliveries", batch_id, R.enqueue_deliveries(fired, rules, destinations))
    made = spark.read.parquet(state.folder("deliveries", batch_id)).select("destination_id", "rule_id", "app_id", "created_ts")
    recent = made if old["recent"] is None else made.unionByName(old["recent"])
    state.write("recent", batch_id, recent.where(F.col("created_ts") >= F.lit(clock - dt.timedelta(hours=1))))
    state.commit(batch_id)


def stream_rules(events: DataFrame, rules: list[dict], destinations: list[dict], path: str, checkpoint: str):
    """Rules on a stream of events with commit_ts; path holds a version for each micro-batch (see rules_batch). Deliveries: rule_deliveries(spark, path)."""
    state = Versions(events.sparkSession, path)
    return events.writeStream.foreachBatch(lambda batch, batch_id: rules_batch(batch, batch_id, rules, destinations, state)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rule_deliveries(spark: SparkSession, path: str) -> DataFrame | None:
    """What the rules of a stream have enqueued, in committed batches."""
    return Versions(spark, path).read_all("deliveries")
