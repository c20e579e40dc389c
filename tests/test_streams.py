"""Streams against their batch forms: frames, silent seconds, rules with their whole state, ingest that is cut short."""

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from logspark.operators import rules as R
from logspark.schema import LOG_EVENT
from logspark.shared import Versions
from logspark.sources import store
from logspark.streaming import frames as fr
from logspark.streaming import stream

T0 = dt.datetime(2026, 7, 23, 12)
TAILED = "sub_id string, arrived timestamp, key bigint, level int, matched boolean"


@pytest.fixture
def rocks(spark):
    old = spark.conf.get(fr.PROVIDER)
    spark.conf.set(fr.PROVIDER, fr.ROCKSDB)
    yield spark
    spark.conf.set(fr.PROVIDER, old)


def arrivals(seed=4):
    r = random.Random(seed)
    rows, key = [], 0
    for sub in "ab":
        for second in (0, 0, 1, 3, 9, 9, 10, 20):
            for _ in range(r.choice([3, 40, 150])):
                key += 1
                rows.append((sub, T0 + dt.timedelta(seconds=second, milliseconds=r.randrange(1000)), key, r.randrange(6), r.random() < 0.8))
    return rows


def write_parts(path, parts, cells):
    """A file a part. A stream takes files by their time of change, so each is a minute younger than the one before."""
    path.mkdir()
    for k, part in enumerate(parts):
        (path / f"{k}.json").write_text("".join(json.dumps(dict(zip(cells, [x.isoformat() + "Z" * isinstance(x, dt.datetime) if isinstance(x, dt.date) else x for x in row], strict=True))) + "\n" for row in part))
        os.utime(path / f"{k}.json", (1_700_000_000 + 60 * k,) * 2)


def replay(spark, tmp_path, rows, parts=3, size=7, ring=30, subscriptions=None):
    """The frames of a stream that takes the rows in a few batches, by time; a last row far ahead moves the watermark over all ticks."""
    rows = sorted(rows, key=lambda r: r[1])
    n = -(-len(rows) // parts)
    end = ("end", T0 + dt.timedelta(seconds=60), 0, 0, False)
    write_parts(tmp_path / "in", [rows[i : i + n] for i in range(0, len(rows), n)] + [[end]], ["sub_id", "arrived", "key", "level", "matched"])
    source = spark.readStream.schema(TAILED).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")).withWatermark("arrived", "1 second")
    out = stream.stream_frames(source, subscriptions, size=size, ring=ring, live=False)
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return spark.read.schema(fr.FRAME).parquet(str(tmp_path / "out")).where("sub_id <> 'end'")


def followed(rows, size, ring, ms=250):
    """Frames by hand: every tick from the first arrival on, for each subscription."""
    out = []
    for sub in sorted({r[0] for r in rows}):
        mine = sorted((r for r in rows if r[0] == sub and r[4]), key=lambda r: (r[1], r[2]))
        slot = lambda t: int((t - T0).total_seconds() * 1000) // ms
        waiting, seq, tick = [], 0, 0
        while tick < 4000:
            waiting += [r[2] for r in mine if slot(r[1]) == tick]
            dropped, waiting = max(0, len(waiting) - ring), waiting[-ring:]
            if waiting:
                seq += 1
                out.append((sub, seq, tick, waiting[:size], dropped))
                waiting = waiting[size:]
            tick += 1
            if tick > 100 and not waiting:
                break
    return out


def test_frames_of_a_table(spark):
    rows = arrivals()
    got = stream.frames(spark.createDataFrame(rows, TAILED).where("matched"), size=7, ring=30).groupBy("sub_id", "seq", "at", "dropped").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    found = sorted((r.sub_id, r.seq, int((r["at"] - T0).total_seconds() * 4) - 1, sorted(r["keys"]), r.dropped) for r in got.collect())
    assert found == [(a, b, c, sorted(d), e) for a, b, c, d, e in followed(rows, 7, 30)]
    assert any(r[4] for r in found)


def test_streamed_frames_carry_over_and_drop(rocks, tmp_path):
    rows = arrivals()
    got = replay(rocks, tmp_path, rows).where("type = 'events'").orderBy("sub_id", "seq").collect()
    expected = followed(rows, 7, 30)
    ticks = [(r.sub_id, int((r["at"] - T0).total_seconds() * 4) - 1, list(r["keys"]), r.dropped) for r in got]
    # rows of one tick leave in the order of arrival; those of equal milliseconds may change places
    assert [(a, c, len(k), d) for a, c, k, d in ticks] == [(a, c, len(k), d) for a, _, c, k, d in expected]
    assert sum(d for *_, d in ticks) > 0 and len({k for _, _, keys, _ in ticks for k in keys}) == sum(len(k) for _, _, k, _ in ticks)


def test_silent_seconds_on_a_stream(rocks, tmp_path):
    rows = arrivals(7)
    since = rocks.createDataFrame([(s, T0 - dt.timedelta(seconds=2)) for s in ("a", "b", "quiet")], "sub_id string, since timestamp")
    got = replay(rocks, tmp_path, rows, size=500, ring=2000, subscriptions=since)
    second = F.date_trunc("second", F.col("at") - F.expr("interval 1 millisecond"))
    streamed = {(r.sub_id, r.second): tuple(r)[2:] for r in got.groupBy("sub_id", second.alias("second")).agg(F.sum("total"), F.sum("matched"), *[F.sum(F.col("by_level")[i]) for i in range(6)]).collect()}
    table = rocks.createDataFrame(rows, TAILED)
    stats = stream.zero_filled(stream.stats_frames(table, "arrived"), ["a", "b", "quiet"], T0 - dt.timedelta(seconds=2), T0 + dt.timedelta(seconds=40))
    expected = {(r.sub_id, r.second): tuple(r)[2:] for r in stats.collect()}
    assert {k: v for k, v in streamed.items() if k in expected} == expected and any(not v[0] for v in expected.values())


def test_live_frames_follow_the_clock(rocks, tmp_path):
    write_parts(tmp_path / "in", [[("a", T0, i, 3, True) for i in range(10)]], ["sub_id", "arrived", "key", "level", "matched"])
    out = stream.stream_frames(rocks.readStream.schema(TAILED).json(str(tmp_path / "in")), size=4, ring=8)
    q = out.writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="300 milliseconds").start()
    try:
        for _ in range(60):
            q.awaitTermination(1)
            rows = rocks.table("live").orderBy("seq").collect()
            if any(r.type == "stats" for r in rows):
                break
    finally:
        q.stop()
    assert [len(r["keys"]) for r in rows if r.type == "events"] == [4, 4] and rows[0].dropped == 2 and rows[0].total == 10 and rows[-1].type == "stats" and rows[-1].total == 0


def test_frames_need_rocksdb(spark):
    with pytest.raises(ValueError, match="RocksDB"):
        stream.stream_frames(spark.createDataFrame([], TAILED))


# ---- ingest

APPS = "app_id string, minimum_level int"


def lines(spark, k):
    return spark.createDataFrame([(a, 10 * k + i, json.dumps({"@t": f"2026-07-23T12:00:{10 * k + i:02d}Z", "@m": f"{a}{k}.{i}"})) for a in "ab" for i in range(3)], "app_id string, seq bigint, line string")


class Killed(Exception):
    pass


@pytest.mark.parametrize("table", ["events", "ids", "commit"])
def test_ingest_that_dies_gives_each_row_once(spark, tmp_path, monkeypatch, table):
    """The job dies right after, or right before, it writes a table of batch 1, and the batch runs again with another clock."""
    apps, path = spark.createDataFrame([("a", 0), ("b", 0)], APPS), str(tmp_path / "store")
    stream.ingest_batch(lines(spark, 0), path, apps, T0, 0)
    write = Versions.write

    def dies(self, name, version, df, **options):
        write(self, name, version, df, **options)
        if name == table:
            raise Killed

    with monkeypatch.context() as m:
        m.setattr(Versions, "write", dies)
        if table == "commit":
            m.setattr(Versions, "commit", lambda self, version: (_ for _ in ()).throw(Killed()))
        with pytest.raises(Killed):
            stream.ingest_batch(lines(spark, 1), path, apps, T0, 1)
    assert store.read_ingested(spark, path).count() == 6
    stream.ingest_batch(lines(spark, 1), path, apps, T0 + dt.timedelta(hours=1), 1)
    stream.ingest_batch(lines(spark, 1), path, apps, T0, 1)
    stream.ingest_batch(lines(spark, 2), path, apps, T0, 2)
    rows = store.read_ingested(spark, path, ["a"], T0.date()).orderBy("id").collect()
    assert [(r.id, r.message) for r in rows] == [(3 * k + i + 1, f"a{k}.{i}") for k in range(3) for i in range(3)]
    assert store.read_ingested(spark, path, ["a"], T0.date() + dt.timedelta(days=1)).count() == 0


def test_settled_batches(spark, tmp_path, monkeypatch):
    apps, path, to = spark.createDataFrame([("a", 0), ("b", 0)], APPS), str(tmp_path / "store"), str(tmp_path / "settled")
    assert store.settle(spark, path, to) is None
    for k in range(2):
        stream.ingest_batch(lines(spark, k), path, apps, T0, k)
    with monkeypatch.context() as m:  # the first move dies before its commit
        m.setattr(Versions, "commit", lambda self, version: (_ for _ in ()).throw(Killed()))
        with pytest.raises(Killed):
            store.settle(spark, path, to)
    assert store.read_ingested(spark, to).count() == 0
    stream.ingest_batch(lines(spark, 2), path, apps, T0, 2)
    assert store.settle(spark, path, to, batches=1) == 0 and store.settle(spark, path, to) == 2 and store.settle(spark, path, to) == 2
    assert sorted((r.app_id, r.id, r.message) for r in store.read_ingested(spark, to).collect()) == sorted((r.app_id, r.id, r.message) for r in store.read_ingested(spark, path).collect())


# ---- rules


DEST = [{"id": "d", "body_template": '{"m":"{{event.message}}"}', "rate_limit_per_hour": 30, "is_enabled": True}]


def rule_events():
    """Three batches: distinct keys over the cap of 20, a storm, and events half an hour apart."""
    rows, i = [], 0
    for batch, (n, minutes, app) in enumerate([(12, 0, "a"), (14, 10, "a"), (150, 20, "b"), (6, 50, "b"), (3, 20 + 24 * 60 * 8, "b")]):
        for k in range(n):
            i += 1
            at = T0 + dt.timedelta(minutes=minutes)
            rows.append((batch, (app, at.date(), i, at, 4, "T", f"m{i}", None, 1, None, None, None, None, json.dumps({"K": i if app == "a" else k % 2}), at)))
    return rows


RULES = [R.default_rule(id="many", app_id="a", dedupe_key_template="{{event.properties.K}}"), R.default_rule(id="b", app_id="b", cooldown_minutes=30, dedupe_key_template="{{event.properties.K}}"), R.default_rule(id="bad", filter="Level >>> 5")]


def test_rules_on_a_stream_equal_one_batch(spark, tmp_path):
    rows, schema = rule_events(), LOG_EVENT + ", commit_ts timestamp"
    path, state = str(tmp_path / "rules"), Versions(spark, str(tmp_path / "rules"))
    for batch in (0, 1, 2, 1, 3, 2):  # two of them run again
        stream.rules_batch(spark.createDataFrame([r for b, r in rows if b == batch], schema), batch, RULES, DEST, state)
    whole, fired, off = R.evaluate_rules(spark.createDataFrame([r for b, r in rows if b < 4], schema), RULES, DEST)
    columns = ["rule_id", "dedupe_key", "count", "window_start_ts", "first_seen_ts", "last_seen_ts", "last_fired_ts"]
    assert sorted(map(str, state.read("occurrences", 3).select(columns).collect())) == sorted(map(str, whole.select(columns).collect()))
    made = stream.rule_deliveries(spark, path)
    assert sorted(r.id for r in made.select("id").collect()) == sorted(r.id for r in R.enqueue_deliveries(fired, RULES, DEST).select("id").collect())
    assert made.where("rule_id = 'many'").count() == 20 and made.where("rule_id = 'b'").count() == 3
    assert sorted(map(tuple, state.read("disabled", 3).collect())) == sorted(map(tuple, off.collect())) and state.read("disabled", 3).count() == 2
    assert state.read("recent", 3).count() == made.where("created_ts >= timestamp'2026-07-23 11:50:00'").count()
    # eight days later, what was seen then is forgotten
    stream.rules_batch(spark.createDataFrame([r for b, r in rows if b == 4], schema), 4, RULES, DEST, state)
    assert state.read("occurrences", 4).count() == 2 and state.read("recent", 4).count() == 2
    stream.rules_batch(spark.createDataFrame([], schema), 5, RULES, DEST, state)
    assert state.committed() == 5 and state.read("occurrences", 5).count() == 2


def test_rules_that_die_leave_no_half(spark, tmp_path, monkeypatch):
    rows, schema = rule_events(), LOG_EVENT + ", commit_ts timestamp"
    state = Versions(spark, str(tmp_path / "rules"))
    batch = spark.createDataFrame([r for b, r in rows if b == 0], schema)
    with monkeypatch.context() as m:
        m.setattr(Versions, "commit", lambda self, version: (_ for _ in ()).throw(Killed()))
        with pytest.raises(Killed):
            stream.rules_batch(batch, 0, RULES, DEST, state)
    assert stream.rule_deliveries(spark, str(tmp_path / "rules")) is None
    stream.rules_batch(batch, 0, RULES, DEST, state)
    assert stream.rule_deliveries(spark, str(tmp_path / "rules")).count() == 12


def test_rules_on_a_stream_source(spark, tmp_path):
    rows, names = rule_events(), [c.split()[0] for c in (LOG_EVENT + ", commit_ts timestamp").split(", ")]
    write_parts(tmp_path / "in", [[r for k, r in rows if k == b] for b in range(3)], names)
    source = spark.readStream.schema(LOG_EVENT + ", commit_ts timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = stream.stream_rules(source, RULES, DEST, str(tmp_path / "rules"), str(tmp_path / "cp"))
    q.awaitTermination(180)
    assert stream.rule_deliveries(spark, str(tmp_path / "rules")).count() == 21
