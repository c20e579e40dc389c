import datetime as dt

from pyspark.sql import functions as F

from logspark.operators import deliveries as D
from logspark.operators import ids, maintain, search, stats, traces
from logspark.operators import rules as R
from logspark.sources import clef, store
from logspark.streaming import stream

T0 = dt.datetime(2026, 7, 23, 12)


def log(spark, n, app="billing"):
    rows = [(app, T0.date(), i + 1, T0 + dt.timedelta(seconds=i), 4, "T", f"m{i}", None, 1, "t1", None, "Api", None, "{}") for i in range(n)]
    from logspark.schema import LOG_EVENT

    return spark.createDataFrame(rows, LOG_EVENT)


def test_pages_are_complete(spark):
    events, seen, cursor = log(spark, 25).cache(), [], None
    while True:
        rows, cursor = search.page(events, 10, cursor, app="billing")
        seen += [r.id for r in rows]
        if cursor is None:
            break
    assert seen == list(range(25, 0, -1)) and ids.decode_cursor("bad") is None


def test_row_ids_continue(spark):
    df = spark.range(10).select(F.lit("a").alias("app_id"), F.lit(T0.date()).alias("day"), (F.col("id") * 3).alias("seq"))
    top = spark.createDataFrame([("a", T0.date(), 5)], "app_id string, day date, max_id bigint")
    got = [r.id for r in ids.assign_row_ids(df, "seq", top, split=4).orderBy("seq").collect()]
    assert got == list(range(6, 16))


def test_histogram_and_acks(spark):
    rows = [("billing", T0.date(), i, T0 + dt.timedelta(minutes=m), lv, s) for i, (m, lv, s) in enumerate([(1, 2, "Api"), (2, 2, "Api"), (3, 4, "Api"), (50, 3, "Worker")])]
    e = spark.createDataFrame(rows, "app_id string, day date, id int, ts timestamp, level int, source string")
    h = stats.histogram(e, "billing", T0, T0 + dt.timedelta(hours=1)).collect()
    assert len({r.bucket for r in h}) == 60 and {r.bucket: r.n for r in h if r.n} == {1: 1, 2: 1, 3: 1, 50: 1}
    acks = spark.createDataFrame([("billing", "*", T0, "x", "u", T0), ("billing", "*", T0 - dt.timedelta(days=1), "y", "u", T0 + dt.timedelta(days=1)), ("billing", "other", T0, "z", "u", T0)], "app_id string, scope string, through_ts timestamp, note string, acked_by string, created_ts timestamp")
    snap = stats.ack_snapshot(acks).collect()
    assert len(snap) == 1 and snap[0].through_ts == T0 and snap[0].note == "y"


def span(i, start, end, sid, parent=None):
    t = lambda s: None if s is None else T0 + dt.timedelta(seconds=s)
    return ("t", "a", f"{i}", t(end), t(start), sid, parent, 2)


SPANS = "trace_id string, app_id string, event_id string, ts timestamp, start_ts timestamp, span_id string, parent_span_id string, level int"


def tree(spark, rows):
    linked = traces.link_spans(traces.limit_traces(spark.createDataFrame(rows, SPANS)))
    return {r.event_id: r for r in traces.span_tree(traces.waterfall(linked)).collect()}


def test_tree_depths_rings_and_geometry(spark):
    got = tree(spark, [span(1, 0, 10, "a"), span(2, 1, 8, "b", "a"), span(3, 2, 4, "c", "b"), span(4, 11, 12, "d", "gone"), span(5, None, 3, "c")])
    assert [got[k].depth for k in "1234"] == [0, 1, 2, 0] and got["5"].depth == 3 and [got[k].row for k in ("1", "2", "3", "5", "4")] == [1, 2, 3, 4, 5]
    assert abs(got["2"].left_pct - 100 / 12) < 1e-6 and got["5"].width_pct == 0
    ring = tree(spark, [span(1, 0, 3, "a", "b"), span(2, 1, 4, "b", "a"), span(3, 2, 5, "c", "a")])
    assert ring["1"].depth == 0 and ring["2"].depth == 1 and ring["3"].depth == 1
    assert tree(spark, [span(1, 0, 0, "a")])["1"].left_pct == 0


def committed(spark, n, step=0, level=4, template="T"):
    rows = [("billing", T0.date(), i + 1, T0 + dt.timedelta(minutes=step * i), level, template, f"m{i}", None, i if step < 0 else 1, None, None, None, None, f'{{"K":{i}}}', T0 + dt.timedelta(minutes=step * i)) for i in range(n)]
    from logspark.schema import LOG_EVENT

    return spark.createDataFrame(rows, LOG_EVENT + ", commit_ts timestamp")


DEST = [{"id": "d", "body_template": '{"m":"{{event.message}}"}', "rate_limit_per_hour": 60, "is_enabled": True}]


def test_rules(spark):
    dedupe = R.default_rule(id="r", minimum_level=4)
    state, fired, off = R.evaluate_rules(committed(spark, 30), [dedupe], DEST)
    assert state.first()["count"] == 30 and fired.count() == 1 and off.count() == 0
    many = R.default_rule(id="r", dedupe_key_template="{{event.properties.K}}")
    state, fired, off = R.evaluate_rules(committed(spark, 37), [many], DEST)
    assert fired.count() == 20 and off.count() == 1 and state.count() == 20
    third = R.default_rule(id="r", trigger_type=1, threshold_count=5)
    assert [r.id for r in R.evaluate_rules(committed(spark, 7, 1), [third], DEST)[1].collect()] == [5]
    storm = R.evaluate_rules(committed(spark, 150), [dedupe], DEST)
    assert storm[1].count() == 1 and storm[0].first()["dedupe_key"] == "storm" and storm[0].first()["count"] == 150
    cool = R.evaluate_rules(committed(spark, 5, 30), [dedupe], DEST)
    assert sorted(r.id for r in cool[1].collect()) == [1, 3, 5]
    dry = R.evaluate_rules(committed(spark, 3), [R.default_rule(id="r", is_dry_run=True)], DEST)
    assert dry[1].count() == 0 and dry[0].first()["count"] == 3
    bodies = R.enqueue_deliveries(fired, [many], DEST).collect()
    assert all(b.status == 0 for b in bodies) and bodies[0].request_body.startswith('{"m":"m')
    assert R.compile_rules([R.default_rule(id="x", filter="Level >>> 5")])[1]["x"].startswith("filter does not parse")


def test_second_run_equals_one_run(spark):
    rule = [R.default_rule(id="r", cooldown_minutes=45)]
    e = committed(spark, 8, 20).cache()
    whole = R.evaluate_rules(e, rule, DEST)[0].first()
    half = R.evaluate_rules(e.where("id <= 4"), rule, DEST)[0]
    again = R.evaluate_rules(e.where("id > 4"), rule, DEST, half)[0].first()
    assert whole == again


def test_outcomes(spark):
    d = spark.createDataFrame([(str(i), "d", 0, T0, 0, T0, 0, None, None) for i in range(5)], "id string, destination_id string, source int, created_ts timestamp, attempt int, next_attempt_ts timestamp, status int, response_status int, response_snippet string")
    out = spark.createDataFrame([("0", 200, "ok"), ("1", 404, ""), ("2", 500, ""), ("3", 429, ""), ("4", None, None)], "id string, response_status int, response_body string")
    dest = spark.createDataFrame([("d", 6, None)], "id string, max_attempts int, circuit_open_until_ts timestamp")
    got = {r.id: (r.status, r.attempt, r.next_attempt_ts) for r in D.apply_outcomes(d, out, dest, T0).collect()}
    later = T0 + dt.timedelta(seconds=5)
    assert got == {"0": (1, 0, None), "1": (3, 0, None), "2": (0, 1, later), "3": (0, 1, later), "4": (0, 1, later)}


def test_retention(spark):
    days = [T0.date() - dt.timedelta(days=i) for i in range(5)]
    p = spark.createDataFrame([(a, x, 1024 * 1024) for a in "ab" for x in days], "app_id string, day date, bytes bigint")
    apps = spark.createDataFrame([("a", 3, 100), ("b", 30, 3)], "app_id string, retention_days int, max_size_mb int")
    got = maintain.retention_plan(p, apps, T0.date(), 0, 4 * 1024 * 1024).collect()
    assert {(r.app_id, r.reason) for r in got} == {("a", "retention"), ("b", "size"), ("a", "disk")} and len(got) == 4


def test_clef_rejects_and_marks(spark):
    lines = spark.createDataFrame([("not json",), ('{"@t":"x"}',), ('{"@mt":"Hi {A}","A":{"b":1},"@l":"Loud","@@x":1,"@ps":"p"}',), ('{"@m":"é","@l":3,"@t":"2026-07-23T12:00:00+02:00"}',)], "line string")
    got = clef.parse_clef(lines, T0).collect()
    assert got[0].error == "not a JSON object" and got[1].error == "invalid @t"
    assert got[2].level == 2 and got[2].ts == T0 and got[2].properties == '{"A":"{\\"b\\":1}","@x":1,"_parentSpanId":"p","_rawLevel":"Loud"}'
    assert got[3].level == 3 and got[3].message == "é" and got[3].ts == dt.datetime(2026, 7, 23, 10)


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / f"in/{k}.json").write_text("".join(f'{{"app_id":"a","seq":{10 * k + i},"line":"{{\\"@t\\":\\"2026-07-23T12:00:0{i}Z\\",\\"@m\\":\\"m{i}\\"}}"}}\n' for i in range(5)))
    apps = spark.createDataFrame([("a", 0)], "app_id string, minimum_level int")
    lines = spark.readStream.schema("app_id string, seq bigint, line string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = stream.stream_ingest(lines, str(tmp_path / "store"), apps, str(tmp_path / "cp"), clock=lambda: T0)
    q.awaitTermination(120)
    rows = store.read_ingested(spark, str(tmp_path / "store"), ["a"], T0.date(), T0.date()).orderBy("id").collect()
    assert [r.id for r in rows] == list(range(1, 11))


def test_a_batch_that_runs_again_gives_its_own_rows(spark, tmp_path):
    apps = spark.createDataFrame([("a", 0)], "app_id string, minimum_level int")
    path = str(tmp_path / "store")
    for k in (0, 1, 2, 1):
        lines = spark.createDataFrame([("a", k, f'{{"@t":"2026-07-23T12:00:0{k}Z","@m":"m{k}"}}')], "app_id string, seq bigint, line string")
        assert [r.message for r in stream.ingest_batch(lines, path, apps, T0, k).collect()] == [f"m{k}"]
    assert store.read_ingested(spark, path, ["a"], T0.date(), T0.date()).count() == 3


def test_plain_bodies_are_rejected_by_item(spark):
    bodies = spark.createDataFrame([("1", "not json"), ("2", '[{"message":"x","properties":{"K":[1,"a"]}},5]'), ("3", "[]"), ("4", None), ("5", '{"message":"y"}')], "key string, body string")
    got = sorted((r.key, r.message, r.error) for r in clef.parse_plain(bodies, T0).collect() if not r.error)
    assert got == [("2", "x", None), ("5", "y", None)]
    assert sorted(r.key for r in clef.parse_plain(bodies, T0).collect() if r.error == "not a JSON object") == ["1", "2", "4"]


def test_keys_hold_level_names(spark):
    assert [r.key for r in log(spark, 1).select(R.dedupe_key("{{event.level}}-{{app.id}}").alias("key")).collect()] == ["Error-billing"]


def test_a_span_needs_no_id(spark):
    t = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [("t", 1, t(5), t(0), "p", None), ("t", 2, t(4), t(1), None, "p"), ("t", 3, t(6), None, "p", None)]
    got = traces.link_spans(spark.createDataFrame(rows, "trace_id string, place int, ts timestamp, start_ts timestamp, span_id string, parent_span_id string")).orderBy("place").collect()
    assert [(r.is_span, r.parent) for r in got] == [(True, None), (True, 1), (False, 1)]


def test_frames_drop_the_oldest(spark):
    rows = [("s", T0, i) for i in range(500)]
    got = stream.frames(spark.createDataFrame(rows, "sub_id string, arrived timestamp, key bigint"), size=50, ring=100).orderBy("seq", "key").collect()
    assert len(got) == 100 and got[0].dropped == 400 and got[0].key == 400 and {r.seq for r in got} == {1, 2}


def test_plans_have_no_cross_product(spark):
    import __spark_entry__ as entry

    for name in ("context_window", "search_page", "match_rules", "event_ids"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_bodies_are_computed_once_in_plain_parsing(spark):
    """Bodies made by an expression, whose cost once multiplied with the places that read them; the whole plan holds it once."""
    made = spark.range(4).select("id", F.expr("concat('{\"message\":\"', reverse(cast(id as string)), '\"}')").alias("body"))
    out = clef.parse_plain(made, T0).select("id", "message")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("reverse(") == 1 and sorted(r.message for r in out.collect()) == ["0", "1", "2", "3"]
    odd = spark.createDataFrame([(0, "[]"), (1, None), (2, "[1, {}]"), (3, "{} {}")], "id long, body string")
    assert sorted((r.id, r.item, r.error) for r in clef.parse_plain(odd, T0).collect() if r.id != 1 and r.id != 3) == [(2, 1, "not a JSON object"), (2, 2, None)]
    assert [(r.item, r.error) for r in clef.parse_plain(odd, T0).collect() if r.id in (1, 3)] == [(None, "not a JSON object")] * 2


def test_spans_are_linked_and_placed_without_a_join(spark):
    """Events are read once: neither parents nor rows of the tree come by a join of the events with themselves. Traces go on over Arrow batches."""
    rows = spark.range(3000).selectExpr("concat('t', id % 3) as trace_id", "'a' as app_id", "cast(id as string) as event_id", "timestamp_seconds(id + 10) as ts", "timestamp_seconds(id) as start_ts",
                                        "concat('s', id) as span_id", "case when id > 2 then concat('s', id - 3) end as parent_span_id", "2 as level")
    out = traces.span_tree(traces.link_spans(traces.limit_traces(rows, 2000)))
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = out.select("trace_id", "place", "parent", "depth", "row").collect()
    assert len(got) == 3000 and all(r.depth == r.place - 1 and r.row == r.place and r.parent == (r.place - 1 or None) for r in got)


def test_context_windows_make_no_pairs(spark):
    """The newest events of each anchor by day and id, from a table where every event is near every anchor: 400 rows leave 5 an anchor, and no step holds their 160,000 pairs."""
    events = log(spark, 400).withColumn("ts", F.lit(T0) + F.make_dt_interval(secs=F.col("id") % 100))
    anchors = events.select("app_id", F.col("id").alias("anchor_id"), F.col("ts").alias("anchor_ts"))
    out = search.context_window(events, anchors, minutes=1, limit=5)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    got, secs = {}, {i: i % 100 for i in range(1, 401)}
    for r in out.select("anchor_id", "id", "rank").collect():
        got.setdefault(r.anchor_id, {})[r.rank] = r.id
    assert "Join Inner" not in plan and len(got) == 400
    assert all([got[i][k] for k in range(1, 6)] == [j for j in range(400, 0, -1) if abs(secs[i] - secs[j]) <= 60][:5] for i in got)
