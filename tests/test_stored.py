"""Numbered lines over splits, paths as columns, the stem index, spans of stored events, payload paths and subjects."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from logspark.functions import text as T
from logspark.functions.stem import StemIndex
from logspark.operators import rules as R
from logspark.operators import traces
from logspark.schema import LOG_EVENT
from logspark.sources import clef, store

T0 = dt.datetime(2026, 7, 23, 12)


def test_lines_are_numbered_over_splits(spark, tmp_path):
    (tmp_path / "in").mkdir()
    expected = []
    for name in ("a.clef", "b.clef"):
        lines = ["" if i % 7 == 3 else "bad" if i % 11 == 5 else json.dumps({"@m": f"{name}{i}"}) for i in range(3000)]
        (tmp_path / "in" / name).write_text("".join(x + ("\r\n" if i % 2 else "\n") for i, x in enumerate(lines)))
        expected += [(name, i + 1, x) for i, x in enumerate(lines) if x]
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = clef.number_lines(spark, str(tmp_path / "in"))
        assert rows.rdd.getNumPartitions() > 10
        assert sorted((r.file.rsplit("/", 1)[1], r.number, r.line) for r in rows.collect()) == expected
        bad = clef.reject_messages(clef.parse_clef(rows, T0)).select("file", "number", "message").collect()
        assert {r.message for r in bad} == {f"line {i}: not a JSON object" for _, i, x in expected if x == "bad"} and len(bad) == sum(x == "bad" for *_, x in expected)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep[0])
        spark.conf.set("spark.sql.files.openCostInBytes", keep[1])


def test_items_are_numbered(spark):
    got = clef.reject_messages(clef.parse_plain(spark.createDataFrame([('[{"message":"a"},5]',), ("{",)], "body string"), T0)).collect()
    assert sorted(r.message for r in got) == ["item 2: not a JSON object", "not a JSON object"]


PATHS = [
    ('{"number":42,"html_url":"http://x/42"}', "$.number", "42"), ('{"number":42,"html_url":"http://x/42"}', "html_url", "http://x/42"), ('{"ticket":{"id":7}}', "$.ticket.id", "7"), ('{"ticket":{"id":7}}', "$ticket", '{"id":7}'),
    ('{"items":[{"id":1},{"id":2}]}', "$.items[1].id", "2"), ('{"a":[[1,"x"]]}', "$.a[0][1]", "x"), ("[5,6]", "$[1]", "6"), ('{"a":[1]}', "$.a[1]", None), ('{"a":[1]}', "$.a[-1]", None), ('{"a":1}', "$.missing", None), ("not json", "$.a", None), ('{"a":1} x', "$.a", None),
    ('{"a":1}', None, None), ('{"a":1}', " ", None), ('{"a":null}', "$.a", None), ('{"a":true}', "$..a", "true"), ('{"a b":"c\\"d"}', "$.a b", 'c"d'), ('{"a":{"b":1}}', "$.a[0]", None), ('{"a":[7]}', "$.a[x][0]", "7"), ('{"a":[7]}', "$.a.b", None), (None, "$.a", None), ('{"a":1}', "$", '{"a":1}')]


def test_paths_as_a_column(spark):
    rows = spark.createDataFrame([(i, d, p) for i, (d, p, _) in enumerate(PATHS)], "i int, d string, p string")
    assert [r.v for r in rows.select("i", T.json_path(F.col("d"), F.col("p")).alias("v")).orderBy("i").collect()] == [x for *_, x in PATHS]


def event(i, message, exception=None, app="a", day=0, **more):
    at = T0 + dt.timedelta(days=day)
    row = {"app_id": app, "day": at.date(), "id": i, "ts": at, "level": 4, "template": "T", "message": message, "exception": exception, "event_type": 9, "properties": "{}"} | more
    return tuple(row.get(c) for c in store.COLUMNS)


def test_stem_index(spark, tmp_path):
    index = StemIndex(spark, str(tmp_path / "stems"))
    assert index.search("payment").count() == 0
    first = [event(1, "Payments failed", "Timeout café"), event(2, "payment ok"), event(3, "Failing payments", app="b")]
    second = [event(1, "payment fails", day=1), event(2, None, "PAYMENT failed", day=1), event(3, "", day=1)]
    index.add(spark.createDataFrame(first, LOG_EVENT))
    index.add(spark.createDataFrame(second, LOG_EVENT))
    found = lambda *a, **k: sorted((r.app_id, r.day.day, r.id) for r in index.search(*a, **k).collect())
    assert found("payment fail") == [("a", 23, 1), ("a", 24, 1), ("a", 24, 2), ("b", 23, 3)]
    assert found("failing PAYMENTS", apps=["a"], start=T0.date() + dt.timedelta(days=1)) == [("a", 24, 1), ("a", 24, 2)] and found("cafe timeouts", end=T0.date()) == [("a", 23, 1)]
    assert found("payment refused") == [] and len(found("")) == 5
    plan = index.search("payment fail")._jdf.queryExecution().executedPlan().toString()
    assert "message" not in plan and "EqualTo(stem" in plan


def test_spans_of_stored_events(spark, tmp_path):
    at = lambda s: (T0 + dt.timedelta(seconds=s)).isoformat() + "Z"
    lines = [{"@t": at(10), "@m": "root", "@tr": "t", "@sp": "a", "@st": at(0)}, {"@t": at(8), "@m": "child", "@tr": "t", "@sp": "b", "@ps": "a", "@st": at(1)}, {"@t": at(3), "@m": "line", "@tr": "t", "@sp": "b"}, {"@t": at(4), "@m": "no start", "@tr": "t", "@st": "12:00"}]
    log = clef.parse_clef(spark.createDataFrame([("app", i + 1, json.dumps(x)) for i, x in enumerate(lines)], "app_id string, id bigint, line string"), T0).withColumn("day", F.to_date("ts"))
    for k, rows in enumerate((log, None)):
        if rows is None:
            store.write_events(log.select(store.COLUMNS), str(tmp_path / "store"), spans=True)
            rows = store.read_events(spark, str(tmp_path / "store"))
            assert {"start_ts", "parent_span_id"} <= set(rows.columns)
        out = traces.span_tree(traces.waterfall(traces.link_spans(traces.limit_traces(traces.assemble_traces(rows)))))
        got = {r.message: r for r in out.collect()}
        assert [(got[m].depth, got[m].is_span, round(got[m].left_pct), round(got[m].width_pct)) for m in ("root", "child", "line", "no start")] == [(0, True, 0, 100), (1, True, 10, 70), (2, False, 30, 0), (0, False, 40, 0)], k
        assert got["root"].event_id == "20260723:1"


def test_payload_paths_and_subjects(spark):
    rows = [event(i, f"m{i}", app="billing", properties='{"K":"v"}') + (T0 + dt.timedelta(minutes=i),) for i in (1, 2)]
    events = spark.createDataFrame(rows, LOG_EVENT + ", commit_ts timestamp")
    body = '{"a":"{{app.name}}","r":"{{rule.name}}","f":"{{occurrence.firstSeen}}","l":"{{occurrence.lastSeen}}","n":"{{occurrence.count}}","e":"{{link.event}}","s":"{{link.search}}","t":"{{event.timestamp}}","k":"{{event.properties.K}}"}'
    destinations = [{"id": "mail", "body_template": body, "subject_template": "[{{event.level}}] \"{{event.message}}\" in {{app.name}}", "is_enabled": True}, {"id": "hook", "body_template": "{{event.message}}", "is_enabled": True}]
    rules = [R.default_rule(id="r", name="Errors", destination_id="mail", cooldown_minutes=0, threshold_window_minutes=60), R.default_rule(id="h", destination_id="hook")]
    _, fired, _ = R.evaluate_rules(events, rules, destinations)
    out = R.enqueue_deliveries(fired, rules, destinations, {"billing": "Billing app"}, "https://logs").orderBy("rule_id", "created_ts").collect()
    hook, first, second = out
    assert (hook.subject, hook.status, hook.error) == (None, 2, "rendered body is not valid JSON")
    assert second.subject == '[Error] "m2" in Billing app' and json.loads(second.request_body) == {
        "a": "Billing app", "r": "Errors", "f": "2026-07-23T12:01:00.0000000+00:00", "l": "2026-07-23T12:02:00.0000000+00:00", "n": "2", "e": "https://logs/apps/billing/events/20260723:2", "s": "https://logs/apps/billing/search?eventType=9", "t": "2026-07-23T12:00:00.0000000+00:00", "k": "v"}


@pytest.mark.parametrize("body, ok", [('{"a":1}', True), ("[1]", True), ('{"a":1}}', False), ('{"a":1} {"b":2}', False), ("", False), ('{"a":1},{"b":2}', False), ('"s"', True), (" 5 ", True), ("5],[", False)])
def test_valid_json_is_one_value(spark, body, ok):
    assert spark.createDataFrame([(body,)], "b string").select(T.valid_json(F.col("b"))).first()[0] is ok


def test_presets_render_to_json(spark):
    from logspark.operators.deliveries import presets

    values = json.dumps({"event.message": 'quote " and\nline', "event.exception": "at x\n\tat \\y", "event.level": "Error", "app.id": "a", "link.event": "https://logs/apps/a/events/1"})
    rows = presets(spark).withColumn("body", T.render_payload(F.col("body_template"), F.lit(values))).collect()
    assert len(rows) == 7
    for r in rows:
        body = json.dumps(json.loads(r["body"]))
        assert "https://logs/apps/a/events/1" in body and 'quote \\" and\\nline' in body, r["name"]
