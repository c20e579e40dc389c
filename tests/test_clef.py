"""Compact and plain JSON: names of any kind, repeated names, bodies that aren't JSON, numbered lines, and back."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from logspark.sources import clef

T0 = dt.datetime(2026, 7, 23, 12)


def parsed(spark, *lines):
    return clef.parse_clef(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string"), T0).orderBy("i").collect()


def test_names_of_any_kind(spark):
    odd = {'a"b': 1, "c'd": "x", "e]": [1, {"f": '"'}], "g\\h": None, "": True, "é.$": 1.5, "line\n": "tab\t"}
    (row,) = parsed(spark, json.dumps({"@m": "x", **odd}))
    assert row.error is None and json.loads(row.properties) == odd | {"e]": '[1,{"f":"\\""}]'} and list(json.loads(row.properties)) == list(odd)
    events = clef.parse_clef(spark.createDataFrame([(json.dumps({"@m": "x", "@@t": 1, **odd}),)], "line string"), T0)
    line = json.loads(clef.to_clef(events).first().line)
    assert {k: v for k, v in line.items() if not k.startswith("@") or k.startswith("@@")} == {"@@t": 1} | odd | {"e]": '[1,{"f":"\\""}]'}


def test_one_bad_line_rejects_itself_alone(spark):
    rows = parsed(spark, '{"@m":"a","x\\"y":1}', "", "[1]", "5", '"s"', "null", '{"@m":"b"} trailing', '{"@m":"c"}', '{"@m":', None)
    assert [r.message for r in rows if r.error is None] == ["a", "c"] and [r.i for r in rows if r.error == "not a JSON object"] == [1, 2, 3, 4, 5, 6, 8, 9]


def test_repeated_names_count_once(spark):
    (row,) = parsed(spark, '{"@m":"x","A":1,"B":2,"A":3,"@m":"y"}')
    assert row.properties == '{"A":3,"B":2}' and row.message == "y"
    many = "{" + ",".join(f'"P{i % 60}":{i}' for i in range(120)) + "}"
    events = clef.parse_clef(spark.createDataFrame([("a", many)], "app_id string, line string"), T0)
    assert clef.admit(events, spark.createDataFrame([("a", 0)], "app_id string, minimum_level int"), T0).first().status == "accepted"


@pytest.mark.parametrize("stamp, error", [('"12:30"', "invalid @t"), ('"yesterday"', "invalid @t"), ("5", "invalid @t"), ('"2026-07-23"', None), ('"2026-07-23T14:00:00.1234567+02:00"', None), ('" 2026-07-23T12:00:00Z"', None)])
def test_timestamps(spark, stamp, error):
    (row,) = parsed(spark, f'{{"@t":{stamp},"@m":"x"}}')
    assert row.error == error and (error or row.ts.date() == T0.date())


def test_reserved_and_reified_members(spark):
    (row,) = parsed(spark, '{"@i":"1","@r":["x"],"@mt":5,"@x":{"a":1},"@tr":7,"@sp":"s","@ps":"p","@st":"2026-07-23T11:00:00Z","_parentSpanId":"mine","@l":"Loud","SourceContext":"Api","MachineName":"m"}')
    assert (row.template, row.exception, row.trace_id, row.span_id, row.source, row.machine) == ("5", '{"a":1}', None, "s", "Api", "m")
    assert json.loads(row.properties) == {"_parentSpanId": "p", "SourceContext": "Api", "MachineName": "m", "_spanStart": "2026-07-23T11:00:00Z", "_rawLevel": "Loud"}


def test_plain_bodies(spark):
    bodies = ['{"message":"a"},{"message":"b"}', '{"message":"c","properties":"str"}', '[{"message":"d"},7,{"timestamp":"x"}]', '{"message":"e","properties":{"A":1}}', '{"template":"Hi {A}","properties":{"A":1}}', "[]"]
    rows = clef.parse_plain(spark.createDataFrame(list(enumerate(bodies)), "i int, body string"), T0).orderBy("i", "item").collect()
    assert [(r.i, r.item, r.error, r.message if not r.error else None, r.properties if not r.error else None) for r in rows] == [
        (0, None, "not a JSON object", None, None), (1, 1, None, "c", "{}"), (2, 1, None, "d", "{}"), (2, 2, "not a JSON object", None, None), (2, 3, "invalid timestamp", None, None), (3, 1, None, "e", '{"A":1}'), (4, 1, None, "Hi 1", '{"A":1}')]
