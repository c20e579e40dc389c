import pytest
from pyspark.sql import functions as F

from logspark.functions import text as T


@pytest.mark.parametrize("template, bag, out", [
    ("Hi {Name}", {"Name": "Ann"}, "Hi Ann"), ("{A} {B}", {"A": 1}, "1 B"), ("{{x}} {@A} {$A}", {"A": True}, "{x} true true"), ("{Amount,8:F2}", {"Amount": 49.9}, "49.90"),
    ("{N:D5} {Z:0.00}", {"N": 42, "Z": 1.5}, "00042 1.50"), ("open {Name", {"Name": 1}, "open {Name"), ("{}", {}, "{}"), ("{V}", {"V": 1000.0}, "1000"), ("{N:N0}", {"N": 12345.0}, "12,345")])
def test_render(template, bag, out):
    assert T.render(template, bag) == out


@pytest.mark.parametrize("template, values, out", [
    ('{"a":"{{x}}"}', {"x": 'q"\n'}, '{"a":"q\\"\\n"}'), ('{"a":"{{x | json}}"}', {"x": 'q"'}, '{"a":"q\\""}'), ("{{x | upper}}", {"x": "ab"}, "AB"), ("{{x | truncate:2}}", {"x": "abc"}, "ab…"),
    ('{{y | default:"none"}}', {}, "none"), ("{{y}}|{{x | nope}}", {"x": "1"}, "|1")])
def test_payload(template, values, out):
    assert T.payload(template, True)(values) == out


def test_levels_hash_and_paths(spark):
    df = spark.createDataFrame([("Verbose", 0), ("debug", 1), ("WARNING", 3), ("Trace", 0), ("Warn", 3), ("Critical", 5), ("3", 3), (None, None), ("", None), ("Loud", None), ("9", None)], "n string, e int")
    assert df.where(~T.level_lookup(F.col("n")).eqNullSafe(F.col("e"))).count() == 0
    h = spark.createDataFrame([("", None), (None, "a")], "t string, m string").select(T.event_type_hash(F.col("t"), F.col("m")).alias("h"))
    assert [r.h for r in h.collect()] == [-1205034819632174695, -3292477735350538661]
    j = spark.createDataFrame([('{"a":{"b":[[1,"x"]]},"n":null}',), ("bad",)], "j string")
    got = j.select(T.json_path(F.col("j"), "$.a.b[0][1]"), T.json_path(F.col("j"), "a.b"), T.json_path(F.col("j"), "n"), T.valid_json(F.col("j"))).collect()
    assert [tuple(r) for r in got] == [("x", '[[1,"x"]]', None, True), (None, None, None, False)]


@pytest.mark.parametrize("word, want", [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("conditional", "condit"), ("triplicate", "triplic"), ("revival", "reviv"), ("adoption", "adopt"), ("probate", "probat"), ("controlling", "control"), ("payments", "payment"), ("failed", "fail")])
def test_stem(word, want):
    from logspark.functions.stem import stem

    assert stem(word) == want


def test_stem_search(spark):
    from logspark.functions.stem import stem_search, token_table

    df = spark.createDataFrame([("Payments failed", "Timeout café"), ("payment ok", None)], "message string, exception string")
    assert df.where(stem_search("payment failing")).count() == 1 and df.where(stem_search("CAFE timeouts")).count() == 1 and df.where(stem_search("paid")).count() == 0
    assert token_table(df, ["message"]).where("stem = 'payment'").count() == 2
