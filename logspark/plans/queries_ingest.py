"""Queries: parsing, admission, Windows records, incremental loading, the store."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from ..functions import text
from ..sources import clef, store, windows
from .adapters import LOG_SQL, load, log_events
from .queries_search import registry

QUERIES, SQL = {}, {}
query = registry(QUERIES, SQL)
NOW = dt.datetime(2024, 2, 5)


def clef_lines(spark, d):
    """Log events as lines, some of them bad: not JSON, a bad time, an unknown level."""
    log = log_events(spark, d)
    lines = log.select("event_id", "app_id", F.struct(*[c for c in log.columns]).alias("e"))
    flat = lines.select("event_id", "app_id", "e.ts", "e.template", "e.message", "e.level", "e.exception", "e.trace_id", "e.span_id", "e.source", "e.properties")
    made = clef_rows(flat)
    bad = (F.when(F.col("event_id") % 97 == 0, F.lit("not json")).when(F.col("event_id") % 89 == 0, F.regexp_replace("line", '"@t":"[^"]*"', '"@t":"not-a-date"'))
           .when(F.col("event_id") % 83 == 0, F.regexp_replace("line", '"@l":"[^"]*"', '"@l":"Loud"')).otherwise(F.col("line")))
    return made.withColumn("line", bad)


def clef_rows(events):
    """to_clef() with event_id and app_id beside the line: they travel in the bag and come out of it again."""
    tagged = events.withColumn("properties", clef.with_member(clef.with_member(F.col("properties"), "__id", "0"), "__app", '"x"'))
    tagged = tagged.withColumn("properties", F.regexp_replace(F.regexp_replace("properties", '"__id":0', F.concat(F.lit('"__id":'), F.col("event_id").cast("string"))), '"__app":"x"', F.concat(F.lit('"__app":"'), F.col("app_id"), F.lit('"'))))
    line = F.col("line")
    rows = clef.to_clef(tagged).select(line, F.get_json_object(line, "$.__id").cast("long").alias("event_id"), F.get_json_object(line, "$.__app").alias("app_id"))
    return rows.withColumn("line", F.regexp_replace(F.regexp_replace("line", r'"__id":\d+,', ""), r'"__app":"[^"]*",', ""))


_CLEF = LOG_SQL + """, c AS (SELECT *, CASE WHEN event_id % 97 = 0 THEN 'not a JSON object' WHEN event_id % 89 = 0 THEN 'invalid @t' END AS error, event_id % 97 <> 0 AND event_id % 89 <> 0 AND event_id % 83 = 0 AS loud, event_id % 97 = 0 AS nojson FROM log)"""


@query("parse_clef", f"WITH {_CLEF} SELECT event_id, error, CASE WHEN nojson OR loud THEN 2 ELSE level END AS level, CASE WHEN NOT nojson THEN template END AS template, CASE WHEN nojson THEN '' ELSE message END AS message, CASE WHEN NOT nojson THEN exception END AS exception, CASE WHEN NOT nojson THEN trace_id END AS trace_id, CASE WHEN NOT nojson THEN source END AS source, CASE WHEN loud THEN 'Loud' END AS raw_level, CASE WHEN error IS NULL THEN CAST(epoch_us(ts) AS VARCHAR) END AS us FROM c")
def parse_clef(spark, d):
    out = clef.parse_clef(clef_lines(spark, d), NOW)
    return out.select("event_id", "error", "level", "template", "message", "exception", "trace_id", "source", F.get_json_object("properties", "$._rawLevel").alias("raw_level"), F.unix_micros("ts").cast("string").alias("us"))


@query("clef_round_trip", f"WITH {LOG_SQL} SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, CAST(k AS VARCHAR) AS k, CASE WHEN k > 49 THEN 'true' ELSE 'false' END AS flag FROM log")
def clef_round_trip(spark, d):
    log = log_events(spark, d)
    back = clef.parse_clef(clef_rows(log), NOW)
    return back.select("event_id", *[F.get_json_object("properties", f"$.{n}").alias(a) for n, a in (("UserId", "user_id"), ("K", "k"), ("Flag", "flag"))])


def _apps(spark):
    return spark.createDataFrame([(f"app-{i}", i) for i in range(4)], "app_id string, minimum_level int")


_ADMIT = LOG_SQL + """, a AS (SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-06' THEN 'timestamp too old' WHEN ts > TIMESTAMP '2024-02-05 01:00:00' THEN 'timestamp in the future' END AS reason,
  CASE app_id WHEN 'app-4' THEN 0 ELSE CAST(right(app_id, 1) AS INTEGER) END AS floor FROM log),
  s AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN level < floor THEN 'filtered' ELSE 'accepted' END AS status FROM a)"""


@query("admit", f"WITH {_ADMIT} SELECT event_id, status, reason FROM s")
def admit(spark, d):
    return clef.admit(log_events(spark, d), _apps(spark), NOW).select("event_id", "status", "reason")


@query("ingest_summary", f"WITH {_ADMIT} SELECT app_id, count_if(status <> 'rejected') AS accepted, count_if(status = 'rejected') AS rejected, 'timestamp too old' AS errors FROM s GROUP BY app_id")
def ingest_summary(spark, d):
    out = clef.ingest_summary(clef.admit(log_events(spark, d), _apps(spark), NOW))
    return out.withColumn("errors", F.array_join("errors", ","))


@query("late_events", f"WITH {_ADMIT} SELECT day, count(*) AS n, count_if(true) AS late FROM s WHERE status = 'accepted' GROUP BY day", days=True)
def late_events(spark, d):
    out = clef.mark_late_truncated(clef.admit(log_events(spark, d), _apps(spark), NOW).where("status = 'accepted'"), NOW)
    return out.groupBy("day").agg(F.count("*").alias("n"), F.count_if(F.get_json_object("properties", "$._lateArrival") == "true").alias("late"))


@query("parse_plain", f"WITH {LOG_SQL} SELECT event_id, level, message, trace_id, source, CAST(k AS VARCHAR) AS k FROM log")
def parse_plain(spark, d):
    log = log_events(spark, d)
    body = F.to_json(F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), text.level_name(F.col("level")).alias("level"), "template", F.when(F.col("template").isNull(), F.col("message")).alias("message"), F.col("trace_id").alias("traceId"),
        "source", F.try_parse_json("properties").alias("properties")))
    out = clef.parse_plain(log.select("event_id", body.alias("body")), NOW)
    return out.select("event_id", "level", "message", "trace_id", "source", F.get_json_object("properties", "$.K").alias("k"))


@query("render_templates", f"WITH {LOG_SQL} SELECT message, count(*) AS n FROM log WHERE template IS NOT NULL GROUP BY message")
def render_templates(spark, d):
    log = log_events(spark, d).where("template is not null")
    return log.select(text.render_template("template", "properties").alias("message")).groupBy("message").agg(F.count("*").alias("n"))


@query("template_tokens", f"WITH {LOG_SQL} SELECT template, CAST(len(regexp_extract_all(template, '\\{{')) AS BIGINT) AS holes, count(*) AS n FROM log WHERE template IS NOT NULL GROUP BY template")
def template_tokens(spark, d):
    log = log_events(spark, d).where("template is not null").groupBy("template").agg(F.count("*").alias("n"))
    return log.select("template", F.size(F.filter(text.tokenize_template("template"), lambda s: s["is_hole"])).cast("long").alias("holes"), "n")


@query("event_types", f"WITH {LOG_SQL} SELECT count(DISTINCT coalesce(template, message)) AS types, count(*) AS n FROM log")
def event_types(spark, d):
    return log_events(spark, d, with_type=True).agg(F.count_distinct("event_type").alias("types"), F.count("*").alias("n"))


def records(spark, d):
    e = load(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    out = e.select("event_id", F.col("ts").alias("time_created"), F.concat(F.lit("WEB0"), (F.col("user_id") % 3).cast("string")).alias("machine"), F.when(F.col("event_id") % 2 == 0, "System").otherwise("Application").alias("channel"),
                   F.concat(F.lit("Provider"), (F.col("k") % 4).cast("string")).alias("provider"), (F.col("k") % 6).alias("level"), F.when(F.col("k") % 9 != 0, F.concat(F.lit("event "), F.col("k").cast("string"))).alias("description"),
                   F.array(F.lit("a"), F.lit(" "), F.col("k").cast("string")).alias("data"), F.when(F.col("k") % 5 == 0, "00000000-0000-0000-0000-000000000000").otherwise("6f9619ff-8b86-d011-b42d-00c04fc964ff").alias("activity_id"), "k")
    # record ids follow event_id; they need not be dense for a cursor
    return out.withColumn("record_id", F.col("event_id") + 1)


_WIN = """w AS (SELECT event_id + 1 AS record_id, 'WEB0' || (user_id % 3) AS machine, CASE WHEN event_id % 2 = 0 THEN 'System' ELSE 'Application' END AS channel, ts, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_id FROM events)"""


@query("windows_records", f"""WITH {_WIN} SELECT record_id, CASE k % 6 WHEN 1 THEN 5 WHEN 2 THEN 4 WHEN 3 THEN 3 WHEN 5 THEN 0 ELSE 2 END AS level, '[' || channel || '/Provider' || (k % 4) || ' ' || event_id || ']' AS template,
  CASE WHEN k % 9 <> 0 THEN 'event ' || k ELSE 'Provider' || (k % 4) || ' event ' || event_id || ': a | ' || k END AS message, machine, CASE WHEN k % 5 <> 0 THEN '6f9619ff8b86d011b42d00c04fc964ff' END AS trace_id, CAST(k AS VARCHAR) AS data2 FROM w WHERE k % 6 = 0 OR k % 6 IN (1, 2, 3)""")
def windows_records(spark, d):
    rows = records(spark, d).where(windows.windows_level_ceiling(F.col("level"), 3))
    return windows.map_windows_events(rows, "local").select("record_id", "level", "template", "message", "machine", "trace_id", F.get_json_object("properties", "$.Data2").alias("data2"))


_CURSORS = [("WEB00", "System", 100), ("WEB01", "Application", 1_000_000_000), ("WEB02", "System", 50)]


@query("incremental_load", f"""WITH {_WIN}, c AS (SELECT * FROM (VALUES ('WEB00', 'System', 100), ('WEB02', 'System', 50)) t(machine, channel, cur)),
  r AS (SELECT w.*, row_number() OVER (PARTITION BY machine, channel ORDER BY record_id) AS rn FROM w JOIN c USING (machine, channel) WHERE record_id > cur)
  SELECT machine, channel, count(*) AS n, min(record_id) AS lo, max(record_id) AS hi FROM r WHERE rn <= 60 GROUP BY ALL""")
def incremental_load(spark, d):
    cursors = spark.createDataFrame([(*c, None) for c in _CURSORS], "machine string, channel string, last_record_id bigint, updated_ts timestamp")
    loaded, _ = windows.incremental_load(records(spark, d), cursors, 30, 2, NOW)
    return loaded.groupBy("machine", "channel").agg(F.count("*").alias("n"), F.min("record_id").alias("lo"), F.max("record_id").alias("hi"))


@query("new_cursors", f"""WITH {_WIN}, n AS (SELECT machine, channel, max(record_id) AS newest, list_sort(list(record_id)) AS ids FROM w GROUP BY ALL)
  SELECT machine, channel, CASE WHEN machine = 'WEB01' AND channel = 'Application' THEN 0 WHEN machine = 'WEB00' AND channel = 'System' THEN list_filter(ids, lambda x: x > 100)[60] WHEN machine = 'WEB02' AND channel = 'System' THEN list_filter(ids, lambda x: x > 50)[60] ELSE newest END AS last_record_id FROM n""")
def new_cursors(spark, d):
    cursors = spark.createDataFrame([(*c, None) for c in _CURSORS], "machine string, channel string, last_record_id bigint, updated_ts timestamp")
    return windows.incremental_load(records(spark, d), cursors, 30, 2, NOW)[1]


def _stored(spark, d):
    """Log events in a store of their own, in the folder that the session's executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/events-{uuid.uuid4().hex}"
    log = log_events(spark, d).drop("event_id")
    store.write_events(log, path, promoted=("Region",))
    return path


@query("event_store", f"WITH {LOG_SQL} SELECT app_id, day, count(*) AS n, count_if(k % 2 = 0 AND k % 3 = 0) AS us FROM log WHERE app_id IN ('app-1', 'app-3') AND day BETWEEN DATE '2024-01-10' AND DATE '2024-01-12' GROUP BY ALL", days=True)
def event_store(spark, d):
    rows = store.read_events(spark, _stored(spark, d), ["app-1", "app-3"], dt.date(2024, 1, 10), dt.date(2024, 1, 12))
    return rows.groupBy("app_id", "day").agg(F.count("*").alias("n"), F.count_if(F.col("p_Region") == "us").alias("us"))


@query("storage_bytes", f"WITH {LOG_SQL} SELECT app_id, CAST(count(DISTINCT day) AS BIGINT) AS days, true AS fits FROM log GROUP BY app_id")
def storage_bytes(spark, d):
    b = store.storage_bytes(spark, _stored(spark, d))
    return b.groupBy("app_id").agg(F.count("day").alias("days"), (F.sum(F.when(F.col("day").isNull(), F.col("bytes"))) == F.sum(F.when(F.col("day").isNotNull(), F.col("bytes")))).alias("fits"))
