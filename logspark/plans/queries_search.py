"""Queries: filters, search, lookups, histograms, facets, statistics, acknowledgements."""

from __future__ import annotations

import datetime as dt
import uuid
from functools import reduce

from pyspark.sql import functions as F

from ..functions.filters import add_clause, filter_expr, with_variant
from ..functions.stem import StemIndex, stem_search
from ..functions.text import level_name, level_number
from ..operators import ids, search, stats
from ..shared import shared_dir
from .adapters import LOG_SQL, load, log_events

QUERIES, SQL = {}, {}
UTC = dt.timezone.utc
FROM, TO = dt.datetime(2024, 1, 8), dt.datetime(2024, 1, 15)


def registry(queries: dict, sql_of: dict):
    def query(name: str, sql: str | None = None, days: bool = False):
        """days: a column day, which both sides give as text."""
        def add(f):
            queries[name] = (lambda spark, d: f(spark, d).withColumn("day", F.col("day").cast("string"))) if days else f
            if sql:
                sql_of[name] = f"SELECT * REPLACE (CAST(day AS VARCHAR) AS day) FROM ({sql})" if days else sql
            return f
        return add
    return query


query = registry(QUERIES, SQL)


# Filters and the same conditions in SQL; ks is K as text where it is a string, kn where it is a number.
FILTERS = {
    "number": ("K > 50", "kn > 50"),
    "number_on_string": ("K = '14'", "CASE WHEN k IS NULL THEN NULL ELSE CAST(k AS VARCHAR) = '14' END"),
    "mismatch": ("K != 14", "CASE WHEN ks IS NOT NULL THEN true ELSE kn <> 14 END"),
    "not_mismatch": ("not K = 14", "NOT CASE WHEN ks IS NOT NULL THEN false ELSE kn = 14 END"),
    "missing": ("TenantId = 42 or Region = 'us'", "tenant = 42 OR region = 'us'"),
    "not_missing": ("not TenantId = 42", "NOT (tenant = 42)"),
    "flat_precedence": ("Level = Error or Region = 'us' and TenantId > 41", "(level = 4 OR region = 'us') AND tenant > 41"),
    "boolean": ("Flag = true and Flag != 5", "k > 49"),
    "boolean_order": ("Flag > true", "false"),
    "like": ("Message like '%FAILED for 1_'", "message ILIKE '%FAILED for 1_'"),
    "is_null": ("Nothing is null and Region is not null", "region IS NOT NULL"),
    "column_name": ("Machine = 'GIT4A'", "machine = 'GIT4A'"),
    "property_name": ("Properties.Machine = 'GIT4A'", "pmachine = 'GIT4A'"),
    "level_text": ("Level = '4' and (Source = 'Auth' or Exception is not null)", "level = 4 AND (source = 'Auth' OR exception IS NOT NULL)"),
    "level_word": ("Level >= Warning and not (Source = 'Billing')", "level >= 3 AND NOT (source = 'Billing')"),
}
PROPS = LOG_SQL + """, p AS (SELECT *, CASE WHEN k % 7 = 0 THEN CAST(k AS VARCHAR) END AS ks, CASE WHEN k % 7 <> 0 THEN k END AS kn,
  CASE WHEN k % 5 < 3 THEN 40 + k % 6 END AS tenant, CASE WHEN k % 2 = 0 THEN CASE k % 3 WHEN 0 THEN 'us' WHEN 1 THEN 'eu' ELSE 'apac' END END AS region,
  CASE WHEN k % 5 < 3 THEN CASE k % 2 WHEN 0 THEN 'GIT4A' ELSE 'PAYJS2' END END AS pmachine FROM log)"""


@query("filters", f"WITH {PROPS} SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{n}' AS filter, app_id, count(*) AS n FROM p WHERE {c} GROUP BY app_id" for n, (_, c) in FILTERS.items()) + ")")
def filters(spark, d):
    """All filters in one scan: a sum for each."""
    rows = with_variant(log_events(spark, d))
    hit = [F.sum(F.coalesce(filter_expr(t).cast("long"), F.lit(0))).alias(n) for n, (t, _) in FILTERS.items()]
    wide = rows.groupBy("app_id").agg(*hit)
    return wide.unpivot("app_id", list(FILTERS), "filter", "n").where("n > 0").select("filter", "app_id", "n")


@query("drill_down", f"WITH {PROPS} SELECT app_id, day, id FROM p WHERE level >= 3 AND pmachine = 'GIT4A' AND NOT (source = 'Auth')", days=True)
def drill_down(spark, d):
    text = add_clause(add_clause("Level >= Warning", "Machine", "GIT4A", is_property=True), "Source", "Auth", negate=True)
    return search.event_query(log_events(spark, d), where=text).select("app_id", "day", "id")


@query("event_query", f"WITH {LOG_SQL} SELECT app_id, day, id, ts, level, message FROM log WHERE app_id = 'app-1' AND level >= 3 AND ts >= TIMESTAMP '2024-01-08' AND ts <= TIMESTAMP '2024-01-15' AND (message ILIKE '%payment%' OR exception ILIKE '%payment%') AND (message ILIKE '%timed%' OR exception ILIKE '%timed%')", days=True)
def event_query(spark, d):
    rows = search.event_query(log_events(spark, d), app="app-1", start=FROM, end=TO, level=3, text="Payment TIMED")
    return rows.select("app_id", "day", "id", F.col("ts").cast("timestamp_ntz").alias("ts"), "level", "message")


@query("search_page", f"WITH {LOG_SQL} SELECT day, id, level, message FROM log WHERE app_id = 'app-2' AND level >= 2 ORDER BY day DESC, id DESC LIMIT 101", days=True)
def search_page(spark, d):
    return search.search(log_events(spark, d), app="app-2", level=2).select("day", "id", "level", "message")


@query("search_next", f"WITH {LOG_SQL} SELECT day, id, message FROM log WHERE app_id = 'app-2' AND (day < DATE '2024-01-20' OR (day = DATE '2024-01-20' AND id < 5)) ORDER BY day DESC, id DESC LIMIT 51", days=True)
def search_next(spark, d):
    cursor = ids.encode_cursor(dt.date(2024, 1, 20), 5)
    return search.search(log_events(spark, d), 50, cursor, app="app-2").select("day", "id", "message")


@query("get_by_id", f"WITH {LOG_SQL} SELECT app_id, day, id, message FROM log WHERE level = 5", days=True)
def get_by_id(spark, d):
    log = log_events(spark, d)
    wanted = log.where("level = 5").select("app_id", ids.event_id(F.col("day"), F.col("id")).alias("event_id"))
    return search.get_by_id(log, wanted).select("app_id", "day", "id", "message")


@query("count_by_type", f"WITH {LOG_SQL} SELECT app_id, template, count(*) AS n FROM log JOIN (SELECT app_id, day FROM (SELECT app_id, day, row_number() OVER (PARTITION BY app_id ORDER BY day DESC) AS r FROM (SELECT DISTINCT app_id, day FROM log)) WHERE r <= 10) USING (app_id, day) WHERE template IS NOT NULL GROUP BY ALL")
def count_by_type(spark, d):
    log = log_events(spark, d)
    types = log.where("template is not null").select("app_id", "template").distinct()
    return search.count_by_event_type(log, types, "template", 10).where("n > 0").select("app_id", "template", "n")


@query("context_window", f"""WITH {LOG_SQL}, a AS (SELECT app_id, event_id AS anchor_id, ts AS anchor_ts FROM log WHERE level = 5)
  SELECT app_id, anchor_id, event_id, rank FROM (SELECT a.app_id, anchor_id, event_id, row_number() OVER (PARTITION BY a.app_id, anchor_id ORDER BY day DESC, id DESC) AS rank
  FROM log JOIN a ON log.app_id = a.app_id AND ts BETWEEN anchor_ts - INTERVAL 20 MINUTE AND anchor_ts + INTERVAL 20 MINUTE) WHERE rank <= 80""")
def context_window(spark, d):
    log = log_events(spark, d)
    anchors = log.where("level = 5").select("app_id", F.col("event_id").alias("anchor_id"), F.col("ts").alias("anchor_ts"))
    return search.context_window(log.select("app_id", "day", "id", "ts", "event_id"), anchors, minutes=20).select("app_id", "anchor_id", "event_id", F.col("rank").cast("long").alias("rank"))


_NAMES = "['UserId', 'Value', 'K', CASE WHEN k % 5 < 3 THEN 'TenantId' END, CASE WHEN k % 2 = 0 THEN 'Region' END, CASE WHEN k % 5 < 3 THEN 'Machine' END, 'Flag', CASE WHEN k % 11 = 0 THEN 'Nothing' END]"


@query("discover_properties", f"""WITH {LOG_SQL}, e AS (SELECT row_number() OVER (ORDER BY day DESC, id DESC, app_id) AS rn, list_filter({_NAMES}, lambda x: x IS NOT NULL) AS names FROM log),
  u AS (SELECT rn, unnest(names) AS name, generate_subscripts(names, 1) AS i FROM e), f AS (SELECT name, min(rn * 100 + i) AS first FROM u GROUP BY name)
  SELECT name, CAST(row_number() OVER (ORDER BY first) AS INTEGER) AS position FROM f ORDER BY first LIMIT 20""")
def discover_properties(spark, d):
    return search.discover_properties(log_events(spark, d))


@query("pivot_properties", f"WITH {PROPS} SELECT event_id, coalesce(CAST(tenant AS VARCHAR), '') AS \"TenantId\", coalesce(region, '') AS \"Region\", CASE WHEN k > 49 THEN 'true' ELSE 'false' END AS \"Flag\", CASE WHEN k % 11 = 0 THEN 'null' ELSE '' END AS \"Nothing\" FROM p")
def pivot_properties(spark, d):
    return search.pivot_properties(log_events(spark, d).select("event_id", "properties"), ["TenantId", "Region", "Flag", "Nothing"]).drop("properties")


SAVED = [("errors", "app-0", '{"level": 4, "range": "7d"}'), ("pay", "app-1", '{"q": "payment", "range": "any"}'), ("us", "app-2", '{"filter": "Region = \'us\'", "range": "24h"}'), ("plain", "app-3", "{}")]


@query("saved_searches", f"""WITH {PROPS}
  SELECT 'errors' AS search_id, count(*) AS n FROM p WHERE app_id = 'app-0' AND level >= 4 AND ts >= TIMESTAMP '2024-01-23' UNION ALL SELECT 'pay', count(*) FROM p WHERE app_id = 'app-1' AND (message ILIKE '%payment%' OR exception ILIKE '%payment%')
  UNION ALL SELECT 'us', count(*) FROM p WHERE app_id = 'app-2' AND region = 'us' AND ts >= TIMESTAMP '2024-01-29' UNION ALL SELECT 'plain', count(*) FROM p WHERE app_id = 'app-3' AND ts >= TIMESTAMP '2024-01-29'""")
def saved_searches(spark, d):
    return search.run_saved_searches(log_events(spark, d), SAVED, dt.datetime(2024, 1, 30, tzinfo=UTC))


_HIST = f"""WITH {LOG_SQL}, b AS (SELECT CAST(least(59, greatest(0, (epoch_us(ts) - 1704672000000000) // (604800000000 // 60))) AS INTEGER) AS bucket, level FROM log
  WHERE app_id = 'app-1' AND level >= 3 AND ts >= TIMESTAMP '2024-01-08' AND ts <= TIMESTAMP '2024-01-15'), c AS (SELECT bucket, level, count(*) AS n FROM b GROUP BY ALL)
  SELECT CAST(r.range AS INTEGER) AS bucket, make_timestamp(1704672000000000 + r.range * (6048000000000 // 60) // 10) AS label, c.level, coalesce(n, 0) AS n FROM range(60) r LEFT JOIN c ON c.bucket = r.range"""


@query("histogram", _HIST)
def histogram(spark, d):
    out = stats.histogram(log_events(spark, d), "app-1", FROM, TO, level=3)
    return out.withColumn("label", F.col("label").cast("timestamp_ntz"))


@query("histogram_totals", f"SELECT CAST(sum(n) AS BIGINT) AS total, CAST(max(n) AS BIGINT) AS busiest FROM (SELECT bucket, sum(n) AS n FROM ({_HIST}) GROUP BY bucket)")
def histogram_totals(spark, d):
    return stats.histogram_totals(histogram(spark, d))


@query("level_facet", f"WITH {LOG_SQL} SELECT app_id, level, count(*) AS n FROM log GROUP BY ALL")
def level_facet(spark, d):
    return stats.level_facet(log_events(spark, d))


@query("source_facet", f"WITH {LOG_SQL} SELECT app_id, source, n FROM (SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY n DESC, source) AS r FROM (SELECT app_id, source, count(*) AS n FROM log WHERE source IS NOT NULL GROUP BY ALL)) WHERE r <= 2")
def source_facet(spark, d):
    return stats.source_facet(log_events(spark, d), 2).select("app_id", "source", "n")


@query("app_stats", f"WITH {LOG_SQL} SELECT app_id, level, count(*) AS n, max(ts) AS newest FROM log GROUP BY GROUPING SETS ((app_id, level), (app_id))")
def app_stats(spark, d):
    return stats.app_stats(log_events(spark, d)).withColumn("newest", F.col("newest").cast("timestamp_ntz"))


NOW = dt.datetime(2024, 1, 20, 12, 30)


@query("hourly_counts", f"WITH {LOG_SQL} SELECT app_id, strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:00Z') AS hour, count(*) AS n FROM log WHERE ts >= TIMESTAMP '2024-01-19 12:30:00' GROUP BY ALL")
def hourly_counts(spark, d):
    return stats.hourly_counts(log_events(spark, d), NOW).withColumn("hour", stats.hour_key(F.col("hour")))


@query("hourly_series", f"""WITH {LOG_SQL}, h AS (SELECT app_id, date_trunc('hour', ts) AS hour, count(*) AS n FROM log WHERE ts >= TIMESTAMP '2024-01-19 12:30:00' GROUP BY ALL)
  SELECT a.app_id, strftime(s.hour, '%Y-%m-%dT%H:00Z') AS hour, coalesce(n, 0) AS n FROM (SELECT DISTINCT app_id FROM log) a CROSS JOIN (SELECT TIMESTAMP '2024-01-19 13:00:00' + to_hours(range) AS hour FROM range(24)) s LEFT JOIN h ON h.app_id = a.app_id AND h.hour = s.hour""")
def hourly_series(spark, d):
    log = log_events(spark, d)
    return stats.hourly_series(log, log.select("app_id"), NOW)


def _acks(spark, d):
    """Made from orders: apps by customer, scopes * or a level, some other words that don't count."""
    o = load(spark, d, "orders")
    scope = F.when(F.col("o_orderkey") % 4 == 0, F.lit("*")).when(F.col("o_orderkey") % 4 < 3, (F.col("o_orderkey") % 2 + 4).cast("string")).otherwise(F.lit("other"))
    through = F.to_timestamp(F.lit("2024-01-05")) + F.make_dt_interval((F.col("o_custkey") % 15).cast("int"))
    return o.select(F.concat(F.lit("app-"), (F.col("o_custkey") % 7).cast("string")).alias("app_id"), scope.alias("scope"), through.alias("through_ts"), F.concat(F.lit("n"), F.col("o_orderkey").cast("string")).alias("note"),
                    (F.col("o_custkey") % 3).cast("string").alias("acked_by"), F.timestamp_seconds(F.col("o_orderkey")).alias("created_ts"))


ACK_SQL = """ack AS (SELECT 'app-' || (o_custkey % 7) AS app_id, CASE WHEN o_orderkey % 4 = 0 THEN '*' WHEN o_orderkey % 4 < 3 THEN CAST(o_orderkey % 2 + 4 AS VARCHAR) ELSE 'other' END AS scope,
  TIMESTAMP '2024-01-05' + to_days(CAST(o_custkey % 15 AS INTEGER)) AS through_ts, 'n' || o_orderkey AS note, o_orderkey AS seq FROM orders)"""


@query("ack_snapshot", f"WITH {ACK_SQL} SELECT app_id, scope, max(through_ts) AS through_ts, arg_max(note, seq) AS note FROM ack WHERE scope <> 'other' GROUP BY ALL")
def ack_snapshot(spark, d):
    a = _acks(spark, d)
    out = stats.acknowledge(a.where("scope = '*'"), a.where("scope <> '*'"))
    return out.select("app_id", "scope", F.col("through_ts").cast("timestamp_ntz").alias("through_ts"), "note")


@query("clear_ack", f"WITH {ACK_SQL} SELECT app_id, scope, count(*) AS n FROM ack WHERE app_id <> 'app-0' AND NOT (app_id = 'app-1' AND scope = '*') GROUP BY ALL")
def clear_ack(spark, d):
    cleared = spark.createDataFrame([("app-0", None), ("app-1", "*")], "app_id string, scope string")
    return stats.clear_ack(_acks(spark, d), cleared).groupBy("app_id", "scope").agg(F.count("*").alias("n"))


@query("unacknowledged", f"""WITH {LOG_SQL}, {ACK_SQL}, w AS (SELECT app_id, scope, max(through_ts) AS t FROM ack WHERE scope <> 'other' GROUP BY ALL)
  SELECT app_id, count(*) AS n FROM log l WHERE level >= 4 AND NOT EXISTS (SELECT 1 FROM w WHERE w.app_id = l.app_id AND l.ts <= w.t AND (scope = '*' OR scope = CAST(l.level AS VARCHAR))) GROUP BY app_id""")
def unacknowledged(spark, d):
    return stats.unacknowledged_errors(log_events(spark, d), _acks(spark, d), "level")


@query("text_search", "SELECT source, count(*) AS n FROM documents WHERE text ILIKE '%token%' AND text ILIKE '%the%' GROUP BY source")
def text_search(spark, d):
    docs = load(spark, d, "documents").select(F.col("text").alias("message"), F.lit(None).cast("string").alias("exception"), "source")
    from ..functions.filters import text_search as words
    return docs.where(words("Token THE")).groupBy("source").agg(F.count("*").alias("n"))


@query("levels", f"WITH {LOG_SQL} SELECT event_type, CASE event_type WHEN 'error' THEN 4 ELSE 2 END AS number, CASE event_type WHEN 'error' THEN 'Error' ELSE 'Information' END AS name, count(*) AS n FROM events GROUP BY event_type")
def levels(spark, d):
    n = level_number(F.col("event_type"))
    return load(spark, d, "events").groupBy("event_type", n.alias("number"), level_name(n).alias("name")).agg(F.count("*").alias("n"))


@query("event_ids", f"WITH {LOG_SQL} SELECT event_id, app_id, strftime(day, '%Y%m%d') || ':' || id AS eid, day, id FROM log", days=True)
def event_ids(spark, d):
    eid = ids.event_id(F.col("day"), F.col("id"))
    return log_events(spark, d).select("event_id", "app_id", eid.alias("eid"), ids.parse_event_id(eid).alias("p")).select("event_id", "app_id", "eid", "p.day", "p.id")


# What the stems of the query's words stand for in the messages and exceptions of the table: the words with their endings.
_STEMMED = "regexp_matches(lower(message || ' ' || coalesce(exception, '')), '(^|[^a-z0-9])payments?([^a-z0-9]|$)') AND regexp_matches(lower(message || ' ' || coalesce(exception, '')), '(^|[^a-z0-9])fail(s|ed|ing)?([^a-z0-9]|$)')"


@query("stem_search", f"WITH {LOG_SQL} SELECT app_id, count(*) AS n FROM log WHERE {_STEMMED} GROUP BY app_id")
def stem_search_query(spark, d):
    return log_events(spark, d).where(stem_search("payments failing")).groupBy("app_id").agg(F.count("*").alias("n"))


@query("stem_index", f"WITH {LOG_SQL} SELECT app_id, day, id FROM log WHERE day BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' AND {_STEMMED}", days=True)
def stem_index(spark, d):
    """The same words by an index that is filled in two steps."""
    index, log = StemIndex(spark, f"{shared_dir(spark)}/stems-{uuid.uuid4().hex}"), log_events(spark, d)
    index.add(log.where("app_id <= 'app-1'"))
    index.add(log.where("app_id > 'app-1'"))
    return index.search("payments failing", start="2024-01-10", end="2024-01-20")


@query("tail_backfill", f"WITH {PROPS} SELECT day, id FROM p WHERE app_id = 'app-1' AND level >= 2 AND region = 'us' ORDER BY day DESC, id DESC LIMIT 101", days=True)
def tail_backfill(spark, d):
    """The newest events of a tail's condition, one more than a page."""
    return search.search(log_events(spark, d), 100, app="app-1", level=2, where="Region = 'us'").select("day", "id")
