"""Queries: rules, occurrences, the delivery queue, retention, purges, live tails."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.text import valid_json
from ..operators import deliveries as D
from ..operators import maintain
from ..operators import rules as R
from ..schema import DEAD, DELIVERED, PENDING
from ..streaming import stream
from .adapters import LOG_SQL, load, log_events
from .queries_search import PROPS, registry

QUERIES, SQL = {}, {}
query = registry(QUERIES, SQL)
DESTINATIONS = [{"id": f"d{i}", "body_template": '{"m":"{{event.message}}","k":"{{occurrence.key}}","app":"{{app.id}}"}', "rate_limit_per_hour": 60, "is_enabled": True} for i in range(3)]
RULES = [
    R.default_rule(id="r1", minimum_level=5, dedupe_key_template="{{app.id}}", destination_id="d0"),
    R.default_rule(id="r2", filter="Region = 'us' and TenantId > 41", dedupe_key_template="{{event.level}}-{{event.properties.TenantId}}", destination_id="d0"),
    R.default_rule(id="r3", minimum_level=4, trigger_type=1, threshold_count=3, threshold_window_minutes=60, dedupe_key_template="{{event.source}}", destination_id="d1"),
    R.default_rule(id="r4", app_id="app-2", minimum_level=3, cooldown_minutes=0, dedupe_key_template="k", destination_id="d1", max_fires_per_hour=1000),
    R.default_rule(id="r5", app_id="app-1", dedupe_key_template="{{event.properties.K}}", is_dry_run=True, destination_id="d2"),
    R.default_rule(id="r6", filter="Level >>> 5", destination_id="d2"),
]


def committed(spark, d):
    log = log_events(spark, d)
    return log.withColumn("commit_ts", F.date_trunc("second", "ts") + F.expr("interval 1 second"))


_MATCH = PROPS + """, m AS (
  SELECT 'r1' AS rule_id, app_id AS key, app_id, day, id, ts FROM p WHERE level >= 5
  UNION ALL SELECT 'r2', ['Verbose', 'Debug', 'Information', 'Warning', 'Error', 'Fatal'][level + 1] || '-' || tenant, app_id, day, id, ts FROM p WHERE region = 'us' AND tenant > 41
  UNION ALL SELECT 'r3', coalesce(source, ''), app_id, day, id, ts FROM p WHERE level >= 4
  UNION ALL SELECT 'r4', 'k', app_id, day, id, ts FROM p WHERE level >= 3 AND app_id = 'app-2'
  UNION ALL SELECT 'r5', CAST(k AS VARCHAR), app_id, day, id, ts FROM p WHERE app_id = 'app-1')"""


@query("match_rules", f"WITH {_MATCH} SELECT rule_id, key AS dedupe_key, count(*) AS n FROM m GROUP BY ALL")
def match_rules(spark, d):
    return R.match_rules(committed(spark, d), RULES).groupBy("rule_id", "dedupe_key").agg(F.count("*").alias("n"))


@query("storms", f"WITH {LOG_SQL} SELECT app_id, day, count(*) AS n, min(id) AS id FROM log WHERE level >= 2 AND ts >= CAST(day AS TIMESTAMP) GROUP BY ALL HAVING count(*) > 100", days=True)
def storms(spark, d):
    daily = log_events(spark, d).withColumn("commit_ts", F.col("day").cast("timestamp") + F.expr("interval 1 day"))
    rule = [R.default_rule(id="s", minimum_level=2)]
    return R.split_storms(R.match_rules(daily, rule, max_age_minutes=1440))[1].select("app_id", "day", "n", "id")


# Windows of occurrences restart once they are older than the rule's (r4 has none), which SQL follows match by match; a match fires where the rule's cooldown is over and, for r3, three are counted.
_STATE = """, o AS (SELECT *, date_trunc('second', ts) + INTERVAL 1 SECOND AS c, CASE WHEN rule_id = 'r4' THEN INTERVAL 0 MINUTE ELSE INTERVAL 60 MINUTE END AS wide, CASE WHEN rule_id = 'r3' THEN 3 ELSE 1 END AS least,
    row_number() OVER (PARTITION BY rule_id, key ORDER BY date_trunc('second', ts), app_id, day, id) AS n FROM m),
  f AS (SELECT rule_id, key, n, c, app_id, day, id, c AS start, 1 AS count, least = 1 AS fire, CASE WHEN least = 1 THEN c END AS fired FROM o WHERE n = 1 UNION ALL
    SELECT rule_id, key, n, c, app_id, day, id, start, count, count >= least AND (fired IS NULL OR c - fired >= wide), CASE WHEN count >= least AND (fired IS NULL OR c - fired >= wide) THEN c ELSE fired END FROM (
      SELECT o.*, f.fired, CASE WHEN o.c - f.start > o.wide THEN o.c ELSE f.start END AS start, CASE WHEN o.c - f.start > o.wide THEN 1 ELSE f.count + 1 END AS count FROM f JOIN o ON o.rule_id = f.rule_id AND o.key = f.key AND o.n = f.n + 1))"""


@query("occurrences", "WITH RECURSIVE " + _MATCH + _STATE + "SELECT rule_id, key AS dedupe_key, CAST(arg_max(count, n) AS INTEGER) AS count, arg_max(start, n) AS window_start_ts, min(c) AS first_seen_ts, max(c) AS last_seen_ts FROM f GROUP BY rule_id, key")
def occurrences(spark, d):
    """All rules, without caps: none ends early."""
    state, _, _ = R.evaluate_rules(committed(spark, d), [r | {"max_fires_per_hour": 1_000_000} for r in RULES], DESTINATIONS)
    times = ("window_start_ts", "first_seen_ts", "last_seen_ts")
    return state.select("rule_id", "dedupe_key", "count", *[F.col(c).cast("timestamp_ntz").alias(c) for c in times])


# The caps as one sequence for each destination: what was sent in the last hour, the rules that have ended, and the fires of the commit at hand. (The table has no storms.)
_CAPS = """, d AS (SELECT *, CASE WHEN rule_id IN ('r1', 'r2') THEN 'd0' WHEN rule_id = 'r5' THEN 'd2' ELSE 'd1' END AS dest, CASE WHEN rule_id = 'r4' THEN 1000 ELSE 20 END AS most FROM f),
  q AS (SELECT *, row_number() OVER (PARTITION BY dest ORDER BY c, app_id, day, rule_id, id) AS place, row_number() OVER (PARTITION BY dest, c, app_id, day, rule_id ORDER BY id) = 1 AS opens FROM d),
  s AS (SELECT dest, 0::bigint AS place, NULL::varchar AS verdict, []::STRUCT(t TIMESTAMP, r VARCHAR)[] AS sent, []::varchar[] AS gone, 0::bigint AS inside FROM (SELECT DISTINCT dest FROM d) UNION ALL
    SELECT dest, place, verdict, CASE WHEN verdict = 'delivered' THEN list_append(live, {'t': c, 'r': rule_id}) ELSE live END, CASE WHEN verdict = 'disabled' THEN list_append(gone, rule_id) ELSE gone END, CASE WHEN verdict <> 'disabled' THEN inside + 1 ELSE inside END FROM (
      SELECT *, CASE WHEN list_contains(gone, rule_id) THEN NULL WHEN inside >= most THEN 'disabled' WHEN NOT fire THEN NULL WHEN rule_id = 'r5' THEN 'dry run' WHEN len(live) >= 60 THEN 'rate limited' ELSE 'delivered' END AS verdict FROM (
        SELECT * REPLACE (CASE WHEN opens THEN len(list_filter(live, lambda x: x.r = rule_id)) ELSE inside END AS inside) FROM (
          SELECT q.dest, q.place, q.rule_id, q.c, q.most, q.fire, q.opens, s.gone, s.inside, list_filter(s.sent, lambda x: x.t >= q.c - INTERVAL 1 HOUR) AS live FROM s JOIN q ON q.dest = s.dest AND q.place = s.place + 1))))
  SELECT left(sha256(concat_ws(chr(31), rule_id, key, strftime(c, '%Y-%m-%d %H:%M:%S'), app_id, id)), 32) AS id, q.dest AS destination_id, rule_id, app_id, c AS created_ts, 0 AS status,
    '{"m":"' || message || '","k":"' || key || '","app":"' || app_id || '"}' AS request_body FROM s JOIN q ON q.dest = s.dest AND q.place = s.place JOIN log USING (app_id, day, id) WHERE verdict = 'delivered'"""


@query("rule_deliveries", "WITH RECURSIVE " + _MATCH + _STATE + _CAPS)
def rule_deliveries(spark, d):
    """All rules with their caps, rendered."""
    _, fired, _ = R.evaluate_rules(committed(spark, d), RULES, DESTINATIONS)
    return R.enqueue_deliveries(fired, RULES, DESTINATIONS).select("id", "destination_id", "rule_id", "app_id", F.col("created_ts").cast("timestamp_ntz").alias("created_ts"), "status", "request_body")


@query("capped_deliveries", "WITH RECURSIVE " + _MATCH + _STATE + _CAPS.replace("WHEN rule_id = 'r4' THEN 1000 ELSE 20 END AS most", "WHEN rule_id = 'r4' THEN 1000 ELSE 3 END AS most").replace(">= 60", ">= 4"))
def capped_deliveries(spark, d):
    """The same rules with caps that the table's events reach: rules end, and destinations refuse."""
    rules = [r if r["id"] == "r4" else r | {"max_fires_per_hour": 3} for r in RULES]
    destinations = [x | {"rate_limit_per_hour": 4} for x in DESTINATIONS]
    _, fired, _ = R.evaluate_rules(committed(spark, d), rules, destinations)
    return R.enqueue_deliveries(fired, rules, destinations).select("id", "destination_id", "rule_id", "app_id", F.col("created_ts").cast("timestamp_ntz").alias("created_ts"), "status", "request_body")


@query("disabled_rules", "WITH RECURSIVE " + _MATCH + _STATE + _CAPS[: _CAPS.index("  SELECT left(")].replace("WHEN rule_id = 'r4' THEN 1000 ELSE 20 END AS most", "WHEN rule_id = 'r4' THEN 1000 ELSE 3 END AS most").replace(">= 60", ">= 4")
       + "SELECT rule_id, 'exceeded 3 fires/hour' AS reason, c AS commit_ts FROM s JOIN q ON q.dest = s.dest AND q.place = s.place WHERE verdict = 'disabled' UNION ALL SELECT 'r6', 'filter does not parse', min(date_trunc('second', ts) + INTERVAL 1 SECOND) FROM log")
def disabled_rules(spark, d):
    """Why and when rules end: a cap, or a filter that doesn't parse."""
    rules = [r if r["id"] == "r4" else r | {"max_fires_per_hour": 3} for r in RULES]
    _, _, off = R.evaluate_rules(committed(spark, d), rules, [x | {"rate_limit_per_hour": 4} for x in DESTINATIONS])
    return off.select("rule_id", F.regexp_replace("reason", "(does not parse).*", "$1").alias("reason"), F.col("commit_ts").cast("timestamp_ntz").alias("commit_ts"))


@query("pruned_occurrences", "WITH RECURSIVE " + _MATCH + _STATE + "SELECT rule_id, key AS dedupe_key, max(c) AS last_seen_ts FROM f GROUP BY rule_id, key HAVING max(c) >= TIMESTAMP '2024-01-30' - INTERVAL 7 DAY AND rule_id <> 'r2'")
def pruned_occurrences(spark, d):
    """What is left a week later, once one rule was reset."""
    state, _, _ = R.evaluate_rules(committed(spark, d), [r | {"max_fires_per_hour": 1_000_000} for r in RULES], DESTINATIONS)
    left = R.reset_rule(R.prune_occurrences(state, dt.datetime(2024, 1, 30)), "r2")
    return left.select("rule_id", "dedupe_key", F.col("last_seen_ts").cast("timestamp_ntz").alias("last_seen_ts"))


@query("fresh_matches", f"WITH {LOG_SQL}, c AS (SELECT *, ts + to_minutes(CAST(k % 31 AS INTEGER)) AS commit_ts FROM log WHERE level >= 3) SELECT 'all' AS rule_id, count(*) AS n FROM c WHERE k % 31 <= 15 UNION ALL SELECT 'edited', count(*) FROM c WHERE k % 31 <= 15 AND ts >= TIMESTAMP '2024-01-15'")
def fresh_matches(spark, d):
    """Backfill protection: commits up to half an hour after their events, and a rule that was edited in between."""
    late = log_events(spark, d).withColumn("commit_ts", F.col("ts") + F.make_interval(mins=F.get_json_object("properties", "$.K").cast("int") % 31))
    rules = [R.default_rule(id="all", minimum_level=3), R.default_rule(id="edited", minimum_level=3, scope_changed_ts=dt.datetime(2024, 1, 15))]
    return R.match_rules(late, rules).groupBy("rule_id").agg(F.count("*").alias("n"))


@query("purge_destination", f"WITH {_MATCH} SELECT 'occurrences' AS part, count(*) AS n FROM (SELECT DISTINCT rule_id, key FROM m WHERE rule_id NOT IN ('r1', 'r2')) UNION ALL SELECT 'rules', 4")
def purge_destination(spark, d):
    rules = spark.createDataFrame([(r["id"], r["destination_id"]) for r in RULES], "id string, destination_id string")
    seen = R.narrow_matches(committed(spark, d), RULES).select("rule_id", "dedupe_key").distinct()
    left, known = maintain.purge_destination("d0", rules, seen)
    return known.agg(F.count("*").alias("n")).select(F.lit("occurrences").alias("part"), "n").union(left.agg(F.count("*").alias("n")).select(F.lit("rules").alias("part"), "n"))


@query("valid_bodies", "SELECT event_id, event_id % 4 IN (0, 3) AS valid FROM events")
def valid_bodies(spark, d):
    """One JSON value is a body; a value with something after it, or two of them, is none."""
    body = F.when(F.col("event_id") % 4 == 0, F.col("props")).when(F.col("event_id") % 4 == 1, F.concat("props", F.lit("}"))).when(F.col("event_id") % 4 == 2, F.concat_ws(",", "props", "props")).otherwise(F.concat(F.lit("["), "props", F.lit("]")))
    return load(spark, d, "events").select("event_id", valid_json(body).alias("valid"))


@query("manual_deliveries", f"WITH {LOG_SQL} SELECT app_id, '{{\"u\":\"ann\",\"t\":\"T\",\"m\":\"' || message || '\"}}' AS request_body FROM log WHERE level = 5")
def manual_deliveries(spark, d):
    chosen = log_events(spark, d).where("level = 5")
    out = R.manual_deliveries(chosen, {"id": "d0", "body_template": '{"u":"{{user.name}}","t":"{{title}}","m":"{{event.message}}"}'}, "ann", "T", "b", dt.datetime(2024, 2, 1))
    return out.select("app_id", "request_body")


def queue(spark, d):
    """orders as deliveries: by customer to seven destinations, status by the order's."""
    o = load(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", DELIVERED).when(F.col("o_orderstatus") == "O", PENDING).otherwise(2)
    return o.select(F.col("o_orderkey").cast("string").alias("id"), (F.col("o_custkey") % 7).cast("string").alias("destination_id"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("r"), (F.col("o_custkey") % 4).cast("string"))).alias("rule_id"),
                    F.concat(F.lit("app-"), (F.col("o_custkey") % 5).cast("string")).alias("app_id"), F.lit(0).alias("source"), F.col("o_orderdate").cast("timestamp").alias("created_ts"), (F.col("o_orderkey") % 6).cast("int").alias("attempt"), F.col("o_orderdate").cast("timestamp").alias("next_attempt_ts"),
                    status.alias("status"), F.lit(None).cast("int").alias("response_status"), F.lit(None).cast("string").alias("response_snippet"))


def attempts(spark, d):
    li = load(spark, d, "lineitem")
    codes = F.element_at(F.array(*[F.lit(c) for c in (200, 400, 408, 429, 500)]), F.when(F.col("l_linenumber") < 6, F.col("l_linenumber").cast("int")).otherwise(1))
    return li.select(F.col("l_orderkey").cast("string").alias("id"), F.col("l_linenumber"), F.when(F.col("l_linenumber") < 6, codes).alias("response_status"), F.concat(F.lit('{"key":"T'), F.col("l_orderkey").cast("string"), F.lit('","self":{"url":"u'), F.col("l_linenumber").cast("string"), F.lit('"}}')).alias("response_body"))


_QUEUE = """q AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey % 7 AS VARCHAR) AS destination_id, CASE WHEN o_orderkey % 3 = 0 THEN 'r' || (o_custkey % 4) END AS rule_id, 'app-' || (o_custkey % 5) AS app_id, CAST(o_orderdate AS TIMESTAMP) AS created_ts,
  CAST(o_orderkey % 6 AS INTEGER) AS attempt, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 ELSE 2 END AS status FROM orders)"""


@query("due_deliveries", f"WITH {_QUEUE} SELECT id, destination_id FROM (SELECT * FROM q WHERE status = 0 AND created_ts <= TIMESTAMP '2001-07-31' ORDER BY created_ts, id LIMIT 16) WHERE (SELECT count(*) FROM q WHERE created_ts >= TIMESTAMP '2001-07-30 23:00:00') < 500")
def due_deliveries(spark, d):
    return D.due_deliveries(queue(spark, d), dt.datetime(2001, 7, 31)).select("id", "destination_id")


def _destinations(spark):
    return spark.createDataFrame([(str(i), 6 if i else 3, dt.datetime(1999, 1, 1) if i == 5 else None) for i in range(6)], "id string, max_attempts int, circuit_open_until_ts timestamp")


@query("apply_outcomes", f"""WITH {_QUEUE}, l AS (SELECT CAST(l_orderkey AS VARCHAR) AS id, CASE max(l_linenumber) WHEN 1 THEN 200 WHEN 2 THEN 400 WHEN 3 THEN 408 WHEN 4 THEN 429 WHEN 5 THEN 500 END AS code FROM lineitem GROUP BY l_orderkey),
  x AS (SELECT q.*, code, destination_id = '6' AS missing, destination_id = '5' AS held, CASE destination_id WHEN '0' THEN 3 ELSE 6 END AS most FROM q JOIN l USING (id)),
  y AS (SELECT *, coalesce(code BETWEEN 200 AND 299, false) AS ok, coalesce(code BETWEEN 400 AND 499 AND code NOT IN (408, 429), false) AS final, attempt + 1 >= most AS spent FROM x)
  SELECT id, CASE WHEN missing THEN 3 WHEN held THEN 0 WHEN ok THEN 1 WHEN final THEN 3 WHEN spent THEN 3 ELSE 0 END AS status, CASE WHEN missing OR held OR ok OR final THEN attempt ELSE attempt + 1 END AS attempt,
    CASE WHEN missing THEN NULL WHEN held THEN TIMESTAMP '1999-01-01' WHEN ok OR final OR spent THEN NULL ELSE TIMESTAMP '1998-01-01' + to_seconds([1, 5, 30, 120, 600, 3600][least(attempt + 1, 5) + 1]) END AS next_attempt_ts FROM y""")
def apply_outcomes(spark, d):
    # the last of an order's lines tells how its delivery went
    one = attempts(spark, d).groupBy("id").agg(F.max_by(F.struct("response_status", "response_body"), "l_linenumber").alias("a")).select("id", "a.*")
    out = D.apply_outcomes(queue(spark, d), one, _destinations(spark), dt.datetime(1998, 1, 1))
    return out.select("id", "status", "attempt", F.col("next_attempt_ts").cast("timestamp_ntz").alias("next_attempt_ts"))


@query("destination_health", f"""WITH a AS (SELECT CAST(o_custkey % 97 AS VARCHAR) AS dest, CAST(l_shipdate AS TIMESTAMP) AS att, l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_linenumber = 7 THEN 'ok' WHEN l_linenumber IN (3, 4, 5) THEN 'transient' ELSE 'other' END AS kind FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
  r AS (SELECT *, sum(CASE WHEN kind = 'ok' THEN 1 ELSE 0 END) OVER (PARTITION BY dest ORDER BY att DESC, id DESC ROWS UNBOUNDED PRECEDING) AS oks FROM a)
  SELECT dest AS destination_id, CAST(count_if(oks = 0 AND kind = 'transient') AS INTEGER) AS failures, CASE WHEN count_if(oks = 0 AND kind = 'transient') >= 5 THEN max(att) FILTER (WHERE oks = 0 AND kind = 'transient') + INTERVAL 15 MINUTE END AS until FROM r GROUP BY dest""")
def destination_health(spark, d):
    o, li = load(spark, d, "orders"), load(spark, d, "lineitem")
    kind = F.when(F.col("l_linenumber") == 7, "ok").when(F.col("l_linenumber").isin(3, 4, 5), "transient").otherwise("other")
    a = li.join(o, F.col("o_orderkey") == F.col("l_orderkey")).select((F.col("o_custkey") % 97).cast("string").alias("destination_id"), F.col("l_shipdate").cast("timestamp").alias("at"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), kind.alias("kind"))
    return D.destination_health(a).select("destination_id", F.col("consecutive_failures").alias("failures"), F.col("circuit_open_until_ts").cast("timestamp_ntz").alias("until"))


@query("extract_tickets", f"WITH {_QUEUE} SELECT q.id, CASE WHEN destination_id < '3' THEN 'T' || q.id END AS ticket_id, CASE WHEN destination_id < '5' THEN 'u' || l_linenumber END AS ticket_url FROM q JOIN lineitem ON CAST(l_orderkey AS VARCHAR) = q.id WHERE status = 1 AND destination_id < '5'")
def extract_tickets(spark, d):
    paths = [{"id": str(i), "ticket_id_path": "$.key" if i < 3 else None, "ticket_url_path": "self.url" if i < 5 else None} for i in range(7)]
    return D.extract_tickets(queue(spark, d).join(attempts(spark, d).drop("response_status"), "id"), paths).select("id", "ticket_id", "ticket_url")


@query("query_deliveries", f"WITH {_QUEUE} SELECT id, status FROM q WHERE status = {PENDING} AND destination_id = '3' AND created_ts BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-01-01' ORDER BY created_ts DESC, id LIMIT 200")
def query_deliveries(spark, d):
    return D.query_deliveries(queue(spark, d), PENDING, "3", dt.datetime(1996, 1, 1), dt.datetime(1998, 1, 1)).select("id", "status")


@query("delivery_counts", f"""WITH {_QUEUE} SELECT 'status' AS kind, CAST(status AS VARCHAR) AS key, count(*) AS n FROM q GROUP BY ALL UNION ALL SELECT 'destination', destination_id, count(*) FROM q WHERE created_ts >= TIMESTAMP '1997-01-01' GROUP BY ALL
  UNION ALL SELECT 'rule', rule_id, count(*) FROM q WHERE created_ts >= TIMESTAMP '1997-01-01' AND rule_id IS NOT NULL GROUP BY ALL""")
def delivery_counts(spark, d):
    return D.delivery_counts(queue(spark, d), dt.datetime(1997, 1, 1))


@query("ticket_badges", f"""WITH {LOG_SQL}, l AS (SELECT 'app-' || (o_custkey % 7) AS app_id, CAST(o_orderkey % 6 AS INTEGER) AS level, arg_max('u' || o_orderkey, o_orderkey) AS ticket_url FROM orders WHERE o_orderkey % 6 > 2 GROUP BY ALL)
  SELECT event_id, ticket_url FROM log LEFT JOIN l USING (app_id, level)""")
def ticket_badges(spark, d):
    links = load(spark, d, "orders").where("o_orderkey % 6 > 2").select(F.concat(F.lit("app-"), (F.col("o_custkey") % 7).cast("string")).alias("app_id"), (F.col("o_orderkey") % 6).cast("int").alias("level"), F.concat(F.lit("u"), F.col("o_orderkey").cast("string")).alias("ticket_url"), F.timestamp_seconds("o_orderkey").alias("created_ts"))
    return D.ticket_badges(log_events(spark, d), links, "level").select("event_id", "ticket_url")


_DAYS = "pt AS (SELECT app_id, day, count(*) * 10000 AS bytes FROM log GROUP BY ALL)"


@query("retention_plan", f"""WITH {LOG_SQL}, {_DAYS}, a AS (SELECT *, CASE WHEN app_id = 'app-0' THEN 10 ELSE 20 END AS keep FROM pt),
  b AS (SELECT *, day < DATE '2024-01-30' - CAST(keep AS INTEGER) AS old FROM a), c AS (SELECT *, sum(CASE WHEN old THEN 0 ELSE bytes END) OVER (PARTITION BY app_id ORDER BY day DESC) AS young FROM b)
  SELECT app_id, day, CASE WHEN old THEN 'retention' ELSE 'size' END AS reason FROM c WHERE old OR young > 8 * 1024 * 1024""", days=True)
def retention_plan(spark, d):
    parts = log_events(spark, d).groupBy("app_id", "day").agg((F.count("*") * 10000).alias("bytes"))
    apps = spark.createDataFrame([(f"app-{i}", 10 if i == 0 else 20, 8) for i in range(5)], "app_id string, retention_days int, max_size_mb int")
    return maintain.retention_plan(parts, apps, dt.date(2024, 1, 30)).select("app_id", "day", "reason")


@query("purge_app", f"WITH {_QUEUE} SELECT 'stay' AS part, count(*) AS n FROM q WHERE app_id <> 'app-3' UNION ALL SELECT 'gone', count(*) FROM q WHERE app_id = 'app-3'")
def purge_app(spark, d):
    stay, gone = maintain.purge_app("app-3", {"deliveries": queue(spark, d)})
    count = lambda t, name: t["deliveries"].agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return count(stay, "stay").union(count(gone, "gone"))


SUBSCRIPTIONS = [stream.subscription("a", "app-0", 3), stream.subscription("b", "app-1", 0, "Region = 'us'"), stream.subscription("c", "app-1", 4)]
_TAIL = PROPS + """, t AS (SELECT 'a' AS sub_id, level >= 3 AS matched, level, ts, event_id FROM p WHERE app_id = 'app-0' UNION ALL SELECT 'b', coalesce(region = 'us', false), level, ts, event_id FROM p WHERE app_id = 'app-1'
  UNION ALL SELECT 'c', level >= 4, level, ts, event_id FROM p WHERE app_id = 'app-1')"""


@query("tail", f"WITH {_TAIL} SELECT sub_id, count(*) AS total, count_if(matched) AS matched FROM t GROUP BY sub_id")
def tail(spark, d):
    return stream.tail(log_events(spark, d), SUBSCRIPTIONS).groupBy("sub_id").agg(F.count("*").alias("total"), F.count_if("matched").alias("matched"))


@query("stats_frames", f"WITH {_TAIL} SELECT sub_id, date_trunc('second', ts) AS second, count(*) AS total, count_if(matched) AS matched, count_if(matched AND level = 4) AS errors FROM t GROUP BY ALL")
def stats_frames(spark, d):
    out = stream.stats_frames(stream.tail(log_events(spark, d), SUBSCRIPTIONS))
    return out.select("sub_id", F.col("second").cast("timestamp_ntz").alias("second"), "total", "matched", F.col("level_4").alias("errors"))


# The ring by counts, tick after tick; rows meet their frame by their place in the order of arrival.
_FRAMES = """, r AS (SELECT sub_id, event_id AS key, epoch_us(ts) // 3600000000 AS slot, row_number() OVER (PARTITION BY sub_id ORDER BY ts, event_id) AS place FROM t WHERE matched),
  c AS (SELECT sub_id, slot, count(*) AS n FROM r GROUP BY ALL), e AS (SELECT sub_id, min(slot) AS lo, max(slot) AS hi FROM c GROUP BY sub_id),
  f AS (SELECT sub_id, lo - 1 AS tick, hi, 0::bigint AS waiting, 0::bigint AS head, 0::bigint AS sent, 0::bigint AS dropped FROM e UNION ALL
    SELECT sub_id, tick, hi, least(w, 3) - least(w, 1), head + sent + greatest(w - 3, 0), least(w, 1), greatest(w - 3, 0) FROM (
      SELECT f.sub_id, f.tick + 1 AS tick, f.hi, f.head, f.sent, f.waiting + coalesce(c.n, 0) AS w FROM f LEFT JOIN c ON c.sub_id = f.sub_id AND c.slot = f.tick + 1 WHERE f.tick < f.hi OR f.waiting > 0)),
  g AS (SELECT *, row_number() OVER (PARTITION BY sub_id ORDER BY tick) AS seq FROM f WHERE sent > 0)
  SELECT g.sub_id, CAST(seq AS INTEGER) AS seq, make_timestamp((tick + 1) * 3600000000) AS at, key, CAST(dropped AS INTEGER) AS dropped FROM g JOIN r ON r.sub_id = g.sub_id AND r.place BETWEEN head + 1 AND head + sent"""


@query("frames", "WITH RECURSIVE " + _TAIL + _FRAMES)
def frames(spark, d):
    """Frames of an hour each, so that the sparse events of the table share some."""
    t = stream.tail(log_events(spark, d), SUBSCRIPTIONS).where("matched").select("sub_id", F.col("ts").alias("arrived"), F.col("event_id").alias("key"))
    return stream.frames(t, size=1, ring=3, ms=3_600_000).withColumn("at", F.col("at").cast("timestamp_ntz"))
