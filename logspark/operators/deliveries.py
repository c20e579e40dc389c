"""Tables around the delivery queue: what is due, outcomes, circuit breakers, tickets, counts."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import json_path
from ..schema import DEAD, DELIVERED, PENDING, TEST

# Seconds between attempts, most attempts, failures that open a circuit, its minutes, the brake on an hour's deliveries.
BACKOFF, MOST_ATTEMPTS, OPEN_AFTER, OPEN_MINUTES, HOURLY_BRAKE, SNIPPET = (1, 5, 30, 120, 600, 3600), 6, 5, 15, 500, 500


def due_deliveries(deliveries: DataFrame, now: dt.datetime, limit: int = 16) -> DataFrame:
    """The oldest pending ones that are due; none if an hour's deliveries reached the brake."""
    brake = deliveries.where(F.col("created_ts") >= F.lit(now - dt.timedelta(hours=1))).agg((F.count("*") >= HOURLY_BRAKE).alias("__stop"))
    due = deliveries.where((F.col("status") == PENDING) & (F.col("next_attempt_ts").isNull() | (F.col("next_attempt_ts") <= F.lit(now))))
    return due.orderBy("created_ts", "id").limit(limit).join(F.broadcast(brake.where("not __stop")), how="left_semi")  # one row at most


def apply_outcomes(deliveries: DataFrame, outcomes: DataFrame, destinations: DataFrame, now: dt.datetime) -> DataFrame:
    """Deliveries after attempts (id, response_status, response_body; a null status is no answer)."""
    d = deliveries.join(outcomes.select(F.col("id"), F.col("response_status").alias("__code"), "response_body"), "id").join(
        destinations.select(F.col("id").alias("destination_id"), F.lit(True).alias("__there"), "max_attempts", "circuit_open_until_ts"), "destination_id", "left")
    code, test = F.col("__code"), F.col("source") == TEST
    missing, held = F.col("__there").isNull(), F.coalesce((F.col("circuit_open_until_ts") > F.lit(now)) & ~test, F.lit(False))
    ok = code.between(200, 299)
    final = code.between(400, 499) & ~code.isin(408, 429)
    tries = F.col("attempt") + 1
    spent = tries >= F.least(F.coalesce("max_attempts", F.lit(MOST_ATTEMPTS)), F.lit(MOST_ATTEMPTS))
    wait = F.element_at(F.array(*[F.lit(s) for s in BACKOFF]), F.least(tries, F.lit(len(BACKOFF) - 1)) + 1)
    status = F.when(missing, DEAD).when(held, PENDING).when(ok, DELIVERED).when(final, DEAD).when(spent, DEAD).otherwise(PENDING)
    following = F.when(missing | (~held & (F.coalesce(ok, F.lit(False)) | F.coalesce(final, F.lit(False)) | spent)), F.lit(None).cast("timestamp")).when(held, F.col("circuit_open_until_ts")).otherwise(F.timestamp_seconds(F.unix_timestamp(F.lit(now)) + wait))
    unsent = missing | held
    return d.select(*[c for c in deliveries.columns if c not in ("attempt", "status", "next_attempt_ts", "response_status", "response_snippet")],
                    F.when(unsent | F.coalesce(ok | final, F.lit(False)), F.col("attempt")).otherwise(tries).alias("attempt"), status.alias("status"), following.alias("next_attempt_ts"), F.when(~unsent, code).alias("response_status"), F.when(~unsent, F.substring("response_body", 1, SNIPPET)).alias("response_snippet"))


def destination_health(attempts: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(destination_id, at, id, kind: ok, transient or other) to consecutive failures and the circuit's end of each destination.

    Successes cut the sequence of a destination; failures since the last one count. The last success is an aggregate, so no order within a
    destination is built.
    """
    key = F.struct("at", "id")
    last = attempts.where("kind = 'ok'").groupBy("destination_id").agg(F.max(key).alias("ok"))
    since = attempts.where("kind = 'transient'").join(last, "destination_id", "left").where(F.col("ok").isNull() | (key > F.col("ok")))
    now = since.groupBy("destination_id").agg(F.count("*").alias("n"), F.max("at").alias("latest"))
    every = attempts.select("destination_id").distinct().join(now, "destination_id", "left").join(last, "destination_id", "left")
    base = F.lit(0)
    if known is not None:
        every = every.join(known.select(F.col("id").alias("destination_id"), F.col("consecutive_failures").alias("__old")), "destination_id", "left")
        base = F.when(F.col("ok").isNull(), F.coalesce("__old", F.lit(0))).otherwise(0)
    failures = (F.coalesce("n", F.lit(0)) + base).cast("int")
    until = F.when((failures >= OPEN_AFTER) & F.col("latest").isNotNull(), F.timestamp_seconds(F.unix_timestamp("latest") + OPEN_MINUTES * 60))
    return every.select("destination_id", failures.alias("consecutive_failures"), until.alias("circuit_open_until_ts"))


def extract_tickets(answered: DataFrame, destinations: list[dict]) -> DataFrame:
    """Delivered rows with response_body to (id, ticket_id, ticket_url), where either is there."""
    def by(path: str):
        rows = [F.when(F.col("destination_id") == d["id"], json_path(F.col("response_body"), d[path])) for d in destinations if d.get(path)]
        return F.coalesce(*rows) if rows else F.lit(None).cast("string")

    out = answered.where(F.col("status") == DELIVERED).withColumn("ticket_id", by("ticket_id_path")).withColumn("ticket_url", by("ticket_url_path"))
    return out.where("ticket_id is not null or ticket_url is not null")


def query_deliveries(deliveries: DataFrame, status: int | None = None, destination: str | None = None, start=None, end=None, limit: int = 200) -> DataFrame:
    conditions = [F.lit(True)]
    if status is not None:
        conditions.append(F.col("status") == status)
    if destination is not None:
        conditions.append(F.col("destination_id") == destination)
    if start is not None:
        conditions.append(F.col("created_ts") >= F.lit(start))
    if end is not None:
        conditions.append(F.col("created_ts") <= F.lit(end))
    return deliveries.where(reduce(lambda a, b: a & b, conditions)).orderBy(F.col("created_ts").desc(), "id").limit(limit)


def delivery_counts(deliveries: DataFrame, since) -> DataFrame:
    """(kind, key, n): by status over all, by destination and by rule since a time."""
    recent = deliveries.where(F.col("created_ts") >= F.lit(since))
    count = lambda df, kind, c: df.groupBy(F.col(c).cast("string").alias("key")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "key", "n")
    return count(deliveries, "status", "status").union(count(recent, "destination", "destination_id")).union(count(recent.where("rule_id is not null"), "rule", "rule_id"))


def ticket_badges(events: DataFrame, links: DataFrame, key: str = "event_type") -> DataFrame:
    """Events with the newest ticket of their app and type."""
    newest = links.where("ticket_url is not null").groupBy("app_id", key).agg(F.max_by("ticket_url", F.struct("created_ts", "ticket_url")).alias("ticket_url"))
    return events.join(newest, ["app_id", key], "left")


def app_links(links: DataFrame, limit: int = 100) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("app_id").orderBy(F.col("created_ts").desc(), "ticket_url"))
    return links.withColumn("rank", rank).where(F.col("rank") <= limit)


# What the bodies say: a title, and the event with where it came from, how often it was seen and where to read on. Tokens inside JSON strings are escaped by render_payload().
_TITLE = "[{{event.level}}] {{event.message | truncate:120}}"
_ABOUT = "App: {{app.name | default:\"unnamed\"}} ({{app.id}})\\nSource: {{event.source | default:\"none\"}}\\nTime: {{event.timestamp}}\\nTrace: {{event.traceId | default:\"none\"}}\\nSeen: {{occurrence.count | default:\"1\"}} since {{occurrence.firstSeen | default:\"now\"}}"
_LINKS = "Event: {{link.event}}\\nAll of this kind: {{link.search}}"
_ISSUE = f"{_ABOUT}\\n\\n{{{{event.exception | md}}}}\\n\\n{_LINKS}"
_TEXT = f"{_ABOUT}\\n\\n{{{{event.exception | truncate:2000}}}}\\n\\n{_LINKS}"
# Names of presets and the paths of tickets in their answers, (name, content type, body, ticket id path, ticket url path).
PRESETS = [
    ("gitea", "application/json", f'{{"title":"{_TITLE}","body":"{_ISSUE}"}}', "$.number", "$.html_url"),
    ("github", "application/json", f'{{"title":"{_TITLE}","body":"{_ISSUE}","labels":["{{{{app.id}}}}"]}}', "$.number", "$.html_url"),
    ("jira", "application/json", f'{{"fields":{{"summary":"{_TITLE}","description":"{_TEXT}","issuetype":{{"name":"Bug"}}}}}}', "$.key", "$.self"),
    ("zendesk", "application/json", f'{{"ticket":{{"subject":"{_TITLE}","comment":{{"body":"{_TEXT}"}},"external_id":"{{{{event.id}}}}"}}}}', "$.ticket.id", "$.ticket.url"),
    ("slack", "application/json", f'{{"text":"*{_TITLE}*\\n{_ABOUT}\\n{_LINKS}"}}', None, None),
    ("teams", "application/json", f'{{"title":"{_TITLE}","text":"{_ABOUT}\\n{_LINKS}"}}', None, None),
    ("generic", "application/json", '{"rule":{"id":"{{rule.id}}","name":"{{rule.name}}"},"app":{"id":"{{app.id}}","name":"{{app.name}}"},"event":{"id":"{{event.id}}","time":"{{event.timestamp}}","level":"{{event.level}}","type":"{{event.eventType}}","message":"{{event.message}}","template":"{{event.template}}","exception":"{{event.exception}}","source":"{{event.source}}","trace":"{{event.traceId}}"},"occurrence":{"key":"{{occurrence.key}}","count":"{{occurrence.count}}","first":"{{occurrence.firstSeen}}","last":"{{occurrence.lastSeen}}"},"links":{"event":"{{link.event}}","search":"{{link.search}}"}}', "$.id", "$.url"),
]


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRESETS, "name string, content_type string, body_template string, ticket_id_path string, ticket_url_path string")
