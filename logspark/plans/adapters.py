"""The given tables as log events, traces with spans, deliveries and Windows records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import event_type_hash
from ..operators.ids import assign_row_ids
from ..session import prepare


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in df.columns else df


def number_text(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def log_events(spark: SparkSession, sf_dir: str, with_type: bool = False) -> DataFrame:
    """events as LOG_EVENT; event_type is null unless asked for, since its hash is a Python helper. event_id stays for tests."""
    e = load(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    k, kind = F.col("k"), F.col("event_type")
    value, user = number_text(F.col("value")), F.col("user_id").cast("string")
    by_kind = lambda rows, other=None: F.coalesce(*[F.when(kind == n, v) for n, v in rows.items()], F.lit(other))
    level = by_kind({"error": F.when(k % 10 == 0, 5).otherwise(4), "purchase": F.lit(3), "signup": F.lit(2), "click": F.lit(1)}, 0)
    template = by_kind({"error": F.lit("Payment {Value} failed for {UserId}"), "purchase": F.lit("Slow checkout {Value} for {UserId}"), "signup": F.lit("User {UserId} signed up"), "click": F.lit("Cache miss for key {K}")})
    message = by_kind({
        "error": F.concat(F.lit("Payment "), value, F.lit(" failed for "), user), "purchase": F.concat(F.lit("Slow checkout "), value, F.lit(" for "), user),
        "signup": F.concat(F.lit("User "), user, F.lit(" signed up")), "click": F.concat(F.lit("Cache miss for key "), k.cast("string")),
        "view": F.concat(F.lit("healthcheck ping "), (k % 4).cast("string"))})
    field = lambda name, text, when=None: F.when(when, F.concat(F.lit(f'"{name}":'), text)) if when is not None else F.concat(F.lit(f'"{name}":'), text)
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    pick = lambda m, names: F.element_at(F.array(*[F.lit(x) for x in names]), k % m + 1)
    parts = F.array_compact(F.array(
        field("UserId", user), field("Value", value), field("K", F.when(k % 7 == 0, quoted(k.cast("string"))).otherwise(k.cast("string"))),
        field("TenantId", (k % 6 + 40).cast("string"), k % 5 < 3), field("Region", quoted(pick(3, ("us", "eu", "apac"))), k % 2 == 0),
        field("Machine", quoted(pick(2, ("GIT4A", "PAYJS2"))), k % 5 < 3), field("Flag", (k > 49).cast("string")), field("Nothing", F.lit("null"), k % 11 == 0)))
    out = e.select(
        "event_id", F.concat(F.lit("app-"), (F.col("user_id") % 5).cast("string")).alias("app_id"), F.to_date("ts").alias("day"), "ts", level.alias("level"), template.alias("template"), message.alias("message"),
        F.when((kind == "error") & (k % 2 == 0), F.lit("System.TimeoutException: the operation timed out")).alias("exception"),
        F.when(k % 5 != 0, F.concat(F.lit("t"), user, F.lit("-"), F.date_format("ts", "yyyyMMdd"))).alias("trace_id"), F.lit(None).cast("string").alias("span_id"),
        F.when(k % 4 < 3, F.element_at(F.array(F.lit("Billing"), F.lit("HealthCheck"), F.lit("Auth")), F.least(k % 4, F.lit(2)) + 1)).alias("source"),
        F.when(k % 3 < 2, F.element_at(F.array(F.lit("GIT4A"), F.lit("BUILD1")), F.least(k % 3, F.lit(1)) + 1)).alias("machine"),
        F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")).alias("properties"))
    out = out.withColumn("event_type", event_type_hash(F.col("template"), F.col("message")) if with_type else F.lit(None).cast("long"))
    return assign_row_ids(out, "event_id")


#: DuckDB: events as the same log events, with property values as columns.
LOG_SQL = """log AS (
  SELECT event_id, app_id, day, row_number() OVER (PARTITION BY app_id, day ORDER BY event_id) AS id, ts, level, template,
         message, exception, trace_id, source, machine, user_id, value, k
  FROM (SELECT event_id, 'app-' || (user_id % 5) AS app_id, CAST(ts AS DATE) AS day, ts, user_id, value, k,
    CASE event_type WHEN 'error' THEN CASE WHEN k % 10 = 0 THEN 5 ELSE 4 END WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 WHEN 'click' THEN 1 ELSE 0 END AS level,
    CASE event_type WHEN 'error' THEN 'Payment {Value} failed for {UserId}' WHEN 'purchase' THEN 'Slow checkout {Value} for {UserId}'
      WHEN 'signup' THEN 'User {UserId} signed up' WHEN 'click' THEN 'Cache miss for key {K}' END AS template,
    CASE event_type WHEN 'error' THEN 'Payment ' || vt || ' failed for ' || user_id WHEN 'purchase' THEN 'Slow checkout ' || vt || ' for ' || user_id
      WHEN 'signup' THEN 'User ' || user_id || ' signed up' WHEN 'click' THEN 'Cache miss for key ' || k ELSE 'healthcheck ping ' || (k % 4) END AS message,
    CASE WHEN event_type = 'error' AND k % 2 = 0 THEN 'System.TimeoutException: the operation timed out' END AS exception,
    CASE WHEN k % 5 <> 0 THEN 't' || user_id || '-' || strftime(ts, '%Y%m%d') END AS trace_id,
    CASE k % 4 WHEN 0 THEN 'Billing' WHEN 1 THEN 'HealthCheck' WHEN 2 THEN 'Auth' END AS source,
    CASE k % 3 WHEN 0 THEN 'GIT4A' WHEN 1 THEN 'BUILD1' END AS machine
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, regexp_replace(CAST(value AS VARCHAR), '\\.0$', '') AS vt FROM events)))"""


def conversation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as spans: one for each turn, its parent the turn before."""
    c = load(spark, sf_dir, "conversations")
    start = F.timestamp_seconds(F.lit(1704067200) + F.col("turn"))
    end = F.timestamp_millis(F.unix_millis(start) + F.length("text"))
    span = lambda t: F.concat_ws("-", F.col("conv_id").cast("string"), t.cast("string"))
    return c.select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("trace_id"), F.col("role").alias("app_id"), F.lpad(F.col("turn").cast("string"), 6, "0").alias("event_id"), end.alias("ts"), start.alias("start_ts"),
        span(F.col("turn")).alias("span_id"), F.when(F.col("turn") > 0, span(F.col("turn") - 1)).alias("parent_span_id"), F.lit(2).alias("level"), F.col("text").alias("message"))


CONVERSATION_SQL = """ev AS (
  SELECT 'c' || conv_id AS trace_id, role AS app_id, lpad(CAST(turn AS VARCHAR), 6, '0') AS event_id,
         TIMESTAMP '2024-01-01' + to_seconds(turn) + to_milliseconds(length(text)) AS ts, TIMESTAMP '2024-01-01' + to_seconds(turn) AS start_ts,
         conv_id || '-' || turn AS span_id, CASE WHEN turn > 0 THEN conv_id || '-' || (turn - 1) END AS parent_span_id, turn
  FROM conversations)"""


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as root spans over their lineitems' spans."""
    o, li = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    last = li.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last"))
    t = lambda c: F.concat(F.lit("o"), F.col(c).cast("string"))
    root = o.join(last, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        t("o_orderkey").alias("trace_id"), F.lit("orders").alias("app_id"), F.lit("0").alias("event_id"), F.greatest(F.col("o_orderdate"), F.col("last")).cast("timestamp").alias("ts"),
        F.col("o_orderdate").cast("timestamp").alias("start_ts"), t("o_orderkey").alias("span_id"), F.lit(None).cast("string").alias("parent_span_id"), F.lit(2).alias("level"))
    line = li.join(o.select("o_orderkey", "o_orderdate"), F.col("o_orderkey") == F.col("l_orderkey")).select(
        t("l_orderkey").alias("trace_id"), F.lit("lines").alias("app_id"), F.col("l_linenumber").cast("string").alias("event_id"), F.col("l_shipdate").cast("timestamp").alias("ts"),
        (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(F.col("l_linenumber"))).alias("start_ts"), F.concat_ws("-", t("l_orderkey"), F.col("l_linenumber").cast("string")).alias("span_id"),
        t("l_orderkey").alias("parent_span_id"), F.when(F.col("l_returnflag") == "R", 4).otherwise(2).alias("level"))
    return root.unionByName(line)


ORDER_SQL = """ev AS (
  SELECT 'o' || o_orderkey AS trace_id, 'orders' AS app_id, '0' AS event_id, CAST(greatest(o_orderdate, (SELECT max(l_shipdate) FROM lineitem WHERE l_orderkey = o_orderkey)) AS TIMESTAMP) AS ts,
         CAST(o_orderdate AS TIMESTAMP) AS start_ts, 'o' || o_orderkey AS span_id, CAST(NULL AS VARCHAR) AS parent_span_id, 2 AS level FROM orders
  UNION ALL
  SELECT 'o' || l_orderkey, 'lines', CAST(l_linenumber AS VARCHAR), CAST(l_shipdate AS TIMESTAMP), CAST(o_orderdate AS TIMESTAMP) + to_days(CAST(l_linenumber AS INTEGER)),
         'o' || l_orderkey || '-' || l_linenumber, 'o' || l_orderkey, CASE WHEN l_returnflag = 'R' THEN 4 ELSE 2 END FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""
