"""Alert rules: matching, dedupe keys, storms, occurrences, caps, deliveries.

A commit is (app_id, day, commit_ts); commit_ts is the clock of its evaluation. Rules and destinations are small control tables, read by the
driver; events stay in the executors.
"""

from __future__ import annotations

import datetime as dt
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.filters import VARIANT, FilterError, filter_expr, with_variant
from ..functions.text import level_name, property_text, render_payload, segments, valid_json  # noqa: F401
from ..schema import BY_RULE, EVERY_MATCH, FAILED, MANUAL, PENDING, TEST
from ..shared import cut, in_sequence
from .ids import event_id

# Matches of a rule in a commit above which it is a storm; minutes that an event stays fresh; days of occurrences.
STORM, MAX_AGE_MINUTES, OCCURRENCE_DAYS = 100, 15, 7
COMMIT = ("rule_id", "commit_ts", "app_id", "day")


def default_rule(**given) -> dict:
    return {"app_id": None, "filter": None, "minimum_level": 0, "trigger_type": EVERY_MATCH, "threshold_count": None, "threshold_window_minutes": None, "dedupe_key_template": "{{event.eventType}}", "cooldown_minutes": 60,
            "destination_id": "d", "body_template_override": None, "max_fires_per_hour": 20, "is_dry_run": False, "is_enabled": True, "scope_changed_ts": None} | given


def compile_rules(rules: list[dict]) -> tuple[list[tuple[dict, Column]], dict[str, str]]:
    """Each enabled rule with its condition, and the reason for those whose filter doesn't parse: they are disabled, the others run."""
    good, bad = [], {}
    for r in sorted(rules, key=lambda r: r["id"]):
        if not r["is_enabled"]:
            continue
        c = F.col("level") >= r["minimum_level"]
        if r["app_id"] is not None:
            c &= F.col("app_id") == r["app_id"]
        if r["scope_changed_ts"] is not None:
            c &= F.col("ts") >= F.lit(r["scope_changed_ts"])
        if r["filter"] and r["filter"].strip():
            try:
                c &= filter_expr(r["filter"])
            except FilterError as e:
                bad[r["id"]] = f"filter does not parse: {e}"
                continue
        good.append((r, c))
    return good, bad


def dedupe_key(template: str) -> Column:
    """The key template as a Column; it has no filters, and unknown paths are empty."""
    known = {"event.eventType": F.col("event_type").cast("string"), "event.level": level_name(F.col("level")), "event.source": F.col("source"), "event.message": F.col("message"), "app.id": F.col("app_id")}
    parts, at = [], 0
    while (start := template.find("{{", at)) >= 0 and (end := template.find("}}", start)) >= 0:
        path = template[start + 2 : end].split("|")[0].strip()
        value = property_text(VARIANT, path.removeprefix("event.properties.")) if path.startswith("event.properties.") else known.get(path)
        parts += [F.lit(template[at:start]), F.coalesce(value, F.lit("")) if value is not None else F.lit("")]
        at = end + 2
    return F.concat(*parts, F.lit(template[at:]))


def match_rules(events: DataFrame, rules: list[dict], max_age_minutes: int = MAX_AGE_MINUTES) -> DataFrame:
    """events with commit_ts to one row for each match: rule_id and dedupe_key beside the event. One scan, no join."""
    good, _ = compile_rules(rules)
    e = with_variant(events)
    fresh = F.unix_micros("commit_ts") - F.unix_micros("ts") <= max_age_minutes * 60_000_000
    kind = "struct<rule_id:string,dedupe_key:string>"
    hits = F.array_compact(F.array(*[F.when(fresh & c, F.struct(F.lit(r["id"]).alias("rule_id"), dedupe_key(r["dedupe_key_template"]).alias("dedupe_key"))) for r, c in good])) if good else F.array().cast(f"array<{kind}>")
    return e.withColumn("__hit", F.explode(hits)).select(*events.columns, "__hit.rule_id", "__hit.dedupe_key")


def narrow_matches(events: DataFrame, rules: list[dict], max_age_minutes: int = MAX_AGE_MINUTES) -> DataFrame:
    """What the folds need of matches: (rule, commit, key, id)."""
    return match_rules(events, rules, max_age_minutes).select(*COMMIT, "dedupe_key", "id")


def unparsed_rules(events: DataFrame, rules: list[dict]) -> DataFrame:
    """(rule_id, reason, commit_ts): enabled rules whose filter doesn't parse, disabled by the first commit of an app that they are for."""
    _, bad = compile_rules(rules)
    app = {r["id"]: r["app_id"] for r in rules}
    first = F.array(*[F.struct(F.lit(k).alias("rule_id"), F.lit(why).alias("reason"), F.min(F.when(F.lit(app[k] is None) | (F.col("app_id") == app[k]), F.col("commit_ts"))).alias("commit_ts")) for k, why in bad.items()])
    if not bad:
        first = F.array().cast("array<struct<rule_id:string,reason:string,commit_ts:timestamp>>")
    return events.agg(first.alias("x")).select(F.inline("x")).where("commit_ts is not null")


def split_storms(matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Matches outside storms, and a row (rule, commit, n, id of the first match) for each storm."""
    counts = matches.groupBy(*COMMIT).agg(F.count("*").alias("n"), F.min("id").alias("id"))
    storms = counts.where(F.col("n") > STORM)
    return matches.join(storms.select(*COMMIT), list(COMMIT), "left_anti"), storms


def reduced(matches: DataFrame) -> DataFrame:
    """(rule, key, commit) with the ids of its matches in order: at most STORM of them, since storms are apart."""
    return matches.groupBy(*COMMIT, "dedupe_key").agg(F.sort_array(F.collect_list("id")).alias("ids"))


_FOLD = "rule_id string, dedupe_key string, at bigint, app_id string, day date, ids array<bigint>, count int, window_start bigint, first_seen bigint, last_fired bigint, last_id bigint, fires array<bigint>"
MINUTE_MICROS = 60_000_000


def _batch(out: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)


_FOLD_ARROW = pa.schema([("rule_id", pa.string()), ("dedupe_key", pa.string()), ("at", pa.int64()), ("app_id", pa.string()), ("day", pa.date32()), ("ids", pa.list_(pa.int64())), ("count", pa.int32()),
                         *[(c, pa.int64()) for c in ("window_start", "first_seen", "last_fired", "last_id")], ("fires", pa.list_(pa.int64()))])


def _fold(rules: dict[str, dict]):
    """Commits of each (rule, key) in order. All matches of a commit have one clock, so a commit has a closed form. Times are microseconds."""
    names = ("rule_id", "dedupe_key", "at", "app_id", "day", "ids", "old_count", "window_start", "first_seen", "last_fired")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = None
        for batch in batches:
            out = []
            for name, key, now, app, day, ids, old, old_start, old_seen, old_fired in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if of != (name, key):
                    of, r = (name, key), rules[name]
                    window = MINUTE_MICROS * (r["threshold_window_minutes"] if r["threshold_window_minutes"] is not None else r["cooldown_minutes"])
                    cooldown = MINUTE_MICROS * r["cooldown_minutes"]
                    least = 1 if r["trigger_type"] == EVERY_MATCH else r["threshold_count"]
                    start = seen = fired = None
                    count = 0
                if old is not None:  # what earlier runs left
                    start, seen, count, fired = old_start, old_seen, old, old_fired
                    continue
                if start is None:
                    start = seen = now
                elif now - start > window:
                    start, count = now, 0
                fires: list[int] = []
                if least is not None and not (fired is not None and now - fired < cooldown):
                    first = max(1, least - count)
                    if first <= len(ids):
                        fires = ids[first - 1 :] if cooldown == 0 else ids[first - 1 : first]
                        fired = now
                count += len(ids)
                out.append((name, key, now, app, day, ids, count, start, seen, fired, ids[-1], fires))
            yield _batch(out, _FOLD_ARROW)
    return run


def fold_occurrences(rows: DataFrame, rules: list[dict], occurrences: DataFrame | None = None) -> DataFrame:
    """A row for each (rule, key, commit), with its ids: the occurrence after it, and the ids that fire, caps aside."""
    times = {"window_start_ts": "window_start", "first_seen_ts": "first_seen", "last_fired_ts": "last_fired"}
    new = rows.select("rule_id", "dedupe_key", F.unix_micros("commit_ts").alias("at"), "app_id", "day", "ids", F.lit(None).cast("int").alias("old_count"), *[F.lit(None).cast("bigint").alias(c) for c in times.values()])
    if occurrences is not None:
        old = occurrences.join(rows.select("rule_id", "dedupe_key").distinct(), ["rule_id", "dedupe_key"], "left_semi").select(
            "rule_id", "dedupe_key", F.lit(None).cast("bigint").alias("at"), F.lit("").alias("app_id"), F.lit(None).cast("date").alias("day"), F.array().cast("array<bigint>").alias("ids"), F.col("count").alias("old_count"), *[F.unix_micros(c).alias(x) for c, x in times.items()])
        new = new.unionByName(old)
    # an earlier state has no time: it comes first
    folded = in_sequence(new, ["rule_id", "dedupe_key"], F.col("at").asc_nulls_first(), "app_id", "day").mapInArrow(_fold({r["id"]: r for r in rules}), _FOLD)
    return folded.select("rule_id", F.timestamp_micros("at").alias("commit_ts"), "app_id", "day", "dedupe_key", "ids", "count", *[F.timestamp_micros(x).alias(c) for c, x in times.items()], "last_id", "fires")


_DECIDED = "destination_id string, hour bigint, rule_id string, at bigint, app_id string, day date, id bigint, verdict string"
SENT = ("delivered", "storm")
HOUR_MICROS = 3_600_000_000


def _cap(rules: dict[str, dict], limits: dict[str, int]):
    """The hourly caps of each destination and of its rules, over commits in order. Times are microseconds.

    What is kept: what was sent in the last hour, and the rules that have ended.
    """
    names = ("destination_id", "hour", "at", "app_id", "day", "rule_id", "kind", "ids", "fires")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = None
        for batch in batches:
            out = []
            for destination, hour, now, app, day, name, kind, ids, fires in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if of != destination:
                    of, limit, sent, by_rule, off = destination, limits.get(destination), deque(), {}, set()
                if name in off:
                    continue
                rule, own, is_storm = rules.get(name), by_rule.setdefault(name, deque()), kind == "storm"
                for q in (sent, own):
                    while q and q[0] < now - HOUR_MICROS:
                        q.popleft()
                if kind == "past":
                    sent.append(now)
                    own.append(now)
                    continue
                if rule is None:
                    continue
                fired, inside = set(fires), len(own)
                # a commit finds the cap reached before its first match; a storm is asked then only
                for k, i in enumerate(ids):
                    verdict = None
                    if inside >= rule["max_fires_per_hour"] and not (is_storm and k):
                        off.add(name)
                        verdict = "disabled"
                    elif i in fired:
                        inside += 1
                        verdict = "dry run" if rule["is_dry_run"] else "no destination" if limit is None else "rate limited" if len(sent) >= limit else "storm" if is_storm else "delivered"
                        if verdict in SENT:
                            sent.append(now)
                            own.append(now)
                    if verdict:
                        out.append((destination, hour, name, now, app, day, i, verdict))
                    if verdict == "disabled":
                        break
            yield _batch(out, _DECIDED_ARROW)
    return run


_DECIDED_ARROW = pa.schema([("destination_id", pa.string()), ("hour", pa.int64()), ("rule_id", pa.string()), ("at", pa.int64()), ("app_id", pa.string()), ("day", pa.date32()), ("id", pa.int64()), ("verdict", pa.string())])


def _busy_hours(rows: DataFrame, rules: list[dict], limits: dict[str, int]) -> DataFrame:
    """(destination_id, hour) of the hours in which a cap may be reached, whatever else happens: those with enough fires in them and in the hour before."""
    fires = F.when(F.col("kind") == "past", F.lit(1)).otherwise(F.size("fires"))
    by_rule = rows.groupBy("destination_id", "rule_id", "hour").agg(F.sum(fires).alias("n"))
    by_destination = by_rule.groupBy("destination_id", "hour").agg(F.sum("n").alias("n"))

    def with_before(df: DataFrame, *key: str) -> DataFrame:
        w = Window.partitionBy(*key).orderBy("hour")
        return df.withColumn("n", F.col("n") + F.when(F.lag("hour").over(w) == F.col("hour") - 1, F.lag("n").over(w)).otherwise(0))

    most = F.create_map(*[F.lit(x) for r in rules for x in (r["id"], r["max_fires_per_hour"])])
    limit = F.create_map(*[F.lit(x) for k, v in limits.items() for x in (k, v)]) if limits else F.create_map(F.lit(""), F.lit(0))
    rule = with_before(by_rule, "destination_id", "rule_id").where(F.col("n") >= F.try_element_at(most, F.col("rule_id")))
    destination = with_before(by_destination, "destination_id").where(F.col("n") > F.try_element_at(limit, F.col("destination_id")))
    return rule.select("destination_id", "hour").union(destination.select("destination_id", "hour")).distinct()


def apply_caps(folded: DataFrame, storms: DataFrame, rules: list[dict], destinations: list[dict], deliveries: DataFrame | None = None) -> DataFrame:
    """(rule, commit, id, verdict) for what fires and for the points where a rule is disabled.

    In most hours of a destination the fires of the hour and of the one before are too few for any cap; there every fire is delivered, unless its rule has ended. The
    other hours are one sequence for each destination, since what may be sent depends on what was sent in the hour before: their commits, and those of the hours that
    they look back to, stream through one fold in order, and destinations are folded side by side. The fold holds an hour's sends, whatever the number of commits.
    """
    names = F.create_map(*[F.lit(x) for r in rules for x in (r["id"], r["destination_id"])])
    normal = folded.groupBy(*COMMIT).agg(F.sort_array(F.flatten(F.collect_list("ids"))).alias("ids"), F.flatten(F.collect_list("fires")).alias("fires")).withColumn("kind", F.lit("commit"))
    storm = storms.select(*COMMIT, F.array("id").alias("ids"), F.array("id").alias("fires"), F.lit("storm").alias("kind"))
    rows = normal.unionByName(storm).withColumn("destination_id", F.element_at(names, F.col("rule_id")))
    if deliveries is not None:
        none = F.array().cast("array<bigint>")
        rows = rows.unionByName(deliveries.select(F.coalesce("rule_id", F.lit("")).alias("rule_id"), F.col("created_ts").alias("commit_ts"), F.coalesce("app_id", F.lit("")).alias("app_id"), F.to_date("created_ts").alias("day"), none.alias("ids"), none.alias("fires"), F.lit("past").alias("kind"), "destination_id"))
    rows = cut(rows.withColumn("at", F.unix_micros("commit_ts")).withColumn("hour", F.floor(F.col("at") / F.lit(HOUR_MICROS))).drop("commit_ts"))
    limits = {x["id"]: x.get("rate_limit_per_hour", 60) for x in destinations if x.get("is_enabled", True)}
    key, names = ["destination_id", "hour"], [k.split()[0] for k in _DECIDED.split(", ")]
    busy = cut(_busy_hours(rows, rules, limits))
    verdict = F.when(F.col("rule_id").isin([r["id"] for r in rules if r["is_dry_run"]]), F.lit("dry run")).when(~F.col("destination_id").isin(list(limits)), F.lit("no destination")).otherwise(F.when(F.col("kind") == "storm", "storm").otherwise("delivered"))
    looked_at = busy.union(busy.select("destination_id", F.col("hour") - 1)).distinct()
    folds = cut(in_sequence(rows.join(looked_at, key, "left_semi"), ["destination_id"], "at", "app_id", "day", "rule_id").mapInArrow(_cap({r["id"]: r for r in rules}, limits), _DECIDED))
    calm = rows.where("kind <> 'past'").join(looked_at, key, "left_anti").withColumn("id", F.explode("fires")).withColumn("verdict", verdict).select(names)
    ends = folds.where("verdict = 'disabled'").groupBy("destination_id", "rule_id").agg(F.min("hour").alias("end"))
    decided = calm.join(ends, ["destination_id", "rule_id"], "left").where("end is null or hour < end").select(names).unionByName(folds)
    return decided.withColumn("commit_ts", F.timestamp_micros("at")).drop(*key, "at")


def round_trip(ts: Column) -> Column:
    """A time as payloads show it: seven decimals and the offset."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'0+00:00'")


def payload_values(with_rule: bool = True, app_names: dict[str, str] | None = None, rule_names: dict[str, str] | None = None, base_url: str = "") -> Column:
    """Values by path for payload templates, as a JSON object; event properties go by event.properties.X."""
    key = event_id(F.col("day"), F.col("id"))
    name = lambda names, c: F.try_element_at(F.create_map(*[F.lit(x) for k, v in names.items() for x in (k, v)]), F.col(c)) if names else F.lit(None).cast("string")
    app = F.concat(F.lit(f"{base_url}/apps/"), F.col("app_id"))
    known = {"event.timestamp": round_trip(F.col("ts")), "event.level": level_name(F.col("level")), "event.message": F.col("message"), "event.template": F.col("template"), "event.exception": F.col("exception"),
             "event.source": F.col("source"), "event.traceId": F.col("trace_id"), "event.id": key, "event.eventType": F.col("event_type").cast("string"), "app.id": F.col("app_id"), "app.name": name(app_names, "app_id"),
             "link.event": F.concat(app, F.lit("/events/"), key), "link.search": F.concat(app, F.lit("/search?eventType="), F.col("event_type").cast("string"))}
    if with_rule:
        known |= {"rule.id": F.col("rule_id"), "rule.name": name(rule_names, "rule_id"), "occurrence.key": F.col("dedupe_key"), "occurrence.count": F.col("count").cast("string"),
                  "occurrence.firstSeen": round_trip(F.col("first_seen_ts")), "occurrence.lastSeen": round_trip(F.col("commit_ts"))}
    fixed = F.map_from_arrays(F.array(*[F.lit(k) for k in known]), F.array(*known.values()))
    own = F.transform_keys(F.from_json(F.coalesce("properties", F.lit("{}")), "map<string,string>"), lambda k, v: F.concat(F.lit("event.properties."), k))
    return F.to_json(F.map_concat(fixed, own))


def enqueue_deliveries(fired: DataFrame, rules: list[dict], destinations: list[dict], app_names: dict[str, str] | None = None, base_url: str = "") -> DataFrame:
    """Deliveries for fired matches (event columns, rule_id, dedupe_key, count, first_seen_ts, commit_ts): rendered bodies, Pending, or Failed where a body isn't JSON.

    A destination with a subject_template (mail) gets a subject, which is plain text.
    """
    body, subjects = {d["id"]: d["body_template"] for d in destinations}, {d["id"]: d.get("subject_template") for d in destinations}
    by_rule = lambda value: F.create_map(*[F.lit(x) for r in rules for x in (r["id"], value(r))])[F.col("rule_id")]
    values = payload_values(True, app_names, {r["id"]: r.get("name") or r["id"] for r in rules}, base_url)
    rendered = fired.withColumn("__values", values).withColumn("request_body", render_payload(by_rule(lambda r: r["body_template_override"] or body.get(r["destination_id"]) or ""), F.col("__values")))
    if any(subjects.values()):
        rendered = rendered.withColumn("subject", render_payload(by_rule(lambda r: subjects.get(r["destination_id"])).cast("string"), F.col("__values"), json_mode=False))
    else:
        rendered = rendered.withColumn("subject", F.lit(None).cast("string"))
    ok = valid_json(F.col("request_body"))
    return rendered.select(
        F.sha2(F.concat_ws("\x1f", "rule_id", "dedupe_key", F.col("commit_ts").cast("string"), "app_id", F.col("id").cast("string")), 256).substr(1, 32).alias("id"), by_rule(lambda r: r["destination_id"]).alias("destination_id"), "rule_id", "app_id",
        F.lit(BY_RULE).alias("source"), "event_type", F.col("commit_ts").alias("created_ts"), F.lit(0).alias("attempt"), F.col("commit_ts").alias("next_attempt_ts"), F.when(ok, PENDING).otherwise(FAILED).alias("status"), "request_body", "subject",
        F.when(~ok, F.lit("rendered body is not valid JSON")).alias("error"))


def manual_deliveries(chosen: DataFrame, destination: dict, user: str, title: str, text: str, now: dt.datetime, test: bool = False) -> DataFrame:
    """Deliveries that a user asks for, from chosen events."""
    extra = F.create_map(*[F.lit(x) for x in ("user.name", user, "title", title, "body", text)])
    values = F.to_json(F.map_concat(F.from_json(payload_values(False), "map<string,string>"), extra))
    rendered = chosen.withColumn("request_body", render_payload(F.lit(destination["body_template"]), values))
    return rendered.select(F.sha2(F.concat_ws("\x1f", F.lit("manual"), F.lit(user), "app_id", F.col("day").cast("string"), F.col("id").cast("string")), 256).substr(1, 32).alias("id"), F.lit(destination["id"]).alias("destination_id"), "app_id",
                           F.lit(TEST if test else MANUAL).alias("source"), "event_type", F.lit(now).alias("created_ts"), F.when(valid_json(F.col("request_body")), PENDING).otherwise(FAILED).alias("status"), "request_body")


def evaluate_rules(events: DataFrame, rules: list[dict], destinations: list[dict], occurrences: DataFrame | None = None, deliveries: DataFrame | None = None, max_age_minutes: int = MAX_AGE_MINUTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events with commit_ts to (occurrences, fired matches, disabled rules with their reason).

    Without caps first: a fold by key gives the fires. Then the caps, by destination and hour: they tell what is delivered and where a rule ends. Occurrences are folded
    again over the matches before that point. Matches are written once, as (rule, commit, key, id); events are read again for what is fired only.
    """
    matches = cut(narrow_matches(events, rules, max_age_minutes))
    calm, storms = split_storms(matches)
    rows = cut(reduced(calm))
    folded = cut(fold_occurrences(rows, rules, occurrences))
    decided = cut(apply_caps(folded, storms, rules, destinations, deliveries))
    off = decided.where("verdict = 'disabled'").groupBy("rule_id").agg(F.min(F.struct("commit_ts", "app_id", "day", "id")).alias("end"))
    before = F.col("end").isNull() | (F.struct("commit_ts", "app_id", "day", "id") < F.col("end"))
    again = folded
    if not off.isEmpty():  # rules that ended: over their matches before that
        again = cut(folded.join(off, "rule_id", "left_anti").unionByName(fold_occurrences(reduced(calm.join(off, "rule_id").where(before).drop("end")), rules, occurrences)))
    last = again.groupBy("rule_id", "dedupe_key").agg(F.max_by(F.struct("count", "window_start_ts", "first_seen_ts", F.col("commit_ts").alias("last_seen_ts"), "last_fired_ts"), F.struct("commit_ts", "app_id", "day")).alias("o")).select("rule_id", "dedupe_key", "o.*")
    storm = storms.join(off, "rule_id", "left").where(before).groupBy("rule_id").agg(F.max_by("n", "commit_ts").cast("int").alias("count"), F.max("commit_ts").alias("window_start_ts"), F.min("commit_ts").alias("first_seen_ts"), F.max("commit_ts").alias("last_seen_ts"), F.max("commit_ts").alias("last_fired_ts"))
    if occurrences is not None:  # a storm that is known keeps when it was seen first
        known = occurrences.where("dedupe_key = 'storm'").select("rule_id", F.col("first_seen_ts").alias("__seen"))
        storm = storm.join(known, "rule_id", "left").withColumn("first_seen_ts", F.least("first_seen_ts", "__seen")).drop("__seen")
    state = last.unionByName(storm.withColumn("dedupe_key", F.lit("storm")))
    sent = decided.where(F.col("verdict").isin(*SENT)).join(matches, [*COMMIT, "id"])
    sent = sent.join(again.select(*COMMIT, "dedupe_key", "count", "first_seen_ts"), [*COMMIT, "dedupe_key"], "left").join(storms.select(*COMMIT, F.col("n").alias("__n")), list(COMMIT), "left")
    is_storm = F.col("verdict") == "storm"
    sent = sent.withColumn("dedupe_key", F.when(is_storm, F.lit("storm")).otherwise(F.col("dedupe_key"))).withColumn("count", F.when(is_storm, F.col("__n").cast("int")).otherwise(F.col("count"))).withColumn("first_seen_ts", F.when(is_storm, F.col("commit_ts")).otherwise(F.col("first_seen_ts"))).drop("__n")
    fired = sent.join(events, ["commit_ts", "app_id", "day", "id"])
    reason = F.concat(F.lit("exceeded "), F.element_at(F.create_map(*[F.lit(x) for r in rules for x in (r["id"], r["max_fires_per_hour"])]), F.col("rule_id")).cast("string"), F.lit(" fires/hour"))
    ended = off.select("rule_id", reason.alias("reason"), "end.commit_ts")
    return state, fired, ended.unionByName(unparsed_rules(events, rules))


def prune_occurrences(occurrences: DataFrame, now: dt.datetime, days: int = OCCURRENCE_DAYS) -> DataFrame:
    return occurrences.where(F.col("last_seen_ts") >= F.lit(now) - F.make_dt_interval(F.lit(days)))


def reset_rule(occurrences: DataFrame, rule_id: str) -> DataFrame:
    return occurrences.where(F.col("rule_id") != rule_id)
