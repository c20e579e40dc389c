"""Alert rules: caps hour by hour against one sequence, reasons as rows, and rules on a stream against one batch."""

import datetime as dt
import random

from pyspark.sql import functions as F

from logspark.operators import rules as R
from logspark.schema import LOG_EVENT

T0 = dt.datetime(2026, 7, 23, 12)
HOUR = dt.timedelta(hours=1)


def in_order(commits, rules, limits):
    """Verdicts of (destination, ts, app, rule, ids, fires, kind), one after another, looking back at everything that was sent."""
    rules, sent, off, out = {r["id"]: r for r in rules}, [], set(), set()
    for dest, ts, app, rule, ids, fires, kind in sorted(commits, key=lambda c: (c[1], c[2], c[3])):
        count = lambda match: sum(1 for d, r, t in sent if match(d, r) and t >= ts - HOUR)  # noqa: B023, E731
        if kind == "past":
            sent.append((dest, rule, ts))
            continue
        if rule in off:
            continue
        most, inside = rules[rule]["max_fires_per_hour"], count(lambda d, r: r == rule)  # noqa: B023
        if inside >= most:
            off.add(rule)
            out.add((rule, ts, app, ids[0], "disabled"))
            continue
        for i in ids:
            if kind != "storm" and inside >= most:
                off.add(rule)
                out.add((rule, ts, app, i, "disabled"))
                break
            if i in fires:
                inside += 1
                verdict = "dry run" if rules[rule]["is_dry_run"] else "no destination" if dest not in limits else "rate limited" if count(lambda d, r: d == dest) >= limits[dest] else "storm" if kind == "storm" else "delivered"  # noqa: B023
                out.add((rule, ts, app, i, verdict))
                if verdict in R.SENT:
                    sent.append((dest, rule, ts))
    return out


def test_caps_by_hour_equal_one_sequence(spark):
    r = random.Random(11)
    rules = [R.default_rule(id=f"r{i}", destination_id=f"d{i % 3}", max_fires_per_hour=[4, 9, 30, 1000][i % 4], is_dry_run=i == 7) for i in range(9)]
    destinations = [{"id": "d0", "rate_limit_per_hour": 12, "body_template": ""}, {"id": "d1", "rate_limit_per_hour": 5, "body_template": ""}, {"id": "d2", "is_enabled": False, "body_template": ""}]
    commits, seen = [], set()
    for _ in range(900):
        rule = r.randrange(9)
        # busy mornings, quiet nights: runs of hours in which the caps are reached, and hours apart
        ts = T0 + dt.timedelta(seconds=r.choice([r.randrange(5 * 3600), r.randrange(60 * 3600)]))
        if (rule, ts) in seen:
            continue
        seen.add((rule, ts))
        ids = sorted(r.sample(range(1000), r.choice([1, 1, 2, 5])))
        commits.append((f"d{rule % 3}", ts, "app", f"r{rule}", ids, sorted(r.sample(ids, r.randrange(len(ids) + 1))), "storm" if r.random() < 0.05 else "commit"))
    for c in commits:
        if c[6] == "storm":
            c[4][1:], c[5][:] = [], c[4][:1]
    past = [("d0", T0 - dt.timedelta(minutes=m), "app", "r0", [], [], "past") for m in (5, 30, 70)] + [("d1", T0 + dt.timedelta(minutes=90), "app", "", [], [], "past")]
    day = T0.date()
    folded = spark.createDataFrame([(c[3], c[1], c[2], day, "k", c[4], c[5]) for c in commits if c[6] == "commit"], "rule_id string, commit_ts timestamp, app_id string, day date, dedupe_key string, ids array<bigint>, fires array<bigint>")
    storms = spark.createDataFrame([(c[3], c[1], c[2], day, 150, c[4][0]) for c in commits if c[6] == "storm"], "rule_id string, commit_ts timestamp, app_id string, day date, n bigint, id bigint")
    sent = spark.createDataFrame([(c[3] or None, c[2], c[1], c[0]) for c in past], "rule_id string, app_id string, created_ts timestamp, destination_id string")
    got = {(x.rule_id, x.commit_ts, x.app_id, x.id, x.verdict) for x in R.apply_caps(folded, storms, rules, destinations, sent).collect()}
    expected = in_order(commits + past, rules, {"d0": 12, "d1": 5})
    assert got == expected and {v for *_, v in got} == {"disabled", "dry run", "no destination", "rate limited", "storm", "delivered"}


def test_a_long_run_of_busy_hours_is_one_pass(spark, monkeypatch):
    """Each hour depends on the one before; the steps don't grow with the hours."""
    rules, day = [R.default_rule(id=f"r{i}", destination_id="d", max_fires_per_hour=1000 if i else 30) for i in range(2)], T0.date()
    commits = [("d", T0 + dt.timedelta(seconds=411 * n), "app", f"r{n % 2}", [n], [n], "commit") for n in range(400)]
    commits += [("d", T0 + dt.timedelta(hours=20, seconds=n), "app", "r0", [1000 + n], [], "commit") for n in range(5)]
    folded = spark.createDataFrame([(c[3], c[1], c[2], day, "k", c[4], c[5]) for c in commits], "rule_id string, commit_ts timestamp, app_id string, day date, dedupe_key string, ids array<bigint>, fires array<bigint>")
    storms = spark.createDataFrame([], "rule_id string, commit_ts timestamp, app_id string, day date, n bigint, id bigint")
    cuts, cut = [], R.cut
    monkeypatch.setattr(R, "cut", lambda df: cuts.append(1) or cut(df))
    got = {(x.rule_id, x.commit_ts, x.app_id, x.id, x.verdict) for x in R.apply_caps(folded, storms, rules, [{"id": "d", "rate_limit_per_hour": 3, "body_template": ""}]).collect()}
    assert got == in_order(commits, rules, {"d": 3}) and {v for *_, v in got} == {"rate limited", "delivered"} and len(cuts) <= 4


def events(spark, rows):
    """(app, id, seconds, level, bag) with a commit at the event's time."""
    return spark.createDataFrame([(a, T0.date(), i, T0 + dt.timedelta(seconds=s), lv, "T", f"m{i}", None, 1, None, None, None, None, bag, T0 + dt.timedelta(seconds=s)) for a, i, s, lv, bag in rows], LOG_EVENT + ", commit_ts timestamp")


DEST = [{"id": "d", "body_template": '{"m":"{{event.message}}"}', "rate_limit_per_hour": 60, "is_enabled": True}]


def test_reasons_are_rows(spark):
    e = events(spark, [("a", i, i, 4, f'{{"K":{i}}}') for i in range(30)] + [("b", i, 100 + i, 4, "{}") for i in range(3)])
    rules = [R.default_rule(id="many", app_id="a", dedupe_key_template="{{event.properties.K}}"), R.default_rule(id="bad", filter="Level >>> 5", app_id="b"), R.default_rule(id="unseen", filter="Level >>> 5", app_id="c"), R.default_rule(id="good", app_id="b")]
    _, fired, off = R.evaluate_rules(e, rules, DEST)
    got = {r.rule_id: (r.reason, r.commit_ts) for r in off.collect()}
    assert got["many"] == ("exceeded 20 fires/hour", T0 + dt.timedelta(seconds=20)) and got["bad"][0].startswith("filter does not parse: ") and got["bad"][1] == T0 + dt.timedelta(seconds=100)
    assert set(got) == {"many", "bad"} and {r.rule_id for r in fired.select("rule_id").collect()} == {"many", "good"}


def test_a_known_storm_keeps_when_it_began(spark):
    rule = [R.default_rule(id="r")]
    old = R.evaluate_rules(events(spark, [("a", i, 0, 4, "{}") for i in range(150)]), rule, DEST)[0]
    state, fired, _ = R.evaluate_rules(events(spark, [("a", i, 4000, 4, "{}") for i in range(200, 400)]), rule, DEST, old)
    row = state.first()
    assert (row["dedupe_key"], row["count"], row["first_seen_ts"], row["last_seen_ts"]) == ("storm", 200, T0, T0 + dt.timedelta(seconds=4000)) and fired.first()["count"] == 200


def test_backfill_protection(spark):
    e = events(spark, [("a", i, i, 4, "{}") for i in range(4)]).withColumn("ts", F.col("ts") - F.make_interval(mins=F.col("id").cast("int") * 5, secs=F.when(F.col("id") == 3, 0.000001).otherwise(0)))
    assert sorted(r.id for r in R.match_rules(e, [R.default_rule(id="r")]).collect()) == [0, 1, 2]
    assert sorted(r.id for r in R.match_rules(e, [R.default_rule(id="r", scope_changed_ts=T0 - dt.timedelta(minutes=6))]).collect()) == [0, 1]
