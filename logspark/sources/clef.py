"""Compact log event JSON lines and plain JSON: reading, parsing, admission, and writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import event_type_hash, level_lookup, level_name, level_number, is_whole, marked_json, render_template, span_start, valid_json
from ..operators.search import at

# Limits of admission.
LINE_LIMIT, PROPERTY_LIMIT, OLDEST_DAYS, NEWEST_HOURS = 262_144, 100, 30, 1
#: Names that a bag can't hold as they are.
RESERVED = ("@t", "@mt", "@m", "@l", "@x", "@i", "@r", "@tr", "@sp", "@ps", "@st")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines end at a line feed alone, as they are counted."""
    return spark.read.option("lineSep", "\n").text(path)


def read_clef(spark: SparkSession, path: str) -> DataFrame:
    """(line, file): the lines that aren't blank, without a trailing carriage return. Numbers of lines come from number_lines()."""
    lines = _lines(spark, path).select(F.regexp_replace("value", r"\r$", "").alias("line"), F.col("_metadata.file_path").alias("file"))
    return lines.where(F.trim("line") != "")


def number_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, file, number): as read_clef(), with the number of each line in its file, for files of any number of splits. Blank lines count, but aren't there.

    A split of a file (path and first byte) is read by one task from its first line to its last, so a line's number is its place in the split after the lines of the
    splits before, which are prefix sums over counts: a row for each split. Lines aren't shuffled; the files are read twice.
    """
    at = F.monotonically_increasing_id()
    lines = _lines(spark, path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), at.alias("at"))
    counts = lines.groupBy("file", "split").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("file", "split", "first", "last", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # both reads see the same splits in the same order; were it otherwise, a wrong number would be worse than none
    same = F.assert_true(F.col("at").between(F.col("first"), F.col("last")), F.lit("the splits of a file changed between two reads"))
    rows = lines.join(base, ["file", "split"], "left").select(F.regexp_replace("value", r"\r$", "").alias("line"), "file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("number"), same.alias("same"))
    return rows.where(F.col("same").isNull()).where(F.trim("line") != "").drop("same")


def reject_messages(events: DataFrame) -> DataFrame:
    """Rejected events of parse_clef() over numbered lines, or of parse_plain(), with message: `line N: reason` or `item N: reason`; the reason alone where a body is none."""
    place = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{word} "), F.col(c).cast("string"), F.lit(": "))) for c, word in (("number", "line"), ("item", "item")) if c in events.columns]
    return events.where("error is not null").withColumn("message", F.concat(F.coalesce(*place, F.lit("")), F.col("error")))


def _is(value: Column, kind: str) -> Column:
    return F.schema_of_variant(value) == kind


def _text(value: Column) -> Column:
    """A variant as text: strings as they are, anything else as JSON; null if missing."""
    return F.when(_is(value, "STRING"), F.try_variant_get(value, "$", "string")).when(value.isNotNull(), F.to_json(value))


def _string(value: Column) -> Column:
    """A variant if it is a string."""
    return F.when(_is(value, "STRING"), F.try_variant_get(value, "$", "string"))


def _members(document: str, variant: str) -> tuple[Column, Column]:
    """The distinct member names of a JSON object in order, and a map of their values; null where it isn't one. Of equal names the last value counts."""
    return F.array_distinct(F.expr(f"json_object_keys({document})")), F.try_variant_get(F.col(variant), "$", "map<string,variant>")


def _object(entries: Column) -> Column:
    """JSON text of an object from an array of (k, v variant); of equal names the last one counts, in the place of the first. The entries are made once, as the value of a lambda."""

    def once(entries: Column) -> Column:
        names = F.transform(entries, lambda e: e["k"])
        distinct = F.transform(F.array_distinct(names), lambda k: F.struct(k.alias("k"), F.element_at(F.filter(entries, lambda e: e["k"] == k), -1)["v"].alias("v")))
        return F.when(F.size(F.array_distinct(names)) < F.size(names), distinct).otherwise(entries)

    return F.to_json(F.map_from_entries(F.element_at(F.transform(F.array(entries), once), 1)))


def _entry(name: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("k"), value.cast("variant").alias("v"))


def _finish(df: DataFrame) -> DataFrame:
    """Rendered messages and event types: the only Python here, on distinct values of each batch."""
    message = F.when(F.col("message").isNotNull(), F.col("message")).otherwise(F.coalesce(render_template("template", "properties"), F.lit("")))
    df = df.withColumn("message", message)
    return df.withColumn("event_type", event_type_hash(F.col("template"), F.col("message")))


def parse_clef(lines: DataFrame, now, spans: bool = False) -> DataFrame:
    """Adds the event's columns, and error for lines that are rejected. Other columns of lines stay.

    A line is parsed once; columns are read from its members, and the bag of properties from a map of them, so a name may hold any character. A time without a date
    is no timestamp: the clock is an argument. With spans, start_ts and parent_span_id are columns, too: what traces.with_spans() reads from the bag.
    """
    own = [F.col(f"`{c}`") for c in lines.columns]
    line, names = F.col("line"), _members("line", "__j")[0]
    read = {"t": "@t", "l": "@l", "mt": "@mt", "msg": "@m", "x": "@x", "ps": "@ps", "st": "@st", "own_ps": "_parentSpanId", "own_st": "_spanStart"}
    strings = {"tr": "@tr", "sp": "@sp", "source": "SourceContext", "machine": "MachineName"}
    # steps stand in columns of their own: an expression would be computed in each place that reads it, and code that is too long isn't compiled
    v = lines.withColumn("__j", marked_json(line))
    is_object = is_whole("__j", line) & F.ltrim(line, F.lit(" \t\r\n")).startswith("{")
    members = F.try_variant_get("__j", "$[0]", "struct<" + ",".join(f"`{n}`:variant" for n in (read | strings).values()) + ">")
    values = F.try_variant_get("__j", "$[0]", "map<string,variant>")
    v = v.select(*own, names.alias("__k"), *[F.when(is_object, x).alias(n) for x, n in ((members, "__s"), (values, "__m"))])
    v = v.select(*own, "__k", "__m", "__s", *[F.col(f"__s.`{n}`").alias(f"__{k}") for k, n in (read | strings).items()])
    c = {k: F.col(f"__{k}") for k in read | strings}
    time = _string(c["t"])
    stamp = F.when(c["t"].isNull(), at(now)).when(time.rlike(r"^\s*[+-]?\d{4,}-"), F.try_to_timestamp(time))
    v = v.select(*own, "__k", "__m", F.col("__s").isNotNull().alias("__is"), stamp.alias("__stamp"), *[c[k] for k in read], *[_string(c[k]).alias(f"__{k}") for k in strings])
    raw_level = _text(c["l"])
    known = level_lookup(raw_level)
    # members in order: nested values as JSON strings, reserved names left out, @@ as @
    nested = lambda x: F.schema_of_variant(x).rlike("^(OBJECT|ARRAY)")
    found = F.transform(F.filter("__k", lambda k: ~k.isin(*RESERVED)), lambda k: F.struct(k.alias("k"), F.try_element_at("__m", k).alias("v")))  # one lookup a member
    bag = F.transform(found, lambda e: F.struct(
        F.when(e["k"].startswith("@@"), F.substring(e["k"], 2, 1_000_000)).otherwise(e["k"]).alias("k"), F.when(nested(e["v"]), F.to_json(e["v"]).cast("variant")).otherwise(e["v"]).alias("v")))
    extra = F.array_compact(F.array(
        F.when(_is(c["ps"], "STRING"), _entry("_parentSpanId", _string(c["ps"]))), F.when(_is(c["st"], "STRING"), _entry("_spanStart", _string(c["st"]))),
        F.when(raw_level.isNotNull() & known.isNull(), _entry("_rawLevel", raw_level))))
    error = F.when(~F.col("__is"), F.lit("not a JSON object")).when(F.col("__stamp").isNull(), F.lit("invalid @t"))
    out = v.select(
        *own, F.when(F.col("__is"), F.col("__stamp")).alias("ts"), F.coalesce(known, F.lit(2)).alias("level"), _text(c["mt"]).alias("template"), _text(c["msg"]).alias("message"), _text(c["x"]).alias("exception"),
        c["tr"].alias("trace_id"), c["sp"].alias("span_id"), c["source"].alias("source"), c["machine"].alias("machine"),
        F.when(F.col("__is"), _object(F.concat(bag, extra))).alias("properties"), error.alias("error"), *([span_start(_kept(c["st"], c["own_st"])).alias("start_ts"), _kept(c["ps"], c["own_ps"]).alias("parent_span_id")] if spans else []))
    return _finish(out)


def _kept(value: Column, own: Column) -> Column:
    """What the bag holds under the name of a reified member: its text, or that of a property of that name; a JSON null is none."""
    return F.coalesce(_string(value), F.when(~_is(own, "VOID"), _text(own)))


PLAIN = "struct<timestamp:string,level:string,message:string,exception:string,template:string,traceId:string,spanId:string,source:string,properties:string>"


def parse_plain(bodies: DataFrame, now) -> DataFrame:
    """Rows with body, one JSON object or an array of them, to events with the number of their item (from 1).

    A body that isn't JSON as a whole is one event with an error (item null), and so is an item that isn't an object. Properties that aren't an object are none.
    """
    others = [F.col(f"`{c}`") for c in bodies.columns if c != "body"]

    def as_items(body: Column) -> Column:
        text = F.trim(body)
        listed = F.when(valid_json(body), F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]"))))
        return F.coalesce(F.transform(F.from_json(listed, "array<string>"), lambda x, i: F.struct((i + 1).alias("n"), x.alias("text"))), F.array(F.struct(F.lit(None).cast("int").alias("n"), F.lit(None).cast("string").alias("text"))))

    # the body is bound once, as the value of a lambda, and no condition stands on items: as one, it would be pushed down with the whole body in each of its places
    items = F.element_at(F.transform(F.array("body"), as_items), 1)
    e = bodies.select(*others, F.explode_outer(items).alias("__i")).where("__i is not null")  # an empty list has none
    is_object = F.coalesce(F.trim("__i.text").startswith("{"), F.lit(False))
    e = e.select(*others, F.col("__i.n").alias("item"), F.from_json("__i.text", PLAIN).alias("e"), is_object.alias("is_object"))
    stamp = F.when(F.col("e.timestamp").isNull(), at(now)).otherwise(F.try_to_timestamp("e.timestamp"))
    bag = F.coalesce(F.when(F.trim("e.properties").startswith("{"), F.col("e.properties")), F.lit("{}"))
    error = F.when(~F.col("is_object"), F.lit("not a JSON object")).when(stamp.isNull(), F.lit("invalid timestamp"))
    out = e.select(
        *others, "item", stamp.alias("ts"), level_number(F.coalesce("e.level", F.lit(""))).alias("level"), F.col("e.template").alias("template"), F.col("e.message").alias("message"),
        F.col("e.exception").alias("exception"), F.col("e.traceId").alias("trace_id"), F.col("e.spanId").alias("span_id"), F.col("e.source").alias("source"), F.lit(None).cast("string").alias("machine"), bag.alias("properties"), error.alias("error"))
    return _finish(out)


def with_member(properties: Column, name: str, value: str) -> Column:
    """A JSON bag with one more member."""
    inner = F.substring(properties, 2, 1_000_000_000)
    comma = F.when(F.trim(inner) == "}", F.lit("")).otherwise(F.lit(","))
    return F.concat(F.lit(f'{{"{name}":{value}'), comma, inner)


def admit(events: DataFrame, apps: DataFrame, now) -> DataFrame:
    """Adds status (accepted, filtered, rejected) and reason. apps (app_id, minimum_level) is a control table; Spark broadcasts it by its size."""
    floors = apps.select(F.col("app_id").alias("__app"), F.col("minimum_level").alias("__floor"))
    e = events.join(floors, F.col("app_id") == F.col("__app"), "left")
    error = F.col("error") if "error" in events.columns else F.lit(None).cast("string")
    reason = (F.when(error.isNotNull(), error)
              .when(F.col("ts") < at(now) - F.make_dt_interval(F.lit(OLDEST_DAYS)), F.lit("timestamp too old"))
              .when(F.col("ts") > at(now) + F.make_dt_interval(F.lit(0), F.lit(NEWEST_HOURS)), F.lit("timestamp in the future")))
    low = F.col("level") < F.coalesce("__floor", F.lit(0))
    many = F.coalesce(F.size(F.expr("json_object_keys(properties)")), F.lit(0)) > PROPERTY_LIMIT
    reason = F.coalesce(reason, F.when(~low & many, F.lit("too many properties")))
    status = F.when(reason.isNotNull(), "rejected").when(low, "filtered").otherwise("accepted")
    return e.withColumn("status", status).withColumn("reason", reason).drop("__app", "__floor")


def mark_late_truncated(events: DataFrame, now) -> DataFrame:
    """Marks long lines (column line) and events of earlier days in their bags; day is the event's own."""
    long = F.length("line") > LINE_LIMIT if "line" in events.columns else F.lit(False)
    late = F.to_date("ts") < F.to_date(at(now))
    bag = F.coalesce("properties", F.lit("{}"))
    bag = F.when(long, with_member(bag, "_truncated", "true")).otherwise(bag)
    return (events.withColumn("properties", F.when(late, with_member(bag, "_lateArrival", "true")).otherwise(bag))
            .withColumn("message", F.when(long, F.substring("message", 1, LINE_LIMIT)).otherwise(F.col("message"))).withColumn("day", F.to_date("ts")))


def ingest_summary(events: DataFrame, keys: tuple[str, ...] = ("app_id",), examples: int = 10) -> DataFrame:
    """Counts of each batch, and its first distinct reasons in order."""
    reasons = events.where("reason is not null").groupBy(*keys, "reason").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list("reason")), 1, examples).alias("errors"))
    counts = events.groupBy(*keys).agg(F.count_if(F.col("status") != "rejected").alias("accepted"), F.count_if(F.col("status") == "rejected").alias("rejected"))
    return counts.join(reasons, list(keys), "left")


def to_clef(events: DataFrame) -> DataFrame:
    """(line): events as compact JSON; empty fields are left out, names that begin with @ are escaped, reserved names skipped."""
    names, values = _members("properties", "__v")
    e = events.withColumn("__v", F.try_parse_json("properties")).withColumn("__k", F.coalesce(names, F.array().cast("array<string>"))).withColumn("__m", values)
    field = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", _entry(name, c))
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    head = F.array_compact(F.array(field("@t", stamp), field("@mt", F.col("template")), F.when(F.coalesce("template", F.lit("")) == "", field("@m", F.col("message"))), field("@l", level_name(F.col("level"))),
                                   field("@x", F.col("exception")), field("@tr", F.col("trace_id")), field("@sp", F.col("span_id")), field("SourceContext", F.col("source"))))
    rest = F.transform(F.filter("__k", lambda k: k != "SourceContext"), lambda k: F.struct(F.when(k.startswith("@"), F.concat(F.lit("@"), k)).otherwise(k).alias("k"), F.try_element_at("__m", k).alias("v")))
    return e.select(_object(F.concat(head, rest)).alias("line"))


def write_clef(events: DataFrame, path: str) -> None:
    to_clef(events).write.mode("overwrite").text(path)
