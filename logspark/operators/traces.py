"""Traces over all apps: assembly, span links, rings, tree order, waterfall and summary.

Events have trace_id, app_id, event_id (text), ts, start_ts (null for log lines), span_id, parent_span_id, level; log events as they are stored get what they lack from
with_spans().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import span_start
from ..shared import in_sequence
from .ids import event_id
from .search import at, newest_days

ORDER = ("ts", "app_id", "event_id")
SPAN = ("start_ts", "parent_span_id", "event_id")
#: Most events of a trace that limit_traces() keeps, and the default.
MOST, USUAL = 2000, 500


def with_spans(events: DataFrame) -> DataFrame:
    """Log events with start_ts and parent_span_id, from the bag's _spanStart and _parentSpanId, and with event_id as text. What is there already stays."""
    start = F.get_json_object("properties", "$._spanStart")
    made = {"start_ts": span_start(start), "parent_span_id": F.get_json_object("properties", "$._parentSpanId"), "event_id": event_id(F.col("day"), F.col("id")) if "id" in events.columns else None}
    return events.withColumns({k: v for k, v in made.items() if k not in events.columns and v is not None})


def assemble_traces(events: DataFrame, ids: DataFrame | None = None, apps: list[str] | None = None, near=None, days: int = 7) -> DataFrame:
    """Events of each trace: on the days around near, or on each app's newest days. Blank trace ids are no traces."""
    rows = events.where(F.coalesce(F.trim("trace_id"), F.lit("")) != "")
    if apps is not None:
        rows = rows.where(F.col("app_id").isin(apps))
    if near is not None:
        day = F.to_date(at(near))
        rows = rows.where(F.col("day").between(F.date_sub(day, 1), F.date_add(day, 1)))
    else:
        recent = newest_days(events.where(F.col("app_id").isin(apps)) if apps is not None else events, days)
        rows = rows.join(recent, ["app_id", "day"])
    return rows if ids is None else rows.join(ids.select("trace_id").distinct(), "trace_id", "left_semi")


def place_events(events: DataFrame) -> DataFrame:
    """All events of each trace, with place (from 1) and truncated, which is false."""
    events = with_spans(events) if not set(SPAN) <= set(events.columns) else events
    return events.withColumn("place", F.row_number().over(Window.partitionBy("trace_id").orderBy(*ORDER))).withColumn("truncated", F.lit(False))


def limit_traces(events: DataFrame, limit: int = USUAL) -> DataFrame:
    """The oldest events of each trace, as place_events(), and whether there are more."""
    events = with_spans(events) if not set(SPAN) <= set(events.columns) else events
    limit = max(1, min(MOST, limit))
    place = F.row_number().over(Window.partitionBy("trace_id").orderBy(*ORDER))
    # a rank bound below the window's own filter keeps a runaway trace from being sorted whole
    kept = events.withColumn("place", place).where(F.col("place") <= limit + 1)
    most = F.max("place").over(Window.partitionBy("trace_id"))
    return kept.withColumn("truncated", most > limit).where(F.col("place") <= limit)


def link_spans(events: DataFrame) -> DataFrame:
    """Adds is_span and parent, the place of the parent span in its trace (null for roots). A span needs a start; an id only to be a parent."""
    events = with_spans(events) if not {"start_ts", "parent_span_id"} <= set(events.columns) else events
    e = events.withColumn("is_span", F.coalesce((F.col("start_ts") <= F.col("ts")), F.lit(False)))
    key = F.when(F.col("is_span"), F.col("parent_span_id")).otherwise(F.col("span_id"))
    # a row under the key that it looks for, and, of spans with an id, one under its own; both stay in the trace's partition, so events are neither read twice nor shuffled again
    look = F.struct(F.nullif(key, F.lit("")).alias("key"), F.lit(False).alias("own"))
    own = F.when(F.col("is_span") & (F.col("span_id") != ""), F.struct(F.col("span_id").alias("key"), F.lit(True).alias("own")))
    both = e.withColumn("__k", F.explode_outer(F.array_compact(F.array(look, own))))
    rest = [F.when(~F.col("__k.own"), F.col(c)).alias(c) for c in e.columns if c not in ("trace_id", "place")]
    both = both.select("trace_id", "place", *rest, F.col("__k.key").alias("__key"), F.col("__k.own").alias("__own"))
    first = F.min(F.when(F.col("__own"), F.col("place"))).over(Window.partitionBy("trace_id", "__key"))
    found = both.withColumn("parent", F.when(F.col("trace_id").isNotNull() & F.col("__key").isNotNull(), first)).where("not __own")
    return found.select(*e.columns, F.when(F.col("parent") != F.col("place"), F.col("parent")).alias("parent"))


def _runs(ids: pa.Array) -> tuple[list[int], list]:
    """Ends and values of the runs of equal ids, nulls among them."""
    runs = pc.run_end_encode(ids)
    return runs.run_ends.to_pylist(), runs.values.to_pylist()


def _cut_rings(parent: np.ndarray, longest: int) -> np.ndarray:
    """The parents of nodes, without (len(parent)) where a ring is cut: at each node that no root is above of and that comes before all that are above it."""
    n = len(parent)
    up, first = np.append(parent, n), np.arange(n + 1)
    for _ in range(longest.bit_length()):  # all nodes above, twice as many in each step
        if (up == n).all():
            return parent
        first = np.minimum(first, first[up])
        up = up[up]
    return np.where((up != n) & (first == np.arange(n + 1)), n, np.append(parent, n))[:n]


def _numbered(parent: np.ndarray, trace: np.ndarray, order: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Depth and depth-first number (from 1 in each trace) of nodes without rings; order: all nodes, siblings in order.

    A walk around each tree enters and leaves every node; what is left of the walk at each step adds up in steps that double, so deep trees cost no more than wide ones.
    """
    n, traces = len(parent), int(trace[-1]) + 1
    top = np.where(parent == n, n + trace, parent)  # traces are nodes above their roots
    by = order[np.argsort(top[order], kind="stable")]
    nodes = n + traces
    head = np.append(True, top[by[1:]] != top[by[:-1]])
    after = np.arange(2 * nodes)  # entering is x, leaving nodes + x; the walk ends where a trace is left
    after[:nodes] += nodes
    after[top[by[head]]] = by[head]
    tail = np.append(head[1:], True)
    after[nodes + by] = np.where(tail, nodes + top[by], np.append(by[1:], 0))
    seen, deep = np.zeros(2 * nodes, np.int32), np.zeros(2 * nodes, np.int32)
    seen[:n] = deep[:n] = 1
    deep[nodes : nodes + n] = -1
    for _ in range((2 * longest + 2).bit_length()):
        seen, deep, after = seen + seen[after], deep + deep[after], after[after]
    return -deep[:n], seen[n + trace] - seen[:n] + 1


def _tree(rows: pa.Table) -> pa.Table:
    """Rows of whole traces, in order of trace and place, with parent (rings cut), depth and row in place of parent and the columns that only give the order of siblings."""
    ends = np.array(_runs(rows["trace_id"].combine_chunks())[0])
    lengths = np.diff(ends, prepend=0)
    trace = np.repeat(np.arange(len(ends)), lengths)
    key = trace * (1 << 32) + rows["place"].to_numpy()
    named = rows["parent"].is_valid().to_numpy(zero_copy_only=False)
    wanted = trace * (1 << 32) + pc.fill_null(rows["parent"], 0).to_numpy()
    at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
    parent, longest = np.where(named & (key[at] == wanted), at, len(key)), int(lengths.max())
    parent = _cut_rings(parent, longest)
    order = pc.sort_indices(rows, [(c, "ascending") for c in ("__begin", "__ts", "app_id", "event_id")]).to_numpy().astype(np.int64)
    depth, row = _numbered(parent, trace, order, longest)
    out = rows.drop_columns(["parent", "__begin", "__ts"])
    root = parent == len(key)
    places = pa.array(rows["place"].to_numpy()[np.where(root, 0, parent)], pa.int32(), mask=root)
    for name, values in (("parent", places), ("depth", depth), ("row", row)):
        out = out.append_column(name, pa.array(values, pa.int32()))
    return out


#: Rows of whole traces that are numbered at once, at least; a trace is never parted.
TOGETHER = 20_000


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_tree() of rows in order of trace and place; a trace may go on over any number of batches, and each is looked at once."""
    held: list[pa.RecordBatch] = []
    n, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        ends, ids = _runs(batch.column("trace_id"))
        start = ends[-2] if len(ends) > 1 else 0
        if n + start >= TOGETHER and (start or ids[0] != last):  # all before the batch's last trace is whole
            yield from _tree(pa.Table.from_batches([*held, batch.slice(0, start)])).to_batches(max_chunksize=10_000)
            held, n, batch = [], 0, batch.slice(start)
        held.append(batch)
        n, last = n + batch.num_rows, ids[-1]
    if held:
        yield from _tree(pa.Table.from_batches(held)).to_batches(max_chunksize=10_000)


def span_tree(linked: DataFrame) -> DataFrame:
    """Adds depth and row, and replaces parent by null where a ring was cut. Traces of any length stream in order; one is held at a time, so leave out columns that aren't needed."""
    begin = F.when(F.col("is_span"), F.col("start_ts")).otherwise(F.col("ts"))
    rows = in_sequence(linked.withColumn("__begin", F.unix_micros(begin)).withColumn("__ts", F.unix_micros("ts")), ["trace_id"], "place")
    kept = [f for f in linked.schema if f.name != "parent"]
    return rows.mapInArrow(_trees, T.StructType([*kept, *[T.StructField(c, T.IntegerType()) for c in ("parent", "depth", "row")]]))


def waterfall(linked: DataFrame) -> DataFrame:
    """Adds offset_ms, left_pct and width_pct in the trace's span of time."""
    whole = Window.partitionBy("trace_id")
    begin = F.when(F.col("is_span"), F.unix_micros("start_ts")).otherwise(F.unix_micros("ts"))
    # first the trace's own values, so that one window gives them: what is made of them is no window's input again
    rows = linked.select("*", F.min(begin).over(whole).alias("__start"), F.max(F.unix_micros("ts")).over(whole).alias("__last"))
    start = F.col("__start")
    end = F.greatest("__last", start)
    total = F.greatest((end - start) / 1000.0, F.lit(0.0))
    offset = (begin - start) / 1000.0
    left = F.least(F.lit(100.0), F.greatest(F.lit(0.0), offset * 100 / F.when(total > 0, total).otherwise(F.lit(1.0))))
    width = F.when(F.col("is_span"), (F.unix_micros("ts") - begin) / 1000.0).otherwise(F.lit(0.0)) * 100 / F.when(total > 0, total).otherwise(F.lit(1.0))
    return rows.withColumn("offset_ms", offset).withColumn("left_pct", left).withColumn("width_pct", F.greatest(F.lit(0.0), F.least(width, F.lit(100.0) - F.col("left_pct")))).drop("__start", "__last")


def trace_summary(linked: DataFrame) -> DataFrame:
    begin = F.when(F.col("is_span"), F.unix_micros("start_ts")).otherwise(F.unix_micros("ts"))
    return linked.groupBy("trace_id").agg(
        ((F.greatest(F.max(F.unix_micros("ts")), F.min(begin)) - F.min(begin)) / 1000.0).alias("duration_ms"), F.count_if("is_span").alias("spans"), F.count_distinct("app_id").alias("apps"),
        F.count_if(F.col("level") >= 4).alias("errors"), F.count("*").alias("events"), F.max("truncated").alias("truncated"))
