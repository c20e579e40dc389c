"""Queries over traces hold whole traces, of any length, as their SQL does; rings and trees against a plain search."""

import datetime as dt
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logspark.catalog import ORACLE_SQL, QUERIES
from logspark.operators import traces
from logspark.sources import clef
from tests.test_oracle import rows

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def long_dir(tmp_path_factory):
    """A conversation of 2,100 turns and an order of 2,100 lines, beside short ones."""
    d = tmp_path_factory.mktemp("long")
    made = {
        "conversations": "SELECT c AS conv_id, CAST(turn AS INTEGER) AS turn, if(turn % 2 = 0, 'user', 'assistant') AS role, repeat('x', CAST(hash(c, turn) % 2500 AS INTEGER)) AS text FROM range(3) t(c), range(2100) u(turn) WHERE c = 0 OR turn < 4 + c",
        "orders": "SELECT o AS o_orderkey, DATE '1996-01-01' + CAST(o AS INTEGER) AS o_orderdate FROM range(3) t(o)",
        "lineitem": "SELECT o AS l_orderkey, CAST(n AS INTEGER) AS l_linenumber, DATE '1996-01-05' + CAST(n * 7 % 5000 AS INTEGER) AS l_shipdate, if(n % 3 = 0, 'R', 'N') AS l_returnflag FROM range(3) t(o), range(1, 2101) u(n) WHERE o = 0 OR n < 4 + o",
    }
    for name, sql in made.items():
        duckdb.execute(f"COPY ({sql}) TO '{d}/{name}.parquet'")
    return d


@pytest.mark.parametrize("name", ["link_spans", "span_tree", "broken_rings", "waterfall", "stored_waterfall", "trace_summary"])
def test_long_traces_stay_whole(spark, long_dir, name):
    con = duckdb.connect()
    for p in long_dir.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = rows(con.execute(ORACLE_SQL[name]).df())
    assert len(want) == 3 or len(want) > 2100
    assert rows(QUERIES[name](spark, str(long_dir)).toPandas()) == want


def plain_tree(parents, begins):
    """(parent, depth, row) of nodes from 0 by search: nodes in order, each cut where no root is above it."""
    parent, below, out = list(parents), {}, {}
    for node in range(len(parent)):
        seen, up = {node}, parent[node]
        while up is not None and up not in seen:
            seen.add(up)
            up = parent[up]
        if up is not None:
            parent[node] = None
    for node in sorted(range(len(parent)), key=begins.__getitem__, reverse=True):
        below.setdefault(parent[node], []).append(node)
    todo = [(node, 0) for node in below.get(None, [])]
    while todo:
        node, depth = todo.pop()
        out[node] = (None if parent[node] is None else parent[node] + 1, depth, len(out) + 1)
        todo += [(child, depth + 1) for child in below.get(node, [])]
    return [out[node] for node in range(len(parent))]


def test_trees_of_any_links(monkeypatch):
    """Random parents, rings and what hangs on them among them, over batches that begin anywhere."""
    rnd = random.Random(3)
    for trial in range(60):
        want, made = [], []
        for t in range(rnd.randint(1, 9)):
            n = rnd.choice([1, 2, 3, 8, 40])
            free = [None] * (rnd.random() < 0.5)
            parents = [rnd.choice([*free, *[p for p in range(n) if p != x]] or [None]) for x in range(n)]
            begins = [(rnd.randint(0, 3), rnd.randint(0, 3), rnd.choice("ab"), str(i)) for i in range(n)]
            want += plain_tree(parents, begins)
            made += [{"trace_id": f"t{t}", "place": i + 1, "parent": None if p is None else p + 1, "__begin": b[0], "__ts": b[1], "app_id": b[2], "event_id": b[3]} for i, (p, b) in enumerate(zip(parents, begins, strict=True))]
        table = pa.Table.from_pylist(made, pa.schema([("trace_id", pa.string()), ("place", pa.int32()), ("parent", pa.int32()), ("__begin", pa.int64()), ("__ts", pa.int64()), ("app_id", pa.string()), ("event_id", pa.string())]))
        monkeypatch.setattr(traces, "TOGETHER", rnd.choice([1, 20, 1000]))
        got = pa.Table.from_batches(traces._trees(iter(table.to_batches(max_chunksize=rnd.choice([1, 3, 50])))))
        assert list(zip(*(got[c].to_pylist() for c in ("parent", "depth", "row")), strict=True)) == want, trial


def test_stored_spans_need_no_bag(spark):
    """Starts and parents come from the parsed line as from its bag, which the waterfall of stored spans doesn't make; a trace's bounds come from one window."""
    lines = ['{"@t":"2024-01-02","@st":"2024-01-01T00:00:00Z","@ps":"p","_spanStart":"2023-01-01"}', '{"_spanStart":"2023-01-01","_parentSpanId":"q","@ps":5}', '{"_spanStart":"12:30","_parentSpanId":null}', '{"_parentSpanId":[1]}',
             '{"@st":null,"_spanStart":"2023-01-01"} x', "[]"]
    both = clef.parse_clef(spark.createDataFrame(list(enumerate(lines)), "id int, line string"), dt.datetime(2024, 1, 1), spans=True).withColumn("day", F.to_date("ts"))
    bag = traces.with_spans(both.drop("start_ts", "parent_span_id")).orderBy("id").select("start_ts", "parent_span_id").collect()
    assert both.orderBy("id").select("start_ts", "parent_span_id").collect() == bag and [r.parent_span_id for r in bag] == ["p", "q", None, "[1]", None, None]
    plan = QUERIES["stored_waterfall"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "map_from_entries" not in plan and sum(x.strip(" :+-").startswith("Window [") for x in plan.splitlines()) == 2
