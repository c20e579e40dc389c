"""Repeated byte strings by suffix arrays that are built through Lyndon grouping (operator 9).

A byte is removed if it lies in a string of `width` bytes that also starts anywhere else in the table, overlaps included.

1. Equal texts are one text: where one of width bytes or more has a copy, all of it repeats. Each distinct text goes on once.
2. Every window of width bytes has an anchor, its smallest rolling hash of GRAM bytes (leftmost among equal ones); equal windows
   have equal anchors at equal offsets. The windows of one text that share an anchor form a context: the bytes that they cover.
   Contexts are grouped by anchor hash; only that hash and a hash of the context are shuffled. An anchor that occurs once has no
   repeat; an equal context elsewhere means that all its windows repeat.
3. Where an anchor has several different contexts, their bytes are needed. They meet in bounded bins, dealt by anchor. In a
   bin, context ends that no other context of the anchor agrees with are cut off (no repeated window lies there), and a suffix array
   over what remains tells the windows whose neighbour in order shares width bytes.
4. The suffix array comes from Lyndon grouping in linear time: suffixes are grouped by their first byte; groups are processed
   in descending order, and each tells its members' previous-smaller positions apart by how often it points to them, until
   every group holds the suffixes with one common longest Lyndon prefix. Then groups are read in ascending order: each suffix that is
   put out puts its previous-smaller position at the front of its own group. Nothing is renamed and nothing recurses.
5. An anchor with more than BIN_CONTEXTS different contexts (a passage that very many documents share, with their own text
   around) is never gathered. Its windows are told apart by counts over 128-bit BLAKE2b digests of runs of windows, in steps of
   BLOCKS windows: a run whose union is found twice repeats as a whole, one whose common core is found once doesn't
   repeat at all, any other is split. Wherever equality is told by digests, those are BLAKE2b or SHA-256; rolling hashes choose anchors only.

Cases: null and empty texts have 0 bytes and the hash of nothing; a text shorter than width keeps all; rows that repeat
an id are different starts, like any other rows; other columns aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import bytesops as B
from .common import cut, table

WIDTH, GRAM = 400, 32
#: Different contexts of one anchor that may meet in a bin, and about how many contexts a bin holds.
BIN_CONTEXTS, BIN = 192, 800
#: Windows that are told apart together where an anchor has more contexts, step by step.
BLOCKS = (64, 8, 1)
#: Windows of a text that are looked at together, and bits of a position among them, beside the hash bits that order anchors.
CHUNK, POSITION = 1 << 22, 23


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum over each w consecutive values, from block-wise prefix and suffix minima."""
    m = len(h) - w + 1
    x = np.concatenate([h, np.full((-len(h)) % w, ~B.U(0), B.U)]).reshape(-1, w)
    left = np.minimum.accumulate(x, 1).ravel()
    right = np.ascontiguousarray(np.minimum.accumulate(x[:, ::-1], 1)[:, ::-1]).ravel()
    return np.minimum(right[:m], left[w - 1 : w - 1 + m])


def anchored(text: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of each run of windows with one anchor: anchor hash, first window, windows, anchor offset."""
    h = B.Rolling(text).fixed(gram)
    low = window_minima((h >> B.U(POSITION) << B.U(POSITION)) | np.arange(len(h), dtype=B.U), width - gram + 1) & B.U((1 << POSITION) - 1)
    start = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    at = low[start].astype(np.int64)
    return h[at], start, np.diff(np.append(start, len(low))), at - start


def contexts(text: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of each run of windows with one anchor: anchor hash, first window, windows, anchor offset, two halves of a digest of the bytes.

    Long texts go by chunks of windows; a run that crosses their border is two.
    """
    parts = []
    for s in range(0, len(text) - width + 1, CHUNK):
        key, start, n, at = anchored(text[s : s + CHUNK + width - 1], width, gram)
        parts.append((key, start + s, n, at))
    if not parts:
        none = np.zeros(0, np.int64)
        return none.astype(B.U), none, none, none, none.astype(B.U), none.astype(B.U)
    key, start, n, at = (np.concatenate(x) for x in zip(*parts, strict=True))
    raw = text.tobytes()
    both = b"".join(blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), (start + n + width - 1).tolist(), strict=True))
    c = np.frombuffer(both, B.U).reshape(-1, 2)
    return key, start, n, at, c[:, 0], c[:, 1]


def suffix_array(text: list[int]) -> list[int]:
    """Suffixes in ascending order, by Lyndon grouping. Symbols are whole numbers; a suffix that ends is smaller."""
    n = len(text)
    by_symbol: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        by_symbol.setdefault(c, []).append(i)
    members = [by_symbol[c] for c in sorted(by_symbol)]
    group = [0] * n
    for g, own in enumerate(members):
        for s in own:
            group[s] = g
    lower = list(range(-1, len(members) - 1))  # of each group, the next lower one
    above: dict[int, int] = {g: g + 1 for g in range(len(members) - 1)}
    prev = [-1] * n  # nearest position before in a lower group, known for all suffixes of processed groups
    done = bytearray(n)
    order: list[list[int]] = []
    g = len(members) - 1
    while g >= 0:
        own = [s for s in members[g] if group[s] == g]
        members[g] = own
        moved: dict[tuple[int, int], list[int]] = {}
        parent, times = -1, 0
        for s in own:
            j = s - 1
            while j >= 0 and (done[j] or group[j] == g):
                j = prev[j]
            prev[s] = j
            if j == parent:
                times += 1
            else:
                if parent >= 0:
                    moved.setdefault((group[parent], times), []).append(parent)
                parent, times = j, 1
        if parent >= 0:
            moved.setdefault((group[parent], times), []).append(parent)
        for s in own:
            done[s] = 1
        if own:
            order.append(own)
        # parents with more pointers stand above those with fewer, all above what stays in their old group
        for old, times in sorted(moved, reverse=True):
            new, up = len(members), above.get(old, -1)
            members.append(moved[old, times])
            for s in members[new]:
                group[s] = new
            lower.append(old)
            above[old], above[new] = new, up
            if up >= 0:
                lower[up] = new
        g = lower[g]
    order.reverse()
    place, slot = [0] * n, 0
    front = []
    for i, own in enumerate(order):
        front.append(slot)
        slot += len(own)
        for s in own:
            place[s] = i
    out, put = [0] * n, bytearray(n)
    for i in range(-1, n):
        j = (n if i < 0 else out[i]) - 1
        while j >= 0 and not put[j]:
            at = front[place[j]]
            out[at] = j
            front[place[j]] = at + 1
            put[j] = 1
            j = prev[j]
    return out


def _shared(strings: list[bytes]) -> list[int]:
    """Of each string, the longest common prefix with any other one: a neighbour in order has it."""
    order = sorted(range(len(strings)), key=strings.__getitem__)
    best = [0] * len(strings)
    for a, b in zip(order, order[1:], strict=False):
        x, y = strings[a], strings[b]
        n = min(len(x), len(y))
        if x[:n] != y[:n]:
            n = int(np.argmax(np.frombuffer(x, np.uint8, n) != np.frombuffer(y, np.uint8, n)))
        best[a], best[b] = max(best[a], n), max(best[b], n)
    return best


def trimmed(group: list[tuple[int, bytes]], width: int) -> list[tuple[int, int] | None]:
    """Of contexts (anchor offset, bytes) of one anchor: the range of bytes where windows could repeat, or None."""
    right = _shared([x[a:] for a, x in group])
    left = _shared([x[:a][::-1] for a, x in group])
    return [(a - lo, a + hi) if lo + hi >= width else None for (a, _), lo, hi in zip(group, left, right, strict=True)]


def _spans(flags: list[int], base: int) -> list[tuple[int, int]]:
    """Runs of set flags as (from, to) windows."""
    f = np.flatnonzero(np.diff(np.concatenate([[0], np.asarray(flags, np.int8), [0]])))
    return [(base + int(a), base + int(b)) for a, b in zip(f[::2], f[1::2], strict=True)]


def bin_repeats(rows: list[tuple[int, int, bytes, int]], width: int) -> list[list[tuple[int, int]]]:
    """Contexts (anchor hash, anchor offset, bytes, times found): of each, the runs of windows that repeat."""
    by_key: dict[int, list[int]] = {}
    for i, r in enumerate(rows):
        by_key.setdefault(r[0], []).append(i)
    pieces: dict[tuple[int, bytes], list[tuple[int, int]]] = {}  # what remains of contexts, with (row, first byte)
    times: dict[tuple[int, bytes], int] = {}
    out: list[list[tuple[int, int]]] = [[] for _ in rows]
    lone: dict[int, set[bytes]] = {}
    for key, own in by_key.items():
        for i, cut_ in zip(own, trimmed([rows[i][1:3] for i in own], width), strict=True):
            if rows[i][3] > 1:  # found twice as it stands: all its windows repeat, for itself and for others
                out[i] = [(0, len(rows[i][2]) - width + 1)]
            if cut_ is not None:
                p = (key, rows[i][2][cut_[0] : cut_[1]])
                pieces.setdefault(p, []).append((i, cut_[0]))
                times[p] = times.get(p, 0) + rows[i][3]
                lone.setdefault(key, set()).add(p[1])
    # an anchor with one remaining piece needs no order: the piece repeats as a whole if it was found twice
    asked = [p for p in pieces if len(lone[p[0]]) > 1]
    hit: dict[tuple[int, bytes], list[int]] = {p: [int(times[p] > 1)] * (len(p[1]) - width + 1) for p in pieces}
    if asked:
        k = len(asked)
        symbols: list[int] = []
        text = bytearray()
        first, owner = [], []
        for i, p in enumerate(asked):
            first.append(len(symbols))
            symbols += [b + k for b in p[1]]
            symbols.append(i)  # an end of its own: no common prefix crosses it
            text += p[1] + b"\0"
            w = len(p[1]) - width + 1
            owner += [i] * w + [-1] * (len(p[1]) + 1 - w)
        whole = bytes(text)
        last = -1
        for s in suffix_array(symbols):
            o = owner[s]
            if o < 0:
                continue
            if last >= 0 and whole[s : s + width] == whole[last : last + width]:
                hit[asked[o]][s - first[o]] = 1
                hit[asked[owner[last]]][last - first[owner[last]]] = 1
            last = s
    for p, places in pieces.items():
        for i, at in places:
            if not out[i]:
                out[i] = _spans(hit[p], at)
    return out


def _scan(width: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = B.texts(batch.column("text"))
            sizes, t1, t2, sha, parts, lens = [], [], [], [], [], []
            for i in range(len(offs) - 1):
                x = data[offs[i] : offs[i + 1]]
                raw = x.tobytes()
                d = hashlib.sha256(raw)
                sha.append(d.hexdigest())
                t1.append(int.from_bytes(d.digest()[:8], "little", signed=True))
                t2.append(int.from_bytes(d.digest()[8:16], "little", signed=True))
                sizes.append(len(raw))
                c = contexts(x, width, gram)
                parts.append(c)
                lens.append(len(c[0]))
            where = pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32))
            cat = lambda k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0)
            lists = [pa.ListArray.from_arrays(where, pa.array(cat(k).astype(B.U).view(np.int64) if k in (0, 4, 5) else cat(k).astype(np.int32))) for k in (0, 1, 2, 4, 5)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(t1, pa.int64()), pa.array(t2, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sha, pa.string()), *lists],
                names=["id", "t1", "t2", "n_bytes", "sha", "key", "start", "n", "c1", "c2"])
    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        raw = [(x or "").encode() for x in batch.column("text").to_pylist()]
        t1 = [int.from_bytes(hashlib.sha256(x).digest()[:8], "little", signed=True) for x in raw]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(t1, pa.int64()), pa.array([press.compress(x) for x in raw], pa.binary())], names=["id", "t1", "z"])


def _extract(width: int, gram: int):
    """(z, need: array of (key, c1, c2, m, hot)) to the bytes of the needed contexts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        kind = pa.schema([("key", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("m", pa.int64()), ("hot", pa.bool_()), ("at", pa.int32()), ("body", pa.binary())])
        for batch in batches:
            for z, need in zip(batch.column("z"), batch.column("need").to_pylist(), strict=True):
                raw = unpack.decompress(z.as_py())
                key, start, n, at, c1, c2 = contexts(np.frombuffer(raw, np.uint8), width, gram)
                place = {x: i for i, x in enumerate(zip(*(x.astype(B.U).view(np.int64).tolist() for x in (key, c1, c2)), strict=True))}
                rows = []
                for r in need:
                    i = place.get((r["key"], r["c1"], r["c2"]))
                    if i is not None:
                        rows.append({**r, "at": int(at[i]), "body": raw[start[i] : start[i] + n[i] + width - 1]})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=kind)
    return run


_FOUND = "key long, c1 long, c2 long, a int, b int"


def _order(width: int):
    def run(group: pa.Table) -> pa.Table:
        key, c1, c2, at, body, m = (group.column(c).to_pylist() for c in ("key", "c1", "c2", "at", "body", "m"))
        found = bin_repeats(list(zip(key, at, body, m, strict=True)), width)
        flat = [(*own, a, b) for own, s in zip(zip(key, c1, c2, strict=True), found, strict=True) for a, b in s]
        kinds = (("key", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("a", pa.int32()), ("b", pa.int32()))
        return pa.table({n: pa.array([r[i] for r in flat], t) for i, (n, t) in enumerate(kinds)})
    return run


def _blocks(width: int, step: int, big: int):
    """Digests of runs of `step` windows: of their common core, and of their union where the context has all of them.

    `only` names the runs of `big` windows that are asked for (null: all) and those that surely repeat, which count twice at least.
    """
    kinds = pa.schema([("key", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("m", pa.int64()), ("block", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("u", pa.binary()), ("k", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, c1, c2, m, at, body, only in zip(*(batch.column(c).to_pylist() for c in ("key", "c1", "c2", "m", "at", "body", "only")), strict=True):
                n, only = len(body) - width + 1, None if only is None else dict(only)
                rows = []
                # windows by the bytes before the anchor: from `at` down
                for block in range((at - n + 1) // step, at // step + 1):
                    bottom, top = block * step, block * step + step - 1
                    sure = False if only is None else only.get(bottom // big)
                    if sure is None:
                        continue
                    a, b = max(0, at - top), min(n, at - bottom + 1)
                    core = blake2b(body[at - bottom : at - top + width], digest_size=16).digest()
                    union = blake2b(body[a : b + width - 1], digest_size=16).digest() if b - a == step else None
                    rows.append((key, c1, c2, max(m, 2) if sure else m, block, a, b, union, core))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)
    return run


_BLOCK = "key long, c1 long, c2 long, m long, block int, a int, b int, u binary, k binary"


def hot_repeats(hot: DataFrame, width: int) -> DataFrame:
    """Contexts of anchors that have too many for a bin, (key, c1, c2, m, at, body): their repeated windows (key, c1, c2, a, b)."""
    own = ["key", "c1", "c2"]
    asked, found = hot.withColumn("only", F.lit(None).cast("map<int,boolean>")), []
    steps = [x for x in BLOCKS if x == 1 or 2 * x <= width]  # windows that are told apart together have a common core
    for step, big in zip(steps, (1, *steps), strict=False):
        runs = cut(asked.mapInArrow(_blocks(width, step, big), _BLOCK))
        core = runs.groupBy("key", "block", "k").agg(F.sum("m").alias("kn")).where("kn > 1")
        if step == 1:
            found.append(runs.join(core, ["key", "block", "k"]).select(*own, "a", "b"))
            break
        union = runs.where("u is not null").groupBy("key", "block", "u").agg(F.sum("m").alias("un"), F.min(F.struct("c1", "c2")).alias("first"))
        told = runs.join(core, ["key", "block", "k"]).join(union, ["key", "block", "u"], "left")
        told = cut(told.select(*own, "block", "a", "b", "kn", F.coalesce(F.col("un") > 1, F.lit(False)).alias("sure"), "un", (F.col("first") == F.struct("c1", "c2")).alias("stands")))
        found.append(told.where("sure").select(*own, "a", "b"))
        # what is open, and one context of each repeated union that stands for it where others share the core
        still = told.where("not sure or (stands and kn > un)").groupBy(*own).agg(F.map_from_entries(F.collect_list(F.struct("block", "sure"))).alias("only"))
        asked = hot.join(still, own)
    return reduce(DataFrame.union, found)


def _finish(width: int):
    """(z, runs of windows as packed numbers) to sizes and the hash of what remains."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            removed, spans, sha = [], [], []
            for z, runs in zip(batch.column("z"), batch.column("runs").to_pylist(), strict=True):
                raw = unpack.decompress(z.as_py())
                mark = np.zeros(len(raw) + 1, np.int32)
                r = np.array(runs, np.int64)
                np.add.at(mark, r >> 32, 1)
                np.add.at(mark, (r & 0xFFFFFFFF) + width - 1, -1)
                gone = np.cumsum(mark)[:-1] > 0
                removed.append(int(gone.sum()))
                spans.append(int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum()))
                sha.append(hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("t1"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())], names=["id", "t1", "n_removed", "n_spans", "kept"])
    return run


def repeated_windows(scan: DataFrame, texts: DataFrame, width: int, gram: int) -> DataFrame:
    """Runs of repeated windows (key, c1, c2, a, b) of the contexts in scan; texts has (id, t1, z)."""
    each = scan.select("id", F.explode(F.arrays_zip("key", "c1", "c2")).alias("x")).select("id", "x.*")
    found = each.groupBy("key", "c1", "c2").agg(F.count("*").alias("m"), F.min("id").alias("id"))
    keys = found.groupBy("key").agg(F.count("*").alias("d"), F.sum("m").alias("total")).where("total > 1")
    found = cut(found.join(keys, "key").select("key", "c1", "c2", "m", "id", "d"))
    # contexts that are found twice repeat from end to end; -1 stands for the end
    whole = found.where("m > 1").select("key", "c1", "c2", F.lit(0).alias("a"), F.lit(-1).alias("b"))
    need = found.where("d > 1").groupBy("id").agg(F.collect_list(F.struct("key", "c1", "c2", "m", (F.col("d") > BIN_CONTEXTS).alias("hot"))).alias("need"))
    bodies = cut(texts.join(need, "id").select("z", "need").mapInArrow(_extract(width, gram), "key long, c1 long, c2 long, m long, hot boolean, at int, body binary").dropDuplicates(["key", "c1", "c2"]))
    n = bodies.where("not hot").count()
    bins = F.pmod(F.xxhash64("key"), F.lit(max(1, -(-n // BIN))))
    binned = bodies.where("not hot").withColumn("bin", bins).groupBy("bin").applyInArrow(_order(width), _FOUND)
    out = whole.union(binned)
    hot = bodies.where("hot").select("key", "c1", "c2", "m", "at", "body")
    return cut(out if hot.isEmpty() else out.union(hot_repeats(hot, width)))


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """docs with doc_id and text to (doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    ship(docs.sparkSession)
    scan = cut(docs.select(F.col("doc_id").alias("id"), "text").mapInArrow(_scan(width, gram), "id long, t1 long, t2 long, n_bytes long, sha string, key array<long>, start array<int>, n array<int>, c1 array<long>, c2 array<long>")
               .withColumn("own", F.coalesce("id", "t1")))
    rows = docs.select(F.col("doc_id").alias("id"), "text").mapInArrow(_pack, "id long, t1 long, z binary").withColumn("id", F.coalesce("id", "t1"))
    wins = repeated_windows(scan.select(F.col("own").alias("id"), "key", "c1", "c2"), rows, width, gram)
    each = scan.select(F.col("own").alias("id"), "t1", F.explode(F.arrays_zip("key", "c1", "c2", "start", "n")).alias("x")).select("id", "t1", "x.*")
    run = each.join(wins, ["key", "c1", "c2"])
    a, b = F.col("start") + F.col("a"), F.col("start") + F.when(F.col("b") < 0, F.col("n")).otherwise(F.col("b"))
    runs = run.select("id", "t1", (F.shiftleft(a.cast("long"), 32) + b).alias("r")).groupBy("id", "t1").agg(F.collect_set("r").alias("runs"))
    copies = scan.groupBy("t1", "t2").agg(F.count("*").alias("copies")).where("copies > 1")
    base = scan.select("id", "own", "t1", "t2", "n_bytes", "sha").join(copies, ["t1", "t2"], "left")
    base = cut(base.withColumn("all", F.col("copies").isNotNull() & (F.col("n_bytes") >= width)))
    some = base.where("not all").select(F.col("own").alias("id"), "t1").distinct().join(runs, ["id", "t1"])
    part = rows.join(some, ["id", "t1"]).select("id", "t1", "z", "runs").mapInArrow(_finish(width), "id long, t1 long, n_removed long, n_spans long, kept string").dropDuplicates(["id", "t1"])
    part = cut(part.select(F.col("id").alias("own"), "t1", "n_removed", "n_spans", "kept"))
    zero = F.lit(0).cast("long")
    return base.join(part, ["own", "t1"], "left").select(
        F.col("id").alias("doc_id"), "n_bytes",
        F.when(F.col("all"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(F.col("all"), F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(F.col("all"), F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"))


def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
